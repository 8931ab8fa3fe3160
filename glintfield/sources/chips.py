"""Complex samples: px(chip, r, c, re, im), dense per chip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintfield.operators.spectral import unpacked
from glintfield.session import table

LINES, SAMPLES = 64, 32


def lines_from_embeddings(spark, sf_dir: str) -> DataFrame:
    """64 vectors of 64 floats are one chip of 64 lines(chip, r, re, im) of 32 complex samples; only whole chips."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / LINES).cast("long").alias("chip"), (F.col("vec_id") % LINES).cast("int").alias("r"), F.col("embedding").cast("array<double>").alias("e"))
    whole = rows.groupBy("chip").agg(F.count(F.lit(1)).alias("n")).where(f"n = {LINES}").select("chip")
    half = lambda k: F.filter("e", lambda x, i: i % 2 == k)
    return rows.join(whole, "chip", "left_semi").select("chip", "r", half(0).alias("re"), half(1).alias("im"))


def chips_from_embeddings(spark, sf_dir: str) -> DataFrame:
    """The same chips as samples px(chip, r, c, re, im)."""
    return unpacked(lines_from_embeddings(spark, sf_dir), "c")


def window(px: DataFrame, r0: int, c0: int, height: int, width: int) -> DataFrame:
    """The samples of a half-open pixel window, with their own numbering from 0."""
    inside = (F.col("r") >= r0) & (F.col("r") < r0 + height) & (F.col("c") >= c0) & (F.col("c") < c0 + width)
    return px.where(inside).withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


#: The same chips for the SQL twin.
PX_SQL = """px AS (
  SELECT v.vec_id // 64 AS chip, CAST(v.vec_id % 64 AS INT) AS r, CAST(t.c AS INT) AS c,
         CAST(v.embedding[2*t.c+1] AS DOUBLE) AS re, CAST(v.embedding[2*t.c+2] AS DOUBLE) AS im
  FROM embeddings v CROSS JOIN range(32) t(c)
  WHERE v.vec_id // 64 IN (SELECT vec_id // 64 FROM embeddings GROUP BY 1 HAVING count(*) = 64))"""
