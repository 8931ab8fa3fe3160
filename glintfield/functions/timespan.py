"""Acquisition times: tolerant parsing, spans, equal ranges a band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO-8601 with Z or offset; fractions beyond microseconds are cut; anything else is null."""
    clean = F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1")
    return F.when(clean.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"), F.try_to_timestamp(clean))


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def span_seconds(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / 1e6


def band_ranges(spans: DataFrame, key: str, bands: int) -> DataFrame:
    """(key, band from 1, t0, t1 in microseconds): equal parts of [start_us, end_us); none without a span."""
    part = (F.col("end_us") - F.col("start_us")) / bands
    long = spans.where("end_us > start_us").select(key, "start_us", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("k"))
    edge = lambda k: F.floor(F.col("start_us") + F.col("part") * k).cast("long")
    return long.select(key, (F.col("k") + 1).alias("band"), edge(F.col("k")).alias("t0"), edge(F.col("k") + 1).alias("t1"))


def layer_ranges(layers: DataFrame, key: str) -> DataFrame:
    """layers(key, start_us, end_us, bands, last_is_alpha) as (key, band, t0, t1 in microseconds).

    Two bands or more share the span in equal parts, an alpha band at the end has none; a span that does not last gives no
    rows. Fewer than two bands have the whole span as band 0, whatever its length. A null start or end gives no rows.
    """
    known = layers.where("start_us IS NOT NULL AND end_us IS NOT NULL")
    whole = known.where("bands < 2 OR bands IS NULL").select(key, F.lit(0).alias("band"), F.col("start_us").alias("t0"), F.col("end_us").alias("t1"))
    n = F.col("bands") - F.col("last_is_alpha").cast("int")
    long = known.where("bands >= 2 AND end_us > start_us").withColumn("n", n)
    each = long.select(key, "start_us", ((F.col("end_us") - F.col("start_us")) / F.col("n")).alias("part"), F.explode(F.expr("sequence(0, n - 1)")).alias("_k"))
    edge = lambda k: F.floor(F.col("start_us") + F.col("part") * k).cast("long")
    return whole.unionByName(each.select(key, (F.col("_k") + 1).cast("int").alias("band"), edge(F.col("_k")).alias("t0"), edge(F.col("_k") + 1).alias("t1")))


def band_of(t_us: Column, start_us: Column, end_us: Column, bands: int) -> Column:
    return (F.least(F.floor((t_us - start_us) * bands / (end_us - start_us)), F.lit(bands - 1)) + 1).cast("int")
