"""Catalogue items and acquisition events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintfield.operators.catalog import pick_asset
from glintfield.sources.catalogs import ITEM_SCHEMA


def item_stream(spark: SparkSession, path: str) -> DataFrame:
    """New item files of a folder: id, collection, and the chosen complex and quick-look assets."""
    items = spark.readStream.schema(ITEM_SCHEMA).option("multiLine", True).json(path)
    return items.select("id", "collection", pick_asset(F.col("assets"), ("slc-cog", "slc"), ("slc",))["href"].alias("slc"), pick_asset(F.col("assets"), ("qlk-cog", "qlk"), ("quicklook", "qlk"))["href"].alias("quicklook"))


def events_per_window(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream of events(ts, event_type, value) in tumbling windows; later rows than `late` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = timed.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "total")
