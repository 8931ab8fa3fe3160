"""Areas of interest from KML files and polygon tables: rings of points, and their boxes in any map's system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintfield.functions.mapping import from_lonlat

#: Rings of polygons, whatever the tags' namespaces and attributes; ids and names of placemarks.
PLACEMARKS = "//*[local-name()='Placemark']"
LISTS = "//*[local-name()='coordinates']"


def ring_points(text: Column) -> Column:
    """A coordinate list as points (x, y), for `lon,lat[,height]` words; words that are no numbers are left out."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: F.size(F.split(w, ",")) >= 2)
    number = lambda w, k: F.try_element_at(F.split(w, ","), F.lit(k)).try_cast("double")
    points = F.transform(words, lambda w: F.struct(number(w, 1).alias("x"), number(w, 2).alias("y")))
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def kml_rings(documents: DataFrame, text_col: str = "value") -> DataFrame:
    """documents(..., text) with a row for each coordinate list: its number `ring` and its points."""
    lists = F.xpath(text_col, F.lit(f"{LISTS}/text()"))
    each = documents.select("*", F.posexplode(lists).alias("ring", "_list"))
    return each.select(*documents.columns, "ring", ring_points(F.col("_list")).alias("points")).where(F.size("points") > 0)


def kml_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, ring, points) of the KML files of a path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return kml_rings(files).drop("value")


def boxes(rings: DataFrame, *keys: str, epsg: Column | None = None) -> DataFrame:
    """(keys, xmin, ymin, xmax, ymax) over all points; with epsg, points are degrees and the box is of their places on that map."""
    points = rings.select(*keys, F.inline("points"))
    if epsg is not None:
        x, y = from_lonlat(F.col("x"), F.col("y"), epsg)
        points = points.select(*keys, x.alias("x"), y.alias("y"))
    return points.groupBy(*keys).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def kml_extents(spark: SparkSession, path: str) -> DataFrame:
    """(file, xmin, ymin, xmax, ymax) over all coordinates of each KML file; files without coordinates give no row."""
    return boxes(kml_files(spark, path), "file")


def polygon_extents(features: DataFrame, epsg: Column | None = None) -> DataFrame:
    """features(feature_id, ring array<struct<x, y>>) as boxes, on another map if epsg is given; empty rings and boxes without an area give no row."""
    found = boxes(features.withColumnRenamed("ring", "points"), "feature_id", epsg=epsg)
    return found.where("xmax > xmin AND ymax > ymin")
