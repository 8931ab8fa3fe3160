"""Scenes and multi-band products as Parquet: the layout that stands for raster files here.

A scene folder has three tables: `lines` (scene_id, r, amp, phase; one row a file line, two arrays of samples),
`bands` (scene_id, band, name, scale, offset, interp) and `scenes` (scene_id, props, the metadata as JSON). A product
folder has `frames` (scene_id, r, c, v) in a folder a band, and `scenes`. Row groups hold consecutive lines, so
a window of lines reads only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintfield.operators.indexing import decode_slc, or_default, write_orientation
from glintfield.operators.spectral import magnitude


def write_scene(folder: str, lines: DataFrame, bands: DataFrame, scenes: DataFrame, mode: str = "errorifexists") -> None:
    lines.repartitionByRange("scene_id", "r").sortWithinPartitions("scene_id", "r").write.mode(mode).parquet(f"{folder}/lines")
    bands.write.mode(mode).parquet(f"{folder}/bands")
    scenes.write.mode(mode).parquet(f"{folder}/scenes")


def named_bands(bands: DataFrame) -> DataFrame:
    """One row a scene: scale and offset of the bands named amplitude and phase, whatever their case.

    A scene with fewer than two bands, or without both names, is an error when its row is read.
    """
    pick = lambda name, col: F.max(F.when(F.lower("name") == name, F.col(col)))
    found = bands.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.lower("name") == name).alias(f"{name}_n") for name in ("amplitude", "phase")),
        *(pick(name, col).alias(f"{name}_{col}") for name in ("amplitude", "phase") for col in ("scale", "offset")),
    )
    broken = (F.col("n") < 2) | (F.col("amplitude_n") != 1) | (F.col("phase_n") != 1)
    checked = F.when(broken, F.raise_error(F.concat(F.lit("no amplitude and phase bands: "), "scene_id"))).otherwise(F.col("scene_id"))
    return found.select(checked.alias("scene_id"), *(or_default(F.col(f"{name}_scale"), 1.0).alias(f"{name}_scale") for name in ("amplitude", "phase")), *(F.coalesce(F.col(f"{name}_offset"), F.lit(0.0)).alias(f"{name}_offset") for name in ("amplitude", "phase")))


def decode_lines(lines: DataFrame, bands: DataFrame, power: Column | None = None) -> DataFrame:
    """lines(scene_id, r, amp, phase) as packed complex lines (scene_id, r, re, im)."""
    met = lines.join(named_bands(bands), "scene_id")

    def part(k: int) -> Column:
        return F.zip_with("amp", "phase", lambda a, p: decode_slc(a, p, F.col("amplitude_scale"), F.col("amplitude_offset"), F.col("phase_scale"), F.col("phase_offset"), power)[k])

    return met.select("scene_id", "r", part(0).alias("re"), part(1).alias("im"))


def read_scene(spark: SparkSession, folder: str, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """Packed complex lines of a scene folder; half-open windows of rows (pushed to the scan) and columns (cut from the arrays) number from 0."""
    lines = spark.read.parquet(f"{folder}/lines")
    if rows:
        lines = lines.where((F.col("r") >= rows[0]) & (F.col("r") < rows[1])).withColumn("r", F.col("r") - rows[0])
    if columns:
        lines = lines.withColumns({p: F.slice(p, columns[0] + 1, columns[1] - columns[0]) for p in ("amp", "phase")})
    return decode_lines(lines, spark.read.parquet(f"{folder}/bands"))


def write_product(folder: str, frames: DataFrame, scenes: DataFrame, *, left: Column, height: int, strict: bool = True, mode: str = "errorifexists") -> None:
    """frames(scene_id, band, r, c, v) in file orientation, a folder a band, 0 as no data; the metadata of its scenes goes along.

    With strict a scene without metadata is an error before anything is written, else it is written without.
    """
    known = scenes.where("props IS NOT NULL").select("scene_id", "props")
    if strict and not frames.select("scene_id").distinct().join(known, "scene_id", "left_anti").isEmpty():
        raise ValueError("a scene has no metadata")
    turned = write_orientation(frames, left, height).withColumn("v", F.coalesce(F.col("v"), F.lit(0.0)).cast("float"))
    turned.repartition("scene_id", "band").sortWithinPartitions("r", "c").write.mode(mode).partitionBy("band").parquet(f"{folder}/frames")
    known.join(frames.select("scene_id").distinct(), "scene_id", "left_semi").write.mode(mode).parquet(f"{folder}/scenes")


def read_product(spark: SparkSession, folder: str, band: int | None = None) -> DataFrame:
    """frames(scene_id, band, r, c, v); one band reads that band's folder alone."""
    frames = spark.read.parquet(f"{folder}/frames")
    return frames if band is None else frames.where(F.col("band") == band)


def focus_frames(focused: DataFrame) -> DataFrame:
    """The two bands of a focused scene: amplitude and angle."""
    bands = F.explode(F.array(F.struct(F.lit(1).alias("band"), magnitude().alias("v")), F.struct(F.lit(2).alias("band"), F.atan2("im", "re").alias("v"))))
    return focused.select("scene_id", "r", "c", bands.alias("b")).select("scene_id", "b.band", "r", "c", "b.v")


def color_frames(rgb: DataFrame) -> DataFrame:
    """The three bands of a colour composite."""
    bands = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("band"), F.col(name).alias("v")) for k, name in enumerate(("red", "green", "blue")))))
    return rgb.select("scene_id", "r", "c", bands.alias("b")).select("scene_id", "b.band", "r", "c", "b.v")
