"""Areas of interest as jobs over layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_source(selection: DataFrame) -> DataFrame:
    """selection(batch, layer_id, raster, eligible, active, selected): one row a batch with the source to use, or the error.

    raster: a valid raster, derived ones too; eligible: one that can be the source; active: the batch's active layer, selected or
    not. More than one selected raster is an error, whatever is active. Else the active layer is the source
    if it is eligible, and if not the only eligible selected one.
    """
    sums = selection.groupBy("batch").agg(
        F.count_if(F.col("raster") & F.col("selected")).alias("rasters"),
        F.max(F.when(F.col("eligible") & F.col("active"), F.col("layer_id"))).alias("current"),
        F.count_if(F.col("eligible") & F.col("selected")).alias("n"),
        F.max(F.when(F.col("eligible") & F.col("selected"), F.col("layer_id"))).alias("only"),
    )
    source = F.when(F.col("rasters") <= 1, F.coalesce("current", F.when(F.col("n") == 1, F.col("only"))))
    return sums.select("batch", source.alias("layer_id"), F.when(F.col("rasters") > 1, "several").when(source.isNotNull(), "ok").otherwise("none").alias("status"))


def jobs_from_masks(masks: DataFrame, sources: DataFrame) -> DataFrame:
    """A job for each mask whose batch has a source, numbered within the batch."""
    order = Window.partitionBy("batch").orderBy("mask_id")
    usable = sources.where("status = 'ok'").select("batch", "layer_id")
    return masks.join(usable, "batch").withColumn("seq", F.row_number().over(order))


def job_status(jobs: DataFrame, layers: DataFrame, step: str) -> DataFrame:
    """What becomes of each job: missing and invalid layers are skipped; without metadata focus aborts, video skips, others run."""
    no_metadata = {"focus": "abort", "video": "skip"}.get(step, "task")
    known = jobs.join(layers.select("layer_id", "valid", "has_metadata"), "layer_id", "left")
    status = F.when(F.col("valid").isNull() | ~F.col("valid"), "skip").when(~F.col("has_metadata"), no_metadata).otherwise("task")
    return known.withColumn("status", status).drop("valid", "has_metadata")


def stopped_behind_aborts(jobs: DataFrame) -> DataFrame:
    """jobs(batch, seq, status): a batch ends at its first job that aborts, and every later job is `not run`."""
    ends = jobs.where("status = 'abort'").groupBy("batch").agg(F.min("seq").alias("end"))
    return jobs.join(ends, "batch", "left").withColumn("status", F.when(F.col("seq") > F.col("end"), "not run").otherwise(F.col("status"))).drop("end")


def frame_manifest(layers: DataFrame, factor: float = 1.0, video_fps: int = 3) -> DataFrame:
    """layers(layer, bands, width, height, fps) as a row a frame: one frame a band, in the order of the bands.

    Frames are scaled by `factor` and cut to whole pixels. An animation waits delay_cs hundredths of a second on each (250 ms
    where fps is null or not above 0); a video shows `video_fps` frames a second, of even width and height.
    """
    wait = F.when(F.col("fps") > 0, 1000 / F.col("fps")).otherwise(F.lit(250.0))
    sized = layers.select(
        "layer", F.explode(F.when(F.col("bands") >= 1, F.sequence(F.lit(1), F.col("bands").cast("int")))).alias("band"), F.floor(wait / 10).cast("int").alias("delay_cs"),
        *(F.floor(F.col(side) * F.lit(float(factor))).cast("int").alias(side) for side in ("width", "height")),
    )
    even = [(F.col(side) - F.col(side) % 2).alias(f"video_{side}") for side in ("width", "height")]
    return sized.select("*", *even, ((F.col("band") - 1) / F.lit(video_fps)).alias("video_second"))
