"""Normalisation of sample columns within groups (window aggregates over the keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _per(df: DataFrame, keys: tuple[str, ...], **aggregates: Column) -> DataFrame:
    """df with aggregates of its group: combined before the shuffle and joined back."""
    return df.join(df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items())), list(keys))


def log_normalise(df: DataFrame, keys: tuple[str, ...], value: str, out: str) -> DataFrame:
    """log10(value + 1e-10) brought to [0, 1] in each group; 0 where the group is flat."""
    logged = df.withColumn("_l", F.log10(F.col(value) + 1e-10))
    ranged = _per(logged, keys, _lo=F.min("_l"), _hi=F.max("_l"))
    return ranged.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col("_l") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_l", "_lo", "_hi")


def to_uint8(df: DataFrame, keys: tuple[str, ...], value: str, out: str) -> DataFrame:
    """Min-max to 0..255, cut to whole numbers (after rounding to 1e-6, so that the top is 255); 0 where the group is flat."""
    ranged = _per(df, keys, _lo=F.min(value), _hi=F.max(value))
    return ranged.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), F.floor(F.round(255.0 * (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), 6))).otherwise(0).cast("int")).drop("_lo", "_hi")


def clip_sigma(df: DataFrame, keys: tuple[str, ...], value: str, sigmas: float) -> DataFrame:
    """Values cut at the group's mean plus so many (population) standard deviations."""
    ranged = _per(df, keys, _m=F.avg(value), _s=F.stddev_pop(value))
    return ranged.withColumn(value, F.least(value, F.col("_m") + sigmas * F.col("_s"))).drop("_m", "_s")


def to_db(amplitude: Column) -> Column:
    db = 20 * F.log10(amplitude + 1e-12)
    return F.when(F.isnan(db) | (F.abs(db) == float("inf")), -100.0).otherwise(db)


def strongest_first(keys: tuple[str, ...], value: Column, *ties: str) -> Window:
    return Window.partitionBy(*keys).orderBy(value.desc(), *ties)
