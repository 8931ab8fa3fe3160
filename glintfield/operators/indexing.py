"""Index algebra on px(chip, r, c, ...): orientation, padding, centring, extents. Pure projections and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def or_default(value: Column, default) -> Column:
    """A missing value or zero takes the default."""
    return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)


def shadows_down(px: DataFrame, left: Column, width: int) -> DataFrame:
    """Transposed; for left-looking scenes mirrored first."""
    return px.withColumns({"r": F.when(left, F.lit(width - 1) - F.col("c")).otherwise(F.col("c")), "c": F.col("r")})


def write_orientation(px: DataFrame, left: Column, height: int) -> DataFrame:
    """The way back of shadows_down on frames that have `height` rows of file columns."""
    return px.withColumns({"r": F.col("c"), "c": F.when(left, F.lit(height - 1) - F.col("r")).otherwise(F.col("r"))})


def display_orientation(px: DataFrame, left: Column, height: int, width: int) -> DataFrame:
    """For the screen: transposed and upside down, for left-looking scenes mirrored too."""
    return px.withColumns({"r": F.lit(width - 1) - F.col("c"), "c": F.when(left, F.lit(height - 1) - F.col("r")).otherwise(F.col("r"))})


def zero_pad(px: DataFrame, height: int, width: int, pad_r: int, pad_c: int) -> DataFrame:
    """The chip in the middle of a grid that is larger by pad_r and pad_c; what is missing is zero."""
    grid = px.select("chip").distinct().select("chip", F.explode(F.sequence(F.lit(0), F.lit(height + pad_r - 1))).alias("r")).select("chip", "r", F.explode(F.sequence(F.lit(0), F.lit(width + pad_c - 1))).alias("c"))
    moved = px.select("chip", (F.col("r") + pad_r // 2).alias("r"), (F.col("c") + pad_c // 2).alias("c"), "re", "im")
    return grid.join(moved, ["chip", "r", "c"], "left").fillna(0.0, ["re", "im"])


def centre_strongest(px: DataFrame, width: int, keys: tuple[str, ...] = ("chip",)) -> DataFrame:
    """Each line rolled so that its first strongest sample lands at width // 2."""
    line = Window.partitionBy(*keys, "r").orderBy(F.desc("_p"), "c")
    ranked = px.withColumn("_p", F.col("re") * F.col("re") + F.col("im") * F.col("im")).withColumn("_top", F.first("c").over(line))
    return ranked.withColumn("c", F.pmod(F.col("c") + width // 2 - F.col("_top"), F.lit(width)).cast("int")).drop("_p", "_top")


def grow_extent(df: DataFrame, least: float = 100) -> DataFrame:
    """xmin, ymin, xmax, ymax grown about their middle to at least `least` a side; `grown` says whether."""
    out = df.withColumn("grown", (F.col("xmax") - F.col("xmin") < least) | (F.col("ymax") - F.col("ymin") < least))
    for a in "xy":
        lo, hi = F.col(f"{a}min"), F.col(f"{a}max")
        more = F.greatest((least - (hi - lo)) / 2, F.lit(0.0))
        out = out.withColumns({f"{a}min": lo - more, f"{a}max": hi + more})
    return out


def clamp_chip(row: Column, col: Column, half: int, height: Column, width: Column) -> Column:
    """Half-open window around a pixel inside a raster; null if nothing of it is inside."""
    r0, r1 = F.greatest(row - half, F.lit(0)), F.least(row + half, height)
    c0, c1 = F.greatest(col - half, F.lit(0)), F.least(col + half, width)
    return F.when((r0 < r1) & (c0 < c1), F.struct(r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1")))


def decode_slc(amp: Column, phase: Column, amp_scale: Column, amp_offset: Column, phase_scale: Column, phase_offset: Column, power: Column | None = None) -> tuple[Column, Column]:
    """Amplitude and phase bands as (re, im). A scene's phase offset is a real exponent, as specified; `power` maps the amplitude."""
    a = (F.pow(amp, power) if power is not None else amp) * or_default(amp_scale, 1.0) + amp_offset
    turn = phase * or_default(phase_scale, 1.0)
    return a * F.exp(phase_offset) * F.cos(turn), -a * F.exp(phase_offset) * F.sin(turn)


def decode_chip(amp: Column, phase: Column, amp_scale: Column, amp_offset: Column, phase_scale: Column, phase_offset: Column, power: Column | None = None) -> tuple[Column, Column]:
    """The same for chips, whose phase offset is part of the angle."""
    a = (F.pow(amp, power) if power is not None else amp) * or_default(amp_scale, 1.0) + amp_offset
    turn = phase * or_default(phase_scale, 1.0) + phase_offset
    return a * F.cos(turn), -a * F.sin(turn)
