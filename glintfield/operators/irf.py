"""Point-target metrics on amplitude profiles (keys..., i, v) and the chips they come from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintfield.operators.autofocus import first_peak
from glintfield.operators.normalize import to_db

Keys = tuple[str, ...]


def profile_metrics(profile: DataFrame, spacing: float | Column, keys: Keys = ("chip",)) -> DataFrame:
    """(keys, peak, mainlobe, hpbw, pslr, islr) of profiles whose v is a linear amplitude.

    mainlobe counts samples within 0.5 of the peak amplitude; hpbw is the extent of what is within
    3 dB, 0 for fewer than two samples; pslr and islr are in dB, -infinity without side lobes.
    """
    profile = profile.withColumn("spacing", spacing if isinstance(spacing, Column) else F.lit(spacing))
    top = profile.groupBy(*keys).agg(F.max("v").alias("peak_v"), F.max("spacing").alias("step"), F.max_by("i", F.struct(F.col("v"), -F.col("i"))).alias("peak"))
    near = profile.join(top, list(keys))
    wide = near.groupBy(*keys).agg(F.count_if(F.col("v") >= F.col("peak_v") - 0.5).alias("mainlobe"))
    joined = near.join(wide, list(keys))
    p = F.col("v") * F.col("v")
    db = 20 * F.log10(F.col("v") + 1e-12)
    in_half = db >= 20 * F.log10(F.col("peak_v") + 1e-12) - 3
    main = F.abs(F.col("i") - F.col("peak")) <= F.col("mainlobe")
    sums = joined.groupBy(*keys, "peak", "peak_v", "step", "mainlobe").agg(
        F.count_if(in_half).alias("n_half"),
        (F.max(F.when(in_half, F.col("i"))) - F.min(F.when(in_half, F.col("i")))).alias("span"),
        F.max(F.when(~main, p)).alias("side"),
        F.sum(p).alias("total"),
        F.sum(F.when(main, p)).alias("main"),
    )
    none = F.lit(float("-inf"))
    hpbw = F.when(F.col("n_half") < 2, 0.0).otherwise(F.col("span") * F.col("step"))
    pslr = F.when(F.col("side") > 0, 10 * F.log10(F.try_divide(F.col("side"), F.col("peak_v") * F.col("peak_v")))).otherwise(none)
    rest = F.col("total") - F.col("main")
    islr = F.when(F.col("side") > 0, 10 * F.log10(F.try_divide(rest, F.col("main")))).otherwise(none)
    return sums.select(*keys, "peak", "mainlobe", hpbw.alias("hpbw"), pslr.alias("pslr"), islr.alias("islr"))


def around_peak(px: DataFrame, half: int = 64) -> DataFrame:
    """Each chip's samples within `half` rows and columns of its first strongest one, numbered from 0."""
    peak = first_peak(px).select("chip", F.col("r").alias("pr"), F.col("c").alias("pc"))
    near = px.join(peak, "chip").where((F.abs(F.col("r") - F.col("pr")) <= half) & (F.abs(F.col("c") - F.col("pc")) <= half))
    first = [F.greatest(F.col(p) - half, F.lit(0)) for p in ("pr", "pc")]
    return near.select("chip", (F.col("r") - first[0]).cast("int").alias("r"), (F.col("c") - first[1]).cast("int").alias("c"), "re", "im")


def interpolate_chip(px: DataFrame, factor: int = 10, spacing: tuple[float, float] = (1.0, 1.0), metres: tuple[float, float] = (float("inf"), float("inf"))) -> DataFrame:
    """Each chip zero-padded in frequency to the next power of two of factor times its size: (chip, axis, i, v, spacing).

    The two profiles through the peak of the interpolated amplitude, which is scaled to a peak of 1; rows are
    azimuth and columns are range, and spacing and metres (the profile's extent around the peak) come in that order.
    A chip is one task's group: cut it with around_peak first.
    """
    if spacing[0] <= 0 or spacing[1] <= 0:
        raise ValueError("spacings are above 0")

    def finer(table: pa.Table) -> pa.Table:
        r, c = (table[x].to_numpy() for x in ("r", "c"))
        data = np.zeros((r.max() + 1, c.max() + 1), complex)
        data[r, c] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        want = tuple(1 << int(np.ceil(np.log2(factor * n))) for n in data.shape)
        big = np.zeros(want, complex)
        at = tuple((w - n) // 2 for w, n in zip(want, data.shape))
        big[at[0] : at[0] + data.shape[0], at[1] : at[1] + data.shape[1]] = np.fft.fftshift(np.fft.fft2(data))
        fine = np.abs(np.fft.ifft2(np.fft.ifftshift(big))) * (big.size / data.size)
        peak = np.unravel_index(np.argmax(fine), fine.shape)
        rows = []
        for k, (axis, line) in enumerate((("azimuth", fine[:, peak[1]]), ("range", fine[peak[0]]))):
            step = spacing[k] * data.shape[k] / want[k]
            reach = int(min(0.5 * metres[k] / step, len(line)))
            first = max(peak[k] - reach, 0)
            rows += [(axis, i, v / fine[peak], step) for i, v in enumerate(line[first : peak[k] + reach + 1])]
        axis, i, v, step = zip(*rows)
        chip = pa.array([table["chip"][0].as_py()] * len(rows), pa.int64())
        return pa.table([chip, pa.array(axis), pa.array(i, pa.int32()), pa.array(v, pa.float64()), pa.array(step, pa.float64())], names=["chip", "axis", "i", "v", "spacing"])

    return px.groupBy("chip").applyInArrow(finer, "chip bigint, axis string, i int, v double, spacing double")


def analyse_points(px: DataFrame, spacing_azimuth: float, spacing_range: float, half: int = 64, metres: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Around each chip's strongest sample: the profiles in dB (chip, axis, i, v, spacing, db), and their metrics a chip and axis."""
    profiles = interpolate_chip(around_peak(px, half), spacing=(spacing_azimuth, spacing_range), metres=(metres, metres))
    return profiles.withColumn("db", to_db(F.col("v"))), profile_metrics(profiles, F.col("spacing"), ("chip", "axis"))


def metric_text(value: Column, digits: int) -> Column:
    """A metric for reading; N/A where it is null or not finite."""
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(usable, F.format_string(f"%.{digits}f", value)).otherwise("N/A")


def plot_floor(lowest: Column) -> Column:
    """The lower end of a profile's plot in dB; the upper end is 5."""
    return F.least(F.greatest(lowest - 5, F.lit(-60.0)), F.lit(5.0))
