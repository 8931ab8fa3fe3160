"""Spectra of px(keys..., r, c, re, im): centred transforms along one axis, looks and sub-apertures.

The packed form of samples is lines(keys..., other, re, im): one row a line, two arrays. A table of stored lines
is transformed along them without a shuffle; only the turn to the other axis needs one. All lines of a batch that
have one length are one matrix for the FFT; masks, weights and shifts are column expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPLEX_LINE = "struct<re: array<double>, im: array<double>>"


def _spectrum(inverse: bool):
    @F.arrow_udf(COMPLEX_LINE)
    def transform(re: pa.Array, im: pa.Array) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(np.asarray(re.value_lengths().fill_null(0)))])
        x = np.asarray(re.flatten(), float) + 1j * np.asarray(im.flatten(), float)
        y, lengths = np.empty_like(x), np.diff(offsets)
        for n in np.unique(lengths[lengths > 0]):
            places = offsets[:-1][lengths == n, None] + np.arange(n)
            lines = x[places]
            y[places] = np.fft.ifft(np.fft.ifftshift(lines, axes=1), axis=1) if inverse else np.fft.fftshift(np.fft.fft(lines, axis=1), axes=1)
        at = pa.array(offsets, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(part)) for part in (y.real, y.imag)], ["re", "im"])

    return transform


def packed(px: DataFrame, axis: str, keys: tuple[str, ...] = ("chip",)) -> DataFrame:
    """lines(keys, other, re, im) along an axis, from dense samples; one shuffle by line."""
    other = "c" if axis == "r" else "r"
    sets = px.groupBy(*keys, other).agg(F.sort_array(F.collect_list(F.struct(axis, "re", "im"))).alias("x"))
    return sets.select(*keys, other, F.col("x.re").alias("re"), F.col("x.im").alias("im"))


def unpacked(lines: DataFrame, axis: str, keys: tuple[str, ...] = ("chip",)) -> DataFrame:
    other = "c" if axis == "r" else "r"
    return lines.select(*keys, other, F.posexplode(F.arrays_zip("re", "im")).alias(axis, "s")).select(*keys, "r", "c", "s.re", "s.im")


def line_fft(lines: DataFrame, inverse: bool = False) -> DataFrame:
    """The transform of each packed line: the spectrum with its zero in the middle, or back from such a spectrum."""
    rest = [c for c in lines.columns if c not in ("re", "im")]
    return lines.select(*rest, _spectrum(inverse)("re", "im").alias("y")).select(*rest, "y.re", "y.im")


def centred_fft(px: DataFrame, axis: str, keys: tuple[str, ...] = ("chip",), inverse: bool = False) -> DataFrame:
    """shift(fft(x)) along axis "r" or "c", or ifft(unshift(x)); the axis column then counts frequencies (or samples)."""
    return unpacked(line_fft(packed(px, axis, keys), inverse), axis, keys)


def power(scale: float = 1.0):
    return (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * scale


def magnitude():
    return F.hypot("re", "im")


def shifted(index, n: int, inverse: bool = False):
    """Where a sample goes under fftshift (or its inverse)."""
    return F.pmod(index + ((n + 1) // 2 if inverse else n // 2), F.lit(n))


def centred_look(spectrum: DataFrame, n_r: int, n_c: int, centre_r: int, centre_c: int, look_r: int, look_c: int, keys: tuple[str, ...] = ("chip",)) -> DataFrame:
    """The look_r x look_c part of a centred spectrum around a centre, moved to the middle, zero elsewhere; back in samples."""
    r0, c0 = centre_r - look_r // 2, centre_c - look_c // 2
    to_r, to_c = n_r // 2 - look_r // 2 - r0, n_c // 2 - look_c // 2 - c0
    inside = F.col("r").between(max(r0, 0), min(r0 + look_r, n_r) - 1) & F.col("c").between(max(c0, 0), min(c0 + look_c, n_c) - 1)
    kept = spectrum.where(inside).withColumns({"r": F.col("r") + to_r, "c": F.col("c") + to_c})
    grid = spectrum.select(*keys, "r", "c")
    dense = grid.join(kept, [*keys, "r", "c"], "left").fillna(0.0, ["re", "im"])
    return centred_fft(centred_fft(dense, "c", keys, inverse=True), "r", keys, inverse=True)


def line_band_pass(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Zero outside [start, end) of each packed line."""
    return lines.withColumns({p: F.transform(p, lambda x, i: F.when((i >= start) & (i < end), x).otherwise(0.0)) for p in ("re", "im")})


def band_pass(spectrum: DataFrame, axis: str, start, end) -> DataFrame:
    """Zero outside [start, end) of the axis."""
    inside = (F.col(axis) >= start) & (F.col(axis) < end)
    return spectrum.withColumns({p: F.when(inside, F.col(p)).otherwise(0.0) for p in ("re", "im")})


def sub_aperture_range(n: int, centre: float, usable: float = 0.9, width: float = 0.15) -> tuple[int, int]:
    """[start, end) of a viewer's band around a centre share of the usable spectrum."""
    used = int(n * usable)
    start = max(int(n * 0.1), int(used * (centre - width / 2)))
    return start, min(used, start + int(used * width))


def valid_samples(n: int, oversampling: float) -> tuple[int, int]:
    """[start, stop) of the middle n / oversampling samples."""
    m = max(1, min(n, int(n / oversampling)))
    return (n - m) // 2, (n - m) // 2 + m


def frame_bands(n: int, oversampling: float, resolution: float, frames: int) -> list[tuple[int, int, int]]:
    """(band, start, end) of each video frame's part of the slow-time spectrum."""
    start, stop = valid_samples(n, oversampling)
    segment = (stop - start) * resolution / 0.5
    half = int(segment // 2)
    centres = np.linspace(start + half, stop - half, frames, dtype=int)
    return [(k, int(c - segment // 2), int(c - segment // 2) + int(segment)) for k, c in enumerate(centres)]


def video_frames(px: DataFrame, n: int, oversampling: float, resolution: float, frames: int) -> DataFrame:
    """frames(chip, band, r, c, v): magnitudes of sub-aperture images along slow time (axis r)."""
    spark = px.sparkSession
    bands = F.broadcast(spark.createDataFrame(frame_bands(n, oversampling, resolution, frames), "band int, b0 int, b1 int"))
    looks = centred_fft(px, "r").crossJoin(bands)  # `frames` copies, a parameter
    masked = band_pass(looks, "r", F.col("b0"), F.col("b1")).drop("b0", "b1")
    return centred_fft(masked, "r", ("chip", "band"), inverse=True).select("chip", "band", "r", "c", magnitude().alias("v"))
