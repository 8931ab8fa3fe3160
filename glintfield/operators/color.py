"""Colour composites: the spectrum under red, green and blue weights, back in samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintfield.operators.normalize import clip_sigma, to_uint8
from glintfield.operators.spectral import _spectrum, centred_fft, line_fft, magnitude, packed, unpacked


def weighted_channels(px: DataFrame, axis: str, n: int) -> DataFrame:
    """(chip, channel, r, c, v): magnitudes under weights 1-p, 1-2|p-.5| and p along the axis, p from 0 to 1."""
    p = F.col(axis) / (n - 1) if n > 1 else F.lit(0.0)
    green = F.greatest(F.least(1 - 2 * F.abs(p - 0.5), F.lit(1.0)), F.lit(0.0))
    channels = F.explode(F.array(*(F.struct(F.lit(name).alias("channel"), w.alias("w")) for name, w in (("red", 1 - p), ("green", green), ("blue", p)))))
    spectrum = centred_fft(px, axis).select("chip", "r", "c", "re", "im", channels.alias("x"))
    weighted = spectrum.select("chip", "x.channel", "r", "c", (F.col("re") * F.col("x.w")).alias("re"), (F.col("im") * F.col("x.w")).alias("im"))
    return centred_fft(weighted, axis, ("chip", "channel"), inverse=True).select("chip", "channel", "r", "c", magnitude().alias("v"))


def _stacked(channels: DataFrame, value: str) -> DataFrame:
    return channels.groupBy("chip", "r", "c").agg(*(F.max(F.when(F.col("channel") == name, F.col(value))).alias(name) for name in ("red", "green", "blue")))


def _weighted(lines: DataFrame, n: int) -> DataFrame:
    """Packed lines as red, green and blue: magnitudes (arrays) under the three weights of their spectra."""
    rest = [c for c in lines.columns if c not in ("re", "im")]
    place = lambda i: i / (n - 1) if n > 1 else F.lit(0.0)
    weights = {"red": lambda i: 1 - place(i), "green": lambda i: F.greatest(F.least(1 - 2 * F.abs(place(i) - 0.5), F.lit(1.0)), F.lit(0.0)), "blue": place}
    spectra, back = line_fft(lines), _spectrum(True)
    under = lambda part, w: F.transform(part, lambda x, i: x * w(i))
    images = spectra.select(*rest, *(back(under("re", w), under("im", w)).alias(name) for name, w in weights.items()))
    return images.select(*rest, *(F.zip_with(F.col(name)["re"], F.col(name)["im"], F.hypot).alias(name) for name in weights))


def color_composite(lines: DataFrame, axis: str, n: int) -> DataFrame:
    """rgb(chip, r, c, red, green, blue) of packed lines along an axis, each channel log-normalised on its own."""
    names = ("red", "green", "blue")
    logged = _weighted(lines, n).withColumns({x: F.transform(x, lambda v: F.log10(v + 1e-10)) for x in names})
    ends = [end(f(x)).alias(f"{x}_{key}") for x in names for key, end, f in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max))]
    ranged = logged.join(logged.groupBy("chip").agg(*ends), "chip")

    def scaled(x: str) -> Column:
        lo, hi = F.col(f"{x}_lo"), F.col(f"{x}_hi")
        return F.transform(x, lambda v: F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0))

    other = "c" if axis == "r" else "r"
    flat = ranged.withColumns({x: scaled(x) for x in names}).select("chip", other, F.posexplode(F.arrays_zip(*names)).alias(axis, "s"))
    return flat.select("chip", "r", "c", *(F.col("s")[x].alias(x) for x in names))


def lens_color(px: DataFrame, n: int) -> DataFrame:
    """Slow-time colours cut at mean + 2 sigma a channel, one 0..255 scale over all channels."""
    cut = clip_sigma(weighted_channels(px, "r", n), ("chip", "channel"), "v", 2)
    return _stacked(to_uint8(cut, ("chip",), "v", "t"), "t")


#: Colour modes by name; any other name is fast time.
MODES = {"fast_time": "c", "slow_time": "r"}


def color_by_mode(lines: DataFrame, mode: str, height: int, width: int) -> DataFrame:
    """lines: packed along c, as stored."""
    if MODES.get(mode, "c") == "c":
        return color_composite(lines, "c", width)
    return color_composite(packed(unpacked(lines, "c"), "r"), "r", height)
