"""Spectral, colour and sub-aperture queries over chips."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintfield.operators import color, spectral
from glintfield.operators.normalize import to_uint8
from glintfield.sources.chips import LINES, PX_SQL, SAMPLES, chips_from_embeddings, lines_from_embeddings


def rounded(df, **digits):
    return df.withColumns({n: F.round(F.col(n), d) + 0.0 for n, d in digits.items()})


def fft_sql(name: str, source: str, axis: str, n: int, keys: str = "chip", inverse: bool = False) -> str:
    """A transform as a sum; samples count from 0, frequencies from -n // 2."""
    other, sign = ("c" if axis == "r" else "r"), ("-" if inverse else "")
    turn = f"2*pi()*((k.k*(p.{axis}-{n // 2})) % {n})/{n}.0" if inverse else f"2*pi()*(((k.k-{n // 2})*p.{axis}) % {n})/{n}.0"
    scale = f"/{n}.0" if inverse else ""
    keyed = ", ".join(f"p.{x.strip()}" for x in keys.split(","))
    return f"""{name} AS (
  SELECT {keyed}, p.{other}, CAST(k.k AS INT) AS {axis},
         sum(p.re*cos({turn}) + {sign}p.im*sin({turn})){scale} AS re,
         sum(p.im*cos({turn}) - {sign}p.re*sin({turn})){scale} AS im
  FROM {source} p CROSS JOIN range({n}) k(k) GROUP BY {keyed}, p.{other}, k.k)"""


def _chips(spark, sf_dir):
    return chips_from_embeddings(spark, sf_dir)


def _lines(spark, sf_dir):
    return lines_from_embeddings(spark, sf_dir)


def range_spectrum_log(spark, sf_dir):
    samples = spectral.unpacked(spectral.line_fft(_lines(spark, sf_dir)), "c")
    return rounded(samples.select("chip", "r", "c", F.log10(spectral.power() + 1e-10).alias("v")), v=5)


def azimuth_spectrum(spark, sf_dir):
    return rounded(spectral.centred_fft(_chips(spark, sf_dir), "r"), re=6, im=6)


def spectrum_2d_log(spark, sf_dir):
    both = spectral.centred_fft(spectral.unpacked(spectral.line_fft(_lines(spark, sf_dir)), "c"), "r")
    return rounded(both.select("chip", "r", "c", F.log10(spectral.magnitude() + 1e-10).alias("v")), v=5)


def range_power_u8(spark, sf_dir):
    logged = spectral.unpacked(spectral.line_fft(_lines(spark, sf_dir)), "c").select("chip", "r", "c", F.log10(spectral.power() + 1e-10).alias("v"))
    return to_uint8(rounded(logged, v=6), ("chip",), "v", "u").select("chip", "r", "c", "u")


def fft_shift(spark, sf_dir):
    px = _chips(spark, sf_dir)
    return px.select("chip", spectral.shifted(F.col("r"), LINES).cast("int").alias("r"), spectral.shifted(F.col("c"), SAMPLES, inverse=True).cast("int").alias("c"), "re", "im")


def ifft_roundtrip(spark, sf_dir):
    back = spectral.line_fft(spectral.line_fft(_lines(spark, sf_dir)), inverse=True)
    return rounded(spectral.unpacked(back, "c"), re=6, im=6)


def color_fast_time(spark, sf_dir):
    return rounded(color.color_by_mode(_lines(spark, sf_dir), "fast_time", LINES, SAMPLES), red=5, green=5, blue=5)


def color_slow_time(spark, sf_dir):
    return rounded(color.color_by_mode(_lines(spark, sf_dir), "slow_time", LINES, SAMPLES), red=5, green=5, blue=5)


def color_default_mode(spark, sf_dir):
    return rounded(color.color_by_mode(_lines(spark, sf_dir), "range_cmap", LINES, SAMPLES), red=5, green=5, blue=5)


def lens_color_u8(spark, sf_dir):
    return color.lens_color(_chips(spark, sf_dir), LINES)


def centered_look(spark, sf_dir):
    both = spectral.centred_fft(spectral.unpacked(spectral.line_fft(_lines(spark, sf_dir)), "c"), "r")
    return rounded(spectral.centred_look(both, LINES, SAMPLES, 30, 17, 24, 12), re=6, im=6)


def azimuth_subaperture_db(spark, sf_dir):
    b0, b1 = spectral.sub_aperture_range(LINES, 0.5)
    band = spectral.band_pass(spectral.centred_fft(_chips(spark, sf_dir), "r"), "r", b0, b1)
    return rounded(spectral.centred_fft(band, "r", inverse=True).select("chip", "r", "c", (10 * F.log10(spectral.power() + 1e-30)).alias("v")), v=4)


def range_subaperture_mag(spark, sf_dir):
    b0, b1 = spectral.sub_aperture_range(SAMPLES, 0.5)
    band = spectral.line_band_pass(spectral.line_fft(_lines(spark, sf_dir)), b0, b1)
    return rounded(spectral.unpacked(spectral.line_fft(band, inverse=True), "c").select("chip", "r", "c", spectral.magnitude().alias("v")), v=6)


FRAMES = dict(n=LINES, oversampling=1.25, resolution=0.15, frames=4)


def video_frames(spark, sf_dir):
    return rounded(spectral.video_frames(_chips(spark, sf_dir), **FRAMES), v=6)


QUERIES = {f.__name__: f for f in (range_spectrum_log, azimuth_spectrum, spectrum_2d_log, range_power_u8, fft_shift, ifft_roundtrip, color_fast_time, color_slow_time, color_default_mode, lens_color_u8, centered_look, azimuth_subaperture_db, range_subaperture_mag, video_frames)}


def _color_sql(axis: str, n: int, tail: str) -> str:
    p = f"s.{axis}/{n - 1}.0"
    return f"""WITH {PX_SQL},
{fft_sql('s', 'px', axis, n)},
w AS (
  SELECT s.chip, s.r, s.c, ch.channel, s.re*ch.w AS re, s.im*ch.w AS im FROM s, LATERAL (
    VALUES ('red', 1-{p}), ('green', greatest(least(1-2*abs({p}-0.5), 1), 0)), ('blue', {p})) ch(channel, w)),
{fft_sql('b', 'w', axis, n, 'chip, channel', inverse=True)},
m AS (SELECT chip, channel, r, c, sqrt(re*re+im*im) AS v FROM b),
{tail}"""


_RGB = "SELECT chip, r, c, {} FROM t GROUP BY chip, r, c"
_COMPOSITE = (
    "l AS (SELECT *, log10(v+1e-10) AS l FROM m),\n"
    "t AS (SELECT *, coalesce((l-min(l) OVER w)/nullif(max(l) OVER w-min(l) OVER w, 0), 0) AS t FROM l WINDOW w AS (PARTITION BY chip, channel))\n"
    + _RGB.format(", ".join(f"round(max(t) FILTER (channel='{x}'), 5)+0.0 AS {x}" for x in ("red", "green", "blue")))
)
_LENS = (
    "q AS (SELECT chip, channel, r, c, least(v, avg(v) OVER w + 2*stddev_pop(v) OVER w) AS v FROM m WINDOW w AS (PARTITION BY chip, channel)),\n"
    "t AS (SELECT *, CAST(coalesce(floor(round(255.0*(v-min(v) OVER w)/nullif(max(v) OVER w-min(v) OVER w, 0), 6)), 0) AS INT) AS t FROM q WINDOW w AS (PARTITION BY chip))\n"
    + _RGB.format(", ".join(f"max(t) FILTER (channel='{x}') AS {x}" for x in ("red", "green", "blue")))
)
_BAND = "{name} AS (SELECT chip, r, c, CASE WHEN {axis} >= {b0} AND {axis} < {b1} THEN re ELSE 0 END AS re, CASE WHEN {axis} >= {b0} AND {axis} < {b1} THEN im ELSE 0 END AS im FROM {source})"


def _sub_sql(axis: str, n: int, value: str) -> str:
    b0, b1 = {64: (24, 32), 32: (11, 15)}[n]  # worked out by hand: 90 % usable, 15 % wide, in the middle
    return f"WITH {PX_SQL},\n{fft_sql('s', 'px', axis, n)},\n{_BAND.format(name='q', axis=axis, b0=b0, b1=b1, source='s')},\n{fft_sql('b', 'q', axis, n, inverse=True)}\nSELECT chip, r, c, {value} AS v FROM b"


_S2 = f"WITH {PX_SQL},\n{fft_sql('s1', 'px', 'c', SAMPLES)},\n{fft_sql('s2', 's1', 'r', LINES)}"
_FRAMES = " UNION ALL ".join(f"SELECT {k} AS band, {a} AS b0, {b} AS b1" for k, a, b in spectral.frame_bands(**FRAMES))

ORACLE_SQL = {
    "range_spectrum_log": f"WITH {PX_SQL},\n{fft_sql('s', 'px', 'c', SAMPLES)}\nSELECT chip, r, c, round(log10(re*re+im*im+1e-10), 5)+0.0 AS v FROM s",
    "azimuth_spectrum": f"WITH {PX_SQL},\n{fft_sql('s', 'px', 'r', LINES)}\nSELECT chip, r, c, round(re, 6)+0.0 AS re, round(im, 6)+0.0 AS im FROM s",
    "spectrum_2d_log": f"{_S2}\nSELECT chip, r, c, round(log10(sqrt(re*re+im*im)+1e-10), 5)+0.0 AS v FROM s2",
    "range_power_u8": f"WITH {PX_SQL},\n{fft_sql('s', 'px', 'c', SAMPLES)},\nl AS (SELECT chip, r, c, round(log10(re*re+im*im+1e-10), 6)+0.0 AS v FROM s)\nSELECT chip, r, c, CAST(coalesce(floor(round(255.0*(v-min(v) OVER w)/nullif(max(v) OVER w-min(v) OVER w, 0), 6)), 0) AS INT) AS u FROM l WINDOW w AS (PARTITION BY chip)",
    "fft_shift": f"WITH {PX_SQL}\nSELECT chip, CAST((r+32) % 64 AS INT) AS r, CAST((c+16) % 32 AS INT) AS c, re, im FROM px",
    "ifft_roundtrip": f"WITH {PX_SQL}\nSELECT chip, r, c, round(re, 6)+0.0 AS re, round(im, 6)+0.0 AS im FROM px",
    "color_fast_time": _color_sql("c", SAMPLES, _COMPOSITE),
    "color_slow_time": _color_sql("r", LINES, _COMPOSITE),
    "color_default_mode": _color_sql("c", SAMPLES, _COMPOSITE),
    "lens_color_u8": _color_sql("r", LINES, _LENS),
    "centered_look": f"""{_S2},
k AS (SELECT chip, r+2 AS r, c-1 AS c, re, im FROM s2 WHERE r >= 18 AND r < 42 AND c >= 11 AND c < 23),
d AS (SELECT px.chip, px.r, px.c, coalesce(k.re, 0) AS re, coalesce(k.im, 0) AS im FROM px LEFT JOIN k USING (chip, r, c)),
{fft_sql('i1', 'd', 'c', SAMPLES, inverse=True)},
{fft_sql('i2', 'i1', 'r', LINES, inverse=True)}
SELECT chip, r, c, round(re, 6)+0.0 AS re, round(im, 6)+0.0 AS im FROM i2""",
    "azimuth_subaperture_db": _sub_sql("r", LINES, "round(10*log10(re*re+im*im+1e-30), 4)+0.0"),
    "range_subaperture_mag": _sub_sql("c", SAMPLES, "round(sqrt(re*re+im*im), 6)+0.0"),
    "video_frames": f"""WITH {PX_SQL},
{fft_sql('s', 'px', 'r', LINES)},
f AS ({_FRAMES}),
q AS (SELECT chip, band, r, c, CASE WHEN r >= b0 AND r < b1 THEN re ELSE 0 END AS re, CASE WHEN r >= b0 AND r < b1 THEN im ELSE 0 END AS im FROM s CROSS JOIN f),
{fft_sql('b', 'q', 'r', LINES, 'chip, band', inverse=True)}
SELECT chip, CAST(band AS INT) AS band, r, c, round(sqrt(re*re+im*im), 6)+0.0 AS v FROM b""",
}
