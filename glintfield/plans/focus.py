"""Autofocus, point-target and index-algebra queries over chips and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintfield.operators import autofocus as af
from glintfield.operators import indexing as ix
from glintfield.operators import irf
from glintfield.operators.normalize import clip_sigma
from glintfield.plans.spectra import fft_sql, rounded
from glintfield.session import table
from glintfield.sources.chips import LINES, PX_SQL, SAMPLES, chips_from_embeddings, window


def _left():
    return F.col("chip") % 2 == 0


def _px(spark, sf_dir):
    return chips_from_embeddings(spark, sf_dir)


def entropy(spark, sf_dir):
    return rounded(af.entropy(_px(spark, sf_dir)), entropy=7)


def strong_lines(spark, sf_dir):
    return rounded(af.strong_lines(_px(spark, sf_dir)), re=6, im=6)


def target_centering(spark, sf_dir):
    return ix.centre_strongest(_px(spark, sf_dir), SAMPLES)


def power_window(spark, sf_dir):
    return af.power_window(af.renumber_rows(_px(spark, sf_dir)))


def _bordered(spark, sf_dir):
    """The chips with every third one empty, as at a scene's border."""
    gone = F.col("chip") % 3 == 1
    return _px(spark, sf_dir).withColumns({p: F.when(gone, 0.0).otherwise(F.col(p)) for p in ("re", "im")})


def no_data_entropy(spark, sf_dir):
    return rounded(af.entropy(_bordered(spark, sf_dir)), entropy=7)


def no_data_window(spark, sf_dir):
    return af.power_window(af.renumber_rows(_bordered(spark, sf_dir)), threshold=-1.0, least=10)


def no_data_gradient(spark, sf_dir):
    return rounded(af.phase_gradient(_bordered(spark, sf_dir)), g=7)


def no_data_focus(spark, sf_dir):
    """The amplitudes of the focused chips, the empty ones among them unchanged."""
    return rounded(af.best_look(_bordered(spark, sf_dir), LINES, SAMPLES).select("chip", "r", "c", F.hypot("re", "im").alias("v")), v=6)


def power_window_narrow(spark, sf_dir):
    return af.power_window(af.renumber_rows(_px(spark, sf_dir)), threshold=-1.0, least=10)


def phase_gradient(spark, sf_dir):
    return rounded(af.phase_gradient(_px(spark, sf_dir)), g=7)


def _walk(spark, sf_dir):
    """Each user's events as a sequence of phases."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(order) - 1).alias("i"), (F.pmod("value", F.lit(6.25)) - 3.0).alias("phase"))


def cumsum_unwrap(spark, sf_dir):
    return rounded(af.unwrap(_walk(spark, sf_dir), ("user_id",), "i", "phase", "flat").select("user_id", "i", "flat"), flat=6)


def linear_detrend(spark, sf_dir):
    rms = af.detrend(_walk(spark, sf_dir), ("user_id",), "i", "phase", "flat")
    return rounded(rms.select("user_id", "i", "flat"), flat=6)


def phase_interp(spark, sf_dir):
    walk = _walk(spark, sf_dir).select("user_id", "i", F.col("phase").alias("phi"))
    return rounded(af.stretch(walk, 32, ("user_id",)), phi=6)


def phase_rms(spark, sf_dir):
    return rounded(_walk(spark, sf_dir).groupBy("user_id").agg(F.sqrt(F.avg(F.col("phase") * F.col("phase"))).alias("rms")), rms=7)


def pga_phase(spark, sf_dir):
    return rounded(af.phase_gradient_autofocus(af.strong_lines(_px(spark, sf_dir)), SAMPLES).select("chip", "i", "phi", "rms"), phi=6, rms=6)


def focus_best_look(spark, sf_dir):
    return rounded(af.best_look(_px(spark, sf_dir), LINES, SAMPLES), re=6, im=6, entropy=6)


def pga_rounds(spark, sf_dir):
    return rounded(af.phase_gradient_autofocus(af.strong_lines(_px(spark, sf_dir), 0.5), SAMPLES, rounds=3), phi=6, rms=6)


def pga_history(spark, sf_dir):
    """Rms and entropy of each round of up to three; chips under 0.4 radians are done."""
    _, history = af.autofocus_rounds(af.strong_lines(_bordered(spark, sf_dir), 0.5), SAMPLES, rounds=3, tolerance=0.4)
    return rounded(history, rms=6, entropy=6)


def lens_focus_u8(spark, sf_dir):
    return ix.display_orientation(af.lens_focus(_px(spark, sf_dir), LINES, SAMPLES), _left(), LINES, SAMPLES)


def focus_bands(spark, sf_dir):
    return rounded(af.focus_bands(_px(spark, sf_dir)), amplitude=6, angle=6)


def first_peak(spark, sf_dir):
    return rounded(af.first_peak(_px(spark, sf_dir)), p=6)


def clip_mean_sigma(spark, sf_dir):
    amplitude = _px(spark, sf_dir).select("chip", "r", "c", F.hypot("re", "im").alias("v"))
    return rounded(clip_sigma(amplitude, ("chip",), "v", 2), v=6)


def irf_profile_metrics(spark, sf_dir):
    profile = _px(spark, sf_dir).groupBy("chip", "c").agg(F.sum(F.hypot("re", "im")).alias("v")).withColumnRenamed("c", "i")
    return rounded(irf.profile_metrics(profile, 0.5), hpbw=4, pslr=5, islr=5)


def irf_full(spark, sf_dir):
    _, metrics = irf.analyse_points(_px(spark, sf_dir), 0.8, 0.4)
    return rounded(metrics, hpbw=4, pslr=4, islr=4)


def irf_profiles(spark, sf_dir):
    profiles, _ = irf.analyse_points(_px(spark, sf_dir), 0.8, 0.4)
    return rounded(profiles, v=6, db=4, spacing=9)


def irf_text(spark, sf_dir):
    """Metrics as read, and the floor of the plot."""
    value = F.when(F.col("l_linenumber") == 1, F.lit(float("-inf"))).when(F.col("l_linenumber") == 2, F.lit(None).cast("double")).otherwise(F.floor("l_extendedprice") / 4)
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    floor = irf.plot_floor(-F.col("l_quantity") * 2)
    return table(spark, sf_dir, "lineitem").select(*keys, irf.metric_text(value, 2).alias("shown"), floor.alias("low"))


def orient_left(spark, sf_dir):
    return ix.shadows_down(_px(spark, sf_dir), F.lit(True), SAMPLES)


def orient_right(spark, sf_dir):
    return ix.shadows_down(_px(spark, sf_dir), F.lit(False), SAMPLES)


def write_orientation(spark, sf_dir):
    return ix.write_orientation(_px(spark, sf_dir), _left(), LINES)


def display_orient(spark, sf_dir):
    return ix.display_orientation(_px(spark, sf_dir), _left(), LINES, SAMPLES)


def crop(spark, sf_dir):
    return window(_px(spark, sf_dir), 10, 5, 20, 12)


def crop_of_crop(spark, sf_dir):
    return window(window(_px(spark, sf_dir), 10, 5, 20, 12), 3, 2, 8, 6)


def zero_pad(spark, sf_dir):
    return ix.zero_pad(_px(spark, sf_dir), LINES, SAMPLES, 10, 7)


def overviews(spark, sf_dir):
    """Block means of the amplitude at each overview level."""
    levels = F.explode(F.array(*(F.lit(f) for f in (2, 4, 8, 16)))).alias("level")
    px = _px(spark, sf_dir).select("chip", "r", "c", F.hypot("re", "im").alias("v"), levels)
    blocks = px.groupBy("chip", "level", (F.col("r") / F.col("level")).cast("int").alias("r"), (F.col("c") / F.col("level")).cast("int").alias("c"))
    return rounded(blocks.agg(F.avg("v").alias("v")), v=6)


def _raw(spark, sf_dir):
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(*keys, F.col("l_quantity").alias("amp"), (F.col("l_discount") * 30).alias("phase"), (F.col("l_linenumber") % 3 * 0.5).alias("scale"), F.col("l_tax").alias("shift"))


def slc_decode(spark, sf_dir):
    zero = F.lit(0.0)
    re, im = ix.decode_slc(F.col("amp"), F.col("phase"), F.col("scale"), zero, F.lit(1.0), F.col("shift"))
    return rounded(_raw(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", re.alias("re"), im.alias("im")), re=6, im=6)


def chip_decode(spark, sf_dir):
    re, im = ix.decode_chip(F.col("amp"), F.col("phase"), F.col("scale"), F.lit(0.25), F.lit(0.0), F.col("shift"), F.lit(0.5))
    return rounded(_raw(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", re.alias("re"), im.alias("im")), re=6, im=6)


def _extents(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("id"), (key % 400).cast("double").alias("xmin"), (key * 7 % 300).cast("double").alias("ymin"), (key % 400 + key * 13 % 180).cast("double").alias("xmax"), (key * 7 % 300 + key * 11 % 170).cast("double").alias("ymax"))


def grow_extent(spark, sf_dir):
    return ix.grow_extent(_extents(spark, sf_dir))


def chip_clamp(spark, sf_dir):
    key = F.col("c_custkey")
    chip = ix.clamp_chip((key * 7 % 500).cast("int"), (key * 11 % 400).cast("int"), 64, F.lit(420), F.lit(300))
    return table(spark, sf_dir, "customer").select(key.alias("id"), chip.alias("w")).where("w IS NOT NULL").select("id", "w.*")


QUERIES = {f.__name__: f for f in (entropy, no_data_entropy, no_data_window, no_data_gradient, no_data_focus, strong_lines, target_centering, power_window, power_window_narrow, pga_rounds, pga_history, lens_focus_u8, irf_profiles, irf_text, phase_gradient, cumsum_unwrap, linear_detrend, phase_interp, phase_rms, pga_phase, focus_best_look, focus_bands, first_peak, clip_mean_sigma, irf_profile_metrics, irf_full, orient_left, orient_right, write_orientation, display_orient, crop, crop_of_crop, zero_pad, overviews, slc_decode, chip_decode, grow_extent, chip_clamp)}

_WALK = "walk AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS i, (value - 6.25*floor(value/6.25)) - 3.0 AS phase FROM events)"
_RAW = "raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS amp, l_discount*30 AS phase, CASE WHEN l_linenumber%3=0 THEN 1.0 ELSE l_linenumber%3*0.5 END AS scale, l_tax AS shift FROM lineitem)"
_P = "(re*re+im*im)"

_BORDERED = PX_SQL.replace("px AS", "filled AS", 1) + ",\npx AS (SELECT chip, r, c, CASE WHEN chip%3=1 THEN 0 ELSE re END AS re, CASE WHEN chip%3=1 THEN 0 ELSE im END AS im FROM filled)"

ORACLE_SQL = {
    "no_data_entropy": f"WITH {_BORDERED},\nt AS (SELECT chip, sum({_P}) AS t FROM px GROUP BY 1)\nSELECT chip, round(coalesce(-sum(CASE WHEN {_P} > 0 THEN {_P}/t*ln({_P}/t) END), 0), 7)+0.0 AS entropy FROM px JOIN t USING (chip) GROUP BY chip",
    "no_data_window": f"""WITH {_BORDERED},
col AS (SELECT chip, c, sum({_P}) AS p FROM px GROUP BY 1, 2), n AS (SELECT chip, count(DISTINCT r) AS h FROM px GROUP BY 1), top AS (SELECT chip, max(p) AS top FROM col GROUP BY 1),
w AS (SELECT chip, h, CAST(least(greatest(count(*) FILTER (top > 0 AND p > 0 AND 10*log10(p/nullif(top, 0)) > -1), 10), h-1) AS INT) AS w FROM col JOIN top USING (chip) JOIN n USING (chip) GROUP BY 1, 2)
SELECT chip, w, CAST((h-1)//2-CAST(ceil(w/2.0) AS INT) AS INT) AS c0, CAST((h-1)//2+w//2 AS INT) AS c1 FROM w""",
    "no_data_gradient": f"""WITH {_BORDERED},
s AS (SELECT chip, r, re, im, lead(re) OVER d AS re1, lead(im) OVER d AS im1 FROM px WINDOW d AS (PARTITION BY chip, c ORDER BY r)),
q AS (SELECT chip, CAST(r AS INT) AS i, re*re1+im*im1 AS a, re*im1-im*re1 AS b FROM s WHERE re1 IS NOT NULL)
SELECT chip, i, round(coalesce(sum(atan2(b, a)*sqrt(a*a+b*b))/nullif(sum(sqrt(a*a+b*b)), 0), 0), 7)+0.0 AS g FROM q GROUP BY 1, 2""",
    "entropy": f"WITH {PX_SQL},\nw AS (SELECT chip, {_P}/sum({_P}) OVER (PARTITION BY chip) AS p FROM px)\nSELECT chip, round(-sum(p*ln(p)), 7)+0.0 AS entropy FROM w WHERE p > 0 GROUP BY chip",
    "strong_lines": f"WITH {PX_SQL},\nk AS (SELECT chip, r, max(sqrt({_P})) AS peak FROM px GROUP BY 1, 2),\nb AS (SELECT chip, quantile_cont(peak, 0.95) AS bound FROM k GROUP BY 1)\nSELECT px.chip, px.r, px.c, round(re, 6)+0.0 AS re, round(im, 6)+0.0 AS im FROM px JOIN k USING (chip, r) JOIN b USING (chip) WHERE peak >= bound",
    "target_centering": f"WITH {PX_SQL},\nt AS (SELECT *, first_value(c) OVER (PARTITION BY chip, r ORDER BY {_P} DESC, c) AS top FROM px)\nSELECT chip, r, CAST((c+16-top+32) % 32 AS INT) AS c, re, im FROM t",
    "power_window": f"""WITH {PX_SQL},
col AS (SELECT chip, c, sum({_P}) AS p FROM px GROUP BY 1, 2), n AS (SELECT chip, count(DISTINCT r) AS h FROM px GROUP BY 1), top AS (SELECT chip, max(p) AS top FROM col GROUP BY 1),
w AS (SELECT chip, h, CAST(least(greatest(count(*) FILTER (10*log10(p/top) > -20), 50), h-1) AS INT) AS w FROM col JOIN top USING (chip) JOIN n USING (chip) GROUP BY 1, 2)
SELECT chip, w, CAST((h-1)//2-CAST(ceil(w/2.0) AS INT) AS INT) AS c0, CAST((h-1)//2+w//2 AS INT) AS c1 FROM w""",
    "pga_phase": f"""WITH {PX_SQL},
k AS (SELECT chip, r, max(sqrt({_P})) AS peak FROM px GROUP BY 1, 2),
b AS (SELECT chip, quantile_cont(peak, 0.95) AS bound FROM k GROUP BY 1),
kept AS (SELECT chip, r, row_number() OVER (PARTITION BY chip ORDER BY r)-1 AS i, count(*) OVER (PARTITION BY chip) AS h FROM k JOIN b USING (chip) WHERE peak >= bound),
x AS (SELECT chip, i, h, c, re, im, first_value(c) OVER (PARTITION BY chip, i ORDER BY {_P} DESC, c) AS top FROM px JOIN kept USING (chip, r)),
y AS (SELECT chip, i, h, (c+16-top+32)%32 AS c, re, im FROM x),
w AS (SELECT chip, h, least(greatest(count(*) FILTER (10*log10(p/top) > -20), 50), h-1) AS w FROM (SELECT *, max(p) OVER (PARTITION BY chip) AS top FROM (SELECT chip, c, any_value(h) AS h, sum({_P}) AS p FROM y GROUP BY 1, 2)) GROUP BY 1, 2),
e AS (SELECT chip, (h-1)//2-CAST(ceil(w/2.0) AS INT) AS c0, (h-1)//2+CAST(floor(w/2.0) AS INT) AS c1 FROM w),
m AS (SELECT chip, i, h, c, CASE WHEN (c >= c0 AND c < c1) OR (c0 < 0 AND c >= 32+c0) THEN re ELSE 0 END AS re, CASE WHEN (c >= c0 AND c < c1) OR (c0 < 0 AND c >= 32+c0) THEN im ELSE 0 END AS im FROM y JOIN e USING (chip)),
f AS (SELECT m.chip, m.c, q.i AS k, any_value(m.h) AS h, sum(re*cos(2*pi()*((q.i-m.h//2)*m.i)/m.h)+im*sin(2*pi()*((q.i-m.h//2)*m.i)/m.h)) AS re, sum(im*cos(2*pi()*((q.i-m.h//2)*m.i)/m.h)-re*sin(2*pi()*((q.i-m.h//2)*m.i)/m.h)) AS im
      FROM m JOIN (SELECT DISTINCT chip, i FROM kept) q USING (chip) GROUP BY 1, 2, 3),
s AS (SELECT chip, k, re, im, lead(re) OVER d AS re1, lead(im) OVER d AS im1 FROM f WINDOW d AS (PARTITION BY chip, c ORDER BY k)),
g AS (SELECT chip, k+1 AS i, sum(atan2(re*im1-im*re1, re*re1+im*im1)*sqrt((re*im1-im*re1)**2+(re*re1+im*im1)**2))/sum(sqrt((re*im1-im*re1)**2+(re*re1+im*im1)**2)) AS g FROM s WHERE re1 IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT DISTINCT chip, 0, 0.0 FROM kept),
raw AS (SELECT chip, i, sum(g) OVER (PARTITION BY chip ORDER BY i ROWS UNBOUNDED PRECEDING) AS raw FROM g),
d AS (SELECT *, coalesce(raw-lag(raw) OVER (PARTITION BY chip ORDER BY i), 0) AS d FROM raw),
u AS (SELECT chip, i, raw+sum(CASE WHEN abs(d) >= pi() THEN -2*pi()*round(d/(2*pi())) ELSE 0 END) OVER (PARTITION BY chip ORDER BY i ROWS UNBOUNDED PRECEDING) AS phase FROM d),
l AS (SELECT chip, regr_slope(phase, i) AS a, regr_intercept(phase, i) AS b FROM u GROUP BY 1),
z AS (SELECT chip, i, phase-(a*i+b) AS phi FROM u JOIN l USING (chip)),
rms AS (SELECT chip, sqrt(avg(phi*phi)) AS rms FROM z GROUP BY 1)
SELECT chip, CAST(i AS INT) AS i, round(CASE WHEN rms < 0.01 THEN 0 ELSE phi END, 6)+0.0 AS phi, round(rms, 6)+0.0 AS rms FROM z JOIN rms USING (chip)""",
    "irf_text": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber IN (1, 2) THEN 'N/A' ELSE printf('%.2f', floor(l_extendedprice)/4) END AS shown, least(greatest(-l_quantity*2-5, -60.0e0), 5.0e0) AS low FROM lineitem",
    "power_window_narrow": f"""WITH {PX_SQL},
k AS (SELECT chip, c, sum({_P}) AS p FROM px GROUP BY 1, 2),
n AS (SELECT chip, count(*) FILTER (10*log10(p/top) > -1.0) AS n FROM (SELECT *, max(p) OVER (PARTITION BY chip) AS top FROM k) GROUP BY 1),
w AS (SELECT chip, CAST(least(greatest(n, 10), 63) AS INT) AS w FROM n)
SELECT chip, w, CAST(31-ceil(w/2.0) AS INT) AS c0, CAST(31+floor(w/2.0) AS INT) AS c1 FROM w""",
    "phase_gradient": f"""WITH {PX_SQL},
s AS (SELECT chip, r, re, im, lead(re) OVER d AS re1, lead(im) OVER d AS im1 FROM px WINDOW d AS (PARTITION BY chip, c ORDER BY r)),
g AS (SELECT chip, r AS i, atan2(re*im1-im*re1, re*re1+im*im1) AS a, sqrt((re*im1-im*re1)**2+(re*re1+im*im1)**2) AS w FROM s WHERE re1 IS NOT NULL)
SELECT chip, i, round(sum(a*w)/sum(w), 7)+0.0 AS g FROM g GROUP BY 1, 2""",
    "cumsum_unwrap": f"""WITH {_WALK},
d AS (SELECT *, coalesce(phase-lag(phase) OVER (PARTITION BY user_id ORDER BY i), 0) AS d FROM walk),
m AS (SELECT *, (d+pi()) - 2*pi()*floor((d+pi())/(2*pi())) - pi() AS m0 FROM d),
f AS (SELECT *, CASE WHEN abs(d) >= pi() THEN (CASE WHEN m0 = -pi() AND d > 0 THEN pi() ELSE m0 END)-d ELSE 0 END AS fix FROM m)
SELECT user_id, CAST(i AS INT) AS i, round(phase+sum(fix) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), 6)+0.0 AS flat FROM f""",
    "linear_detrend": f"WITH {_WALK},\nl AS (SELECT user_id, regr_slope(phase, i) AS s, regr_intercept(phase, i) AS t FROM walk GROUP BY 1)\nSELECT user_id, CAST(i AS INT) AS i, round(phase-(s*i+t), 6)+0.0 AS flat FROM walk JOIN l USING (user_id)",
    "phase_interp": f"""WITH {_WALK},
k AS (SELECT *, coalesce(lead(phase) OVER (PARTITION BY user_id ORDER BY i), phase) AS nxt, count(*) OVER (PARTITION BY user_id) AS m FROM walk),
x AS (SELECT DISTINCT user_id, m, CAST(t.r AS INT) AS r, t.r*(m-1)/31.0 AS x FROM k CROSS JOIN range(32) t(r))
SELECT x.user_id, x.r, round(phase+(nxt-phase)*(x.x-k.i), 6)+0.0 AS phi FROM x JOIN k ON k.user_id = x.user_id AND k.i = least(floor(x.x), x.m-1)""",
    "phase_rms": f"WITH {_WALK}\nSELECT user_id, round(sqrt(avg(phase*phase)), 7)+0.0 AS rms FROM walk GROUP BY 1",
    "focus_bands": f"WITH {PX_SQL}\nSELECT chip, r, c, round(sqrt({_P}), 6)+0.0 AS amplitude, round(atan2(im, re), 6)+0.0 AS angle FROM px",
    "first_peak": f"WITH {PX_SQL}\nSELECT chip, r, c, round({_P}, 6)+0.0 AS p FROM px QUALIFY row_number() OVER (PARTITION BY chip ORDER BY {_P} DESC, r, c) = 1",
    "clip_mean_sigma": f"WITH {PX_SQL},\na AS (SELECT chip, r, c, sqrt({_P}) AS v FROM px)\nSELECT chip, r, c, round(least(v, avg(v) OVER w + 2*stddev_pop(v) OVER w), 6)+0.0 AS v FROM a WINDOW w AS (PARTITION BY chip)",
    "irf_profile_metrics": f"""WITH {PX_SQL},
p AS (SELECT chip, c AS i, sum(sqrt({_P})) AS v FROM px GROUP BY 1, 2),
t AS (SELECT *, max(v) OVER (PARTITION BY chip) AS top, first_value(i) OVER (PARTITION BY chip ORDER BY v DESC, i) AS peak FROM p),
m AS (SELECT *, count(*) FILTER (v >= top-0.5) OVER (PARTITION BY chip) AS mainlobe, 20*log10(v+1e-12) >= 20*log10(top+1e-12)-3 AS half FROM t),
a AS (SELECT chip, peak, top, mainlobe, count(*) FILTER (half) AS n, max(i) FILTER (half)-min(i) FILTER (half) AS span,
        max(v*v) FILTER (abs(i-peak) > mainlobe) AS side, sum(v*v) AS total, sum(v*v) FILTER (abs(i-peak) <= mainlobe) AS main FROM m GROUP BY 1, 2, 3, 4)
SELECT chip, peak, mainlobe, round(CASE WHEN n < 2 THEN 0 ELSE span*0.5 END, 4)+0.0 AS hpbw,
       round(CASE WHEN side > 0 THEN 10*log10(side/(top*top)) ELSE CAST('-inf' AS DOUBLE) END, 5)+0.0 AS pslr,
       round(CASE WHEN side > 0 THEN 10*log10((total-main)/main) ELSE CAST('-inf' AS DOUBLE) END, 5)+0.0 AS islr FROM a""",
    "orient_left": f"WITH {PX_SQL}\nSELECT chip, 31-c AS r, r AS c, re, im FROM px",
    "orient_right": f"WITH {PX_SQL}\nSELECT chip, c AS r, r AS c, re, im FROM px",
    "write_orientation": f"WITH {PX_SQL}\nSELECT chip, c AS r, CASE WHEN chip%2=0 THEN 63-r ELSE r END AS c, re, im FROM px",
    "display_orient": f"WITH {PX_SQL}\nSELECT chip, 31-c AS r, CASE WHEN chip%2=0 THEN 63-r ELSE r END AS c, re, im FROM px",
    "crop": f"WITH {PX_SQL}\nSELECT chip, r-10 AS r, c-5 AS c, re, im FROM px WHERE r >= 10 AND r < 30 AND c >= 5 AND c < 17",
    "crop_of_crop": f"WITH {PX_SQL}\nSELECT chip, r-13 AS r, c-7 AS c, re, im FROM px WHERE r >= 13 AND r < 21 AND c >= 7 AND c < 13",
    "zero_pad": f"WITH {PX_SQL}\nSELECT g.chip, CAST(g.r AS INT) AS r, CAST(g.c AS INT) AS c, coalesce(re, 0) AS re, coalesce(im, 0) AS im FROM (SELECT chip, a.r, b.c FROM (SELECT DISTINCT chip FROM px) CROSS JOIN range(74) a(r) CROSS JOIN range(39) b(c)) g LEFT JOIN px ON px.chip = g.chip AND px.r+5 = g.r AND px.c+3 = g.c",
    "overviews": f"WITH {PX_SQL}\nSELECT chip, l.level, CAST(r//l.level AS INT) AS r, CAST(c//l.level AS INT) AS c, round(avg(sqrt({_P})), 6)+0.0 AS v FROM px CROSS JOIN (VALUES (2), (4), (8), (16)) l(level) GROUP BY 1, 2, 3, 4",
    "slc_decode": f"WITH {_RAW}\nSELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(amp*scale*exp(shift)*cos(phase), 6)+0.0 AS re, round(-amp*scale*exp(shift)*sin(phase), 6)+0.0 AS im FROM raw",
    "chip_decode": f"WITH {_RAW}\nSELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((pow(amp, 0.5)*scale+0.25)*cos(phase+shift), 6)+0.0 AS re, round(-(pow(amp, 0.5)*scale+0.25)*sin(phase+shift), 6)+0.0 AS im FROM raw",
    "grow_extent": """WITH e AS (SELECT c_custkey AS id, CAST(c_custkey%400 AS DOUBLE) AS x0, CAST(c_custkey*7%300 AS DOUBLE) AS y0, CAST(c_custkey%400+c_custkey*13%180 AS DOUBLE) AS x1, CAST(c_custkey*7%300+c_custkey*11%170 AS DOUBLE) AS y1 FROM customer)
SELECT id, x1-x0 < 100 OR y1-y0 < 100 AS grown, CASE WHEN x1-x0 < 100 THEN x0-(100-(x1-x0))/2 ELSE x0 END AS xmin, CASE WHEN y1-y0 < 100 THEN y0-(100-(y1-y0))/2 ELSE y0 END AS ymin,
       CASE WHEN x1-x0 < 100 THEN x1+(100-(x1-x0))/2 ELSE x1 END AS xmax, CASE WHEN y1-y0 < 100 THEN y1+(100-(y1-y0))/2 ELSE y1 END AS ymax FROM e""",
    "chip_clamp": """WITH p AS (SELECT c_custkey AS id, CAST(c_custkey*7%500 AS INT) AS r, CAST(c_custkey*11%400 AS INT) AS c FROM customer),
w AS (SELECT id, greatest(r-64, 0) AS r0, least(r+64, 420) AS r1, greatest(c-64, 0) AS c0, least(c+64, 300) AS c1 FROM p)
SELECT id, r0, r1, c0, c1 FROM w WHERE r0 < r1 AND c0 < c1""",
}
