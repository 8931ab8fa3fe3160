"""Bounded values over events, layer trees, timing of bands: queries whose groups may be of any size or depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintfield.functions import timespan
from glintfield.operators import folds
from glintfield.plans.spectra import rounded
from glintfield.session import table


def _turns(spark, sf_dir):
    """Each event as a turn of a wheel; every 13th sets the value anew."""
    delta = F.round((F.col("value") - 50) * 10, 3)
    return table(spark, sf_dir, "events").select("user_id", "event_id", delta.alias("delta"), (F.col("event_id") % 13 == 0).alias("anew"))


def bounded_value(spark, sf_dir):
    """A user's value in [0, 1] after each turn, in steps of 0.05 from 0.5, and whether the turn changed it."""
    steps = folds.wheel_steps(F.col("delta"))
    events = _turns(spark, sf_dir).select("user_id", "event_id", F.when(~F.col("anew"), steps * 0.05).alias("move"))
    walked = folds.bounded_walk(events, "user_id", ["event_id"], start=0.5, low=0.0, high=1.0)
    return rounded(walked.select("user_id", "event_id", "value"), value=6)


def sub_aperture_scroll(spark, sf_dir):
    """The centre of a sub-aperture of a quarter of the track: one step of 0.02 a turn, kept off the ends by half its length and 0.01; activation puts it in the middle."""
    look, margin, step = 0.25, 0.01, 0.02
    events = _turns(spark, sf_dir).select("user_id", "event_id", F.when(~F.col("anew"), F.signum("delta") * step).alias("move"))
    walked = folds.bounded_walk(events, "user_id", ["event_id"], start=0.5, low=look / 2 + margin, high=1 - margin - look / 2)
    return rounded(walked.select("user_id", "event_id", "value"), value=6)


def _tree(spark, sf_dir):
    """Parts as a tree: the first 60 are a chain, the others hang at half their number; siblings by size. Odd ones are layers, some of them in several places."""
    key = F.col("p_partkey")
    parent = F.when(key <= 1, None).when(key <= 60, key - 1).otherwise(F.floor(key / 2))
    return table(spark, sf_dir, "part").select(key.alias("id"), parent.cast("long").alias("parent"), (F.col("p_size") * 1_000_000 + key).cast("long").alias("ordinal"), F.when(key % 2 == 1, key % 150).alias("layer"))


def selected_layers(spark, sf_dir):
    """What the selected nodes imply, each layer where it is first seen."""
    nodes = _tree(spark, sf_dir)
    chosen = nodes.where("id % 41 = 3 OR id = 30").select((-F.col("id")).alias("seq"), "id")
    found = folds.selected_layers(nodes, chosen)
    return found.select("layer", "seq", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def value_quantiles(spark, sf_dir):
    """Quartiles and far quantiles of the events' values by type."""
    found = folds.quantiles(table(spark, sf_dir, "events"), "event_type", "value", {"q02": 0.02, "q25": 0.25, "q50": 0.5, "q98": 0.98})
    return rounded(found, q02=6, q25=6, q50=6, q98=6)


def layer_timing(spark, sf_dir):
    """Times of layers by their bands: a last alpha band has none, one band has the whole span, and layers without a span in order have none."""
    key = F.col("o_orderkey")
    start = F.when(key % 17 != 0, timespan.micros(F.col("o_orderdate")))
    end = F.when(key % 19 != 0, timespan.micros(F.col("o_orderdate")) + (key % 90 - 5) * 1_000_000)
    layers = table(spark, sf_dir, "orders").select(key.alias("layer"), start.alias("start_us"), end.alias("end_us"), (key % 5).cast("int").alias("bands"), (key % 3 == 0).alias("last_is_alpha"))
    return timespan.layer_ranges(layers, "layer")


QUERIES = {f.__name__: f for f in (bounded_value, sub_aperture_scroll, selected_layers, value_quantiles, layer_timing)}

_TURNS = "ev AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, round((value-50)*10, 3) AS delta, event_id%13=0 AS anew FROM events)"


def _walk(move: str, low: str, high: str) -> str:
    return f"""WITH RECURSIVE {_TURNS},
mv AS (SELECT user_id, event_id, i, anew, {move} AS m FROM ev),
w AS (
  SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, 0.5e0 AS value FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL SELECT w.user_id, mv.i, mv.event_id, CASE WHEN mv.anew THEN 0.5e0 ELSE least({high}, greatest({low}, w.value+mv.m)) END FROM w JOIN mv ON mv.user_id = w.user_id AND mv.i = w.i+1)
SELECT user_id, event_id, round(value, 6)+0.0 AS value FROM w WHERE i > 0"""


ORACLE_SQL = {
    "bounded_value": _walk("CASE WHEN delta = 0 THEN 0 WHEN round_even(delta/120.0e0, 0) = 0 THEN sign(delta) ELSE round_even(delta/120.0e0, 0) END*0.05e0", "0.0e0", "1.0e0"),
    "sub_aperture_scroll": _walk("sign(delta)*0.02e0", "0.135e0", "0.865e0"),
    "selected_layers": """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey <= 1 THEN NULL WHEN p_partkey <= 60 THEN p_partkey-1 ELSE p_partkey//2 END AS parent, CAST(p_size AS BIGINT)*1000000+p_partkey AS ordinal, CASE WHEN p_partkey%2=1 THEN p_partkey%150 END AS layer FROM part),
v AS (
  SELECT -id AS seq, id, layer, CAST([] AS BIGINT[]) AS path FROM n WHERE id%41=3 OR id=30
  UNION ALL SELECT v.seq, n.id, n.layer, list_append(v.path, n.ordinal) FROM v JOIN n ON n.parent = v.id)
SELECT layer, seq, array_to_string(path, '/') AS path FROM v WHERE layer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY layer ORDER BY seq, path) = 1""",
    "value_quantiles": "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6)+0.0 AS {n}" for n, q in (("q02", 0.02), ("q25", 0.25), ("q50", 0.5), ("q98", 0.98))) + " FROM events GROUP BY 1",
    "layer_timing": """WITH l AS (SELECT o_orderkey AS layer, CASE WHEN o_orderkey%17<>0 THEN epoch_us(o_orderdate) END AS a, CASE WHEN o_orderkey%19<>0 THEN epoch_us(o_orderdate)+(o_orderkey%90-5)*1000000 END AS b, CAST(o_orderkey%5 AS INT) AS bands, o_orderkey%3=0 AS alpha FROM orders),
n AS (SELECT *, CASE WHEN bands >= 2 AND alpha THEN bands-1 ELSE bands END AS n FROM l WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT layer, CAST(0 AS INT) AS band, a AS t0, b AS t1 FROM n WHERE bands < 2
UNION ALL SELECT layer, CAST(k+1 AS INT), CAST(floor(a+(b-a)/CAST(n AS DOUBLE)*k) AS BIGINT), CAST(floor(a+(b-a)/CAST(n AS DOUBLE)*(k+1)) AS BIGINT) FROM n JOIN range(4) r(k) ON k < n WHERE bands >= 2 AND b > a""",
}
