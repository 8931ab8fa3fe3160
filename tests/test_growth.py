"""Queries whose work must grow with their input: no step may make many more rows than it was given."""

import math

import pandas as pd
import pytest

from glintfield.operators import folds
from glintfield.plans import tables


def most_rows(spark, run):
    """What run() returns, and the most rows that any step of its plans put out."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    done = store.executionsCount()
    got = run()
    bus.waitUntilEmpty()
    most, runs = 0, store.executionsList()
    for i in range(done, runs.size()):
        metrics, values = runs.apply(i).metrics(), store.executionMetrics(runs.apply(i).executionId())
        for j in range(metrics.size()):
            metric = metrics.apply(j)
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return got, most


def test_clicks_and_items_that_share_pixels(spark, tmp_path):
    # Places repeat every 4,000 keys: 2,000 items share one, 2,000 clicks share another 10 pixels off, and one item is at negative places.
    item_keys = [813 - 4000, *(813 + 4000 * k for k in range(3, 2003)), 2, 3]
    click_keys = [*(813 + 4000 * k for k in range(2000)), 2, 5]
    pd.DataFrame({"s_suppkey": item_keys}).to_parquet(tmp_path / "supplier.parquet")
    pd.DataFrame({"c_custkey": click_keys}).to_parquet(tmp_path / "customer.parquet")
    got, most = most_rows(spark, lambda: tables.hit_test(spark, str(tmp_path)).collect())
    first = {}
    for i in sorted(item_keys):
        first.setdefault((int(math.fmod(i * 37, 1000)), int(math.fmod(i * 91, 800))), i)
    want = {c: min((i for (x, y), i in first.items() if (x - c * 53 % 1000) ** 2 + (y - c * 29 % 800) ** 2 <= 2500), default=None) for c in click_keys}
    assert {r.click: r.item for r in got} == {c: i for c, i in want.items() if i is not None} and len(got) >= 2000
    assert most < 10 * (len(item_keys) + len(click_keys))


def test_layers_at_the_end_of_a_long_chain(spark):
    # 300 levels, 1,500 layers below the last: a row a node and level would be half a million rows.
    depth, leaves = 300, 1500
    rows = [(k, k - 1 if k else None, 7, None) for k in range(depth)] + [(depth + k, depth - 1, leaves - k, k % 40) for k in range(leaves)]
    df = spark.createDataFrame(rows, "id int, parent int, ordinal int, layer int")
    picked = spark.createDataFrame([(0, depth + 3), (1, depth - 2), (2, 0)], "seq int, id int")
    got, most = most_rows(spark, lambda: folds.selected_layers(df, picked).collect())
    # Layer 3 is selected itself; the others are first met in the order of their ordinals, which fall as their ids rise.
    want = {(k, 1, (7, min(leaves - j for j in range(leaves) if j % 40 == k))) for k in range(40) if k != 3} | {(3, 0, ())}
    assert {(r.layer, r.seq, tuple(r.path)) for r in got} == want
    assert most < 10 * len(rows)


def test_a_node_under_two_parents_is_an_error(spark):
    df = spark.createDataFrame([(1, None, 0, 1), (2, None, 1, 2), (3, 1, 0, 3), (3, 2, 0, 3)], "id int, parent int, ordinal int, layer int")
    with pytest.raises(ValueError, match="several parents"):
        folds.selected_layers(df, spark.createDataFrame([(0, 1)], "seq int, id int"))
