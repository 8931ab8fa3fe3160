"""Walks, trees and quantiles of any size against plain loops."""

import random

import numpy as np
import pytest

from glintfield.functions import timespan
from glintfield.operators import autofocus, batch, folds


def held(moves, start, low, high):
    v, out = min(high, max(low, start)), []
    for m in moves:
        old, v = v, start if m is None else min(high, max(low, v + m))
        out.append((round(v, 9), v != old))
    return out


def test_bounded_walk_with_a_user_of_a_third_of_all_events(spark):
    rnd = random.Random(2)
    rows = [(7 if k % 3 == 0 else rnd.randrange(40), k, None if rnd.random() < 0.02 else rnd.choice([-3, -1, 1, 2]) * 0.05, "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "user int, at int, move double, value string")
    got = folds.bounded_walk(df, "user", ["at"], start=0.5, low=0.0, high=1.0).collect()
    split = folds.in_ranges(df, "user", ["at"]).where("user = 7").select("part").distinct().count()
    assert split > 1
    want = {}
    for user in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == user]
        want |= {r[1]: v for r, v in zip(own, held([r[2] for r in own], 0.5, 0.0, 1.0))}
    assert {r["at"]: (round(r["value"], 9), r.changed) for r in got} == want


def test_clamped_steps_compose():
    rnd = random.Random(4)
    for _ in range(500):
        fs = [(0.0, 0.5, 0.5) if rnd.random() < 0.1 else (rnd.uniform(-1, 1), *sorted((rnd.uniform(-1, 1), rnd.uniform(-1, 1)))) for _ in range(6)]
        whole, v = (0.0, float("-inf"), float("inf")), rnd.uniform(-3, 3)
        want = v
        for f in fs:
            whole, want = folds.then(whole, f), folds.applied(f, want)
        assert folds.applied(whole, v) == pytest.approx(want)


def test_running_sum(spark):
    rows = [(k % 5 if k % 3 else 9, k, float(k % 7)) for k in range(600)]
    got = folds.running_sum(spark.createDataFrame(rows, "g int, k int, v double"), "g", ["k"], folds.F.col("v"), "s").collect()
    sums, want = {}, {}
    for g, k, v in rows:
        sums[g] = sums.get(g, 0) + v
        want[k] = sums[g]
    assert {r.k: r.s for r in got} == want


def visit(children, layers, order, chosen):
    seen, out = set(), []

    def go(n):
        if n in layers and layers[n] not in seen:
            seen.add(layers[n])
            out.append(layers[n])
        for c in children.get(n, []):
            go(c)

    for n in chosen:
        go(n)
    return out


def test_layers_of_a_deep_tree(spark):
    rnd = random.Random(8)
    nodes = [(k, k - 1 if k else None, 0) for k in range(55)] + [(k, rnd.randrange(k), k) for k in range(55, 160)]
    layers = {k: k % 70 for k in range(160) if k % 3 == 0}
    children = {}
    for k, p, o in sorted(nodes, key=lambda x: x[2]):
        children.setdefault(p, []).append(k)
    chosen = [50, 3, 120, 99, 0]
    df = spark.createDataFrame([(*n, layers.get(n[0])) for n in nodes], "id int, parent int, ordinal int, layer int")
    picked = spark.createDataFrame(list(enumerate(chosen)), "seq int, id int")
    got = [r.layer for r in folds.selected_layers(df, picked).orderBy("seq", "path").collect()]
    assert got == visit(children, layers, None, chosen)
    assert max(len(r.path) for r in folds.tree_paths(df.select("id", "parent", "ordinal")).collect()) >= 55


def test_a_ring_is_an_error(spark):
    df = spark.createDataFrame([(1, 2, 0), (2, 3, 0), (3, 1, 0)], "id int, parent int, ordinal int")
    with pytest.raises(ValueError, match="ring"):
        folds.tree_paths(df, most_depth=50)


def test_quantiles_of_ties_extremes_and_single_values(spark):
    rnd = random.Random(1)
    groups = {"ties": [1.0] * 500 + [2.0] * 3, "one": [4.5], "wide": [rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-9, 9) for _ in range(400)], "ints": list(map(float, range(77))), "huge": [-1.7e308, 1.6e308, 0.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("ints", None)], "g string, v double")
    shares = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.98, "e": 1.0}
    for r in folds.quantiles(df, "g", "v", shares).collect():
        v = sorted(groups[r.g])
        for name, q in shares.items():
            at = q * (len(v) - 1)
            a, b = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            assert r[name] == pytest.approx(a + (b - a) * (at - int(at)), rel=1e-9), (r.g, name)


def test_one_selected_raster_at_most(spark):
    rows = [
        (1, 10, True, True, True, True), (1, 11, True, False, False, True),  # a derived raster beside the active one
        (2, 20, True, True, True, False), (2, 21, False, False, False, True),  # the active one is not selected
        (3, 30, True, True, False, True), (3, 31, False, False, True, True),  # the only one
        (4, 40, True, False, False, True),  # derived only
        (5, 50, False, False, False, True),
    ]
    df = spark.createDataFrame(rows, "batch int, layer_id int, raster boolean, eligible boolean, active boolean, selected boolean")
    assert sorted(map(tuple, batch.resolve_source(df).collect())) == [(1, None, "several"), (2, 20, "ok"), (3, 30, "ok"), (4, None, "none"), (5, None, "none")]


def test_layer_ranges(spark):
    rows = [(1, 0, 90, 4, True), (2, 0, 90, 3, False), (3, 0, 90, 1, True), (4, 9, 9, 3, False), (5, 9, 3, 1, False), (6, None, 5, 2, False), (7, 0, 90, 2, True)]
    got = timespan.layer_ranges(spark.createDataFrame(rows, "k int, start_us long, end_us long, bands int, last_is_alpha boolean"), "k")
    thirds = [(1, 0, 30), (2, 30, 60), (3, 60, 90)]
    assert sorted(map(tuple, got.collect())) == sorted([(k, *t) for k in (1, 2) for t in thirds] + [(3, 0, 0, 90), (5, 0, 9, 3), (7, 1, 0, 90)])


def test_empty_chips_go_through_the_whole_focus(spark):
    rng = np.random.default_rng(3)
    rows = [(chip, r, c, *(rng.normal(size=2).tolist() if chip else (0.0, 0.0))) for chip in range(2) for r in range(16) for c in range(8)]
    px = spark.createDataFrame(rows, "chip int, r int, c int, re double, im double")
    assert {r.chip: r.entropy for r in autofocus.entropy(px).collect()}[0] == 0
    focused = autofocus.best_look(px, 16, 8).collect()
    assert len(focused) == 256 and all(abs(r.re) + abs(r.im) == 0 for r in focused if r.chip == 0)
    assert {r.u for r in autofocus.lens_focus(px, 16, 8).where("chip = 0").collect()} == {0}
