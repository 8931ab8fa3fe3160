"""One answer at all sizes: ties, bounds, repeated ids, weights and recall."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintfield.llm import license_scan, near_dedup
from glintfield.llm.language_id import fit_languages
from glintfield.llm.quality_score import fit_quality
from glintfield.llm.source_mixing import fit_domains
from glintfield.llm.topk_search import exact_top_k
from glintfield.llm.url_filters import Rule, filter_urls


def test_equally_long_rules_have_one_verdict_in_both_plans(spark):
    rules = [Rule("com", f"/p{k}yz", "allow") for k in range(6)] + [Rule("a.com", f"/p{k}", "block") for k in range(6)]
    rules += [Rule("com", "/é12", "allow"), Rule("a.com", "/é", "block"), Rule("com", "/q4yz", "block"), Rule("a.com", "/q4", "block"), Rule("b.com", "/" + "x" * 30_000, "block")]
    urls = [f"http://a.com/p{k}yz" for k in range(6)] + ["http://a.com/é12", "http://a.com/q4yz", "http://b.com/" + "x" * 40_000, None, "http://a.com/p1yz"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = [sorted(map(tuple, filter_urls(pages, rules, max_broadcast_bytes=most).collect())) for most in (1 << 30, 0)]
    assert got[0] == got[1]
    told = {r[0]: r[3:] for r in got[0]}
    assert told[1] == ("a.com/p1", "block") and told[6] == ("a.com/é", "block") and told[7] == ("com/q4yz", "block") and told[8][1] == "block" and told[9] == (None, "allow")


def test_large_components_are_refused(spark):
    one = lambda x: spark.createDataFrame([(1, [x, 1]), (2, [3, 4])], "vec_id long, vector array<bigint>")
    assert exact_top_k(one(2**20 - 1), one(1 - 2**20)).count() == 2
    for x in (2**20, -(2**20), 2**40):
        with pytest.raises(Exception, match="2\\*\\*20"):
            exact_top_k(one(1), one(x)).collect()


def test_the_longest_tag_at_a_place(spark):
    lines = ["SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: MIT and later SPDX-License-Identifier: GPL-2.0-only"]
    df = spark.createDataFrame([(k, "x " + t) for k, t in enumerate(lines)], "doc_id long, text string")
    got = {}
    for r in license_scan.find_licenses(df, license_scan.templates(spark)).collect():
        got.setdefault(r.doc_id, set()).add(r.template_id)
    names = {k: {n.replace("SPDX-", "").replace("spdx-", "") for n in v} for k, v in got.items()}
    assert [len(names[k]) for k in range(4)] == [1, 1, 1, 2] and "MIT-0" in str(names[0]) and "GPL-2.0-only" in str(names[1]) and "MIT-0" not in str(names[2])


def test_samples_take_a_repeated_id_once(spark):
    """Half of all rows have one id; what is learned is what its single row gives."""
    rnd = random.Random(2)
    words = {"de": ["der", "und", "nicht", "ist"], "en": ["the", "and", "not", "is"]}
    rows = [(k, " ".join(rnd.choices(words[g], k=30)), g) for k, g in enumerate(["de", "en"] * 40)]
    once, often = (spark.createDataFrame(rows + [rows[0]] * n, "doc_id long, text string, lang string") for n in (0, 300))
    labels = spark.createDataFrame([(k, int(g == "en"), g) for k, _, g in rows], "doc_id long, quality int, domain string")
    assert fit_languages(once) == fit_languages(often)
    assert fit_quality(once, labels) == fit_quality(often, labels)
    a, b = fit_domains(once, labels), fit_domains(often, labels)
    assert a.words == b.words and np.array_equal(a.weights, b.weights)


def slow_probability_jaccard(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in x.keys() & y.keys())


def test_probability_jaccard_by_its_definition():
    rnd = random.Random(6)
    for _ in range(60):
        x, y = ({rnd.randrange(12): rnd.choice([1.0, 1.0, 2.0, 5.0]) for _ in range(rnd.randint(1, 9))} for _ in range(2))
        pair = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in (x, y)]
        assert near_dedup.probability_jaccard(*pair) == pytest.approx(slow_probability_jaccard(x, y))


def test_weighted_signatures_estimate_the_probability_jaccard():
    a, b = " ".join(f"w{k}" for k in range(60)) + " again" * 40, " ".join(f"w{k}" for k in range(60)) + " again" * 90
    signs, _ = near_dedup.signatures([a.encode().split(), b.encode().split()], 4000, weighted=True)
    want = near_dedup.probability_jaccard(near_dedup.weighted_shingles(a), near_dedup.weighted_shingles(b))
    assert (signs[0] == signs[1]).mean() == pytest.approx(want, abs=0.035) and want < 0.9
    signs, _ = near_dedup.signatures([a.encode().split(), b.encode().split()], 4000)
    assert (signs[0] == signs[1]).mean() == 1  # equal sets


def test_weights_tell_repetition_apart(spark):
    base = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, base + " again" * 200), (2, base + " again" * 8), (3, base + " again" * 199)], "doc_id long, text string")
    classes = lambda **o: {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(df, **o).collect()}
    assert classes() == {1: 1, 2: 1, 3: 1} and classes(weighted=True) == {1: 1, 2: 2, 3: 1}


def test_recall_by_similarity(spark, capsys):
    """Shares of the pairs of each Jaccard that meet in a band, over the documents of sf0.01."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").distinct().collect() if r.text]
    lists = [t.encode().split() for t in texts]
    bands = []
    for k in range(0, len(lists), 100):
        bands.extend(near_dedup.band_keys(near_dedup.signatures(lists[k : k + 100], 150)[0], 30))
    sets = [set(near_dedup.shingles(t).tolist()) for t in texts]
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    common = {}
    for who in holders.values():
        for i, a in enumerate(who):
            for b in who[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    caught = {}
    for (a, b), n in common.items():
        j = n / (len(sets[a]) + len(sets[b]) - n)
        if j >= 0.5:
            band = min(math.floor(j * 10 + 1e-9), 9)
            met = bool((bands[a] == bands[b]).any())
            total = caught.setdefault(band, [0, 0])
            total[0] += met
            total[1] += 1
    with capsys.disabled():
        print("\nrecall by Jaccard:", {f"{k / 10:.1f}": f"{m}/{n}" for k, (m, n) in sorted(caught.items())})
    assert all(m == n for k, (m, n) in caught.items() if k >= 8)


def test_an_id_with_several_texts_does_not_depend_on_their_order(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " one"), (3, b + " two"), (4, "alone")], "doc_id long, text string")
    told = [{(r.doc_id, r.class_id) for r in near_dedup.near_duplicate_classes(part).collect()} for part in (df, df.orderBy(F.desc("text")))]
    assert told[0] == told[1] and (4, 4) in told[0]
