"""The training-data operators against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintfield.llm import license_scan, license_texts, media_columns, near_dedup, url_filters
from glintfield.llm.language_id import fit_languages, identify_languages
from glintfield.llm.packing import best_fit, pack
from glintfield.llm.quality_score import fit_quality, score_quality
from glintfield.llm.source_mixing import domain_posteriors, fit_domains, mix_to_targets
from glintfield.llm.substring_dedup import pack as pack_hashes
from glintfield.llm.substring_dedup import remove_repeated_passages, unpack
from glintfield.llm.topk_search import exact_top_k, integer_vector

DOC = "doc_id long, text string, lang string, n_words long, score double"
RNG = np.random.default_rng(5)
WORDS = [f"w{k}" for k in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


def frame(spark, rows):
    """rows of (doc_id, text), with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "xx", -1, -1.0) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def texts():
    passage, base = prose(60), prose(200)
    rows = [(k, prose(int(RNG.integers(1, 300)))) for k in range(1, 30)]
    rows += [(k, prose(40) + " " + passage + "\t" + prose(30)) for k in range(30, 36)]
    rows += [(k, base) for k in range(40, 45)]
    rows += [(50 + k, " ".join(w if j % 67 != k else "zz" for j, w in enumerate(base.split()))) for k in range(8)]
    return [*rows, (60, ""), (61, None), (62, " \n\t "), (63, "one"), (63, "one"), (64, prose(3000))]


def brute_removal(rows, n):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, texts):
    cut = remove_repeated_passages(frame(spark, texts).repartition(5), group_bytes=2000)
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in cut.collect())
    assert got == brute_removal(texts, 50)


def test_substring_dedup_keeps_layout_and_null_ids(spark, texts):
    rows = [*texts, (None, texts[-1][1])]
    cut = remove_repeated_passages(frame(spark, rows), rejoin=False, keep=["lang"])
    whole = {(r.doc_id, r.kept_text) for r in cut.where("n_removed = 0").collect()}
    assert whole <= set(rows) and (None, texts[-1][1]) in whole
    assert "lang" in cut.columns


def test_packed_hashes_round_trip():
    high = np.sort(RNG.integers(0, 1 << 63, 100).astype(np.uint64))
    low = RNG.integers(0, 1 << 16, 100).astype(np.uint16)
    a, b = unpack(pack_hashes(high, low))
    assert (a == high).all() and (b == low).all()


def brute_classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        words = (t or "").split()
        if words:
            sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in up}


@pytest.mark.parametrize("blocks", [dict(), dict(block_rows=4, pivots=2)])
def test_near_dedup(spark, texts, blocks):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(frame(spark, texts), **blocks).collect()}
    assert got == brute_classes(texts)


def test_near_dedup_keeps_one(spark, texts):
    rows = [*texts, (None, "one")]
    kept = [r.doc_id for r in near_dedup.keep_one_of_each(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([*set(brute_classes(texts).values()), None], key=str)


def test_probminhash_estimates_jaccard():
    a = [b"a%d" % k for k in range(600)]
    b = a[:480] + [b"b%d" % k for k in range(120)]
    s, sizes = near_dedup.signatures([a, b], 4000)
    x, y = ({tuple(t[k : k + 5]) for k in range(596)} for t in (a, b))
    assert sizes.tolist() == [596, 596]
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.04


@pytest.mark.parametrize("body, footer, edits", [(60, 60, 0), (60, 60, 2), (200, 100, 2)])
def test_probminhash_ignores_repetition(body, footer, edits):
    a, f = [b"a%d" % k for k in range(body)], [b"f%d" % k for k in range(footer)]
    b = [b"edit%d" % k if k in (20, 40)[:edits] else w for k, w in enumerate(a)]
    one, many = a + f, b + f * 30
    s, _ = near_dedup.signatures([one, many], 4000)
    x, y = ({tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (one, many))
    assert len(x & y) / len(x | y) > 0.8
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.04


def test_near_dedup_finds_unequal_repetition(spark):
    rows = []
    for k in range(150):
        body, footer = prose(60).split(), prose(60)
        changed = [w if j not in (20, 40) else "zz" for j, w in enumerate(body)]
        rows += [(2 * k, " ".join(body) + " " + footer), (2 * k + 1, " ".join(changed + [footer] * 100))]
    want = brute_classes(rows)
    assert sum(i != c for i, c in want.items()) > 100
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(frame(spark, rows)).collect()} == want


def test_top_k(spark):
    vectors = [(k, RNG.normal(size=8).round(3).tolist()) for k in range(300)] + [(900, [0.5] * 8)] * 3 + [(950, None), (951, [float("nan")] * 8), (952, [1.0, None])]
    df = spark.createDataFrame(vectors, "vec_id long, e array<double>").select("vec_id", integer_vector(F.col("e")).alias("vector"))
    got = sorted(tuple(r) for r in exact_top_k(df.where("vec_id % 50 = 0"), df, k=5, block_rows=64, depth=8).collect())
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in {i: v for i, v in ok if i % 50 == 0}.items():
        best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_url_filters(spark):
    rules = [url_filters.Rule("com", "/en/", "block"), url_filters.Rule("example.com", "/en/7", "allow"), url_filters.Rule("net", "/", "block")]
    urls = ["http://a.example.com/en/71?x", "https://EXAMPLE.com/en/8", "http://b.com/fr", "x://net", "http://a.net/#", "http://xcom/en/1", None, "nothing", "http://com/en/", ""]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id int, url string, rule string")
    small = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(pages, rules).collect()}
    large = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(pages, rules, max_broadcast_bytes=0).collect()}
    assert small == large
    assert [small[k][0] for k in range(10)] == ["example.com/en/7", "com/en/", None, None, "net/", None, None, None, "com/en/", None]
    assert url_filters.filter_urls(pages, []).where("verdict <> 'allow'").count() == 0


def test_url_digest_collisions_are_confirmed():
    index = url_filters.DigestArray(url_filters.DigestArray.build([url_filters.Rule("a.com", "/x", "block")]))
    index.digests = np.array([url_filters.xxhash.xxh64_intdigest(b"b.com/x")], np.uint64)
    assert index.find([b"b.com/x"]).tolist() == [-1]


def test_media(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big") for k, d in ((b"IHDR", b"\0" * 13), (b"IEND", b"")))
    wav = media_columns.wav_bytes(b"abc")
    gz = zlib.compress(b"hello" * 50, wbits=31)
    assert [f.kind for f in media_columns.sniff(wav)] == ["wav"] and media_columns.wav_samples(wav, media_columns.sniff(wav)[0]) == b"abc"
    assert [(f.kind, f.offset, f.length) for f in media_columns.sniff(b"junk" + png + b"BM" + gz)] == [("png", 4, len(png)), ("gzip", 6 + len(png), len(gz))]
    assert media_columns.sniff(png[:-1]) == [] and media_columns.sniff(b"") == []
    df = spark.createDataFrame([(1, png, "image/jpeg"), (2, None, None), (3, b"xx" + wav, "text")], "id int, b binary, t string")
    got = {r.id: r for r in media_columns.sniff_media(df, id_col="id", bytes_col="b", declared_col="t").collect()}
    assert got[1].corrected == "image/png" and got[2].detected is None and got[3].embedded[0].content == wav
    rows = {r.doc_id: r for r in media_columns.store_as_media(frame(spark, [(1, "ä" * 40), (2, None), (3, "x" * 64)])).collect()}
    padded = ("ä" * 40).encode().ljust(128, b"\0")
    assert (rows[1].n_bytes, rows[1].payload_bytes, rows[1].payload_sha256, rows[1].tail_crc32) == (80, 128, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert (rows[2].n_bytes, rows[2].payload_bytes, rows[3].payload_bytes) == (0, 64, 64)


def test_language_id(spark):
    a, b = [f"alpha{k} beta{k}" for k in range(30)], [f"gruss{k} welt{k}" for k in range(30)]
    rows = [(k, " ".join(RNG.choice(a, 60)), "aa") for k in range(20)] + [(100 + k, " ".join(RNG.choice(b, 60)), "bb") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs)
    asked = spark.createDataFrame([(1, "alpha3 beta4 alpha1", None), (2, "gruss welt gruss", None), (3, None, "aa"), (4, "12 34", "aa"), (5, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in identify_languages(asked, model).collect()}
    assert got == {1: ("aa", False), 2: ("bb", False), 3: ("und", True), 4: ("und", True), 5: ("und", True)}
    none = fit_languages(docs.where("false"))
    assert {r.lang_pred for r in identify_languages(asked, none).collect()} == {"und"}


def test_quality(spark):
    good = [(k, ". ".join(prose(8).capitalize() for _ in range(12))) for k in range(80)]
    bad = [(100 + k, "!! ".join(prose(40).upper().split())) for k in range(80)]
    docs = spark.createDataFrame([*good, *bad, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in [*good, *bad]], "doc_id long, quality int")
    out = {r.doc_id: r for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    assert sum(out[i].predicted == int(i < 100) for i, _ in [*good, *bad]) >= 155
    assert all(0 <= r.score <= 1 for r in out.values()) and out[900].score == out[901].score
    assert score_quality(docs, fit_quality(docs, labels.where("false"))).where("score BETWEEN 0 AND 1").count() == 162


def test_mixing(spark):
    rows = [(k, prose(50) + " good" * 3) for k in range(60)] + [(100 + k, prose(50) + " BAD!" * 6) for k in range(60)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good" if i < 100 else "bad") for i, _ in rows[:-2]], "doc_id long, domain string")
    model = fit_domains(docs, labels)
    mixed = mix_to_targets(domain_posteriors(docs, model), model.domains, {"good": 0.8, "bad": 0.2}).toPandas()
    p, n = np.stack(mixed.posteriors), mixed.n_tokens.to_numpy()
    assert np.allclose((n * mixed.rate) @ p / n.sum(), [0.2, 0.8], atol=1e-3) and (mixed.rate >= 0).all()
    one = fit_domains(docs, labels.where("false"))
    assert mix_to_targets(domain_posteriors(docs, one), one.domains, {"good": 1.0}).where("rate <> 1").isEmpty()


def test_best_fit_is_tightest_and_respects_conflicts():
    placed = best_fit([60, 50, 40, 40, 30], ["a", "a", "b", "a", "b"], [1, 2, 3, 1, 4], 100, 1)
    assert [b for b, _ in placed] == [0, 1, 0, 2, 1]


def test_packing(spark):
    rows = [(k, int(n), f"s{k % 3}" if k % 5 else None, k % 11 if k % 2 else None) for k, n in enumerate(RNG.integers(0, 250, 300))]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long")
    t = pack(df, capacity=100, shard_pieces=80).toPandas().merge(df.toPandas(), on="doc_id")
    assert t.groupby("doc_id").piece_tokens.sum().sort_index().tolist() == [n for _, n, _, _ in rows]
    full = t[t.piece_tokens > 0]
    assert full.groupby("bin_id").piece_tokens.sum().max() <= 100
    assert full.groupby(["bin_id", "source"]).doc_id.nunique().max() <= 2
    assert full.groupby(["bin_id", "cluster"]).doc_id.nunique().max() == 1
    assert t[t.piece_tokens == 0].bin_id.isna().all()


def test_license_scan(spark):
    notices = dict(license_texts.NOTICES)
    long_notice = notices["MIT-permission"].split()
    rows = [(k, prose(30) + "\n" + text + " " + prose(20)) for k, text in enumerate(notices.values())] + [(50, " ".join(long_notice[:7] + ["changed"] + long_notice[7:])), (51, None), (52, ""), (53, prose(400)), (54, "Released under the MIT License")]
    got = {(r.doc_id, r.template_id, r.start_word) for r in license_scan.find_licenses(frame(spark, rows), license_scan.templates(spark)).collect()}
    assert got == {(k, name, 30) for k, name in enumerate(notices)} | {(54, "MIT", 0)}  # 50 keeps 12 of 16 shingles, a share of 0.75


def test_license_scan_tells_creative_commons_apart(spark):
    rows = [(k, prose(30) + "\n" + text) for k, (_, text) in enumerate(license_texts.CC_NOTICES)]
    got = {(r.doc_id, r.template_id, r.start_word) for r in license_scan.find_licenses(frame(spark, rows), license_scan.templates(spark)).collect()}
    assert got == {(k, name, 30) for k, (name, _) in enumerate(license_texts.CC_NOTICES)}


@pytest.mark.parametrize("run", [
    lambda d, s: remove_repeated_passages(d),
    lambda d, s: near_dedup.near_duplicate_classes(d),
    lambda d, s: media_columns.store_as_media(d),
    lambda d, s: identify_languages(d, fit_languages(d)),
    lambda d, s: license_scan.find_licenses(d, license_scan.templates(s)),
    lambda d, s: pack(d.withColumns({"source": F.col("lang"), "cluster": F.col("doc_id"), "n_tokens": F.lit(1)})),
])
def test_empty_tables(spark, run):
    assert run(frame(spark, []), spark).count() == 0


def test_near_dedup_and_licenses_without_broadcasts(spark, texts):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(frame(spark, texts), broadcast_rows=0).collect()}
    assert got == brute_classes(texts)
    rows = [(1, prose(20) + " Released under the MIT License. " + prose(9)), (2, None)]
    found = license_scan.find_licenses(frame(spark, rows), license_scan.templates(spark), broadcast_rows=0).collect()
    assert [(r.doc_id, r.template_id, r.start_word) for r in found] == [(1, "MIT", 20)]
