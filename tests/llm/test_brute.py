"""Operators that SQL cannot express against plain loops, and the cases every operator defines."""

import hashlib
import io
import math
import re
import wave
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from glintfield.llm import license_scan, license_texts, media_columns, queries
from glintfield.llm.common import crc_of_id
from glintfield.llm.language_id import fit_languages, identify_languages
from glintfield.llm.packing import best_fit, pack
from glintfield.llm.quality_score import fit_quality, score_quality
from glintfield.llm.source_mixing import domain_posteriors, fit_domains, mix_to_targets
from glintfield.llm.topk_search import exact_top_k, integer_vector
from glintfield.llm.url_filters import Rule, filter_urls
from tests.llm.test_operators import brute_classes, brute_removal

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(11)


def prose(n):
    return " ".join(f"w{k}" for k in RNG.integers(0, 400, n))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def block_sizes(data, dictionaries, level, block):
    """Compressed bytes with each dictionary, one block and one compressor at a time."""
    total = [0] * len(dictionaries)
    for k, content in enumerate(dictionaries):
        for at in range(0, len(data), block):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=p)
            total[k] += len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(data[at : at + block]))
    return total


def only_letters(text):
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def test_language_id_by_loops(spark, docs):
    model = fit_languages(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    got = {r.doc_id: r for r in queries.op2_language_id(spark, SF).collect()}
    for r in docs.collect():
        letters = only_letters(r.text or "").encode()
        assert got[r.doc_id].held_out == (crc_of_id(r.doc_id) % 3 == 1)
        if not letters:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        sizes = block_sizes(letters, model.dictionaries, model.level, model.block)
        best = sizes.index(min(sizes))
        odds = [2 ** (-8 * (s - sizes[best]) / model.bits_per_doubling) for s in sizes]
        assert got[r.doc_id].lang_pred == model.languages[best]
        assert got[r.doc_id].score == pytest.approx(1 / sum(odds))


def test_language_id_cases(spark):
    train = spark.createDataFrame([(k, "alpha beta gamma " * 20, "aa") for k in range(5)] + [(10 + k, "delta epsilon zeta " * 20, "bb") for k in range(5)], "doc_id long, text string, lang string")
    model = fit_languages(train)
    rows = [(1, "½ ² Ⅷ ① 12"), (2, "alpha Ⅷ beta"), (2, "alpha Ⅷ beta"), (3, "delta zeta " * 60_000), (None, None), (4, "q")]
    asked = spark.createDataFrame([(i, t, "x", 5.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double")
    got = {r.doc_id: r for r in identify_languages(asked, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, None)] == ["und", "aa", "bb", "und"]
    tie = fit_languages(train.withColumn("text", F.lit("alpha beta gamma " * 20)))
    assert {(r.lang_pred, r.rejected) for r in identify_languages(asked.where("doc_id = 2"), tie).collect()} == {("aa", True)}


def test_quality_by_loops(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    got = {r.doc_id: r for r in queries.op5_quality_classifier(spark, SF).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        g, b = block_sizes(data, [model.good, model.bad], model.level, model.block) if data else (0, 0)
        raw = (b - g + model.average * model.prior_bytes) / (b + g + model.prior_bytes)
        want = 1 / (1 + math.exp(-(raw * model.slope + model.offset)))
        assert got[r.doc_id].score == pytest.approx(want) and got[r.doc_id].predicted == int(want >= 0.7)
        assert got[r.doc_id].held_out == (crc_of_id(r.doc_id) % 4 == 2)


def members(spark, p, n):
    rows = [(k, int(n[k]), [float(x) for x in p[k]]) for k in range(len(p))]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, posteriors array<double>")


@pytest.mark.parametrize("goal, slack", [({"a": 0.5, "b": 0.3, "c": 0.2}, 2e-4), ({"a": 1.0}, 0.02)])
def test_mixing_reaches_the_least_squares(spark, goal, slack):
    """The second target is out of reach for soft posteriors, so its least squares have a rest."""
    p = RNG.dirichlet([1.0, 0.6, 0.4], 200) * 0.9 + 0.1 / 3
    n = RNG.integers(0, 300, 200)
    target = np.array([goal.get(d, 0.0) for d in "abc"])
    mixed = mix_to_targets(members(spark, p, n), list("abc"), goal).toPandas().sort_values("doc_id")
    share = (n * mixed.rate.to_numpy()) @ p / n.sum()
    rate = np.ones(200)
    step = 1 / np.linalg.norm((p * n[:, None]).T @ p / n.sum(), 2)
    for _ in range(20_000):
        rate = np.maximum(0, rate - step * (p @ ((n * rate) @ p / n.sum() - target)))
    best = np.linalg.norm((n * rate) @ p / n.sum() - target)
    assert (mixed.rate >= 0).all() and np.linalg.norm(share - target) <= best + slack
    assert (np.abs(mixed.copies - mixed.rate) < 1).all()


@pytest.mark.parametrize("spread", [0.01, 0.03, 0.05])
@pytest.mark.parametrize("kept", [0.5, 0.85])
def test_mixing_meets_reachable_targets_of_posteriors_that_are_alike(spark, spread, kept):
    """The targets are the shares of the documents with the largest second posterior, so they are in reach."""
    rng = np.random.default_rng(int(100 * spread + 10 * kept))
    p = np.abs([0.9, 0.06, 0.04] + rng.normal(0, spread, (1000, 3)))
    p /= p.sum(1, keepdims=True)
    n = rng.integers(1, 500, 1000)
    some = n * (p[:, 1] > np.quantile(p[:, 1], kept))
    goal = some @ p / some.sum()
    mixed = mix_to_targets(members(spark, p, n), list("abc"), dict(zip("abc", goal.tolist()))).toPandas().sort_values("doc_id")
    share = (n * mixed.rate.to_numpy()) @ p / n.sum()
    assert mixed.converged.all() and np.abs(share - goal).max() < 1e-4 and np.abs(share - goal).max() == pytest.approx(mixed.gap.iloc[0], abs=1e-9)
    assert (mixed.rate >= 0).all()


def test_mixing_says_what_is_out_of_reach(spark):
    p = RNG.dirichlet([1.0, 0.6, 0.4], 200) * 0.9 + 0.1 / 3
    n = RNG.integers(1, 300, 200)
    mixed = mix_to_targets(members(spark, p, n), list("abc"), {"b": 1.0}).toPandas()
    share = (n * mixed.sort_values("doc_id").rate.to_numpy()) @ p / n.sum()
    assert not mixed.converged.any() and mixed.gap.iloc[0] == pytest.approx(np.abs(share - [0, 1, 0]).max(), abs=1e-9)


def test_mixing_that_does_not_settle_is_an_error(spark):
    p = RNG.dirichlet([1.0, 1.0], 50)
    with pytest.raises(RuntimeError):
        mix_to_targets(members(spark, p, np.full(50, 100)), ["a", "b"], {"a": 0.9, "b": 0.1}, most_rounds=1)


def scanned_fit(lengths, sources, clusters, capacity, per_source):
    bins, out = [], []
    for n, s, c in zip(lengths, sources, clusters):
        open_to = [b for b, held in enumerate(bins) if sum(x for x, _, _ in held) + n <= capacity and (s is None or sum(t == s for _, t, _ in held) < per_source) and (c is None or all(t != c for _, _, t in held))]
        tightest = min(open_to, key=lambda b: (capacity - sum(x for x, _, _ in bins[b]), b), default=None)
        if tightest is None:
            tightest = len(bins)
            bins.append([])
        out.append((tightest, len(bins[tightest])))
        bins[tightest].append((n, s, c))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_tightest_of_all_bins(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 101, 250).tolist(), reverse=True)
    sources = [None if x == 0 else f"s{x}" for x in rng.integers(0, 5, 250)]
    clusters = [None if x < 20 else int(x) for x in rng.integers(0, 60, 250)]
    assert best_fit(lengths, sources, clusters, 100, 3) == scanned_fit(lengths, sources, clusters, 100, 3)


def test_shards_cost_few_bins(spark):
    rows = [(k, int(n), f"s{k % 40}", int(k)) for k, n in enumerate(RNG.integers(1, 2048, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long")
    bins = [pack(df, shard_pieces=m).select("bin_id").distinct().count() for m in (600, 1 << 20)]
    assert bins[0] <= 1.03 * bins[1]


def test_packing_cases(spark):
    rows = [(1, 5, "s", 1, "x")] * 3 + [(2, 250, "s", None, "x"), (3, 0, None, None, "x"), (None, 7, None, None, "x"), (4, None, "s", 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long, bin_id string")
    got = [tuple(r) for r in pack(df, capacity=100).collect()]
    assert sum(n for _, _, n, _, _ in got) == 15 + 250 + 7
    assert sorted(n for i, _, n, _, _ in got if i == 2) == [50, 100, 100]
    assert len({b for i, _, _, b, _ in got if i == 1}) == 3  # one cluster, three bins
    assert [(n, b) for i, _, n, b, _ in got if i in (3, 4)] == [(0, None)] * 2
    assert pack(df.where("false")).count() == 0


def test_stored_media_by_the_wave_module(spark, docs):
    got = {r.doc_id: r for r in media_columns.store_as_media(docs).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (max(64, math.ceil(len(raw) / 64) * 64) - len(raw))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        media, x = out.getvalue(), got[r.doc_id]
        with wave.open(io.BytesIO(media)) as w:
            assert w.readframes(1 << 30) == payload
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        turns = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        assert x.feature.startswith(f"wav;samples={len(payload)};sum={sum(payload)};distinct={len(set(payload))};turns={turns};embedded=")


def jpeg():
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd" + b"scan\xff\0more\xff\xd9"


def pdf():
    first = b"%PDF-1.4\n1 0 obj<<>>endobj\n"
    first += b"xref\n0 1\ntrailer<<>>\nstartxref\n%d\n%%%%EOF" % len(first)
    again = first + b"\n2 0 obj<<>>endobj\n"
    return again + b"xref\n0 1\ntrailer<<>>\nstartxref\n%d\n%%%%EOF" % len(again)


def mp4():
    box = lambda name, body: (8 + len(body)).to_bytes(4, "big") + name + body
    return box(b"ftyp", b"isom\0\0\2\0isom") + box(b"moov", b"x" * 9) + box(b"mdat", b"y" * 30)


def tiff():
    entries = [(256, 3, 1, 4), (257, 3, 1, 2), (273, 4, 1, 8), (279, 4, 1, 8)]
    table = len(entries).to_bytes(2, "little") + b"".join(t.to_bytes(2, "little") + k.to_bytes(2, "little") + c.to_bytes(4, "little") + v.to_bytes(4, "little") for t, k, c, v in entries)
    return b"II*\0" + (16).to_bytes(4, "little") + b"pixelpix" + table + b"\0" * 4


def ogg():
    page = lambda flags, n, body: b"OggS\0" + bytes([flags]) + b"\0" * 8 + (7).to_bytes(4, "little") + n.to_bytes(4, "little") + b"\0" * 4 + bytes([1, len(body)]) + body
    return page(2, 0, b"head") + page(0, 1, b"middle") + page(4, 2, b"tail")


def mp3():
    frame = b"\xff\xfb\x90\x00" + b"\0" * 413  # 128 kbit/s, 44,100 Hz
    return b"ID3\x04\0\0\0\0\0\x05hello" + frame * 4


@pytest.mark.parametrize("kind", ["jpeg", "pdf", "mp4", "tiff", "ogg", "mp3"])
@pytest.mark.parametrize("behind", [b"", b"z", b"zz", b"z" * 700])
def test_media_are_carved_whole(kind, behind):
    data = globals()[kind]()
    for before in (b"", b"some text "):
        found = [f for f in media_columns.sniff(before + data + behind) if f.kind == kind]
        assert [(f.offset, f.length) for f in found] == [(len(before), len(data))]
    assert not [f for f in media_columns.sniff(data[: len(data) // 2]) if f.kind == kind]


def test_media_cases(spark):
    flac = b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"\xff\xf8frame"
    avi = b"RIFF" + (16).to_bytes(4, "little") + b"AVI LIST" + (4).to_bytes(4, "little") + b"hdrl"
    assert [f.kind for f in media_columns.sniff(flac)] == ["flac"] and [f.kind for f in media_columns.sniff(avi)] == ["avi"]
    rows = [(k, x, "text/plain", "own") for k, x in enumerate([flac, flac, None, b"", b"a" * 3_000_000, b"PK\3\4" * 50_000 + b"%PDF-" * 50_000])]
    df = spark.createDataFrame(rows, "id int, b binary, t string, detected string")
    got = {r.id: r for r in media_columns.sniff_media(df, id_col="id", bytes_col="b", declared_col="t").collect()}
    assert got[0][1:] == got[1][1:] and got[0].corrected == "audio/flac" and {got[k].corrected for k in (2, 3, 4, 5)} == {"text/plain"}
    assert media_columns.sniff_media(df.where("false"), id_col="id", bytes_col="b").count() == 0


def plain(text):
    return "".join(c if c.isalpha() or c.isnumeric() else " " for c in (text or "").lower()).split()


def contained(words, template, share):
    """Whether some stretch of the words, a fifth longer than the template on both sides, holds that share of its shingles."""
    if len(template) < 5:
        return any(words[k : k + len(template)] == template for k in range(len(words)))
    pool = {tuple(template[k : k + 5]) for k in range(len(template) - 4)}
    at = [k for k in range(len(words) - 4) if tuple(words[k : k + 5]) in pool]
    slack = math.ceil(0.2 * len(template))
    for b in at:
        first = max(0, b - slack)
        region = words[first : b + len(template) + slack]
        if len({tuple(region[k : k + 5]) for k in range(len(region) - 4)} & pool) >= share * len(pool):
            return True
    return False


def test_license_scan_by_loops(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    got = {(r.doc_id, r.template_id) for r in license_scan.find_licenses(docs, license_scan.templates(spark)).collect()}
    shapes = [(name, plain(text)) for name, text in license_texts.TEMPLATES]
    want = {(r.doc_id, name) for r in rows for words in [plain(r.text)] for name, t in shapes if t[0] in words and contained(words, t, 0.8)}
    lines = {r.doc_id for r in rows if re.search(r"licens", r.text or "", re.I)}
    print(f"license lines {len(lines)}, documents found {len({i for i, _ in got})}")
    assert got == want and lines <= {i for i, _ in got}


def test_license_texts_are_found_whole_and_changed(spark):
    changed = lambda text: " ".join(w if k % 40 != 20 else "other" for k, w in enumerate(text.split()))
    rows = [(2 * k + j, prose(25) + "\n" + how(text) + "\n" + prose(25)) for k, (_, text) in enumerate(license_texts.TEXTS) for j, how in enumerate((str, changed))]
    rows += [(900 + k, f"// {line}\nint x;") for k, (_, line) in enumerate(license_texts.SPDX_LINES)] + [(1000, prose(120_000) + " SPDX-License-Identifier: MIT"), (None, "SPDX-License-Identifier: MIT")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, template_id string")
    got = {(r.doc_id, r.template_id) for r in license_scan.find_licenses(df, license_scan.templates(spark)).collect()}
    want = {(2 * k + j, name) for k, (name, _) in enumerate(license_texts.TEXTS) for j in range(2) if j == 0 or len(license_texts.TEXTS[k][1].split()) > 60}
    assert want <= got and {(900 + k, name) for k, (name, _) in enumerate(license_texts.SPDX_LINES)} <= got and (1000, "SPDX-MIT") in got
    assert all(i is not None for i, _ in got)


def test_empty_tables_of_the_others(spark):
    none = spark.createDataFrame([], "doc_id long, text string, quality int, domain string, vec_id long, vector array<bigint>, page_id long, url string")
    model = fit_domains(none, none.select("doc_id", "domain"))
    assert mix_to_targets(domain_posteriors(none, model), model.domains, {"x": 1.0}).count() == 0
    assert score_quality(none, fit_quality(none, none.select("doc_id", "quality"))).count() == 0
    assert exact_top_k(none, none).count() == 0 and filter_urls(none, [Rule("com", "/", "block")]).count() == 0


def test_long_repeated_and_clashing_rows(spark):
    long = " ".join(["Good words are here."] * 60_000)
    rows = [(1, long), (2, "good words"), (2, "good words"), (3, None), (4, ""), (None, "BAD BAD!!")] + [(10 + k, ("good words are here. " if k % 2 else "BAD!! ") * 30) for k in range(60)]
    df = spark.createDataFrame([(i, t, -1.0, -1, "own", "own") for i, t in rows], "doc_id long, text string, score double, predicted int, n_tokens string, rate string")
    labels = spark.createDataFrame([(10 + k, k % 2, "good" if k % 2 else "bad") for k in range(60)], "doc_id long, quality int, domain string")
    scored = score_quality(df, fit_quality(df, labels)).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored if r.doc_id == 2}) == 1 and all(0 <= r.score <= 1 for r in scored)
    model = fit_domains(df, labels)
    mixed = mix_to_targets(domain_posteriors(df, model), model.domains, {"good": 0.9, "bad": 0.1}).collect()
    assert len(mixed) == len(rows) and len({(r.rate, r.copies) for r in mixed if r.doc_id == 2}) == 1
    assert {r.n_tokens for r in mixed if r.doc_id in (3, 4)} == {0} and next(r.n_tokens for r in mixed if r.doc_id == 1) == 240_000


def test_top_k_of_repeated_rows(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [0.5, 0.5])] * 2000 + [(8, [0.9, 0.0]), (9, [0.5, -0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", integer_vector(F.col("e")).alias("vector"), F.lit("own").alias("score"))
    got = [tuple(r) for r in exact_top_k(df.where("vec_id = 0"), df, k=3, block_rows=50).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 230 * 256), (0, 2, 7, 128 * 256), (0, 3, 7, 128 * 256)]


def test_pipeline_stages_by_loops(spark, docs, tmp_path):
    stages, n = dict(corpus_pipeline.STAGES), iter(range(99))

    def written(df):
        path = str(tmp_path / str(next(n)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    told = {r.doc_id: r.rejected for r in identify_languages(docs, fit_languages(docs)).collect()}
    first = written(stages["language_id"](spark, docs, SF))
    assert sorted(r.doc_id for r in first.select("doc_id").collect()) == sorted(i for i, x in told.items() if not x)
    second = written(stages["near_dedup"](spark, first, SF))
    before = [tuple(r) for r in first.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in second.select("doc_id").collect()) == sorted(set(brute_classes(before).values()))
    third = written(stages["substring_dedup"](spark, second, SF))
    want = brute_removal([tuple(r) for r in second.select("doc_id", "text").collect()], 50)
    got = sorted((r.doc_id, hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text)).encode()).hexdigest(), r.n_chars) for r in third.collect())
    assert [x[:2] for x in got] == [(i, h) for i, _, _, h in want] and all(c == len(r.text) for r in third.collect() for c in [r.n_chars])
    fourth = written(stages["source_mixing"](spark, third, SF))
    times = {r.doc_id: r.n for r in fourth.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    model = fit_domains(third, queries.domain_labels(spark, SF))
    mixed = mix_to_targets(domain_posteriors(third, model), model.domains, queries.MIX_TARGETS).collect()
    assert times == {r.doc_id: r.copies for r in mixed if r.copies}
    packed = stages["packing"](spark, fourth, SF).toPandas()
    words = {r.doc_id: len((r.text or "").split()) for r in third.collect()}
    assert packed.groupby("doc_id").piece_tokens.sum().to_dict() == {i: words[i] * k for i, k in times.items()}
    assert packed.groupby("bin_id").piece_tokens.sum().max() <= 2048


def test_pipeline_passes_clashing_columns_and_nulls(spark):
    names = ["score", "margin", "lang_pred", "rejected", "n_words", "n_removed", "kept_text", "removed", "copy", "copies", "rate", "n_tokens", "posteriors", "docs_row", "nth", "row"]
    rows = [(k if k else None, prose(80), "en", "s", 1, *["own"] * len(names)) for k in range(12)] + [(50, None, None, None, None, *[None] * len(names)), (51, "", "en", "s", 0, *["own"] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    for frame in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == df.columns, name
            assert {r[n] for r in frame.collect() for n in names} <= {"own"}, name
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
