"""Merkle manifests, prefix tries and disclosures against plain loops."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
import regex
from pyspark.sql import functions as F

from glintfield.llm import disclosure, merkle_manifest, prefix_trie, queries

SF = "/root/testdata/sf0.001"


def hexed(text):
    return sha256(text.encode()).hexdigest()


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


# Merkle manifest


def leaf(row, text):
    return hexed("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(nodes, arity=8):
    """The root, and for each leaf what stands left and right of its path."""
    paths, own = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for j in range(len(run)):
                for i in own[k + j]:
                    paths[i] += ["".join(run[:j]), "".join(run[j + 1 :])]
            above.append(hexed("".join(run)))
            owners.append(sum(own[k : k + arity], []))
        nodes, own = above, owners
    return nodes[0], paths


def manifest(rows, arity=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        found[name] = tree([leaf(r, r["text"]) for r in groups[name]], arity)
    root, tops = tree([found[n][0] for n in names], arity) if names else ("", [])
    out = []
    for name, top in zip(names, tops):
        for r, path in zip(groups[name], found[name][1]):
            text, path = r["text"], path + top
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            folded = leaf(r, text)
            for k in range(0, len(path), 2):
                folded = hexed(path[k] + folded + path[k + 1])
            out.append((r["doc_id"], leaf(r, r["text"]), found[name][0], root, hexed("".join(path)), folded, folded == root))
    return out


def tampered(df):
    return {"text": F.when(queries.id_residue(F.col("doc_id"), 3) == 0, F.translate("text", queries.UPPER, queries.LOWER)).otherwise(F.col("text"))}


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, block int, tree string, node string"


def documents(spark, rows):
    """rows of (doc_id, text, lang), with columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "x", 1, "y", "z") for i, t, g in rows], DOCS)


@pytest.mark.parametrize("size", [1, 2, 7, 8, 9, 63, 64, 65, 500, 512])
def test_traversal_gives_the_paths_of_the_whole_tree(size):
    nodes = [hexed(str(k)) for k in range(size)]
    levels = next(k for k in range(5) if 8**k >= size)
    for height in (1, 2):
        walk = merkle_manifest.Traversal(nodes, levels, 8, height)
        assert list(walk.paths()) == tree(nodes)[1]
    assert merkle_manifest.block_root(nodes, levels, 8) == tree(nodes)[0]


def test_traversal_keeps_two_runs_a_level():
    """What a subtree in the making holds is bounded by the levels, not by the block."""
    nodes = [hexed(str(k)) for k in range(512)]
    part = merkle_manifest.Subtree(nodes, [512, 64, 8, 1], 2, 3, 0, 8)
    most = 0
    while part.grow():
        most = max(most, sum(map(len, part.runs)) + sum(map(len, part.rows)))
    assert most <= 8 * 3 + 8


def test_manifest_of_all_documents(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(queries.op11_merkle_manifest(spark, SF).collect(), manifest(rows))


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_edges(spark, levels):
    rows = [(k, "Text %d" % k, "a") for k in range(70)] + [(None, "n", "a"), (None, None, None), (5, None, None), (6, "", None)]
    rows += [(7, "Same", "é"), (7, "Same", "é"), (7, "Other", "é"), (8, "X", "z"), (9, "Y" * 50_000, "")]
    df = documents(spark, rows)
    got = merkle_manifest.merkle_manifest(df, found=tampered(df), block_levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(got.collect(), manifest([r.asDict() for r in df.collect()]))


def test_manifest_of_a_hot_repeated_row(spark):
    df = documents(spark, [(1, "A", "a"), (3, "C", "a")] + [(2, "B", "a")] * 150)
    same(merkle_manifest.merkle_manifest(df, found=tampered(df), block_levels=1).collect(), manifest([r.asDict() for r in df.collect()]))


def test_manifest_proofs_verify(spark):
    rows = merkle_manifest.merkle_manifest(documents(spark, [(k, str(k), "ab"[k % 2]) for k in range(30)]), proofs=True).collect()
    assert all(merkle_manifest.fold(r.leaf, r.proof) == r.root and hexed("".join(r.proof)) == r.proof_sha256 and r.verified for r in rows)


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle_manifest.merkle_manifest(documents(spark, [(1, "x", "a")]).limit(0)).collect() == []
    (only,) = merkle_manifest.merkle_manifest(documents(spark, [(1, "x", "a")])).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == hexed("") and only.verified


# Prefix trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def conversations(rows):
    """The contract's rebuilt conversations of rows(conv_id, turn, role, text)."""
    own = {}
    digest = lambda role, text: hexed(f"{len(role.encode())}:{role}{text}")
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    first = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: turns.get(c - c % 20, [])[: first(c)] + t[first(c) :] for c, t in turns.items()}


def trie(built):
    members, below, leaves, saved = {}, {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            below.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        kids = below.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    ends = lambda p, m: hexed(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))))
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below.get(p, [])), leaves[p], saved[p], ends(p, m)) for p, m in members.items()]


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, key string")


def test_trie_of_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op13_prefix_trie(spark, SF).collect(), trie(conversations(rows)))


def test_trie_edges(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["u", "", None]), rnd.choice(["a b", "a", "", None, "c  d\te"])) for c in range(60) for t in range(rnd.randint(1, 5))]
    rows += [(None, 0, "u", "lost"), (61, None, "u", "first"), (61, 3, "u", "y"), (61, 3, "u", "x"), (61, 3, "u", "x"), (-7, 0, "u", "below")]
    rows += [(400 + c, t, "u", f"turn {t}") for c in range(25) for t in range(4)] + [(600, t, "u", str(t % 3)) for t in range(300)] + [(602, t, "u", str(t % 3)) for t in range(299)]
    built = queries.rebuilt(prefix_trie.conversation_turns(turns_of(spark, rows)))
    for range_bytes in (1, 1 << 20):
        same(prefix_trie.prefix_trie(built, range_bytes=range_bytes).collect(), trie(conversations(rows)))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(prefix_trie.conversation_turns(turns_of(spark, [(1, 1, "u", "x")]).limit(0))).collect() == []


def test_trie_in_any_ranges():
    """Random sequences cut into ranges at random places give the nodes of the uncut tree."""
    rnd = random.Random(5)
    weight = {0: 1, 1: 5, 2: 7}
    for _ in range(400):
        keys = sorted({bytes(b for x in rnd.choices(range(3), k=rnd.randint(0, 6)) for b in [x] * 16) for _ in range(rnd.randint(1, 14))})
        convs, copies = rnd.sample(range(100), len(keys)), [rnd.randint(1, 3) for _ in keys]
        cuts = sorted(rnd.sample(range(1, len(keys)), min(len(keys) - 1, rnd.randint(0, 4)))) if len(keys) > 1 else []
        parts = [range(a, b) for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        common = [prefix_trie.common_turns(keys[b[-1]], keys[a[0]]) for b, a in zip(parts, parts[1:])]
        sides = list(zip([-1, *common], [*common, -1]))
        trees = [prefix_trie.Patricia([keys[i] for i in p], [[weight[keys[i][j]] for j in range(0, len(keys[i]), 16)] for i in p], [convs[i] for i in p], [copies[i] for i in p], *s) for p, s in zip(parts, sides)]
        rows = [{"part": k, "common": prefix_trie.common_turns(keys[p[0]], keys[p[-1]]), "left": t.border(True), "right": t.border(False)} for k, (p, t) in enumerate(zip(parts, trees))]
        got = [tuple(x.values()) for m, p, t in zip(prefix_trie.merge_borders(rows), parts, trees) for x in t.nodes(m["left"], m["right"], [keys[i].hex() for i in p]).to_pylist()]
        members = {}
        for i, key in enumerate(keys):
            for d in range(0, len(key) + 1, 16):
                members.setdefault(key[:d], []).append(i)
        count = {p: sum(copies[i] for i in m) for p, m in members.items()}
        want = []
        for p, m in members.items():
            sub = [q for q in members if q.startswith(p)]
            childless = [q for q in sub if not any(z != q and z.startswith(q) for z in sub)]
            want.append((min(convs[i] for i in m), len(p) // 16, min(convs[i] for i in members[p[:-16]]) if p else None, count[p], sum(len(q) == len(p) + 16 for q in sub), len(childless), sum((count[q] - 1) * weight[q[-1]] for q in sub if q), p.hex() if p in keys else prefix_trie.NO_ENDS))
        same(got, want)


def test_streamed_digests(spark):
    rows = [("k%d" % (v % 3), v) for v in random.Random(1).sample(range(-500, 5000), 900)]
    got = prefix_trie.joined_digests(spark.createDataFrame(rows, "key string, value bigint"), "key", "value", piece_ids=7).collect()
    same(got, [(k, hexed(",".join(str(v) for v in sorted(v for j, v in rows if j == k)))) for k in ("k0", "k1", "k2")])


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = regex.compile(r"[\p{L}\p{N}]+")


def confirmed(kind, value):
    digits = re.sub("[^0-9]", "", value)
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0,
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def personal(text):
    return [(k, m.start(), m.end(), m.group(0)) for k, p in PATTERNS.items() for m in re.finditer(p, text) if confirmed(k, m.group(0))]


def private(rows, reach=100, support=2, at=0.9):
    def name(kind, value):
        return f"{kind}:" + (re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())

    together, holders, having, seen = Counter(), Counter(), Counter(), []
    for doc, text in rows:
        text = text or ""
        base, near = personal(text), set()
        spans = sorted((s, e, k, v) for k, s, e, v in base)
        for i, (s, e, k, v) in enumerate(spans):
            matches = [m.span() for m in re.finditer(PATTERNS[k], text) if k != "card" or len(re.sub("[^0-9]", "", m.group(0))) >= 16]
            j = matches.index((s, e))
            low, high = max((x[1] for x in spans[:i]), default=0), spans[i + 1][0] if i + 1 < len(spans) else len(text) + 1
            left = max(matches[j - 1][1] if j else 0, s - reach)
            right = min(matches[j + 1][0] if j + 1 < len(matches) else len(text), e + reach)
            before, after = text[left:s], text[e:right]
            if len(before) == reach:
                before = regex.sub(r"^[\p{L}\p{N}]+", "", before)
            if len(after) == reach:
                after = regex.sub(r"[\p{L}\p{N}]+$", "", after)
            words = [(s - len(before) + m.start(), m.group(0)) for m in TERM.finditer(before)] + [(e + m.start(), m.group(0)) for m in TERM.finditer(after)]
            near |= {(name(k, v), w, a, a + len(w)) for a, w in words if a + len(w) <= s and a >= low or a >= max(e, low) and a + len(w) <= high}
        together.update({x[:2] for x in near})
        holders.update({name(k, v) for k, _, _, v in base})
        having.update(set(TERM.findall(text)))
        seen.append((doc, base, near))
    n, flagged = len(rows), set()
    for (c, w), both in together.items():
        if both >= support and holders[c] < n and math.log(n * both / (holders[c] * having[w])) / math.log(n / holders[c]) >= at - 1e-12:
            flagged.add((c, w))
    out = []
    for doc, base, near in seen:
        labels = [f"{k}:{s}:{e}" for k, s, e, _ in base]
        terms = sorted({(s, e) for c, w, s, e in near if (c, w) in flagged})
        count = Counter(k for k, *_ in base)
        out.append((doc, *(count[k] for k in PATTERNS), hexed(",".join(labels)), ",".join(labels + [f"term:{s}:{e}" for s, e in terms])))
    return out


def op12_over(monkeypatch, spark, df):
    monkeypatch.setattr(queries, "documents", lambda *_: df)
    return queries.op12_pii(spark, "").collect()


def test_personal_data_of_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.op12_pii(spark, SF).collect(), private(rows))


TRICKY = [
    "a@b.com_x@y.org and .@c.de, a@b.com.@c.de; a@b, @x.y a@b..c %+-@d-.e-",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 001.002.0003.255 1.2.3 9999999999.1.1.1 1..2.3.4",
    "4111111111111111 4111-1111 1111-1111 4111 1111 1111 1112 4111  1111111111111 " + "4" * 15 + " " + "0" * 19 + " " + "0" * 20,
    "+1 (017) 555-7713 +12 +1-2 +1234567 +12345678 +1 2) +123456789012345 +1234567890123456 ++1 555 555 5555.",
    "é\U0001f600 née a.b@c.io \U0001f600\U0001f600 10.0.0.1 ümlaut +49 30 1234567 4111 1111 1111 1111",
    "mail a@b.cc or +1 555 555 55554111111111111111 10.0.0.1@host.net",
    "", None, "   ", "@" * 50, "+" * 50, "1" * 30_000, "a" * 30_000 + "@", "a.b" * 5_000 + "@c" + ".d" * 5_000,
]


def test_personal_data_edges(monkeypatch, spark):
    rows = [(k, t) for k, t in enumerate(TRICKY)] + [(0, TRICKY[0]), (None, "z@z.zz"), (None, "z@z.zz")]
    rows += [(100 + k, f"the patient Quibble wrote from q@mail.org today {k}") for k in range(6)]
    rows += [(200 + k, "the weather today is fine") for k in range(40)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id bigint, text string, spans string, row int")
    got = op12_over(monkeypatch, spark, df)
    same(got, private(rows))
    told = {r.doc_id: r.spans for r in got}
    assert "term:12:19" in told[100] and told[200] == "" and told[6] == ""


def test_many_matches_in_one_text(monkeypatch, spark):
    rows = [(1, " ".join(f"u{k}@h.org 10.0.{k % 300}.1" for k in range(800))), (2, "x")]
    same(op12_over(monkeypatch, spark, spark.createDataFrame(rows, "doc_id bigint, text string")), private(rows))


def test_no_documents(monkeypatch, spark):
    assert op12_over(monkeypatch, spark, spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_sanitised_text(spark):
    rows = [(k, f"Call Zorblax 77 at zx@mail.org or 10.0.0.{k}, thanks") for k in range(3)] + [(k, "Call the shop, thanks") for k in range(3, 40)] + [(50, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    removed = {r.doc_id: r.sanitised for r in disclosure.find_personal_data(df, sanitise=True).collect()}
    assert removed[0] == "Call   at [EMAIL]  [IP], thanks" or removed[0] == "Call    [EMAIL]  [IP], thanks"
    general = {r.doc_id: r.sanitised for r in disclosure.find_personal_data(df, sanitise=True, remove_at=2.0).collect()}
    assert "[NAME] [NUMBER]" in general[1] and removed[3] == "Call the shop, thanks" and removed[50] == ""


def test_disclosure_is_one_for_words_of_one_entity(spark):
    df = spark.createDataFrame([(k, f"Zorblax z@m.org common {'x' if k else 'y'}") for k in range(3)] + [(k, "common words") for k in range(3, 30)], "doc_id bigint, text string")
    spans = disclosure.settled(disclosure.personal_spans(df))
    told = {r.term: r.disclosure for r in disclosure.disclosures(df, disclosure.settled(disclosure.words_beside(spans)), spans, broadcast_terms=0).collect()}
    assert told["Zorblax"] == pytest.approx(1) and abs(told["common"]) < 1e-9 and "y" not in told
