"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted across documents.

A window is repeated if its word sequence also starts in a document with a smaller id. Every word
that a repeated window covers is removed; overlapping windows merge into maximal intervals.

Plan, for any size of corpus:

1. Documents are dealt into groups of about `group_bytes` of text by a hash of id and text, so neither
   the driver nor any task needs to know the ids' distribution.
2. Each group hashes all windows of its documents and sends every distinct hash once to the hash's
   bucket, packed, with the smallest id that has it there. A passage that a third of all documents hold
   costs one entry a group, not one a document.
3. Each bucket takes the smallest id of each hash and answers every group whose own smallest id is larger.
4. Each group meets its answers, adds the repeats inside the group, merges intervals and cuts.

Hashes have 64 + 16 bits from two Rabin-Karp polynomials over 64-bit word hashes: with N windows
some two different ones meet with a probability of about N*N / 2**81 (3e-5 for 8 billion).

Defined cases: a null text has no words and stays null; an empty one stays empty; documents
shorter than the window are untouched; rows that repeat an id are one document to each other (no
removal among them); rows with a null id are returned untouched and remove nothing; an empty
table gives an empty result; columns of the input that clash with the output's are dropped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintfield.llm.common import WordHashes, given_back, mix64

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SPAN = T.StructType().add("start", "long").add("end", "long")
RESULT = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("removed", T.ArrayType(SPAN))

_HASHES = WordHashes()


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i < n."""
    up, down = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of `window` word hashes, from differences of prefix sums."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    out = []
    for base, x in zip(BASES, (words, mix64(words))):
        up, down = _powers(len(words), base)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(x * up, out=sums[1:])
        out.append(mix64((sums[window:] - sums[:-window]) * down[:n]))
    return out[0], (out[1] >> np.uint64(48)).astype(np.uint16)


class Windows:
    """The windows of the documents of one group, in the order of their ids."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int):
        # Words are held for one document at a time: as objects they take ten times their bytes.
        hashed = [_HASHES.of(text.split()) for text in texts]
        self.counts = np.array([len(x) for x in hashed], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        tokens = np.concatenate([*hashed, np.empty(0, np.uint64)])
        del hashed
        high, low = window_hashes(tokens, window)
        of_word = np.repeat(np.arange(len(texts)), self.counts)
        self.at = np.flatnonzero(of_word[: len(high)] == of_word[window - 1 :]) if len(high) else np.empty(0, np.int64)
        self.doc = ids[of_word[self.at]] if len(self.at) else np.empty(0, np.int64)
        high, low = high[self.at], low[self.at]
        order = np.argsort(high, kind="stable")
        self.order, self.high, self.low = order, high[order], low[order]
        self.first = np.ones(len(order), bool)
        self.first[1:] = (self.high[1:] != self.high[:-1]) | (self.low[1:] != self.low[:-1])

    def repeated(self, high: np.ndarray, low: np.ndarray, window: int) -> np.ndarray:
        """Which words a repeated window covers; high, low: the hashes that earlier groups have, sorted."""
        run_start = np.maximum.accumulate(np.where(self.first, np.arange(len(self.first)), 0))
        docs = self.doc[self.order]
        again = docs > docs[run_start] if len(docs) else np.empty(0, bool)
        if len(high):
            at = np.minimum(np.searchsorted(high, self.high), len(high) - 1)
            again |= (high[at] == self.high) & (low[at] == self.low)
        edges = np.zeros(int(self.starts[-1]) + 1, np.int64)
        begun = self.at[self.order[again]]
        np.add.at(edges, begun, 1)
        np.add.at(edges, begun + window, -1)
        return np.cumsum(edges[:-1]) > 0


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane: the high planes are mostly zero and shrink in the shuffle."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, n: int, at: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def pack(high: np.ndarray, low: np.ndarray, ids: np.ndarray | None = None) -> bytes:
    """Sorted hashes as differences, their low parts, and the ids that go with them."""
    packed = _planes(np.diff(high, prepend=np.uint64(0))) + low.tobytes()
    return packed if ids is None else packed + _planes(ids.astype(np.int64).view(np.uint64))


def unpack(packed: bytes, with_ids: bool = False) -> tuple[np.ndarray, ...]:
    n = len(packed) // (18 if with_ids else 10)
    high, low = np.cumsum(_numbers(packed, n, 0), dtype=np.uint64), np.frombuffer(packed, np.uint16, n, 8 * n)
    return (high, low, _numbers(packed, n, 10 * n).view(np.int64)) if with_ids else (high, low)


def _sorted_group(table: pa.Table, id_col: str) -> pa.Table:
    return table.sort_by([(id_col, "ascending")]) if table.num_rows > 1 else table


def _texts(table: pa.Table) -> list[bytes]:
    return [(x or "").encode() for x in table["text"].to_pylist()]


def _done() -> None:
    """Between groups a worker keeps no words and no free memory."""
    _HASHES.clear()
    given_back()


def _kept(text: bytes, gone: np.ndarray, rejoin: bool) -> str:
    if rejoin:
        return b" ".join([w for w, g in zip(text.split(), gone.tolist()) if not g]).decode()
    if not gone.any():
        return text.decode()
    parts, here = [], 0
    spans = [m.span() for m in WORD.finditer(text)]
    for start, end in _runs(gone):
        parts.append(text[here : spans[start][0]])
        here = spans[end - 1][1]
    return (b"".join(parts) + text[here:]).decode()


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _untouched(df: DataFrame, id_col: str, text_col: str, keep: list[str], rejoin: bool) -> DataFrame:
    """The result's rows for rows that nothing is removed from."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    kept = F.when(F.col(text_col).isNotNull(), F.array_join("words", " ")) if rejoin else F.col(text_col)
    counted = df.withColumn("words", words).select(id_col, *keep, F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), kept.alias("kept_text"))
    return counted.withColumn("removed", F.array().cast(RESULT["removed"].dataType))


def remove_repeated_passages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, window: int = 50, rejoin: bool = True, group_bytes: int = 1 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """Per row of df: the id, the `keep` columns, n_words, n_removed, kept_text and the removed word intervals.

    kept_text joins the kept words by one space, or with rejoin=False is the text with the removed
    passages cut out. id_col holds integers. A bucket holds the hashes of about `bucket_bytes` of text.
    """
    keep = [c for c in keep or [] if c not in (id_col, text_col, *RESULT.names)]
    df = df.select(id_col, text_col, *keep)
    total, rows = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.count(F.lit(1))).first()
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = (max(1, min(rows, max(total // size, least))) for size in (group_bytes, bucket_bytes))

    spot = F.pmod(F.xxhash64(id_col, text_col), F.lit(groups)).cast("int")
    dealt = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.struct(id_col, *keep).alias("row"), F.col(text_col).alias("text"), spot.alias("g"))
    bucket_of = np.uint64(buckets)

    def send(key: tuple, table: pa.Table) -> pa.Table:
        table = _sorted_group(table, "id")
        w = Windows(table["id"].to_numpy(), _texts(table), window)
        high, low, ids = w.high[w.first], w.low[w.first], w.doc[w.order][w.first]
        bucket = (high >> np.uint64(32)) * bucket_of >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 40))) if len(high) else np.empty(0, int)
        ends = [*cuts[1:].tolist(), len(high)]
        packed = [pack(high[a:b], low[a:b], ids[a:b]) for a, b in zip(cuts.tolist(), ends)]
        sent = pa.table([pa.array(bucket[cuts].astype(np.int32)), pa.array(np.full(len(cuts), key[0].as_py(), np.int32)), pa.array(packed, pa.binary())], schema=SENT)
        _done()
        return sent

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack(x, with_ids=True) for x in table["packed"].to_pylist()]
        owner = np.repeat(table["g"].to_numpy(), [len(h) for h, _, _ in parts])
        high, low, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(high, kind="stable")
        high, low, ids, owner = high[order], low[order], ids[order], owner[order]
        begins = np.ones(len(high), bool)
        begins[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(begins)
        again = ids > np.repeat(np.minimum.reduceat(ids, at), np.diff(at, append=len(ids)))
        high, low, owner = high[again], low[again], owner[again]
        order = np.argsort(owner, kind="stable")
        high, low, owner = high[order], low[order], owner[order]
        cuts = np.flatnonzero(np.diff(owner, prepend=-1)) if len(owner) else np.empty(0, int)
        ends = [*cuts[1:].tolist(), len(owner)]
        answered = pa.table([pa.array(owner[cuts].astype(np.int32)), pa.array([pack(high[a:b], low[a:b]) for a, b in zip(cuts.tolist(), ends)], pa.binary())], schema=ANSWERED)
        _done()
        return answered

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _sorted_group(table, "id")
        texts = _texts(table)
        w = Windows(table["id"].to_numpy(), texts, window)
        parts = [unpack(x) for x in answers["packed"].to_pylist()]
        high, low = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint16))
        order = np.argsort(high, kind="stable")
        gone = w.repeated(high[order], low[order], window)
        masks = [gone[w.starts[k] : w.starts[k + 1]] for k in range(len(texts))]
        kept = [_kept(t, mask, rejoin) if z.is_valid else None for z, t, mask in zip(table["text"], texts, masks)]
        spans = pa.array([[{"start": a, "end": b} for a, b in _runs(m)] for m in masks], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        out = pa.table({"row": table["row"], "n_words": pa.array([len(m) for m in masks], pa.int64()), "n_removed": pa.array([int(m.sum()) for m in masks], pa.int64()), "kept_text": pa.array(kept, pa.string()), "removed": spans})
        del w, texts, kept
        _done()
        return out

    sent = dealt.groupBy("g").applyInArrow(send, "bucket int, g int, packed binary")
    answered = sent.groupBy("bucket").applyInArrow(answer, "g int, packed binary")
    schema = T.StructType([T.StructField("row", dealt.schema["row"].dataType), *RESULT])
    out = dealt.groupBy("g").cogroup(answered.groupBy("g")).applyInArrow(cut, schema).select("row.*", *RESULT.names)
    return out.unionByName(_untouched(df.where(F.col(id_col).isNull()), id_col, text_col, keep, rejoin))


SENT = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("packed", pa.binary())])
ANSWERED = pa.schema([("g", pa.int32()), ("packed", pa.binary())])
