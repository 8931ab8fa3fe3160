"""URL filters: a sorted array of 64-bit digests, probed by binary search, confirmed by string.

Rules are (host, path prefix, action). A rule fits its host and every subdomain when the
url's path starts with the rule's path; the longest fitting rule decides, then `default`.

The rules become one block of bytes: sorted 64-bit xxhash keys, string offsets, strings and
actions. Executors receive it as a broadcast of checked size; each Python worker puts it in an
unlinked file and memory-maps that. All probe keys of a batch are searched at once, and a hit
counts only if the stored string equals the probe, so digest collisions never decide.
Rule sets above `max_broadcast_bytes` take `join_rules`, a shuffle join on the same keys.

Defined cases: a null url or one without "://" has empty host and path and fits no rule; a rule
given twice with both actions blocks; repeated pages give repeated rows; an empty table or an
empty rule list works; extra columns of the input are dropped.
"""

from __future__ import annotations

import mmap
import string
import tempfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("allow", "block")


class Rule(NamedTuple):
    host: str
    path: str
    action: str


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """The rule block: build() on the driver, the rest on a memory map of it."""

    def __init__(self, block):
        self.n, lengths, text_bytes = np.frombuffer(block, np.uint64, 3).astype(int)
        at = 24
        self.digests = np.frombuffer(block, np.uint64, self.n, at)
        at += 8 * self.n
        self.offsets = np.frombuffer(block, np.uint64, self.n + 1, at)
        at += 8 * (self.n + 1)
        self.path_lengths = np.frombuffer(block, np.uint64, lengths, at).astype(int).tolist()
        at += 8 * lengths
        self.actions = np.frombuffer(block, np.uint8, self.n, at)
        at += self.n
        self.texts = memoryview(block)[at : at + text_bytes]

    @staticmethod
    def build(rules: Iterable[Rule]) -> bytes:
        strictest: dict[bytes, int] = {}
        lengths: set[int] = set()
        for host, path, action in rules:
            if host:
                key = (host + path).encode()
                strictest[key] = max(strictest.get(key, 0), ACTIONS.index(action))
                lengths.add(len(path))
        ordered = sorted((xxhash.xxh64_intdigest(key), key) for key in strictest)
        texts = b"".join(key for _, key in ordered)
        head = np.array([len(ordered), len(lengths), len(texts)], np.uint64)
        digests = np.array([digest for digest, _ in ordered], np.uint64)
        offsets = np.cumsum([0, *(len(key) for _, key in ordered)]).astype(np.uint64)
        actions = np.array([strictest[key] for _, key in ordered], np.uint8)
        return b"".join(x.tobytes() for x in (head, digests, offsets, np.array(sorted(lengths), np.uint64), actions)) + texts

    @classmethod
    def mapped(cls, block: bytes) -> DigestArray:
        """Over an unlinked file of this worker: pages come in when searched."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The rule index of each key, or -1: binary search, then the stored string must match."""
        found = np.full(len(keys), -1)
        if not self.n or not keys:
            return found
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        for k in np.flatnonzero(self.digests[np.minimum(at, self.n - 1)] == wanted):
            i = int(at[k])
            while i < self.n and self.digests[i] == wanted[k]:
                if self.texts[int(self.offsets[i]) : int(self.offsets[i + 1])] == keys[k]:
                    found[k] = i
                    break
                i += 1
        return found

    def text(self, i: int) -> str:
        return bytes(self.texts[int(self.offsets[i]) : int(self.offsets[i + 1])]).decode()


def _probe_keys(host: str, path: str, lengths: list[int]) -> Iterator[bytes]:
    """host and its parent domains, each with every path prefix of a length that some rule has."""
    while host:
        for length in lengths:
            if length <= len(path):
                yield (host + path[:length]).encode()
        host = host.partition(".")[2]


_MAPPED: dict[int, DigestArray] = {}


def filter_urls(pages: DataFrame, rules: Iterable[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_broadcast_bytes: int = 256 << 20) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict.

    The longest fitting rule in characters decides; of equally long ones block before allow, then the greater string.
    """
    rules = list(rules)
    block = DigestArray.build(rules)
    parts = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if len(block) > max_broadcast_bytes:
        return join_rules(parts, pages.sparkSession.createDataFrame(rules, "host string, path string, action string"), id_col=id_col, default=default)
    shared = pages.sparkSession.sparkContext.broadcast(block)
    key = xxhash.xxh64_intdigest(block)

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judge(host: pa.Array, path: pa.Array) -> pa.Array:
        if key not in _MAPPED:
            _MAPPED.clear()
            _MAPPED[key] = DigestArray.mapped(shared.value)
        index = _MAPPED[key]
        keys, owner = [], []
        for row, (h, p) in enumerate(zip(host.to_pylist(), path.to_pylist())):
            for probe in _probe_keys(h, p, index.path_lengths):
                keys.append(probe)
                owner.append(row)
        best: list[int | None] = [None] * len(host)
        found = index.find(keys)
        size = lambda i: (len(index.text(i)), int(index.actions[i]), index.text(i))
        for k in np.flatnonzero(found >= 0):
            i, row = int(found[k]), owner[k]
            if best[row] is None or size(i) > size(best[row]):
                best[row] = i
        rule = [None if i is None else index.text(i) for i in best]
        verdict = [default if i is None else ACTIONS[index.actions[i]] for i in best]
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["rule", "verdict"])

    return parts.withColumn("judged", judge("host", "path")).select(id_col, "host", "path", F.col("judged.rule").alias("rule"), F.col("judged.verdict").alias("verdict"))


def join_rules(parts: DataFrame, rules: DataFrame, *, id_col: str, default: str) -> DataFrame:
    """The same verdicts by a shuffle join, for rule tables of any size. parts: id, host, path."""
    keyed = rules.where("host <> ''").groupBy(F.concat("host", "path").alias("rule")).agg(F.max("action").alias("action"), F.min(F.length("path")).alias("n"))
    lengths = [r.n for r in keyed.select("n").distinct().collect()]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    usable = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(usable, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    sites = parts.select("host", "path").distinct()
    best = sites.select("host", "path", F.explode(keys).alias("rule")).join(keyed, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "action", "rule")).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
