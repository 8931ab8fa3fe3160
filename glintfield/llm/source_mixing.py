"""Mixing to target weights: soft domain posteriors, then nonnegative document rates.

A softmax classifier, fitted on a bounded sample of a labelled table (about `sample_rows` rows a
domain, a piece of at most `piece_chars` of each), gives every whole document its domain
posteriors p. Rates r >= 0 then minimise half the squared distance between the expected domain token
shares, sum over documents of r * tokens * p / all tokens, and the target shares, by
projected gradient steps (with momentum, begun anew where the distance grows) from r = 1. A step needs only
the shares' residual, one number a domain; Spark sums it over all documents in each round. A document's rate
follows from its last settled state and the residuals since; every `settle_rounds` rounds the states are settled again.

Residuals are weighed by the inverse of the documents' K x K second moments of p, so domains that p hardly tells
apart take few rounds; where the targets are in reach the answer is the same. They are out of reach if a
direction v has v.p <= 0 for all documents but v.target > 0; from each round's residual Spark finds the largest
v.p, and with it a lower bound on the distance that any rates leave. Once that bound is above `tolerance`, the rounds go on
unweighted, until the distance is within `still` of the bound or no longer shrinks by that share in `settle_rounds` rounds.
`gap` is the largest difference of a share from its target in the end, `converged` whether it is within
`tolerance`; only targets that are proven out of reach come without it, everything else within `most_rounds` is an error.

Features of a text: how often it uses the `vocabulary` words that tell the sample's domains apart
best, and shares of word shapes (upper case, digits, symbols, repeated words).

`copies` turns a rate into whole copies, by a hash of the id: the floor of the rate, and one more with
the rest as its probability.

Defined cases: null and empty texts have no tokens, the average posteriors and a rate like any
other; without labels there is one domain and every rate is 1; targets of domains that were not
learned are dropped and the others scaled to sum to 1; repeated rows get equal rates; columns that
clash with the output's are dropped.
"""

from __future__ import annotations

import re
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintfield.llm.common import discard, settled
from glintfield.llm.compression import hashed_piece, hashed_sample

SHAPES = 5  # lower case, capitalised or mixed, upper case, with digits, without cased letters or digits
DIGIT = re.compile(rb"[0-9]")


class DomainModel(NamedTuple):
    domains: list[str]
    words: list[bytes]
    weights: np.ndarray
    key: int


def _bare(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()|-").lower()


def _shape(word: bytes) -> int:
    if DIGIT.search(word):
        return 3
    text = word.decode(errors="replace")
    if text.islower():
        return 0
    if text.isupper():
        return 2 if sum(map(str.isalpha, text)) > 1 else 1
    return 1 if text.lower() != text else 4


class WordFeatures(dict):
    """word -> its vocabulary place and shape in one number, remembered for `most` words."""

    def __init__(self, words: list[bytes], most: int = 50_000):
        super().__init__()
        self.places, self.most = {w: k for k, w in enumerate(words)}, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.places.get(_bare(word), len(self.places)) * SHAPES + _shape(word)
        return value

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words; log rates of the vocabulary, shape shares, share of repeated words, 1."""
        words = (text or "").encode().split()
        n = len(words)
        codes = np.fromiter(map(self.__getitem__, words), np.int64, n)
        counts = np.bincount(codes // SHAPES, minlength=len(self.places) + 1)[:-1] if n else np.zeros(len(self.places))
        shapes = np.bincount(codes % SHAPES, minlength=SHAPES) if n else np.zeros(SHAPES)
        again = sum(map(eq, words, words[1:]))
        return n, np.concatenate([np.log1p(1000 * counts / max(n, 1)) / 4, shapes / max(n, 1), [again / max(n, 1), 1.0]])


def _choose_words(pieces: list[tuple[str, str]], vocabulary: int) -> list[bytes]:
    """The words whose document frequencies differ most between one domain and the others."""
    totals: dict[str, int] = {}
    seen: dict[bytes, dict[str, int]] = {}
    for domain, text in pieces:
        totals[domain] = totals.get(domain, 0) + 1
        for word in {_bare(w) for w in text.encode().split()}:
            by = seen.setdefault(word, {})
            by[domain] = by.get(domain, 0) + 1

    def spread(by: dict[str, int]) -> float:
        rates = [by.get(d, 0) / n for d, n in totals.items()]
        return max(rates) - sorted(rates)[-2] if len(rates) > 1 else 0.0

    return sorted((w for w in seen if w), key=lambda w: (-spread(seen[w]), w))[:vocabulary]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fit_domains(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample_rows: int = 1500, piece_chars: int = 2000, vocabulary: int = 300, steps: int = 300, max_domains: int = 100) -> DomainModel:
    """A softmax classifier of labels' domains (at most `max_domains`), weighted so that the sample has the labels' class shares."""
    marked = labels.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(domain_col).alias("domain"))
    sample, counts = hashed_sample(marked, "domain", "id", sample_rows, max_domains)
    texts = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), hashed_piece(F.col(text_col), F.col(id_col), piece_chars).alias("piece"))
    # An id that repeats is drawn once, so the sample stays bounded.
    once = texts.join(F.broadcast(sample), "id").groupBy("id", "domain").agg(F.min("piece").alias("piece"))
    drawn = sorted((r.domain, r.piece) for r in once.select("domain", "piece").collect())
    domains = sorted({d for d, _ in drawn}) or ["all"]
    words = _choose_words(drawn, vocabulary)
    features = WordFeatures(words)
    weights = np.zeros((len(words) + SHAPES + 2, len(domains)))
    if len(domains) > 1:
        x = np.stack([features.of(text)[1] for _, text in drawn])
        y = np.eye(len(domains))[[domains.index(d) for d, _ in drawn]]
        share = (y * (np.array([counts[d] for d in domains]) / y.sum(0))).sum(1)
        share = (share / share.sum())[:, None]
        velocity = np.zeros_like(weights)
        rate = 1 / (0.5 * np.linalg.norm(x * np.sqrt(share), 2) ** 2 + 1e-4)
        for step in range(steps):
            ahead = weights + step / (step + 3) * velocity
            moved = ahead - rate * (x.T @ (share * (_softmax(x @ ahead) - y)) + 1e-4 * ahead)
            velocity, weights = moved - weights, moved
    return DomainModel(domains, words, weights, xxhash.xxh64_intdigest(weights.tobytes()))


_FEATURES: dict[int, WordFeatures] = {}


def domain_posteriors(df: DataFrame, model: DomainModel, *, text_col: str = "text") -> DataFrame:
    """df with n_tokens and posteriors (in the order of model.domains)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<n: bigint, p: array<double>>")
    def member(texts: pa.Array) -> pa.Array:
        m = shared.value
        if m.key not in _FEATURES:
            _FEATURES.clear()
            _FEATURES[m.key] = WordFeatures(m.words)
        found = [_FEATURES[m.key].of(x.as_py()) for x in texts]
        p = _softmax(np.stack([f for _, f in found]) @ m.weights) if found else np.empty((0, 1))
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], ["n", "p"])

    rest = df.drop("n_tokens", "posteriors")
    return rest.select(F.struct("*").alias("row"), member(F.col(text_col)).alias("m")).select("row.*", F.col("m.n").alias("n_tokens"), F.col("m.p").alias("posteriors"))


def follow(p: np.ndarray, rounds: list[tuple[float, np.ndarray]], rate: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the rounds, and those of the round before. rounds: (momentum, step for a posterior at the point ahead)."""
    for momentum, step in rounds:
        ahead = rate + momentum * (rate - before)
        before, rate = rate, np.maximum(0.0, ahead - p @ step)
    return rate, before


def _matrix(posteriors: pa.Array, k: int) -> np.ndarray:
    return np.asarray(posteriors.flatten(), float).reshape(-1, k)


def lower_bound(direction: np.ndarray, most: float, goal: np.ndarray) -> float:
    """The distance from goal that no rates can get under, if direction.p is at most `most` for all documents.

    Posteriors sum to 1, so direction - most has a product of 0 or less with each of them.
    """
    tilted = direction - max(most, 0.0)
    size = np.linalg.norm(tilted)
    return float(tilted @ goal / size) if size > 0 else 0.0


def mix_to_targets(members: DataFrame, domains: list[str], targets: dict[str, float], *, id_col: str = "doc_id", tolerance: float = 1e-4, still: float = 0.02, settle_rounds: int = 16, most_rounds: int = 400) -> DataFrame:
    """members (id_col, n_tokens, posteriors, ...) with rate, copies, gap and converged."""
    rest = members.drop("rate", "copies", "gap", "converged")
    k = len(domains)
    goal = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    goal = goal / goal.sum() if goal.sum() > 0 else np.full(k, 1 / k)
    states = settled(rest.select("n_tokens", "posteriors", F.lit(1.0).alias("rate"), F.lit(1.0).alias("before")))
    pairs = [F.sum(F.col("n_tokens") * F.col("posteriors")[i] * F.col("posteriors")[j]) for i in range(k) for j in range(k)]
    total, *gram = states.agg(F.sum("n_tokens"), *pairs).first()
    rounds: list[tuple[float, np.ndarray]] = []
    gap, recent, begun, bound, last = 0.0, 0, 0, 0.0, np.inf
    directions, plain = np.zeros((2, k)), []
    done = not total or k == 1
    if not done:
        second = np.array(gram, float).reshape(k, k) / total
        weighed, unweighed = np.linalg.inv(second + 1e-9 * np.trace(second) / k * np.eye(k)), np.eye(k) / np.linalg.norm(second, 2)
    while not done:
        if len(rounds) == most_rounds:
            raise RuntimeError(f"token shares are {gap:.2g} off their targets after {most_rounds} rounds")
        momentum = (len(rounds) - begun) / (len(rounds) - begun + 3)
        shares, most = _expected(states, rounds[recent:], momentum, directions)
        residual = shares / total - goal
        if len(rounds):
            bound = max([bound, *(lower_bound(d, m, goal) for d, m in zip(directions, most))])
        metric = unweighed if bound > tolerance else weighed
        gap, away = float(np.abs(residual).max()), float(np.linalg.norm(residual))
        directions = np.stack([-residual / max(away, 1e-300), -weighed @ residual])
        rounds.append((momentum, metric @ residual))
        distance = float(residual @ metric @ residual)
        if bound > tolerance:
            plain.append(away)
        if distance > last or len(plain) == 1:
            begun = len(rounds)
        last = distance if len(plain) != 1 else np.inf
        near = gap < tolerance / 2
        halted = bool(plain) and (away <= (1 + still) * bound + tolerance or len(plain) > settle_rounds and min(plain[-settle_rounds:]) > (1 - still) * min(plain[:-settle_rounds]))
        if near or halted:
            # The rates themselves, not the point ahead.
            gap = float(np.abs(_expected(states, rounds[recent:], 0.0, directions)[0] / total - goal).max())
            done = halted or gap < tolerance
        if len(rounds) - recent == settle_rounds and not done:
            old, states = states, _settle(states, rounds[recent:])
            discard(old)
            recent = len(rounds)
    discard(states)

    @F.arrow_udf("double")
    def final_rate(posteriors: pa.Array) -> pa.Array:
        ones = np.ones(len(posteriors))
        return pa.array(follow(_matrix(posteriors, k), rounds, ones, ones)[0])

    rated = rest.withColumn("rate", final_rate("posteriors"))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return rated.withColumns({"copies": copies, "gap": F.lit(gap), "converged": F.lit(gap < tolerance)})


def _settle(states: DataFrame, rounds: list) -> DataFrame:
    """The states after the rounds."""

    @F.arrow_udf("struct<rate: double, before: double>")
    def moved(posteriors: pa.Array, rate: pa.Array, before: pa.Array) -> pa.Array:
        p = _matrix(posteriors, len(rounds[0][1]))
        now, then = follow(p, rounds, *(np.asarray(x, float) for x in (rate, before)))
        return pa.StructArray.from_arrays([pa.array(now), pa.array(then)], ["rate", "before"])

    return settled(states.select("n_tokens", "posteriors", moved("posteriors", "rate", "before").alias("m")).select("n_tokens", "posteriors", "m.*"))


def _expected(states: DataFrame, rounds: list, momentum: float, directions: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Expected tokens of each domain at the point ahead, and each direction's largest product with a posterior.

    Partial sums and maxima a batch, combined by Spark.
    """
    k = directions.shape[1]

    def partial(batches):
        for batch in batches:
            n, rate, before = (np.asarray(batch.column(i), float) for i in (0, 2, 3))
            p = _matrix(batch.column(1), k)
            rate, before = follow(p, rounds, rate, before)
            sums = (n * (rate + momentum * (rate - before))) @ p
            most = (p[n > 0] @ directions.T).max(0, initial=-1e300)
            yield pa.record_batch([pa.array([x]) for x in (*sums, *most)], names=names)

    names = [f"s{i}" for i in range(k)] + [f"m{i}" for i in range(len(directions))]
    found = states.mapInArrow(partial, ", ".join(f"{x} double" for x in names))
    row = found.agg(*(F.sum(f"s{i}") for i in range(k)), *(F.max(f"m{i}") for i in range(len(directions)))).first()
    return np.array([x or 0.0 for x in row[:k]]), [x if x is not None else 0.0 for x in row[k:]]
