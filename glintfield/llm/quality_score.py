"""Quality score by compression: does text shrink more with the good or the bad dictionary?

Two raw-content dictionaries hold sampled text labelled good and bad. A whole text is compressed
with both; the size difference as a share of the two sizes together is the raw score, drawn
towards the labelled average as if `prior_bytes` of average text stood beside it (which only short
texts feel), and a one-dimensional logistic curve, fitted on labelled rows that are in neither dictionary, turns it
into a probability.

Learning uses a bounded sample: about `sample_rows` labelled rows a class, half of them for the
dictionaries (a piece of at most `piece_chars` each, `dictionary_bytes` in all) and half, whole,
for calibration. Calibration weighs the classes by how often they are labelled.

Defined cases: null and empty texts get the average raw score and the curve's value there; without both
classes to learn from every score is the share of good labels (0.5 with no labels); repeated
rows give repeated results; columns that clash with the output's are dropped.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintfield.llm.compression import dictionary_content, hashed_piece, hashed_sample, sizer


class QualityModel(NamedTuple):
    good: bytes
    bad: bytes
    #: Tells models apart in a worker's cache.
    key: int
    average: float = 0.0
    slope: float = 0.0
    offset: float = 0.0
    prior_bytes: int = 40
    level: int = 6
    #: Short blocks, so that what a text repeats counts as seen from the dictionaries.
    block: int = 128

    def sizes(self, text: str | None) -> tuple[float, float]:
        """Compressed bytes of the whole text with the good and the bad dictionary."""
        data = (text or "").encode()
        if not data or len(self.good) < 8 or len(self.bad) < 8:
            return 0.0, 0.0
        return tuple(sizer(self.key, [self.good, self.bad], self.level, self.block).sizes(data).tolist())


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton steps."""
    design = np.stack([x, np.ones_like(x)], 1)
    scale = np.array([max(np.abs(x).max(initial=0.0), 1e-9), 1.0])
    design, beta = design / scale, np.zeros(2)
    weight = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * beta
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), gradient)
        beta = beta - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale[0]), float(beta[1])


def _sizes(df: DataFrame, model: QualityModel, text_col: str):
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<good: double, bad: double>")
    def sizes(texts: pa.Array) -> pa.Array:
        both = np.array([shared.value.sizes(x.as_py()) for x in texts], float).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["good", "bad"])

    return sizes(F.col(text_col))


def fit_quality(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 3000, piece_chars: int = 300, dictionary_bytes: int = 100_000) -> QualityModel:
    """labels: id_col and label_col (1 good, 0 bad) of the rows that may be learned from."""
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample, counts = hashed_sample(marked, "label", "id", sample_rows)
    chosen = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    # An id that repeats is learned from once, so what reaches the driver stays bounded.
    chosen = chosen.groupBy("id", "label").agg(F.min("text").alias("text"))
    h = F.xxhash64("id", F.lit("use"))
    drawn = chosen.where(F.pmod(h, F.lit(2)) == 0).select("label", h.alias("h"), hashed_piece(F.col("text"), F.col("id"), piece_chars).alias("piece")).collect()
    drawn.sort(key=lambda r: (r.h, r.piece))
    bad, good = (dictionary_content([r.piece for r in drawn if r.label == k], dictionary_bytes) for k in (0, 1))
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    flat = QualityModel(good, bad, xxhash.xxh64_intdigest(good + b"\0" + bad), offset=float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    if len(good) < 8 or len(bad) < 8:
        return flat
    held = chosen.where(F.pmod(h, F.lit(2)) == 1).select("label", _sizes(chosen, flat, "text").alias("s")).select("label", "s.*").collect()
    y, g, b = (np.array([r[k] for r in held], float) for k in range(3))
    if not 0 < y.sum() < len(y):
        return flat
    weight = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    average = float(weight @ ((b - g) / np.maximum(b + g, 1)))
    raw = (b - g + average * flat.prior_bytes) / (b + g + flat.prior_bytes)
    slope, offset = fit_curve(raw, y, weight)
    return flat._replace(average=average, slope=slope, offset=offset)


def score_quality(df: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """df with raw_score, score (0 to 1) and predicted (1 if score >= threshold)."""
    rest = df.drop("raw_score", "score", "predicted")
    told = rest.select(F.struct("*").alias("row"), _sizes(rest, model, text_col).alias("s"))
    raw = (F.col("s.bad") - F.col("s.good") + model.average * model.prior_bytes) / (F.col("s.bad") + F.col("s.good") + model.prior_bytes)
    score = 1 / (1 + F.exp(-(F.col("raw_score") * model.slope + model.offset)))
    return told.select("row.*", raw.alias("raw_score")).select("*", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
