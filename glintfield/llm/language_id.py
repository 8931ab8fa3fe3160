"""Language ID by compression: the language whose dictionary shrinks the text most.

Each language's raw-content dictionary is `dictionary_bytes` of sampled training text (about
`sample_rows` rows a language, a piece of at most `piece_chars` from each). The whole text, in
lower case with everything but letters turned into single spaces, is compressed with every
dictionary; the smallest size wins. The margin is how much larger the second size is, as a
share of the smallest; a text is rejected when its margin is below `min_margin`.

Defined cases: a text that is null or has no letter is `und`, score 0, rejected; with no training
rows every text is `und`; equal sizes go to the first language in order and are rejected;
repeated rows give repeated results; columns that clash with the output's are dropped.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintfield.llm.compression import dictionary_content, hashed_piece, hashed_sample, sizer

NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


class LanguageModel(NamedTuple):
    languages: list[str]
    dictionaries: list[bytes]
    #: Tells models apart in a worker's cache.
    key: int
    level: int = 6
    block: int = 2048
    #: Bits of size difference that halve a language's odds.
    bits_per_doubling: float = 16.0


def letters_of(text: str) -> str:
    """Lower case, everything but letters (Unicode category L) as single spaces."""
    plain = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not plain.replace(" ", "").isalpha():  # numerals that are no digits are word characters too
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    return plain


def fit_languages(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 400, piece_chars: int = 400, dictionary_bytes: int = 32_000, max_languages: int = 500) -> LanguageModel:
    """A dictionary per language, from a bounded sample of the rows whose language is not null."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample, counts = hashed_sample(rows, "lang", "id", sample_rows, max_languages)
    pieces: dict[str, list[str]] = {lang: [] for lang in sorted(counts)}
    each = sample.select("id", "lang", hashed_piece(F.col("text"), F.col("id"), piece_chars).alias("piece"))
    # An id that repeats is drawn once, so the sample stays bounded.
    drawn = each.groupBy("id", "lang").agg(F.min("piece").alias("piece")).select("lang", "piece", F.xxhash64("id").alias("h"))
    for r in sorted(drawn.collect(), key=lambda r: (r.h, r.piece)):
        pieces[r.lang].append(letters_of(r.piece))
    contents = {lang: dictionary_content([p for p in found if p], dictionary_bytes) for lang, found in pieces.items()}
    learned = [lang for lang, content in contents.items() if len(content) >= 8]
    dictionaries = [contents[lang] for lang in learned]
    return LanguageModel(learned, dictionaries, xxhash.xxh64_intdigest(b"\0".join(dictionaries)))


def judge(model: LanguageModel, text: str | None) -> tuple[str, float, float]:
    """(language, score, margin) of one whole text."""
    letters = letters_of(text or "")
    if not letters or not model.languages:
        return UNKNOWN, 0.0, 0.0
    sizes = sizer(model.key, model.dictionaries, model.level, model.block).sizes(letters.encode())
    best = int(np.argmin(sizes))
    odds = np.exp2(-8 * (sizes - sizes[best]) / model.bits_per_doubling)
    rest = np.delete(sizes, best)
    return model.languages[best], float(1 / odds.sum()), float((rest.min() - sizes[best]) / sizes[best]) if len(rest) else 1.0


def identify_languages(df: DataFrame, model: LanguageModel, *, text_col: str = "text", min_margin: float = 0.01) -> DataFrame:
    """df with lang_pred, score, margin and rejected."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, margin: double>")
    def predict(texts: pa.Array) -> pa.Array:
        told = [judge(shared.value, x.as_py()) for x in texts]
        columns = list(zip(*told)) if told else [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], ["lang_pred", "score", "margin"])

    rest = df.drop("lang_pred", "score", "margin", "rejected")
    told = rest.select(F.struct("*").alias("row"), predict(F.col(text_col)).alias("told"))
    unsure = (F.col("told.lang_pred") == UNKNOWN) | (F.col("told.margin") < min_margin)
    return told.select("row.*", "told.*", unsure.alias("rejected"))
