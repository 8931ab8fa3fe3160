"""A training corpus from raw documents, in five stages.

Every stage but the last returns the columns of documents:

1. language_id drops documents whose language is unclear (no letters, or a margin below 1 %).
2. near_dedup keeps one document, that of the smallest id, of each near-duplicate class.
3. substring_dedup cuts passages of 50 words or more that an earlier document has; n_chars follows.
4. source_mixing repeats documents (or leaves some out) so that the expected token shares of the
   labelled domains meet TARGETS. Clean documents' rates are 1 or more while their target share is at
   least their share of the input.
5. packing puts the documents into bins of 2048 words and returns a row for each piece.

Defined cases: a document with a null or empty text goes in stage 1 (no letters); rows with a null id pass
stages 2 and 3 unchanged, are repeated by stage 4 like any other and packed with a null id; rows that
repeat an id are one document in stage 2 (one of them stays if it is kept); empty tables give empty
results; further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintfield.llm import queries as q
from glintfield.llm.common import discard, settled, text_batches
from glintfield.llm.language_id import fit_languages, identify_languages
from glintfield.llm.near_dedup import keep_one_of_each
from glintfield.llm.packing import pack
from glintfield.llm.source_mixing import domain_posteriors, fit_domains, mix_to_targets
from glintfield.llm.substring_dedup import remove_repeated_passages


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as one struct: no result of an operator can meet a column of docs."""
    return docs.select("doc_id", "text", F.struct("*").alias("docs_row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = identify_languages(_boxed(docs), fit_languages(docs))
    return told.where("NOT rejected").select("docs_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = docs.columns.copy()
    others.remove("text")
    boxed = docs.select("doc_id", "text", F.struct(*others).alias("docs_row"))
    cut = remove_repeated_passages(boxed, keep=["docs_row"], rejoin=False)
    whole = {"text": F.col("kept_text")}
    if "n_chars" in others:
        whole["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(whole.get(c, F.col("docs_row")[c]).alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_domains(docs, q.domain_labels(spark, sf_dir))
    with text_batches(spark):
        members = settled(domain_posteriors(_boxed(docs), model).drop("text"))
    mixed = mix_to_targets(members, model.domains, q.MIX_TARGETS)
    times = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return mixed.where("copies > 0").select("docs_row", times.alias("nth")).select("docs_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(q.to_pack(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("source_mixing", source_mixing), ("packing", packing)]

#: Two stages learn and one solves iteratively: not SQL. tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each from the files of the one before."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settled(docs)
            if before is not None:
                discard(before)  # nothing reads the stage before the last one any more
            before = docs
    return docs
