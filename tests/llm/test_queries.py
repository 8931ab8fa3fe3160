"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from glintfield.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, SF)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, want.fetchall())) == sorted(map(repr, map(tuple, got.select(*names).collect())))


def test_language_held_out_accuracy(spark):
    told = queries.QUERIES["op2_language_id"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = told[told.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.9


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settled(stage(spark, docs, SF))
        assert docs.columns == columns, name
        if name != "source_mixing":
            assert 0 < docs.count() <= before, name
            before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("bin_id").sum("piece_tokens").where("bin_id IS NOT NULL AND `sum(piece_tokens)` > 2048").isEmpty()
