"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintfield.llm.common import WORD_GAP, documents, id_residue, settled, text_batches
from glintfield.llm.disclosure import KINDS, find_personal_data
from glintfield.llm.language_id import fit_languages, identify_languages
from glintfield.llm.media_columns import store_as_media
from glintfield.llm.license_scan import find_licenses, templates
from glintfield.llm.merkle_manifest import merkle_manifest
from glintfield.llm.near_dedup import near_duplicate_classes
from glintfield.llm.packing import pack
from glintfield.llm.prefix_trie import conversation_turns, prefix_trie
from glintfield.llm.quality_score import fit_quality, score_quality
from glintfield.llm.source_mixing import domain_posteriors, fit_domains, mix_to_targets
from glintfield.llm.sql_twins import PREFIX_TRIE_SQL, merkle_sql
from glintfield.llm.substring_dedup import remove_repeated_passages
from glintfield.llm.topk_search import exact_top_k, integer_vector
from glintfield.llm.url_filters import Rule, filter_urls

#: The contract's rules.
URL_RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]


def op1_substring_dedup(spark, sf_dir):
    cut = remove_repeated_passages(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_language_id(spark, sf_dir):
    rows = documents(spark, sf_dir)
    held_out = id_residue(F.col("doc_id"), 3) == 1
    model = fit_languages(rows.where(~held_out))
    told = identify_languages(rows.select("doc_id", "text"), model)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


#: Shares of the tokens that each labelled domain shall have.
MIX_TARGETS = {"good": 0.94, "low": 0.03, "toxic": 0.03}


def domain_labels(spark, sf_dir):
    """labels as domains: toxic, else good or low."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", domain.alias("domain"))


def op3_source_mixing(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_domains(rows, domain_labels(spark, sf_dir))
    with text_batches(spark):
        members = settled(domain_posteriors(rows, model).drop("text"))
    return mix_to_targets(members, model.domains, MIX_TARGETS)


def to_pack(rows):
    """What packing needs of documents: words, source, and a cluster for each distinct content."""
    words = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), WORD_GAP, " ")
    return rows.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).alias("n_tokens"), F.xxhash64(words).alias("cluster"))


def op6_best_fit_packing(spark, sf_dir):
    return pack(to_pack(documents(spark, sf_dir)))


def op4_topk_search(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", integer_vector(F.col("embedding")).alias("vector"))
    return exact_top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op5_quality_classifier(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text")
    held_out = id_residue(F.col("doc_id"), 4) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(rows, labels.where(~held_out))
    return score_quality(rows, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "raw_score")


def op7_url_filters(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op8_media_columns(spark, sf_dir):
    return store_as_media(documents(spark, sf_dir))


def op9_near_dedup(spark, sf_dir):
    return near_duplicate_classes(documents(spark, sf_dir))


def op10_license_scan(spark, sf_dir):
    return find_licenses(documents(spark, sf_dir), templates(spark))


#: What the contract's tampering does to a text.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark, sf_dir):
    tampered = F.when(id_residue(F.col("doc_id"), 3) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return merkle_manifest(documents(spark, sf_dir), found={"text": tampered})


def op12_pii(spark, sf_dir):
    found = find_personal_data(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    place = lambda kind, s: F.concat_ws(":", kind, s["start"], s["end"])
    base, terms = F.transform("spans", lambda s: place(s["kind"], s)), F.transform("terms", lambda t: place(F.lit("term"), t))
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))


def rebuilt(convs):
    """The contract's conversations: the first h turns of the one whose id is the multiple of 20 at or below, then the own ones after h."""
    h = id_residue(F.col("conv_id"), 4).cast("int")
    heads = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    led = convs.join(heads, F.expr("conv_id - pmod(conv_id, 20)") == F.col("base"), "left")
    begun = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return led.select("conv_id", F.concat(begun, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def op13_prefix_trie(spark, sf_dir):
    turns = settled(conversation_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(rebuilt(turns))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op3_source_mixing": op3_source_mixing,
    "op4_topk_search": op4_topk_search,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filters": op7_url_filters,
    "op8_media_columns": op8_media_columns,
    "op9_near_dedup": op9_near_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_pii": op12_pii,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op11_merkle_manifest": merkle_sql(),
    "op13_prefix_trie": PREFIX_TRIE_SQL,
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER f AS t, count(*) OVER f AS n FROM pos
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
firsts AS (SELECT t, min(doc_id) AS first FROM win WHERE n = 50 GROUP BY t),
again AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (t) WHERE n = 50 AND first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM again),
kept AS (
  SELECT pos.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY pos.i) FILTER (gone.i IS NULL) AS kept
  FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.i = pos.i GROUP BY pos.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
pos AS (SELECT doc_id, len(ws) AS m, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (
  SELECT doc_id, m, i, string_agg(word, ' ') OVER f AS t, count(*) OVER f AS n FROM pos
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sh AS (SELECT DISTINCT doc_id, t FROM win WHERE n = 5 OR (m < 5 AND i = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT w.doc_id, least(w.doc_id, coalesce(min(other), w.doc_id)) AS class_id, coalesce(max(n), 0) AS n_shingles
FROM w LEFT JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY w.doc_id""",
    "op4_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= 5""",
    "op7_url_filters": """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'org/es/', 'example.net/de/8') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""",
}
