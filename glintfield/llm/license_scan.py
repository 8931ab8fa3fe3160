"""License scans in DataFrame functions alone: MinHash bands over text windows, then exact containment.

Texts and templates are words in lower case, without anything but letters and digits, and each
shingle is `WIDTH` consecutive words. A document's windows hold SHINGLES shingles and start every
STRIDE words, so that every shingle is in two windows; a template's windows start at every word.
A window has BANDS MinHash values (a band is one value): the smallest of its shingles' hashes after
XOR with the band's own mask. A window and a template that share a band value are a candidate; the masks
are random, so values of different bands do not meet.

A window of 4 shingles with only one of the template's agrees in a given band with a
probability of about 1/4, so 24 bands find it with 99.9 %, and each shingle has two windows; a
window that lies within the template agrees in all bands. Each candidate names the word where the
template would begin; the template's shingles found from there (with a slack of a fifth of its
length on both sides) are counted exactly, and a share of at least `containment` is a match. Overlapping
matches of one template in one document count once, the best first. Of the matches that begin at one word
only the longest stay, so that a tag is not also found as the shorter tag that it begins with.

A template under WIDTH words is one shorter shingle and matches only word by word: its places are the
words that are some short template's first, and the words behind must be the template's.

Broadcast are tables of the templates, of which `max_templates` is checked, and the bare ids of the
documents with candidates while they are at most `broadcast_rows`, to sift the texts. Texts meet their
candidate places in a shuffle join: a document's places travel in one row, in proportion to its own words.

Defined cases: null and empty texts have no match; texts under WIDTH words can only hold templates under
WIDTH words, and templates without words match nothing; rows that repeat an id are one document each with equal matches, given once; an empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintfield.llm.common import settled
from glintfield.llm.license_texts import TEMPLATES

WIDTH, SHINGLES, STRIDE, BANDS = 5, 4, 2, 24

def templates(spark: SparkSession, notices: list[tuple[str, str]] = TEMPLATES, max_templates: int = 20_000) -> DataFrame:
    if len(notices) > max_templates:
        raise ValueError(f"{len(notices)} templates; max_templates is {max_templates}")
    return spark.createDataFrame(notices, "template_id string, text string")


def word_hashes(text: Column) -> Column:
    """Hashes of the normalised words of the whole text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.transform(F.split(F.nullif(plain, F.lit("")), " "), lambda w: F.xxhash64(w))


def shingle(words: Column, at: Column) -> Column:
    """Hash of the shingle that begins at word `at` of an array; null beyond its end."""
    return F.when(F.size(words) >= at + WIDTH, F.xxhash64(*(F.get(words, at + k) for k in range(WIDTH))))


def windows(rows: DataFrame, stride: int) -> DataFrame:
    """rows(key, words) as (key, at, shingles s0..): one row a window, none for texts without a shingle."""
    last = F.size("words") - WIDTH
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride)))
    cut = F.transform(starts, lambda i: F.slice("words", i + 1, WIDTH + SHINGLES - 1))
    return rows.select("key", F.posexplode(cut).alias("k", "w")).select("key", (F.col("k") * stride).alias("at"), *(shingle(F.col("w"), F.lit(k)).alias(f"s{k}") for k in range(SHINGLES)))


def band_values() -> list[Column]:
    """The MinHash value of each band; the masks are hashes of the bands' numbers."""
    masks = [F.xxhash64(F.lit(f"band {b}")) for b in range(BANDS)]
    return [F.least(*(F.col(f"s{k}").bitwiseXOR(mask) for k in range(SHINGLES))) for mask in masks]


def find_licenses(df: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Per match: id, template_id, start_word, end_word (of the region), matched, shingles, containment."""
    hashed = known.select(F.col("template_id").alias("key"), word_hashes(F.col("text")).alias("words"))
    shapes = F.broadcast(hashed.where(F.size("words") >= WIDTH))
    pieces = shapes.select("key", F.size("words").alias("length"), F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - WIDTH), lambda i: shingle(F.col("words"), i))).alias("pool"))
    values = F.explode(F.array(*band_values())).alias("value")
    table = windows(shapes, 1).select(F.col("key").alias("template_id"), F.col("at").alias("offset"), values).distinct()
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), word_hashes(F.col(text_col)).alias("words"))
    met = windows(texts, STRIDE).select("key", "at", values).join(F.broadcast(table), "value")
    places = met.select("key", "template_id", (F.col("at") - F.col("offset")).alias("begin")).distinct()

    # Exact containment, in the documents that have candidates.
    asked = settled(places.groupBy("key").agg(F.collect_set(F.struct("template_id", "begin")).alias("asked")))
    whole = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    if asked.count() <= broadcast_rows:
        whole = whole.join(F.broadcast(asked.select("key")), "key", "left_semi")  # only their texts are shuffled
    whole = whole.join(asked.hint("merge"), "key")
    near = whole.select("key", word_hashes(F.col("text")).alias("words"), "asked").select("key", "words", F.explode("asked").alias("a")).select("key", "words", "a.*").join(F.broadcast(pieces.withColumnRenamed("key", "template_id")), "template_id")
    slack = F.ceil(F.col("length") * 0.2).cast("int")
    first = F.greatest(F.col("begin") - slack, F.lit(0))
    past = F.least(F.col("begin") + F.col("length") + slack, F.size("words"))
    region = F.slice("words", first + 1, F.greatest(past - first, F.lit(0)))
    own = F.transform(F.sequence(F.lit(0), F.size("region") - WIDTH), lambda i: shingle(F.col("region"), i))
    seen = near.select("key", "template_id", "length", "pool", first.alias("first"), region.alias("region")).where(F.size("region") >= WIDTH).withColumn("own", own)
    places = F.filter(F.transform("own", lambda x, i: F.when(F.array_contains("pool", x), F.col("first") + i)), lambda i: i.isNotNull())
    counted = seen.select("key", "template_id", "length", F.size("pool").alias("shingles"), F.size(F.array_intersect("pool", "own")).alias("both"), F.array_min(places).alias("begin"), (F.array_max(places) + WIDTH).alias("end"))
    scored = counted.withColumn("share", F.col("both") / F.col("shingles")).where(F.col("share") >= containment).distinct()

    # Matches of one template that overlap are one: runs of places nearer than its length.
    order = Window.partitionBy("key", "template_id").orderBy("begin")
    apart = F.coalesce(F.col("begin") - F.lag("begin").over(order) >= F.col("length"), F.lit(True))
    runs = scored.withColumn("run", F.sum(apart.cast("int")).over(order))
    best = runs.groupBy("key", "template_id", "run").agg(F.max_by(F.struct("begin", "end", "both", "shingles", "share"), F.struct("share", -F.col("end"), "begin")).alias("m"))
    long = best.select(F.col("key").alias(id_col), "template_id", F.col("m.begin").alias("start_word"), F.col("m.end").alias("end_word"), F.col("m.both").alias("matched"), F.col("m.shingles").alias("shingles"), F.col("m.share").alias("containment"))
    found = long.unionByName(_short_matches(texts, hashed.where(F.size("words").between(1, WIDTH - 1)), id_col))
    furthest = F.max("end_word").over(Window.partitionBy(id_col, "start_word"))
    return found.withColumn("_furthest", furthest).where("end_word = _furthest").drop("_furthest")


def _short_matches(texts: DataFrame, short: DataFrame, id_col: str) -> DataFrame:
    """Matches of templates under WIDTH words: texts(key, words) and short(key, words) hold word hashes."""
    heads = [r.head for r in short.select(F.get("words", 0).alias("head")).distinct().collect()]  # at most max_templates
    known = F.array(*(F.lit(h) for h in heads)) if heads else F.array().cast("array<bigint>")
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(known, F.get("words", i)))
    met = texts.where(F.arrays_overlap("words", known)).select("key", "words", F.explode(starts).alias("at"))
    around = met.select("key", "at", F.slice("words", F.col("at") + 1, WIDTH - 1).alias("here"), F.get("words", F.col("at")).alias("head"))
    rules = F.broadcast(short.select(F.col("key").alias("template_id"), F.col("words").alias("pattern"), F.get("words", 0).alias("head")))
    same = around.join(rules, "head").where(F.slice("here", F.lit(1), F.size("pattern")) == F.col("pattern"))
    one = F.lit(1)
    return same.select(F.col("key").alias(id_col), "template_id", F.col("at").alias("start_word"), (F.col("at") + F.size("pattern")).alias("end_word"), one.alias("matched"), one.alias("shingles"), F.lit(1.0).alias("containment")).distinct()
