"""STAC catalogues as tables: links, collections and items from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintfield.operators.catalog import filled, id_from_href, resolve_url

LINK = "rel string, href string, title string, id string, type string"
ASSET = "struct<href: string, title: string, type: string>"
NODE_SCHEMA = f"id string, title string, links array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in LINK.split(', ')))}>>"
ITEM_SCHEMA = f"id string, collection string, bbox array<double>, geometry string, properties struct<datetime: string>, assets map<string, {ASSET}>"


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Catalogues or collections: (url, id, title, links)."""
    return spark.read.schema(NODE_SCHEMA).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("url"), "*")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM_SCHEMA).option("multiLine", True).json(path)


def links(nodes: DataFrame, rels: tuple[str, ...] = ()) -> DataFrame:
    """(url, href, target, label) of the links of some relations (all if none is named); links without href are dropped."""
    wanted = F.filter("links", lambda x: x["rel"].isin(*rels)) if rels else F.col("links")
    found = nodes.select("url", F.inline(wanted)).where("href IS NOT NULL")
    placed = found.withColumn("target", resolve_url(F.col("url"), F.col("href")))
    return placed.select("url", "rel", "href", "target", F.coalesce(filled(F.col("title")), filled(F.col("id")), id_from_href(F.col("target"))).alias("label"))


def tree(catalogs: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection, item label, item url): the two levels below a catalogue."""
    below = links(catalogs, ("child", "collection")).select(F.col("target").alias("url"), F.col("label").alias("collection")).distinct()
    items = links(collections, ("item",)).select("url", F.col("label").alias("item"), F.col("target").alias("item_url"))
    return below.join(items, "url").select("collection", "item", "item_url")
