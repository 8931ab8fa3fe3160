"""Readers and streams over small files."""

import json

import pytest
from pyspark.sql import functions as F

from glintfield.operators import batch, catalog
from glintfield.sources import areas, catalogs, scenes
from glintfield.streaming.items import events_per_window, item_stream


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text("<kml><Polygon><coordinates>\n117.7,38.9,0 117.8,38.95 117.75,39.0\n</coordinates></Polygon></kml>")
    (tmp_path / "b.kml").write_text("<kml/>")
    got = [tuple(r)[1:] for r in areas.kml_extents(spark, str(tmp_path)).collect()]
    assert got == [(117.7, 38.9, 117.8, 39.0)]


def test_kml_with_namespaces_attributes_and_rings(spark, tmp_path):
    ring = "<g:coordinates a='1'>1,2,0\n 3,4 x,9 5 2,8,1</g:coordinates>"
    (tmp_path / "c.kml").write_text(f"<g:kml xmlns:g='u'><g:Placemark id='p'><g:Polygon>{ring}</g:Polygon></g:Placemark><g:Placemark><g:coordinates/><g:coordinates> </g:coordinates>{ring.replace('1,2,0', '-7,2')}</g:Placemark></g:kml>")
    rings = areas.kml_files(spark, str(tmp_path))
    assert sorted(tuple(p) for r in rings.collect() for p in r.points) == [(-7.0, 2.0), (1.0, 2.0), (2.0, 8.0), (2.0, 8.0), (3.0, 4.0), (3.0, 4.0)] and rings.count() == 2
    assert [tuple(r)[1:] for r in areas.kml_extents(spark, str(tmp_path)).collect()] == [(-7.0, 2.0, 3.0, 8.0)]


def test_catalogue_tree(spark, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps({"id": "root", "links": [{"rel": "child", "href": "col/c.json", "title": "C"}, {"rel": "self", "href": "x"}, {"rel": "child"}]}))
    (tmp_path / "col").mkdir()
    (tmp_path / "col" / "c.json").write_text(json.dumps({"id": "c", "links": [{"rel": "item", "href": "i1.json"}, {"rel": "item", "href": "https://h/p/i2.json", "title": "two"}]}))
    top = catalogs.read_nodes(spark, str(tmp_path / "catalog.json")).withColumn("url", F.lit("https://h/catalog.json"))
    below = catalogs.read_nodes(spark, str(tmp_path / "col")).withColumn("url", F.lit("https://h/col/c.json"))
    assert sorted(map(tuple, catalogs.tree(top, below).collect())) == [("C", "i1", "https://h/col/i1.json"), ("C", "two", "https://h/p/i2.json")]


def test_metadata(spark):
    props = json.dumps({"sar:product_type": "SLC-COG", "sar:looks_range": 2, "proj:centroid": {"lat": 1.5, "lon": 2.5}, "unknown": 1})
    df = scenes.parse_metadata(spark.createDataFrame([(1, props), (2, "{broken"), (3, None)], "scene_id int, props string"))
    got = {r.scene_id: r for r in df.collect()}
    assert got[1].sar_product_type == "SLC-COG" and got[1].proj_centroid.lat == 1.5 and got[2].sar_product_type is None
    assert [r.scene_id for r in scenes.is_slc_cog(df).collect()] == [1]
    assert scenes.metadata_view(df, ["platform", "nope"]).columns == ["platform"]


@pytest.mark.parametrize(("href", "want"), [("https://o/x", "https://o/x"), ("//o/x", "https://o/x"), ("/x", "https://h/x"), ("x.json", "https://h/a/x.json")])
def test_resolve(spark, href, want):
    row = spark.createDataFrame([("https://h/a/b.json?q", href)], "base string, href string").select(catalog.resolve_url(F.col("base"), F.col("href")).alias("u")).first()
    assert row.u == want


def test_job_status(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "gone"), (4, "bad")], "seq int, layer_id string")
    layers = spark.createDataFrame([("a", True, True), ("b", True, False), ("bad", False, True)], "layer_id string, valid boolean, has_metadata boolean")
    status = lambda step: [r.status for r in batch.job_status(jobs, layers, step).orderBy("seq").collect()]
    assert status("focus") == ["task", "abort", "skip", "skip"]
    assert status("video") == ["task", "skip", "skip", "skip"]
    assert status("crop") == ["task", "task", "skip", "skip"]


def test_streams(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"id": "i", "assets": {"slc": {"href": "s.tif", "title": "SLC", "type": "image/tiff"}, "p": {"href": "q.tif", "title": "Quicklook", "type": "image/tiff"}}}))
    query = item_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("items_out").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("items_out").collect()] == [("i", None, "s.tif", "q.tif")]
    batch_events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "events")
    batch_events.write.parquet(folder)
    stream = spark.readStream.schema(batch_events.schema).parquet(folder)
    query = events_per_window(stream).writeStream.outputMode("complete").format("memory").queryName("events_out").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("events_out").agg(F.sum("n")).first()[0] == batch_events.count()
