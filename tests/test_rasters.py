"""GeoTIFF files as a source and a sink."""

import io
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from glintfield.operators.control_points import extent_windows
from glintfield.sources import geotiff
from glintfield.sources.tiff_layout import lines, plan_file, read_layout


def classic(data, *, order="<", tile=None, interleaved=False, rows=3):
    """A classic TIFF of data[band, line, column], by hand: strips of `rows` lines or tiles."""
    bands, height, width = data.shape
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    tall, wide = tile or (rows, width)
    down, across = -(-height // tall), -(-width // wide)
    blocks = []
    for plane in [slice(None)] if interleaved else range(bands):
        for y in range(down):
            for x in range(across):
                lines_here = tall if tile else min(tall, height - y * tall)
                part = np.zeros((bands if interleaved else 1, lines_here, wide), data.dtype)
                cut = data[plane, y * tall : y * tall + lines_here, x * wide : (x + 1) * wide]
                part[:, : cut.shape[-2], : cut.shape[-1]] = cut
                blocks.append(part.transpose(1, 2, 0).astype(data.dtype.newbyteorder(order)).tobytes())
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    entries = {256: width, 257: height, 258: [8 * data.itemsize] * bands, 259: 1, 277: bands, 284: 1 if interleaved else 2, 339: [kind] * bands}
    entries |= {322: wide, 323: tall, 324: offsets, 325: list(map(len, blocks))} if tile else {273: offsets, 278: tall, 279: list(map(len, blocks))}
    table, tail, end = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, v in sorted(entries.items()):
        v = v if isinstance(v, list) else [v]
        raw = struct.pack(f"{order}{len(v)}I", *v)
        if len(raw) > 4:
            raw, tail = struct.pack(order + "I", end + len(tail)), tail + raw
        table += struct.pack(order + "HHI", tag, 4, len(v)) + raw
    return struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, at) + b"".join(blocks) + struct.pack(order + "H", len(entries)) + table + b"\0" * 4 + tail


@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "f4", "f8"])
@pytest.mark.parametrize("form", [{}, {"interleaved": True}, {"tile": (4, 8)}, {"tile": (4, 8), "interleaved": True}, {"order": ">"}])
def test_all_layouts_bit_for_bit(spark, tmp_path, kind, form):
    data = np.random.default_rng(1).integers(0, 200, (3, 11, 19)).astype(kind)
    raw = classic(data, **form)
    layout = read_layout(io.BytesIO(raw))
    assert (layout.width, layout.height, layout.bands) == (19, 11, 3)
    tall = layout.block[0]
    got = np.concatenate([lines(io.BytesIO(raw), layout, [3, 1], k // tall, k, k + 1) for k in range(11)], 1)
    assert (got == data[[2, 0]]).all()
    if kind == "f4":
        (tmp_path / "a.tif").write_bytes(raw)
        rows = {r.r: r.bands for r in geotiff.raster_lines(spark, str(tmp_path)).collect()}
        assert (np.array([rows[r] for r in range(11)]).transpose(1, 0, 2) == data).all()


def test_a_window_of_lines_opens_only_its_strips(tmp_path):
    (tmp_path / "a.tif").write_bytes(classic(np.zeros((1, 40, 5), "f4"), rows=4))
    (tmp_path / "b.tif").write_bytes(classic(np.zeros((1, 40, 5), "f4"), rows=4))
    reader = geotiff.RasterReader({"path": str(tmp_path), "chunkbytes": "80"})
    rest = list(reader.pushFilters([GreaterThanOrEqual(("r",), 9), LessThan(("r",), 17), EqualTo(("path",), f"{tmp_path}/b.tif"), EqualTo(("bands",), 1)]))
    assert rest == [EqualTo(("bands",), 1)]
    assert [(os.path.basename(c.path), c.blocks, c.first, c.last) for c in reader.partitions()] == [("b.tif", (2, 3), 9, 12), ("b.tif", (3, 4), 12, 16), ("b.tif", (4, 5), 16, 17)]


def test_filters_reach_the_source(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(classic(np.arange(200, dtype="f4").reshape(1, 40, 5), rows=4))
    some = geotiff.raster_lines(spark, str(tmp_path)).where("r >= 30 AND r <= 32")
    assert sorted((r.r, r.bands[0][0]) for r in some.collect()) == [(30, 150.0), (31, 155.0), (32, 160.0)]
    assert some.rdd.getNumPartitions() == 1 and geotiff.raster_lines(spark, str(tmp_path)).where("r > 100").count() == 0


def frames(spark, scenes=("s",), height=12, width=7, bands=2):
    rows = [(s, b, r, [float(np.float32(b * 1000 + r * 10 + c + k / 3)) for c in range(width)]) for k, s in enumerate(scenes) for b in range(1, bands + 1) for r in range(height)]
    return rows, spark.createDataFrame(rows, "scene_id string, band int, r int, samples array<double>").repartition(5)


LAYOUT = {"width": 7, "height": 12, "bands": 2}


def test_sink_and_scan_agree_and_places_go_along(spark, tmp_path):
    rows, df = frames(spark, ("a", "b"))
    points = [[0, 0, 10.5, 20.5, 1], [6, 0, 11, 20, 2], [0, 11, 10, 21, 3]]
    layouts = {"a": LAYOUT | {"control_points": points, "items": {"K": "<v> & 'w'"}, "geo_keys": {"34735": [1, 1, 0, 1, 1024, 0, 1, 2]}}, "b": LAYOUT | {"transform": [100.0, 2.0, 0.0, 50.0, 0.0, -2.0], "band_items": {"1": {"NAME": "x", "scale": "3"}}}}
    geotiff.write_rasters(df, str(tmp_path), layouts)
    assert sorted(os.listdir(tmp_path)) == ["a.tif", "b.tif"]
    got = {(os.path.basename(r.path)[0], b + 1, r.r): list(v) for r in geotiff.raster_lines(spark, str(tmp_path)).collect() for b, v in enumerate(r.bands)}
    assert got == {(s, b, r): v for s, b, r, v in rows}
    heads = {os.path.basename(r.path)[0]: r for r in geotiff.raster_headers(spark, str(tmp_path)).collect()}
    assert [list(p) for p in heads["a"].control_points] == points and heads["a"].transform is None and heads["a"]["items"] == {"K": "<v> & 'w'"}
    assert heads["b"].transform == [100.0, 2.0, 0.0, 50.0, 0.0, -2.0] and heads["b"].bands[0].scale == 3 and heads["b"].bands[0].name == "x" and heads["b"].nodata == 0
    copied = geotiff.layout_of(str(tmp_path / "a.tif"), 3, 4, 1)
    assert copied["control_points"] == points and copied["geo_keys"]["34735"] == [1, 1, 0, 1, 1024, 0, 1, 2]
    plan_file(**copied)


def test_a_failed_or_short_write_leaves_nothing(spark, tmp_path):
    _, df = frames(spark)
    bad = df.withColumn("samples", F.when((F.col("r") == 7) & (F.col("band") == 2), F.array(F.lit(1.0))).otherwise(F.col("samples")))
    for broken in (bad, df.where("NOT (r = 3 AND band = 1)")):
        with pytest.raises(Exception, match="does not fit|have come"):
            geotiff.write_rasters(broken, str(tmp_path), {"s": LAYOUT})
        assert os.listdir(tmp_path) == []
    geotiff.write_rasters(df, str(tmp_path), {"s": LAYOUT})
    with pytest.raises(Exception, match="s.tif"):
        geotiff.write_rasters(df, str(tmp_path), {"s": LAYOUT})
    geotiff.write_rasters(df, str(tmp_path), {"s": LAYOUT}, mode="overwrite")
    assert os.listdir(tmp_path) == ["s.tif"]


def test_band_order_and_power_mapping(spark, tmp_path):
    _, df = frames(spark, ("ok",))
    named = lambda first, second: {"1": {"NAME": first, "scale": "2", "offset": "1"}, "2": {"NAME": second}}
    mapping = json.dumps({"amplitude_mapping": {"function": "power", "parameters": {"scale": 1, "exponent": 2}}})
    geotiff.write_rasters(df, str(tmp_path / "a"), {"ok": LAYOUT | {"band_items": named("AMPLITUDE", "Phase"), "items": {"PROPERTIES": mapping}}})
    row = geotiff.complex_scenes(spark, str(tmp_path / "a")).where("r = 4").first()
    amp, phase = (np.array([np.float32(b * 1000 + 40 + c) for c in range(7)], float) for b in (1, 2))
    assert np.allclose(np.array(row.re) + 1j * np.array(row.im), (amp**0.5 * 2 + 1) * np.exp(-1j * phase))
    geotiff.write_rasters(df, str(tmp_path / "b"), {"ok": LAYOUT | {"band_items": named("phase", "amplitude")}})
    with pytest.raises(Exception, match="band 1 is not amplitude"):
        geotiff.complex_scenes(spark, str(tmp_path / "b")).collect()


def test_extents_become_windows_and_failures_no_rows(spark, tmp_path):
    _, df = frames(spark, ("a",), bands=1)
    points = [[c, r, 100.0 + 2 * c, 50.0 - 4 * r, 0.0] for c in (0, 7) for r in (0, 12)]
    geotiff.write_rasters(df, str(tmp_path), {"a": {"width": 7, "height": 12, "bands": 1, "control_points": points}})
    heads = geotiff.raster_headers(spark, str(tmp_path))
    path = heads.first().path
    boxes = [(1, 102.6, 108.2, 10.4, 30.8), (2, 90.0, 104.0, 20.0, 30.0), (3, 103.0, 103.5, 20.0, 30.0), (4, 102.6, 108.2, -9.0, 30.8)]
    extents = spark.createDataFrame([(path, *b) for b in boxes] + [("elsewhere", 9, 1.0, 2.0, 1.0, 2.0)], "scene_id string, window int, xmin double, xmax double, ymin double, ymax double")
    windows = extent_windows(extents, geotiff.control_points(heads), heads.select(F.col("path").alias("scene_id"), "width", "height"))
    assert [tuple(r)[1:] for r in windows.collect()] == [(1, 4, 9, 1, 3)]
    found = geotiff.read_windows(windows.withColumnRenamed("scene_id", "path"), [1], run=2).orderBy("r").collect()
    assert [(r.window, r.r, r.c0, r.bands) for r in found] == [(1, r, 1, [[1000.0 + r * 10 + c for c in (1, 2)]]) for r in range(4, 9)]


def test_compressed_and_cut_files_are_errors():
    raw = classic(np.zeros((1, 6, 5), "f4"))
    with pytest.raises(ValueError, match="compression"):
        read_layout(io.BytesIO(raw.replace(struct.pack("<HHII", 259, 4, 1, 1), struct.pack("<HHII", 259, 4, 1, 5))))
    with pytest.raises(ValueError, match="not a TIFF"):
        read_layout(io.BytesIO(b"\x89PNG\r\n\x1a\n" + bytes(20)))
    layout = read_layout(io.BytesIO(raw))
    with pytest.raises(ValueError, match="ends within"):
        lines(io.BytesIO(raw[:40]), layout, [1], 0, 0, 3)
