"""GeoTIFF rasters as a data source: spark.read.format("raster_lines") and its writer.

Reading gives one row a file line, (path, r, bands), the asked bands' samples as arrays of doubles. A partition is a run of
whole strips or tile rows of about `chunkBytes` (option) in one file. Filters on r and path are pushed: chunks outside are
no partitions, and of a chunk only the lines inside are read. Files are opened by their URI where tasks run.

Writing takes (scene_id, band, r, samples) and makes path/<scene_id>.tif of 32-bit floats, bands apart, a strip a line. The
`layouts` option names each scene's size and what goes along (`layout_of` copies it from a source file). Places follow from the
layout alone, so each task writes its lines straight to where they belong, in files of a hidden folder beside; a task
that runs twice writes the same bytes. The commit adds headers, checks that every line has come, and renames;
an abort leaves nothing. It needs a folder that all tasks can write to at any place (a file system, not an object store).
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from glintfield.operators.indexing import decode_slc, or_default
from glintfield.sources.tiff_layout import GEO_DOUBLES, GEO_KEYS, GEO_TEXT, Layout, Plan, lines, plan_file, read_layout

ROWS = pa.schema([("path", pa.string()), ("r", pa.int32()), ("bands", pa.list_(pa.list_(pa.float64())))])


def _opened(path: str):
    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
    where, inside = arrow_fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return where.open_input_file(inside)


def _local(path: str) -> str:
    """The path of a folder that can be written at any place."""
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"rasters are written to a file system, not to {parts.scheme}")
    return os.path.abspath(unquote(parts.path))


def _files(path: str) -> list[str]:
    """The file, or those that end in .tif or .tiff in the folder."""
    where, inside = arrow_fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))
    info = where.get_file_info(inside)
    if info.type != arrow_fs.FileType.Directory:
        return [path]
    found = where.get_file_info(arrow_fs.FileSelector(inside))
    names = sorted(f.base_name for f in found if f.base_name.lower().endswith((".tif", ".tiff")) and not f.base_name.startswith(("_", ".")))
    return [f"{path.rstrip('/')}/{name}" for name in names]


class Chunk(InputPartition):
    """Lines first to last - 1 of a file, in the given rows of strips or tiles."""

    def __init__(self, path: str, layout: Layout, blocks: tuple[int, int], first: int, last: int):
        self.path, self.layout, self.blocks, self.first, self.last = path, layout, blocks, first, last


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = _files(options["path"])
        self.asked = [int(b) for b in options.get("bands", "").split(",") if b]
        self.chunk_bytes = int(options.get("chunkbytes", options.get("chunkBytes", 8 << 20)))
        self.first, self.last, self.only = 0, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if f.attribute == ("path",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            elif f.attribute == ("r",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    end = f.value + (not isinstance(f, LessThan))
                    self.last = end if self.last is None else min(self.last, end)
            else:
                yield f

    def partitions(self) -> list[Chunk]:
        paths = [p for p in self.paths if self.only is None or p in self.only]
        with ThreadPoolExecutor(16) as pool:
            return [c for part in pool.map(self._chunks, paths) for c in part]

    def _chunks(self, path: str) -> list[Chunk]:
        with _opened(path) as file:
            layout = read_layout(file)
        tall = layout.block[0]
        first, last = self.first, layout.height if self.last is None else min(self.last, layout.height)
        row_bytes = layout.width * np.dtype(layout.dtype).itemsize * (layout.bands if layout.interleaved or not self.asked else len(self.asked))
        step = max(1, self.chunk_bytes // max(1, row_bytes * tall))
        out = []
        for block in range(first // tall, -(-last // tall), step) if first < last else ():
            end = min(block + step, -(-last // tall))
            own = layout._replace(tags={}, items={}, band_items={})
            out.append(Chunk(path, own, (block, end), max(first, block * tall), min(last, end * tall)))
        return out

    def read(self, chunk: Chunk | None):
        if chunk is None:  # no chunk is left
            return
        layout, tall = chunk.layout, chunk.layout.block[0]
        bands = self.asked or list(range(1, layout.bands + 1))
        if not all(1 <= b <= layout.bands for b in bands):
            raise ValueError(f"{chunk.path} has bands 1 to {layout.bands}")
        with _opened(chunk.path) as file:
            for block in range(*chunk.blocks):
                a, b = max(chunk.first, block * tall), min(chunk.last, (block + 1) * tall)
                if a < b:
                    yield self._batch(chunk.path, a, lines(file, layout, bands, block, a, b).astype(float))

    @staticmethod
    def _batch(path: str, first: int, data: np.ndarray) -> pa.RecordBatch:
        n_bands, n, width = data.shape
        flat = pa.array(data.transpose(1, 0, 2).ravel())
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, n * n_bands + 1, n_bands, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n * n_bands + 1, dtype=np.int32) * np.int32(width)), flat))
        return pa.record_batch([pa.array([path] * n), pa.array(np.arange(first, first + n, dtype=np.int32)), rows], schema=ROWS)


@dataclass
class Written(WriterCommitMessage):
    lines: dict[str, int]


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = _local(options["path"]), overwrite
        self.layouts = json.loads(options["layouts"])
        self.hidden = f"{self.folder}/.writing-{uuid.uuid4().hex}"

    def _plan(self, scene: str) -> Plan:
        if scene not in self.layouts:
            raise ValueError(f"no layout of scene {scene}")
        return plan_file(**self.layouts[scene])

    def write(self, batches) -> Written:
        os.makedirs(self.hidden, exist_ok=True)
        files: dict[str, int] = {}
        plans: dict[str, Plan] = {}
        count: dict[str, int] = {}
        try:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                for scene, band, r, samples in zip(*(table[c].to_pylist() for c in ("scene_id", "band", "r")), table["samples"]):
                    if scene not in files:
                        plans[scene] = self._plan(scene)
                        files[scene] = os.open(f"{self.hidden}/{scene}.tif", os.O_WRONLY | os.O_CREAT)
                    plan, values = plans[scene], np.array(samples.values.fill_null(0.0) if samples.is_valid else [], "<f4")
                    if not (1 <= band <= plan.bands and 0 <= r < plan.height and len(values) == plan.width):
                        raise ValueError(f"scene {scene}: band {band}, line {r} of {len(values)} samples does not fit")
                    os.pwrite(files[scene], values.tobytes(), plan.place(band, r))
                    count[scene] = count.get(scene, 0) + 1
        finally:
            for file in files.values():
                os.close(file)
        return Written(count)

    def commit(self, messages) -> None:
        come: dict[str, int] = {}
        for m in messages:
            for scene, n in (m.lines if m else {}).items():
                come[scene] = come.get(scene, 0) + n
        try:
            for scene, n in come.items():
                plan = self._plan(scene)
                if n != plan.height * plan.bands:
                    raise ValueError(f"scene {scene}: {n} lines have come, not {plan.height * plan.bands}")
                if not self.overwrite and os.path.exists(f"{self.folder}/{scene}.tif"):
                    raise FileExistsError(f"{self.folder}/{scene}.tif")
                with open(f"{self.hidden}/{scene}.tif", "r+b") as file:
                    file.write(plan.header)
                    file.truncate(plan.size)
            for scene in come:
                os.replace(f"{self.hidden}/{scene}.tif", f"{self.folder}/{scene}.tif")
        finally:
            shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class RasterLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_lines"

    def schema(self) -> str:
        return "path string, r int, bands array<array<double>>"

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterLines)


def raster_lines(spark: SparkSession, path: str, bands: list[int] | None = None) -> DataFrame:
    """(path, r, bands) of the raster file, or of all in a folder; only the named bands' bytes are read."""
    register(spark)
    reader = spark.read.format("raster_lines")
    return (reader.option("bands", ",".join(map(str, bands))) if bands else reader).load(path)


HEADERS = "path string, width int, height int, n_bands int, bands array<struct<band: int, name: string, scale: double, offset: double>>, items map<string, string>, transform array<double>, control_points array<struct<pixel: double, line: double, x: double, y: double, z: double>>, nodata double"


def raster_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row a file with what its header says; headers are read in tasks."""
    paths = _files(path)

    def headers(batches):
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                with _opened(p) as file:
                    x = read_layout(file)
                number = lambda own, what: float(own[what]) if own.get(what) else None
                own = [(b, x.band_items.get(b, {})) for b in range(1, x.bands + 1)]
                rows.append({"path": p, "width": x.width, "height": x.height, "n_bands": x.bands, "bands": [{"band": b, "name": o.get("NAME"), "scale": number(o, "scale"), "offset": number(o, "offset")} for b, o in own], "items": list(x.items.items()), "transform": x.transform(), "control_points": [dict(zip(("pixel", "line", "x", "y", "z"), g)) for g in x.control_points()], "nodata": x.nodata()})
            point = pa.struct([(c, pa.float64()) for c in ("pixel", "line", "x", "y", "z")])
            band = pa.struct([("band", pa.int32()), ("name", pa.string()), ("scale", pa.float64()), ("offset", pa.float64())])
            schema = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("n_bands", pa.int32()), ("bands", pa.list_(band)), ("items", pa.map_(pa.string(), pa.string())), ("transform", pa.list_(pa.float64())), ("control_points", pa.list_(point)), ("nodata", pa.float64())])
            yield pa.RecordBatch.from_pylist(rows, schema)

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, min(len(paths), 200))).mapInArrow(headers, HEADERS)


def layout_of(path: str, width: int, height: int, bands: int) -> dict:
    """A layout for the writer with the places, keys and items of a source file."""
    with _opened(path) as file:
        x = read_layout(file)
    return {"width": width, "height": height, "bands": bands, "transform": x.transform(), "control_points": [list(g) for g in x.control_points()], "geo_keys": {str(k): x.tags[k] if isinstance(x.tags[k], str) else list(x.tags[k]) for k in (GEO_KEYS, GEO_DOUBLES, GEO_TEXT) if k in x.tags}, "items": x.items}


def write_rasters(frames: DataFrame, path: str, layouts: dict[str, dict], mode: str = "append") -> None:
    """frames(scene_id, band, r, samples) as path/<scene_id>.tif; layouts: plan_file's arguments by scene.

    mode append: an existing file of a scene is an error; overwrite: it is replaced.
    """
    register(frames.sparkSession)
    os.makedirs(_local(path), exist_ok=True)
    rows = frames.select(F.col("scene_id").cast("string").alias("scene_id"), F.col("band").cast("int").alias("band"), F.col("r").cast("int").alias("r"), F.col("samples").cast("array<double>").alias("samples"))
    rows.write.format("raster_lines").option("layouts", json.dumps(layouts)).mode(mode).save(path)


def complex_scenes(spark: SparkSession, path: str, properties: str = "PROPERTIES", mapping: str = "amplitude_mapping") -> DataFrame:
    """Packed complex lines (path, r, re, im) of amplitude and phase rasters, in file orientation.

    Band 1 must be named amplitude and band 2 phase, whatever their case; else reading the scene is an error. A missing scale or 0
    is 1, a missing offset 0. The metadata (JSON in the item `properties`) may map amplitudes by a power under the key `mapping`:
    the exponent is the mapping's scale over its exponent.
    """
    heads = raster_headers(spark, path)
    name = lambda k: F.lower(F.coalesce(F.get("bands", k)["name"], F.lit("")))
    broken = (F.col("n_bands") < 2) | (name(0) != "amplitude") | (name(1) != "phase")
    checked = F.when(broken, F.raise_error(F.concat(F.lit("band 1 is not amplitude or band 2 not phase: "), "path"))).otherwise(F.col("path"))
    value = lambda what: F.get_json_object(F.element_at("items", F.lit(properties)), f"$['{mapping}'].{what}")
    power = F.when(value("function") == "power", value("parameters.scale").cast("double") / value("parameters.exponent").cast("double")).otherwise(1.0)
    scales = [c for k, b in enumerate("ap") for c in (or_default(F.get("bands", k)["scale"], 1.0).alias(f"{b}_scale"), F.coalesce(F.get("bands", k)["offset"], F.lit(0.0)).alias(f"{b}_offset"))]
    known = heads.select(checked.alias("path"), power.alias("power"), *scales)
    met = raster_lines(spark, path, [1, 2]).join(known, "path")
    part = lambda k: F.zip_with(F.get("bands", 0), F.get("bands", 1), lambda a, p: decode_slc(a, p, F.col("a_scale"), F.col("a_offset"), F.col("p_scale"), F.col("p_offset"), F.col("power"))[k])
    return met.select("path", "r", part(0).alias("re"), part(1).alias("im"))


def control_points(headers: DataFrame) -> DataFrame:
    """The files' control points for the splines: (scene_id, pixel, line, x, y), scene_id being the path."""
    return headers.select(F.col("path").alias("scene_id"), F.explode("control_points").alias("g")).select("scene_id", "g.pixel", "g.line", "g.x", "g.y")


def read_windows(windows: DataFrame, bands: list[int], *, run: int = 64) -> DataFrame:
    """windows(path, window, r0, r1, c0, c1) as (window, path, r, c0, bands), the windows' lines cut to their columns.

    Windows may come from any query: each becomes runs of at most `run` lines that are dealt over the tasks, and a task reads
    those lines' bytes alone. Empty or null windows give no rows; one that leaves its raster is an error.
    """
    asked = windows.where("r0 < r1 AND c0 < c1").select("window", "path", *(F.col(c).cast("int").alias(c) for c in ("r0", "r1", "c0", "c1")))
    runs = asked.withColumn("first", F.explode(F.expr(f"sequence(r0, r1 - 1, {run})"))).select("window", "path", "first", F.least(F.col("first") + run, F.col("r1")).alias("last"), "c0", "c1")

    def read(batches):
        known: dict[str, Layout] = {}
        for batch in batches:
            for window, path, first, last, c0, c1 in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(path) as file:
                    layout = known.setdefault(path, None) or read_layout(file)
                    known[path] = layout
                    if first < 0 or c0 < 0 or last > layout.height or c1 > layout.width:
                        raise ValueError(f"{path}: lines {first} to {last}, columns {c0} to {c1} leave the raster")
                    for block in range(first // layout.block[0], (last - 1) // layout.block[0] + 1):
                        a, b = max(first, block * layout.block[0]), min(last, (block + 1) * layout.block[0])
                        found = RasterReader._batch(path, a, lines(file, layout, bands, block, a, b)[:, :, c0:c1].astype(float))
                        n = found.num_rows
                        yield pa.record_batch([pa.array([window] * n, batch.column(0).type), found.column(0), found.column(1), pa.array([c0] * n, pa.int32()), found.column(2)], names=["window", "path", "r", "c0", "bands"])

    kind = runs.schema["window"].dataType.simpleString()
    return runs.repartition("path", "first").mapInArrow(read, f"window {kind}, path string, r int, c0 int, bands array<array<double>>")
