"""Raster files written from the chips, and queries that scan them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from glintfield.operators.control_points import extent_windows
from glintfield.operators.indexing import shadows_down
from glintfield.operators.spectral import unpacked
from glintfield.plans.spectra import rounded
from glintfield.session import shared_folder
from glintfield.sources import geotiff
from glintfield.sources.chips import LINES, PX_SQL, SAMPLES, lines_from_embeddings


def _layout(chip: int) -> dict:
    """Amplitude and phase; placed by control points on half and quarter units of the map."""
    place = lambda c, r: [c, r, 10.0 + chip + c * 0.5, 50.0 - r * 0.25, 0.0]
    mapping = {"amplitude_mapping": {"function": "power", "parameters": {"scale": 1, "exponent": 2}}} if chip % 2 else {}
    return {"width": SAMPLES, "height": LINES, "bands": 2, "control_points": [place(c, r) for c in (0, SAMPLES) for r in (0, LINES)], "items": {"PROPERTIES": json.dumps(mapping)}, "band_items": {"1": {"NAME": "Amplitude", "scale": "2", "offset": "0.5"}, "2": {"NAME": "PHASE"}}}


def _written(spark, sf_dir) -> str:
    """The chips as raster files in a folder of the shared one."""
    chips = lines_from_embeddings(spark, sf_dir)
    size = F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))
    bands = F.explode(F.array(F.struct(F.lit(1).alias("band"), size.alias("samples")), F.struct(F.lit(2).alias("band"), F.zip_with("re", "im", lambda a, b: F.atan2(b, a)).alias("samples"))))
    frames = chips.select(F.col("chip").cast("string").alias("scene_id"), "r", bands.alias("b")).select("scene_id", "b.band", "r", "b.samples")
    folder = f"{shared_folder(spark)}/rasters-{uuid.uuid4().hex}"
    scenes = [r.chip for r in chips.select("chip").distinct().collect()]  # a layout a file
    geotiff.write_rasters(frames, folder, {str(c): _layout(c) for c in scenes})
    return folder


def _chip(path: str = "path"):
    return F.regexp_extract(path, r"([0-9]+)\.tif$", 1).cast("long").alias("chip")


def raster_scene(spark, sf_dir):
    """Lines 16 to 39 of every file as complex samples with shadows down; of each file only their strips are read."""
    scenes = geotiff.complex_scenes(spark, _written(spark, sf_dir)).where("r >= 16 AND r < 40")
    px = unpacked(scenes.select(_chip(), (F.col("r") - 16).alias("r"), "re", "im"), "c")
    return rounded(shadows_down(px, F.col("chip") % 3 == 0, SAMPLES).select("chip", "r", "c", "re", "im"), re=5, im=5)


def raster_band(spark, sf_dir):
    """The second band alone, samples as stored."""
    lines = geotiff.raster_lines(spark, _written(spark, sf_dir), [2])
    return rounded(lines.select(_chip(), "r", F.posexplode(F.get("bands", 0)).alias("c", "v")), v=5)


def raster_headers(spark, sf_dir):
    found = geotiff.raster_headers(spark, _written(spark, sf_dir))
    one = lambda k, what: F.get("bands", k)[what]
    return found.select(_chip(), "width", "height", "n_bands", one(0, "name").alias("first_name"), one(0, "scale").alias("scale"), one(0, "offset").alias("offset"), F.coalesce(one(1, "scale"), F.lit(-1.0)).alias("second_scale"), F.size("control_points").alias("n_points"), F.get("control_points", 3)["x"].alias("last_x"), F.get("control_points", 3)["y"].alias("last_y"), "nodata")


def raster_extents(spark, sf_dir):
    """Map extents (two a file, and two that leave it) as pixel windows, and the amplitudes in them."""
    folder = _written(spark, sf_dir)
    heads = geotiff.raster_headers(spark, folder)
    chip = _chip()
    # From pixel 3.3, 5.4 on, 9 x 20 pixels; from 12.6, 30.7, 12 x 16; beyond the last line; before the first column.
    spots = F.explode(F.array(*(F.struct(F.lit(w).alias("window"), *(F.lit(float(v)).alias(n) for n, v in zip("cdrs", box))) for w, box in enumerate([(3.3, 12.4, 5.4, 25.9), (12.6, 24.7, 30.7, 47.2), (2.2, 5.3, 50.2, 65.9), (-1.6, 5.3, 2.2, 9.9)]))))
    placed = heads.select("path", chip, spots.alias("s")).select("path", "chip", "s.*")
    extents = placed.select(F.col("path").alias("scene_id"), "window", (F.lit(10.0) + F.col("chip") + F.col("c") * 0.5).alias("xmin"), (F.lit(10.0) + F.col("chip") + F.col("d") * 0.5).alias("xmax"), (F.lit(50.0) - F.col("s") * 0.25).alias("ymin"), (F.lit(50.0) - F.col("r") * 0.25).alias("ymax"))
    windows = extent_windows(extents, geotiff.control_points(heads), heads.select(F.col("path").alias("scene_id"), "width", "height"))
    lines = geotiff.read_windows(windows.withColumnRenamed("scene_id", "path"), [1])
    px = lines.select(_chip(), "window", "r", "c0", F.posexplode(F.get("bands", 0)).alias("k", "v"))
    return rounded(px.select("chip", "window", "r", (F.col("c0") + F.col("k")).alias("c"), "v"), v=5)


QUERIES = {f.__name__: f for f in (raster_scene, raster_band, raster_headers, raster_extents)}

_STORED = f"""{PX_SQL},
st AS (SELECT chip, r, c, CAST(CAST(sqrt(re*re+im*im) AS FLOAT) AS DOUBLE) AS amp, CAST(CAST(atan2(im, re) AS FLOAT) AS DOUBLE) AS phase FROM px)"""

ORACLE_SQL = {
    "raster_scene": f"""WITH {_STORED},
d AS (SELECT chip, r-16 AS r, c, CASE WHEN chip%2=1 THEN sqrt(amp) ELSE amp END*2+0.5 AS a, phase FROM st WHERE r BETWEEN 16 AND 39)
SELECT chip, CAST(CASE WHEN chip%3=0 THEN {SAMPLES - 1}-c ELSE c END AS INT) AS r, CAST(r AS INT) AS c, round(a*cos(phase), 5)+0.0 AS re, round(-a*sin(phase), 5)+0.0 AS im FROM d""",
    "raster_band": f"WITH {_STORED}\nSELECT chip, r, c, round(phase, 5)+0.0 AS v FROM st",
    "raster_headers": f"WITH {PX_SQL}\nSELECT DISTINCT chip, {SAMPLES} AS width, {LINES} AS height, 2 AS n_bands, 'Amplitude' AS first_name, 2.0e0 AS scale, 0.5e0 AS offset, -1.0e0 AS second_scale, 4 AS n_points, 10.0e0+chip+{SAMPLES}*0.5e0 AS last_x, 50.0e0-{LINES}*0.25e0 AS last_y, 0.0e0 AS nodata FROM px",
    "raster_extents": f"""WITH {_STORED}
SELECT chip, CAST(w.w AS INT) AS window, r, c, round(amp, 5)+0.0 AS v FROM st JOIN (VALUES (0, 3, 12, 5, 25), (1, 12, 24, 30, 46)) w(w, c0, c1, r0, r1) ON c >= c0 AND c < c1 AND r >= r0 AND r < r1""",
}
