"""Scene metadata: JSON with keys prefix:name as nullable columns prefix_name; the vendor's own prefix is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys and types of the public metadata record. Fixed values.
FIELDS = {
    "datetime": "string",
    "created": "string",
    "start_datetime": "string",
    "end_datetime": "string",
    "platform": "string",
    "constellation": "string",
    "sar:instrument_mode": "string",
    "sar:frequency_band": "string",
    "sar:center_frequency": "double",
    "sar:polarizations": "array<string>",
    "sar:product_type": "string",
    "sar:resolution_range": "double",
    "sar:resolution_azimuth": "double",
    "sar:pixel_spacing_range": "double",
    "sar:pixel_spacing_azimuth": "double",
    "sar:looks_range": "int",
    "sar:looks_azimuth": "int",
    "sar:observation_direction": "string",
    "sat:orbit_state": "string",
    "view:off_nadir": "double",
    "view:azimuth": "double",
    "view:incidence_angle": "double",
    "processing:software": "map<string, string>",
    "proj:code": "string",
    "proj:shape": "array<int>",
    "proj:centroid": "struct<lat: double, lon: double>",
    "proj:transform": "array<double>",
    "raster:bands": "array<map<string, string>>",
}


#: The vendor's own keys by type, without their prefix. Fixed values.
VENDOR_FIELDS = {
    "int": ["image_id", "frame_number"],
    "string": [
        "image_reference", "scene_id", "run_name", "filename", "zero_doppler_start_datetime", "zero_doppler_end_datetime",
        "orientation", "coordinate_frame", "orbit_precision", "processing_end_datetime", "processing_mode",
    ],
    "double": [
        "resolution_range_near", "resolution_range_far", "looks_range_bandwidth", "looks_range_overlap", "looks_azimuth_bandwidth",
        "looks_azimuth_overlap", "synthetic_aperture_angle", "pulse_bandwidth", "pulse_duration", "acquisition_prf",
        "acquisition_range_sampling_rate", "orbit_mean_altitude", "incidence_angle_near", "incidence_angle_far", "grazing_angle_near",
        "grazing_angle", "grazing_angle_far", "squint_angle", "layover_angle", "shadow_angle", "doppler_cone_angle", "range_near",
        "range", "range_far", "average_scene_height", "extent_range", "extent_azimuth", "processing_bandwidth_range",
        "processing_bandwidth_azimuth", "processing_prf", "calibration_factor",
    ],
    "array<string>": ["doppler_centroid_datetimes"],
    "struct<function: string, parameters: struct<scale: double, exponent: double>>": ["amplitude_mapping"],
}
STATES = "array<struct<position: array<double>, velocity: array<double>>>"
#: Fields of the short view, in order; the squint is the vendor's.
ESSENTIAL = ["datetime", "created", "start_datetime", "end_datetime", "platform", "constellation", "proj_centroid"]


def parse_metadata(scenes: DataFrame, json_col: str = "props", vendor: str | None = None) -> DataFrame:
    """scenes with one column a field; unknown keys are dropped, missing keys and broken JSON are null.

    With a vendor prefix the vendor's fields follow as vendor_<name>, and the middle orbit state as
    center_aperture_position and center_aperture_velocity; a scene without orbit states then has no metadata at all.
    """
    own = {f"{vendor}:{name}": (f"vendor_{name}", kind) for kind, names in VENDOR_FIELDS.items() for name in names} if vendor else {}
    states = {f"{vendor}:orbit_states": STATES} if vendor else {}
    kinds = {**FIELDS, **{key: kind for key, (_, kind) in own.items()}, **states}
    parsed = scenes.withColumn("_m", F.from_json(json_col, ", ".join(f"`{key}` {kind}" for key, kind in kinds.items())))
    columns = [F.col("_m")[key].alias(key.replace(":", "_")) for key in FIELDS] + [F.col("_m")[key].alias(name) for key, (name, _) in own.items()]
    if vendor:
        orbit = F.col("_m")[f"{vendor}:orbit_states"]
        parsed = parsed.withColumn("_m", F.when(F.size(orbit) > 0, F.col("_m")))
        middle = F.get(orbit, F.floor(F.size(orbit) / 2).cast("int"))
        columns += [middle[part].alias(f"center_aperture_{part}") for part in ("position", "velocity")]
    return parsed.select(*scenes.columns, *columns)


def essential_json(scenes: DataFrame) -> DataFrame:
    """The short view of parsed vendor metadata as ordered JSON text, nulls included."""
    names = [*ESSENTIAL, "vendor_squint_angle"]
    return scenes.select("scene_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("view"))


def metadata_view(scenes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The named fields that exist; all if none is named."""
    return scenes if keys is None else scenes.select(*(k for k in keys if k in scenes.columns))


def is_slc_cog(scenes: DataFrame) -> DataFrame:
    return scenes.where(F.col("sar_product_type") == "SLC-COG")
