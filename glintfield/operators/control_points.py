"""Thin-plate splines through ground control points: pixel to map places and back.

A scene's spline is one row of arrays (its points, their weights, the affine part), solved in a task a scene from a
bounded number of points, and evaluated in column expressions for any number of places joined to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLINE = "scene_id string, centre array<double>, size array<double>, px array<double>, py array<double>, wx array<double>, wy array<double>"


def _bend(d2: np.ndarray) -> np.ndarray:
    """r * r * ln(r * r), 0 at 0."""
    return d2 * np.log(np.where(d2 > 0, d2, 1.0))


def fit_splines(gcps: DataFrame, *, to_map: bool = True, most_points: int = 1000) -> DataFrame:
    """gcps(scene_id, pixel, line, x, y) as one spline a scene: from pixels to the map, or back.

    Three points that are not in one line at least, `most_points` at most; points at the same place count once.
    """
    ends = [("pixel", "line"), ("x", "y")]
    start, goal = ends if to_map else ends[::-1]

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        p, q = (np.stack([table[c].to_numpy().astype(float) for c in names], 1) for names in (start, goal))
        p, first = np.unique(p, axis=0, return_index=True)
        q = q[first]
        if not 3 <= len(p) <= most_points:
            raise ValueError(f"scene {key[0].as_py()}: {len(p)} control points; 3 to {most_points} are needed")
        centre, size = p.mean(0), np.maximum(np.ptp(p, axis=0), 1e-12)
        u = (p - centre) / size
        side = np.concatenate([np.ones((len(u), 1)), u], 1)
        d2 = ((u[:, None] - u[None]) ** 2).sum(2)
        system = np.block([[_bend(d2), side], [side.T, np.zeros((3, 3))]])
        w = np.linalg.solve(system, np.concatenate([q, np.zeros((3, 2))]))
        row = {"scene_id": key[0].as_py(), "centre": centre, "size": size, "px": u[:, 0], "py": u[:, 1], "wx": w[:, 0], "wy": w[:, 1]}
        return pa.table({k: pa.array([v]) for k, v in row.items()})

    return gcps.select("scene_id", "pixel", "line", "x", "y").groupBy("scene_id").applyInArrow(solve, SPLINE)


def along_spline(points: DataFrame, splines: DataFrame, u: str, v: str, out_u: str, out_v: str) -> DataFrame:
    """points(scene_id, u, v, ...) with their places under the scene's spline; points of scenes without one are dropped."""
    met = points.join(splines, "scene_id")
    a, b = ((F.col(name) - F.get("centre", k)) / F.get("size", k) for k, name in enumerate((u, v)))
    met = met.withColumns({"_a": a, "_b": b})

    def bend(x: Column, y: Column) -> Column:
        d2 = (F.col("_a") - x) * (F.col("_a") - x) + (F.col("_b") - y) * (F.col("_b") - y)
        return F.when(d2 > 0, d2 * F.log(d2)).otherwise(0.0)

    n = F.size("px")
    bends = met.withColumn("_k", F.zip_with("px", "py", bend))

    def value(w: str) -> Column:
        sums = F.aggregate(F.zip_with("_k", F.slice(w, 1, n), lambda k, x: k * x), F.lit(0.0), lambda s, x: s + x)
        return sums + F.get(w, n) + F.get(w, n + 1) * F.col("_a") + F.get(w, n + 2) * F.col("_b")

    return bends.withColumns({out_u: value("wx"), out_v: value("wy")}).drop("_a", "_b", "_k", "centre", "size", "px", "py", "wx", "wy")


def map_to_pixel(points: DataFrame, gcps: DataFrame) -> DataFrame:
    """points(scene_id, x, y) with the pixel (r, c) they are in; halves round to even."""
    found = along_spline(points, fit_splines(gcps, to_map=False), "x", "y", "_c", "_r")
    return found.withColumns({"r": F.bround("_r").cast("int"), "c": F.bround("_c").cast("int")}).drop("_r", "_c")


def map_corners(extents: DataFrame, gcps: DataFrame) -> DataFrame:
    """extents(scene_id, xmin, ymin, xmax, ymax) in pixels as (scene_id, corner, x, y) on the map, clockwise from the first line."""
    corners = F.explode(F.array(*(F.struct(F.lit(k).alias("corner"), F.col(x).cast("double").alias("pixel"), F.col(y).cast("double").alias("line")) for k, (x, y) in enumerate([("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")]))))
    return along_spline(extents.select("scene_id", corners.alias("q")).select("scene_id", "q.*"), fit_splines(gcps), "pixel", "line", "x", "y")


def pixel_extents(extents: DataFrame, gcps: DataFrame) -> DataFrame:
    """extents(scene_id, xmin, ymin, xmax, ymax) on the map as whole-pixel boxes around their four corners."""
    corners = F.explode(F.array(*(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x in ("xmin", "xmax") for y in ("ymin", "ymax"))))
    placed = along_spline(extents.select("scene_id", corners.alias("q")).select("scene_id", "q.*"), fit_splines(gcps, to_map=False), "x", "y", "c", "r")
    return placed.groupBy("scene_id").agg(F.min("c").alias("xmin"), F.min("r").alias("ymin"), F.max("c").alias("xmax"), F.max("r").alias("ymax"))


def extent_windows(extents: DataFrame, gcps: DataFrame, sizes: DataFrame) -> DataFrame:
    """extents(scene_id, window, xmin, ymin, xmax, ymax) on the map as half-open pixel windows (scene_id, window, r0, r1, c0, c1).

    The box around the four placed corners, its start and its size cut to whole pixels. A box that leaves the scene
    (sizes(scene_id, width, height)), is empty or lies in a scene without control points gives no row.
    """
    corners = F.explode(F.array(*(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x in ("xmin", "xmax") for y in ("ymin", "ymax"))))
    placed = along_spline(extents.select("scene_id", "window", corners.alias("q")).select("scene_id", "window", "q.*"), fit_splines(gcps, to_map=False), "x", "y", "c", "r")
    box = placed.groupBy("scene_id", "window").agg(*(f(k).alias(f"{n}{k}") for k in "rc" for n, f in (("low_", F.min), ("high_", F.max))))
    start = {k: F.col(f"low_{k}").cast("int") for k in "rc"}
    long = {k: (F.col(f"high_{k}") - F.col(f"low_{k}")).cast("int") for k in "rc"}
    cut = box.select("scene_id", "window", *(c for k in "rc" for c in (start[k].alias(f"{k}0"), (start[k] + long[k]).alias(f"{k}1"))))
    return cut.join(sizes.select("scene_id", "width", "height"), "scene_id").where("r0 >= 0 AND c0 >= 0 AND r0 < r1 AND c0 < c1 AND r1 <= height AND c1 <= width").drop("width", "height")
