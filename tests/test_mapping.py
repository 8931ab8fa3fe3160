"""Map coordinates: known places, round trips, the older series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintfield.functions import geometry, mapping
from glintfield.functions.steps import apply_steps

PLACES = [(zone * 6 - 183 + d, lat) for zone in range(1, 61) for d in (-3.0, -1.1, 0.0, 2.9) for lat in (-79.9, -33.3, -0.001, 0.0, 12.3, 45.0, 83.9)]


def test_there_and_back_in_all_zones(spark):
    df = spark.createDataFrame(PLACES, "lon double, lat double")
    zone = mapping.zone_code(F.col("lon"), F.col("lat"))
    x, y = mapping.from_lonlat(F.col("lon"), F.col("lat"), zone)
    placed = df.select("*", zone.alias("epsg"), x.alias("x"), y.alias("y"))
    lon, lat = mapping.to_lonlat(F.col("x"), F.col("y"), F.col("epsg"))
    t = placed.select("*", lon.alias("lon2"), lat.alias("lat2")).toPandas()
    metres = 111_320 * np.hypot((t.lon - t.lon2) * np.cos(np.radians(t.lat)), t.lat - t.lat2)
    assert metres.max() < 1e-3 and t.x.between(0, 1e6).all()


def test_agrees_with_the_footpoint_series_and_known_places(spark):
    df = spark.createDataFrame([(lon, lat) for lon, lat in PLACES if abs(lat) < 80], "lon double, lat double").withColumn("zone", F.expr("CAST(least(60, floor((lon+180)/6)+1) AS INT)"))
    code = F.when(F.col("lat") >= 0, F.col("zone") + 32600).otherwise(F.col("zone") + 32700)
    x, y = mapping.from_lonlat(F.col("lon"), F.col("lat"), code)
    t = apply_steps(df.select("*", x.alias("x"), y.alias("y")), geometry.transverse_mercator("lat", "lon", "zone")).toPandas()
    assert np.hypot(t.x - t.easting, t.y - t.northing).max() < 0.01
    # The equator on a zone's meridian, and the length of a quarter meridian.
    (a, b), = [(r.x, r.y) for r in spark.createDataFrame([(3.0, 0.0)], "lon double, lat double").select(*(c.alias(n) for c, n in zip(mapping.from_lonlat(F.col("lon"), F.col("lat"), F.lit(32631)), "xy"))).collect()]
    assert (a, b) == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert mapping.RADIUS * np.pi / 2 == pytest.approx(10_001_965.729, abs=1e-3)


def test_web_sphere_and_unknown_systems(spark):
    df = spark.createDataFrame([(180.0, 85.0511287798066, 3857), (1.0, 2.0, 4326), (1.0, 2.0, 27700)], "lon double, lat double, epsg int")
    x, y = mapping.from_lonlat(F.col("lon"), F.col("lat"), F.col("epsg"))
    rows = df.select(x.alias("x"), y.alias("y")).collect()
    assert rows[0].x == pytest.approx(20037508.342789244) and rows[0].y == pytest.approx(20037508.342789244, abs=1e-3)
    assert tuple(rows[1]) == (1.0, 2.0) and tuple(rows[2]) == (None, None)


def test_ground_squares_have_their_side(spark):
    df = spark.createDataFrame([(lon, lat) for lon, lat in PLACES if abs(lat) < 60], "x double, y double").withColumn("epsg", F.lit(4326))
    t = mapping.ground_squares(df, 300.0).select("x", "y", "box.*").toPandas()
    high = 110_900 * (t.ymax - t.ymin)
    assert high.between(295, 320).all() and ((t.xmin < t.x) & (t.x < t.xmax) & (t.ymin < t.y) & (t.y < t.ymax)).all()
