"""Map coordinates both ways between reference systems, by their EPSG codes, as columns.

Known are longitude and latitude (4326), zones of the transverse Mercator projection (32601 to 32660 north, 32701 to
32760 south) and the web's sphere (3857); any other code gives nulls. The series of the transverse Mercator
projection go to the fourth order of the third flattening, which is below a tenth of a millimetre within a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS 84, and the projections' scale and offsets. Fixed values.
AXIS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Coefficients of the series: to the projection, back, and from the conformal to the geodetic latitude. Fixed values.
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BACK = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
GEODETIC = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def _zone(epsg: Column) -> Column:
    return F.when(epsg.between(32601, 32660), epsg - 32600).when(epsg.between(32701, 32760), epsg - 32700)


def _meridian(epsg: Column) -> Column:
    return 6.0 * _zone(epsg) - 183.0


def _false_north(epsg: Column) -> Column:
    return F.when(epsg >= 32701, SOUTH).otherwise(0.0)


def zone_code(lon: Column, lat: Column) -> Column:
    """The code of the zone that a place lies in, by its sixth of a degree of longitude alone."""
    zone = F.least(F.greatest(F.floor((lon + 180.0) / 6.0).cast("int") + 1, F.lit(1)), F.lit(60))
    return F.when(lat >= 0, zone + 32600).otherwise(zone + 32700)


def _sums(coefficients, x: Column, y: Column) -> tuple[Column, Column]:
    """Sums of c sin(2jx) cosh(2jy) and of c cos(2jx) sinh(2jy)."""
    terms = [(c, 2.0 * (j + 1)) for j, c in enumerate(coefficients)]
    sines = sum((F.lit(c) * F.sin(x * k) * F.cosh(y * k) for c, k in terms), F.lit(0.0))
    return sines, sum((F.lit(c) * F.cos(x * k) * F.sinh(y * k) for c, k in terms), F.lit(0.0))


def _to_zone(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    e = 2 * math.sqrt(N) / (1 + N)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    away = F.radians(lon - _meridian(epsg))
    x, y = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1.0 + t * t))
    dx, dy = _sums(FORWARD, x, y)
    return EAST + SCALE * RADIUS * (y + dy), _false_north(epsg) + SCALE * RADIUS * (x + dx)


def _from_zone(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    x, y = (north - _false_north(epsg)) / (SCALE * RADIUS), (east - EAST) / (SCALE * RADIUS)
    dx, dy = _sums(BACK, x, y)
    x, y = x - dx, y - dy
    conformal = F.asin(F.sin(x) / F.cosh(y))
    lat = conformal + sum((F.lit(c) * F.sin(conformal * (2.0 * (j + 1))) for j, c in enumerate(GEODETIC)), F.lit(0.0))
    return _meridian(epsg) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def to_lonlat(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of map coordinates."""
    lon, lat = _from_zone(x, y, epsg)
    sphere = F.degrees(2.0 * F.atan(F.exp(y / AXIS)) - math.pi / 2)
    pick = lambda zone, plain, web: F.when(_zone(epsg).isNotNull(), zone).when(epsg == 4326, plain).when(epsg == 3857, web)
    return pick(lon, x, F.degrees(x / AXIS)), pick(lat, y, sphere)


def from_lonlat(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Map coordinates of a longitude and a latitude in degrees."""
    east, north = _to_zone(lon, lat, epsg)
    pick = lambda zone, plain, web: F.when(_zone(epsg).isNotNull(), zone).when(epsg == 4326, plain).when(epsg == 3857, web)
    return pick(east, lon, AXIS * F.radians(lon)), pick(north, lat, AXIS * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)))


def ground_squares(df: DataFrame, side: float, x: str = "x", y: str = "y", epsg: str = "epsg") -> DataFrame:
    """df with `box`: in the map's own system the bounds of a square of `side` metres on the ground around each place.

    The square is built in the zone of the place; its corners go back to the map. Step by step in columns of their own, for
    each formula uses what the one before gives many times.
    """
    own = F.struct("*").alias("_row")
    placed = df.select(own, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(epsg).alias("_e"))
    placed = placed.withColumns(dict(zip(("_lon", "_lat"), to_lonlat(F.col("_x"), F.col("_y"), F.col("_e")))))
    placed = placed.withColumn("_zone", zone_code(F.col("_lon"), F.col("_lat")))
    placed = placed.withColumns(dict(zip(("_east", "_north"), from_lonlat(F.col("_lon"), F.col("_lat"), F.col("_zone")))))
    pair = lambda xy: F.struct(xy[0].alias("x"), xy[1].alias("y"))
    corners = F.array(*(pair((F.col("_east") + a * side / 2, F.col("_north") + b * side / 2)) for a in (-1, 1) for b in (-1, 1)))
    placed = placed.withColumn("_corners", F.transform(corners, lambda c: pair(to_lonlat(c["x"], c["y"], F.col("_zone")))))
    placed = placed.withColumn("_corners", F.transform("_corners", lambda c: pair(from_lonlat(c["x"], c["y"], F.col("_e")))))
    side_of = lambda k, pick: pick(F.transform("_corners", lambda c: c[k]))
    box = F.struct(*(side_of(k, pick).alias(f"{k}{name}") for name, pick in (("min", F.array_min), ("max", F.array_max)) for k in "xy"))
    return placed.select("_row.*", box.alias("box"))
