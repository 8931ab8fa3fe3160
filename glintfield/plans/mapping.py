"""Places on maps: reference systems both ways, ground squares, control points."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintfield.functions import mapping
from glintfield.operators.control_points import map_corners, map_to_pixel
from glintfield.plans.spectra import rounded
from glintfield.session import table
from glintfield.sources import areas, catalogs


def _places(spark, sf_dir):
    """Customers as places between 78 degrees south and 78 north, in one of four systems each."""
    key = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(key.alias("key"), (key * 53 % 35900 / 100.0 - 179.5).alias("lon"), (key * 37 % 15601 / 100.0 - 78.0).alias("lat"))
    key, own = F.col("key"), mapping.zone_code(F.col("lon"), F.col("lat"))
    beside = F.when(own % 100 < 60, own + 1).otherwise(own - 1)
    return at.withColumn("epsg", F.when(key % 4 == 0, 4326).when(key % 4 == 1, 3857).when(key % 4 == 2, own).otherwise(beside))


def _on_map(spark, sf_dir):
    x, y = mapping.from_lonlat(F.col("lon"), F.col("lat"), F.col("epsg"))
    return _places(spark, sf_dir).select("key", "epsg", x.alias("x"), y.alias("y"))


def map_forward(spark, sf_dir):
    """Coordinates of the places in their systems, a millimetre."""
    return rounded(_on_map(spark, sf_dir), x=4, y=4)


def map_back(spark, sf_dir):
    """From there back to longitude and latitude."""
    lon, lat = mapping.to_lonlat(F.col("x"), F.col("y"), F.col("epsg"))
    return rounded(_on_map(spark, sf_dir).select("key", lon.alias("lon"), lat.alias("lat")), lon=7, lat=7)


def ground_squares(spark, sf_dir):
    """Boxes of squares of 300 metres around the places, in the map's system, in degrees or metres."""
    boxes = mapping.ground_squares(_on_map(spark, sf_dir).where("epsg IN (4326, 3857)"), 300.0)
    return rounded(boxes.select("key", "box.*"), xmin=6, ymin=6, xmax=6, ymax=6)


def _points(spark, sf_dir):
    """Suppliers as scenes with four control points: 2 map units a pixel, turned by a quarter of that."""
    spots = F.explode(F.array(*(F.struct(F.lit(float(c)).alias("pixel"), F.lit(float(r)).alias("line")) for c, r in ((0, 0), (400, 0), (0, 300), (400, 300)))))
    at = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene_id"), spots.alias("p")).select("scene_id", "p.*")
    return at.select(F.col("scene_id").cast("string").alias("scene_id"), "pixel", "line", (1000.0 + F.col("scene_id") + 2 * F.col("pixel") + 0.5 * F.col("line")).alias("x"), (5000.0 - 2 * F.col("line") + 0.5 * F.col("pixel")).alias("y"))


def click_pixels(spark, sf_dir):
    """The pixel under each click on a map; clicks on scenes without control points are dropped."""
    key = F.col("c_custkey")
    spot = table(spark, sf_dir, "customer").select(key.alias("click"), (key % 200).alias("scene_id"), (key % 390 + 0.3).alias("c"), (key * 7 % 290 + 0.7).alias("r"))
    clicks = spot.select("click", F.col("scene_id").cast("string").alias("scene_id"), (1000.0 + F.col("scene_id") + 2 * F.col("c") + 0.5 * F.col("r")).alias("x"), (5000.0 - 2 * F.col("r") + 0.5 * F.col("c")).alias("y"))
    return map_to_pixel(clicks, _points(spark, sf_dir)).select("click", "r", "c")


def pixel_corners(spark, sf_dir):
    """The map corners of a box of pixels in each scene."""
    key = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select(key.cast("string").alias("scene_id"), (key % 50).alias("xmin"), (key % 40).alias("ymin"), (key % 50 + 60).alias("xmax"), (key % 40 + 30).alias("ymax"))
    return rounded(map_corners(boxes, _points(spark, sf_dir)).select("scene_id", "corner", "x", "y"), x=4, y=4)


def kml_areas(spark, sf_dir):
    """Suppliers' areas from KML texts with namespaces, attributes and several placemarks, as boxes in degrees and on a zone's map."""
    key = F.col("s_suppkey")
    lon, lat = key % 170 + 0.25, key % 70 + 0.5
    point = lambda dx, dy: F.concat_ws(",", (lon + dx).cast("string"), (lat + dy).cast("string"), F.lit("0"))
    ring = lambda *points: F.concat(F.lit("<k:Placemark id='a'><k:Polygon><k:outerBoundaryIs><k:LinearRing><k:coordinates x='1'>\n "), F.concat_ws(" \n", *points), F.lit(" </k:coordinates></k:LinearRing></k:outerBoundaryIs></k:Polygon></k:Placemark>"))
    second = F.when(key % 3 == 0, ring(point(0.5, 0.5), point(1.25, 0.75), point(0.5, 0.75))).otherwise(F.lit("<k:Placemark><k:Polygon/></k:Placemark>"))
    text = F.concat(F.lit("<?xml version='1.0'?><k:kml xmlns:k='http://www.opengis.net/kml/2.2'><k:Document>"), ring(point(0, 0), point(0.5, 0), point(0.5, 0.25), point(0, 0)), second, F.lit("</k:Document></k:kml>"))
    texts = table(spark, sf_dir, "supplier").select(key.alias("key"), F.when(key % 7 == 0, F.lit("<kml/>")).otherwise(text).alias("value"))
    return rounded(areas.boxes(areas.kml_rings(texts), "key"), xmin=6, ymin=6, xmax=6, ymax=6)


def mask_extents(spark, sf_dir):
    """Polygons in degrees as boxes on the web's map; lines and empty rings have none."""
    key = F.col("c_custkey")
    x, y = key % 300 - 150.0, key % 120 - 60.0
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    flat = F.array(corner(0, 0), corner(1, 0))
    ring = F.when(key % 5 == 0, flat).when(key % 7 == 0, F.slice(flat, 1, 0)).otherwise(F.array(corner(0, 0), corner(0.5, 1), corner(1, 0.25), corner(0, 0)))
    features = table(spark, sf_dir, "customer").select(key.alias("feature_id"), ring.alias("ring"))
    return rounded(areas.polygon_extents(features, F.lit(3857)), xmin=4, ymin=4, xmax=4, ymax=4)


def catalogue_tree(spark, sf_dir):
    """Regions as catalogues of nations, nations as collections of suppliers: every item with its collection, label and url."""
    link = lambda rel, href, title: F.struct(rel.alias("rel"), href.alias("href"), title.alias("title"), F.lit(None).cast("string").alias("id"), F.lit("application/json").alias("type"))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    child = link(F.when(F.col("n_nationkey") % 4 == 0, "collection").when(F.col("n_nationkey") % 4 == 3, "self").otherwise("child"), F.concat(F.lit("./n"), "n_nationkey", F.lit("/collection.json")), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    tops = nation.groupBy(F.concat(F.lit("https://h/r"), "n_regionkey", F.lit("/catalog.json")).alias("url")).agg(F.collect_list(child).alias("links"))
    key = F.col("s_suppkey")
    href = F.when(key % 5 == 0, None).when(key % 5 == 1, F.concat(F.lit("https://o/p/i"), key, F.lit(".json"))).otherwise(F.concat(F.lit("../items/i"), key, F.lit(".json")))
    item = link(F.lit("item"), href, F.when(key % 3 == 0, F.col("s_name")))
    below = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.concat(F.lit("https://h/r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/collection.json")).alias("url")).agg(F.collect_list(item).alias("links"))
    return catalogs.tree(tops, below)


QUERIES = {f.__name__: f for f in (map_forward, map_back, ground_squares, click_pixels, pixel_corners, kml_areas, mask_extents, catalogue_tree)}


def _series(c: tuple, f: str, g: str, x: str, y: str) -> str:
    return "+".join(f"({v!r})*{f}({2 * k + 2}*{x})*{g}({2 * k + 2}*{y})" for k, v in enumerate(c))


_PLACES = """pl AS (SELECT c_custkey AS key, c_custkey*53%35900/100.0e0-179.5 AS lon, c_custkey*37%15601/100.0e0-78.0 AS lat FROM customer),
pz AS (SELECT *, CAST(least(greatest(floor((lon+180)/6)+1, 1), 60) AS INT)+CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS own FROM pl),
pe AS (SELECT *, CASE key%4 WHEN 0 THEN 4326 WHEN 1 THEN 3857 WHEN 2 THEN own ELSE CASE WHEN own%100 < 60 THEN own+1 ELSE own-1 END END AS epsg FROM pz)"""
_E = f"{2 * mapping.N**0.5 / (1 + mapping.N)!r}"
_K = f"{mapping.SCALE * mapping.RADIUS!r}"


def _ahead(source: str, name: str, code: str) -> str:
    """Easting and northing (en, nn) of lon, lat in the zone `code`."""
    return f"""{name}a AS (SELECT *, radians(lon-(6*({code}%100)-183)) AS w, sinh(atanh(sin(radians(lat)))-{_E}*atanh({_E}*sin(radians(lat)))) AS t FROM {source}),
{name}b AS (SELECT *, atan2(t, cos(w)) AS u, atanh(sin(w)/sqrt(1+t*t)) AS v FROM {name}a),
{name} AS (SELECT *, 500000+{_K}*(v+{_series(mapping.FORWARD, "cos", "sinh", "u", "v")}) AS en, CASE WHEN {code} > 32700 THEN 10000000 ELSE 0 END+{_K}*(u+{_series(mapping.FORWARD, "sin", "cosh", "u", "v")}) AS nn FROM {name}b)"""


ORACLE_SQL = {
    "map_forward": f"""WITH {_PLACES},
{_ahead("pe", "f", "epsg")}
SELECT key, CAST(epsg AS INT) AS epsg, round(CASE epsg WHEN 4326 THEN lon WHEN 3857 THEN 6378137*radians(lon) ELSE en END, 4)+0.0 AS x, round(CASE epsg WHEN 4326 THEN lat WHEN 3857 THEN 6378137*ln(tan(pi()/4+radians(lat)/2)) ELSE nn END, 4)+0.0 AS y FROM f""",
    # There and back is where it was.
    "map_back": f"WITH {_PLACES}\nSELECT key, round(lon, 7)+0.0 AS lon, round(lat, 7)+0.0 AS lat FROM pe",
    "ground_squares": f"""WITH {_PLACES},
{_ahead("(SELECT * FROM pe WHERE key%4 < 2)", "f", "own")},
c AS (SELECT key, epsg, own, en+i*150 AS ce, nn+j*150 AS cn FROM f, (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) q(i, j)),
g AS (SELECT *, (cn-CASE WHEN own > 32700 THEN 10000000 ELSE 0 END)/{_K} AS a, (ce-500000)/{_K} AS b FROM c),
h AS (SELECT *, a-({_series(mapping.BACK, "sin", "cosh", "a", "b")}) AS u, b-({_series(mapping.BACK, "cos", "sinh", "a", "b")}) AS v FROM g),
m AS (SELECT key, epsg, 6*(own%100)-183+degrees(atan2(sinh(v), cos(u))) AS lon, asin(sin(u)/cosh(v)) AS s FROM h),
d AS (SELECT key, epsg, lon, degrees(s+{"+".join(f"({v!r})*sin({2 * k + 2}*s)" for k, v in enumerate(mapping.GEODETIC))}) AS lat FROM m),
o AS (SELECT key, CASE epsg WHEN 4326 THEN lon ELSE 6378137*radians(lon) END AS x, CASE epsg WHEN 4326 THEN lat ELSE 6378137*ln(tan(pi()/4+radians(lat)/2)) END AS y FROM d)
SELECT key, round(min(x), 6)+0.0 AS xmin, round(min(y), 6)+0.0 AS ymin, round(max(x), 6)+0.0 AS xmax, round(max(y), 6)+0.0 AS ymax FROM o GROUP BY key""",
    "click_pixels": "SELECT c_custkey AS click, CAST(c_custkey*7%290+1 AS INT) AS r, CAST(c_custkey%390 AS INT) AS c FROM customer WHERE c_custkey%200 IN (SELECT s_suppkey FROM supplier)",
    "pixel_corners": """SELECT CAST(s_suppkey AS VARCHAR) AS scene_id, CAST(k AS INT) AS corner, round(1000.0e0+s_suppkey+2*(s_suppkey%50+dx)+0.5e0*(s_suppkey%40+dy), 4)+0.0 AS x, round(5000.0e0-2*(s_suppkey%40+dy)+0.5e0*(s_suppkey%50+dx), 4)+0.0 AS y
FROM supplier CROSS JOIN (VALUES (0, 0, 0), (1, 60, 0), (2, 60, 30), (3, 0, 30)) q(k, dx, dy)""",
    "kml_areas": """WITH s AS (SELECT s_suppkey AS key, s_suppkey%170+0.25e0 AS x, s_suppkey%70+0.5e0 AS y, s_suppkey%3=0 AS two FROM supplier WHERE s_suppkey%7<>0)
SELECT key, round(x, 6)+0.0 AS xmin, round(y, 6)+0.0 AS ymin, round(x+CASE WHEN two THEN 1.25e0 ELSE 0.5e0 END, 6)+0.0 AS xmax, round(y+CASE WHEN two THEN 0.75e0 ELSE 0.25e0 END, 6)+0.0 AS ymax FROM s""",
    "mask_extents": """WITH c AS (SELECT c_custkey AS feature_id, c_custkey%300-150.0e0 AS x, c_custkey%120-60.0e0 AS y FROM customer WHERE c_custkey%5<>0 AND c_custkey%7<>0)
SELECT feature_id, round(6378137*radians(x), 4)+0.0 AS xmin, round(6378137*ln(tan(pi()/4+radians(y)/2)), 4)+0.0 AS ymin, round(6378137*radians(x+1), 4)+0.0 AS xmax, round(6378137*ln(tan(pi()/4+radians(y+1)/2)), 4)+0.0 AS ymax FROM c""",
    "catalogue_tree": """SELECT CASE WHEN n_nationkey%2=0 THEN n_name ELSE 'collection' END AS collection, CASE WHEN s_suppkey%3=0 THEN s_name ELSE 'i' || s_suppkey END AS item,
  CASE WHEN s_suppkey%5=1 THEN 'https://o/p/i' || s_suppkey || '.json' ELSE 'https://h/r' || n_regionkey || '/items/i' || s_suppkey || '.json' END AS item_url
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey%5<>0 AND n_nationkey%4<>3""",
}
