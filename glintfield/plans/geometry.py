"""Geometry queries over suppliers and customers as targets on the ellipsoid."""

from __future__ import annotations

from glintfield.functions import geometry as g
from glintfield.functions.steps import Step, apply_steps, doubles, steps_sql
from glintfield.session import table

#: Deterministic targets: (table, key, balance).
AIM_SOURCE = {
    "supplier": "SELECT s_suppkey AS key, CAST(s_suppkey*37%179-89 AS DOUBLE) AS lat, CAST(s_suppkey*53%359-179 AS DOUBLE) AS lon, s_acctbal/10.0 AS h FROM supplier",
    "customer": "SELECT c_custkey AS key, CAST(c_custkey*37%179-89 AS DOUBLE) AS lat, CAST(c_custkey*53%359-179 AS DOUBLE) AS lon, c_acctbal/10.0 AS h FROM customer",
}
SENSOR: list[Step] = [{"lat_p": "lat+5.0", "lon_p": "lon+5.0", "h_p": "h+550000.0"}, *g.to_ecef("aim", "lat", "lon", "h"), *g.to_ecef("p", "lat_p", "lon_p", "h_p"), {"vel_x": "1000.0", "vel_y": "7000.0", "vel_z": "-500.0"}]
VIEW = [*SENSOR, *g.view_geometry("aim", "p", "vel")]
DEGREES: Step = {f"deg_{a}": f"degrees({a})" for a in g.ANGLES}
INCIDENCE: Step = {"incidence": "90.0-deg_graze"}


def rounded(names: dict[str, int], *plain: str) -> str:
    return ", ".join([*plain, *(f"round({n}, {d})+0.0 AS {n}" for n, d in names.items())])


#: name -> (source, steps, result columns)
CHAINS: dict[str, tuple[str, list[Step], str]] = {
    "ecef": ("supplier", g.to_ecef("aim", "lat", "lon", "h"), rounded({"aim_x": 3, "aim_y": 3, "aim_z": 3}, "key")),
    "geodetic": ("supplier", [*g.to_ecef("aim", "lat", "lon", "h"), *g.to_geodetic("g", "aim")], rounded({"g_lat": 9, "g_lon": 9}, "key")),
    "ellipsoid_normal": ("supplier", [*g.to_ecef("aim", "lat", "lon", "h"), *g.ellipsoid_normal("n", "aim")], rounded({"n_x": 9, "n_y": 9, "n_z": 9}, "key")),
    "view_geometry": ("supplier", [*VIEW, g.side_and_node("vel")], rounded({a: 7 for a in g.ANGLES}, "key", "sense", "look_side", "orbital_node")),
    "view_geometry_degrees": ("customer", [*VIEW, DEGREES], rounded({f"deg_{a}": 5 for a in g.ANGLES}, "key")),
    "incidence": ("customer", [*VIEW, DEGREES, INCIDENCE], rounded({"incidence": 6}, "key")),
    "rotation": ("customer", [*VIEW, DEGREES, g.rotations()], rounded({"shadows_down": 5, "layover_up": 5, "north_up": 5}, "key")),
    "mandala": ("customer", [*VIEW, DEGREES, INCIDENCE, *g.mandala()], rounded({"arm_layover": 5, "arm_shadow": 5, "arm_track": 5, "len_layover": 5, "len_shadow": 5}, "key")),
    "height_ruler": ("customer", [*VIEW, DEGREES, INCIDENCE, *g.height_ruler("(key % 120 + 0.5)", "incidence", "deg_graze")], rounded({"ruler_len": 4, "height": 4, "shadow_len": 4}, "key")),
    "ruler_step": ("customer", [*VIEW, DEGREES, INCIDENCE, {"spacing": "(CASE WHEN key % 7 = 0 THEN 1.0 ELSE key % 7 * 0.5 END)", "is_slc": "key % 2 = 0"}, {"step": "(CASE WHEN is_slc THEN spacing/sin(radians(incidence)) ELSE spacing END)*(CASE WHEN key % 3 = 0 THEN 10.0 ELSE 1.0 END)"}], rounded({"step": 6}, "key", "is_slc")),
    "lens_extent": ("customer", [{"size": "100.0+(key % 21)*0.05*300.0"}, *g.lens_extent("lat", "size"), {"xmin": "lon-half_lon", "xmax": "lon+half_lon", "ymin": "lat-half_lat", "ymax": "lat+half_lat"}], rounded({"xmin": 9, "xmax": 9, "ymin": 9, "ymax": 9}, "key")),
    "utm_zone": ("customer", g.utm_zone("lat", "lon"), "key, zone, epsg"),
    "utm_square": ("customer", [*g.utm_zone("lat", "lon"), *g.transverse_mercator("lat", "lon", "zone"), {"e0": "easting-150.0", "e1": "easting+150.0", "n0": "northing-150.0", "n1": "northing+150.0"}], rounded({"e0": 3, "e1": 3, "n0": 3, "n1": 3}, "key", "zone")),
    "viewer_step": ("customer", [{"was": "0.175+(key % 14)*0.05", "direction": "(CASE WHEN key % 2 = 0 THEN 1.0 ELSE -1.0 END)"}, g.viewer_step("was", "direction")], rounded({"centre": 6}, "key")),
    "wheel_steps": ("customer", [{"delta": "(key*60 % 2100)-1020.0"}, *g.wheel_steps("delta")], "key, steps"),
    "sane_inputs": ("customer", [*SENSOR, {"vel_x": "(key % 3)*60.0", "vel_y": "(key % 5)*30.0", "vel_z": "0.0"}, g.sane_inputs("aim", "p", "vel")], "key, sane"),
    "side_and_node": ("customer", [{"sense": "key % 3-1.0", "vel_z": "(key % 5-2.0)*700.0"}, g.side_and_node("vel")], "key, look_side, orbital_node"),
    "angle_range": ("customer", [*VIEW, DEGREES, g.angles_in_range("deg_", "360.0")], "key, in_range"),
    "imaging_time": ("customer", [{"full": "key % 900+100.0", "part": "key % 90+1.0"}, {"seconds": "part/full*(key % 7+1.5)"}], rounded({"seconds": 9}, "key")),
    "export_size": ("customer", [{"wide": "key % 4000 + 1.0", "high": "key*7 % 3000 + 1.0", "f": "(key % 100 + 1.0)/100.0"}, g.export_size("wide", "high", "f")], "key, out_w, out_h"),
    "frame_delay": ("customer", g.frame_delay("(key % 30)"), "key, delay_cs"),
    "local_incidence": ("customer", [*VIEW, DEGREES, INCIDENCE, {"scene_inc": "(CASE WHEN key % 3 = 0 THEN 0.0 ELSE 20.0+key % 30 END)"}, g.local_incidence("scene_inc", "incidence", "key % 2 = 0")], rounded({"incidence_used": 6}, "key")),
    "overlay_place": ("customer", [{"x": "key*13 % 1900+0.0", "y": "key*17 % 1060+0.0"}, g.overlay_place("x", "y", "350.0", "1920.0", "1080.0")], rounded({"left_px": 3, "top_px": 3}, "key")),
    "ruler_orientation": ("customer", [*VIEW, DEGREES, {"rot": "deg_layover-deg_north-90.0"}], rounded({"rot": 6}, "key")),
}


def _query(name: str):
    source, steps, final = CHAINS[name]

    def run(spark, sf_dir):
        table(spark, sf_dir, source).createOrReplaceTempView(source)
        aims = spark.sql(doubles(AIM_SOURCE[source]))
        return apply_steps(aims, steps).selectExpr(*_split(doubles(final)))

    return run


def _split(final: str) -> list[str]:
    """Top-level commas of a select list."""
    parts, depth, here = [], 0, ""
    for ch in final:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(here)
            here = ""
        else:
            here += ch
    return [*parts, here]


QUERIES = {name: _query(name) for name in CHAINS}

# The SQL twins of the view angles are written from rotations by longitude and normal latitude, not from the chain above.
_ECEF_SQL = "({n}+{h})*cos(radians({lat}))*cos(radians({lon})) AS {p}x, ({n}+{h})*cos(radians({lat}))*sin(radians({lon})) AS {p}y, (6356752.314245*6356752.314245/40680631590769.0*{n}+{h})*sin(radians({lat})) AS {p}z"
_N_SQL = "6378137.0/sqrt(1-(1-6356752.314245*6356752.314245/40680631590769.0)*sin(radians({lat}))*sin(radians({lat})))"


def _view_sql(source: str) -> str:
    """key, lat, lon, h, sense, velocity and the twelve angles of a source's targets."""
    places = ", ".join(_ECEF_SQL.format(n=_N_SQL.format(lat=lat), lat=lat, lon=lon, h=h, p=p) for lat, lon, h, p in (("lat", "lon", "h", "a"), ("(lat+5.0)", "(lon+5.0)", "(h+550000.0)", "p")))
    split = lambda name, x, y, z: f"-sin(la)*{x}+cos(la)*{y} AS {name}e, -sin(be)*cos(la)*{x}-sin(be)*sin(la)*{y}+cos(be)*{z} AS {name}n, cos(be)*cos(la)*{x}+cos(be)*sin(la)*{y}+sin(be)*{z} AS {name}u"
    return f"""WITH src AS ({AIM_SOURCE[source]}),
c AS (SELECT *, {places}, 1000.0 AS vel_x, 7000.0 AS vel_y, -500.0 AS vel_z FROM src),
f AS (SELECT *, px-ax AS lx, py-ay AS ly, pz-az AS lz, atan2(ay, ax) AS la, atan2(az/(6356752.314245179*6356752.314245179), sqrt(ax*ax+ay*ay)/40680631590769.0) AS be, atan2(py, px) AS pla, atan2(pz, sqrt(px*px+py*py)) AS pbe FROM c),
g AS (SELECT *, {split('l', 'lx', 'ly', 'lz')}, {split('v', 'vel_x', 'vel_y', 'vel_z')},
        -(-sin(pla)*lx+cos(pla)*ly) AS be_e, -(-sin(pbe)*cos(pla)*lx-sin(pbe)*sin(pla)*ly+cos(pbe)*lz) AS be_n,
        -sin(pla)*vel_x+cos(pla)*vel_y AS ve_e, -sin(pbe)*cos(pla)*vel_x-sin(pbe)*sin(pla)*vel_y+cos(pbe)*vel_z AS ve_n FROM f),
k AS (SELECT *, sqrt(le*le+ln*ln+lu*lu) AS l, sqrt(ve*ve+vn*vn+vu*vu) AS v, ln*vu-lu*vn AS ke, lu*ve-le*vu AS kn, le*vn-ln*ve AS ku FROM g),
m AS (SELECT *, CAST(sign(ku) AS DOUBLE) AS sense, sqrt(ke*ke+kn*kn+ku*ku) AS kk FROM k),
w AS (SELECT *, asin(lu/l) AS graze, acos(abs(ku)/kk) AS slope, asin(sense*(le*kn-ln*ke)/sqrt((le*le+ln*ln)*(ke*ke+kn*kn))) AS layover FROM m),
t AS (SELECT *, -acos(least(1, cos(slope)/cos(graze)))*sign(layover) AS tilt FROM w)
SELECT key, lat, lon, h, sense, vel_x, vel_y, vel_z, graze, slope, layover, tilt,
       CASE WHEN atan2(le, ln) < -1e-12 THEN atan2(le, ln)+2*pi() ELSE greatest(atan2(le, ln), 0) END AS azimuth,
       CASE WHEN atan2(-le, ln) < -1e-12 THEN atan2(-le, ln)+2*pi() ELSE greatest(atan2(-le, ln), 0) END AS north,
       atan2(ve_e*be_n-ve_n*be_e, ve_e*be_e+ve_n*be_n) AS squint,
       -sense*acos(-(le*ve+ln*vn+lu*vu)/(l*v)) AS dca,
       -sense*acos(greatest(-1, least(1, -(le*ve+ln*vn)/sqrt((le*le+ln*ln)*(ve*ve+vn*vn))))) AS track,
       asin(vu/v) AS felev, -atan(tan(tilt)*sin(graze)) AS multipath, CASE WHEN lu > 0 THEN pi() ELSE 0 END AS shadow FROM t"""


def _twin(name: str) -> str:
    source, steps, final = CHAINS[name]
    if steps[: len(VIEW)] == VIEW:
        return steps_sql(_view_sql(source), steps[len(VIEW) :], final)
    return steps_sql(AIM_SOURCE[source], steps, final)


ORACLE_SQL = {name: _twin(name) for name in CHAINS}
ORACLE_SQL["side_and_node"] = "SELECT c_custkey AS key, ['right', 'unknown', 'left'][c_custkey%3+1] AS look_side, ['descending', 'descending', 'unknown', 'ascending', 'ascending'][c_custkey%5+1] AS orbital_node FROM customer"
ORACLE_SQL["sane_inputs"] = "SELECT c_custkey AS key, sqrt(pow(c_custkey%3*60.0, 2)+pow(c_custkey%5*30.0, 2)) > 100 AS sane FROM customer"
ORACLE_SQL["wheel_steps"] = "WITH d AS (SELECT c_custkey AS key, c_custkey*60%2100-1020 AS d FROM customer)\nSELECT key, CAST(CASE WHEN d=0 THEN 0 ELSE sign(d)*greatest(abs(round_even(d/120.0, 0)), 1) END AS INT) AS steps FROM d"
ORACLE_SQL["angle_range"] = "SELECT key, " + " AND ".join(f"abs(deg_{a}) <= 360" for a in g.ANGLES if a != "felev") + f" AS in_range FROM ({ORACLE_SQL['view_geometry_degrees']})"
ORACLE_SQL["imaging_time"] = "SELECT c_custkey AS key, round((c_custkey%90+1)/(c_custkey%900+100)*(c_custkey%7+1.5e0), 9)+0.0 AS seconds FROM customer"
