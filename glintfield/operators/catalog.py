"""Scene metadata, layers and the catalogue tree as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintfield.session import settled


def filled(value: Column) -> Column:
    """Null for empty text."""
    return F.nullif(value, F.lit(""))


def vendor_layer(name: Column, source: Column, token: str) -> Column:
    return name.startswith(token) | F.element_at(F.split(source, "/"), -1).contains(token)


def layer_style(name: Column, vendor: Column) -> Column:
    """Whether a new layer gets the default style: the vendor's, but no colour composites and no quick looks."""
    return vendor & ~name.rlike("COLOR|CSI|QLK")


def layer_timing(name: Column, vendor: Column, bands: Column) -> Column:
    """How a new layer is timed: none, per_band or fixed."""
    plain = F.when(~vendor | name.rlike("COLOR|CSI"), "none")
    return plain.when(name.rlike("VID|SHORT") | (name.contains("FOCUS") & (bands > 2)), "per_band").otherwise("fixed")


def derived_layer(name: Column) -> Column:
    return name.rlike("SHORT|CROP|FOCUS|COLOR")


#: Scheme, authority, path, query and fragment of a reference (RFC 3986, appendix B). Fixed value.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def _without_dots(segments: Column) -> Column:
    """Path segments after . and .. are followed; a path that ends in one of them ends in a slash."""
    start = F.array().cast("array<string>")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.slice(done, 1, 1))
    walked = F.aggregate(segments, start, lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.array_append(done, x)))
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)


def resolve_url(base: Column, href: Column) -> Column:
    """A reference against its base, by RFC 3986: absolute ones stay, the others take scheme, authority, folder and query of the base as needed."""
    b_scheme, b_site, b_path, b_query, _ = (F.regexp_extract(base, PARTS, k) for k in range(1, 6))
    scheme, site, path, query, _ = (F.regexp_extract(href, PARTS, k) for k in range(1, 6))
    tail = F.regexp_extract(href, r"(#[\s\S]+)$", 1)
    folder = F.when(F.endswith(b_path, F.lit("/")), F.split(b_path, "/")).otherwise(F.slice(F.split(b_path, "/"), 1, F.greatest(F.size(F.split(b_path, "/")) - 1, F.lit(1))))
    joined = F.when(F.startswith(path, F.lit("/")), F.split(path, "/")).otherwise(F.concat(folder, F.split(path, "/")))
    n = F.size(joined)
    inner = F.filter(F.slice(joined, 2, F.greatest(n - 2, F.lit(0))), lambda x: x != "")
    kept = F.when(n > 2, F.concat(F.slice(joined, 1, 1), inner, F.slice(joined, n, 1))).otherwise(joined)
    whole = F.array_join(_without_dots(kept), "/")
    asked = lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")
    start = F.concat(b_scheme, F.lit("://"), F.when(site != "", site).otherwise(b_site))
    relative = (
        F.when(site != "", F.concat(start, path, asked(query)))
        .when(path == "", F.concat(start, b_path, asked(F.when(query != "", query).otherwise(b_query))))
        .otherwise(F.concat(start, F.when(F.startswith(whole, F.lit("/")), whole).otherwise(F.concat(F.lit("/"), whole)), asked(query)))
    )
    return F.when(href == "", base).when((scheme != "") | (b_scheme == ""), href).otherwise(F.concat(relative, tail))


def id_from_href(href: Column) -> Column:
    """Last path segment without .json; the href itself if that is empty."""
    last = F.regexp_replace(F.element_at(F.split(F.regexp_replace(href, r"[?#].*$", ""), "/"), -1), r"\.json$", "")
    return F.coalesce(filled(last), href)


def file_name(url: Column, item: Column, fallback: str = "slc") -> Column:
    """Name of a download: the path's last segment (slashes at its end do not count), else item.tif, else fallback.tif; .tif where it has no dot."""
    path = F.regexp_replace(F.regexp_extract(url, PARTS, 3), r"(/\.?)+$", "")
    base = filled(F.element_at(F.split(path, "/"), -1))
    return F.when(base.isNull(), F.concat(F.coalesce(filled(item), F.lit(fallback)), F.lit(".tif"))).when(base.contains("."), base).otherwise(F.concat(base, F.lit(".tif")))


def pick_asset(assets: Column, keys: tuple[str, ...], words: tuple[str, ...]) -> Column:
    """The asset under the first present key, else the first whose title has a word and whose type is a tiff."""
    titled = F.filter(F.map_values(assets), lambda a: F.lower(a["title"]).rlike("|".join(words)) & F.lower(a["type"]).contains("tiff"))
    return F.coalesce(*(F.try_element_at(assets, F.lit(k)) for k in keys), F.get(titled, 0))


def visible_nodes(nodes: DataFrame, text: str | None, most_levels: int = 32) -> DataFrame:
    """nodes(id, parent, label) with `visible`: itself or any descendant matches the stripped text, whatever its case; an empty text shows all.

    Each round lifts the matches by one level; a tree deeper than `most_levels` is an error.
    """
    wanted = (text or "").strip().lower()
    if not wanted:
        return nodes.withColumn("visible", F.lit(True))
    shown = settled(nodes.where(F.lower("label").contains(wanted)).select("id"))
    edge = shown
    for _ in range(most_levels):
        above = nodes.join(edge, "id").where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
        edge = settled(above.join(shown, "id", "left_anti"))
        if edge.isEmpty():
            break
        shown = settled(shown.union(edge))
    else:
        raise ValueError(f"more than {most_levels} levels")
    seen = shown.distinct().withColumn("visible", F.lit(True))
    return nodes.join(seen, "id", "left").select("id", "parent", "label", F.coalesce("visible", F.lit(False)).alias("visible"))


def bbox_ring(bbox: Column) -> Column:
    """A closed ring of five points, null for fewer than four numbers."""
    b = [F.get(bbox, k) for k in range(4)]
    corners = [(b[0], b[1]), (b[0], b[3]), (b[2], b[3]), (b[2], b[1]), (b[0], b[1])]
    return F.when(F.size(bbox) >= 4, F.array(*(F.array(x, y) for x, y in corners)))


def product_name(name: Column, extent: Column) -> Column:
    """Name of a crop: the part before _CROP_, else without its last token; then _CROP_ and eight digits of the extent's SHA-1."""
    stem = F.when(name.contains("_CROP_"), F.substring_index(name, "_CROP_", 1)).otherwise(F.regexp_replace(name, r"_[^_]*$", ""))
    return F.concat(stem, F.lit("_CROP_"), F.substring(F.sha1(extent.cast("binary")), 1, 8))


def falling_edges(events: DataFrame, key: str, order: str, wanted: str) -> DataFrame:
    """Rows at which a control goes from on to off."""
    along = Window.partitionBy(key).orderBy(order)
    return events.withColumn("_was", F.lag(wanted).over(along)).where(F.col("_was") & ~F.col(wanted)).drop("_was")


#: GeoJSON geometry types by their lower-case names. Fixed values.
GEOMETRIES = {x.lower(): x for x in ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")}


def geometry_type(geometry: Column) -> Column:
    """The layer type of a GeoJSON text; GeometryCollection where it names none that is known."""
    known = F.create_map(*(F.lit(x) for pair in GEOMETRIES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.coalesce(F.get_json_object(geometry, "$.type"), F.lit("unknown")))), F.lit("GeometryCollection"))


def footprint(items: DataFrame) -> DataFrame:
    """items(id, collection, geometry, bbox, datetime): one feature each, by its geometry, else its box; `status` tells which, or none."""
    ring = bbox_ring(F.col("bbox"))
    boxed = F.when(ring.isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))
    own = F.when(F.get_json_object("geometry", "$.type").isNotNull(), F.col("geometry"))
    status = F.when(own.isNotNull(), "geometry").when(boxed.isNotNull(), "bbox").otherwise("rejected")
    shape = F.coalesce(own, boxed)
    return items.select("id", "collection", "datetime", shape.alias("shape"), F.when(shape.isNotNull(), geometry_type(shape)).alias("kind"), F.coalesce(filled(F.col("id")), F.lit("STAC Item")).alias("layer"), status.alias("status"))


def load_plan(items: DataFrame, keys: tuple[str, ...], words: tuple[str, ...], fallback: str = "slc") -> DataFrame:
    """items(id, assets): what to download, as (id, url, file, error); the error says why there is nothing to."""
    chosen = items.select("id", pick_asset(F.col("assets"), keys, words).alias("a"))
    url = filled(F.col("a.href"))
    error = F.when(F.col("a").isNull(), "no asset").when(url.isNull(), "no href").when(~url.startswith("https://"), "not https")
    return chosen.select("id", F.when(error.isNull(), url).alias("url"), F.when(error.isNull(), file_name(url, F.col("id"), fallback)).alias("file"), error.alias("error"))


#: Lens modes that need single-look complex data. Fixed values.
SLC_MODES = ("2d_spectrum", "azimuth_viewer", "color", "range_spectrum", "range_viewer", "spectrum")


def mode_uses_slc(mode: Column) -> Column:
    return mode.isin(*SLC_MODES)


def tool_policy(session: Column, has_metadata: Column, slc_cog: Column) -> dict[str, Column]:
    """Which of a tool's actions are on: the toggle with metadata, the plain mode in a session too, the others in a session over SLC-COG layers."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    return {"toggle": yes(has_metadata), "normal": yes(session) & yes(has_metadata), "slc": yes(session) & yes(slc_cog)}


def renamed_product(name: Column, token: str) -> Column:
    """The name of what is derived from a crop: its _CROP_ token becomes _FOCUS_, _COLOR_ or _SHORT_."""
    return F.replace(name, F.lit("_CROP_"), F.lit(f"_{token}_"))


def can_be_source(is_raster: Column, has_metadata: Column, name: Column) -> Column:
    """Whether a layer can feed a batch: a raster with metadata that is no product of one."""
    return is_raster & has_metadata & ~derived_layer(name)
