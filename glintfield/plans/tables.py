"""Time, text, tone, catalogue and batch queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintfield.functions import timespan, tone
from glintfield.functions.steps import apply_steps, doubles, steps_sql
from glintfield.operators import batch, catalog
from glintfield.operators.folds import quantiles
from glintfield.operators.spectral import unpacked
from glintfield.plans.spectra import rounded
from glintfield.session import table
from glintfield.sources import rasters, scenes
from glintfield.sources.chips import PX_SQL, lines_from_embeddings

BANDS = 4


def _spans(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(timespan.micros(F.col("ts"))).alias("start_us"), F.max(timespan.micros(F.col("ts"))).alias("end_us"))


def acquisition_span(spark, sf_dir):
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return rounded(spans.select("user_id", timespan.span_seconds(F.col("a"), F.col("b")).alias("seconds")), seconds=6)


def band_ranges(spark, sf_dir):
    return timespan.band_ranges(_spans(spark, sf_dir), "user_id", BANDS)


def rows_per_band(spark, sf_dir):
    timed = table(spark, sf_dir, "events").select("user_id", timespan.micros(F.col("ts")).alias("t")).join(_spans(spark, sf_dir).where("end_us > start_us"), "user_id")
    band = timespan.band_of(F.col("t"), F.col("start_us"), F.col("end_us"), BANDS)
    return timed.groupBy("user_id", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def iso_parse(spark, sf_dir):
    form = F.col("event_id") % 5
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.when(form == 0, F.concat(stamp, F.lit("Z"))).when(form == 1, F.concat(stamp, F.lit("789Z"))).when(form == 2, F.lit("")).when(form == 3, F.lit("garbage")).otherwise(F.concat(F.lit("  "), stamp, F.lit("+00:00")))
    return table(spark, sf_dir, "events").select("event_id", timespan.micros(timespan.parse_iso(text)).alias("us")).where("us IS NOT NULL")


def fixed_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", timespan.micros(F.col("o_orderdate")).alias("t0"), (timespan.micros(F.col("o_orderdate")) + F.col("o_orderkey") % 90 * 1_000_000).alias("t1"))


ITEM = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _samples(spark, sf_dir):
    """Line items as samples of 256 levels."""
    return table(spark, sf_dir, "lineitem").select(*ITEM, F.pmod(F.floor("l_extendedprice"), F.lit(256)).cast("long").alias("i"))


def _tone(columns):
    def run(spark, sf_dir):
        return rounded(apply_steps(_samples(spark, sf_dir), tone.curve_steps(256)).select(*ITEM, "i", *columns), **{c: 8 for c in columns if c != "grey"})

    return run


def teal_ramp(spark, sf_dir):
    at = _samples(spark, sf_dir).selectExpr(*ITEM, "i", doubles("i/255.0 AS x"))
    return at.select(*ITEM, "i", *(F.expr(doubles(tone.ramp_channel("x", tone.TEAL_STOPS, k))).alias(name) for k, name in ((1, "red"), (2, "green"), (3, "blue"))))


def cumulative_cut(spark, sf_dir):
    return rounded(quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"low": 0.02, "high": 0.98}), low=4, high=4)


def to_db(spark, sf_dir):
    from glintfield.operators.normalize import to_db as db

    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", db(F.col("l_discount")).alias("db")), db=6)


TOKEN = "Customer"


def vendor_layer_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(catalog.vendor_layer(F.col("c_name"), F.concat(F.lit("/data/"), F.col("c_mktsegment"), F.lit(".tif")), "AUTO") | (F.col("c_custkey") % 50 == 0)).select("c_custkey", "c_name")


def layer_routing(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["COLOR", "QLK", "SHORT", "FOCUS", "SLC", "CSI", "VID"]))
    name = F.concat(F.when(F.col("p_partkey") % 4 == 0, "X_").otherwise("SAR_"), F.get(kinds, (F.col("p_partkey") % 7).cast("int")), F.lit("_"), F.col("p_partkey"))
    layers = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), (F.col("p_size") % 5 + 1).alias("bands"))
    vendor = catalog.vendor_layer(F.col("name"), F.concat(F.lit("/data/"), F.when(F.col("p_partkey") % 8 == 0, "SAR_"), F.lit("x.tif")), "SAR_")
    vendor = F.coalesce(vendor, F.col("name").startswith("SAR_"))
    return layers.select("p_partkey", "name", catalog.layer_style(F.col("name"), vendor).alias("styled"), catalog.layer_timing(F.col("name"), vendor, F.col("bands")).alias("timing"), catalog.derived_layer(F.col("name")).alias("derived"))


def _links(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(found).alias("k", "href"))


def link_extract(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


def url_resolve(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", catalog.resolve_url(F.col("url"), F.col("href")).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


def id_from_href(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", catalog.id_from_href(F.col("url")).alias("item"))


def file_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", catalog.file_name(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string"))).alias("name"))


def https_only(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("https://")).select("page_id", "url")


def _items(spark, sf_dir):
    asset = lambda title, kind: F.struct(F.concat(F.lit("https://x/"), F.col("p_partkey"), F.lit(f".{title}")).alias("href"), F.lit(title).alias("title"), F.lit(kind).alias("type"))
    form = F.col("p_partkey") % 4
    tiff = "image/tiff; application=geotiff"
    assets = F.when(form == 0, F.create_map(F.lit("slc-cog"), asset("SLC COG", tiff), F.lit("slc"), asset("SLC", tiff))).when(form == 1, F.create_map(F.lit("slc"), asset("SLC", tiff), F.lit("qlk"), asset("QLK", tiff))).when(form == 2, F.create_map(F.lit("a"), asset("Quicklook image", tiff), F.lit("b"), asset("my slc file", tiff))).otherwise(F.create_map(F.lit("meta"), asset("slc metadata", "application/json")))
    return table(spark, sf_dir, "part").select("p_partkey", assets.alias("assets"))


def asset_pick_slc(spark, sf_dir):
    return _items(spark, sf_dir).select("p_partkey", catalog.pick_asset(F.col("assets"), ("slc-cog", "slc"), ("slc",))["href"].alias("href"))


def asset_pick_qlk(spark, sf_dir):
    return _items(spark, sf_dir).select("p_partkey", catalog.pick_asset(F.col("assets"), ("qlk-cog", "qlk"), ("quicklook", "qlk"))["href"].alias("href"))


def qlk_footprint_split(spark, sf_dir):
    picked = asset_pick_qlk(spark, sf_dir)
    return picked.groupBy(F.when(F.col("href").isNotNull(), "quicklook").otherwise("footprint").alias("shown_as")).agg(F.count(F.lit(1)).alias("n"))


def catalog_filter(spark, sf_dir):
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("label"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("label"))
    return catalog.visible_nodes(regions.unionByName(nations).unionByName(suppliers), " R#000000003 ").select("id", "label", "visible")


def tool_policies(spark, sf_dir):
    """Which tools are on for a layer, in a session or out of it."""
    modes = F.array(*map(F.lit, ["normal", "focus", "spectrum", "color", "2d_spectrum", "azimuth_viewer", "range_viewer", "range_spectrum"]))
    layers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("layer"), (F.col("s_suppkey") % 3 != 0).alias("session"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 2 == 0).alias("has_metadata"), (F.col("s_suppkey") % 5 == 0).alias("slc_cog"), F.get(modes, (F.col("s_suppkey") % 8).cast("int")).alias("mode"))
    actions = catalog.tool_policy(F.col("session"), F.col("has_metadata"), F.col("slc_cog"))
    return layers.select("layer", catalog.mode_uses_slc(F.col("mode")).alias("uses_slc"), *(on.alias(name) for name, on in actions.items()))


def batch_sources(spark, sf_dir):
    """Layers that can feed a batch, with the name of the focused product."""
    name = F.concat(F.lit("SAR_"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "_CROP_ab").when(F.col("p_partkey") % 3 == 1, "_SLC").otherwise("_FOCUS_x"))
    layers = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), (F.col("p_size") % 2 == 0).alias("is_raster"), (F.col("p_size") % 5 != 0).alias("has_metadata"))
    return layers.select("p_partkey", catalog.can_be_source(F.col("is_raster"), F.col("has_metadata"), F.col("name")).alias("usable"), catalog.renamed_product(F.col("name"), "FOCUS").alias("product"))


def _footprint_items(spark, sf_dir):
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ["Polygon", "MULTIPOLYGON", "Point", "Circle"]))
    shape = F.when(k % 5 != 0, F.concat(F.lit('{"type":"'), F.get(kinds, (k % 4).cast("int")), F.lit('","coordinates":[]}')))
    x = k.cast("double")
    return table(spark, sf_dir, "part").select(F.when(k % 11 != 0, k.cast("string")).alias("id"), k.alias("p_partkey"), F.lit("c").alias("collection"), shape.alias("geometry"), F.when(k % 10 != 0, F.array(x, x, x + 1, x + 1)).alias("bbox"), F.lit("2024").alias("datetime"))


def footprints(spark, sf_dir):
    return catalog.footprint(_footprint_items(spark, sf_dir)).groupBy("status", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("layer") == "STAC Item").alias("unnamed"))


def load_plan(spark, sf_dir):
    """What would be downloaded of the items, and why not the rest."""
    items = _items(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("id"), "assets")
    return catalog.load_plan(items, ("slc-cog", "slc"), ("slc",))


def curve_ramp(spark, sf_dir):
    """Samples at the inner stops of a ramp between two colours under the logarithmic curve."""
    at = apply_steps(_samples(spark, sf_dir).where("i BETWEEN 1 AND 254"), [*tone.curve_steps(256), tone.blended("log_tone", (10, 200, 0, 255), (240, 20, 255, 55))])
    return rounded(at.select(*ITEM, "i", F.col("x").alias("offset"), "red", "green", "blue", "alpha"), offset=9)


def grey_shader(spark, sf_dir):
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return apply_steps(table(spark, sf_dir, "lineitem").select(*keys, (F.col("l_quantity") / 40.0).alias("t")), tone.shader("t")).select(*keys, F.coalesce("grey", F.lit(-1)).alias("grey"))


def _scene_rows(spark, sf_dir):
    """Suppliers as scenes with metadata in JSON; every ninth has no orbit states."""
    k = F.col("s_suppkey")
    state = lambda j: F.struct(F.array(F.lit(7e6) + k, k * 10.0 + j, F.lit(1.0) * j).alias("position"), F.array(F.lit(100.0), F.lit(7500.0), k * 1.0).alias("velocity"))
    own = [F.lit("2024-01-02T03:04:05Z").alias("datetime"), F.lit("SLC-COG").alias("sar:product_type"), F.struct((k % 80 * 1.0).alias("lat"), (k % 170 * 1.0).alias("lon")).alias("proj:centroid"), (k % 9 * 0.5).alias("v:squint_angle"), F.when(k % 9 != 0, F.array(*(state(j) for j in range(4)))).alias("v:orbit_states"), F.lit(1).alias("unknown:key")]
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("scene_id"), F.when(k % 13 != 0, F.to_json(F.struct(*own))).otherwise("{broken").alias("props"))


def scene_metadata(spark, sf_dir):
    parsed = scenes.parse_metadata(_scene_rows(spark, sf_dir), vendor="v")
    place = F.col("center_aperture_position")
    return parsed.select("scene_id", "datetime", "sar_product_type", F.col("proj_centroid.lat").alias("lat"), "vendor_squint_angle", F.get(place, 0).alias("px"), F.get(place, 2).alias("pz"), F.get("center_aperture_velocity", 2).alias("vz"), F.coalesce(F.col("sar_product_type") == "SLC-COG", F.lit(False)).alias("slc_cog"))


def essential_view(spark, sf_dir):
    return scenes.essential_json(scenes.parse_metadata(_scene_rows(spark, sf_dir), vendor="v"))


def scene_scan(spark, sf_dir):
    """Packed amplitude and phase lines decoded under the scale and offset of their named bands."""
    raw = lines_from_embeddings(spark, sf_dir).select(F.col("chip").cast("string").alias("scene_id"), "r", F.transform("re", F.abs).alias("amp"), F.col("im").alias("phase"))
    ids = raw.select("scene_id").distinct()
    kinds = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(scale).alias("scale"), F.lit(offset).alias("offset")) for name, scale, offset in (("Phase", 2.0, 0.25), ("AMPLITUDE", 0.0, 0.5), ("alpha", 9.0, 9.0)))))
    bands = ids.select("scene_id", kinds.alias("b")).select("scene_id", "b.*")
    decoded = rasters.decode_lines(raw, bands)
    return rounded(unpacked(decoded, "c", ("scene_id",)), re=6, im=6)


def bbox_ring(spark, sf_dir):
    key = F.col("c_custkey").cast("double")
    box = F.when(F.col("c_custkey") % 3 == 0, F.array(key, key)).otherwise(F.array(key, key + 1, key + 2, key + 3))
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(catalog.bbox_ring(box)).alias("ring")).where("ring IS NOT NULL")


def product_name_hash(spark, sf_dir):
    name = F.concat(F.lit("SAR_"), F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "_CROP_ab12_SLC").otherwise("_SLC"))
    return table(spark, sf_dir, "part").select("p_partkey", catalog.product_name(name, F.col("p_name")).alias("product"))


def metadata_view(spark, sf_dir):
    parsed = F.from_json("props", "k long, missing string")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(parsed["missing"], F.lit("N/A")).alias("missing"))


def _selection(spark, sf_dir):
    """Layers of each batch's panel: rasters (one kind of them derived) and masks; an active layer need not be selected."""
    key = F.col("s_suppkey")
    kept = table(spark, sf_dir, "supplier").where((key % 5 == 0) | (key % 34 == 1) | (key % 3 == 0))
    return kept.select((key % 17).alias("batch"), key.alias("layer_id"), ((key % 5 == 0) | (key % 34 == 1)).alias("raster"), (key % 5 == 0).alias("eligible"), (key % 10 == 0).alias("active"), (key % 20 != 0).alias("selected"))


def resolve_source(spark, sf_dir):
    return batch.resolve_source(_selection(spark, sf_dir)).select("batch", F.coalesce("layer_id", F.lit(-1)).alias("layer_id"), "status")


def jobs_from_masks(spark, sf_dir):
    masks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("mask_id"), (F.col("c_custkey") % 17).alias("batch"))
    return batch.jobs_from_masks(masks, batch.resolve_source(_selection(spark, sf_dir))).select("mask_id", "batch", "layer_id", "seq")


def job_status(spark, sf_dir):
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 150).alias("layer_id"))
    layers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("layer_id"), (F.col("s_suppkey") % 6 != 0).alias("valid"), (F.col("s_suppkey") % 4 != 0).alias("has_metadata"))
    steps = [batch.job_status(jobs, layers, s).withColumn("step", F.lit(s)) for s in ("focus", "video", "crop")]
    return steps[0].unionByName(steps[1]).unionByName(steps[2]).groupBy("step", "status").agg(F.count(F.lit(1)).alias("n"))


def job_sequence(spark, sf_dir):
    """The focus jobs of each batch in their order, which end at the first without metadata."""
    jobs = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 17).alias("batch"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") * 7 % 150).alias("layer_id"))
    layers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("layer_id"), (F.col("s_suppkey") % 6 != 0).alias("valid"), (F.col("s_suppkey") % 4 != 0).alias("has_metadata"))
    return batch.stopped_behind_aborts(batch.job_status(jobs, layers, "focus")).select("batch", "seq", "status")


def frame_manifest(spark, sf_dir):
    """Frames of every layer for animations and videos at half size; every sixth layer names no rate."""
    key = F.col("p_partkey")
    layers = table(spark, sf_dir, "part").select(key.alias("layer"), (F.col("p_size") % 5).alias("bands"), (key % 900 + 101).alias("width"), (key % 700 + 64).alias("height"), (key % 6).alias("fps"))
    return rounded(batch.frame_manifest(layers, factor=0.5), video_second=6)


def export_format(spark, sf_dir):
    """The writer of a path by its ending, which must be lower case."""
    kinds = F.array(*map(F.lit, [".png", ".tif", ".tiff", ".gif", ".mp4", ".TIF", ".doc"]))
    path = F.concat("p_brand", F.get(kinds, (F.col("p_partkey") % 7).cast("int")))
    kind = F.when(path.endswith(".png"), "png").when(path.rlike(r"\.tiff?$"), "copy").when(path.endswith(".gif"), "gif").when(path.endswith(".mp4"), "video")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(kind, F.lit("none")).alias("writer"))


def hit_test(spark, sf_dir):
    """The first placed item (in order of placing) within 50 pixels of each click."""
    items = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), (F.col("s_suppkey") * 37 % 1000).alias("x"), (F.col("s_suppkey") * 91 % 800).alias("y"))
    clicks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("click"), (F.col("c_custkey") * 53 % 1000).alias("cx"), (F.col("c_custkey") * 29 % 800).alias("cy"))
    # Places are whole pixels of one view, so pairs are made of places, never of rows: the first item and one row of clicks each.
    firsts = items.groupBy("x", "y").agg(F.min("item").alias("item"))
    places = clicks.select("cx", "cy").distinct()
    # Cells of the hit radius: an item is looked for in the nine cells around a click only.
    cell = lambda v: F.floor(F.col(v) / 50).cast("int")
    around = F.explode(F.expr("transform(sequence(0, 8), k -> struct(k % 3 - 1 AS dx, CAST(k / 3 AS INT) - 1 AS dy))"))
    near = places.select("*", around.alias("d")).select("cx", "cy", (cell("cx") + F.col("d.dx")).alias("gx"), (cell("cy") + F.col("d.dy")).alias("gy"))
    met = near.join(firsts.select("*", cell("x").alias("gx"), cell("y").alias("gy")), ["gx", "gy"]).where("(x-cx)*(x-cx)+(y-cy)*(y-cy) <= 2500")
    # A row a place that was hit, at most the pixels of the view: clicks meet it without a shuffle, however many share a pixel.
    hits = met.groupBy("cx", "cy").agg(F.min("item").alias("item"))
    return clicks.join(F.broadcast(hits), ["cx", "cy"]).groupBy("click").agg(F.min("item").alias("item"))


def band_alpha(spark, sf_dir):
    """The first band of each layer that is an alpha band, and the bands that remain."""
    bands = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("layer"), F.col("l_linenumber").alias("band")).agg((F.max("l_tax") > 0.075).alias("alpha"))
    return bands.groupBy("layer").agg(F.coalesce(F.min(F.when(F.col("alpha"), F.col("band"))), F.lit(0)).alias("alpha_band"), F.count_if(~F.col("alpha")).alias("n_bands"))


def layer_tree(spark, sf_dir):
    """Regions, nations and suppliers as one tree, flattened in pre-order; every layer once."""
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    paths = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    keyed = paths.groupBy("s_suppkey").agg(F.min(F.concat_ws("/", F.lpad(F.col("r_regionkey").cast("string"), 4, "0"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).alias("path"))
    return keyed.select(F.col("s_suppkey").alias("layer"), "path")


def policy_edges(spark, sf_dir):
    states = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 50).alias("wanted"))
    return catalog.falling_edges(states, "user_id", "event_id", "wanted").select("event_id", "user_id")


QUERIES = {f.__name__: f for f in (tool_policies, batch_sources, footprints, load_plan, curve_ramp, grey_shader, scene_metadata, essential_view, scene_scan, acquisition_span, band_ranges, rows_per_band, iso_parse, fixed_range, teal_ramp, cumulative_cut, to_db, vendor_layer_filter, layer_routing, link_extract, url_resolve, id_from_href, file_name, https_only, asset_pick_slc, asset_pick_qlk, qlk_footprint_split, catalog_filter, bbox_ring, product_name_hash, metadata_view, resolve_source, jobs_from_masks, job_status, job_sequence, frame_manifest, policy_edges, export_format, hit_test, band_alpha, layer_tree)}
CURVES = {"tone_log": ["log_tone"], "tone_db": ["db_tone"], "tone_sqrt": ["sqrt_tone"], "tone_asinh": ["asinh_tone"], "tone_loglog": ["loglog_tone"], "grey_ramp": ["grey"]}
QUERIES.update({name: _tone(columns) for name, columns in CURVES.items()})

_SPANS = "spans AS (SELECT user_id, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events GROUP BY 1)"
_LINKS = "links AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"
_SELECTION = "sel AS (SELECT s_suppkey%17 AS batch, s_suppkey AS layer_id, s_suppkey%5=0 AS eligible, s_suppkey%5=0 OR s_suppkey%34=1 AS raster, s_suppkey%10=0 AS active, s_suppkey%20<>0 AS selected FROM supplier WHERE s_suppkey%5=0 OR s_suppkey%34=1 OR s_suppkey%3=0)"
_SOURCES = f"""{_SELECTION},
sums AS (SELECT batch, count(*) FILTER (raster AND selected) AS rasters, count(*) FILTER (eligible AND selected) AS n, max(layer_id) FILTER (eligible AND active) AS cur, max(layer_id) FILTER (eligible AND selected) AS one FROM sel GROUP BY 1),
src AS (SELECT batch, CASE WHEN rasters <= 1 THEN coalesce(cur, CASE WHEN n=1 THEN one END) END AS layer_id, rasters FROM sums)"""

_SAMPLES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)%256 AS i FROM lineitem"

ORACLE_SQL = {
    "acquisition_span": f"WITH {_SPANS}\nSELECT user_id, round((b-a)/1e6, 6)+0.0 AS seconds FROM spans",
    "band_ranges": f"WITH {_SPANS}\nSELECT user_id, CAST(k.k+1 AS INT) AS band, CAST(floor(a+(b-a)/4.0*k.k) AS BIGINT) AS t0, CAST(floor(a+(b-a)/4.0*(k.k+1)) AS BIGINT) AS t1 FROM spans CROSS JOIN range(4) k(k) WHERE b > a",
    "rows_per_band": f"WITH {_SPANS}\nSELECT user_id, CAST(least(floor((epoch_us(ts)-a)*4/(b-a)), 3)+1 AS INT) AS band, count(*) AS n FROM events JOIN spans USING (user_id) WHERE b > a GROUP BY 1, 2",
    "iso_parse": "SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_id%5 NOT IN (2, 3)",
    "fixed_range": "SELECT o_orderkey, epoch_us(o_orderdate) AS t0, epoch_us(o_orderdate)+o_orderkey%90*1000000 AS t1 FROM orders",
    "teal_ramp": """WITH s AS (SELECT * FROM (VALUES (0, 0.0, 0, 0, 0, 45, 105, 103), (1, 1.0/3, 45, 105, 103, 172, 212, 205), (2, 2.0/3, 172, 212, 205, 255, 255, 255)) s(k, x0, r0, g0, b0, r1, g1, b1)),
l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)%256 AS i FROM lineitem),
f AS (SELECT l.*, s.*, (i/255.0e0-x0)*3e0 AS f FROM l JOIN s ON k = CASE WHEN 3*i <= 255 THEN 0 WHEN 3*i <= 510 THEN 1 ELSE 2 END)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, i, CAST(floor(r0+f*(r1-r0)+1e-9) AS INT) AS red, CAST(floor(g0+f*(g1-g0)+1e-9) AS INT) AS green, CAST(floor(b0+f*(b1-b0)+1e-9) AS INT) AS blue FROM f""",
    "cumulative_cut": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.02), 4)+0.0 AS low, round(quantile_cont(l_extendedprice, 0.98), 4)+0.0 AS high FROM lineitem GROUP BY 1",
    "to_db": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(20*log10(l_discount+1e-12), 6)+0.0 AS db FROM lineitem",
    "vendor_layer_filter": "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'AUTO') OR contains(c_mktsegment, 'AUTO') OR c_custkey%50=0",
    "layer_routing": """WITH l AS (SELECT p_partkey, p_partkey%7 AS k, CASE WHEN p_partkey%4=0 THEN 'X_' ELSE 'SAR_' END || ['COLOR','QLK','SHORT','FOCUS','SLC','CSI','VID'][p_partkey%7+1] || '_' || p_partkey AS name, p_size%5+1 AS bands,
  p_partkey%4<>0 OR p_partkey%8=0 AS vendor FROM part)
SELECT p_partkey, name, vendor AND k NOT IN (0, 1, 5) AS styled, CASE WHEN NOT vendor OR k IN (0, 5) THEN 'none' WHEN k IN (2, 6) OR (k = 3 AND bands > 2) THEN 'per_band' ELSE 'fixed' END AS timing, k IN (0, 2, 3) AS derived FROM l""",
    "link_extract": f"WITH {_LINKS}\nSELECT page_id, href, count(*) AS n FROM links GROUP BY 1, 2",
    "url_resolve": f"""WITH {_LINKS},
p AS (SELECT *, regexp_extract(url, '^([a-z]+:)//', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS site, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM links),
t AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN site || href ELSE site || CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS target FROM p)
SELECT page_id, target, count(*) AS n FROM t GROUP BY 1, 2""",
    "id_from_href": "SELECT page_id, coalesce(nullif(regexp_replace(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '\\.json$', ''), ''), url) AS item FROM pages",
    "file_name": """WITH b AS (SELECT page_id, nullif(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '' AND x <> '.')[-1], '') AS base FROM pages)
SELECT page_id, CASE WHEN base IS NULL THEN CASE WHEN page_id%2=0 THEN CAST(page_id AS VARCHAR) ELSE 'slc' END || '.tif' WHEN contains(base, '.') THEN base ELSE base || '.tif' END AS name FROM b""",
    "https_only": "SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')",
    "asset_pick_slc": "SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN 'https://x/' || p_partkey || '.SLC COG' WHEN 1 THEN 'https://x/' || p_partkey || '.SLC' WHEN 2 THEN 'https://x/' || p_partkey || '.my slc file' END AS href FROM part",
    "asset_pick_qlk": "SELECT p_partkey, CASE p_partkey%4 WHEN 1 THEN 'https://x/' || p_partkey || '.QLK' WHEN 2 THEN 'https://x/' || p_partkey || '.Quicklook image' END AS href FROM part",
    "qlk_footprint_split": "SELECT CASE WHEN p_partkey%4 IN (1, 2) THEN 'quicklook' ELSE 'footprint' END AS shown_as, count(*) AS n FROM part GROUP BY 1",
    "catalog_filter": """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier),
up AS (SELECT id, parent FROM nodes WHERE contains(lower(label), 'r#000000003') UNION SELECT p.id, p.parent FROM up JOIN nodes p ON p.id = up.parent)
SELECT id, label, id IN (SELECT id FROM up) AS visible FROM nodes""",
    "tool_policies": "SELECT s_suppkey AS layer, s_suppkey%8 >= 2 AS uses_slc, s_suppkey%7<>0 AND s_suppkey%2=0 AS toggle, s_suppkey%3<>0 AND s_suppkey%7<>0 AND s_suppkey%2=0 AS normal, s_suppkey%3<>0 AND s_suppkey%5=0 AS slc FROM supplier",
    "batch_sources": "SELECT p_partkey, p_size%2=0 AND p_size%5<>0 AND p_partkey%3=1 AS usable, 'SAR_' || p_partkey || ['_FOCUS_ab', '_SLC', '_FOCUS_x'][p_partkey%3+1] AS product FROM part",
    "footprints": """WITH i AS (SELECT p_partkey AS k, p_partkey%11=0 AS unnamed, CASE WHEN p_partkey%5<>0 THEN 'geometry' WHEN p_partkey%10<>0 THEN 'bbox' ELSE 'rejected' END AS status FROM part)
SELECT status, CASE status WHEN 'geometry' THEN ['Polygon', 'MultiPolygon', 'Point', 'GeometryCollection'][k%4+1] WHEN 'bbox' THEN 'Polygon' END AS kind, count(*) AS n, count(*) FILTER (unnamed) AS unnamed FROM i GROUP BY 1, 2""",
    "load_plan": "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE p_partkey%4 WHEN 0 THEN 'https://x/' || p_partkey || '.SLC COG' WHEN 1 THEN 'https://x/' || p_partkey || '.SLC' WHEN 2 THEN 'https://x/' || p_partkey || '.my slc file' END AS url, CASE p_partkey%4 WHEN 0 THEN p_partkey || '.SLC COG' WHEN 1 THEN p_partkey || '.SLC' WHEN 2 THEN p_partkey || '.my slc file' END AS file, CASE WHEN p_partkey%4=3 THEN 'no asset' END AS error FROM part",
    "curve_ramp": "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT)%256 AS i FROM lineitem), t AS (SELECT *, i/255.0e0 AS x, ln(1+9*i/255.0e0)/ln(10) AS t FROM l WHERE i BETWEEN 1 AND 254)\nSELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, i, round(x, 9)+0.0 AS offset, CAST(trunc(10+t*230) AS INT) AS red, CAST(trunc(200-t*180) AS INT) AS green, CAST(trunc(t*255) AS INT) AS blue, CAST(trunc(255-t*200) AS INT) AS alpha FROM t",
    "grey_shader": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity <= 40 THEN CAST(floor(255*(l_quantity/40.0e0)) AS INT) ELSE -1 END AS grey FROM lineitem",
    "scene_metadata": """WITH s AS (SELECT s_suppkey AS k, s_suppkey%13<>0 AND s_suppkey%9<>0 AS ok FROM supplier)
SELECT CAST(k AS VARCHAR) AS scene_id, CASE WHEN ok THEN '2024-01-02T03:04:05Z' END AS datetime, CASE WHEN ok THEN 'SLC-COG' END AS sar_product_type, CASE WHEN ok THEN k%80*1.0e0 END AS lat, CASE WHEN ok THEN k%9*0.5e0 END AS vendor_squint_angle,
       CASE WHEN ok THEN 7e6+k END AS px, CASE WHEN ok THEN 2.0e0 END AS pz, CASE WHEN ok THEN k*1.0e0 END AS vz, ok AS slc_cog FROM s""",
    "scene_scan": f"""WITH {PX_SQL}
SELECT CAST(chip AS VARCHAR) AS scene_id, r, c, round((abs(re)+0.5)*exp(0.25)*cos(2*im), 6)+0.0 AS re, round(-(abs(re)+0.5)*exp(0.25)*sin(2*im), 6)+0.0 AS im FROM px""",
    "bbox_ring": "WITH b AS (SELECT c_custkey, CAST(c_custkey AS DOUBLE) AS k FROM customer WHERE c_custkey%3<>0)\nSELECT c_custkey, '[[' || k || ',' || (k+1) || '],[' || k || ',' || (k+3) || '],[' || (k+2) || ',' || (k+3) || '],[' || (k+2) || ',' || (k+1) || '],[' || k || ',' || (k+1) || ']]' AS ring FROM b",
    "product_name_hash": "SELECT p_partkey, 'SAR_' || p_partkey || '_CROP_' || substr(sha1(p_name), 1, 8) AS product FROM part",
    "metadata_view": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'N/A' AS missing FROM events",
    "resolve_source": f"WITH {_SOURCES}\nSELECT batch, coalesce(layer_id, -1) AS layer_id, CASE WHEN rasters > 1 THEN 'several' WHEN layer_id IS NOT NULL THEN 'ok' ELSE 'none' END AS status FROM src",
    "jobs_from_masks": f"WITH {_SOURCES}\nSELECT c_custkey AS mask_id, batch, layer_id, CAST(row_number() OVER (PARTITION BY batch ORDER BY c_custkey) AS INT) AS seq FROM customer JOIN src ON c_custkey%17 = batch WHERE layer_id IS NOT NULL",
    "job_status": """WITH j AS (SELECT c_custkey%150 AS layer_id FROM customer), l AS (SELECT s_suppkey AS layer_id, s_suppkey%6<>0 AS valid, s_suppkey%4<>0 AS meta FROM supplier)
SELECT step, CASE WHEN valid IS NULL OR NOT valid THEN 'skip' WHEN NOT meta THEN nometa ELSE 'task' END AS status, count(*) AS n
FROM j LEFT JOIN l USING (layer_id) CROSS JOIN (VALUES ('focus', 'abort'), ('video', 'skip'), ('crop', 'task')) s(step, nometa) GROUP BY 1, 2""",
    "job_sequence": """WITH j AS (SELECT c_custkey%17 AS batch, c_custkey AS seq, s_suppkey IS NULL OR s_suppkey%6=0 AS gone, s_suppkey%4=0 AS bare FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey*7%150),
d AS (SELECT *, count(*) FILTER (NOT gone AND bare) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops FROM j)
SELECT batch, seq, CASE WHEN stops > 0 THEN 'not run' WHEN gone THEN 'skip' WHEN bare THEN 'abort' ELSE 'task' END AS status FROM d""",
    "frame_manifest": """WITH l AS (SELECT p_partkey AS layer, p_size%5 AS bands, p_partkey%6 AS fps, (p_partkey%900+101)//2 AS w, (p_partkey%700+64)//2 AS h FROM part)
SELECT layer, CAST(b.b AS INT) AS band, CAST(CASE fps WHEN 0 THEN 25 ELSE 100//fps END AS INT) AS delay_cs, CAST(w AS INT) AS width, CAST(h AS INT) AS height, CAST(w//2*2 AS INT) AS video_width, CAST(h//2*2 AS INT) AS video_height, round((b.b-1)/3.0e0, 6)+0.0 AS video_second
FROM l JOIN range(1, 5) b(b) ON b.b <= bands""",
    "export_format": "SELECT p_partkey, ['png', 'copy', 'copy', 'gif', 'video', 'none', 'none'][p_partkey%7+1] AS writer FROM part",
    "hit_test": """WITH i AS (SELECT s_suppkey AS item, s_suppkey*37%1000 AS x, s_suppkey*91%800 AS y FROM supplier), c AS (SELECT c_custkey AS click, c_custkey*53%1000 AS cx, c_custkey*29%800 AS cy FROM customer)
SELECT click, min(item) AS item FROM c JOIN i ON (x-cx)*(x-cx)+(y-cy)*(y-cy) <= 2500 GROUP BY 1""",
    "band_alpha": "SELECT layer, coalesce(min(band) FILTER (alpha), 0) AS alpha_band, count(*) FILTER (NOT alpha) AS n_bands FROM (SELECT l_suppkey AS layer, l_linenumber AS band, max(l_tax) > 0.075 AS alpha FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "layer_tree": "SELECT s_suppkey AS layer, lpad(CAST(n_regionkey AS VARCHAR), 4, '0') || '/' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || '/' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "policy_edges": "SELECT event_id, user_id FROM events QUALIFY lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AND NOT value > 50",
    **{name: steps_sql(_SAMPLES, tone.curve_steps(256), "l_orderkey, l_linenumber, l_partkey, l_suppkey, i, " + ", ".join(c if c == "grey" else f"round({c}, 8)+0.0 AS {c}" for c in columns)) for name, columns in CURVES.items()},
}
