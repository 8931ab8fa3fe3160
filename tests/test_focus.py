"""Autofocus, point analysis and control points against numpy; scenes and products through files; urls, trees and the entry."""

import json
import math
import os
import shutil
import subprocess
import sys
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintfield.operators import autofocus as af
from glintfield.operators import catalog, irf
from glintfield.operators.control_points import along_spline, fit_splines, map_corners, map_to_pixel, pixel_extents
from glintfield.sources import rasters
from glintfield.sources.scenes import essential_json, parse_metadata
from tests.test_signals import to_array, to_px

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def spectrum(x):
    return np.fft.fftshift(np.fft.fft(x, axis=0), axes=0)


def numpy_phase(rows):
    """One round on chosen rows, written from the definitions."""
    h, w = rows.shape
    rolled = np.stack([np.roll(x, w // 2 - np.argmax(np.abs(x))) for x in rows])
    profile = (np.abs(rolled) ** 2).sum(0)
    count = int((10 * np.log10(profile / profile.max()) > -20).sum())
    width = min(max(count, 50), h - 1)
    middle = (h - 1) // 2
    mask = np.zeros(w)
    for k in range(middle - math.ceil(width / 2), middle + width // 2):
        mask[k] = 1
    z = spectrum(rolled * mask)
    s = np.conj(z[:-1]) * z[1:]
    g = (np.angle(s) * np.abs(s)).sum(1) / np.abs(s).sum(1)
    phase = np.unwrap(np.cumsum(np.concatenate([[0], g])))
    i = np.arange(h)
    flat = phase - np.polyval(np.polyfit(i, phase, 1), i)
    rms = math.sqrt((flat**2).mean())
    return (flat if rms >= 0.01 else np.zeros(h)), rms


def numpy_apply(x, phi):
    on = np.interp(np.linspace(0, 1, len(x)), np.linspace(0, 1, len(phi)), phi)
    return np.fft.ifft(np.fft.ifftshift(spectrum(x) * np.exp(-1j * on)[:, None], axes=0), axis=0)


def noise(seed, shape):
    rng = np.random.default_rng(seed)
    return rng.normal(size=shape) + 1j * rng.normal(size=shape)


@pytest.mark.parametrize("shape", [(9, 40), (16, 20)])
def test_phase_error_is_numpy(spark, shape):
    x = noise(42, shape)
    got = af.phase_error(to_px(spark, x), shape[1]).orderBy("i").toPandas()
    phi, rms = numpy_phase(x)
    assert np.allclose(got.phi, phi, atol=1e-9) and got.rms[0] == pytest.approx(rms)


def test_rounds_add_up(spark):
    x = noise(3, (10, 30))
    got = af.phase_gradient_autofocus(to_px(spark, x), 30, rounds=2).orderBy("i").toPandas()
    first, _ = numpy_phase(x)
    second, rms = numpy_phase(numpy_apply(x, first))
    assert np.allclose(got.phi, first + second, atol=1e-8) and got.rms[0] == pytest.approx(rms)


def share_entropy(x):
    p = np.abs(x) ** 2
    p = p[p > 0] / p.sum()
    return -(p * np.log(p)).sum()


def test_chips_stop_at_different_rounds(spark):
    """Each chip ends where its own rms is under the tolerance; the others go on."""
    chips = {0: noise(3, (10, 30)), 1: noise(5, (10, 30)), 2: np.zeros((10, 30), complex)}
    px = None
    for k, x in chips.items():
        one = to_px(spark, x).withColumn("chip", F.lit(k))
        px = one if px is None else px.unionByName(one)
    total, history = af.autofocus_rounds(px, 30, rounds=3, tolerance=0.3)
    got = {k: t.sort_values("round") for k, t in history.toPandas().groupby("chip")}
    phases = {k: t.sort_values("i").phi.to_numpy() for k, t in total.toPandas().groupby("chip")}
    for k, x in chips.items():
        want, phi = [(0, None, share_entropy(x) if np.abs(x).sum() else 0.0)], np.zeros(10)
        for r in (1, 2, 3):
            if np.abs(x).sum():
                z = x.copy()
                flat, rms = numpy_phase(z)
            else:
                flat, rms = np.zeros(10), 0.0
            if rms < 0.3:
                want.append((r, rms, None))
                break
            x, phi = numpy_apply(x, flat), phi + flat
            want.append((r, rms, share_entropy(x)))
        rows = [(int(a), None if np.isnan(b) else b, None if np.isnan(c) else c) for a, b, c in got[k][["round", "rms", "entropy"]].to_numpy()]
        assert [r[0] for r in rows] == [r[0] for r in want]
        for r, w in zip(rows, want):
            assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-6)) for a, b in zip(r, w)), (k, r, w)
        assert np.allclose(phases[k], phi, atol=1e-7)


def test_own_estimator(spark):
    still = lambda spectrum, keys: spectrum.groupBy(*keys, F.col("r").alias("i")).agg(F.lit(0.0).alias("g")).where("i < 9")
    got = af.phase_error(to_px(spark, noise(1, (10, 30))), 30, estimator=still).toPandas()
    assert len(got) == 10 and (got.phi == 0).all()


def test_apply_phase_is_numpy(spark):
    x, phi = noise(5, (12, 7)), np.random.default_rng(1).normal(size=5)
    phase = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(phi)], "chip long, i int, phi double")
    assert np.allclose(to_array(af.apply_phase(to_px(spark, x), af.stretch(phase, 12))), numpy_apply(x, phi))


def test_best_look_is_numpy(spark):
    x = noise(7, (40, 24))
    both = np.fft.fftshift(np.fft.fft2(x))
    best = None
    for height in (4, 6, 8, 10):
        look = np.zeros_like(both)
        first = 20 - height // 2
        look[first : first + height] = both[first : first + height]
        image = np.fft.ifft2(np.fft.ifftshift(look))
        peaks = np.abs(image).max(1)
        phi, _ = numpy_phase(image[peaks >= np.percentile(peaks, 95)])
        sharp = numpy_apply(image, phi)
        p = np.abs(sharp) ** 2 / (np.abs(sharp) ** 2).sum()
        entropy = -(p[p > 0] * np.log(p[p > 0])).sum()
        if best is None or entropy < best[0]:
            best = (entropy, height, sharp)
    got = af.best_look(to_px(spark, x), 40, 24)
    assert got.first().look == best[1] and got.first().entropy == pytest.approx(best[0])
    assert np.allclose(to_array(got), best[2])


def test_defocused_points_get_sharper(spark):
    """Points in many rows under one quadratic phase error over the row spectrum."""
    rng = np.random.default_rng(2)
    n, w = 64, 64
    x = 0.01 * noise(9, (n, w))
    for r in range(n):
        x[r, w // 2] += 5 * np.exp(1j * rng.uniform(0, 2 * np.pi))
    x = x * np.exp(1j * 0)
    blurred = numpy_apply(x, -6 * np.linspace(-1, 1, n) ** 2)
    rows = to_px(spark, blurred)
    phi = af.phase_gradient_autofocus(rows, w)
    assert np.allclose(phi.orderBy("i").toPandas().phi, numpy_phase(blurred)[0], atol=1e-8)


def test_lens_focus_is_numpy(spark):
    x = noise(8, (40, 24))
    both = np.fft.fftshift(np.fft.fft2(x))
    look = np.zeros_like(both)
    look[17:23] = both[17:23]
    image = np.fft.ifft2(np.fft.ifftshift(look))
    peaks = np.abs(image).max(1)
    v = np.abs(numpy_apply(image, numpy_phase(image[peaks >= np.percentile(peaks, 95)])[0]))
    v = np.minimum(v, v.mean() + 4 * v.std())
    want = np.floor(np.round(255 * (v - v.min()) / (v.max() - v.min()), 6))
    got = af.lens_focus(to_px(spark, x), 40, 24).toPandas()
    grid = np.zeros((40, 24))
    grid[got.r, got.c] = got.u
    assert np.abs(grid - want).max() <= 1 and (grid == want).mean() > 0.99


def test_point_analysis_is_numpy(spark):
    x = noise(4, (30, 150)) * 0.05
    x[11, 90] += 3
    profiles, metrics = irf.analyse_points(to_px(spark, x), 0.8, 0.4)
    chip = x[:, 90 - 64 : 90 + 65]
    want = tuple(1 << math.ceil(math.log2(10 * n)) for n in chip.shape)
    padded = np.zeros(want, complex)
    at = [(w - n) // 2 for w, n in zip(want, chip.shape)]
    padded[at[0] : at[0] + chip.shape[0], at[1] : at[1] + chip.shape[1]] = np.fft.fftshift(np.fft.fft2(chip))
    fine = np.abs(np.fft.ifft2(np.fft.ifftshift(padded)))
    peak = np.unravel_index(fine.argmax(), fine.shape)
    got = {r.axis: r for r in metrics.collect()}
    for k, (axis, line, spacing) in enumerate((("azimuth", fine[:, peak[1]], 0.8), ("range", fine[peak[0]], 0.4))):
        step = spacing * chip.shape[k] / want[k]
        reach = int(2 / step)
        cut = (line / line.max())[max(0, peak[k] - reach) : peak[k] + reach + 1]
        rows = profiles.where(F.col("axis") == axis).orderBy("i").toPandas()
        assert np.allclose(rows.v, cut) and np.allclose(rows.db, 20 * np.log10(cut + 1e-12)) and np.allclose(rows.spacing, step)
        wide = np.flatnonzero(rows.db >= rows.db.max() - 3)
        lobe = int((cut >= 0.5).sum())
        p, top = cut**2, int(cut.argmax())
        main = np.abs(np.arange(len(cut)) - top) <= lobe
        assert got[axis].hpbw == pytest.approx((wide[-1] - wide[0]) * step)
        assert got[axis].pslr == pytest.approx(10 * math.log10(p[~main].max())) and got[axis].islr == pytest.approx(10 * math.log10(p[~main].sum() / p[main].sum()))


@pytest.fixture(scope="module")
def gcps(spark):
    rng = np.random.default_rng(6)
    rows = []
    for scene in ("a", "b"):
        for p, q in rng.uniform(0, 500, (25, 2)):
            p, q = float(p), float(q)
            rows.append((scene, p, q, 10 + p / 1000 + 0.02 * math.sin(q / 300), 50 - q / 900 + 0.01 * math.cos(p / 200)))
    return spark.createDataFrame([*rows, rows[0]], "scene_id string, pixel double, line double, x double, y double")


def test_splines_go_through_their_points_and_back(spark, gcps):
    there = along_spline(gcps.select("scene_id", "pixel", "line", F.col("x").alias("x0"), F.col("y").alias("y0")), fit_splines(gcps), "pixel", "line", "x", "y").toPandas()
    assert np.allclose(there.x, there.x0, atol=1e-9) and np.allclose(there.y, there.y0, atol=1e-9)
    grid = spark.createDataFrame([("a", float(p), float(q)) for p in range(100, 401, 75) for q in range(100, 401, 75)], "scene_id string, pixel double, line double")
    placed = along_spline(grid, fit_splines(gcps), "pixel", "line", "x", "y")
    back = map_to_pixel(placed, gcps).toPandas()
    assert (np.abs(back.c - back.pixel) <= 1).all() and (np.abs(back.r - back.line) <= 1).all()
    corners = map_corners(spark.createDataFrame([("a", 100.0, 100.0, 300.0, 200.0)], "scene_id string, xmin double, ymin double, xmax double, ymax double"), gcps)
    box = corners.groupBy("scene_id").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    got = pixel_extents(box, gcps).first()
    assert [got.xmin, got.ymin, got.xmax, got.ymax] == pytest.approx([100, 100, 300, 200], abs=12)
    with pytest.raises(Exception, match="control points"):
        fit_splines(gcps.limit(2)).collect()


def test_scenes_through_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    amp, phase = rng.uniform(1, 5, (20, 8)), rng.uniform(-3, 3, (20, 8))
    lines = spark.createDataFrame([("s", r, amp[r].tolist(), phase[r].tolist()) for r in range(20)], "scene_id string, r int, amp array<double>, phase array<double>")
    bands = spark.createDataFrame([("s", 1, "Amplitude", 2.0, 0.5, None), ("s", 2, "PHASE", None, 0.1, None)], "scene_id string, band int, name string, scale double, offset double, interp string")
    scenes = spark.createDataFrame([("s", '{"platform": "x"}')], "scene_id string, props string")
    rasters.write_scene(f"{tmp_path}/scene", lines, bands, scenes)
    want = (2 * amp + 0.5) * np.exp(0.1) * np.exp(-1j * phase)
    whole = rasters.read_scene(spark, f"{tmp_path}/scene").orderBy("r").toPandas()
    assert np.allclose(np.stack(whole.re) + 1j * np.stack(whole.im), want)
    part = rasters.read_scene(spark, f"{tmp_path}/scene", (5, 9), (2, 6)).orderBy("r").toPandas()
    assert part.r.tolist() == [0, 1, 2, 3] and np.allclose(np.stack(part.re), want[5:9, 2:6].real)
    with pytest.raises(Exception, match="no amplitude and phase"):
        rasters.decode_lines(lines, bands.where("band = 1")).collect()
    px = rasters.read_scene(spark, f"{tmp_path}/scene").select("scene_id", "r", F.posexplode(F.arrays_zip("re", "im")).alias("c", "s")).select("scene_id", "r", "c", "s.*")
    rasters.write_product(f"{tmp_path}/focus", rasters.focus_frames(px), scenes, left=F.lit(False), height=20)
    assert rasters.read_product(spark, f"{tmp_path}/focus").count() == 2 * 160
    one = rasters.read_product(spark, f"{tmp_path}/focus", 1).toPandas()
    assert np.allclose(one.sort_values(["c", "r"]).v, np.abs(want).ravel(), rtol=1e-6)
    assert spark.read.parquet(f"{tmp_path}/focus/scenes").first().props == '{"platform": "x"}'
    with pytest.raises(ValueError):
        rasters.write_product(f"{tmp_path}/none", rasters.focus_frames(px), scenes.where("false"), left=F.lit(False), height=20)
    rgb = px.select("scene_id", "r", "c", *(F.col("re").alias(x) for x in ("red", "green", "blue")))
    assert rasters.color_frames(rgb).select("band").distinct().count() == 3


def test_metadata_record(spark):
    states = [{"position": [float(k)] * 3, "velocity": [10.0 * k] * 3} for k in range(5)]
    rows = [("a", json.dumps({"platform": "X1", "v:squint_angle": 2.5, "v:orbit_states": states, "v:amplitude_mapping": {"function": "power", "parameters": {"scale": 1.0, "exponent": 2.0}}, "proj:centroid": {"lat": 1.0, "lon": 2.0}})), ("b", json.dumps({"platform": "X1", "v:orbit_states": []})), ("c", "{"), ("d", None)]
    df = spark.createDataFrame(rows, "scene_id string, props string")
    got = {r.scene_id: r for r in parse_metadata(df, vendor="v").collect()}
    assert len(parse_metadata(df, vendor="v").columns) == 2 + 28 + 46 + 2
    assert got["a"].center_aperture_position == [2.0] * 3 and got["a"].vendor_amplitude_mapping.parameters.exponent == 2.0
    assert got["b"].platform is None and got["c"].platform is None and got["d"].platform is None
    assert list(json.loads(essential_json(parse_metadata(df, vendor="v")).where("scene_id = 'a'").first().view)) == ["datetime", "created", "start_datetime", "end_datetime", "platform", "constellation", "proj_centroid", "vendor_squint_angle"]


def test_urls_like_the_standard_library(spark):
    bases = ["https://h.org/a/b/c.json", "https://h.org/a/b/", "http://h.org", "HTTP://H.org/x?q=1#f", "https://h.org/a/b/c?x=1"]
    refs = ["d.json", "./d", "../d", "../../d", "../../../../d", "/r/./s/../t", "//other/x", "https://z/y/../k", "?p=2", "#frag", "d/e/", "..", ".", "d//e", "d?u=1#v", ""]
    rows = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(rows, "b string, r string")
    got = {(x.b, x.r): x.u for x in df.withColumn("u", catalog.resolve_url(F.col("b"), F.col("r"))).collect()}
    wrong = {k: (u, urljoin(*k)) for k, u in got.items() if u.lower() != urljoin(*k).lower()}
    assert not wrong
    names = spark.createDataFrame([("https://h/a/b/", "i"), ("https://h/a/b.tif?x", "i"), ("https://h/", "i"), ("https://h", None), ("https://h/a/./", "i")], "u string, i string")
    assert [r.n for r in names.select(catalog.file_name(F.col("u"), F.col("i")).alias("n")).collect()] == ["b.tif", "b.tif", "i.tif", "slc.tif", "a.tif"]


def test_a_match_shows_all_its_ancestors(spark):
    nodes = spark.createDataFrame([("a", None, "Top"), ("b", "a", "mid"), ("c", "b", "Wanted leaf"), ("d", "b", "other"), ("e", None, "alone")], "id string, parent string, label string")
    shown = lambda text: sorted(r.id for r in catalog.visible_nodes(nodes, text).where("visible").collect())
    assert shown("  wanted ") == ["a", "b", "c"] and shown("top") == ["a"] and shown(" ") == ["a", "b", "c", "d", "e"]


def test_entry_without_the_text_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "glintfield"), tmp_path / "glintfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    for here in (True, False):
        if not here and (tmp_path / "corpus_pipeline.py").exists():
            os.remove(tmp_path / "corpus_pipeline.py")
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
