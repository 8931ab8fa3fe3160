"""Closed-form signals: transforms, orientation, windows, focus and point targets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintfield.functions import geometry as g
from glintfield.functions.steps import apply_steps
from glintfield.functions.timespan import parse_iso
from glintfield.operators import autofocus as af
from glintfield.operators import indexing as ix
from glintfield.operators import irf
from glintfield.operators.normalize import log_normalise, to_uint8
from glintfield.operators.spectral import centred_fft, frame_bands, valid_samples
from glintfield.plans import focus


def to_px(spark, x, chip=0):
    x = np.asarray(x, complex)
    rows = [(chip, r, c, float(x[r, c].real), float(x[r, c].imag)) for r in range(x.shape[0]) for c in range(x.shape[1])]
    return spark.createDataFrame(rows, "chip long, r int, c int, re double, im double")


def to_array(px):
    t = px.toPandas()
    x = np.zeros((t.r.max() + 1, t.c.max() + 1), complex)
    x[t.r, t.c] = t.re + 1j * t.im
    return x


@pytest.mark.parametrize("shape", [(4, 8), (5, 7), (1, 6), (6, 1)])
@pytest.mark.parametrize("axis", ["r", "c"])
def test_centred_fft_and_back(spark, shape, axis):
    rng = np.random.default_rng(1)
    x = rng.normal(size=shape) + 1j * rng.normal(size=shape)
    k = 0 if axis == "r" else 1
    there = centred_fft(to_px(spark, x), axis)
    want = np.fft.fftshift(np.fft.fft(x, axis=k), axes=k)
    assert np.allclose(to_array(there), want)
    assert np.allclose(to_array(centred_fft(there, axis, inverse=True)), x)


def test_orientation(spark):
    px = to_px(spark, [[1, 2, 3], [4, 5, 6]])
    assert to_array(ix.shadows_down(px, F.lit(True), 3)).real.tolist() == [[3, 6], [2, 5], [1, 4]]
    assert to_array(ix.shadows_down(px, F.lit(False), 3)).real.tolist() == [[1, 4], [2, 5], [3, 6]]


def test_grow_extent(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 50.0), (2, 0.0, 0.0, 200.0, 150.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    out = {r.id: (r.xmax - r.xmin, r.ymax - r.ymin, r.grown) for r in ix.grow_extent(df).collect()}
    assert out == {1: (100, 100, True), 2: (200, 150, False)}


def test_valid_samples():
    assert valid_samples(1000, 1.2) == (83, 916)
    assert valid_samples(100, 50.0) == (49, 51)
    assert valid_samples(100, 0.5) == (0, 100)
    assert [b[0] for b in frame_bands(64, 1.25, 0.15, 4)] == [0, 1, 2, 3]


def test_look_heights():
    assert af.look_heights(64) == [6, 10, 13, 16]
    assert af.look_heights(5) == [1]


def test_unwrap_is_numpy(spark):
    x = np.random.default_rng(3).uniform(-9, 9, 40)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "chip long, i int, v double")
    got = [r.u for r in af.unwrap(df, ("chip",), "i", "v", "u").orderBy("i").collect()]
    assert np.allclose(got, np.unwrap(x))


def test_phase_interp_is_numpy_over_all_events(spark, tmp_path):
    rng = np.random.default_rng(4)
    counts = {1: 1, 2: 2, 3: 20, 4: 21, 5: 99, 6: 400}
    events = [(int(e), user, float(v)) for user, m in counts.items() for e, v in zip(rng.permutation(m) + 1000 * user, rng.uniform(0, 100, m))]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = focus.phase_interp(spark, str(tmp_path)).toPandas().sort_values("r")
    assert len(got) == 32 * len(counts)
    for user, m in counts.items():
        phase = [v % 6.25 - 3 for _, u, v in sorted(events) if u == user]
        want = np.interp(np.linspace(0, 1, 32), np.linspace(0, 1, m), phase) if m > 1 else np.full(32, phase[0])
        assert np.allclose(got[got.user_id == user].phi, want, atol=1e-6), user


def test_flat_normalisation(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 2.0), (1, 1.0), (1, 3.0)], "chip long, v double")
    assert sorted(r.t for r in log_normalise(df, ("chip",), "v", "t").collect()) == [0, 0, 0, 1]
    assert sorted(r.t for r in to_uint8(df, ("chip",), "v", "t").collect()) == [0, 0, 0, 255]


def test_entropy_of_equal_powers(spark):
    assert math.isclose(af.entropy(to_px(spark, np.ones((4, 4)))).first().entropy, math.log(16))


def test_focus_keeps_shape_and_is_finite(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(48, 24)) + 1j * rng.normal(size=(48, 24))
    out = af.best_look(to_px(spark, x), 48, 24).toPandas()
    assert len(out) == 48 * 24 and np.isfinite(out.re).all() and (out.entropy > 0).all()


def test_point_target_sidelobe(spark):
    n = 32
    spectrum = np.zeros((n, n))
    spectrum[8:24, 8:24] = 1
    chip = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(spectrum)))
    metrics = irf.profile_metrics(irf.interpolate_chip(to_px(spark, chip)).where("i >= 0"), 1.0, ("chip", "axis")).collect()
    assert len(metrics) == 2
    profile = irf.interpolate_chip(to_px(spark, chip)).where("axis = 'range'").orderBy("i").toPandas().v.to_numpy()
    peaks = profile[1:-1][(profile[1:-1] > profile[:-2]) & (profile[1:-1] > profile[2:])]
    assert abs(20 * np.log10(np.sort(peaks)[-2]) + 13.3) < 0.5


def test_geometry_against_numpy(spark):
    steps = [{"lat_p": "lat+5.0", "lon_p": "lon+5.0", "h_p": "h+550000.0"}, *g.to_ecef("aim", "lat", "lon", "h"), *g.to_ecef("p", "lat_p", "lon_p", "h_p"), {"vel_x": "1000.0", "vel_y": "7000.0", "vel_z": "-500.0"}, *g.view_geometry("aim", "p", "vel")]
    got = apply_steps(spark.createDataFrame([(60.0, 25.0, 300.0)], "lat double, lon double, h double"), steps).first()
    a, b = 6378137.0, 6356752.314245

    def ecef(lat, lon, h):
        lat, lon = np.radians([lat, lon])
        n = a / np.sqrt(1 - (a * a - b * b) / a**2 * np.sin(lat) ** 2)
        return np.array([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (b * b / a**2 * n + h) * np.sin(lat)])

    unit = lambda x: x / np.linalg.norm(x)
    aim, p, v = ecef(60, 25, 300), ecef(65, 30, 550300), np.array([1000.0, 7000.0, -500.0])
    n, r = unit(aim / np.array([a * a, a * a, 6356752.314245179**2])), unit(p - aim)
    s0 = unit(np.cross(r, unit(v)))
    assert math.isclose(got.graze, math.asin(r @ n), abs_tol=1e-12)
    assert got.sense == np.sign(s0 @ n)
    assert math.isclose(got.slope, math.acos(abs(s0 @ n)), abs_tol=1e-12)


def test_iso_times(spark):
    texts = ["2024-01-02T03:04:05.87Z", "2024-01-02T03:04:05.1234567Z", "2024-01-02T03:04:05+02:00", "", "garbage", None]
    got = [r.us for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.unix_micros(parse_iso(F.col("t"))).alias("us")).orderBy("k").collect()]
    base = 1704164645000000
    assert got == [base + 870000, base + 123456, base - 7200000000, None, None, None]
