"""Operators against analytic truth and plain NumPy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundswell.functions import scalars as S
from groundswell.operators import aggregates as A
from groundswell.operators import areas, cycles, fits, footprints, joins, kernels
from groundswell.operators import neighbourhood as N
from groundswell.plans.calibrate import calibrate_pair, calibrate_windowed, robust_weights


def smooth_array(v, sigma, mode="constant"):
    """Cell by cell, with the weights of a normal density."""
    reach = int(4 * sigma + 0.5)
    k = np.arange(-reach, reach + 1)
    w = np.exp(-(k**2) / (2 * sigma**2))
    w /= w.sum()
    for axis in (0, 1):
        wide = np.pad(v, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode={"constant": "constant", "nearest": "edge", "reflect": "symmetric"}[mode])
        v = np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), axis, wide)
    return v


def field(spark, v, **more):
    r, c = np.indices(v.shape)
    p = pd.DataFrame({"k": 1, "r": r.ravel(), "c": c.ravel(), "v": v.ravel(), **{n: a.ravel() for n, a in more.items()}})
    df = spark.createDataFrame(p)
    return df.withColumns({n: F.nanvl(F.col(n), F.lit(None).cast("double")) for n in ("v", *more)})


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for row in df.select("r", "c", name).collect():
        out[row[0], row[1]] = np.nan if row[2] is None else row[2]
    return out


def test_plane_is_recovered_and_null_cells_ignored(spark):
    r, c = np.indices((6, 9))
    v = 2.0 + 0.5 * c - 0.25 * r
    v[2, 3] = np.nan
    p = fits.plane(field(spark, v), ["k"]).first()
    assert np.allclose([p.p0, p.px, p.py], [2.0, 0.5, -0.25])


def test_gaussian_matches_dense_matrices(spark):
    v = np.random.default_rng(1).normal(size=(9, 7))
    for mode in ("constant", "nearest", "reflect"):
        got = back(N.gaussian(field(spark, v), ["k"], ["v"], v.shape, 1.3, mode=mode), "v", v.shape)
        assert np.allclose(got, smooth_array(v, 1.3, mode))


def test_local_linear_reproduces_planes_with_gaps(spark):
    r, c = np.indices((10, 10))
    v = 1.0 + 0.2 * c - 0.1 * r
    w = (np.random.default_rng(2).random(v.shape) > 0.3).astype(float)
    got = back(N.local_linear(field(spark, v, w=w), ["k"], v.shape, 2.0, ridge=1e-12), "level", v.shape)
    assert np.allclose(got, v, atol=1e-6)


def test_resample_line_is_exact_and_outliers_are_damped(spark):
    t = np.arange(0, 20.0)
    y = 3 + 0.5 * t
    y[10] += 100
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "ord": np.arange(20), "t": t, "y": y}))
    targets = spark.createDataFrame([(3.0,), (10.0,), (40.0,)], "t0 double")
    lin, hub = ({x.t0: x.value for x in fits.resample(df, targets, ["k"], 12.0, method=m).collect()} for m in ("linear", "theil_sen"))
    assert lin[3.0] == pytest.approx(4.5, abs=1e-9) and hub[10.0] == pytest.approx(8.0, abs=0.2)
    assert 40.0 not in lin or lin[40.0] is None


def test_decompose_recovers_two_looks_and_falls_back_on_one(spark):
    e, u = np.array([0.6, -0.6, 0.6]), np.array([0.8, 0.8, 0.8])
    rows = [(1, float(0.02 * e[0] + 0.01 * u[0]), 0.01, float(e[0]), 0.0, 0.8), (1, float(0.02 * e[1] + 0.01 * u[1]), 0.01, float(e[1]), 0.0, 0.8), (2, 0.08, 0.01, 0.6, 0.0, 0.8)]
    got = {x.k: x for x in fits.decompose(spark.createDataFrame(rows, "k long, los double, sigma double, e double, n double, u double"), ["k"]).collect()}
    assert got[1].mode == 2 and got[1].east == pytest.approx(0.02) and got[1].up == pytest.approx(0.01)
    assert got[2].mode == 1 and got[2].east is None and got[2].up == pytest.approx(0.1)


def test_nearest_epoch_takes_the_first_of_equals_and_drops_far_ones(spark):
    rows = [(1, 0, 4.9, 1.0), (1, 1, 5.1, 2.0), (1, 2, 9.0, 7.0), (2, 0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, ord long, t double, y double")
    got = joins.epoch_displacement(df, ["k"], 5.0, 9.0, 0.2).collect()
    assert len(got) == 1 and got[0].dy == pytest.approx(6.0)


def test_events_meet_pairs_at_their_ends(spark):
    day = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(days=d)
    pairs = spark.createDataFrame([(1, day(0), day(10)), (2, day(11), day(300))], "pair_id long, ref timestamp_ntz, sec timestamp_ntz")
    events = spark.createDataFrame([("a", day(10), None), ("b", day(5), day(12)), ("c", day(301), None)], "event string, t0 timestamp_ntz, t1 timestamp_ntz")
    assert {(x.pair_id, x.event) for x in joins.affecting(pairs, events).collect()} == {(1, "a"), (1, "b"), (2, "b")}


def test_nearest_fill_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(5):
        mask = rng.random((7, 11)) > 0.6
        mask[0, 0] = True
        r, c, d2 = kernels.nearest_valid(mask)
        ys, xs = np.nonzero(mask)
        for i in range(7):
            for j in range(11):
                best = min(((i - y) ** 2 + (j - x) ** 2, y, x) for y, x in zip(ys, xs, strict=True))
                assert (d2[i, j], r[i, j], c[i, j]) == best
    with pytest.raises(ValueError, match="no valid cell"):
        kernels.nearest_valid(np.zeros((2, 2), bool))


def test_components_and_segments():
    m = np.zeros((8, 12), bool)
    m[1:4, 1:4] = m[4, 4] = m[6:8, 8:11] = True
    assert kernels.connected(m).max() == 3 and kernels.connected(m, diagonal=True).max() == 2
    land = np.zeros((20, 40), bool)
    land[2:18, 2:18] = land[2:18, 22:38] = True
    lab = kernels.segment_regions(land)
    assert lab.max() == 2 and (lab > 0).sum() == land.sum()


def test_cycles_are_decided_outwards_and_respect_gnss():
    """A mainland and five islands: +2 cycles, +0.6, +1 as GNSS says, +1 out of reach, and +1 beyond the first island."""
    lab = np.zeros((40, 300), int)
    for k, (a, b) in enumerate(((0, 60), (64, 90), (120, 135), (64, 80), (200, 240), (94, 112)), 1):
        lab[(slice(0, 18) if k != 4 else slice(22, 40)) if k != 1 else slice(0, 40), a:b] = k
    lab[:18, 120:135] = 0
    lab[22:, 84:99] = 3
    truth = {1: 0.0, 2: 2.0, 3: 0.6, 4: 1.0, 5: 1.0, 6: 3.0}
    res = np.select([lab == k for k in truth], truth.values(), np.nan) + np.random.default_rng(4).normal(0, 0.01, lab.shape)
    gnss = np.where(lab == 4, 1.0, 0.0)
    limits = cycles.Limits(reach=8, least=20, edge=10)
    got = {d.region: d for d in cycles.decide(res, lab, gnss, np.isfinite(res), 1.0, limits)}
    assert {k: d.cycles for k, d in got.items()} == {2: -2, 3: 0, 4: 0, 5: 0, 6: -3}
    assert got[3].reason.startswith("rejected") and got[4].reason.startswith("vetoed") and got[5].reason == "not measured"
    assert got[2].jump == pytest.approx(2, abs=0.02) and got[4].gnss_rel == pytest.approx(0, abs=0.02) and got[2].accepted and got[6].anchor
    gated = cycles.Limits(reach=8, least=20, edge=10, gate=0.5)
    closed = {d.region: d for d in cycles.decide(res, lab, gnss, np.isfinite(res), 1.0, gated, np.zeros(lab.shape))}
    assert closed[2].cycles == 0 and closed[2].resid_med == 0 and "inversion" in closed[2].reason
    opened = {d.region: d.cycles for d in cycles.decide(res, lab, gnss, np.isfinite(res), 1.0, gated, np.full(lab.shape, 2 * np.pi))}
    assert opened == {2: -2, 3: 0, 4: 0, 5: 0, 6: -3} and cycles.decide(res, np.zeros_like(lab), gnss, np.isfinite(res), 1.0, limits) == []
    few = cycles.Limits(reach=8, least=10_000, edge=10)
    assert {d.reason for d in cycles.decide(res, lab, gnss, np.isfinite(res), 1.0, few)} == {"too small"} and cycles.cells_for_area(0.9, 30.0) == 1000


def test_gaussian_weights_are_the_normal_densitys():
    known = [0.000133830625, 0.00443186162, 0.0539911274, 0.241971446, 0.398943469]
    assert np.allclose(N.gaussian_weights(1.0), known + known[3::-1], atol=1e-9)
    a = np.random.default_rng(3).normal(size=(3, 50))
    wide = N.gaussian_weights(9.0)
    assert np.allclose(N.convolve_lines(a, wide, "constant"), [np.convolve(np.pad(x, 36), wide, "valid") for x in a])


def test_nearest_valid_is_exact_with_ties():
    rng = np.random.default_rng(6)
    for share in (0.02, 0.3, 0.9):
        mask = rng.random((23, 31)) < share
        mask[rng.integers(0, 23), rng.integers(0, 31)] = True
        rows, cols = np.nonzero(mask)
        r, c, d2 = kernels.nearest_valid(mask)
        for i in range(23):
            for j in range(31):
                at = (rows - i) ** 2 + (cols - j) ** 2
                k = np.lexsort((cols, rows, at))[0]
                assert (r[i, j], c[i, j], d2[i, j]) == (rows[k], cols[k], at[k])


def test_fill_methods_keep_valid_cells():
    r, c = np.indices((14, 17))
    v = 1 + 0.5 * r - 0.2 * c
    gappy = v.copy()
    gappy[3:8, 4:9] = np.nan
    gappy[0, 0] = np.nan
    for method in ("nearest", "nearest_smooth", "idw", "biharmonic"):
        out = kernels.fill_gaps(gappy, method)
        assert np.isfinite(out).all() and np.array_equal(out[np.isfinite(gappy)], v[np.isfinite(gappy)])
    assert np.allclose(kernels.fill_gaps(gappy, "biharmonic"), v, atol=1e-6)  # a plane has no curvature
    assert np.allclose(kernels.fill_gaps(gappy, "nearest_smooth")[np.isnan(gappy)], kernels.smooth(kernels.fill_nearest(gappy), 3.0)[np.isnan(gappy)])
    with pytest.raises(ValueError):
        kernels.fill_gaps(np.full((3, 3), np.nan))
    with pytest.raises(ValueError):
        kernels.fill_gaps(gappy, "other")


def test_robust_plane_leaves_outliers_out(spark):
    rng = np.random.default_rng(7)
    r, c = np.indices((20, 20))
    v = 2 + 0.1 * c - 0.3 * r + rng.normal(0, 0.01, r.shape)
    v[4:7, 5:9] += 40
    v[0, 0] = np.nan
    p = fits.robust_plane(field(spark, v), ["k"]).first()
    use, coef = np.isfinite(v).ravel(), None
    a = np.stack([np.ones(400), c.ravel(), r.ravel()], 1)
    for _ in range(3):
        coef = np.linalg.lstsq(a[use], v.ravel()[use], rcond=None)[0]
        res = v.ravel() - a @ coef
        med = np.median(res[use])
        use = np.isfinite(res) & (np.abs(res - med) <= 3 * 1.4826 * np.median(np.abs(res[use] - med)))
    assert np.allclose([p.p0, p.px, p.py], coef, atol=1e-9) and np.allclose(coef, [2, 0.1, -0.3], atol=0.02)


def test_weighted_surfaces_match_numpy(spark):
    rng = np.random.default_rng(9)
    r, c = np.indices((12, 10))
    x, y = c / 9, r / 11
    v = 1 + x - 2 * y + 0.5 * x * y + rng.normal(0, 0.05, r.shape)
    s = rng.uniform(0.5, 2, r.shape)
    v[3, 3], v[5, 5] = np.nan, 30.0
    df = field(spark, v, x=x, y=y, s=s)
    ok = np.isfinite(v).ravel()
    a = np.stack([x.ravel(), y.ravel(), (x * y).ravel(), np.ones(120)], 1)
    for rounds in (1, 2):
        w = 1 / s.ravel()[ok] ** 2
        normal = a[ok].T @ (a[ok] * w[:, None])
        coef = np.linalg.solve(normal, a[ok].T @ (w * v.ravel()[ok]))
        res = v.ravel() - a @ coef
        mse = (w * res[ok] ** 2).sum() / (ok.sum() - 4)
        got = fits.surface_fit(df, ["k"], sigma="s", rounds=rounds).first()
        assert got.n == ok.sum() and np.allclose(got.coef, coef) and np.isclose(got.mse, mse)
        assert np.allclose(np.array(got.covariance), np.linalg.inv(normal) * mse)
        ok = ok & (np.abs(res - res[ok].mean()) <= 2 * res[ok].std())
    alone = fits.least_squares(df.limit(2), ["k"], [F.lit(1.0), F.col("x"), F.col("y")]).first()
    assert alone.coef is None and alone.covariance is None


def test_surface_stands_in_where_there_is_no_data(spark):
    v = np.full((30, 30), 3.0)
    w = np.zeros((30, 30))
    w[:, :10] = 1.0
    out = N.loclin_surface(field(spark, v, w=w, m=(w > 0).astype(float)), ["k"], v.shape, pixel_m=1.0, cutoff_m=2 / S.HALF_RESPONSE)
    assert np.allclose(back(out, "surface", v.shape), 3.0, atol=1e-5)
    seen = N.loclin_surface(field(spark, v, w=w / 100, m=(w > 0).astype(float)), ["k"], v.shape, pixel_m=1.0, cutoff_m=2 / S.HALF_RESPONSE, data="m")
    assert np.allclose(back(seen, "coverage", v.shape), smooth_array((w > 0).astype(float), 2.0))


def test_large_fields_are_refused(spark):
    with pytest.raises(ValueError, match="blocks"):
        kernels.per_field(field(spark, np.zeros((2, 2))), ["k"], (3000, 3000), lambda f: f, ["v"], "v double")


def test_filters_keep_polynomials_and_means():
    r, c = np.indices((15, 15))
    v = 1 + 0.3 * c + 0.02 * r * r
    assert np.allclose(kernels.savgol(v, 5, 2), v)
    assert np.isclose(kernels.fft_lowpass(v, 2.0).mean(), v.mean())
    w, s = kernels.rbf_weights(np.array([0.0, 1, 0, 1]), np.array([0.0, 0, 1, 1]), np.array([1.0, 2, 3, 4]), smooth=0.0)
    assert np.allclose(kernels.rbf_values(w, s, np.array([0.0, 1, 0, 1]), np.array([0.0, 0, 1, 1]), np.array([1.0]), np.array([0.0])), 2.0)


def test_pair_calibration_closes(spark):
    r, c = np.indices((8, 8))
    v = 0.1 * c + np.random.default_rng(5).normal(0, 0.01, (8, 8))
    df = field(spark, v, coherence=np.full((8, 8), 0.8)).select("k", "r", "c", F.col("v").alias("disp"), F.lit(0.0).alias("gnss"), F.lit(0.01).alias("tropo"), "coherence", ((F.col("r") + F.col("c")) % 5 != 0).alias("ok"))
    got = calibrate_pair(df, ["k"], (8, 8)).toPandas()
    assert got.calibration.isna().sum() == sum((i + j) % 5 == 0 for i in range(8) for j in range(8))
    ok = got.dropna()
    assert np.allclose(ok.surface + ok.tie + ok.reference + ok.tropo, ok.calibration) and ok.calibrated.abs().max() < 0.1


def test_scalars(spark):
    row = spark.sql("SELECT timestamp_ntz'2020-07-01 12:00:00' AS ts, 'OPERA_L3_DISP-S1_IW_F00042_VV_20220111T002312Z_20220722T002313Z_v0.3_20231101T000000Z.nc' AS name")
    got = row.select(S.decimal_year("ts").alias("y"), S.product_fields("name")["frame_id"].alias("f"), S.try_day(F.lit("2022-13-01")).alias("bad"), S.wrap_longitude(F.lit(359.0)).alias("w"), S.smoothstep(F.lit(0.5)).alias("s")).first()
    assert got.y == pytest.approx(2020 + 182.5 / 366) and got.f == 42 and got.bad is None and got.w == -1 and got.s == 0.5


def test_median_blocks_and_poison(spark):
    v = np.arange(16.0).reshape(4, 4)
    v[0, 0] = np.nan
    got = back(A.block_aggregate(field(spark, v), ["k"], 2, (4, 4), method="median"), "v", (2, 2))
    assert got[0, 0] == 4.0 and got[1, 1] == 12.5
    assert A.stack_mean(field(spark, v), ["k"], poison=True).first()["mean"] is None


def scene_rows(spark, disp, gnss, ok, **more):
    full = {"gnss": gnss, "coherence": np.full(disp.shape, 0.9), "correction": np.full(disp.shape, 0.01), **more}
    df = field(spark, disp, **full).withColumnRenamed("v", "disp")
    good = spark.createDataFrame([(int(r), int(c), bool(ok[r, c])) for r, c in np.ndindex(ok.shape)], "r long, c long, ok boolean")
    df = df.join(good, ["r", "c"]).withColumn("r", F.col("r").cast("int")).withColumn("c", F.col("c").cast("int"))
    return df.withColumn("event", F.col("event") > 0) if "event" in more else df


@pytest.mark.parametrize("events", [False, True])
def test_windowed_calibration_sees_through_a_bump(spark, events):
    r, c = np.indices((16, 16))
    ramp = 0.3 + 0.02 * c - 0.01 * r
    bump = ((r - 8) ** 2 + (c - 8) ** 2 <= 4) * 5.0
    gnss = 0.001 * (c + r)
    ok = (r + 2 * c) % 9 != 4
    more = {"event": (bump > 0).astype(float)} if events else {}
    df = scene_rows(spark, ramp + bump + gnss + 0.01, gnss, ok, **more)
    out = calibrate_windowed(df, ["k"], (16, 16), (4, 4), 8, events=events, sigma=0.0)
    got = back(out, "calibration", (16, 16))
    inner = np.zeros((16, 16), bool)
    inner[1:-1, 1:-1] = True
    assert np.isnan(got[~ok]).all() and np.isfinite(got[ok & inner]).all()
    # Filled cells repeat their neighbours, so that the surface bends by far less than the bump of 5.
    assert np.abs(got - ramp - 0.01)[ok & inner].max() < 0.1
    both = back(out, "calibrated", (16, 16)) + got
    assert np.allclose(both[ok & inner], (ramp + bump + gnss + 0.01)[ok & inner])


def test_windowed_calibration_of_a_plane_is_exact_and_shrinks_fields(spark):
    r, c = np.indices((16, 16))
    ramp = 0.02 * c - 0.01 * r
    ok = np.ones((16, 16), bool)
    df = scene_rows(spark, ramp + 0.01, np.zeros((16, 16)), ok)
    inner = slice(3, -3)
    exact = back(calibrate_windowed(df, ["k"], (16, 16), (4, 4), 8, sigma=0.0), "calibration", (16, 16))
    assert np.allclose(exact[inner, inner], (ramp + 0.01)[inner, inner])
    half = back(calibrate_windowed(df, ["k"], (16, 16), (4, 4), 8, factor=2), "calibration", (16, 16))
    assert np.abs(half - ramp - 0.01)[inner, inner].max() < 0.03
    with pytest.raises(Exception, match="reference cell is invalid"):
        ok = ok.copy()
        ok[4, 4] = False
        calibrate_windowed(scene_rows(spark, ramp, ramp, ok), ["k"], (16, 16), (4, 4), 8).collect()


def test_stratified_fit_finds_its_coefficients_and_needs_enough_cells(spark):
    r, c = np.indices((20, 20))
    h = np.random.default_rng(6).random((20, 20)) * 2
    v = 1.0 + 2.0 * c / 100 - 3.0 * r / 100 + 0.5 * h - 0.25 * h * h
    v[0, 0] = np.nan
    df = field(spark, v, h=h)
    row = fits.stratified(df, ["k"], step=2).first()
    assert row.n == 99 and np.allclose(row.coef, [1.0, 2.0, -3.0, 0.5, -0.25])
    assert fits.stratified(df, ["k"], step=7).first().coef is None


def test_robust_weights_match_numpy(spark):
    rng = np.random.default_rng(8)
    v, w = rng.normal(size=(9, 9)), rng.random((9, 9))
    v[4, 4], w[2, 2] = 40.0, 0.0
    robust = np.ones_like(v)
    for _ in range(2):
        u = w * robust
        d = (v - smooth_array(u * v, 1.5, "nearest") / smooth_array(u, 1.5, "nearest"))
        far = np.abs(d - np.median(d[u > 0]))
        z = far / (1.4826 * np.median(far[u > 0]))
        robust = np.where((u <= 0) | (z > 4.0), 0.0, np.where(z > 1.345, 1.345 / z, 1.0))
    got = back(robust_weights(field(spark, v, w=w), ["k"], (9, 9), 1.5), "robust", (9, 9))
    assert np.allclose(got, robust) and got[4, 4] == 0 and got[2, 2] == 0


def test_mask_growth_matches_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(4):
        coh, vel = rng.random((9, 11)) * 0.95, rng.normal(0, 2, (9, 11))
        want = {(i, j) for i, j in np.ndindex(coh.shape) if coh[i, j] >= 0.85}
        for level in (0.80, 0.75, 0.70, 0.65, 0.60):
            fresh = set()
            for i, j in np.ndindex(coh.shape):
                d, y, x = min(((i - y) ** 2 + (j - x) ** 2, y, x) for y, x in want)
                if coh[i, j] >= level - 1e-12 and d <= 9 and abs(vel[i, j] - vel[y, x]) <= 2.0:
                    fresh.add((i, j))
            want |= fresh
        got = kernels.grow_mask(coh, vel, reach=3)
        assert {(i, j) for i, j in np.argwhere(got).tolist()} == want
    assert not kernels.grow_mask(np.zeros((3, 3)), np.zeros((3, 3))).any()


def test_geodesics_reach_the_published_place(spark):
    """Flinders Peak to Buninyong, the worked example of the Australian datum's manual."""
    dms = lambda d, m, s: d + m / 60 + s / 3600
    start = spark.createDataFrame([(dms(144, 25, 29.52440), -dms(37, 57, 3.72030), dms(306, 52, 5.37), 54972.271)], "lon double, lat double, az double, m double")
    got = footprints.along(start, F.col("lon"), F.col("lat"), F.col("az"), F.col("m")).first()
    assert abs(got["lon"] - dms(143, 55, 35.38390)) < 2e-8 and abs(got["lat"] + dms(37, 39, 10.15610)) < 2e-8


def test_event_rings_lie_around_the_rupture(spark):
    rows = spark.createDataFrame([(1, 20.0, 0.0, 7.0, 0.0), (2, 179.99, 10.0, 5.0, 90.0), (3, None, 0.0, 6.0, 0.0)], "event int, lon double, lat double, magnitude double, strike double")
    got = footprints.event_rings(rows, "event").toPandas()
    one = got[got.event == 1].sort_values("ord")
    length = 10 ** (-3.55 + 0.74 * 7)
    assert len(one) == 67 and np.allclose(one.iloc[0][["lon", "lat"]].astype(float), one.iloc[-1][["lon", "lat"]].astype(float), atol=1e-12)
    # Metres at the equator: each vertex is a buffer away from the part of the meridian that broke.
    x, y = np.radians(one.lon - 20) * 6378.137, np.radians(one.lat) * 6335.439
    away = np.hypot(x, np.maximum(np.abs(y) - length / 2, 0))
    assert np.allclose(one.buffer_km, max(15, 0.75 * length)) and np.allclose(away, one.buffer_km, rtol=2e-4)
    assert np.sum(x.values[:-1] * y.values[1:] - x.values[1:] * y.values[:-1]) < 0  # clockwise
    two = got[got.event == 2]
    assert np.allclose(two.buffer_km, 15) and two.lon.min() < -179 and two.lon.max() > 179 and two.lon.between(-180, 180).all()
    assert got[got.event == 3][["lon", "lat"]].isna().all(axis=None)
    assert footprints.event_rings(rows.limit(0), "event").count() == 0


def test_land_pieces_stay_apart_over_water(spark):
    shape = (40, 61)
    r, c = np.indices(shape)
    land = (c < 28) | (c >= 32)
    ok = land & ((r + 2 * c) % 5 > 0) & (c != 40)
    rows = field(spark, ok.astype(float), land=land.astype(float)).select("k", "r", "c", (F.col("v") > 0).alias("ok"), (F.col("land") > 0).alias("land"))
    for land_known, pieces in ((True, 2), (False, 1)):
        cells = rows if land_known else rows.withColumn("land", F.lit(True))
        got = back(areas.land_pieces(cells, ["k"], shape, factor=2, closing=2, least=20), "piece", shape)
        assert set(got[got > 0]) == set(range(1, pieces + 1))
        assert (got[:, 60] == 0).all() and not np.isnan(got).any()
        if land_known:
            assert (got[:, 28:32] == 0).all() and got[20, 10] == 1 and got[20, 50] == 2


def test_draft_areas_find_what_moves_against_the_trend(spark):
    shape = (60, 70)
    r, c = np.indices(shape)
    v = 0.5 * r - 0.3 * c + 2 + 0.2 * np.sin(7 * r + 3 * c)
    v[(r - 20) ** 2 + (c - 20) ** 2 <= 64] += 12
    v[(r - 45) ** 2 + (c - 55) ** 2 <= 30] -= 20
    v[5, 60] += 50  # a single cell, opened away
    v[20, 20] = np.nan
    df = field(spark, v)
    p = areas.regional_plane(df, ["k"]).first()
    assert abs(p.p0 - 2) < 0.1 and abs(p.px + 0.3) < 0.01 and abs(p.py - 0.5) < 0.01
    draw = lambda sign: sorted(areas.draft_areas(df, ["k"], shape, threshold=5, least=20, buffer=3, opening=1, sign=sign).collect(), key=lambda x: x.area)
    one, two = draw("both")
    assert (one.area, two.area) == (1, 2) and one.cells > two.cells and one.reaches and two.ring > 0.9
    assert (one.r0, one.r1, one.c0, one.c1) == (9, 31, 9, 31) and abs(one.peak - 12) < 0.6 and abs(two.peak - 20) < 0.6
    assert [x.r0 for x in draw("positive")] == [9] and [x.c1 for x in draw("negative")] == [63]
    flat = areas.regional_plane(field(spark, 1.0 * r + c), ["k"]).first()
    assert abs(flat.px - 1) < 1e-9 and abs(flat.py - 1) < 1e-9
