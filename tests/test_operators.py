"""Units, recipes, bins, models, interpolation, flags, averaging, sources and streams."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfringe.functions.jones import Cx, Jones, abs_ratio, corrected_weights, inv_abs2, rotation
from sparkfringe.operators import angles, apply, bda, binning, flagging, interpolation, model, preprocess, weights
from sparkfringe.plans import config, queries
from sparkfringe.plans.schemas import CHUNK
from sparkfringe.sources import tables
from sparkfringe.streaming import windows


@pytest.mark.parametrize(("text", "want"), [("5", 5), (0, 0), ("300s", 300.0), (291.0, 291.0), ("1e1 s", 10.0)])
def test_times(text, want):
    got = config.as_time(text)
    assert got == want and type(got) is type(want)


@pytest.mark.parametrize(("text", "want"), [("7", 7), ("10MHz", 1e7), ("1.5 GHz", 1.5e9), ("2kHz", 2e3), ("3Hz", 3.0)])
def test_frequencies(text, want):
    assert config.as_freq(text) == want


def test_bad_units():
    for text in ("5m", "x", "-3s"):
        with pytest.raises(ValueError):
            config.as_time(text)


RECIPES = [
    ("", [[]]), ("A", [["+A"]]), ("A+B", [["+A", "+B"]]), ("A~B", [["+A", "-B"]]), ("~A", [["-A"]]), ("A:B", [["+A"], ["+B"]]),
    ("A+B:C~D", [["+A", "+B"], ["+C", "-D"]]), (" A + B : ~C ", [["+A", "+B"], ["-C"]]), ("A~B~C+D", [["+A", "-B", "-C", "+D"]]),
]


@pytest.mark.parametrize(("text", "want"), RECIPES)
def test_recipes(text, want):
    assert [["+-"[s < 0] + n for s, n, _ in d] for d in config.parse_recipe(text).directions] == want


def test_recipe_tags_and_errors():
    r = config.parse_recipe("sky.lsm.html@dE,x~COL:COL2")
    assert r.directions[0][0] == (1, "sky.lsm.html", ("dE", "x")) and r.columns == ["COL", "COL2"] and r.sky_models == ["sky.lsm.html"]
    for bad in ("A:", "A++B", "A+", "m@a+n@b"):
        with pytest.raises(ValueError):
            config.parse_recipe(bad)


def test_options(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(config.blank(("G", "B")))
    made = config.load(str(path), {"G": {"time_interval": "8s"}}, arguments=["B.type=delay", "solver.robust=true"])
    assert made.terms["G"].time_interval == 8.0 and made.terms["B"].type == "delay" and made.solver.robust
    assert "solver.robust = True" in config.final_config(made) and "solver.robust" in config.help_text()
    for wrong in ({"X": {}}, {"solver": {"nothing": 1}}, {"G": {"type": "odd"}}, {"G": {"type": "crosshand_phase"}}, {"G": {"scalar": True}}, {"solver": {"terms": ["A", "A"], "iter_recipe": [1, 1]}}, {"solver": {"terms": ["A", "B"]}}, {"output": {"products": ["residual"]}}, {"mad_flags": {"whitening": "odd"}}, {"input_ms": {"group_by": ["scan"]}}):
        with pytest.raises((config.ConfigError, ValueError)):
            config.load(wrong)


def greedy(lengths, limit, strict):
    out, total, k = [], 0.0, 0
    for x in lengths:
        out.append(k)
        total += x
        if total > limit if strict else total >= limit:
            total, k = 0.0, k + 1
    return out


def test_greedy_bins(spark):
    rng = np.random.default_rng(1)
    for strict in (True, False):
        for limit in (3.0, 7.5, 100.0):
            lengths = [float(x) for x in rng.integers(1, 5, 40)]
            df = spark.createDataFrame([(lengths,)], "x array<double>")
            assert df.select(binning.fold_bins(F.col("x"), limit, strict)).first()[0] == greedy(lengths, limit, strict)


def test_time_bins_break_at_scans(spark):
    rows = [(s, 0, 0, 10.0 * s + t, 8.0, 1) for s in range(3) for t in range(5)]
    times = spark.createDataFrame(rows, "scan int, field int, ddid int, time double, interval double, n_rows int")
    keys = ("field", "ddid")
    chunked = binning.time_chunks(times, 0, keys)
    whole = [r.t_bin for r in binning.time_bins(chunked, 2, respect_scans=False, keys=keys).orderBy("time").collect()]
    split = [r.t_bin for r in binning.time_bins(chunked, 2, respect_scans=True, keys=keys).orderBy("time").collect()]
    assert whole == [k // 2 for k in range(15)]
    assert split == [3 * s + t // 2 for s in range(3) for t in range(5)]
    by_length = [r.t_bin for r in binning.time_bins(chunked, 20.0, keys=keys).orderBy("time").collect()]
    assert by_length == [2 * s + t // 3 for s in range(3) for t in range(5)]


def rand(rng, n):
    return rng.normal(size=n) + 1j * rng.normal(size=n)


def as_df(spark, **named):
    cells = {k: [(float(z.real), float(z.imag)) for z in v] for k, v in named.items()}
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} array<struct<re:double,im:double>>" for k in cells))


def value(df, jones: Jones):
    return np.array([complex(z.re, z.im) for z in df.select(jones.column()).first()[0]])


def test_jones_algebra(spark):
    rng = np.random.default_rng(2)
    a, b = rand(rng, 4), rand(rng, 4)
    df = as_df(spark, a=a, b=b)
    ja, jb = Jones.of(F.col("a"), 4), Jones.of(F.col("b"), 4)
    ma, mb = a.reshape(2, 2), b.reshape(2, 2)
    assert np.allclose(value(df, ja @ jb), (ma @ mb).ravel())
    assert np.allclose(value(df, ja @ jb.herm()), (ma @ mb.conj().T).ravel())
    assert np.allclose(value(df, ja.inverse()), np.linalg.inv(ma).ravel())
    assert np.allclose(value(df, Jones((Cx.lit(1), Cx.lit(1), Cx.lit(1), Cx.lit(1))).inverse()), 0)
    k = [df.select(x.column()).first()[0] for x in ja.kron_t(jb)]
    assert np.allclose([complex(z.re, z.im) for z in k], np.kron(ma, mb.T).ravel())
    w = [1.0, 2.0, 3.0, 4.0]
    got = df.select(F.array(*corrected_weights(ja, jb, [F.lit(x) for x in w]))).first()[0]
    assert np.allclose(got, (np.abs(np.kron(ma, mb.conj())) ** 2).T @ w)
    for n in (1, 2):
        short = Jones.of(F.col("a"), n)
        assert np.allclose(value(df, short.inverse()), 1 / a[:n]) and np.allclose(value(df, short @ short.herm()), np.abs(a[:n]) ** 2)
    assert df.select(inv_abs2(Cx.lit(0))).first()[0] == 0 and df.select(abs_ratio(Cx.lit(3, 4), Cx.lit(0))).first()[0] == 0
    r = value(df, rotation(F.lit(0.4), False)).reshape(2, 2)
    assert np.allclose(r, [[math.cos(0.4), math.sin(0.4)], [-math.sin(0.4), math.cos(0.4)]])
    with pytest.raises(ValueError):
        Jones((Cx.lit(1),) * 3)


NAN = np.nan


@pytest.mark.parametrize("roll", range(3))
@pytest.mark.parametrize("holes", [[], [(0, 0)], [(0, 0), (0, 1), (0, 2)], [(0, 0), (1, 1), (2, 2)], [(0, 1), (1, 1), (2, 1)]])
def test_filling_constants(roll, holes):
    x = np.arange(3.0)
    grid = np.ones((3, 3, 1))
    for t, f in holes:
        grid[t, f] = NAN
    assert (interpolation.fill_grid(x, x, np.roll(grid, roll, 0)) == 1).all()
    assert (interpolation.fill_grid(x, x, np.roll(grid, roll, 1)) == 1).all()
    assert (interpolation.fill_grid(x, x, np.full((3, 3, 1), NAN)) == 0).all()


@settings(max_examples=40, deadline=None)
@given(st.integers(4, 8), st.floats(-2, 2), st.floats(-2, 2))
def test_splines_keep_cubics_and_planes(n, a, b):
    x = np.sort(np.random.default_rng(n).uniform(0, 5, n))
    to = np.linspace(x[0], x[-1], 17)
    assert np.allclose(interpolation.spline(x, (a * x**3 + b * x)[:, None], to)[:, 0], a * to**3 + b * to, atol=1e-6)
    plane = (a * x[:, None] + b * x[None, :])[..., None]
    assert np.allclose(interpolation.bilinear(x, x, plane, to, to)[..., 0], a * to[:, None] + b * to[None, :], atol=1e-9)
    outside = interpolation.bilinear(x, x, plane, np.array([-9.0]), to[:1])
    assert np.allclose(outside, plane[0, interpolation.nearest(x, to[:1])[0]])


@pytest.mark.parametrize("method", ["2dlinear", "2dspline"])
def test_identity_gains_stay_identity(spark, method):
    rows = [("G", a, 0, float(t), 1e9 + f * 1e6, [(1.0, 0.0), (1.0, 0.0)], 1 if (t, f) == (2, 2) else 0) for a in range(2) for t in range(5) for f in range(5)]
    gains = spark.createDataFrame(rows, "term string, ant int, dir int, gain_time double, gain_freq double, g array<struct<re:double,im:double>>, gain_flag int")
    targets = spark.createDataFrame([("G", -1.0, 1e9, 1), ("G", 1.5, 1.0015e9, 2), ("G", 99.0, 2e9, 3)], "term string, gain_time double, gain_freq double, tag int")
    interpolation.check_overlap(gains)
    out = interpolation.from_real(interpolation.interpolate(interpolation.to_real(gains, 2), targets, method), 2).collect()
    assert len(out) == 6 and all(abs(complex(z.re, z.im) - 1) < 1e-9 for r in out for z in r.g)
    with pytest.raises(ValueError):
        interpolation.check_overlap(gains.union(gains))


def test_lookup_in_series_of_many_ranges(spark):
    """Series over many ranges, of which some know nothing, a short one, one of the key null, and one of unknown places alone."""
    rng = np.random.default_rng(5)
    series = {1: (np.arange(0, 30_000, 3_000), np.arange(-500, 33_000)), 2: (rng.choice(9_000, 900, False), np.arange(0, 9_000, 2)), None: (np.array([4.0]), np.arange(9)), 4: (np.array([]), np.arange(3))}
    table = lambda rows: spark.createDataFrame(rows, "k int, x double, y double")
    known = [(k, float(x), math.sin(x)) for k, (own, _) in series.items() for x in own]
    wanted = [(k, float(x), None) for k, (_, to) in series.items() for x in to]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = interpolation.linear_lookup(table(known), table(wanted).drop("y"), ["k"])
        plan, rows = found._jdf.queryExecution().toString().lower(), found.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "unboundedfollowing" not in plan  # such a frame costs the square of a series' length
    assert len(rows) == len(wanted)
    for k, (own, to) in series.items():
        got = sorted((r["x"], r["y"]) for r in rows if r["k"] == k)
        own = np.sort(own)
        assert [x for x, _ in got] == sorted(map(float, to))
        assert all(y is None for _, y in got) if not len(own) else np.allclose([y for _, y in got], np.interp(np.sort(to), own, np.sin(own)))


def test_smoothing_follows_a_direct_sum(spark):
    rng = np.random.default_rng(3)
    x, good = rng.normal(size=30), rng.random(30) > 0.2
    df = spark.createDataFrame([(0, k, float(a), bool(g)) for k, (a, g) in enumerate(zip(x, good, strict=True))], "k int, i int, x double, good boolean")
    got = [r.smoothed for r in interpolation.smooth(df, ["k"], "i", "x", "good").orderBy("i").collect()]
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    pad = lambda v: np.pad(v, 4, mode="symmetric")
    conv = lambda v: np.array([(pad(v)[k : k + 9] * w).sum() for k in range(30)])
    assert np.allclose(got, conv(np.where(good, x, 0)) / conv(good.astype(float)))


def test_digamma_and_dof():
    assert abs(weights.digamma(1.0) + 0.5772156649015329) < 1e-6
    rng = np.random.default_rng(4)
    eta = rng.gamma(3.0, 1 / 3.0, 200_000) * 1.0
    dof = weights.degrees_of_freedom(float((np.log(eta) - eta).mean()), 6.0, 2)
    assert 1 <= dof <= 30


def test_mad_finds_outliers(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(600):
        z = rng.normal(size=2) + (40 if k == 7 else 0)
        rows.append((0, 0, 0, 0, 0, k % 4, k % 4 + 1 + k % 3, [(float(z[0]), float(z[1]))] * 2, [1.0, 1.0], 0))
    df = spark.createDataFrame(rows, "scan int, field int, ddid int, t_chunk int, f_chunk int, ant1 int, ant2 int, residual array<struct<re:double,im:double>>, weight array<double>, flag byte")
    out = flagging.mad_flags(flagging.whitened(df, 2), 2, 10.0, 12.0)
    hit = out.where("flag = 1").collect()
    assert len(hit) == 1 and hit[0].residual[0].re > 20
    assert flagging.mad_flags(flagging.whitened(df, 2), 2, 0.0, 0.0).where("flag = 1").count() == 0
    still = df.withColumn("residual", F.array(*[Cx.lit(1).column()] * 2))
    assert flagging.mad_flags(flagging.whitened(still, 2), 2).where("flag = 1").count() == 600


def test_flags_and_weights(spark):
    inf = float("inf")
    rows = [([(1.0, 0.0), (2.0, inf)], [1.0, 2.0], [False, False], False, 0, 1, 3.0, 4.0), ([(1.0, 1.0), (1.0, 1.0)], [1.0, 0.0], [False, False], False, 0, 1, 3.0, 4.0),
            ([(1.0, 1.0)] * 2, [1.0, 1.0], [False, True], False, 0, 1, 3.0, 4.0), ([(1.0, 1.0)] * 2, [1.0, 1.0], [False] * 2, True, 0, 1, 3.0, 4.0),
            ([(1.0, 1.0)] * 2, [1.0, 1.0], [False] * 2, False, 2, 2, 3.0, 4.0), ([(1.0, 1.0)] * 2, [1.0, 1.0], [False] * 2, False, 0, 1, 30.0, 40.0), ([(1.0, 1.0)] * 2, [1.0, 1.0], [False] * 2, False, 0, 1, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "data array<struct<re:double,im:double>>, weight array<double>, flag array<boolean>, flag_row boolean, ant1 int, ant2 int, u double, v double").coalesce(1)
    out = preprocess.preprocess(df, 2, "weight", uv_range=(1.0, 10.0)).collect()
    assert [r.flag for r in out] == [1, 1, 1, 1, -1, -1, 0]
    assert (out[0].data[1].re, out[0].data[1].im) == (0.0, 0.0)
    with pytest.raises(IndexError):
        preprocess.select_correlations(df, [2], 2)


def test_averaged_data_round_trip(spark):
    vis = queries.visibilities(spark, queries_dir())
    up = bda.upsample_channels(vis, F.lit(3))
    back = bda.downsample(up, 2, F.lit(3), ("scan", "row_id", "ant1", "ant2", "time", "u"))
    a = back.agg(F.sum(F.col("weight")[0]), F.sum(F.col("data")[0]["re"] * 0 + 1)).first()
    assert abs(a[0] - vis.agg(F.sum(F.col("weight")[0])).first()[0]) < 1e-6 * a[0]
    assert bda.common_interval(spark.createDataFrame([(8.0,), (12.0,)], "interval double")) == 4.0


def queries_dir() -> str:
    return "/root/testdata/sf0.001"


def test_plans_push_columns_and_filters(spark):
    plan = preprocess.select_partitions(queries.visibilities(spark, queries_dir()), 1).select("scan")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" in plan and "l_extendedprice" not in plan.split("ReadSchema")[-1]


def test_rotation_takes_itself_off(spark):
    z = [(1.0, 0.5), (0.2, 0.0), (0.1, -0.3), (0.8, 0.0)]
    vis = spark.createDataFrame([(0, 0, 0, 5e9, 0, 1, z)], "scan int, field int, ddid int, time double, ant1 int, ant2 int, data array<struct<re:double,im:double>>")
    fields = spark.createDataFrame([(0, 0.3, -0.5)], "field int, phase_ra double, phase_dec double")
    ants = spark.createDataFrame([(0, 5e6, 1e6, -3e6), (1, 5.1e6, 1e6, -2.9e6)], "ant int, x double, y double, z double")
    feeds = spark.createDataFrame([(0, 0, ["X", "Y"], [0.1, 0.1]), (1, 0, ["X", "Y"], [0.0, 0.0])], "ant int, spw int, pol_type array<string>, receptor_angle array<double>")
    angles.check_receptors(feeds)
    own = angles.parallactic_angles(vis.select("scan", "field", "ddid", "time"), ants, fields, feeds)
    for circular in (False, True):
        there = angles.apply_rotation(vis, own, ["data"], circular)
        back = angles.apply_rotation(there, own, ["data"], circular, derotate=True).first().data
        assert np.allclose([[x.re, x.im] for x in back], z)
    with pytest.raises(ValueError):
        angles.check_receptors(feeds.withColumn("receptor_angle", F.array(F.lit(0.0), F.lit(1.0))))


def test_sky_models(spark):
    text = "#name ra dec i spi emaj tags\nA 1:00:00 -30.30.00 2.0 -0.7 0 dE\nB 15.0 -30.0 1.0 0 1e-5 x\nC 15.0 -30.0 1.0 0 0 x"
    rows = tables.parse_sky_model(text, "m", ("dE",))
    assert [(r[1], r[2]) for r in rows] == [("A", "point"), ("DIE", "gauss"), ("DIE", "point")]
    assert all(r[9] == 0 and r[10] == 1e9 for r in rows)  # without any reference frequency all are flat
    tagged = "#name ra dec i spi freq0 tags\nA 1.0 2.0 1 -0.7 1.2e9 +dE,cluster=far\nB 1.0 2.0 1 -0.5 - dE,cluster=far\nC 1.0 2.0 1 0 - dE\nD 1.0 2.0 1 0 1.5e9 x"
    assert [(r[1], r[9], r[10]) for r in tables.parse_sky_model(tagged, "m", ("dE",))] == [("far", -0.7, 1.2e9), ("far", -0.5, 1.2e9), ("C", 0.0, 1.2e9), ("DIE", 0.0, 1.5e9)]
    assert {r[1] for r in tables.parse_sky_model(tagged, "m")} == {"DIE"} and model.cluster_order(["b", "DIE", "a"]) == ["DIE", "a", "b"]
    assert abs(rows[0][3] - math.radians(15)) < 1e-12 and abs(rows[0][4] + math.radians(30.5)) < 1e-12
    html = "<table><tr><th>name<th>ra</th><th>dec</th><th>i</th></tr><tr><td>A</td><td>10.0</td><td>-5.0</td><td>3</td></tr></table>"
    assert tables.parse_sky_model(html.replace("<th>name", "<th>name</th>"), "h")[0][5] == 3.0
    sources = spark.createDataFrame(rows, tables.SOURCES)
    fields = spark.createDataFrame([(0, math.radians(15), math.radians(-30.5))], "field int, phase_ra double, phase_dec double")
    vis = spark.createDataFrame([(0, 0, 0, 1, 0, 1.4e9, 0.0, 0.0, 0.0)], "scan int, field int, ddid int, row_id long, chan int, freq double, u double, v double, w double")
    sky = model.predict(vis, sources, fields, 4).first().sky
    assert len(sky) == 2 and abs(sky[1][0].re - 2.0) < 1e-9 and abs(sky[0][3].re - 2.0) < 1e-9
    far = vis.unionByName(vis.selectExpr("scan", "0 AS field", "ddid", "2L AS row_id", "1 AS chan", "1.5e9D AS freq", "310.0D AS u", "-120.0D AS v", "7.0D AS w"))
    shaped = spark.createDataFrame([("m", c, kind, math.radians(ra), -0.53, i, 0.3, 0.2, 0.1, spi, 1.4e9, e, e / 2, 0.4) for c, kind, ra, i, spi, e in (("a", "gauss", 15.1, 2.0, -0.7, 1e-4), ("a", "point", 14.9, 1.0, 0.0, 0.0), ("DIE", "point", 15.2, 3.0, 0.5, 0.0))], tables.SOURCES)
    for n_corr, circular in ((4, False), (4, True), (2, False), (1, False)):
        held = model.predict(far, shaped, fields, n_corr, circular, invert_uvw=True).orderBy("row_id").collect()
        few, model._few = model._few, lambda *_: False
        try:
            by_join = model.predict(far, shaped, fields, n_corr, circular, invert_uvw=True).orderBy("row_id").collect()
        finally:
            model._few = few
        assert np.allclose([[[(z.re, z.im) for z in j] for j in r.sky] for r in held], [[[(z.re, z.im) for z in j] for j in r.sky] for r in by_join])


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path)
    subs = {
        "ANTENNA": [(0, "a", "alt", 5e6, 1e6, -3e6, False), (1, "b", "alt", 5e6, 1e6, -3e6, False)], "SPECTRAL_WINDOW": [(0, [1e9, 1.1e9], [1e8, 1e8], 1e9, 2e8)],
        "POLARIZATION": [(0, [9, 12])], "DATA_DESCRIPTION": [(0, 0, 0)], "FIELD": [(0, "f", 0, 0.1, 0.2)], "FEED": [(0, 0, ["X", "Y"], [0.0, 0.0])],
    }
    for name, rows in subs.items():
        spark.createDataFrame(rows, tables.SUB_TABLES[name]).write.parquet(f"{path}/{name}")
    cx = (1.0, 0.0)
    vis = spark.createDataFrame([(0, 0, 0, 1, 0.0, 8.0, 0, 1, 1.0, 1.0, 1.0, c, [cx, cx], [1.0, 1.0], [False, False], False) for c in (0, 1)], "scan int, field int, ddid int, row_id long, time double, interval double, ant1 int, ant2 int, u double, v double, w double, chan int, data array<struct<re:double,im:double>>, weight array<double>, flag array<boolean>, flag_row boolean")
    tables.write_main(vis, path)
    read = tables.read_sub_tables(spark, path)
    assert tables.correlation_names(read, 0) == ["XX", "YY"]
    out = tables.with_axes(tables.read_main(spark, path), read)
    assert sorted((r.freq, r.max_freq, r.field_name) for r in out.collect()) == [(1e9, 1.1e9, "f"), (1.1e9, 1.1e9, "f")]
    with pytest.raises(ValueError):
        tables.read_main(spark, path, ["nothing"])
    where = tables.backup(vis, "data", f"{path}/copy")
    back = tables.restore(vis.withColumn("data", F.array(Cx.lit(0).column())), spark.read.parquet(where), "data")
    assert {len(r.data) for r in back.collect()} == {2}
    tables.write_products(vis.withColumn("residual", F.col("data")), f"{path}/new", {"residual": "RES"}, vis)
    assert "RES" in spark.read.parquet(f"{path}/new/MAIN").columns
    from sparkfringe.operators import stats

    assert set(stats.sub_table_summaries(read)) == set(subs)
    from sparkfringe.plans import calibrate

    done = calibrate.run(spark, config.load({"input_ms": {"path": path}, "output": {"path": f"{path}/out", "products": ["residual"], "columns": ["R"]}, "solver": {"iter_recipe": [3]}, "G": {"type": "diag_complex"}}))
    assert spark.read.parquet(f"{path}/out/MAIN").count() == 2 and done.stats.count() == 1
    plot = tables.plot_data(done.gain, "amplitude", mean_over=("gain_freq",))
    assert tables.write_plots(plot, f"{path}/plots", ["ant"], "gain_time").count() == 2


def simulated(spark, path: str, n_corr: int = 4):
    """A small measurement of one point source off the centre, on disk."""
    subs = {
        "ANTENNA": [(k, f"a{k}", "alt", 5e6 + 1e3 * k, 1e6 + 2e3 * k, -3e6, False) for k in range(4)], "SPECTRAL_WINDOW": [(0, [1e9, 1.1e9], [1e8, 1e8], 1e9, 2e8)],
        "POLARIZATION": [(0, [9, 10, 11, 12])], "DATA_DESCRIPTION": [(0, 0, 0)], "FIELD": [(0, "f", 0, 0.5, -0.5)], "FEED": [(k, 0, ["X", "Y"], [0.0, 0.0]) for k in range(4)],
    }
    for name, rows in subs.items():
        spark.createDataFrame(rows, tables.SUB_TABLES[name]).write.parquet(f"{path}/{name}")
    rows, cx = [], (1.0, 0.0)
    for t in range(3):
        for p in range(4):
            for q in range(p + 1, 4):
                for c in (0, 1):
                    rows.append((0, 0, 0, t * 100 + p * 10 + q, 5.1e9 + 8.0 * t, 8.0, p, q, 30.0 * (p - q), 20.0 * (p - q) + t, 1.0, c, [cx] * n_corr, [1.0] * n_corr, [False] * n_corr, False))
    schema = "scan int, field int, ddid int, row_id long, time double, interval double, ant1 int, ant2 int, u double, v double, w double, chan int, data array<struct<re:double,im:double>>, weight array<double>, flag array<boolean>, flag_row boolean"
    vis = spark.createDataFrame(rows, schema)
    with open(f"{path}/sky.txt", "w") as f:
        f.write("#name ra dec i q tags\nA 28.7 -28.6 2.0 0.5 dE\nB 28.6 -28.7 1.0 0.0 x\n")
    tables.write_main(vis, path)
    read = tables.read_sub_tables(spark, path)
    sources = tables.read_sky_models(spark, {f"file://{path}/sky.txt": ("dE",)})
    full = tables.with_axes(vis, read)
    sky = model.predict(full, sources, read["FIELD"], 4, invert_uvw=True)
    both = (Jones.of(F.col("sky")[0], 4) + Jones.of(F.col("sky")[1], 4)).column()
    data = vis.drop("data").join(sky.select("row_id", "chan", both.alias("data")), ["row_id", "chan"])
    data.write.parquet(f"{path}-data")
    return read, sources, full, spark.read.parquet(f"{path}-data")


def test_runs_with_sky_models_and_angles(spark, tmp_path):
    path = str(tmp_path / "ms")
    read, sources, full, data = simulated(spark, path)
    tables.write_main(data, path, "overwrite")
    sky = f"file://{path}/sky.txt"
    base = {"input_ms": {"path": path, "weight_column": "weight"}, "input_model": {"recipe": f"{sky}@dE"}, "solver": {"terms": ["G"], "iter_recipe": [20]}}
    plain = calibrate_run(spark, base | {"G": {"type": "phase", "freq_interval": 0, "time_interval": 0}})
    assert all(r.postsolve_chisq < 1e-12 for r in plain.stats.collect())
    split = calibrate_run(spark, base | {"G": {"type": "diag_complex", "freq_interval": 0, "time_interval": 0, "direction_dependent": True, "pinned_directions": [1]}})
    assert split.gain.select("dir").distinct().count() == 2
    pinned = split.gain.where("dir = 1").select(F.max(F.abs(F.col("g")[0]["re"] - 1)).alias("x")).first().x
    assert pinned < 1e-9
    turned = calibrate_run(spark, base | {"solver": {"terms": ["P"], "iter_recipe": [0]}, "P": {"type": "parallactic_angle"}, "output": {"apply_p_jones_inv": True}})
    g = turned.gain.first().g
    assert abs(g[0].re ** 2 + g[1].re ** 2 - 1) < 1e-9 and abs(g[1].re) > 1e-3
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -64", "NAXIS   =                    3", "NAXIS1  =                    2", "NAXIS2  =                    2", "NAXIS3  =                    1", "END"]
    for corr in range(4):
        for part, value in (("re", [1.0, 0.0, 0.0, 1.0][corr] * 0.5), ("im", 0.0)):
            body = np.full(4, value).astype(">f8").tobytes()
            (tmp_path / f"b{corr}{part}.fits").write_bytes("".join(c.ljust(80) for c in cards).ljust(2880).encode() + body.ljust(2880, b"\0"))
    with_beam = base | {"input_model": base["input_model"] | {"beam": f"file://{tmp_path}/b$(corr)$(reim).fits", "beam_l_axis": [-0.1, 0.1], "beam_m_axis": [-0.1, 0.1]}}
    dim = calibrate_run(spark, with_beam | {"G": {"type": "amplitude", "freq_interval": 0, "time_interval": 0}})
    assert abs(dim.gain.first().g[0].re - 2.0) < 1e-3  # the beam is a half, so amplitudes are two


def calibrate_run(spark, options):
    from sparkfringe.plans import calibrate

    return calibrate.run(spark, config.load(options))


def test_command_line(spark, tmp_path, capsys):
    from sparkfringe import cli

    path = str(tmp_path / "ms")
    simulated(spark, path)
    assert cli.main(["config", f"{tmp_path}/c.yaml", "G"]) == 0
    assert cli.main(["calibrate", f"{tmp_path}/c.yaml", f"input_ms.path={path}", f"output.path={tmp_path}/out", "G.type=phase"], spark) == 0
    assert cli.main(["summary", path], spark) == 0 and "DIMENSIONS" in capsys.readouterr().out
    assert cli.main(["backup", path, f"{tmp_path}/copy", "--column", "data"], spark) == 0
    assert cli.main(["restore", path, f"{tmp_path}/copy/backup-data", f"{tmp_path}/back", "--column", "data"], spark) == 0
    assert cli.main(["plot", f"{tmp_path}/out/gains", "G", f"{tmp_path}/plots", "--transform", "phase"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/back/MAIN").count() == spark.read.parquet(f"{path}/MAIN").count()


def test_phases_go_the_short_way(spark):
    got = interpolation.phase_interp(np.array([0.5, -1.0]), np.array([0.0, 1.0]), np.array([3.0, -3.0]))
    assert abs(abs(got[0]) - math.pi) < 1e-9 and got[1] == 3.0
    gains = spark.createDataFrame([([(2.0, 0.0), (3.0, 0.0)],)], "g array<struct<re:double,im:double>>")
    out = interpolation.align_correlations(gains, ["XX", "YY"], ["XX", "XY", "YX", "YY"]).first().g
    assert [z.re for z in out] == [2.0, 0.0, 0.0, 3.0]


def test_beam_cubes(spark, tmp_path):
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -64", "NAXIS   =                    3", "NAXIS1  =                    2", "NAXIS2  =                    2", "NAXIS3  =                    1", "END"]
    for name, shift in (("re", 0.0), ("im", 10.0)):
        data = (np.arange(4.0) + shift).astype(">f8").tobytes()
        (tmp_path / f"{name}.fits").write_bytes("".join(c.ljust(80) for c in cards).ljust(2880).encode() + data.ljust(2880, b"\0"))
    grid = tables.beam_grid(spark, {0: (f"{tmp_path}/re.fits", f"{tmp_path}/im.fits")}).orderBy("m", "l").collect()
    assert [(r.re, r.im) for r in grid] == [(0.0, 10.0), (1.0, 11.0), (2.0, 12.0), (3.0, 13.0)]


def test_stream_windows(spark, tmp_path):
    rows = [(k, 0, [(1.0, 0.0)], [2.0], 0 if k % 2 else 1) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, ddid int, residual array<struct<re:double,im:double>>, weight array<double>, flag int")
    df.selectExpr("timestamp_seconds(k) AS ts", "ddid", "residual", "weight", "flag").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    run = windows.windowed_chi_squared(stream, 1, "10 seconds", "5 seconds").writeStream.format("memory").queryName("chi").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    out = spark.sql("SELECT * FROM chi").collect()
    assert len(out) == 4 and all(r.chisq == 2.0 and r.n == 5 for r in out)
    assert windows.windowed_flags(spark.read.parquet(f"{tmp_path}/in"), "10 seconds", "5 seconds").first().flagged == 0.5


def test_step_columns_stay_small(spark):
    vis = queries._applied(spark, queries_dir())
    two = [queries.TERM]
    out = apply.corrected(apply.residual(vis, two, 2, 2), two, 2)
    assert not [c for c in out.columns if c.startswith("_step")] and set(CHUNK) <= set(out.columns)
