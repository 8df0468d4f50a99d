"""Edge rules of the DataFrame operators on small closed-form data."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from gridweave.functions import gas
from gridweave.functions.numeric import fdiv
from gridweave.operators import boundary_layer as bl
from gridweave.operators import fields, grid, interp, numeric, probe, stencil, surface, views
from gridweave.plans import bindings, registry
from gridweave.sources import snapshots, text


@pytest.fixture(scope="module")
def cells(spark):
    rows = [Row(case_id="a", snapshot=0, i=i, j=j, x=float(i), y=j * 0.5, f=1.0 + 2 * i + 3 * j * 0.5, rho=1.0, u=float(j), v=0.0, ib_markers=1.0 if j <= 1 else 0.0, vel_mag=0.0 if j <= 1 else 20.0) for i in range(6) for j in range(5)]
    return spark.createDataFrame(rows).cache()


def one(df):
    return df.head()


def test_fdiv_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(fdiv("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 0.25 and got[4] is None


def test_nearest_station_takes_the_first_of_ties(cells):
    assert one(grid.nearest_index(cells, "x", "i", 2.5))["i"] == 2


def test_profiles_mirror_and_validate(cells):
    up = [r["distance"] for r in grid.wall_normal_profile(cells, "f", 2.0, 1.0, 2.0).orderBy("ord").collect()]
    down = [r["distance"] for r in grid.wall_normal_profile(cells, "f", 2.0, 1.0, 0.0, "negative").orderBy("ord").collect()]
    assert up == down == [0.0, 0.5, 1.0]
    assert grid.wall_normal_profile(cells, "f", 2.0, 9.0).count() == 0
    with pytest.raises(ValueError):
        grid.wall_normal_profile(cells, "f", 2.0, side="left")


def test_gradients_are_exact_on_linear_data(cells):
    w = grid.line(cells, "i")
    for col in (stencil.gradient("f", "x", w), stencil.gradient_uniform("f", w, 1.0)):
        assert {round(r[0], 9) for r in cells.select(col).collect()} == {2.0}
    single = cells.filter("i = 0")
    assert {r[0] for r in single.select(stencil.gradient("f", "x", grid.line(single, "i"))).collect()} == {None}


def test_uniform_density_gives_white_schlieren(cells):
    assert {r[0] for r in fields.schlieren(cells).select("schlieren").collect()} == {1.0}
    assert {r[0] for r in fields.schlieren(cells, "f", compat="swapped").select(F.round("schlieren", 9)).collect()} != set()


def test_masks_need_a_threshold(cells):
    with pytest.raises(ValueError):
        grid.mask("f", None)
    with pytest.raises(KeyError):
        grid.streamline_field(cells, u="nothing")
    with pytest.raises(ValueError):
        grid.plane_slice(cells, "xyz")


def test_field_names_resolve_by_alias():
    assert grid.resolve_fields(["Temp", "density"], ["rho", "Temperature"]) == {"rho": "density", "Temperature": "Temp"}
    assert grid.resolve_fields(["Temp", "q"]) == {"Temperature": "Temp", "q": "q"}
    with pytest.raises(KeyError):
        grid.resolve_fields(["Temp"], ["p"])


def test_trapezoid_adds_over_a_split(spark):
    df = spark.range(11).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") * F.col("id")).cast("double").alias("f"), F.col("id").cast("double").alias("s"))
    whole = one(stencil.trapezoid(df, "f", "s", ["k"], "o", "t"))["t"]
    parts = [one(stencil.trapezoid(df.filter(c), "f", "s", ["k"], "o", "t"))["t"] for c in ("o <= 4", "o >= 4")]
    assert whole == pytest.approx(sum(parts)) == pytest.approx(335.0)
    assert one(stencil.trapezoid(df.filter("o = 3"), "f", "s", ["k"], "o", "t"))["t"] == 0.0


def test_origin_fit_and_its_degenerate_case(spark):
    df = spark.createDataFrame([(1, s, 3 * s - 2 * s * s) for s in (0.1, 0.2, 0.4)] + [(2, 2.0, 5.0), (2, 2.0, 5.0), (3, 1.0, 1.0)], "k int, s double, u double")
    got = {r["k"]: r for r in stencil.origin_fit(df, "u", "s", ["k"]).collect()}
    assert (got[1]["a"], got[1]["b"]) == pytest.approx((3.0, -2.0))
    assert (got[2]["a"], got[2]["b"]) == pytest.approx((0.5, 1.0))  # least norm
    assert got[3]["a"] is None


def test_gaps_fill_and_clamp(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([None, 2.0, nan, 4.0, None])], "k int, o int, f double")
    assert [r["g"] for r in stencil.fill_gaps(df, "f", ["k"], "o", "g").orderBy("o").collect()] == [2, 2, 3, 4, 4]


def test_bins_are_anchored_not_chained(spark):
    df = spark.createDataFrame([(x, x) for x in (0.0, 0.6, 1.2, 1.8, 2.4, 3.0, 3.6)], "x double, v double")
    assert [r["x"] for r in stencil.anchored_bins(df, "x", [], 1.0, ("v",)).orderBy("bin").collect()] == [0.0, 1.2, 2.4, 3.6]


def test_natural_order_and_padding(spark):
    df = spark.createDataFrame([("plt10",), ("plt9",), ("PLT1",)], "p string").orderBy(stencil.natural_key("p"))
    assert [r["p"] for r in df.collect()] == ["PLT1", "plt9", "plt10"]
    assert [r[0] for r in spark.createDataFrame([(7,), (123456,)], "s long").select(views.padded("s")).collect()] == ["00007", "123456"]


def test_linspace_of_one(spark):
    assert [r["value"] for r in stencil.linspace(spark, 2.0, 5.0, 1).collect()] == [2.0]


def test_interpolation_clamps_and_hits_knots(spark):
    knots = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (3.0, -1.0)], "x double, y double")
    q = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (2.0,), (9.0,)], "x double")
    assert [r["v"] for r in interp.interpolate(q, knots, "x", "y", "v").orderBy("x").collect()] == [1, 1, 2, 3, 1, -1]


def test_bilinear_is_exact_and_extrapolates(spark, cells):
    pts = spark.createDataFrame([(1, 2.3, 0.7), (2, 5.0, 2.0), (3, 6.0, 0.0)], "point_id int, px double, py double")
    got = {r["point_id"]: r["g"] for r in interp.bilinear(pts, cells, "f", "g", 0.0, 1.0, 6, 0.0, 0.5, 5).collect()}
    assert got == pytest.approx({1: 1 + 4.6 + 2.1, 2: 17.0, 3: 13.0})
    assert {r["point_id"]: r["g"] for r in interp.bilinear(pts, cells, "f", "g", 0.0, 1.0, 6, 0.0, 0.5, 5, extrapolate=False).collect()}[3] is None


def test_marker_surface_of_a_plate(cells):
    got = surface.marker_surface(cells, max_x=3.0).orderBy("side", "idx").collect()
    assert [(r["side"], r["i"], r["j"], r["y_interp"]) for r in got] == [("upper", i, 2, 0.75) for i in range(4)]


def test_tetrahedron_cut(spark, tmp_path):
    p = [(0, 0, -1), (2, 0, 1), (0, 2, 1), (0, 0, 1)]
    body = "".join(f"facet normal 0 0 1\nouter loop\n" + "".join(f"vertex {p[k][0]} {p[k][1]} {p[k][2]}\n" for k in f) + "endloop\nendfacet\n" for f in ((0, 1, 2), (0, 2, 3), (0, 3, 1)))
    (tmp_path / "t.stl").write_text("solid t\n" + body + "facet normal 0 0 1\nvertex 0 0 0\nendfacet\nendsolid\n")
    tri = text.triangles(spark, str(tmp_path / "t.stl"))
    assert tri.count() == 3
    cut = {(round(r["h"], 9), round(r["v"], 9)) for r in surface.plane_points(tri, "xy", 0.0).collect()}
    assert cut == {(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)}


def test_probe_rules(spark):
    df = spark.createDataFrame([("a", 1, k, t) for k, t in enumerate([0.0, 1.0, 2.0, 0.5, 1.5])], "case_id string, probe_id int, seq long, t double")
    assert [r["seq"] for r in probe.reset_trim(df).orderBy("seq").collect()] == [3, 4]
    assert probe.reset_trim(df, skip=1).count() == 4
    assert probe.reset_trim(df.filter("seq < 3")).count() == 3
    assert probe.head_fraction(df, 0.1).count() == 1
    with pytest.raises(ValueError):
        probe.head_fraction(df, 0.0)
    assert one(probe.sampling(df.filter("seq = 0")))["dt"] is None


def test_pure_tone_has_one_line(spark):
    n = 64
    df = spark.createDataFrame([("a", 1, k, k * 0.01, 5 + 3 * math.sin(2 * math.pi * 8 * k / n)) for k in range(n)], "case_id string, probe_id int, seq long, t double, v double")
    got = probe.spectrum(df, "v").orderBy(F.desc("amplitude")).collect()
    assert len(got) == 31 and got[0]["k"] == 8 and got[0]["amplitude"] == pytest.approx(3.0) and got[1]["amplitude"] < 1e-9


def test_linear_layer_thicknesses(spark):
    df = spark.range(201).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") / 200.0).alias("y"))
    got = one(bl.thicknesses(df, "y", "y", ["k"], "o"))
    assert (got["delta_star"], got["theta"], got["H"]) == pytest.approx((0.5, 1 / 6, 3.0), rel=1e-3)


def test_gas_goldens(spark):
    df = spark.createDataFrame([(273.15, 1e6)], "t double, re double")
    got = one(df.select(gas.viscosity("t"), gas.laminar_cf("re"), gas.turbulent_cf("re"), gas.turbulent_cf("re", "power-law"), gas.turbulent_cf("re", "schlichting")))
    assert list(got) == pytest.approx([1.716e-5, 6.64e-4, 3.6095985e-3, 3.7352675e-3, 4.4707581e-3])
    with pytest.raises(ValueError):
        gas.turbulent_cf("re", "guess")
    with pytest.raises(ValueError):
        gas.compressible_cf("re", "re", "re", "re", method="guess")


def test_text_tables(spark, tmp_path):
    (tmp_path / "probe3_prim.dat").write_text("0.0 1.0 2.0 3.0\n\n# c\n 0.1\t1.5 2.5 3.5 # tail\n")
    got = text.probes(spark, str(tmp_path / "probe3_prim.dat")).orderBy("seq").collect()
    assert [(r["probe_id"], r["t"], r["p"]) for r in got] == [(3, 0.0, 3.0), (3, 0.1, 3.5)]
    (tmp_path / "alt.txt").write_text("# y V\n0 1\n1 2\n")
    header = text.header_of(spark, str(tmp_path / "alt.txt"))
    assert header == {"y": 0, "V": 1}
    assert text.table(spark, str(tmp_path / "alt.txt"), {"value": "V"}, header=header).count() == 2
    with pytest.raises(ValueError):
        text.table(spark, str(tmp_path / "alt.txt"), {"value": "W"}, header=header)
    with pytest.raises(ValueError):
        text.scaled_profile(None, transform="boundary_layer_nondim")


def test_configuration():
    assert text.case_list("a.h5") == [{"source": "a.h5"}]
    assert text.case_list([{"path": "p", "label": "x"}]) == [{"label": "x", "source": "p"}]
    for bad, error in ((3, TypeError), ({"label": "x"}, ValueError)):
        with pytest.raises(error):
            text.case_list(bad)
    assert text.option_bool(" Yes ") and not text.option_bool("off")
    with pytest.raises(ValueError):
        text.option_bool("maybe")


def test_series_files(spark):
    df = spark.createDataFrame([("/r/plt10",), ("/r/plt2/",), ("/r/plt3.old.1",), ("/r/chk1",)], "path string")
    files = text.series_files(df)
    assert [r["name"] for r in files.orderBy("key").collect()] == ["plt2", "plt10"]
    assert one(text.pick(files))["name"] == "plt10"


def test_refined_levels_flatten_to_the_finest(spark):
    df = spark.createDataFrame([("a", 0, 0, 0, 0, 1.0), ("a", 0, 1, 1, 1, 9.0)], "case_id string, plot_id int, level int, i long, j long, f double")
    got = {(r["i"], r["j"]): r["f"] for r in snapshots.flattened(df, 2, 1, ["f"]).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 9.0}


def test_seeds_validate(spark):
    for bad in ({"count": 0}, {"low": 2.0}, {"spacing": "odd"}):
        with pytest.raises(ValueError):
            views.seed_line(spark, **({"x": 0.0, "low": 0.0, "high": 1.0, "count": 3} | bad))


def test_first_cell_friction_has_no_wall_distance(spark):
    df = spark.createDataFrame([(1.0, 300.0, 0.5, 0.5), (1.0, 300.0, 0.6, 0.5)], "u_t double, T_wall double, y double, wall_y double")
    got = [r["C_f_direct"] for r in bl.first_cell_friction(df, bl.FreeStream(100.0, 1.0)).collect()]
    assert got[0] is None and got[1] == pytest.approx(1.8459163e-5 / 0.1 / 5000)


def test_windows_never_span_a_grid(cells):
    plan = fields.vorticity(cells)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
    assert Window is not None


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_single_point_layers_of_every_station(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["idx"]: r for r in registry.QUERIES["bl_single_point"](spark, sf).collect()}
    u0 = bindings.grid(spark, sf).groupBy("i").agg(F.avg("u").alias("u0")).orderBy("i").collect()
    assert sorted(got) == list(range(len(u0)))
    s = (np.arange(3, 9) - 2.5) * 0.0005  # the fluid cells of the fit
    slope = np.linalg.lstsq(np.stack([s, s**2], 1), 1000 * np.tanh(s / 0.003), rcond=None)[0][0]
    out_s = np.append(0.0, s[0] + np.tanh(1.5 * np.linspace(0, 1, 100)) / np.tanh(1.5) * 0.015)
    layer = bl.layer_of(out_s, 1000 * np.tanh(out_s / 0.003), registry.STREAM, False, False)
    for idx, r in enumerate(u0):
        t_wall = 300 + r["u0"] / 100
        assert got[idx]["status"] == "ok" and got[idx]["T_wall"] == pytest.approx(t_wall, abs=1e-4)
        assert got[idx]["C_f"] == pytest.approx(bl.mu(t_wall) * slope / registry.STREAM.q, abs=2e-9)
        assert got[idx]["u_edge"] == pytest.approx(layer["u_edge"], abs=0.1) and got[idx]["H"] == pytest.approx(layer["H"], abs=2e-3)


def test_surface_normals_by_case_and_side(spark):
    walls = {("a", "upper", 80): lambda x: 0.1 * x + 0.02 * np.sin(9 * x), ("a", "lower", 51): lambda x: -0.2 * x, ("b", "upper", 60): lambda x: 0.5 - 0.3 * x**2, ("b", "lower", 1): lambda x: 0 * x}
    rows = [(c, 0, side, k, 0.01 * k, float(np.round(f(0.01 * k), 2))) for (c, side, n), f in walls.items() for k in reversed(range(n))]  # a staircase
    df = spark.createDataFrame(rows, "case_id string, snapshot long, side string, idx int, x double, y_interp double")
    got = numeric.surface_normals(df).toPandas().sort_values("idx")
    for (case, side, n), _ in walls.items():
        own = got[(got.case_id == case) & (got.side == side)]
        x, y = own.x.to_numpy(), own.y_interp.to_numpy()
        if n > 51:  # each point by the cubic through its window, the ends by the first and last one
            low = [min(max(k - 25, 0), n - 51) for k in range(n)]
            y = np.array([np.polyval(np.polyfit(np.arange(a - k, a - k + 51), y[a : a + 51], 3), 0) for k, a in enumerate(low)])
        assert np.allclose(own.y_smooth, y, atol=1e-9)
        if n == 1:
            assert own[["nx", "ny", "theta"]].isna().all(axis=None)
            continue
        at = [(max(k - 1, 0), min(k + 1, n - 1)) for k in range(n)]
        dx, dy = (np.array([(f[b] - f[a]) / (b - a) for a, b in at]) for f in (x, y))
        sign = 1 if side == "upper" else -1
        size = np.hypot(dx, dy)
        want = {"tangent_x": dx / size, "tangent_y": dy / size, "nx": -sign * dy / size, "ny": sign * dx / size, "theta": np.arctan2(dy, dx)}
        for name, value in want.items():
            assert np.allclose(own[name], value, atol=1e-6), (case, side, name)


def test_marker_layers_follow_a_sloped_wall(spark):
    slope, stream = 0.5, bl.FreeStream(1000.0, 0.02)
    size = math.hypot(1.0, slope)
    rows = []
    for i in range(60):
        for j in range(80):
            x, y = i * 0.001, j * 0.0005
            d = (y - slope * x - 0.00475) / size  # the wall is halfway between cell centres in every column
            along = 1000 * math.tanh(max(d, 0.0) / 0.002)
            rows.append((0, i, j, x, y, along / size, along * slope / size, 1.0 if d < 0 else 0.0, 0.0 if d < 0 else 100.0))
    cells = spark.createDataFrame(rows, "snapshot long, i int, j int, x double, y double, u double, v double, ib_markers double, vel_mag double")
    cells = cells.withColumns({"p": F.lit(2000.0), "rho": F.lit(0.02), "Temperature": F.lit(300.0)})
    pts = surface.marker_surface(cells).filter("side = 'upper'")
    got = {r["idx"]: r for r in bl.surface_table(pts, cells, stream, smooth=False).collect()}
    assert len(got) == 60 and {r["status"] for r in got.values()} == {"ok"}
    flat = {r["idx"]: r for r in bl.surface_table(pts.withColumns({"nx": F.lit(0.0), "ny": F.lit(1.0)}), cells, stream, smooth=False).collect()}
    for idx in range(15, 45):
        edge = got[idx]["u_edge"]
        assert edge == pytest.approx(1000.0, rel=0.01)
        want = 0.002 * math.atanh(0.99 * edge / 1000.0) - 0.00025 / size  # from the cell centre along the wall's normal
        assert got[idx]["delta_99"] == pytest.approx(want, rel=0.03)
        assert flat[idx]["u_edge"] < 950
