"""Tiled sampling and splines against whole grids in one process."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridweave.operators import boundary_layer as bl
from gridweave.operators import interp, spline, surface, tiles

STREAM = bl.FreeStream(1000.0, 0.02)


def field_of(ni=40, nj=90, seed=1, hole=False):
    """A layer over a curved body, wetted on both sides, on uneven axes."""
    r = np.random.default_rng(seed)
    x, y = np.cumsum(r.uniform(0.004, 0.008, ni)), np.cumsum(r.uniform(0.0004, 0.0007, nj))
    y -= y.mean()
    wall = 0.003 + 0.1 * x * x
    depth = np.abs(y)[None, :] - wall[:, None]
    u = 1000.0 * np.tanh(depth / 0.002) + 20 * np.sin(40 * x)[:, None] * np.cos(300 * y)[None, :]
    t = 300 + 40 * np.cos(200 * y)[None, :] * np.ones((ni, 1))
    v = 30 * np.sin(100 * depth)
    if hole:
        u[ni // 2, nj // 2 + 15] = np.nan
    return x, y, {"u": u, "v": v, "T": t}, wall


def tables(spark, x, y, f, case="a"):
    i, j = np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij")
    wall = 0.003 + 0.1 * x[i] * x[i]
    solid = np.abs(y[j]) < wall
    frame = pd.DataFrame({"case_id": case, "snapshot": 0, "i": i.ravel(), "j": j.ravel(), "x": x[i].ravel(), "y": y[j].ravel(), "u": f["u"].ravel(), "v": f["v"].ravel(), "Temperature": f["T"].ravel(), "p": 2000.0, "rho": 0.02, "ib_markers": solid.ravel() * 1.0, "vel_mag": (~solid).ravel() * 100.0})
    return spark.createDataFrame(frame).withColumns({"u": F.nullif(F.col("u"), F.lit(float("nan"))), "i": F.col("i").cast("int"), "j": F.col("j").cast("int")})


def points_of(cells):
    sign, slope = F.when(F.col("side") == "upper", 1.0).otherwise(-1.0), 0.2 * F.col("x")
    size = F.sqrt(1 + slope * slope)
    return surface.marker_surface(cells, max_x=100.0).withColumns({"nx": -slope / size, "ny": sign / size, "y_exact": sign * (0.003 + 0.1 * F.col("x") * F.col("x"))})


@pytest.mark.parametrize(("mode", "cubic", "size", "hole"), [("body", False, 7, False), ("body", False, 1000, True), ("marker", False, 8, False), ("body", True, 16, False)])
def test_layers_equal_those_of_the_whole_grid(spark, mode, cubic, size, hole):
    x, y, f, _ = field_of(hole=hole)
    cells = tables(spark, x, y, f)
    pts = points_of(cells)
    got = {(r["side"], r["idx"]): r for r in bl.surface_table(pts, cells, STREAM, mode=mode, cubic=cubic, smooth=False, height=0.012, n=60, size=size).collect()}
    whole = bl.Grid(x, y, f, cubic, mode == "marker")
    rows = pts.collect()
    assert {r["side"] for r in rows} == {"upper", "lower"} and len(got) == len(rows)
    for r in rows:
        try:
            want = bl.marker_point(whole, r["i"], r["j"], r["nx"], r["ny"], STREAM, height=0.012, n=60) if mode == "marker" else bl.single_point(whole, r["i"], r["nx"], r["ny"], r["y_exact"], STREAM, height=0.012, n=60)
        except ValueError:
            want = None
        own = got[r["side"], r["idx"]]
        assert own["status"] == ("ok" if want else "failed")
        for c in bl.POINT if want else ():
            assert own[c] == pytest.approx(want[c], rel=1e-9, nan_ok=True), (r["side"], r["idx"], c)
    assert sum(r["status"] == "ok" for r in got.values()) > len(rows) / 2


def test_no_group_is_larger_than_a_tile(spark):
    x, y, f, _ = field_of(ni=33, nj=65)
    cells = tables(spark, x, y, f)
    n = tiles.tiled(cells, {"u": "u"}, 16).groupBy("case_id", "snapshot", "ti", "tj").count().collect()
    assert max(r["count"] for r in n) == 17 * 17 and {(r["ti"], r["tj"]) for r in n} == {(a, b) for a in range(3) for b in range(5)}


def test_cubic_equals_the_spline_of_the_whole_grid(spark):
    x, y, f, _ = field_of(ni=23, nj=37)
    cells = tables(spark, x, y, f).union(tables(spark, x, y, {**f, "T": f["T"] ** 2}, "b"))
    r = np.random.default_rng(3)
    px, py = np.append(r.uniform(x[0] - 0.01, x[-1] + 0.01, 300), [x[0], x[-1], x[5], np.nan]), np.append(r.uniform(y[0] - 0.002, y[-1] + 0.002, 300), [y[0], y[-1], y[5], 0.0])
    rows = [(c, 0, k % 280, float(a), float(b)) for c in "ab" for k, (a, b) in enumerate(zip(px, py, strict=True))]
    pts = spark.createDataFrame(rows, "case_id string, snapshot long, point_id long, px double, py double")
    got = spline.cubic(pts, cells, "Temperature", "value", size=8)
    assert got.columns == ["case_id", "snapshot", "point_id", "px", "py", "value"] and got.count() == len(rows)
    want = {"a": interp.cubic_grid_at(x, y, f["T"], px, py), "b": interp.cubic_grid_at(x, y, f["T"] ** 2, px, py)}
    at = {(a, b): k for k, (a, b) in enumerate(zip(px.tolist(), py.tolist(), strict=True))}
    for q in got.collect():
        if q["px"] == q["px"]:
            assert q["value"] == pytest.approx(want[q["case_id"]][at[q["px"], q["py"]]], rel=1e-12, nan_ok=True)
        else:
            assert q["value"] != q["value"]


def test_edges(spark):
    x, y, f, _ = field_of(ni=6, nj=12)
    cells = tables(spark, x, y, f)
    pts = spark.createDataFrame([("a", 0, 1, None, 0.0), ("z", 0, 2, float(x[2]), 0.0)], "case_id string, snapshot long, point_id long, px double, py double")
    assert all(r["value"] != r["value"] for r in spline.cubic(pts, cells, "u", "value").collect())
    assert spline.cubic(pts.limit(0), cells, "u", "value").count() == 0
    assert spline.cubic(pts, cells.limit(0), "u", "value").count() == 2
    flat = points_of(cells).withColumn("nx", F.lit(None).cast("double"))
    assert {r["status"] for r in bl.surface_table(flat, cells, STREAM, mode="body", smooth=False).collect()} <= {"failed"}


def test_wall_cells_at_ties(spark):
    axis = spark.createDataFrame([(k, float(k)) for k in range(3)], "j int, y double")
    walls = spark.createDataFrame([(1, "lower", 1.0), (2, "upper", 1.0), (3, "lower", 0.0), (4, "upper", 2.5), (5, "lower", 1.5)], "id int, side string, wall_y double")
    at = lambda strict: {r["id"]: (r["j_fluid"], r["j_ghost"]) for r in interp.wall_cells(walls, axis, strict=strict).collect()}
    assert at(False) == {1: (1, 2), 2: (1, 0), 3: (0, 1), 4: (2, 1), 5: (1, 2)}
    assert at(True) == {1: (0, 1), 2: (1, 0), 3: (0, 1), 4: (2, 1), 5: (1, 2)}


def test_overlay_entry(spark):
    from gridweave.operators import fields

    rows = [("a", k, 0, float(k), 0.0, float(v), 5.0 - k, 1.0 if k == 3 else 0.0) for k, v in enumerate([-2.0, 0.1, 3.0, 99.0, float("nan")])] + [("b", 0, 0, 0.0, 0.0, 1.0, 1.0, 0.0)]
    cells = spark.createDataFrame(rows, "case_id string, i int, j int, x double, y double, vorticity double, Schlieren double, ib_markers double")
    of = lambda **how: {(r["case_id"], r["i"]): r for r in fields.overlay(cells, **how).collect()}
    got = of()
    assert [got["a", k]["shown"] for k in range(5)] == [True, True, True, False, False] and got["a", 3]["base"] != got["a", 3]["base"]
    assert (got["a", 0]["low"], got["a", 0]["high"], got["a", 0]["signed"], got["b", 0]["signed"], got["b", 0]["shown"]) == (-2.0, 3.0, True, False, True)
    assert [of(deadband=0.5)["a", k]["shown"] for k in range(3)] == [True, False, True]
    assert [of(low=1.0, high=-1.0)["a", k]["shown"] for k in range(3)] == [False, True, False]
    assert [of(low=-1.0, high=1.0, mask_out_of_range=False, signed=False, deadband=0.0)["a", k]["shown"] for k in range(3)] == [False, True, True]
    with pytest.raises(Exception, match="no finite value of vorticity"):
        fields.overlay(cells.filter("i = 4")).collect()
