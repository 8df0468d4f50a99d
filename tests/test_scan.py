"""Scans over range partitions against plain windows and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import interp, scan, stencil


def series(spark, n=5000, seed=2):
    r = np.random.default_rng(seed)
    key = np.where(r.random(n) < 0.7, "one", r.choice(list("abc"), n))  # one key holds most rows
    return spark.createDataFrame([(str(k), int(o), float(x), float(y)) for k, o, x, y in zip(key, r.permutation(n), r.normal(size=n), r.normal(size=n), strict=True)], "key string, ord long, x double, y double").repartition(5)


@pytest.mark.parametrize("keys", [["key"], []])
def test_long_scans_equal_windows(spark, keys):
    df = series(spark)
    for name, how in (("arc", lambda long: stencil.with_arc_length(df, "x", "y", keys, "ord", "out", long=long)), ("running", lambda long: stencil.with_running_trapezoid(df, "x", "y", keys, "ord", "out", long=long))):
        got, want = ({r["ord"]: r["out"] for r in how(long).collect()} for long in (True, False))
        assert len(got) == 5000 and got == pytest.approx(want, rel=1e-9, abs=1e-9), name
    if keys:
        got, want = (sorted(map(tuple, stencil.trapezoid(df, "x", "y", keys, "ord", "out", long=long).collect())) for long in (True, False))
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_a_long_series_is_dealt_to_many_tasks(spark):
    cut = scan.parts(series(spark).filter("key = 'one'"), ["key"], "ord", number=16)
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16
    plan = stencil.with_arc_length(series(spark), "x", "y", [], "ord", long=True)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    plan = interp.interpolate(series(spark), series(spark, seed=3), "x", "y", "out")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_neighbours_with_ties_across_parts(spark):
    rows = [(float(k // 7), k, k % 5 == 0) for k in range(700)]
    df = spark.createDataFrame(rows, "x double, n long, knot boolean").withColumn("at", F.when(F.col("knot"), F.struct("x", "n")))
    got = scan.with_neighbours(scan.parts(df, [], "x", number=13), [], "x", "at").collect()
    xs = sorted({x for x, _, knot in rows if knot})
    for r in got:
        before, after = [x for x in xs if x <= r["x"]], [x for x in xs if x >= r["x"]]
        assert (r["_before"]["x"] if r["_before"] else None) == (before[-1] if before else None)
        assert (r["_after"]["x"] if r["_after"] else None) == (after[0] if after else None)
    assert len(got) == 700


def test_interpolation_without_keys(spark):
    r = np.random.default_rng(5)
    kx, ky, qx = r.permutation(500) / 10.0, r.normal(size=500), np.append(r.uniform(-5, 60, 800), [0.0, 49.9, 10.0])
    knots = spark.createDataFrame(list(zip(kx.tolist(), ky.tolist(), strict=True)), "x double, y double")
    queries = spark.createDataFrame([(k, x) for k, x in enumerate(qx.tolist())], "id long, x double")
    got = {r["id"]: r["v"] for r in interp.interpolate(queries, knots, "x", "y", "v").collect()}
    order = np.argsort(kx)
    assert [got[k] for k in range(len(qx))] == pytest.approx(np.interp(qx, kx[order], ky[order]).tolist(), rel=1e-12)


def test_empty_tables(spark):
    df = series(spark, 50)
    none = df.limit(0)
    assert stencil.with_arc_length(none, "x", "y", ["key"], "ord", long=True).count() == 0
    assert interp.interpolate(none, df, "x", "y", "v").count() == 0
    walls = spark.createDataFrame([], "id int, side string, wall_y double")
    assert interp.wall_cells(walls, spark.createDataFrame([(0, 0.0), (1, 1.0)], "j int, y double")).count() == 0


def fold(xs, tol):
    bins, anchor = [], None
    for x in sorted(set(xs)):
        if anchor is None or x - anchor >= tol:
            anchor = x
            bins.append([])
        bins[-1].append(x)
    return [(k, b[0], b[0], b[-1]) for k, b in enumerate(bins)]


@pytest.mark.parametrize("tol", [0.5, 0.1, 1e-9, 1000.0])
def test_anchored_bins_equal_the_fold(spark, tol):
    r = np.random.default_rng(7)
    xs = {"dense": np.round(r.uniform(0, 30, 1500), 3), "grid": np.arange(200) * 0.1, "apart": r.uniform(0, 1e6, 50), "one": np.array([3.0])}
    rows = [(k, float(x)) for k, own in xs.items() for x in own]
    df = spark.createDataFrame(rows, "key string, x double").withColumn("v", F.col("x"))
    got = {}
    for b in stencil.anchored_bins(df, "x", ["key"], tol, ("v",)).collect():
        got.setdefault(b["key"], []).append((b["bin"], b["x"], b["min_v"], b["max_v"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: fold(v.tolist(), tol) for k, v in xs.items()}


def test_anchored_bins_without_keys_or_tolerance(spark):
    xs = [0.0, 1e-7, 0.5, 0.5 + 3e-7, 0.5 + 1.2e-6, 1.0]
    df = spark.createDataFrame([(x, x) for x in xs], "x double, v double")
    assert sorted((b["bin"], b["x"], b["min_v"], b["max_v"]) for b in stencil.anchored_bins(df, "x", [], None, ("v",)).collect()) == fold(xs, 1e-6)
    assert stencil.anchored_bins(df.limit(0), "x", [], None, ("v",)).count() == 0
