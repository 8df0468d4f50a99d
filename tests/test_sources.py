"""Sources, sinks and views on small files and stubs of the readers that aren't installed."""

import sys
import types

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridweave.operators import fields, grid, interp, probe, surface, views
from gridweave.sources import sinks, snapshots, text


class Stored(dict):
    """An open snapshot."""

    def __enter__(self):
        return self

    def __exit__(self, *error):
        return False


def snapshot(names, sizes=(3, 2)):
    axes = [np.linspace(0, 1, n + 1) * (k + 1) for k, n in enumerate(sizes)]
    flat = {n: 10.0 * k + np.arange(np.prod(sizes)) for k, n in enumerate(names)}
    return Stored({snapshots.dataset_name(k + 1): v for k, v in enumerate([*axes, *flat.values()])}), axes, flat


@pytest.mark.parametrize("three", [False, True])
def test_snapshot_reader(monkeypatch, three):
    names = snapshots.FIELDS_3D if three else snapshots.FIELDS_2D
    db, axes, flat = snapshot(names, (3, 2, 2) if three else (3, 2))
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=lambda path, mode: db))
    reader = snapshots.SnapshotReader(["/r/p0/40"], names, ["u", "p"], three)
    (part,) = reader.partitions()
    (got,) = (b.to_pydict() for b in reader.read(part))
    n = 12 if three else 6
    assert got["path"] == ["/r/p0/40"] * n and got["p"] == flat["p"].tolist() and got["u"] == flat["u"].tolist()
    assert got["i"] == [0, 1, 2] * (n // 3) and got["j"][:6] == [0, 0, 0, 1, 1, 1]
    centre = (axes[0][1:] + axes[0][:-1]) / 2
    assert got["x"] == pytest.approx([centre[i] for i in got["i"]])
    if three:
        assert got["k"] == [0] * 6 + [1] * 6


def test_snapshot_schema_and_missing_reader(spark, monkeypatch):
    source = snapshots.SnapshotSource({"paths": "a,b", "species": "false", "fields": "p,u"})
    assert source.schema() == "path string, i int, j int, x double, y double, u double, p double"
    assert [p.value for p in source.reader(None).partitions()] == ["a", "b"]
    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(ImportError, match="h5py"):
        list(source.reader(None).read(source.reader(None).partitions()[0]))


def test_rank_files(tmp_path):
    for name in ("p0", "p1", "root"):
        (tmp_path / name).mkdir()
    (tmp_path / "p0" / "10").write_text("")
    assert snapshots.data_file(str(tmp_path / "collection_10")) == str(tmp_path / "p0" / "10")
    assert snapshots.data_file(str(tmp_path / "collection_11")) == str(tmp_path / "collection_11")
    assert snapshots.data_file("x/10") == "x/10"
    (tmp_path / "p1" / "10").write_text("")
    with pytest.raises(ValueError):
        snapshots.data_file(str(tmp_path / "collection_10"))


class Patch:
    """A grid of a refined hierarchy."""

    def __init__(self, level, begin, size, value):
        self.Level, self.begin, self.ActiveDimensions, self.value = level, begin, np.array([*size, 1]), value

    def get_global_startindex(self):
        return np.array([*self.begin, 0])

    def __getitem__(self, name):
        return np.full(self.ActiveDimensions, self.value)


def test_plotfile_batches(spark, monkeypatch):
    patches = [Patch(0, (0, 0), (2, 1), 1.0), Patch(1, (2, 0), (2, 2), 5.0)]
    ds = types.SimpleNamespace(
        field_list=[("boxlib", "density"), ("boxlib", "Temp")], domain_left_edge=[0, 0, 0], domain_right_edge=[200, 100, 1], domain_dimensions=[2, 1, 1],
        current_time=0.5, refine_by=2, index=types.SimpleNamespace(max_level=1, grids=patches),
    )
    monkeypatch.setitem(sys.modules, "yt", types.SimpleNamespace(load=lambda path: ds))
    fields_ = ("density", "Temp")
    source = snapshots.PlotfileSource({"paths": "plt0", "fields": ",".join(fields_)})
    batches = list(source.reader(None).read(source.reader(None).partitions()[0]))
    levels = spark.createDataFrame([r for b in batches for r in b.to_pylist()], source.schema())
    got = {(r["i"], r["j"]): r for r in snapshots.plotfile_cells(levels, fields_).collect()}
    assert sorted(got) == [(i, j) for i in range(4) for j in range(2)]
    assert [got[i, 0]["rho"] for i in range(4)] == [1000.0, 1000.0, 5000.0, 5000.0]  # CGS to SI
    assert got[2, 1]["Temperature"] == 5.0 and (got[2, 1]["x"], got[2, 1]["y"], got[2, 1]["time"]) == pytest.approx((1.25, 0.75, 0.5))
    assert {r["rho"] for r in snapshots.plotfile_cells(levels, fields_, si=False).collect()} == {1.0, 5.0}
    with pytest.raises(KeyError):
        list(snapshots.plotfile_batches("plt0", ("pressure",)))


def test_plotfile_series(spark, tmp_path):
    for name in ("plt10", "plt9", "plt8.old.1", "chk1", "plt7"):
        (tmp_path / name).mkdir()
        if name != "plt7":
            (tmp_path / name / "Header").write_text("")
    (tmp_path / "plt6").write_text("not a folder")
    names = lambda df: [r["name"] for r in df.orderBy("key").collect()]
    found = snapshots.plotfile_series(spark, str(tmp_path))
    assert names(found) == ["plt9", "plt10"]
    assert names(snapshots.plotfile_series(spark, tmp_path / "chk1")) == ["chk1"]
    assert names(snapshots.plotfile_series(spark, ["/r/b.old.1", "/r/a"])) == ["a", "b.old.1"]
    assert [text.pick(found, k).head()["name"] for k in (0, 1, -1, -2)] == ["plt9", "plt10", "plt10", "plt9"]
    for k in (2, -3):
        with pytest.raises(IndexError):
            text.pick(found, k)
    with pytest.raises(FileNotFoundError):
        snapshots.plotfile_series(spark, str(tmp_path / "none"))


def test_contents_of_a_snapshot(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, float("nan"), "b"), (3, None, "c")], "i int, p double, name string")
    got = {r["field"]: (r["n"], r["low"], r["high"]) for r in snapshots.contents(df).collect()}
    assert got == {"i": (3, 1.0, 3.0), "p": (2, 2.0, 2.0)}


def test_flat_positions_and_centres(spark):
    got = [(r["i"], r["j"], r["k"]) for r in grid.indexed(spark.range(12).withColumnRenamed("id", "pos"), 3, 2).orderBy("pos").collect()]
    assert got == [(p % 3, p // 3 % 2, p // 6) for p in range(12)]
    nodes = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 4.0)], "i int, x double")
    assert [r["x"] for r in grid.centres(nodes, "x", "i").orderBy("i").collect()] == [0.5, 2.5]


def test_curves_and_the_second_solver(spark, tmp_path):
    (tmp_path / "curve.csv").write_text("0.5, 1.5\n1.0, 2.5\n")
    curve = text.curve(spark, str(tmp_path / "curve.csv"))
    assert [tuple(r) for r in curve.orderBy("tau").collect()] == [(0.5, 1.5), (1.0, 2.5)]
    (tmp_path / "second.dat").write_text("# t a b p T\n0.1 0 0 7600 125\n0.2 0 0 15200 250\n")
    second = text.second_probes(spark, str(tmp_path / "second.dat"))
    assert [(r["t"], r["p_ratio"], r["T_ratio"]) for r in second.orderBy("seq").collect()] == [(0.1, 1.0, 1.0), (0.2, 2.0, 2.0)]
    own = probe.derived(spark.createDataFrame([("a", 1, 0, 0.1, 1.0, 0.0, 760.0)], "case_id string, probe_id int, seq long, t double, rho double, u double, p double"))
    got = views.probe_view([("ours", own)], second=[("theirs", second)], curves=[("curve", curve)]).collect()
    assert [(r["label"], r["kind"], r["ratio"]) for r in got] == [("ours", "probe", 1.0), ("theirs", "second solver", 1.0), ("theirs", "second solver", 2.0), ("curve", "reference", 1.5), ("curve", "reference", 2.5)]
    assert got[0]["tau"] == pytest.approx(got[1]["tau"]) == pytest.approx(1726.0)
    with pytest.raises(ValueError):
        views.probe_view([])


def test_frames_and_triangles_that_are_missing(spark, tmp_path):
    with pytest.raises(ValueError):
        text.frames(spark, str(tmp_path))
    for name in ("b.png", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert [bytes(r["content"]) for r in text.frames(spark, str(tmp_path)).collect()] == [b"a.png", b"b.png"]
    (tmp_path / "none.stl").write_text("solid t\nfacet normal 0 0 1\nvertex 0 0 0\nendfacet\nendsolid\n")
    with pytest.raises(ValueError):
        text.triangles(spark, str(tmp_path / "none.stl"))
    with pytest.raises((ImportError, ValueError)):  # no encoder, or none of these is an image
        sinks.save_video(text.frames(spark, str(tmp_path)), str(tmp_path / "v.mp4"))


def test_paths_and_ranges(spark):
    assert text.resolved("a/b", "/base") == "/base/a/b" and text.resolved("/a", "/base") == "/a" and text.resolved("s3://x/y", "/base") == "s3://x/y"
    assert [c["source"] for c in text.case_list(["a", {"path": "/b"}], base_dir="/base")] == ["/base/a", "/b"]
    present = spark.createDataFrame([(0,), (20,)], "snapshot long")
    assert [r["snapshot"] for r in text.snapshot_range(spark, 0, 30, 10, present).orderBy("snapshot").collect()] == [0, 20]
    assert text.snapshot_range(spark, 0, 30, 10).count() == 3


def test_saved_views_and_run_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None), (4, -1.0)], "i int, p double")
    seen, metrics = sinks.observed(df, "p")
    assert spark.read.parquet(sinks.save_view(seen, str(tmp_path / "view"))).count() == 4
    assert (metrics.get["n"], metrics.get["finite"], metrics.get["low"], metrics.get["high"]) == (4, 2, -1.0, 2.0)


def test_labels_palettes_and_thinning(spark):
    df = spark.createDataFrame([("a", 0.5), (None, 0.5), (None, None)], "name string, time double")
    assert [r[0] for r in df.select(views.label("name")).collect()] == ["a", "case", "case"]
    assert one_label(df.filter("name = 'a'").select(views.label("name", "time"))) == "a, t = 5.000e-01 s"
    assert views.palette("reds_r") == views.palette("reds")[::-1]
    with pytest.raises(ValueError):
        views.palette("greens")
    assert [r["ord"] for r in views.thinned(spark.range(7).withColumnRenamed("id", "ord"), 3).collect()] == [0, 3, 6]


def one_label(df):
    return df.head()[0]


def test_views_of_surfaces(spark):
    table = spark.createDataFrame([(s, "upper", k, 0.1 * k, float(s + k), 1.0, 2.0) for s in (0, 1) for k in range(3)] + [(1, "lower", 0, 0.0, float("nan"), 1.0, 2.0)], "snapshot long, side string, idx int, s double, C_p double, C_f double, H double")
    got = {(r["snapshot"], r["side"], r["quantity"]): (r["low"], r["high"], r["mean"], r["n"]) for r in views.group_summary(table, ["C_p", "H"]).collect()}
    assert got[1, "upper", "C_p"] == (1.0, 3.0, 2.0, 3) and got[1, "lower", "H"] == (2.0, 2.0, 2.0, 1) and (1, "lower", "C_p") not in got
    assert views.group_view(table, ["C_p", "H"]).count() == 14
    one = table.filter("snapshot = 0").withColumn("x", F.col("s"))
    theory = one.select("side", "idx", "x", F.lit(0.5).alias("Cp_newton"))
    assert views.theory_view(one, theory).count() == 3
    both = table.filter("side = 'upper'").withColumns({"x": F.col("s"), "case_id": F.lit("a")})
    of_both = both.select("case_id", "snapshot", "side", "idx", "x", F.col("snapshot").cast("double").alias("Cp_newton"))
    joined = views.theory_view(both, of_both)
    assert joined.count() == 6 and joined.filter("Cp_newton <> snapshot").count() == 0 and views.theory_view(both, theory).count() == 6
    cells = spark.createDataFrame([(i, j, float(i), float(j), float(i * j)) for i in range(3) for j in range(3)], "i int, j int, x double, y double, p double")
    points, shown, limits = views.geometry_view(spark.createDataFrame([("upper", 0, 0.0, 1.0, 0.9)], "side string, idx int, x double, y double, y_interp double"), cells, "p", 0.0, 1.0)
    assert points.head()["y"] == 0.9 and shown.count() == 9 and tuple(limits.head()) == (0.0, 4.0)


def test_masks_of_bodies(spark):
    df = spark.createDataFrame([(0.0,), (-0.2,), (1.0,)], "ib_markers double")
    assert [r[0] for r in df.select(F.coalesce(F.nanvl(fields.geometry_mask(), F.lit(0.0)), F.lit(-1.0))).collect()] == [0.0, 1.0, 1.0]


@pytest.fixture(scope="module")
def two_cases(spark):
    """Cells of two cases whose fields and bodies differ."""
    rows = [Row(case_id=c, snapshot=0, i=i, j=j, x=float(i), y=float(j), f=sign * (1.0 + i + 10.0 * j)) for c, sign in (("a", 1.0), ("b", -1.0)) for i in range(5) for j in range(6)]
    return spark.createDataFrame(rows).cache()


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [("a", float(x), 2.0 + 0.5 * x, 1.0, 0.5, 0.0) for x in range(4)] + [("b", float(x), 3.0, 2.0 - 0.25 * x, 0.0, -0.25) for x in range(5)]
    return spark.createDataFrame(rows, "case_id string, x double, y_upper double, y_lower double, dyu_dx double, dyl_dx double")


def test_bilinear_keeps_cases_apart(spark, two_cases):
    pts = spark.createDataFrame([(c, 0, 7, 1.5, 2.25) for c in "ab"], "case_id string, snapshot long, point_id int, px double, py double")
    got = {r["case_id"]: r["g"] for r in interp.bilinear(pts, two_cases, "f", "g", 0.0, 1.0, 5, 0.0, 1.0, 6).collect()}
    assert got == pytest.approx({"a": 25.0, "b": -25.0})


def test_body_masks_and_surfaces_keep_cases_apart(two_cases, bodies):
    both = fields.body_mask(two_cases, bodies)
    assert both.count() == 60
    for case in "ab":
        own = fields.body_mask(two_cases.filter(F.col("case_id") == case), bodies.filter(F.col("case_id") == case).drop("case_id"))
        mine = lambda df: sorted((r["i"], r["j"]) for r in df.filter("in_body").collect())
        assert mine(both.filter(F.col("case_id") == case)) == mine(own) != []
    assert mine(both.filter("case_id = 'a'"))[0] == (0, 1)
    found = surface.profile_surface(two_cases, bodies, max_x=9.0)
    for case in "ab":
        own = surface.profile_surface(two_cases.filter(F.col("case_id") == case), bodies.filter(F.col("case_id") == case).drop("case_id"), max_x=9.0)
        listed = lambda df: sorted((r["side"], r["idx"], r["i"], r["j"], r["y_exact"], r["nx"], r["ny"]) for r in df.collect())
        assert listed(found.filter(F.col("case_id") == case)) == listed(own) != []
    slope = found.filter("case_id = 'a' and side = 'upper' and i = 2").head()
    assert (slope["j"], slope["y_exact"], slope["ny"]) == pytest.approx((3, 3.0, 1 / np.sqrt(1.25)))


def test_bodies_need_two_stations(spark):
    points = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "h double, v double")
    with pytest.raises(Exception, match="two stations"):
        surface.envelope(points).collect()
    assert surface.envelope(points.limit(0)).count() == 0
    v = lambda *p: [dict(zip("xyz", map(float, q), strict=True)) for q in p]
    tri = spark.createDataFrame([(0, v((0, 0, -1), (2, 0, 1), (0, 2, 1))), (1, v((0, 0, -1), (0, 2, 1), (-2, 0, 1)))], "tri_id int, v array<struct<x:double,y:double,z:double>>")
    got = surface.plane_profile(tri, "xy", 0.0).orderBy("x").collect()
    assert [(r["x"], r["y_upper"], r["y_lower"]) for r in got] == [(-1.0, 0.0, 0.0), (0.0, 1.0, 1.0), (1.0, 0.0, 0.0)]
    assert [r["x"] for r in surface.body_profile(tri).orderBy("x").collect()] == [-2.0, 0.0, 2.0]
