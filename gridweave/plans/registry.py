"""The registered queries of the library and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gas
from ..functions.numeric import fdiv, quantised, quantised_sql
from ..operators import boundary_layer as bl
from ..operators import fields as fo
from ..operators import grid as g
from ..operators import interp, numeric, probe, spline, stencil, surface, theory, tiles, views
from ..sources import text as src
from . import bindings as b
from . import controllers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def q(name: str, k: int, value=None):
    return quantised(name if value is None else value, k).alias(name)


def s(name: str, k: int, value: str | None = None) -> str:
    return f"{quantised_sql(value or name, k)} AS {name}"


STREAM = bl.FreeStream(u=1011.0, rho=0.0267)

# --- selection -------------------------------------------------------------------------------------


@query(f"""WITH {b.GRID}, near AS (SELECT i FROM (SELECT DISTINCT i, x FROM grid) ORDER BY abs(x - 20.3), i LIMIT 1)
SELECT row_number() OVER (ORDER BY y) - 1 AS ord, CAST(20.3 AS DOUBLE) AS x_requested, x AS x_sampled, y, {s('distance', 9, 'abs(y - 0.02)')}, {s('value', 6, 'p')}
FROM grid JOIN near USING (i) WHERE y >= 0.02 AND y <= 0.08""")
def grid_profile_nearest(spark, d):
    out = g.wall_normal_profile(b.grid(spark, d), "p", 20.3, surface_y=0.02, y_max=0.08)
    return out.select(F.col("ord").cast("long").alias("ord"), "x_requested", "x_sampled", "y", q("distance", 9), q("value", 6))


@query(f"""WITH {b.GRID}, near AS (SELECT i FROM (SELECT DISTINCT i, x FROM grid) ORDER BY abs(x - 20.5), i LIMIT 1)
SELECT row_number() OVER (ORDER BY y DESC) - 1 AS ord, x AS x_sampled, y, {s('distance', 9, 'abs(y - 0.05)')}, {s('value', 6, 'rho')} FROM grid JOIN near USING (i) WHERE y <= 0.05 AND y >= 0.01""")
def grid_profile_negative(spark, d):
    out = g.wall_normal_profile(b.grid(spark, d), "rho", 20.5, surface_y=0.05, y_max=0.01, side="negative")
    return out.select(F.col("ord").cast("long").alias("ord"), "x_sampled", "y", q("distance", 9), q("value", 6))


@query(f"""WITH {b.GRID}, near AS (SELECT i FROM (SELECT DISTINCT i, x FROM grid) ORDER BY abs(x - 33.4), i LIMIT 1)
SELECT y, {s('value', 6, 'u')} FROM grid JOIN near USING (i) WHERE y BETWEEN 0.03 AND 0.07""")
def grid_line_band(spark, d):
    return g.line_band(b.grid(spark, d), "u", 33.4, 0.03, 0.07).select("y", q("value", 6))


@query(f"WITH {b.GRID} SELECT i, j, {s('x', 9, 'x / 100')}, {s('y', 9, 'y / 100')}, {s('density', 6, 'rho * 1000')}, {s('pressure', 6, 'p * CAST(0.1 AS DOUBLE)')}, {s('x_velocity', 9, 'u * CAST(0.01 AS DOUBLE)')} FROM grid")
def grid_units(spark, d):
    raw = b.grid(spark, d).select("i", "j", "x", "y", F.col("rho").alias("density"), F.col("p").alias("pressure"), F.col("u").alias("x_velocity"))
    out = g.with_units(raw, ["density", "pressure", "x_velocity"])
    return out.select("i", "j", q("x", 9), q("y", 9), q("density", 6), q("pressure", 6), q("x_velocity", 9))


@query(f"WITH {b.GRID} SELECT i, j, {s('speed', 6, 'sqrt(u*u + v*v)')}, {s('mach', 9, 'sqrt(u*u + v*v) / c')}, {s('temperature', 6, 'p / (rho * CAST(287.05 AS DOUBLE))')}, {s('speed3', 6, 'sqrt(u*u + v*v + w*w)')} FROM grid")
def grid_speed_mach_temperature(spark, d):
    cells = b.grid(spark, d).withColumn("speed", gas.speed("u", "v"))
    return cells.select("i", "j", q("speed", 6), q("mach", 9, gas.mach("speed", "c")), q("temperature", 6, gas.temperature("p", "rho")), q("speed3", 6, gas.speed("u", "v", "w")))


@query(f"WITH {b.GRID3} SELECT k, count(*) AS n, {s('v_sum', 4, 'sum(v)')}, {s('x_max', 6, 'max(x)')} FROM (SELECT k, x, w AS v FROM grid3 WHERE j = (SELECT (max(j) + 1) // 2 FROM grid3)) GROUP BY 1")
def grid_slice_plane(spark, d):
    out = g.plane_slice(b.grid3(spark, d), "xz").groupBy("k")
    return out.agg(F.count("*").alias("n"), q("v_sum", 4, F.sum("v")), q("x_max", 6, F.max("x")))


@query(f"WITH {b.GRID3}, near AS (SELECT k FROM (SELECT DISTINCT k, z FROM grid3) ORDER BY abs(z - 2.5), k LIMIT 1) SELECT i, j, {s('rho', 6)} FROM grid3 JOIN near USING (k)")
def grid_slice_coord(spark, d):
    return g.plane_slice(b.grid3(spark, d), "xy", coord=2.5).select("i", "j", q("rho", 6))


@query(f"WITH {b.GRID} SELECT i, j, v < 0.1 AS hidden FROM grid")
def grid_mask_below(spark, d):
    return b.grid(spark, d).select("i", "j", g.mask("v", 0.1, "below").alias("hidden"))


@query(f"WITH {b.GRID} SELECT i, j, v > 0.1 AS hidden, {s('color', 6, 'sqrt(u*u + v*v)')} FROM grid")
def grid_mask_above(spark, d):
    return g.streamline_field(b.grid(spark, d), color="speed", mask_key="v", threshold=0.1, mode="above").select("i", "j", F.col("mask").alias("hidden"), q("color", 6))


# --- stencils --------------------------------------------------------------------------------------

_WX, _WY = "OVER (PARTITION BY j ORDER BY i)", "OVER (PARTITION BY i ORDER BY j)"


def _gradient_sql(f: str, x: str, w: str) -> str:
    lo, hi = (lambda c: f"lag({c}) {w}"), (lambda c: f"lead({c}) {w}")
    hs, hd = f"({x} - {lo(x)})", f"({hi(x)} - {x})"
    inner = f"({hs}*{hs}*{hi(f)} + ({hd}*{hd} - {hs}*{hs})*{f} - {hd}*{hd}*{lo(f)}) / ({hs}*{hd}*({hs} + {hd}))"
    return f"CASE WHEN {lo(x)} IS NULL THEN ({hi(f)} - {f}) / ({hi(x)} - {x}) WHEN {hi(x)} IS NULL THEN ({f} - {lo(f)}) / ({x} - {lo(x)}) ELSE {inner} END"


@query(f"WITH {b.GRID} SELECT i, j, {s('df_dx', 6, f'CASE WHEN lag(p) {_WX} IS NULL THEN lead(p) {_WX} - p WHEN lead(p) {_WX} IS NULL THEN p - lag(p) {_WX} ELSE (lead(p) {_WX} - lag(p) {_WX}) / 2 END')} FROM grid")
def grid_gradient_uniform(spark, d):
    cells = b.grid(spark, d)
    return cells.select("i", "j", q("df_dx", 6, stencil.gradient_uniform("p", g.line(cells, "i"), 1.0)))


@query(f"WITH {b.GRID}, warped AS (SELECT i, j, p, x * x AS x2 FROM grid), gr AS (SELECT i, j, {_gradient_sql('p', 'x2', _WX)} AS gx FROM warped) SELECT i, j, {s('df_dx', 6, 'gx')} FROM gr")
def grid_gradient_nonuniform(spark, d):
    cells = b.grid(spark, d).withColumn("x2", F.col("x") * F.col("x"))
    return cells.select("i", "j", q("df_dx", 6, stencil.gradient("p", "x2", g.line(cells, "i"))))


_CURL = f"curl AS (SELECT *, {_gradient_sql('v', 'x', _WX)} - {_gradient_sql('u', 'y', _WY)} AS vort FROM grid)"
_GRAD = f"gr AS (SELECT *, {_gradient_sql('rho', 'x', _WX)} AS gx, {_gradient_sql('rho', 'y', _WY)} AS gy FROM grid), gm AS (SELECT *, sqrt(gx*gx + gy*gy) AS grad_rho FROM gr)"


@query(f"WITH {b.GRID}, {_CURL} SELECT i, j, {s('vorticity', 3, 'vort')}, {s('vorticity_mag', 3, 'abs(vort)')} FROM curl")
def grid_vorticity(spark, d):
    return fo.vorticity(b.grid(spark, d)).select("i", "j", q("vorticity", 3), q("vorticity_mag", 3))


@query(f"WITH {b.GRID}, {_GRAD} SELECT i, j, {s('schlieren', 9, 'exp(CAST(-50 AS DOUBLE) * grad_rho / (SELECT max(grad_rho) FROM gm))')} FROM gm")
def grid_schlieren(spark, d):
    return fo.schlieren(b.grid(spark, d)).select("i", "j", q("schlieren", 9))


@query(f"""WITH {b.GRID}, {_CURL}, {_GRAD}, r AS (SELECT p AS p0, u AS u0, rho AS r0, sqrt(u*u + v*v) / c AS m0 FROM grid WHERE i = 0 AND j = 0)
SELECT a.i, a.j, {s('p_norm', 9, 'a.p / p0')}, {s('u_norm', 9, 'a.u / u0')}, {s('rho_norm', 9, 'a.rho / r0')}, {s('p_dyn', 6, 'a.p / (CAST(0.5 AS DOUBLE) * 1.4 * p0 * m0 * m0)')},
 {s('vorticity_norm', 6, 'a.vort / (u0 / CAST(0.2 AS DOUBLE))')}, {s('grad_rho_norm', 6, 'grad_rho / (r0 / CAST(0.2 AS DOUBLE))')} FROM curl a JOIN gm USING (i, j), r""")
def grid_freestream_norm(spark, d):
    cells = b.grid(spark, d).withColumn("Mach", gas.mach(gas.speed("u", "v"), "c"))
    return fo.normalised(cells).select("i", "j", q("p_norm", 9), q("u_norm", 9), q("rho_norm", 9), q("p_dyn", 6), q("vorticity_norm", 6), q("grad_rho_norm", 6))


@query(f"WITH {b.GRID} SELECT j, {s('integral', 3, 't')} FROM (SELECT j, sum(st) AS t FROM (SELECT j, (lag(u) {_WX} + u) / 2 * (x - lag(x) {_WX}) AS st FROM grid) GROUP BY j)")
def trapezoid_integral(spark, d):
    return stencil.trapezoid(b.grid(spark, d), "u", "x", ["j"], "i", "integral").select("j", q("integral", 3))


@query(f"WITH {b.GRID} SELECT i, j, {s('running', 3, 'r')} FROM (SELECT i, j, sum(st) OVER (PARTITION BY j ORDER BY i) AS r FROM (SELECT i, j, coalesce((lag(u) {_WX} + u) / 2 * (x - lag(x) {_WX}), 0) AS st FROM grid))")
def running_trapezoid(spark, d):
    return stencil.with_running_trapezoid(b.grid(spark, d), "u", "x", ["j"], "i", "running").select("i", "j", q("running", 3))


@query(f"""WITH {b.STATIONS}, st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS ds FROM stations WINDOW w AS (PARTITION BY side ORDER BY idx))
SELECT side, idx, {s('s', 6, 'sum(ds) OVER (PARTITION BY side ORDER BY idx)')} FROM st""")
def arc_length(spark, d):
    return stencil.with_arc_length(b.stations(spark, d), "x", "y", ["side"], "idx").select("side", "idx", q("s", 6))


@query(f"WITH {b.GRID} SELECT i, {s('slope', 2, 'regr_slope(u, y)')} FROM grid WHERE j < 4 GROUP BY i")
def wall_slope(spark, d):
    return stencil.head_slope(b.grid(spark, d), "u", "y", ["i"], "j", 4).select("i", q("slope", 2))


@query(f"""WITH {b.GRID}, f AS (SELECT i, y + CAST(0.01 AS DOUBLE) AS s, u - 100 AS v FROM grid WHERE j < 6),
m AS (SELECT i, sum(s*s) AS s2, sum(s*s*s) AS s3, sum(s*s*s*s) AS s4, sum(s*v) AS t1, sum(s*s*v) AS t2 FROM f GROUP BY i)
SELECT i, {s('a', 2, '(t1*s4 - t2*s3) / (s2*s4 - s3*s3)')}, {s('b', 1, '(s2*t2 - s3*t1) / (s2*s4 - s3*s3)')}, CAST(6 AS BIGINT) AS n FROM m""")
def constrained_fit(spark, d):
    cells = b.grid(spark, d).filter("j < 6").select("i", (F.col("y") + 0.01).alias("s"), (F.col("u") - 100.0).alias("v"))
    return stencil.origin_fit(cells, "v", "s", ["i"]).select("i", q("a", 2), q("b", 1), "n")


@query(f"WITH {b.GRID} SELECT j, min(CASE WHEN p > 125500 THEN i END) AS first_i FROM grid GROUP BY j")
def first_crossing(spark, d):
    return b.grid(spark, d).groupBy("j").agg(bl.edge_place(F.col("p") > 125500, "i").alias("first_i"))


@query(f"WITH {b.GRID}, gr AS (SELECT i, j, {_gradient_sql('p', 'x', _WX)} AS gx FROM grid), qg AS (SELECT i, j, {s('gq', 6, 'abs(gx)')} FROM gr) SELECT j, arg_min(i, (-gq, i)) AS at_i FROM qg GROUP BY j")
def argmax_gradient(spark, d):
    cells = b.grid(spark, d)
    got = cells.withColumn("gq", quantised(F.abs(stencil.gradient("p", "x", g.line(cells, "i"))), 6))
    return got.groupBy("j").agg(F.min_by("i", F.struct(-F.col("gq"), F.col("i"))).alias("at_i"))


@query(f"""WITH {b.PROBE}, h AS (SELECT *, CASE WHEN seq % 3 = 1 THEN value END AS g FROM probe),
e AS (SELECT *, last_value(g IGNORE NULLS) OVER w1 AS a, last_value(CASE WHEN g IS NOT NULL THEN seq END IGNORE NULLS) OVER w1 AS sa,
 first_value(g IGNORE NULLS) OVER w2 AS z, first_value(CASE WHEN g IS NOT NULL THEN seq END IGNORE NULLS) OVER w2 AS sz FROM h
 WINDOW w1 AS (PARTITION BY probe_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY probe_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT probe_id, seq, {s('filled', 6, 'CASE WHEN g IS NOT NULL THEN g WHEN a IS NULL THEN z WHEN z IS NULL THEN a ELSE a + (z - a) * (seq - sa) / (sz - sa) END')} FROM e""")
def gap_fill(spark, d):
    holes = b.probe(spark, d).withColumn("g", F.when(F.col("seq") % 3 == 1, F.col("value")))
    return stencil.fill_gaps(holes, "g", ["probe_id"], "seq", "filled").select("probe_id", "seq", q("filled", 6))


@query("SELECT CAST(r AS INT) AS ord, CASE WHEN r = 40 THEN CAST(2 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) + r * (CAST(3 AS DOUBLE) / 40) END AS value FROM range(41) t(r)")
def linspace(spark, d):
    return stencil.linspace(spark, -1.0, 2.0, 41)


@query("""WITH u AS (SELECT DISTINCT source AS path FROM documents)
SELECT path, row_number() OVER (ORDER BY CAST(regexp_extract(path, '(\\d+)$', 1) AS INT)) AS ord FROM u""")
def natural_order(spark, d):
    paths = b.table(spark, d, "documents").select(F.col("source").alias("path")).distinct()
    ordered = paths.withColumn("key", stencil.natural_key("path"))
    return ordered.select("path", F.row_number().over(Window.orderBy("key")).cast("long").alias("ord"))


@query("SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 5 THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 5, '0') END AS stem FROM orders")
def snapshot_pad(spark, d):
    return b.table(spark, d, "orders").select("o_orderkey", views.padded("o_orderkey").alias("stem"))


@query("""WITH RECURSIVE xs AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS x FROM part), o AS (SELECT x, row_number() OVER (ORDER BY x) AS r FROM xs),
f AS (SELECT r, x, x AS anchor, 0 AS bin FROM o WHERE r = 1 UNION ALL
 SELECT o.r, o.x, CASE WHEN o.x - f.anchor >= 3.5 THEN o.x ELSE f.anchor END, CASE WHEN o.x - f.anchor >= 3.5 THEN f.bin + 1 ELSE f.bin END FROM f JOIN o ON o.r = f.r + 1)
SELECT bin, anchor AS x, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price FROM f JOIN part ON CAST(p_size AS DOUBLE) = x GROUP BY 1, 2""")
def anchor_bins(spark, d):
    part = b.table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("price"))
    return stencil.anchored_bins(part, "x", [], 3.5, ("price",))


# --- fields and statistics ---------------------------------------------------------------------------


@query(f"WITH {b.GRID} SELECT i, j, (isfinite(v) AND v BETWEEN -1 AND 1 AND ib_markers < 0.1 AND abs(v) >= 0.05) AS shown, {s('base', 6, 'CASE WHEN ib_markers < 0.1 THEN p END')} FROM grid")
def overlay_visibility(spark, d):
    cells = b.grid(spark, d)
    return cells.select("i", "j", fo.visible("v", 1.0, -1.0, ib="ib_markers", deadband=0.05, signed=True).alias("shown"), q("base", 6, fo.solid_masked("p")))


@query(f"""WITH {b.GRID}, seen AS (SELECT *, ib_markers < 0.1 AS fluid FROM grid), lim AS (SELECT min(v) FILTER (fluid) AS lo, max(v) FILTER (fluid) AS hi, quantile_cont(p, 0.01) FILTER (fluid) AS b0, quantile_cont(p, 0.99) FILTER (fluid) AS b1 FROM seen)
SELECT i, j, {s('base', 6, 'CASE WHEN fluid THEN p END')}, {s('value', 6, 'v')}, fluid AND abs(v) >= 0.02 AS shown, {s('base_low', 4, 'b0')}, {s('base_high', 4, 'b1')}, {s('low', 6, 'lo')}, {s('high', 6, 'hi')}, lo < 0 AS signed, 'turbo' AS colours FROM seen CROSS JOIN lim""")
def overlay(spark, d):
    out = fo.overlay(b.grid(spark, d), base="p", field="v", deadband=0.02)
    return out.select("i", "j", q("base", 6), q("value", 6), "shown", q("base_low", 4), q("base_high", 4), q("low", 6), q("high", 6), "signed", "colours")


@query(f"""WITH {b.GRID}, lim AS (SELECT max(v) FILTER (ib_markers < 0.1) AS hi FROM grid)
SELECT i, j, v BETWEEN least(CAST(0.01 AS DOUBLE), hi) AND greatest(CAST(0.01 AS DOUBLE), hi) AND ib_markers < 0.1 AND v >= 0.03 AS shown, {s('low', 6, 'least(CAST(0.01 AS DOUBLE), hi)')}, false AS signed, 'turbo' AS colours FROM grid CROSS JOIN lim""")
def overlay_given_range(spark, d):
    return fo.overlay(b.grid(spark, d), base="p", field="v", low=0.01, signed=False, deadband=0.03).select("i", "j", "shown", q("low", 6), "signed", "colours")


@query(f"WITH {b.GRID} SELECT CAST(count_if(v BETWEEN -1 AND 1) AS BIGINT) AS shown, count(*) AS cells, {s('share', 9, 'count_if(v BETWEEN -1 AND 1) / CAST(count(*) AS DOUBLE)')} FROM grid")
def shown_share(spark, d):
    return fo.shown_fraction(b.grid(spark, d), fo.visible("v", -1.0, 1.0)).select("shown", "cells", q("share", 9))


@query(f"WITH {b.GRID} SELECT {s('low', 6, 'quantile_cont(v, 0.01)')}, {s('high', 6, 'quantile_cont(v, 0.99)')} FROM grid")
def colour_limits_percentile(spark, d):
    return fo.colour_limits(b.grid(spark, d), "v").select(q("low", 6), q("high", 6))


@query(f"WITH {b.GRID}, l AS (SELECT 'u' AS field, u AS v FROM grid UNION ALL SELECT 'p', p FROM grid UNION ALL SELECT 'rho', rho FROM grid) SELECT field, {s('low', 6, 'min(v)')}, {s('high', 6, 'max(v)')}, {s('mean', 5, 'avg(v)')}, count(*) AS n FROM l GROUP BY 1")
def field_stats(spark, d):
    return fo.field_stats(b.grid(spark, d), ["u", "p", "rho"]).select("field", q("low", 6), q("high", 6), q("mean", 5), "n")


@query(f"WITH {b.GRID} SELECT CAST(0.2 AS DOUBLE) AS x_low, CAST(0.6 AS DOUBLE) AS x_high, {s('y_low', 9, 'greatest(min(y), (min(y) + max(y)) / 2 - 0.04)')}, {s('y_high', 9, 'least(max(y), (min(y) + max(y)) / 2 + 0.04)')} FROM grid")
def zoom_window(spark, d):
    return fo.zoom_window(b.grid(spark, d), "Sec2", aspect=0.2).select("x_low", "x_high", q("y_low", 9), q("y_high", 9))


# --- surfaces --------------------------------------------------------------------------------------


@query(f"WITH {b.GRID} SELECT i, min(j) AS low, max(j) AS high FROM grid WHERE x <= 40 AND vel_mag < 10 AND ib_markers > 0.1 GROUP BY i")
def wall_columns(spark, d):
    return surface.wall_columns(b.grid(spark, d), max_x=40.0).select("i", "low", "high")


_UPPER = f"""{b.GRID}, ends AS (SELECT i, min(j) AS low, max(j) AS high FROM grid WHERE x <= 40 AND vel_mag < 10 AND ib_markers > 0.1 GROUP BY i),
sides AS (SELECT i, 'upper' AS side, high AS body, high + 1 AS j FROM ends UNION ALL SELECT i, 'lower', low, low - 1 FROM ends),
pts AS (SELECT s.side, s.i, s.j, f.x, f.y, o.y AS yb, f.ib_markers AS f2, o.ib_markers AS f1 FROM sides s JOIN grid f ON f.i = s.i AND f.j = s.j JOIN grid o ON o.i = s.i AND o.j = s.body),
surf AS (SELECT side, row_number() OVER (PARTITION BY side ORDER BY i) - 1 AS idx, i, j, x, y,
 CASE WHEN abs(f2 - f1) > 1e-6 THEN yb + least(greatest((0.5 - f1) / (f2 - f1), 0), 1) * (y - yb) ELSE 0.5 * (yb + y) END AS y_interp FROM pts)"""


@query(f"WITH {_UPPER} SELECT side, idx, i, j, x, y, {s('y_interp', 9)} FROM surf")
def wall_subcell(spark, d):
    return surface.marker_surface(b.grid(spark, d), max_x=40.0).select("side", F.col("idx").cast("long").alias("idx"), "i", "j", "x", "y", q("y_interp", 9))


@query(f"WITH {_UPPER} SELECT side, idx, {s('p', 6, 'grid.p')}, {s('Temperature', 6, 'grid.Temperature')} FROM surf JOIN grid USING (i, j)")
def surface_gather(spark, d):
    cells = b.grid(spark, d)
    return surface.gathered(surface.marker_surface(cells, max_x=40.0), cells, ["p", "Temperature"]).select("side", F.col("idx").cast("long").alias("idx"), q("p", 6), q("Temperature", 6))


@query(f"WITH {_UPPER} SELECT side, idx, {s('C_p', 6, '(grid.p - 0.0267 * CAST(287.05 AS DOUBLE) * 125) / (CAST(0.5 AS DOUBLE) * 0.0267 * 1022121)')} FROM surf JOIN grid USING (i, j)")
def pressure_coefficient(spark, d):
    cells = b.grid(spark, d)
    pts = surface.gathered(surface.marker_surface(cells, max_x=40.0), cells, ["p"])
    return pts.select("side", F.col("idx").cast("long").alias("idx"), q("C_p", 6, gas.pressure_coefficient("p", 0.0267, 1011.0, 125.0)))


@query(f"""WITH {b.KNOTS}, qs AS (SELECT s_suppkey, (s_suppkey % 640) / CAST(10 AS DOUBLE) - 5 AS x FROM supplier),
k AS (SELECT x AS xk, y AS yk, lead(x) OVER (ORDER BY x) AS xn, lead(y) OVER (ORDER BY x) AS yn FROM knots), e AS (SELECT min(x) AS x0, arg_min(y, x) AS y0, max(x) AS x1, arg_max(y, x) AS y1 FROM knots)
SELECT s_suppkey, {s('value', 6, 'CASE WHEN q.x <= x0 THEN y0 WHEN q.x >= x1 THEN y1 ELSE yk + (yn - yk) * ((q.x - xk) / (xn - xk)) END')} FROM qs q CROSS JOIN e LEFT JOIN k ON q.x >= xk AND q.x < xn""")
def interp_linear(spark, d):
    qs = b.table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 640) / F.lit(10.0) - 5.0).alias("x"))
    return interp.interpolate(qs, b.knots(spark, d), "x", "y", "value").select("s_suppkey", q("value", 6))


@query(f"""WITH {b.GRID}, pts AS (SELECT c_custkey AS point_id, CAST(1.3 AS DOUBLE) + (c_custkey % 480) / CAST(10 AS DOUBLE) AS px, (c_custkey % 97) / CAST(1000 AS DOUBLE) AS py FROM customer),
l AS (SELECT *, CAST(least(greatest(floor(px - 1), 0), 48) AS INT) AS i0, CAST(least(greatest(floor((py - 0) / CAST(0.01 AS DOUBLE)), 0), 9) AS INT) AS j0 FROM pts),
m AS (SELECT *, px - (1 + i0) AS a, (py - (0 + j0 * CAST(0.01 AS DOUBLE))) / CAST(0.01 AS DOUBLE) AS bw FROM l)
SELECT point_id, {s('value', 4, '(1-a)*(1-bw)*g00.p + (1-a)*bw*g01.p + a*(1-bw)*g10.p + a*bw*g11.p')} FROM m JOIN grid g00 ON g00.i = i0 AND g00.j = j0 JOIN grid g01 ON g01.i = i0 AND g01.j = j0 + 1
 JOIN grid g10 ON g10.i = i0 + 1 AND g10.j = j0 JOIN grid g11 ON g11.i = i0 + 1 AND g11.j = j0 + 1""")
def bilinear(spark, d):
    pts = b.table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), (1.3 + (F.col("c_custkey") % 480) / F.lit(10.0)).alias("px"), ((F.col("c_custkey") % 97) / F.lit(1000.0)).alias("py"))
    return interp.bilinear(pts, b.grid(spark, d), "p", "value", 1.0, 1.0, 50, 0.0, 0.01, 11).select("point_id", q("value", 4))


_WALLS = "walls AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'upper' ELSE 'lower' END AS side, CAST(s_suppkey % 25 - 1 AS DOUBLE) / 200 AS wall_y FROM supplier)"


def _walls(spark, d):
    key = F.col("s_suppkey")
    return b.table(spark, d, "supplier").select(key.alias("id"), F.when(key % 2 == 0, "upper").otherwise("lower").alias("side"), ((key % 25 - 1).cast("double") / 200.0).alias("wall_y"))


@query(f"""WITH {b.GRID}, {_WALLS}, ax AS (SELECT DISTINCT j, y FROM grid) SELECT id, side, CASE WHEN side = 'upper' THEN coalesce((SELECT min(j) FROM ax WHERE y >= wall_y), 10) ELSE coalesce((SELECT max(j) FROM ax WHERE y <= wall_y), 0) END AS j_fluid FROM walls""")
def nearest_wall_cell(spark, d):
    return interp.wall_cells(_walls(spark, d), b.grid(spark, d).select("j", "y").distinct()).select("id", "side", "j_fluid")


@query(f"""WITH {b.GRID}, {_WALLS}, ax AS (SELECT DISTINCT j, y FROM grid), fl AS (SELECT *, CASE WHEN side = 'upper' THEN coalesce((SELECT min(j) FROM ax WHERE y >= wall_y), 10) ELSE coalesce((SELECT max(j) FROM ax WHERE y < wall_y), 0) END AS j_fluid FROM walls),
gh AS (SELECT *, CASE WHEN side = 'upper' THEN greatest(j_fluid - 1, 0) ELSE least(j_fluid + 1, 10) END AS j_ghost FROM fl)
SELECT id, j_fluid, j_ghost, f.y AS y_fluid, o.y AS y_ghost FROM gh JOIN ax f ON f.j = j_fluid JOIN ax o ON o.j = j_ghost""")
def searchsorted_neighbours(spark, d):
    return interp.wall_cells(_walls(spark, d), b.grid(spark, d).select("j", "y").distinct(), strict=True).select("id", "j_fluid", "j_ghost", "y_fluid", "y_ghost")


_EDGES = f"""{b.POINTS}, e AS (SELECT tri_id, CAST(k AS INT) AS edge, xs[k+1] AS xa, ys[k+1] AS ya, zs[k+1] AS za, xs[(k+1)%3+1] AS xb, ys[(k+1)%3+1] AS yb, zs[(k+1)%3+1] AS zb FROM tri, range(3) t(k)),
cut AS (SELECT tri_id, edge, xa + za / (za - zb) * (xb - xa) AS h, ya + za / (za - zb) * (yb - ya) AS v FROM e WHERE za * zb < 0)"""


@query(f"WITH {_EDGES} SELECT tri_id, edge, {s('h', 6)}, {s('v', 6)} FROM cut")
def triangle_plane(spark, d):
    return surface.plane_points(b.points3d(spark, d), "xy", 0.0).select("tri_id", "edge", q("h", 6), q("v", 6))


@query(f"WITH {b.POINTS} SELECT tri_id, {s('x0', 6, 'xs[1] * 2 + 1')}, {s('z2', 6, 'zs[3] * 2 - 1')} FROM tri")
def triangle_transform(spark, d):
    return surface.transform_triangles(b.points3d(spark, d), 2.0, (1.0, 0.0, -1.0)).select("tri_id", q("x0", 6, F.col("v")[0]["x"]), q("z2", 6, F.col("v")[2]["z"]))


_PROFILE = "prof AS (SELECT idx, x, max(CASE WHEN side = 'upper' THEN y END) AS y_upper, max(CASE WHEN side = 'lower' THEN y END) AS y_lower FROM stations GROUP BY 1, 2)"


@query(f"WITH {b.STATIONS}, {_PROFILE} SELECT g.i, g.j, coalesce(g.y >= y_lower AND g.y <= y_upper AND g.x BETWEEN (SELECT min(x) FROM prof) AND (SELECT max(x) FROM prof), false) AS in_body FROM grid g LEFT JOIN prof ON prof.x = g.x")
def body_mask(spark, d):
    prof = b.stations(spark, d).groupBy("idx", "x").agg(F.max(F.when(F.col("side") == "upper", F.col("y"))).alias("y_upper"), F.max(F.when(F.col("side") == "lower", F.col("y"))).alias("y_lower"))
    return fo.body_mask(b.grid(spark, d), prof).select("i", "j", "in_body")


@query(f"""WITH {b.GRID}, ends AS (SELECT x, min(y) AS y_lower, max(y) AS y_upper FROM grid WHERE ib_markers > 0.1 GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY x) - 1 AS ord FROM ends),
gr AS (SELECT *, {_gradient_sql('y_upper', 'x', 'OVER (ORDER BY x)')} AS du FROM o) SELECT ord, x, y_upper, y_lower, {s('dyu_dx', 6, 'du')} FROM gr""")
def body_envelope(spark, d):
    pts = b.grid(spark, d).filter("ib_markers > 0.1").select(F.col("x").alias("h"), F.col("y").alias("v"))
    return surface.envelope(pts).select(F.col("ord").cast("long").alias("ord"), "x", "y_upper", "y_lower", q("dyu_dx", 6))


@query(f"WITH {b.GRID} SELECT i, j, {s('u_t', 6, 'CASE WHEN rho - CAST(1.3 AS DOUBLE) < 0 THEN -(u * (rho - CAST(1.3 AS DOUBLE)) - v * c) ELSE u * (rho - CAST(1.3 AS DOUBLE)) - v * c END')} FROM grid")
def tangential_velocity(spark, d):
    return b.grid(spark, d).select("i", "j", q("u_t", 6, surface.tangential("u", "v", F.col("c"), F.col("rho") - 1.3)))


# --- boundary layers -------------------------------------------------------------------------------

_LAYER = f"{b.GRID}, lay AS (SELECT i, j, y, least(j / CAST(8 AS DOUBLE) + (u - 300) / 10000, 1) AS r FROM grid)"


@query(f"""WITH {_LAYER}, st AS (SELECT *, ((1 - lag(r) {_WY}) + (1 - r)) / 2 * (y - lag(y) {_WY}) AS dd, (lag(r * (1 - r)) {_WY} + r * (1 - r)) / 2 * (y - lag(y) {_WY}) AS dm FROM lay),
a AS (SELECT i, coalesce(arg_min(y, j) FILTER (r >= 0.99), arg_max(y, j)) AS d99, sum(dd) AS ds, sum(dm) AS th FROM st GROUP BY i) SELECT i, {s('delta_99', 9, 'd99')}, {s('delta_star', 9, 'ds')}, {s('theta', 9, 'th')}, {s('H', 6, 'ds / th')} FROM a""")
def bl_thickness(spark, d):
    lay = b.grid(spark, d).select("i", "j", "y", F.least(F.col("j") / F.lit(8.0) + (F.col("u") - 300.0) / 10000.0, F.lit(1.0)).alias("r"))
    return bl.thicknesses(lay, "y", "r", ["i"], "j").select("i", q("delta_99", 9), q("delta_star", 9), q("theta", 9), q("H", 6))


@query(f"""WITH {b.GRID}, pr AS (SELECT i, j, y, CAST(1000 AS DOUBLE) * least(j / CAST(7 AS DOUBLE), 1) AS u, Temperature AS T FROM grid), gr AS (SELECT *, {_gradient_sql('u', 'y', _WY)} AS g FROM pr),
a AS (SELECT i, coalesce(arg_min(u, j) FILTER (abs(g) < 0.01), arg_max(u, j)) AS u_edge, arg_min(T, j) AS tw, regr_slope(u, y) FILTER (j < 4) AS sl FROM gr GROUP BY i),
t AS (SELECT *, CAST(1.716e-5 AS DOUBLE) * pow(tw / CAST(273.15 AS DOUBLE), 1.5) * CAST(383.55 AS DOUBLE) / (tw + CAST(110.4 AS DOUBLE)) * sl AS tau FROM a)
SELECT i, {s('u_edge', 6)}, {s('T_wall', 6, 'tw')}, {s('tau_w', 7, 'tau')}, {s('C_f', 9, 'tau / (CAST(0.5 AS DOUBLE) * CAST(0.0267 AS DOUBLE) * 1022121)')} FROM t""")
def bl_line_analysis(spark, d):
    pr = b.grid(spark, d).select("i", "j", "y", (1000.0 * F.least(F.col("j") / F.lit(7.0), F.lit(1.0))).alias("u"), F.col("Temperature").alias("T"))
    return bl.line_analysis(pr, STREAM, ["i"], "j").select("i", q("u_edge", 6), q("T_wall", 6), q("tau_w", 7), q("C_f", 9))


@query(f"SELECT CAST(k AS INT) AS ord, {s('s', 12, 'tanh(CAST(1.5 AS DOUBLE) * k / 199) / tanh(CAST(1.5 AS DOUBLE)) * CAST(0.01 AS DOUBLE)')} FROM range(200) t(k)")
def stretched_points(spark, d):
    return spark.range(1).select(F.posexplode(bl.stretched(200, 0.01)).alias("ord", "s")).select("ord", q("s", 12))


@query(f"WITH {b.PROBE}, o AS (SELECT *, min(CASE WHEN p > 1200 THEN seq END) OVER (PARTITION BY probe_id) AS oob FROM probe) SELECT probe_id, seq, count(*) OVER (PARTITION BY probe_id) >= 10 AS trimmed_ok FROM o WHERE oob IS NULL OR oob = 1 OR seq < oob")
def in_bounds_prefix(spark, d):
    return bl.in_bounds_prefix(b.probe(spark, d), F.col("p") <= 1200, ["probe_id"], "seq").select("probe_id", "seq", "trimmed_ok")


@query(f"WITH {b.GRID} SELECT i, {s('C_f_direct', 9, 'CAST(1.716e-5 AS DOUBLE) * pow(Temperature / CAST(273.15 AS DOUBLE), 1.5) * CAST(383.55 AS DOUBLE) / (Temperature + CAST(110.4 AS DOUBLE)) * u / abs(y - CAST(0.005 AS DOUBLE)) / (CAST(0.5 AS DOUBLE) * CAST(0.0267 AS DOUBLE) * 1022121)')} FROM grid WHERE j = 1")
def first_cell_friction(spark, d):
    pts = b.grid(spark, d).filter("j = 1").select("i", F.col("u").alias("u_t"), F.col("Temperature").alias("T_wall"), "y", F.lit(0.005).alias("wall_y"))
    return bl.first_cell_friction(pts, STREAM).select("i", q("C_f_direct", 9))


# walls on centres, between them and off the grid; the first cell and the next one outward
@query(f"""WITH {b.GRID}, w AS (SELECT s_suppkey AS id, CAST(s_suppkey % 50 AS INT) AS i, CAST(s_suppkey % 25 - 1 AS DOUBLE) / 200 AS wall, CASE WHEN s_suppkey % 3 = 0 THEN CAST(-0.8 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS ny, CAST(0.6 AS DOUBLE) AS nx FROM supplier),
ax AS (SELECT DISTINCT j, y FROM grid), a AS (SELECT *, CASE WHEN ny >= 0 THEN coalesce((SELECT min(j) FROM ax WHERE y >= wall), 10) ELSE coalesce((SELECT max(j) FROM ax WHERE y < wall), 0) END AS j1 FROM w),
c AS (SELECT *, CASE WHEN ny >= 0 THEN least(j1 + 1, 10) ELSE greatest(j1 - 1, 0) END AS j2 FROM a),
m AS (SELECT c.*, abs(f.y - wall) AS dn, CASE WHEN ny >= 0 THEN f.u * ny - f.v * nx ELSE -f.u * ny + f.v * nx END AS ut, f.Temperature AS T, abs(g2.y - wall) AS dn2 FROM c JOIN grid f ON f.i = c.i AND f.j = j1 JOIN grid g2 ON g2.i = c.i AND g2.j = j2),
k AS (SELECT *, j1 <> j2 AND dn >= 1e-12 AS good FROM m)
SELECT id, CASE WHEN good THEN j1 ELSE -1 END AS j1, CASE WHEN good THEN j2 ELSE -1 END AS j2, {s('dn2', 9, 'CASE WHEN good THEN dn2 END')}, {s('u_tang1', 6, 'CASE WHEN good THEN ut END')}, {s('C_f', 9, 'CASE WHEN good THEN MU * (ut / dn) / (CAST(0.5 AS DOUBLE) * CAST(0.0267 AS DOUBLE) * 1022121) END')} FROM k""".replace("MU", "CAST(1.716e-5 AS DOUBLE) * pow(T / CAST(273.15 AS DOUBLE), 1.5) * CAST(383.55 AS DOUBLE) / (T + CAST(110.4 AS DOUBLE))"))
def first_cell_from_grid(spark, d):
    key = F.col("s_suppkey")
    pts = b.table(spark, d, "supplier").select(key.alias("id"), (key % 50).cast("int").alias("i"), ((key % 25 - 1).cast("double") / 200.0).alias("wall_y"), F.lit(0.6).alias("nx"), F.when(key % 3 == 0, -0.8).otherwise(0.8).alias("ny"))
    return bl.first_cell_from_grid(pts, b.grid(spark, d), STREAM).select("id", F.coalesce("j1", F.lit(-1)).alias("j1"), F.coalesce("j2", F.lit(-1)).alias("j2"), q("dn2", 9), q("u_tang1", 6), q("C_f", 9))


def _layer_grid(spark, d, nj=60):
    """A layer over a flat wall at y = 0, one column for each grid station."""
    x = b.grid(spark, d).select("case_id", "snapshot", "i", "x", F.col("u").alias("u0")).groupBy("case_id", "snapshot", "i", "x").agg(F.avg("u0").alias("u0"))
    j = x.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nj - 1))))
    y = (F.col("j") - 2.5) * 0.0005
    return j.withColumns({"y": y, "u": 1000.0 * F.tanh(y / 0.003), "v": F.lit(0.0), "Temperature": 300.0 + F.col("u0") / 100.0, "p": F.lit(2000.0), "rho": F.lit(0.02), "ib_markers": F.when(y < 0, 1.0).otherwise(0.0), "vel_mag": F.when(y < 0, 0.0).otherwise(100.0)})


@query()
def surface_table(spark, d):
    cells = _layer_grid(spark, d)
    pts = surface.marker_surface(cells, max_x=100.0).filter("side = 'upper'").withColumns({"nx": F.lit(0.0), "ny": F.lit(1.0), "y_exact": F.lit(0.0)})
    out = bl.surface_table(pts, cells, STREAM, mode="body", height=0.015, n=200)
    return out.select("side", "idx", q("s", 6), q("C_f", 9), q("delta_99", 7), q("delta_star", 7), q("theta", 7), q("H", 4), q("C_p", 6), "q_w", "status")


@query()
def surface_table_markers(spark, d):
    cells = _layer_grid(spark, d)
    pts = surface.marker_surface(cells, max_x=100.0).filter("side = 'upper'")
    return bl.surface_table(pts, cells, STREAM, mode="marker").select("side", "idx", q("s", 6), q("C_f", 9), q("delta_99", 7), q("H", 4), "status")


@query()
def bl_single_point(spark, d):
    cells = _layer_grid(spark, d)
    pts = surface.marker_surface(cells, max_x=100.0).filter("side = 'upper'").withColumns({"nx": F.lit(0.0), "ny": F.lit(1.0), "y_exact": F.lit(0.0)})
    return bl.surface_table(pts, cells, STREAM, mode="body", cubic=True, smooth=False, n=100).select("idx", q("C_f", 9), q("T_wall", 4), q("u_edge", 3), q("H", 4), "status")


def _body_grid(spark, d, nj=120):
    """A layer over a body that grows and curves with x, one column for each grid station; both sides are wetted."""
    x = b.grid(spark, d).select("case_id", "snapshot", "i", "x", F.col("u").alias("u0")).groupBy("case_id", "snapshot", "i", "x").agg(F.avg("u0").alias("u0"))
    cells = x.withColumns({"x": F.col("x") / 100.0, "j": F.explode(F.sequence(F.lit(0), F.lit(nj - 1)))})
    y, depth = (F.col("j") - nj / 2) * 0.0005 + 0.0002, F.abs(F.col("y")) - F.col("wall")
    cells = cells.withColumns({"y": y, "wall": 0.004 + 0.02 * F.col("x") * F.col("x")})
    return cells.withColumns({"u": 1000.0 * F.tanh(depth / 0.003), "v": F.lit(0.0), "Temperature": 300.0 + F.col("u0") / 100.0, "p": F.lit(2000.0), "rho": F.lit(0.02), "ib_markers": F.when(depth < 0, 1.0).otherwise(0.0), "vel_mag": F.when(depth < 0, 0.0).otherwise(100.0)})


def _wall_points(cells):
    """The fluid cells on both sides with the wall and its outward normal."""
    sign, slope = F.when(F.col("side") == "upper", 1.0).otherwise(-1.0), 0.04 * F.col("x")
    size = F.sqrt(1.0 + slope * slope)
    return surface.marker_surface(cells, max_x=100.0).withColumns({"nx": -slope / size, "ny": sign / size, "y_exact": sign * (0.004 + 0.02 * F.col("x") * F.col("x"))})


@query()
def surface_table_sides(spark, d):
    cells = _body_grid(spark, d)
    out = bl.surface_table(_wall_points(cells), cells, STREAM, mode="body", height=0.012, n=200, size=16)
    return out.select("side", "idx", q("s", 6), q("C_f", 9), q("delta_99", 7), q("delta_star", 7), q("theta", 7), q("H", 4), q("C_p", 6), "q_w", "status")


@query()
def surface_table_markers_sides(spark, d):
    cells = _body_grid(spark, d)
    return bl.surface_table(surface.marker_surface(cells, max_x=100.0), cells, STREAM, mode="marker", size=16).select("side", "idx", q("s", 6), q("C_f", 9), q("delta_99", 7), q("H", 4), "status")


@query()
def bl_single_point_sides(spark, d):
    cells = _body_grid(spark, d)
    out = bl.surface_table(_wall_points(cells), cells, STREAM, mode="body", cubic=True, smooth=False, height=0.012, n=100, size=16)
    return out.select("side", "idx", q("C_f", 9), q("T_wall", 4), q("u_edge", 3), q("H", 4), "status")


# samples along lines that leave each station outward and cross tiles of four cells
@query(f"""WITH {b.STATIONS}, pts AS (SELECT side, i, k, x + k * CAST(0.37 AS DOUBLE) AS px, y + (CASE WHEN side = 'upper' THEN 1 ELSE -1 END) * k * CAST(0.0123 AS DOUBLE) AS py FROM stations, range(9) t(k)),
l AS (SELECT *, CAST(least(greatest(floor(px - 1), 0), 48) AS INT) AS i0, CAST(least(greatest((SELECT count(DISTINCT y) FROM grid WHERE y <= py) - 1, 0), 9) AS INT) AS j0 FROM pts),
m AS (SELECT *, px - (1 + i0) AS a, (py - j0 / CAST(100 AS DOUBLE)) / CAST(0.01 AS DOUBLE) AS bw FROM l)
SELECT side, m.i, k AS code, {s('p', 3, '(1-a)*((1-bw)*g00.p + bw*g01.p) + a*((1-bw)*g10.p + bw*g11.p)')} FROM m JOIN grid g00 ON g00.i = i0 AND g00.j = j0 JOIN grid g01 ON g01.i = i0 AND g01.j = j0 + 1
 JOIN grid g10 ON g10.i = i0 + 1 AND g10.j = j0 JOIN grid g11 ON g11.i = i0 + 1 AND g11.j = j0 + 1""")
def tile_samples(spark, d):
    def plan(case, table, x, y, size):
        point, sign = np.asarray(table["point"]), np.where(np.asarray(table["side"]) == "upper", 1.0, -1.0)
        px, py = (np.asarray(table[c])[:, None] for c in "xy")
        k = np.arange(9)
        px, py = px + k * 0.37, py + sign[:, None] * k * 0.0123
        return tiles.by_tile(case, np.repeat(point, 9), np.tile(k.astype(np.int32), len(point)), px.ravel(), py.ravel(), x, y, size)

    cells = b.grid(spark, d)
    point = (F.col("i").cast("long") * 2 + (F.col("side") == "lower").cast("long")).alias("point")
    pts = b.stations(spark, d).select(F.lit("a").alias("case_id"), F.lit(0).cast("long").alias("snapshot"), "side", "x", "y", point)
    route = tiles.routed(pts, cells, plan, ("case_id", "snapshot"), 4)
    got = tiles.sampled(route, cells, {"p": "p"}, {"p": "linear"}, ("case_id", "snapshot"), 4)
    each = got.select("point", F.inline(F.arrays_zip("codes", F.col("p").alias("value"))))
    side = F.when(F.col("point") % 2 == 1, "lower").otherwise("upper").alias("side")
    return each.select(side, F.floor(F.col("point") / 2).cast("int").alias("i"), F.col("codes").cast("long").alias("code"), q("p", 3, F.col("value")))


# a body whose walls slope, and lie on cell centres in some columns and between them in others
@query(f"""WITH {b.STATIONS}, pr AS (SELECT DISTINCT x, CAST(12 + i % 5 AS DOUBLE) / 200 AS yu, CAST(4 + i % 4 AS DOUBLE) / 200 AS yl FROM stations),
pg AS (SELECT *, {_gradient_sql('yu', 'x', 'OVER (ORDER BY x)')} AS su, {_gradient_sql('yl', 'x', 'OVER (ORDER BY x)')} AS sl FROM pr),
ax AS (SELECT DISTINCT j, y FROM grid), co AS (SELECT DISTINCT i, x FROM grid WHERE x <= 45),
wl AS (SELECT 'upper' AS side, i, x, yu AS wall, su AS sl, CAST(1 AS DOUBLE) AS sg FROM co JOIN pg USING (x) UNION ALL SELECT 'lower', i, x, yl, sl, CAST(-1 AS DOUBLE) FROM co JOIN pg USING (x)),
jf AS (SELECT *, CASE WHEN side = 'upper' THEN coalesce((SELECT min(j) FROM ax WHERE y >= wall), 10) ELSE coalesce((SELECT max(j) FROM ax WHERE y <= wall), 0) END AS j FROM wl)
SELECT side, row_number() OVER (PARTITION BY side ORDER BY i) - 1 AS idx, i, j, x, y, {s('y_exact', 9, 'wall')}, {s('nx', 9, '-sg * sl / sqrt(1 + sl * sl)')}, {s('ny', 9, 'sg / sqrt(1 + sl * sl)')}, {s('dist_to_wall', 9, 'abs(y - wall)')}
FROM jf JOIN ax USING (j) WHERE CASE WHEN side = 'upper' THEN y >= wall ELSE y <= wall END""")
def surface_profile(spark, d):
    i = F.col("i")
    prof = b.stations(spark, d).select("x", ((12 + i % 5).cast("double") / 200.0).alias("y_upper"), ((4 + i % 4).cast("double") / 200.0).alias("y_lower")).distinct()
    w = Window.orderBy("x")
    prof = prof.withColumns({"dyu_dx": stencil.gradient("y_upper", "x", w), "dyl_dx": stencil.gradient("y_lower", "x", w)})
    out = surface.profile_surface(b.grid(spark, d), prof, max_x=45.0)
    return out.select("side", F.col("idx").cast("long").alias("idx"), "i", "j", "x", "y", q("y_exact", 9), q("nx", 9), q("ny", 9), q("dist_to_wall", 9))


# --- gas dynamics and theory -----------------------------------------------------------------------

_MU = "CAST(1.716e-5 AS DOUBLE) * pow(t / CAST(273.15 AS DOUBLE), 1.5) * CAST(383.55 AS DOUBLE) / (t + CAST(110.4 AS DOUBLE))"


@query(f"WITH {b.ANGLES} SELECT part_id, {s('mu', 12, _MU)} FROM angles")
def viscosity(spark, d):
    return b.angles(spark, d).select("part_id", q("mu", 12, gas.viscosity("t")))


@query(f"WITH {b.ANGLES} SELECT part_id, {s('re_x', 1, f'CAST(0.0267 AS DOUBLE) * 1011 * x / ({_MU})')}, CAST(NULL AS DOUBLE) AS re_delta FROM angles")
def reynolds(spark, d):
    mu = gas.viscosity("t")
    return b.angles(spark, d).select("part_id", q("re_x", 1, gas.reynolds("x", 1011.0, 0.0267, mu)), gas.reynolds(F.lit(None).cast("double"), 1011.0, 0.0267, mu).alias("re_delta"))


_VAC = "CAST(-2 AS DOUBLE) / (CAST(1.4 AS DOUBLE) * CAST(7.7 AS DOUBLE) * CAST(7.7 AS DOUBLE))"
_PITOT = "(2 / (CAST(1.4 AS DOUBLE)*CAST(59.29 AS DOUBLE)) * (pow(CAST(5.76 AS DOUBLE)*59.29 / (CAST(5.6 AS DOUBLE)*59.29 - CAST(0.8 AS DOUBLE)), 3.5) * ((CAST(2.8 AS DOUBLE)*59.29 - CAST(0.4 AS DOUBLE)) / CAST(2.4 AS DOUBLE)) - 1))"


@query(f"WITH {b.ANGLES} SELECT part_id, {s('cp', 9, f'CASE WHEN theta > 0 THEN 2 * sin(theta) * sin(theta) ELSE {_VAC} END')} FROM angles")
def newton(spark, d):
    return b.angles(spark, d).select("part_id", q("cp", 9, gas.newton_cp("theta", 7.7)))


@query(f"WITH {b.ANGLES} SELECT part_id, {s('cp', 9, f'CASE WHEN theta > 0 THEN {_PITOT} * sin(theta) * sin(theta) ELSE {_VAC} END')} FROM angles")
def modified_newton(spark, d):
    return b.angles(spark, d).select("part_id", q("cp", 9, gas.modified_newton_cp("theta", 7.7)))


def _blend_sql(joint: str) -> str:
    t = f"least(greatest((x - (CAST({joint} AS DOUBLE) - 0.005)) / CAST(0.01 AS DOUBLE), 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


@query(f"""WITH {b.ANGLES}, a AS (SELECT part_id, CASE WHEN x < 0.2019 THEN radians(7) WHEN x < 0.2119 THEN radians(7) * (1 - {_blend_sql('0.2069')}) WHEN x < 0.3797 THEN 0 WHEN x < 0.3897 THEN radians(10) * {_blend_sql('0.3847')} ELSE radians(10) END AS an,
CASE WHEN x < 0.2019 THEN 'cone' WHEN x < 0.2119 THEN 'cyl-junc' WHEN x < 0.3797 THEN 'cylinder' WHEN x < 0.3897 THEN 'flare-junc' ELSE 'flare' END AS section FROM angles) SELECT part_id, {s('theta_local', 9, 'an')}, section FROM a""")
def inclination_sections(spark, d):
    angle, section = gas.inclination("x")
    return b.angles(spark, d).select("part_id", q("theta_local", 9, angle), section.alias("section"))


@query(f"WITH {b.ANGLES} SELECT part_id, {s('cf', 9, 'CASE WHEN re > 0 THEN CAST(0.664 AS DOUBLE) / sqrt(greatest(re, 1)) ELSE 0 END')} FROM angles")
def cf_laminar(spark, d):
    return b.angles(spark, d).select("part_id", q("cf", 9, gas.laminar_cf("re")))


@query(f"""WITH {b.ANGLES} SELECT part_id, {s('schultz', 9, 'CASE WHEN re > 10 THEN CAST(0.37 AS DOUBLE) / pow(log10(greatest(re, 10)), 2.584) ELSE 0 END')}, {s('power_law', 9, 'CASE WHEN re > 0 THEN CAST(0.0592 AS DOUBLE) / pow(greatest(re, 1), 0.2) ELSE 0 END')},
{s('schlichting', 9, 'CASE WHEN re > 10 THEN CAST(0.455 AS DOUBLE) / pow(log10(greatest(re, 10)), 2.58) ELSE 0 END')} FROM angles""")
def cf_turbulent(spark, d):
    return b.angles(spark, d).select("part_id", q("schultz", 9, gas.turbulent_cf("re")), q("power_law", 9, gas.turbulent_cf("re", "power-law")), q("schlichting", 9, gas.turbulent_cf("re", "schlichting")))


@query(f"""WITH {b.ANGLES} SELECT part_id, {s('reference_temperature', 9, 'CAST(0.003 AS DOUBLE) * pow(CAST(0.5 AS DOUBLE) * (1 + t / 125) + CAST(0.22 AS DOUBLE) * 0.85 * 0.5 * 0.4 * m * m, -0.4)')},
{s('laminar', 9, 'CAST(0.003 AS DOUBLE) * pow(CAST(0.5 AS DOUBLE) * (1 + t / 125) + CAST(0.22 AS DOUBLE) * 0.72 * 0.5 * 0.4 * m * m, -0.5)')},
{s('van_driest', 9, 'CAST(0.003 AS DOUBLE) / CASE WHEN m > 0.3 THEN pow(125 * (1 + CAST(0.89 AS DOUBLE) * 0.2 * m * m) / greatest(t, 1), 0.4) ELSE 1 END')} FROM angles""")
def cf_compressible(spark, d):
    a = b.angles(spark, d)
    cf, t_inf = F.lit(0.003), F.lit(125.0)
    return a.select("part_id", q("reference_temperature", 9, gas.compressible_cf(cf, "m", "t", t_inf)), q("laminar", 9, gas.compressible_cf(cf, "m", "t", t_inf, flow="laminar")), q("van_driest", 9, gas.compressible_cf(cf, "m", "t", t_inf, method="van-driest-II")))


def _mangler_sql(speed: int, scale: int = 1) -> str:
    """CTE re: the stations with x over `scale`, re_s and the ratio of Mangler's transform."""
    return f"""{b.STATIONS}, sc AS (SELECT * REPLACE (x / {scale} AS x) FROM stations), st AS (SELECT side, idx, x, pow(greatest(abs(y), 1e-10), 2) AS r2, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS ds FROM sc WINDOW w AS (PARTITION BY side ORDER BY idx)),
ar AS (SELECT *, sum(ds) OVER w AS s, coalesce((lag(r2) OVER w + r2) / 2 * ds, 0) AS di FROM st WINDOW w AS (PARTITION BY side ORDER BY idx)),
mg AS (SELECT *, sum(di) OVER w AS i2, row_number() OVER w AS rn FROM ar WINDOW w AS (PARTITION BY side ORDER BY idx)), re AS (SELECT *, CAST(0.0267 AS DOUBLE) * {speed} * s / CAST(8.6e-6 AS DOUBLE) AS re_s, r2 * greatest(s, 1e-15) / greatest(i2, 1e-30) AS ratio FROM mg)"""


_MANGLER = _mangler_sql(1011)


@query(f"WITH {_MANGLER} SELECT side, idx, {s('Re_s', 0, 're_s')}, {s('Cf_laminar', 9, '(CASE WHEN re_s > 0 THEN CAST(0.664 AS DOUBLE) / sqrt(greatest(re_s, 1)) ELSE 0 END) * CASE WHEN rn = 1 THEN pow(CAST(3 AS DOUBLE), 0.5) ELSE pow(ratio, 0.5) END')} FROM re")
def cf_mangler_laminar(spark, d):
    return theory.friction(b.stations(spark, d), ["side"], "idx", 0.0267, 1011.0, 8.6e-6).select("side", "idx", q("Re_s", 0), q("Cf_laminar", 9))


@query(f"WITH {_MANGLER} SELECT side, idx, {s('Cf_turbulent', 9, '(CASE WHEN re_s > 10 THEN CAST(0.37 AS DOUBLE) / pow(log10(greatest(re_s, 10)), 2.584) ELSE 0 END) * CASE WHEN rn = 1 THEN pow(CAST(3 AS DOUBLE), 0.2) ELSE pow(ratio, 0.2) END')} FROM re")
def cf_mangler_turbulent(spark, d):
    return theory.friction(b.stations(spark, d), ["side"], "idx", 0.0267, 1011.0, 8.6e-6).select("side", "idx", q("Cf_turbulent", 9))


@query()
def theory_comparison(spark, d):
    pts = b.stations(spark, d).withColumn("x", F.col("x") / 100.0).withColumn("Temperature", F.lit(300.0))
    out = theory.comparison(pts, ["side"], "idx", 7.7, 0.0267, 1726.0, 8.6e-6)
    return out.select("side", "idx", "section_id", *(q(c, 7) for c in ("theta_local", "Cp_newton", "Cp_modified_newton", "Cp_tangent_cone", "Cf_laminar", "Cf_turbulent")))


_TINF = "(CAST(1726 AS DOUBLE) / CAST(7.7 AS DOUBLE) * (CAST(1726 AS DOUBLE) / CAST(7.7 AS DOUBLE)) / (CAST(1.4 AS DOUBLE) * CAST(287.05 AS DOUBLE)))"


def _star_sql(recovery: str) -> str:
    return f"(CAST(0.5 AS DOUBLE) * (1 + 300 / {_TINF}) + CAST(0.22 AS DOUBLE) * CAST({recovery} AS DOUBLE) * CAST(0.2 AS DOUBLE) * CAST(59.29 AS DOUBLE))"


@query(f"""WITH {_mangler_sql(1726, 100)}, an AS (SELECT *, CASE WHEN x < 0.2019 THEN radians(7) WHEN x < 0.2119 THEN radians(7) * (1 - {_blend_sql('0.2069')}) WHEN x < 0.382 THEN 0 WHEN x < 0.392 THEN radians(10) * {_blend_sql('0.387')} ELSE radians(10) END AS theta,
 CASE WHEN x < 0.2019 THEN 'cone' WHEN x < 0.2119 THEN 'cyl-junc' WHEN x < 0.382 THEN 'cylinder' WHEN x < 0.392 THEN 'flare-junc' ELSE 'flare' END AS section_id FROM re)
SELECT side, idx, section_id, {s('theta_local', 7, 'theta')}, {s('Cp_newton', 7, f'CASE WHEN theta > 0 THEN 2 * sin(theta) * sin(theta) ELSE {_VAC} END')}, {s('Cp_modified_newton', 7, f'CASE WHEN theta > 0 THEN {_PITOT} * sin(theta) * sin(theta) ELSE {_VAC} END')},
{s('Cf_laminar', 9, f"(CASE WHEN re_s > 0 THEN CAST(0.664 AS DOUBLE) / sqrt(greatest(re_s, 1)) ELSE 0 END) * (CASE WHEN rn = 1 THEN pow(CAST(3 AS DOUBLE), 0.5) ELSE pow(ratio, 0.5) END) * pow({_star_sql('0.72')}, -0.5)")},
{s('Cf_turbulent', 9, f"(CASE WHEN re_s > 10 THEN CAST(0.37 AS DOUBLE) / pow(log10(greatest(re_s, 10)), 2.584) ELSE 0 END) * (CASE WHEN rn = 1 THEN pow(CAST(3 AS DOUBLE), 0.2) ELSE pow(ratio, 0.2) END) * pow({_star_sql('0.85')}, -0.4)")} FROM an""")
def theory_coefficients(spark, d):
    """The comparison without the cone table, which SQL can't state."""
    pts = b.stations(spark, d).withColumn("x", F.col("x") / 100.0).withColumn("Temperature", F.lit(300.0))
    out = theory.comparison(pts, ["side"], "idx", 7.7, 0.0267, 1726.0, 8.6e-6, cone=False)
    return out.select("side", "idx", "section_id", *(q(c, 7) for c in ("theta_local", "Cp_newton", "Cp_modified_newton")), q("Cf_laminar", 9), q("Cf_turbulent", 9))


def _deflection_sql(beta: str) -> str:
    n2 = f"m * m * sin({beta}) * sin({beta})"
    return f"atan2(2 * ({n2} - 1) / tan({beta}), m * m * (CAST(1.4 AS DOUBLE) + cos(2 * {beta})) + 2)"


@query(f"""WITH RECURSIVE {b.ANGLES}, ca AS (SELECT DISTINCT m, theta FROM angles WHERE theta > 0 AND m > 1), ed AS (SELECT m, theta, asin(1 / m) + CAST(1e-8 AS DOUBLE) AS low, pi() / 2 - CAST(1e-8 AS DOUBLE) AS high FROM ca),
sn AS (SELECT m, theta, low, low + CAST(k AS DOUBLE) / 199 * (high - low) AS beta FROM ed, range(200) t(k)), tu AS (SELECT *, {_deflection_sql('beta')} AS turn FROM sn),
tp AS (SELECT m, theta, min(low) AS low, arg_max(beta, turn) AS top, max(turn) AS most FROM tu GROUP BY 1, 2),
bi AS (SELECT m, theta, most, low AS a, top AS z, 0 AS step FROM tp UNION ALL
 SELECT m, theta, most, CASE WHEN {_deflection_sql('c')} < theta THEN c ELSE a END, CASE WHEN {_deflection_sql('c')} < theta THEN z ELSE c END, step + 1 FROM (SELECT *, (a + z) / 2 AS c FROM bi WHERE step < 60)),
be AS (SELECT m, theta, most, (a + z) / 2 AS beta, pow(m * sin((a + z) / 2), 2) AS n2 FROM bi WHERE step = 60),
so AS (SELECT *, 1 + CAST(2.8 AS DOUBLE) / CAST(2.4 AS DOUBLE) * (n2 - 1) AS ratio, (1 + CAST(0.2 AS DOUBLE) * n2) / (CAST(1.4 AS DOUBLE) * n2 - CAST(0.2 AS DOUBLE)) AS after FROM be),
gd AS (SELECT * FROM so WHERE theta <= CAST(0.98 AS DOUBLE) * most AND after >= 0),
al AS (SELECT part_id, a.theta <= 0 OR a.m <= 1 AS still, a.m, a.theta, g.beta AS b, g.ratio, g.after FROM angles a LEFT JOIN gd g ON g.m = a.m AND g.theta = a.theta),
fi AS (SELECT part_id, CASE WHEN still THEN 0 ELSE (ratio - 1) / (CAST(0.7 AS DOUBLE) * m * m) END AS cp, CASE WHEN NOT still THEN b END AS beta, CASE WHEN still THEN m ELSE sqrt(after) / sin(b - theta) END AS m2, CASE WHEN still THEN 1 ELSE ratio END AS p_ratio FROM al)
SELECT part_id, {s('cp', 7)}, {s('beta', 7)}, {s('m2', 6)}, {s('p_ratio', 6)} FROM fi""")
def oblique_shock(spark, d):
    return b.angles(spark, d).withColumn("s", numeric.oblique_shock_column("m", "theta")).select("part_id", q("cp", 7, F.col("s.cp")), q("beta", 7, F.col("s.beta")), q("m2", 6, F.col("s.m2")), q("p_ratio", 6, F.col("s.p_ratio")))


@query()
def cone_flow(spark, d):
    cases = b.angles(spark, d).select("m", "theta").distinct()  # each pair is solved once
    return cases.withColumn("s", numeric.cone_flow_column("m", "theta")).select("m", q("theta", 7), q("cp", 5, F.col("s.cp")), q("beta", 5, F.col("s.beta")), q("m_surface", 4, F.col("s.m_surface")))


@query()
def tangent_cone(spark, d):
    return numeric.tangent_cone(b.angles(spark, d), "theta", 7.7, "cp").select("part_id", q("cp", 6))


# --- probes ----------------------------------------------------------------------------------------


@query(f"WITH {b.PROBE} SELECT probe_id, seq, {s('T', 6, 'p / (rho * CAST(287.05 AS DOUBLE))')}, {s('p_ratio', 9, 'p / 760')}, {s('tau', 3, 't / (CAST(0.1 AS DOUBLE) / 1726)')} FROM probe")
def probe_derived(spark, d):
    return probe.derived(b.probe(spark, d)).select("probe_id", "seq", q("T", 6, "Temperature"), q("p_ratio", 9), q("tau", 3))


_RESTART = f"{b.PROBE}, rs AS (SELECT *, CASE WHEN seq > 20 THEN t - 500000 ELSE t END AS t2 FROM probe)"


@query(f"WITH {_RESTART}, jm AS (SELECT *, CASE WHEN t2 - lead(t2) OVER (PARTITION BY probe_id ORDER BY seq) > 0.01 THEN seq END AS jump FROM rs), ct AS (SELECT *, min(jump) OVER (PARTITION BY probe_id) AS cut FROM jm) SELECT probe_id, seq, {s('t', 6, 't2')} FROM ct WHERE cut IS NULL OR seq > cut")
def probe_reset_trim(spark, d):
    p = b.probe(spark, d).withColumn("t", F.when(F.col("seq") > 20, F.col("t") - 500000.0).otherwise(F.col("t")))
    return probe.reset_trim(p).select("probe_id", "seq", q("t", 6))


@query(f"WITH {b.PROBE}, n AS (SELECT *, count(*) OVER (PARTITION BY probe_id) AS n FROM probe) SELECT probe_id, seq, {s('value', 6)} FROM n WHERE seq <= greatest(1, floor(n * CAST(0.3 AS DOUBLE)))")
def probe_head_fraction(spark, d):
    return probe.head_fraction(b.probe(spark, d), 0.3).select("probe_id", "seq", q("value", 6))


@query(f"WITH {b.PROBE} SELECT probe_id, seq, {s('signal', 5, 'value - avg(value) OVER (PARTITION BY probe_id)')} FROM probe")
def probe_detrend(spark, d):
    return probe.detrend(b.probe(spark, d), "value", "signal").select("probe_id", "seq", q("signal", 5))


@query(f"WITH {b.PROBE}, dd AS (SELECT probe_id, t, t - lag(t) OVER (PARTITION BY probe_id ORDER BY seq) AS dt FROM probe) SELECT probe_id, count(*) AS n, {s('duration', 3, 'max(t) - min(t)')}, {s('dt', 3, 'avg(dt)')}, {s('rate', 9, '1 / avg(dt)')} FROM dd GROUP BY 1")
def probe_sampling(spark, d):
    return probe.sampling(b.probe(spark, d)).select("probe_id", "n", q("duration", 3), q("dt", 3), q("rate", 9))


@query(f"""WITH {b.PROBE}, n AS (SELECT probe_id, seq - 1 AS m, value - avg(value) OVER (PARTITION BY probe_id) AS v, count(*) OVER (PARTITION BY probe_id) AS n FROM probe),
x AS (SELECT probe_id, k, n, sum(v * cos(2 * pi() * k * m / n)) AS re, sum(v * sin(2 * pi() * k * m / n)) AS im FROM n, range(1, 10000) t(k) WHERE k < (n + 1) // 2 GROUP BY 1, 2, 3)
SELECT probe_id, CAST(k AS INT) AS k, {s('amplitude', 5, '2 * sqrt(re * re + im * im) / n')} FROM x""")
def probe_spectrum(spark, d):
    return probe.spectrum(b.probe(spark, d), "value").select("probe_id", "k", q("amplitude", 5))


@query(f"WITH {b.PROBE} SELECT c AS case_id, probe_id, count(*) AS n FROM probe, (VALUES ('a'), ('b')) v(c) WHERE c = 'a' OR seq <= 10 GROUP BY 1, 2")
def probe_union(spark, d):
    p = b.probe(spark, d)
    both = probe.union_of(p, p.filter("seq <= 10").withColumn("case_id", F.lit("b")))
    return both.groupBy("case_id", "probe_id").agg(F.count("*").alias("n"))


@query(f"WITH {b.KNOTS} SELECT {s('y', 9, 'x * pow(CAST(0.25 AS DOUBLE), 0.5) * 2')}, {s('value', 6, 'y * 3')} FROM knots")
def alt_profile_scale(spark, d):
    k = b.knots(spark, d).select(F.col("x").alias("y"), F.col("y").alias("value"))
    return src.scaled_profile(k, transform="boundary_layer_nondim", x=0.5, unit_reynolds=2.0, y_scale=2.0, value_scale=3.0).select(q("y", 9), q("value", 6))


# --- smoothing and cubic interpolation: by orthogonal polynomials in SQL, and exact on cubics ------------


def _cubic_fit_sql(half: int, source: str, out: str) -> str:
    """CTE `out` (i, j, v): source (i, j, r: place on its line from 0, n: length of the line, f) smoothed by the cubic of
    least squares over the window about each place, the first and last window at the ends."""
    begin = f"least(greatest(a.r - {half}, 0), a.n - {2 * half + 1})"
    return f"""pk AS (SELECT CAST(k AS DOUBLE) AS k FROM range({-half}, {half + 1}) t(k)), mo AS (SELECT sum(k*k) / count(*) AS a, sum(k*k*k*k) / sum(k*k) AS c FROM pk),
po AS (SELECT k, CAST(1 AS DOUBLE) AS p0, k AS p1, k*k - a AS p2, k*k*k - c*k AS p3 FROM pk, mo), nr AS (SELECT sum(p0*p0) AS n0, sum(p1*p1) AS n1, sum(p2*p2) AS n2, sum(p3*p3) AS n3 FROM po),
cf AS (SELECT x.k AS at, y.k AS k, x.p0*y.p0/n0 + x.p1*y.p1/n1 + x.p2*y.p2/n2 + x.p3*y.p3/n3 AS w FROM po x, po y, nr),
{out} AS (SELECT a.i, a.j, sum(w * b.f) AS v FROM {source} a JOIN {source} b ON b.j = a.j AND b.r BETWEEN {begin} AND {begin} + {2 * half} JOIN cf ON cf.at = a.r - {begin} - {half} AND cf.k = b.r - {begin} - {half} GROUP BY 1, 2)"""


_ON_LINES = "row_number() OVER (PARTITION BY j ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY j) AS n FROM grid"


@query(f"WITH {b.GRID}, li AS (SELECT i, j, p AS f, {_ON_LINES}), {_cubic_fit_sql(7, 'li', 'sm')} SELECT i, j, {s('p_smooth', 4, 'v')} FROM sm")
def savgol(spark, d):
    out = numeric.smoothed(b.grid(spark, d).select("i", "j", "p"), ["p"], ["j"], "i", window=15)
    return out.select("i", "j", q("p_smooth", 4))


# 50 stations over 49 mm: a median of 5 and a cubic over 21.
@query(f"""WITH {b.GRID}, li AS (SELECT i, j, u, {_ON_LINES}), md AS (SELECT a.i, a.j, a.r, a.n, median(b.u) AS f FROM li a CROSS JOIN range(-2, 3) t(k)
 JOIN li b ON b.j = a.j AND b.r = CASE WHEN a.r + k < 0 THEN -1 - a.r - k WHEN a.r + k >= a.n THEN 2 * a.n - 1 - a.r - k ELSE a.r + k END GROUP BY ALL), {_cubic_fit_sql(10, 'md', 'sm')} SELECT i, j, {s('u_smooth', 5, 'v')} FROM sm""")
def adaptive_smooth(spark, d):
    pts = stencil.with_arc_length(b.grid(spark, d).select("i", "j", "x", "y", "u"), "x", "y", ["j"], "i")
    return numeric.smoothed(pts.withColumn("s", F.col("s") / 1000.0), ["u"], ["j"], "i", length="s").select("i", "j", q("u_smooth", 5))


@query()
def cubic_grid(spark, d):
    pts = b.table(spark, d, "supplier").select(F.lit("a").alias("case_id"), F.lit(0).cast("long").alias("snapshot"), F.col("s_suppkey").alias("point_id"), (1.3 + (F.col("s_suppkey") % 480) / F.lit(10.0)).alias("px"), ((F.col("s_suppkey") % 97) / F.lit(1000.0)).alias("py"))
    return spline.cubic(pts, b.grid(spark, d), "p", "value").select("point_id", q("value", 4))


@query(f"""WITH pt AS (SELECT s_suppkey AS point_id, CAST(1.3 AS DOUBLE) + (s_suppkey % 480) / CAST(10 AS DOUBLE) AS x, (s_suppkey % 97) / CAST(1000 AS DOUBLE) AS y FROM supplier)
SELECT point_id, {s('value', 6, 'x*x*x / 1000 - 20 * x*x * y + 300 * x * y*y - 5000 * y*y*y + 2')} FROM pt""")
def cubic_exact(spark, d):
    """A field that is a cubic along both axes, which the splines give exactly."""
    x, y = F.col("x"), F.col("y")
    cells = b.grid(spark, d).withColumn("f", x * x * x / 1000.0 - 20.0 * x * x * y + 300.0 * x * y * y - 5000.0 * y * y * y + 2.0)
    pts = b.table(spark, d, "supplier").select(F.lit("a").alias("case_id"), F.lit(0).cast("long").alias("snapshot"), F.col("s_suppkey").alias("point_id"), (1.3 + (F.col("s_suppkey") % 480) / F.lit(10.0)).alias("px"), ((F.col("s_suppkey") % 97) / F.lit(1000.0)).alias("py"))
    return spline.cubic(pts, cells, "f", "value").select("point_id", q("value", 6))


# --- views -----------------------------------------------------------------------------------------


@query(f"SELECT 0 AS line_id, CAST(k AS INT) AS ord, CAST(0.1 AS DOUBLE) AS x, {s('y', 9, '0.5 * pow(k / CAST(8 AS DOUBLE), 2)')} FROM range(9) t(k) UNION ALL SELECT 1, CAST(k AS INT), CAST(0.2 AS DOUBLE), {s('y', 9, '1 + 2 * sqrt(k / CAST(4 AS DOUBLE))')} FROM range(5) t(k)")
def seed_lines(spark, d):
    lines = [{"x": 0.1, "low": 0.0, "high": 0.5, "count": 9, "spacing": "power"}, {"x": 0.2, "low": 1.0, "high": 3.0, "count": 5, "spacing": "sqrt"}]
    return views.seed_lines(spark, lines).select("line_id", "ord", "x", q("y", 9))


@query(f"""WITH {b.GRID}, near AS (SELECT i FROM (SELECT DISTINCT i, x FROM grid) ORDER BY abs(x - 10), i LIMIT 1)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY y) - 1 AS ord, {s('value', 6, 'val')}, {s('distance', 9, 'y')} FROM (SELECT 'first' AS label, y, u AS val FROM grid JOIN near USING (i) UNION ALL SELECT 'second', y, v FROM grid JOIN near USING (i))""")
def profile_view(spark, d):
    cells = b.grid(spark, d)
    both = views.profile_view([("first", g.wall_normal_profile(cells, "u", 10.0)), ("second", g.wall_normal_profile(cells, "v", 10.0))])
    return both.select("label", F.col("ord").cast("long").alias("ord"), q("value", 6, F.col("x")), q("distance", 9, F.col("y")))


@query(f"WITH {b.GRID} SELECT i, j, {s('ratio', 9, 'CASE WHEN j = 0 THEN NULL ELSE u / j END')} FROM grid")
def ieee_division(spark, d):
    return b.grid(spark, d).select("i", "j", q("ratio", 9, fdiv("u", F.col("j").cast("double"))))


# --- whole entries -----------------------------------------------------------------------------------


@query(f"""WITH {b.GRID}, near AS (SELECT i FROM (SELECT DISTINCT i, x FROM grid) ORDER BY abs(x - 12.2), i LIMIT 1), pts AS (SELECT * FROM grid JOIN near USING (i) WHERE y >= 0.02)
SELECT label, row_number() OVER (PARTITION BY label ORDER BY y) - 1 AS ord, x AS x_sampled, {s('distance', 9, 'y - sy')}, {s('value', 6, 'v')} FROM (SELECT 'first' AS label, x, y, p AS v, CAST(0.02 AS DOUBLE) AS sy FROM pts UNION ALL SELECT 'second', x, y, p * 2, CAST(0.05 AS DOUBLE) FROM pts WHERE y >= 0.05)""")
def line_extraction(spark, d):
    cells = b.grid(spark, d)
    doubled = cells.withColumn("pressure", F.col("p") * 2.0).drop("p")
    cases = [{"source": "one", "label": "first"}, {"source": "two", "label": "second", "surface_y": 0.05}]
    out = controllers.line_extraction(cases, lambda c: cells if c["source"] == "one" else doubled, "p", 12.2, surface_y=0.02)
    return out.select("label", F.col("ord").cast("long").alias("ord"), "x_sampled", q("distance", 9), q("value", 6))


@query(f"""WITH {b.GRID} SELECT label, i, j, {s('color', 6, 'c')}, m AS mask FROM (SELECT 'a' AS label, i, j, sqrt(u*u + v*v) AS c, v < 0 AS m FROM grid UNION ALL SELECT 'b', i, j, p, v > 1 FROM grid)""")
def streamline_sets(spark, d):
    cells = b.grid(spark, d)
    cases = [{"source": "a", "label": "a"}, {"source": "b", "label": "b", "color_key": "p", "mask_mode": "above", "mask_threshold": 1.0}]
    out, _ = controllers.streamlines(spark, cases, lambda c: cells, color="speed", mask_key="v", threshold=0.0)
    return out.select("label", "i", "j", q("color", 6), "mask")


@query(f"WITH {b.GRID}, st AS (SELECT DISTINCT i, x FROM grid), near AS (SELECT t, arg_min(i, (abs(x - t), i)) AS i FROM st, (VALUES (10.2), (30.7)) v(t) GROUP BY t) SELECT CAST(t AS DOUBLE) AS station, j AS ord, y, {s('value', 6, 'rho')} FROM grid JOIN near USING (i) WHERE y BETWEEN 0.01 AND 0.08")
def snapshot_lines(spark, d):
    out = controllers.snapshot_views(b.grid(spark, d), "rho", stations=(10.2, 30.7), y_range=(0.01, 0.08), stream=STREAM)
    return out["lines"].select("station", "ord", "y", q("value", 6))


@query(f"WITH {b.GRID} SELECT i - 20 AS di, j - 5 AS dj, {s('p', 6)} FROM grid WHERE abs(i - 20) <= 3 AND abs(j - 5) <= 3")
def cell_neighbourhood(spark, d):
    return views.neighbourhood(b.grid(spark, d), 20, 5, 3).select("di", "dj", q("p", 6))
