"""Interpolation and location on axes: piecewise-linear, bilinear, splines of arrays, and cells next to a wall."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import KEYS
from .scan import parts, with_neighbours


def interpolate(queries: DataFrame, knots: DataFrame, x: str, y: str, out: str, keys=()) -> DataFrame:
    """queries with y interpolated at x between ascending knots, ends clamped; keys match queries to knot sets.

    Knots and queries are merged in order (no pair is formed), so the cost is that of a sort whatever the number of
    knots: in a window per key or, without keys, in range partitions that carry their last and first knots over.
    """
    keys = list(keys)
    own = knots.groupBy(*keys, F.col(x).alias("_x")).agg(F.min(y).alias("_y"))
    q = queries.select(*keys, F.col(x).alias("_x")).distinct().withColumn("_y", F.lit(None).cast("double")).withColumn("_q", F.lit(True))
    both = own.withColumn("_q", F.lit(False)).unionByName(q)
    at = F.when(~F.col("_q"), F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))
    if keys:
        w = Window.partitionBy(*keys).orderBy("_x")
        a = F.last(at, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
        b = F.first(at, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    else:
        both = with_neighbours(parts(both.withColumn("_at", at), (), "_x"), (), "_x", "_at")
        a, b = F.col("_before"), F.col("_after")
    value = F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * ((F.col("_x") - a["x"]) / (b["x"] - a["x"])))
    found = both.withColumn(out, value).filter("_q").select(*keys, F.col("_x").alias(x), out)
    return queries.join(found, [*keys, x])


def bilinear(points: DataFrame, cells: DataFrame, field: str, out: str, x0: float, dx: float, nx: int, y0: float, dy: float, ny: int, extrapolate: bool = True, keys=KEYS) -> DataFrame:
    """points (keys, point_id, px, py) with the field by linear interpolation on uniform axes: each point meets
    its four corners by an equi-join on (keys, i, j); points without keys go with cells of one case. Outside
    the grid it extrapolates, or gives null."""
    keys = [k for k in keys if k in points.columns and k in cells.columns]
    i =F.least(F.greatest(F.floor((F.col("px") - x0) / dx), F.lit(0)), F.lit(nx - 2)).cast("int")
    j = F.least(F.greatest(F.floor((F.col("py") - y0) / dy), F.lit(0)), F.lit(ny - 2)).cast("int")
    located = points.withColumns({"_i": i, "_j": j})
    located = located.withColumns({"_a": (F.col("px") - (x0 + F.col("_i") * dx)) / dx, "_b": (F.col("py") - (y0 + F.col("_j") * dy)) / dy})
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (0, 1) for b in (0, 1)))).alias("c")
    each = located.select("*", corners)
    weight = F.when(F.col("c.di") == 1, F.col("_a")).otherwise(1.0 - F.col("_a")) * F.when(F.col("c.dj") == 1, F.col("_b")).otherwise(1.0 - F.col("_b"))
    each = each.select(*keys, "point_id", "px", "py", (F.col("_i") + F.col("c.di")).alias("i"), (F.col("_j") + F.col("c.dj")).alias("j"), weight.alias("_w"))
    found = each.join(cells.select(*keys, "i", "j", F.col(field).alias("_f")), [*keys, "i", "j"])
    total = found.groupBy(*keys, "point_id", "px", "py").agg(F.sum(F.col("_w") * F.col("_f")).alias(out))
    if extrapolate:
        return total
    inside = F.col("px").between(x0, x0 + (nx - 1) * dx) & F.col("py").between(y0, y0 + (ny - 1) * dy)
    return total.withColumn(out, F.when(inside, F.col(out)))


def wall_cells(walls: DataFrame, axis: DataFrame, keys=KEYS, strict: bool = False) -> DataFrame:
    """walls (keys, …, side, wall_y) with j_fluid, y_fluid, j_ghost, y_ghost: the first centre at or above an upper
    wall (last at or below a lower one; with `strict` last below it) and its neighbour across the wall, both clamped to the axis.

    axis (keys, j, y) is one column of coordinates a case, j from 0 without gaps. Walls and centres are merged in order over
    range partitions; the neighbours' coordinates come by their j.
    """
    keys = [k for k in keys if k in walls.columns and k in axis.columns]
    own = axis.select(*keys, "j", "y").distinct()
    asked = walls.select(*keys, F.col("wall_y").alias("_y")).filter("_y is not null").distinct()
    marked = own.select(*keys, F.col("y").cast("double").alias("_y"), F.struct("y", "j").alias("_at")).unionByName(asked, allowMissingColumns=True)
    near = with_neighbours(parts(marked, keys, "_y"), keys, "_y", "_at").filter("_at is null").select(*keys, F.col("_y").alias("wall_y"), "_before", "_after")
    last = own.groupBy(*keys).agg(F.max("j").alias("_n"))  # a row a case
    both = walls.join(near, [*keys, "wall_y"])
    both = both.join(F.broadcast(last), keys) if keys else both.crossJoin(F.broadcast(last))
    upper, tie = F.col("side") == "upper", (F.col("_before.y") == F.col("wall_y")) if strict else F.lit(False)
    above, below = F.coalesce("_after.j", "_n"), F.coalesce(F.col("_before.j") - tie.cast("int"), F.lit(0))
    fluid = F.when(upper, above).otherwise(F.greatest(below, F.lit(0)))
    out = both.withColumn("j_fluid", fluid.cast("int"))
    ghost = F.when(upper, F.greatest(F.col("j_fluid") - 1, F.lit(0))).otherwise(F.least(F.col("j_fluid") + 1, F.col("_n")))
    out = out.withColumn("j_ghost", ghost.cast("int")).drop("_before", "_after", "_n")
    for name in ("fluid", "ghost"):
        out = out.join(own.select(*(F.col(k).alias(k) for k in keys), F.col("j").alias(f"j_{name}"), F.col("y").alias(f"y_{name}")), [*keys, f"j_{name}"])
    return out.select(*walls.columns, "j_fluid", "j_ghost", "y_fluid", "y_ghost")


# --- cubic ---------------------------------------------------------------------------------------


def spline_moments(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Second derivatives of the not-a-knot cubic spline through f (last axis along x; at least 4 points).

    The end conditions are put into the rows next to them, and what is left has three diagonals: one
    elimination for all lines at once, linear in their length. A line with a NaN has NaNs only.
    """
    h = np.diff(x)
    low, middle, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    middle[0] += h[0] * (h[0] + h[1]) / h[1]
    up[0] -= h[0] ** 2 / h[1]
    middle[-1] += h[-1] * (h[-2] + h[-1]) / h[-2]
    low[-1] -= h[-1] ** 2 / h[-2]
    r = np.moveaxis(6 * np.diff(np.diff(f, axis=-1) / h, axis=-1), -1, 0).copy()
    for k in range(1, len(r)):
        w = low[k] / middle[k - 1]
        middle[k] -= w * up[k - 1]
        r[k] -= w * r[k - 1]
    r[-1] /= middle[-1]
    for k in range(len(r) - 2, -1, -1):
        r[k] = (r[k] - up[k] * r[k + 1]) / middle[k]
    inner = np.moveaxis(r, 0, -1)
    first = ((h[0] + h[1]) * inner[..., 0] - h[0] * inner[..., 1]) / h[1]
    last = ((h[-2] + h[-1]) * inner[..., -1] - h[-1] * inner[..., -2]) / h[-2]
    return np.concatenate([first[..., None], inner, last[..., None]], -1)


def _between(x: np.ndarray, at: np.ndarray, k: np.ndarray, f0, f1, m0, m1) -> np.ndarray:
    h, a, b = x[k + 1] - x[k], x[k + 1] - at, at - x[k]
    out = (m0 * a**3 + m1 * b**3) / (6 * h) + (f0 / h - m0 * h / 6) * a + (f1 / h - m1 * h / 6) * b
    return np.where((at >= x[0]) & (at <= x[-1]), out, np.nan)


def _knot(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)


def spline_at(x: np.ndarray, f: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spline values (last axis) at points, NaN outside [x0, x1]."""
    k = _knot(x, at)
    return _between(x, at, k, f[..., k], f[..., k + 1], m[..., k], m[..., k + 1])


def cubic_grid_at(x: np.ndarray, y: np.ndarray, f: np.ndarray, px: np.ndarray, py: np.ndarray, together: int = 4096) -> np.ndarray:
    """Tensor-product cubic spline of f[i, j] at points, `together` of them at a time."""
    along_y = spline_moments(y, f)
    out = np.empty(len(px))
    for at in range(0, len(px), together):
        a, b = px[at : at + together], py[at : at + together]
        rows = spline_at(y, f, along_y, b).T  # the line along x through each point
        m, k, every = spline_moments(x, rows), _knot(x, a), np.arange(len(a))
        out[at : at + together] = _between(x, a, k, rows[every, k], rows[every, k + 1], m[every, k], m[every, k + 1])
    return out
