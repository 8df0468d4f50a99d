"""Cubic splines over grids without a grid in a task: moments line by line, then values tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import KEYS
from .interp import spline_moments
from .tiles import TILE, by_tile, routed, sampled


def line_moments(cells: DataFrame, fields: dict[str, str], along: str, keys=KEYS) -> DataFrame:
    """cells with the not-a-knot spline moments of fields (new column: field) along "x" or "y". A task has one line of one case
    at a time. Lines must have all their cells; a line with a null or NaN has NaNs."""
    k, line = ("i", "j") if along == "x" else ("j", "i")
    keys = [c for c in keys if c in cells.columns]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema), *(f"{n} double" for n in fields)])

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table[k]), kind="stable")
        table = table.take(pa.array(order))
        x = np.asarray(table[along], np.float64)
        f = np.stack([np.asarray(table[c].cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) for c in fields.values()])
        f = np.where(np.isnan(f).any(1, keepdims=True), np.nan, f)
        m = spline_moments(x, f) if len(x) > 3 else np.full_like(f, np.nan)
        for n, values in zip(fields, m, strict=True):
            table = table.append_column(n, pa.array(values))
        return table

    return cells.groupBy(*keys, line).applyInArrow(run, schema)


def moments(cells: DataFrame, names, keys=KEYS) -> DataFrame:
    """keys, i, j, x, y, each field f and its moments f_y, f_x and f_xy: what a tensor spline needs of its corners."""
    keys = [k for k in keys if k in cells.columns]
    own = cells.select(*keys, "i", "j", "x", "y", *(F.col(n).cast("double").alias(n) for n in names))
    own = line_moments(own, {f"{n}_y": n for n in names}, "y", keys)
    return line_moments(own, {**{f"{n}_x": n for n in names}, **{f"{n}_xy": f"{n}_y" for n in names}}, "x", keys)


def cubic(points: DataFrame, cells: DataFrame, field: str, out: str, keys=KEYS, size: int = TILE) -> DataFrame:
    """points (keys, point_id, px, py) with the field by a tensor cubic spline, NaN outside the cell centres; ids are integers.

    Lines go to tasks one at a time for their moments, tiles for the points in them; grids of less than four lines give NaN.
    """
    keys = [k for k in keys if k in cells.columns]
    own = cells.select(*keys, "i", "j", "x", "y", F.col(field).alias("f"))
    numbered = points.select(*keys, F.col("point_id").cast("long").alias("point"), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))

    def plan(case: dict, table: pa.Table, x: np.ndarray, y: np.ndarray, size: int) -> list[dict]:
        point, px, py = (np.asarray(table[c]) for c in ("point", "px", "py"))
        inside = (px >= x[0]) & (px <= x[-1]) & (py >= y[0]) & (py <= y[-1]) if len(x) > 3 and len(y) > 3 else np.zeros(len(px), bool)
        point, px, py = point[inside], px[inside], py[inside]
        return by_tile(case, point, np.arange(len(point), dtype=np.int32), px, py, x, y, size)

    fields = {n: n for n in ("f", "f_x", "f_y", "f_xy")}
    route = routed(numbered.filter("px is not null and py is not null"), own, plan, keys, size)
    carried = sampled(route, moments(own, ["f"], keys), fields, {"f": "cubic"}, keys, size)
    each = carried.select(*keys, "point", F.inline(F.arrays_zip("px", "py", F.col("f").alias("_value"))))
    found = each.toDF(*keys, "point", "px", "py", out).dropDuplicates([*keys, "point", "px", "py"])
    named = points.select(*keys, "point_id", "px", "py", F.col("point_id").cast("long").alias("point"))
    return named.join(found, [*keys, "point", "px", "py"], "left").select(*keys, "point_id", "px", "py", F.coalesce(out, F.lit(float("nan"))).alias(out))
