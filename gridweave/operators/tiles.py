"""Sampling a grid at points through tiles: no task holds more of a grid than one tile and its halo.

A grid is cut in tiles of TILE x TILE cells by index. Samples are located on the case's axes and sent to the tile of
their lower left cell; a tile carries one more row and column of cells, as deep as the stencil reaches. Where a tile has the
whole stencil, its values are those of the untiled grid to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import KEYS

TILE = 256


def fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own: two sides of a cogroup may come from the same cells."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def axes(cells: DataFrame, keys=KEYS) -> DataFrame:
    """keys, axis ("x" or "y"), k, at: the coordinates of a case's columns and lines, as rows."""
    keys = [k for k in keys if k in cells.columns]
    sides = [cells.groupBy(*keys, F.col(k).alias("k")).agg(F.max(a).alias("at")).select(*keys, F.lit(a).alias("axis"), "k", "at") for a, k in (("x", "i"), ("y", "j"))]
    return sides[0].union(sides[1])


def axis_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(x by i, y by j) of one case's axes."""
    name, k, at = np.asarray(table["axis"]), np.asarray(table["k"]), np.asarray(table["at"], np.float64)
    out = []
    for a in "xy":
        own = name == a
        values = np.zeros(int(k[own].max(initial=-1)) + 1)
        values[k[own]] = at[own]
        out.append(values)
    return out[0], out[1]


def lower_cell(axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The interval of a point, the first or last one for points outside."""
    return np.clip(np.searchsorted(axis, at, "right") - 1, 0, len(axis) - 2)


def tiled(cells: DataFrame, fields: dict[str, str], size: int = TILE, keys=KEYS) -> DataFrame:
    """keys, ti, tj, i, j, x, y and fields (new name: column): each cell in its tile and, on a tile's first row or column, in the halo of
    the tile before; at most four rows a cell, and few cells have more than one."""
    keys = [k for k in keys if k in cells.columns]
    before = lambda k, t: F.when((F.col(k) % size == 0) & (F.col(k) > 0), F.array(t, t - 1)).otherwise(F.array(t))
    at = {k: F.floor(F.col(k) / size).cast("int") for k in "ij"}
    own = cells.select(*keys, "i", "j", "x", "y", *(F.col(c).cast("double").alias(n) for n, c in fields.items()), before("i", at["i"]).alias("_ti"), before("j", at["j"]).alias("_tj"))
    return own.withColumn("ti", F.explode("_ti")).withColumn("tj", F.explode("_tj")).drop("_ti", "_tj")


def by_tile(case: dict, point: np.ndarray, code: np.ndarray, px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray, size: int) -> list[dict]:
    """Rows (case, ti, tj, point, codes, px, py) of samples in the order given: one for each point and tile."""
    ti, tj = lower_cell(x, px) // size, lower_cell(y, py) // size
    order = np.lexsort((tj, ti, point))
    same = np.stack([point, ti, tj])[:, order]
    cuts = np.flatnonzero(np.any(same[:, 1:] != same[:, :-1], axis=0)) + 1
    rows = []
    for own in np.split(order, cuts) if len(order) else ():
        k = own[0]
        rows.append({**case, "ti": int(ti[k]), "tj": int(tj[k]), "point": int(point[k]), "codes": code[own], "px": px[own], "py": py[own]})
    return rows


ROUTE = "ti int, tj int, point long, codes array<int>, px array<double>, py array<double>"


class Tile:
    """The cells of one tile and its halo as arrays."""

    def __init__(self, table: pa.Table, fields: list[str]):
        i, j = np.asarray(table["i"]), np.asarray(table["j"])
        self.i0, self.j0 = int(i.min()), int(j.min())
        i, j = i - self.i0, j - self.j0
        self.x, self.y = np.full(i.max() + 1, np.nan), np.full(j.max() + 1, np.nan)
        self.x[i], self.y[j] = np.asarray(table["x"], np.float64), np.asarray(table["y"], np.float64)
        self.f = {}
        for n in fields:
            self.f[n] = np.full((len(self.x), len(self.y)), np.nan)
            self.f[n][i, j] = np.asarray(table[n].cast(pa.float64()).to_numpy(zero_copy_only=False))

    def located(self, px: np.ndarray, py: np.ndarray):
        x, y = self.x, self.y
        i, j = lower_cell(x, px), lower_cell(y, py)
        return i, j, (px - x[i]) / (x[i + 1] - x[i]), (py - y[j]) / (y[j + 1] - y[j])

    def linear(self, name: str, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Bilinear values; points beyond the cells are extrapolated."""
        i, j, a, b = self.located(px, py)
        f = self.f[name]
        return (1 - a) * ((1 - b) * f[i, j] + b * f[i, j + 1]) + a * ((1 - b) * f[i + 1, j] + b * f[i + 1, j + 1])

    def cubic(self, name: str, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Tensor spline values from the field and its spline moments along y, along x and both (name_y, name_x, name_xy)."""
        i, j, _, _ = self.located(px, py)
        x, y = self.x, self.y

        def along(h, a, b, f0, f1, m0, m1):
            return (m0 * a**3 + m1 * b**3) / (6 * h) + (f0 / h - m0 * h / 6) * a + (f1 / h - m1 * h / 6) * b

        line = lambda f, m, k: along(y[j + 1] - y[j], y[j + 1] - py, py - y[j], f[k, j], f[k, j + 1], m[k, j], m[k, j + 1])
        value = [line(self.f[name], self.f[f"{name}_y"], k) for k in (i, i + 1)]
        moment = [line(self.f[f"{name}_x"], self.f[f"{name}_xy"], k) for k in (i, i + 1)]
        return along(x[i + 1] - x[i], x[i + 1] - px, px - x[i], *value, *moment)


def sampled(routed: DataFrame, cells: DataFrame, fields: dict[str, str], kinds: dict[str, str], keys=KEYS, size: int = TILE, carry=()) -> DataFrame:
    """keys, point, codes, px, py and an array of values a field, for each row of `routed` (by_tile); kinds: "linear" or "cubic"
    a field to be read. A cubic field f needs its moments among the fields (spline.moments). Tiles without samples
    are read by no task's function; a tile without cells gives no rows."""
    keys = [k for k in keys if k in routed.columns]
    types = {f.name: f.dataType.simpleString() for f in routed.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "point long, codes array<int>, px array<double>, py array<double>", *(f"{n} array<double>" for n in kinds), *(f"{c} {types[c]}" for c in carry)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*keys, "point", "codes", "px", "py"]
        if not left.num_rows or not right.num_rows:
            types_of = [*(left.schema.field(n).type for n in names), *[pa.list_(pa.float64())] * len(kinds), *(left.schema.field(c).type for c in carry)]
            return pa.table({n: pa.array([], t) for n, t in zip([*names, *kinds, *carry], types_of, strict=True)})
        tile = Tile(right, list(fields))
        px, py = (left[n].combine_chunks() for n in ("px", "py"))
        offsets = px.offsets
        px, py = (np.asarray(a.values, np.float64)[offsets[0].as_py() : offsets[-1].as_py()] for a in (px, py))
        edges = pa.array(np.asarray(offsets) - offsets[0].as_py(), pa.int32())
        out = left.select(names)
        for n, kind in kinds.items():
            out = out.append_column(n, pa.ListArray.from_arrays(edges, pa.array(getattr(tile, kind)(n, px, py))))
        for c in carry:
            out = out.append_column(c, left[c])
        return out

    needed = tiled(cells, fields, size, keys).join(fresh(routed.select(*keys, "ti", "tj").distinct()), [*keys, "ti", "tj"], "left_semi")
    by, needed = [*keys, "ti", "tj"], fresh(needed)
    return routed.groupBy(*by).cogroup(needed.groupBy(*by)).applyInArrow(run, schema)


def routed(points: DataFrame, cells: DataFrame, plan: Callable[[dict, pa.Table, np.ndarray, np.ndarray, int], list[dict]], keys, size: int = TILE, facts: bool = False) -> DataFrame:
    """Rows of by_tile (and, with facts, an array of numbers) for a case's points: plan(case, points, x, y, size) places their samples on the case's axes. A task has a
    case's points and axes, one dimension less than its cells."""
    keys = [k for k in keys if k in cells.columns]
    types = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), ROUTE, *(["facts array<double>"] if facts else [])])
    kinds = {"ti": pa.int32(), "tj": pa.int32(), "point": pa.int64(), "codes": pa.list_(pa.int32()), "px": pa.list_(pa.float64()), "py": pa.list_(pa.float64())}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            case = {k: left[k][0].as_py() for k in keys}
            rows = plan(case, left, *axis_arrays(right), size)
        fields = {**{k: left.schema.field(k).type for k in keys}, **kinds, **({"facts": pa.list_(pa.float64())} if facts else {})}
        return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in fields.items()})

    return points.groupBy(*keys).cogroup(fresh(axes(cells, keys)).groupBy(*keys)).applyInArrow(run, schema)
