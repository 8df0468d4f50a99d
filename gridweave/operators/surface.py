"""Body surfaces: detection by markers, sub-cell walls, triangles, envelopes, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import fdiv, num
from .grid import KEYS
from .interp import interpolate, wall_cells
from .stencil import anchored_bins, gradient


def wall_columns(cells: DataFrame, max_x: float = 0.75, slow: float = 10.0, marker: float = 0.1, keys=KEYS) -> DataFrame:
    """keys, i, low, high: the lowest and highest body cell (slow and marked) of each column up to max_x."""
    keys = [k for k in keys if k in cells.columns]
    solid = cells.filter((F.col("x") <= max_x) & (F.col("vel_mag") < slow) & (F.col("ib_markers") > marker))
    return solid.groupBy(*keys, "i").agg(F.min("j").alias("low"), F.max("j").alias("high"))


def crossing(y1, y2, f1, f2, level: float = 0.5) -> Column:
    """Where f crosses the level between two cells, kept between them; their midpoint if f doesn't change."""
    y1, y2, f1, f2 = map(num, (y1, y2, f1, f2))
    t = F.least(F.greatest(fdiv(level - f1, f2 - f1), F.lit(0.0)), F.lit(1.0))
    return F.when(F.abs(f2 - f1) > 1e-6, y1 + t * (y2 - y1)).otherwise(0.5 * (y1 + y2))


def marker_surface(cells: DataFrame, max_x: float = 0.75, slow: float = 10.0, keys=KEYS) -> DataFrame:
    """keys, side, idx, i, j, x, y, y_interp: the fluid cell next to the body on each side of each column and
    the wall between it and the body cell; columns whose fluid cell is off the grid have no point."""
    keys = [k for k in keys if k in cells.columns]
    ends = wall_columns(cells, max_x, slow, keys=keys)
    sides = ends.select(
        *keys, "i",
        F.explode(F.array(F.struct(F.lit("upper").alias("side"), F.col("high").alias("body"), (F.col("high") + 1).alias("j")), F.struct(F.lit("lower").alias("side"), F.col("low").alias("body"), (F.col("low") - 1).alias("j")))).alias("s"),
    ).select(*keys, "i", "s.*")
    own = cells.select(*keys, "i", "j", "x", "y", F.col("ib_markers").alias("f"))
    fluid = sides.join(own, [*keys, "i", "j"])
    body = own.select(*keys, "i", F.col("j").alias("body"), F.col("y").alias("_y"), F.col("f").alias("_f"))
    out = fluid.join(body, [*keys, "i", "body"])
    idx = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("i")) - 1
    return out.select(*keys, "side", idx.alias("idx"), "i", "j", "x", "y", crossing("_y", "y", "_f", "f").alias("y_interp"))


def gathered(surface: DataFrame, cells: DataFrame, fields, keys=KEYS) -> DataFrame:
    """Fields of the cell at each surface point."""
    keys = [k for k in keys if k in cells.columns and k in surface.columns]
    return surface.join(cells.select(*keys, "i", "j", *fields), [*keys, "i", "j"])


# --- triangles ----------------------------------------------------------------------------------

_NORMAL = {"xy": ("z", "x", "y"), "xz": ("y", "x", "z"), "yz": ("x", "y", "z")}


def transform_triangles(triangles: DataFrame, scale: float | tuple = 1.0, shift=(0.0, 0.0, 0.0)) -> DataFrame:
    """Vertices scaled (one factor, or one an axis) and then moved."""
    s = scale if isinstance(scale, tuple) else (scale,) * 3
    moved = F.transform("v", lambda p: F.struct(*((p[a] * s[k] + shift[k]).alias(a) for k, a in enumerate("xyz"))))
    return triangles.withColumn("v", moved)


def plane_points(triangles: DataFrame, plane: str = "xy", coord: float = 0.0) -> DataFrame:
    """tri_id, edge, h, v: where edges cross a plane, and vertices that lie on it."""
    if plane not in _NORMAL:
        raise ValueError(f"plane is one of {sorted(_NORMAL)}")
    n, h, v = _NORMAL[plane]
    edges = F.array(*(F.struct(F.lit(k).alias("edge"), F.col("v")[k].alias("a"), F.col("v")[(k + 1) % 3].alias("b")) for k in range(3)))
    each = triangles.select("tri_id", F.inline(edges))
    da, db = F.col(f"a.{n}") - coord, F.col(f"b.{n}") - coord
    t = fdiv(da, da - db)
    cross = da * db < 0
    at = lambda c: F.when(cross, F.col(f"a.{c}") + t * (F.col(f"b.{c}") - F.col(f"a.{c}"))).otherwise(F.col(f"a.{c}"))
    return each.filter(cross | (F.abs(da) < 1e-14)).select("tri_id", "edge", at(h).alias("h"), at(v).alias("v"))


def envelope(points: DataFrame, h: str = "h", v: str = "v", keys=()) -> DataFrame:
    """keys, ord, x, y_upper, y_lower, dyu_dx, dyl_dx of the stations of a body: near-equal x are one station.
    A body with one station, or with a range of 1e-15 or less, raises when it is read; no points have no rows."""
    bins = anchored_bins(points, h, keys, values=(v,))
    w, body = Window.partitionBy(*keys).orderBy(h), Window.partitionBy(*keys)
    thin = (F.count("*").over(body) < 2) | (F.max(h).over(body) - F.min(h).over(body) <= 1e-15)
    x = F.when(thin, F.raise_error(F.lit("a body needs two stations or more")).cast("double")).otherwise(F.col(h))
    return bins.select(
        *keys, F.col("bin").alias("ord"), x.alias("x"), F.col(f"max_{v}").alias("y_upper"), F.col(f"min_{v}").alias("y_lower"),
        gradient(f"max_{v}", h, w).alias("dyu_dx"), gradient(f"min_{v}", h, w).alias("dyl_dx"),
    )


def body_profile(triangles: DataFrame, keys=()) -> DataFrame:
    """The envelope of all vertices by x."""
    points = triangles.select(*keys, F.explode("v").alias("p")).select(*keys, F.col("p.x").alias("h"), F.col("p.y").alias("v"))
    return envelope(points, keys=keys)


def plane_profile(triangles: DataFrame, plane: str = "xy", coord: float = 0.0) -> DataFrame:
    """The envelope of a plane's cut through triangles, along the plane's first axis."""
    return envelope(plane_points(triangles, plane, coord))


def profile_normals(queries: DataFrame, profile: DataFrame, side: str, keys=KEYS) -> DataFrame:
    """queries (keys, x) with nx, ny: unit normals outward from the body by the interpolated slope."""
    up = side == "upper"
    keys = [k for k in keys if k in queries.columns and k in profile.columns]
    slope = interpolate(queries, profile, "x", "dyu_dx" if up else "dyl_dx", "_s", keys)
    size = F.sqrt(1.0 + F.col("_s") * F.col("_s"))
    nx, ny = (-F.col("_s") / size, 1.0 / size) if up else (F.col("_s") / size, -1.0 / size)
    return slope.withColumns({"nx": nx, "ny": ny}).drop("_s")


def profile_surface(cells: DataFrame, profile: DataFrame, max_x: float = 0.75, keys=KEYS) -> DataFrame:
    """keys, side, idx, i, j, x, y, y_exact, nx, ny, dist_to_wall: for each grid column within the profile, the first
    fluid-side centre on each side of the body. A profile without a key is the body of all its cases."""
    keys = [k for k in keys if k in cells.columns]
    shared = [k for k in keys if k in profile.columns]
    span = profile.groupBy(*shared).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    columns = cells.select(*keys, "i", "x").distinct()
    columns = columns.join(F.broadcast(span), shared) if shared else columns.crossJoin(F.broadcast(span))  # a row a case
    columns = columns.filter(F.col("x").between(F.col("_x0"), F.col("_x1")) & (F.col("x") <= max_x)).select(*keys, "i", "x")
    axis = cells.select(*keys, "j", "y").distinct()
    parts = []
    for side, name in (("upper", "y_upper"), ("lower", "y_lower")):
        walls = interpolate(columns, profile, "x", name, "wall_y", shared).withColumn("side", F.lit(side))
        found = wall_cells(walls, axis, keys)
        right = (F.col("y_fluid") >= F.col("wall_y")) if side == "upper" else (F.col("y_fluid") <= F.col("wall_y"))
        parts.append(profile_normals(found.filter(right), profile, side, shared))
    both = parts[0].unionByName(parts[1])
    idx = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("i")) - 1
    return both.select(*keys, "side", idx.alias("idx"), "i", F.col("j_fluid").alias("j"), "x", F.col("y_fluid").alias("y"), F.col("wall_y").alias("y_exact"), "nx", "ny", F.abs(F.col("y_fluid") - F.col("wall_y")).alias("dist_to_wall"))


def tangential(u, v, nx, ny) -> Column:
    """Velocity along the wall, in the direction with a component of x that isn't negative."""
    ny = num(ny)
    along = num(u) * ny - num(v) * num(nx)
    return F.when(ny < 0, -along).otherwise(along)
