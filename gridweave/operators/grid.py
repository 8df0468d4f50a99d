"""Structured grids: one row a cell (case_id, snapshot, i, j, [k], x, y, [z], fields), one column a field.

Windows are partitioned by case, snapshot and grid line, so a line is the unit of work and no window
spans a grid. Names, units and dtypes: fields are doubles in SI units unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import num

KEYS = ("case_id", "snapshot")

# Alias -> canonical field name, and the factor from CGS to SI by raw name.
ALIASES = {
    "Pressure": "p",
    "pressure": "p",
    "Density": "rho",
    "density": "rho",
    "Temp": "Temperature",
    "x_velocity": "u",
    "y_velocity": "v",
    "z_velocity": "w",
    "MachNumber": "Mach",
}
CGS_TO_SI = {
    "density": 1000.0,
    "pressure": 0.1,
    "x_velocity": 0.01,
    "y_velocity": 0.01,
    "z_velocity": 0.01,
    "viscosity": 0.1,
    "bulk_viscosity": 0.1,
    "conductivity": 1e-5,
}


def resolve_fields(available: list[str], wanted=None, aliases=ALIASES) -> dict[str, str]:
    """{output name: raw name}. wanted: None (all), a mapping, or names or aliases; an unknown one is a KeyError."""
    if wanted is None:
        return {aliases.get(n, n): n for n in available}
    pairs = dict(wanted).items() if hasattr(wanted, "items") else ((w, w) for w in wanted)
    by_alias = {}
    for raw in available:
        by_alias.setdefault(aliases.get(raw, raw), raw)
    out = {}
    for name, raw in pairs:
        found = raw if raw in available else by_alias.get(aliases.get(raw, raw))
        if found is None:
            raise KeyError(f"no field {raw!r}; there are {sorted(available)}")
        out[name] = found
    return out


def with_units(cells: DataFrame, raw_names, scale=CGS_TO_SI, axes=("x", "y", "z")) -> DataFrame:
    """Fields (by raw name) and axes from CGS to SI; a name without a factor stays."""
    out = {n: F.col(n) * F.lit(scale[n]) for n in raw_names if n in scale}
    out |= {a: F.col(a) / 100.0 for a in axes if a in cells.columns}
    return cells.withColumns(out)


def centres(nodes: DataFrame, axis: str, order: str, keys=()) -> DataFrame:
    """Cell centres of nodal coordinates: the midpoint of each node and the next."""
    after = F.lead(axis).over(Window.partitionBy(*keys).orderBy(order))
    return nodes.withColumn("_after", after).filter("_after is not null").withColumn(axis, (F.col(axis) + F.col("_after")) / 2.0).drop("_after")


def indexed(values: DataFrame, nx: int, ny: int, pos: str = "pos") -> DataFrame:
    """i, j and k of a flat position, x fastest."""
    p = F.col(pos)
    return values.withColumns({"i": (p % nx).cast("int"), "j": (F.floor(p / nx) % ny).cast("int"), "k": F.floor(p / (nx * ny)).cast("int")})


def line(cells: DataFrame, along: str, keys=KEYS):
    """The window along an axis: partitioned by the case and the other axes."""
    others = [c for c in ("i", "j", "k") if c in cells.columns and c != along]
    return Window.partitionBy(*[k for k in keys if k in cells.columns], *others).orderBy(along)


def nearest_index(cells: DataFrame, axis: str, index: str, at, keys=KEYS) -> DataFrame:
    """keys and the index of the station nearest to a coordinate, the first of ties. Grouped by index first,
    so only one row a station meets the minimum."""
    keys = [k for k in keys if k in cells.columns]
    stations = cells.groupBy(*keys, index).agg(F.min(axis).alias("_at"))
    return stations.groupBy(*keys).agg(F.min_by(index, F.struct(F.abs(F.col("_at") - num(at)), F.col(index))).alias(index))


def at_station(cells: DataFrame, axis: str, index: str, at, keys=KEYS) -> DataFrame:
    """The cells of the station nearest to a coordinate. One row a case is broadcast."""
    keys = [k for k in keys if k in cells.columns]
    return cells.join(F.broadcast(nearest_index(cells, axis, index, at, keys)), [*keys, index], "left_semi")


def wall_normal_profile(cells: DataFrame, field: str, x: float, surface_y: float = 0.0, y_max: float | None = None, side: str = "positive", keys=KEYS) -> DataFrame:
    """keys, ord, x_requested, x_sampled, y, distance, value at the station nearest to x, from the surface
    outward, both ends included; y_max bounds y. The negative side runs downward; distance is never negative."""
    if side not in ("positive", "negative"):
        raise ValueError("side is 'positive' or 'negative'")
    keys = [k for k in keys if k in cells.columns]
    up = side == "positive"
    y = F.col("y")
    inside = (y >= surface_y) if up else (y <= surface_y)
    if y_max is not None:
        inside = inside & ((y <= y_max) if up else (y >= y_max))
    found = at_station(cells.select(*keys, "i", "j", "x", "y", field), "x", "i", x, keys).filter(inside)
    order = Window.partitionBy(*keys).orderBy(F.col("y").asc() if up else F.col("y").desc())
    return found.select(
        *keys, (F.row_number().over(order) - 1).alias("ord"), F.lit(float(x)).alias("x_requested"), F.col("x").alias("x_sampled"), "y",
        F.abs(y - surface_y).alias("distance"), F.col(field).alias("value"),
    )


def line_band(cells: DataFrame, field: str, x: float, low: float, high: float, keys=KEYS) -> DataFrame:
    """keys, y, value at the station nearest to x with y in [low, high]."""
    keys = [k for k in keys if k in cells.columns]
    found = at_station(cells.select(*keys, "i", "x", "y", field), "x", "i", x, keys)
    return found.filter(F.col("y").between(low, high)).select(*keys, "y", F.col(field).alias("value"))


_PLANES = {"xy": "k", "xz": "j", "yz": "i"}


def plane_slice(cells: DataFrame, plane: str, index: int | None = None, coord: float | None = None, keys=KEYS) -> DataFrame:
    """A plane of a 3-D grid: nearest to a coordinate, else at an index, else in the middle (n // 2).

    In an xz plane v becomes w; in a yz plane u becomes v and v becomes w. The plane is validated
    before anything is read and an index is a literal filter, so it reaches the scan.
    """
    if plane not in _PLANES:
        raise ValueError(f"plane is one of {sorted(_PLANES)}")
    normal = _PLANES[plane]
    axis = {"i": "x", "j": "y", "k": "z"}[normal]
    if coord is not None:
        out = at_station(cells, axis, normal, coord, keys)
    elif index is not None:
        out = cells.filter(F.col(normal) == index)
    else:
        own = [k for k in keys if k in cells.columns]
        middle = cells.groupBy(*own).agg(F.floor((F.max(normal) + 1) / 2).cast("int").alias(normal))
        out = cells.join(F.broadcast(middle), [*own, normal], "left_semi")
    if plane == "xz" and {"v", "w"} <= set(cells.columns):
        out = out.withColumn("v", F.col("w"))
    if plane == "yz" and {"u", "v", "w"} <= set(cells.columns):
        out = out.withColumns({"u": F.col("v"), "v": F.col("w")})
    return out


def mask(field, threshold: float | None, mode: str = "below") -> Column:
    """Strictly below or above a threshold."""
    if threshold is None:
        raise ValueError("a mask needs a threshold")
    if mode not in ("below", "above"):
        raise ValueError("mode is 'below' or 'above'")
    return num(field) < threshold if mode == "below" else num(field) > threshold


def reference_cell(cells: DataFrame, fields, i: int = 0, j: int = 0, keys=KEYS) -> DataFrame:
    """keys and <field>_ref of one cell a case: the free stream."""
    keys = [k for k in keys if k in cells.columns]
    return cells.filter((F.col("i") == i) & (F.col("j") == j)).select(*keys, *(F.col(f).alias(f"{f}_ref") for f in fields))


def streamline_field(cells: DataFrame, u="u", v="v", color: str | None = None, mask_key: str | None = None, threshold: float | None = None, mode="below") -> DataFrame:
    """i, j, x, y, u, v, color and mask; color may be speed, velocity_magnitude or vel_mag without such a field."""
    have = set(cells.columns)
    for name in (u, v, *([mask_key] if mask_key else [])):
        if name not in have:
            raise KeyError(f"no field {name!r}")
    out = [c for c in (*KEYS, "i", "j", "x", "y") if c in have]
    cols = [F.col(u).alias("u"), F.col(v).alias("v")]
    if color is not None:
        if color in have:
            cols.append(F.col(color).alias("color"))
        elif color in ("speed", "velocity_magnitude", "vel_mag"):
            cols.append(F.hypot(F.col(u), F.col(v)).alias("color"))
        else:
            raise KeyError(f"no field {color!r}")
    if mask_key is not None:
        cols.append(mask(mask_key, threshold, mode).alias("mask"))
    return cells.select(*out, *cols)
