"""Plot-ready tables: the data contracts that a renderer draws, and seeds of streamlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .grid import KEYS
from .probe import LENGTH, SPEED
from .stencil import linspace

# Colour stops of the palettes, by name; the last of the plain ones is transparent white.
PALETTES = {
    "reds": ["crimson", "red", "orangered", "salmon", "pink", "white", (1, 1, 1, 0.0)],
    "blues": ["navy", "blue", "dodgerblue", "skyblue", "lightblue", "white", (1, 1, 1, 0.0)],
    "blue_to_red": ["navy", "blue", "dodgerblue", "skyblue", "lightblue", (1, 1, 1, 0.0), "pink", "salmon", "orangered", "red", "crimson"],
}

# Shape factors of laminar and turbulent layers, drawn as reference lines.
SHAPE_LINES = {"laminar": 2.59, "turbulent": 1.3}


def seed_line(spark, x: float, low: float, high: float, count: int, spacing: str = "uniform", power: float = 2.0, line_id: int = 0) -> DataFrame:
    """line_id, ord, x, y: seeds on a vertical line, dense at the low end for power spacing."""
    if count <= 0:
        raise ValueError("a count is positive")
    if high <= low:
        raise ValueError("the upper end is above the lower")
    shapes = {"uniform": lambda t: t, "power": lambda t: F.pow(t, F.lit(float(power))), "sqrt": lambda t: F.sqrt(t)}
    if spacing not in shapes:
        raise ValueError(f"spacing is one of {sorted(shapes)}")
    t = linspace(spark, 0.0, 1.0, count)
    return t.select(F.lit(line_id).alias("line_id"), "ord", F.lit(float(x)).alias("x"), (low + shapes[spacing](F.col("value")) * (high - low)).alias("y"))


def seed_lines(spark, lines: list[dict]) -> DataFrame:
    if not lines:
        raise ValueError("at least one line")
    parts = [seed_line(spark, line_id=k, **line) for k, line in enumerate(lines)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label(name, time=None, fallback: str = "case") -> Column:
    """A case's label: its name, its time, both, or the fallback."""
    name = F.col(name) if isinstance(name, str) else name
    stamp = F.format_string("t = %.3e s", time if isinstance(time, Column) else F.col(time)) if time is not None else F.lit(None).cast("string")
    return F.coalesce(F.concat_ws(", ", name, stamp), F.lit(fallback)) if time is not None else F.coalesce(name, F.lit(fallback))


def profile_view(profiles: list[tuple[str, DataFrame]]) -> DataFrame:
    """label, ord, x (the value), y (the distance) of several profiles on one pair of axes."""
    parts = [p.select(F.lit(n).alias("label"), "ord", F.col("value").alias("x"), F.col("distance").alias("y")) for n, p in profiles]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_view(table: DataFrame, values) -> DataFrame:
    """snapshot, side, s, quantity, value: property tables of several snapshots in long form."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("quantity"), F.col(v).cast("double").alias("value")) for v in values))).alias("q")
    return table.select("snapshot", "side", "s", pairs).select("snapshot", "side", "s", "q.*")


def group_summary(table: DataFrame, values, keys=("case_id",)) -> DataFrame:
    """keys, snapshot, side, quantity, low, high, mean, n: the finite values of property tables by snapshot and side."""
    keys = [k for k in keys if k in table.columns]
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("quantity"), F.col(v).cast("double").alias("value")) for v in values))).alias("q")
    long = table.select(*keys, "snapshot", "side", pairs).select(*keys, "snapshot", "side", "q.*").filter(finite("value"))
    stats = (F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count("*").alias("n"))
    return long.groupBy(*keys, "snapshot", "side", "quantity").agg(*stats)


def theory_view(simulation: DataFrame, theory: DataFrame) -> DataFrame:
    """Simulated and theoretical coefficients at the same surface points, of the same case and snapshot where both have them; a theory
    without them goes with all."""
    keys = [k for k in KEYS if k in simulation.columns]
    shared = [k for k in keys if k in theory.columns]
    return simulation.select(*keys, "side", "idx", "x", "C_p", "C_f", "H").join(theory.drop("x"), [*shared, "side", "idx"])


def probe_view(cases: list[tuple[str, DataFrame]], column: str = "p_ratio", second: list[tuple[str, DataFrame]] = (), curves: list[tuple[str, DataFrame]] = ()) -> DataFrame:
    """label, kind, tau, ratio on one axis of non-dimensional time: probes with derived ratios, the second solver's
    probes (t and the same column) and reference curves (tau, ratio)."""
    tau = F.col("t") / (LENGTH / SPEED)
    parts = [(n, "probe", p.select("tau", F.col(column).alias("ratio"))) for n, p in cases]
    parts += [(n, "second solver", p.select(tau.alias("tau"), F.col(column).alias("ratio"))) for n, p in second]
    parts += [(n, "reference", c.select("tau", "ratio")) for n, c in curves]
    if not parts:
        raise ValueError("at least one series")
    out = None
    for name, kind, df in parts:
        own = df.select(F.lit(name).alias("label"), F.lit(kind).alias("kind"), "tau", "ratio")
        out = own if out is None else out.unionByName(own)
    return out


def thinned(df: DataFrame, every: int, order: str = "ord") -> DataFrame:
    return df.filter(F.col(order) % every == 0)


def padded(snapshot, width: int = 5) -> Column:
    """A snapshot number with leading zeros; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", snapshot if isinstance(snapshot, Column) else F.col(snapshot))


def palette(name: str) -> list:
    """Colour stops by name; `_r` at its end reverses them."""
    base = name.removesuffix("_r")
    if base not in PALETTES:
        raise ValueError(f"no palette {name!r}; there are {sorted(PALETTES)}, each also reversed by _r")
    return PALETTES[base][::-1] if name.endswith("_r") else PALETTES[base]


def geometry_view(surface: DataFrame, cells: DataFrame, field: str, low: float = 0.01, high: float = 0.99) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(surface points, the field's cells, its colour limits) of a body drawn over a field."""
    from .fields import colour_limits

    keys = [k for k in KEYS if k in surface.columns]
    own = [k for k in KEYS if k in cells.columns]
    points = surface.select(*keys, "side", "idx", "x", F.coalesce(*(F.col(c) for c in ("y_exact", "y_interp", "y") if c in surface.columns)).alias("y"))
    return points, cells.select(*own, "i", "j", "x", "y", F.col(field).alias("value")), colour_limits(cells, field, low, high)


def neighbourhood(cells: DataFrame, i: int, j: int, reach: int = 8) -> DataFrame:
    """The cells within `reach` of one, as a boundary-layer diagnostic draws them, with their offsets."""
    near = (F.abs(F.col("i") - i) <= reach) & (F.abs(F.col("j") - j) <= reach)
    return cells.filter(near).withColumns({"di": F.col("i") - i, "dj": F.col("j") - j})
