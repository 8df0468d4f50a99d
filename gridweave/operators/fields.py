"""Derived fields of a grid, statistics, overlays and zoom windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gas import GAMMA
from ..functions.numeric import NAN, fdiv, finite, num
from . import grid as g
from .stencil import gradient, gradient_uniform


def _keys(cells: DataFrame, keys=g.KEYS) -> list[str]:
    return [k for k in keys if k in cells.columns]


def vorticity(cells: DataFrame, out: str = "vorticity") -> DataFrame:
    """dv/dx - du/dy and its magnitude."""
    wx, wy = g.line(cells, "i"), g.line(cells, "j")
    curl = gradient("v", "x", wx) - gradient("u", "y", wy)
    return cells.withColumn(out, curl).withColumn(f"{out}_mag", F.abs(F.col(out)))


def gradient_magnitude(cells: DataFrame, field: str, out: str, compat: str | None = None) -> DataFrame:
    """|grad field|. compat="swapped" divides the x differences by dy and the y differences by dx, each the
    spacing of the first two cells, as an older convention did; right only where the two are equal."""
    wx, wy = g.line(cells, "i"), g.line(cells, "j")
    if compat == "swapped":
        keys = _keys(cells)
        first = cells.groupBy(*keys).agg(
            (F.min(F.when(F.col("i") == 1, F.col("x"))) - F.min(F.when(F.col("i") == 0, F.col("x")))).alias("_dx"),
            (F.min(F.when(F.col("j") == 1, F.col("y"))) - F.min(F.when(F.col("j") == 0, F.col("y")))).alias("_dy"),
        )
        cells = cells.join(F.broadcast(first), keys)
        gx, gy = gradient_uniform(field, wx, F.col("_dy")), gradient_uniform(field, wy, F.col("_dx"))
    else:
        gx, gy = gradient(field, "x", wx), gradient(field, "y", wy)
    return cells.withColumn(out, F.sqrt(gx * gx + gy * gy)).drop("_dx", "_dy")


def schlieren(cells: DataFrame, rho: str = "rho", strength: float = 50.0, compat: str | None = None) -> DataFrame:
    """exp(-strength |grad rho| / max |grad rho|); ones where the maximum is 0. The maximum is one row a case."""
    keys = _keys(cells)
    with_grad = gradient_magnitude(cells, rho, "grad_rho", compat)
    top = with_grad.groupBy(*keys).agg(F.max("grad_rho").alias("_top"))
    out = F.when(F.col("_top") > 0, F.exp(F.lit(-strength) * F.col("grad_rho") / F.col("_top"))).otherwise(1.0)
    return with_grad.join(F.broadcast(top), keys).withColumn("schlieren", out).drop("_top")


def normalised(cells: DataFrame, i: int = 0, j: int = 0, length: float = 0.2) -> DataFrame:
    """p, u and rho over their values in a reference cell, p over its dynamic pressure, and vorticity and
    |grad rho| over u/length and rho/length of that cell."""
    keys = _keys(cells)
    ref = g.reference_cell(cells, ("p", "u", "rho", "Mach"), i, j)
    out = gradient_magnitude(vorticity(cells), "rho", "grad_rho").join(F.broadcast(ref), keys)
    dynamic = 0.5 * GAMMA * F.col("p_ref") * F.col("Mach_ref") * F.col("Mach_ref")
    return out.withColumns(
        {
            "p_norm": fdiv("p", "p_ref"),
            "u_norm": fdiv("u", "u_ref"),
            "rho_norm": fdiv("rho", "rho_ref"),
            "p_dyn": fdiv("p", dynamic),
            "vorticity_norm": fdiv("vorticity", F.col("u_ref") / length),
            "grad_rho_norm": fdiv("grad_rho", F.col("rho_ref") / length),
        }
    ).drop("p_ref", "u_ref", "rho_ref", "Mach_ref")


def field_stats(cells: DataFrame, names, keys=g.KEYS) -> DataFrame:
    """keys, field, low, high, mean, n of the finite values of each field, in one pass."""
    keys = _keys(cells, keys)
    long = cells.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select(*keys, "x.*")
    return long.filter(finite("value")).groupBy(*keys, "field").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.count("*").alias("n"))


def colour_limits(cells: DataFrame, field: str, low: float = 0.01, high: float = 0.99, exact: bool = True, keys=g.KEYS) -> DataFrame:
    """keys, low, high: percentiles of the finite values, interpolated; exact=False sketches them at scale."""
    keys = _keys(cells, keys)
    ok = cells.filter(finite(field))
    q = (lambda p: F.percentile(field, F.lit(p))) if exact else (lambda p: F.percentile_approx(field, p, 10000))
    return ok.groupBy(*keys).agg(q(low).alias("low"), q(high).alias("high"))


def solid_masked(field: str, ib: str = "ib_markers", limit: float = 0.1) -> Column:
    """The field in the fluid, NaN inside a body."""
    return F.when(F.col(ib) < limit, F.col(field)).otherwise(F.lit(NAN))


def visible(field: str, low: float, high: float, ib: str | None = None, deadband: float | None = None, signed: bool = False) -> Column:
    """Finite, in the fluid, in [low, high] (either order of the bounds) and past the dead band."""
    low, high = min(low, high), max(low, high)
    v = F.col(field)
    out = finite(v) & v.between(low, high)
    if ib is not None:
        out = out & (F.col(ib) < 0.1)
    if deadband is not None:
        out = out & ((F.abs(v) >= deadband) if signed else (v >= deadband))
    return out


def overlay(
    cells: DataFrame, base: str = "Schlieren", field: str = "vorticity", low: float | None = None, high: float | None = None, signed: bool | None = None, deadband: float | None = None,
    mask_out_of_range: bool = True, base_low: float | None = None, base_high: float | None = None, ib: str = "ib_markers", keys=g.KEYS,
) -> DataFrame:
    """keys, i, j, x, y, base (NaN in a body), value, shown, and its case's base_low, base_high, low, high, signed, colours: a field over another.

    Limits that aren't given are a case's own: the base's 1st and 99th percentile in the fluid, the field's range over its finite values there;
    bounds in the wrong order change places. signed: whether the field has a value below 0. A value is shown if it is finite and in the
    fluid, in the range (unless mask_out_of_range is off) and past the dead band. Cells without a body's marker column are all fluid. A
    case without a finite value raises when it is read. Limits are a row a case and are broadcast.
    """
    keys = _keys(cells, keys)
    marked = ib in cells.columns
    fluid = (F.col(ib) < 0.1) if marked else F.lit(True)
    own = cells.withColumns({"_base": solid_masked(base, ib) if marked else F.col(base).cast("double"), "_value": F.col(field).cast("double")})
    seen = finite("_value") & fluid
    at = lambda q: F.percentile(F.when(finite("_base"), F.col("_base")), F.lit(q))
    given = lambda v, c: (F.lit(float(v)) if v is not None else c)
    limits = own.groupBy(*keys).agg(
        F.count_if(seen).alias("_n"), given(base_low, at(0.01)).alias("base_low"), given(base_high, at(0.99)).alias("base_high"),
        F.min(F.when(seen, F.col("_value"))).alias("_low"), F.max(F.when(seen, F.col("_value"))).alias("_high"),
    )
    a, b = given(low, F.col("_low")), given(high, F.col("_high"))
    sign = F.lit(signed) if signed is not None else F.col("_low") < 0
    empty = F.raise_error(F.concat(F.lit("no finite value of "), F.lit(field))).cast("double")
    limits = limits.select(
        *keys, "base_low", "base_high", F.when(F.col("_n") == 0, empty).otherwise(F.least(a, b)).alias("low"), F.greatest(a, b).alias("high"), sign.alias("signed"),
        F.lit("RdBu_r" if signed else "turbo").alias("colours"),
    )
    both = own.join(F.broadcast(limits), keys) if keys else own.crossJoin(F.broadcast(limits))
    shown = seen & F.col("_value").between(F.col("low"), F.col("high")) if mask_out_of_range else seen & F.col("low").isNotNull()
    if deadband is not None:
        shown = shown & (F.when(F.col("signed"), F.abs("_value")).otherwise(F.col("_value")) >= float(deadband))
    return both.select(*keys, "i", "j", "x", "y", F.col("_base").alias("base"), F.col("_value").alias("value"), shown.alias("shown"), "base_low", "base_high", "low", "high", "signed", "colours")


def shown_fraction(cells: DataFrame, shown: Column, keys=g.KEYS) -> DataFrame:
    keys = _keys(cells, keys)
    return cells.groupBy(*keys).agg(F.count_if(shown).alias("shown"), F.count("*").alias("cells")).withColumn("share", F.col("shown") / F.col("cells"))


# X ranges of the named zoom states.
ZOOM = {"Sec1": (0.05, 0.15), "Sec2": (0.20, 0.60)}


def zoom_window(cells: DataFrame, state: str = "Base", aspect: float = 1.0, ranges=ZOOM, keys=g.KEYS) -> DataFrame:
    """keys, x_low, x_high, y_low, y_high: the whole grid, or a named x range with y about the middle, clamped."""
    if state != "Base" and state not in ranges:
        raise ValueError(f"no zoom state {state!r}")
    keys = _keys(cells, keys)
    box = cells.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    if state == "Base":
        return box.select(*keys, F.col("x0").alias("x_low"), F.col("x1").alias("x_high"), F.col("y0").alias("y_low"), F.col("y1").alias("y_high"))
    low, high = ranges[state]
    half, middle = (high - low) * aspect / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    return box.select(*keys, F.lit(low).alias("x_low"), F.lit(high).alias("x_high"), F.greatest("y0", middle - half).alias("y_low"), F.least("y1", middle + half).alias("y_high"))


def geometry_mask(ib: str = "ib_markers") -> Column:
    """1 where a body marks a cell at all, else NaN."""
    return F.when(F.abs(F.col(ib)) > 0, 1.0).otherwise(F.lit(NAN))


def body_mask(cells: DataFrame, profile: DataFrame, keys=g.KEYS) -> DataFrame:
    """cells and in_body: y between the profile's interpolated envelopes, within its x range. Profiles go with the
    cells of their keys; one without keys is the body of all cells. A case without a profile has no body."""
    from .interp import interpolate

    keys = [k for k in keys if k in cells.columns and k in profile.columns]
    xs = cells.select(*keys, "x").distinct()
    upper = interpolate(xs, profile, "x", "y_upper", "_upper", keys)
    both = interpolate(upper, profile, "x", "y_lower", "_lower", keys)
    span = profile.groupBy(*keys).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"))  # a row a case
    both = both.join(F.broadcast(span), keys, "left") if keys else both.crossJoin(F.broadcast(span))
    joined = cells.join(both, [*keys, "x"])
    inside = F.col("x").between(F.col("_x0"), F.col("_x1")) & (num("y") >= F.col("_lower")) & (num("y") <= F.col("_upper"))
    return joined.withColumn("in_body", F.coalesce(inside, F.lit(False))).drop("_upper", "_lower", "_x0", "_x1")
