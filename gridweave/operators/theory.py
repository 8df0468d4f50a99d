"""Theory along a surface: axisymmetric friction by Mangler's transform, and the full comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gas import GAMMA, R_AIR, compressible_cf, inclination, laminar_cf, modified_newton_cp, newton_cp, pitot_cp, reynolds, turbulent_cf
from ..functions.numeric import finite
from .numeric import tangent_cone
from .stencil import with_arc_length, with_running_trapezoid


def with_mangler(surface: DataFrame, keys, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """surface with s, and I = the integral of r**2 over s, r = |y| kept off 0."""
    r = F.greatest(F.abs(F.col(y)), F.lit(1e-10))
    return with_running_trapezoid(with_arc_length(surface, x, y, keys, order).withColumn("_r2", r * r), "_r2", "s", keys, order, "_I")


def mangler_factor(power: float, first: Column) -> Column:
    """(r**2 s / I)**power; at the first point and where it isn't finite, the value on a cone, 3**power."""
    ratio = F.col("_r2") * F.greatest(F.col("s"), F.lit(1e-15)) / F.greatest(F.col("_I"), F.lit(1e-30))
    cone = F.lit(3.0**power)
    f = F.pow(ratio, F.lit(power))
    return F.when(first | ~finite(f), cone).otherwise(f)


def friction(surface: DataFrame, keys, order: str, rho: float, u: float, mu: float, m=None, t_wall=None, t_inf=None, method: str = "schultz-grunow") -> DataFrame:
    """surface with Re_s, Cf_laminar and Cf_turbulent, corrected for compressibility if m, t_wall and t_inf are given."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    out = with_mangler(surface, keys, order).withColumn("_first", first).withColumn("Re_s", reynolds("s", u, rho, mu))
    lam = laminar_cf("Re_s") * mangler_factor(0.5, F.col("_first"))
    tur = turbulent_cf("Re_s", method) * mangler_factor(0.2, F.col("_first"))
    if m is not None and t_wall is not None and t_inf is not None:
        lam = compressible_cf(lam, m, t_wall, t_inf, flow="laminar")
        tur = compressible_cf(tur, m, t_wall, t_inf, flow="turbulent")
    return out.withColumns({"Cf_laminar": lam, "Cf_turbulent": tur}).drop("_r2", "_I", "_first")


def comparison(surface: DataFrame, keys, order: str, m: float, rho: float, u: float, mu: float, t_wall="Temperature", t_inf: float | None = None, gamma: float = GAMMA, method="schultz-grunow", flare_start: float = 0.387, cone: bool = True) -> DataFrame:
    """surface with the inclination, its section, pressure coefficients by four theories and both frictions.
    The edge Mach number is the stream's; t_inf follows from u and m if it isn't given."""
    t_inf = t_inf if t_inf is not None else (u / m) ** 2 / (gamma * R_AIR)
    angle, section = inclination("x", flare_start=flare_start)
    out = friction(surface, keys, order, rho, u, mu, F.lit(m), F.col(t_wall) if isinstance(t_wall, str) else t_wall, F.lit(t_inf), method)
    out = out.withColumns({"theta_local": angle, "section_id": section})
    out = out.withColumns({"Cp_newton": newton_cp("theta_local", m, gamma), "Cp_modified_newton": modified_newton_cp("theta_local", m, gamma), "Cp_max": F.lit(pitot_cp(m, gamma))})
    return tangent_cone(out, "theta_local", m, "Cp_tangent_cone", gamma) if cone else out
