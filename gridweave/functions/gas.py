"""Gas dynamics and flat-plate correlations as Columns (SI units, angles in radians)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import NAN, fdiv, finite, num

# The gas constant of air, and Sutherland's reference temperature, viscosity and constant for air.
R_AIR = 287.05
T_REF, MU_REF, S_AIR = 273.15, 1.716e-5, 110.4
GAMMA = 1.4


def speed(*components) -> Column:
    total = num(components[0]) * num(components[0])
    for c in components[1:]:
        total = total + num(c) * num(c)
    return F.sqrt(total)


def mach(velocity, sound) -> Column:
    return fdiv(velocity, sound)


def temperature(p, rho) -> Column:
    return fdiv(p, num(rho) * R_AIR)


def viscosity(t) -> Column:
    """Sutherland's law for air."""
    t = num(t)
    return F.lit(MU_REF) * F.pow(t / T_REF, F.lit(1.5)) * (T_REF + S_AIR) / (t + S_AIR)


def reynolds(length, u, rho, mu) -> Column:
    """Reynolds number of a length; null where the length is null."""
    return num(rho) * num(u) * num(length) / num(mu)


def dynamic_pressure(rho, u) -> Column:
    return 0.5 * num(rho) * num(u) * num(u)


def pressure_coefficient(p, rho_inf: float, u_inf: float, t_inf) -> Column:
    """(p - p_inf) / q_inf, with p_inf from the gas law at t_inf."""
    return (num(p) - rho_inf * R_AIR * num(t_inf)) / (0.5 * rho_inf * u_inf**2)


def vacuum_cp(m: float, gamma: float = GAMMA) -> float:
    return -2.0 / (gamma * m**2)


def newton_cp(theta, m: float, gamma: float = GAMMA) -> Column:
    """2 sin(theta)**2; leeward sides see a vacuum."""
    theta = num(theta)
    s = F.sin(theta)
    return F.when(theta > 0, 2.0 * s * s).otherwise(F.lit(vacuum_cp(m, gamma)))


def pitot_cp(m: float, gamma: float = GAMMA) -> float:
    """Stagnation pressure coefficient behind a normal shock (Rayleigh's pitot formula)."""
    up, down = gamma + 1, gamma - 1
    ratio = (up**2 * m**2 / (4 * gamma * m**2 - 2 * down)) ** (gamma / down) * ((1 - gamma + 2 * gamma * m**2) / up)
    return 2 / (gamma * m**2) * (ratio - 1)


def modified_newton_cp(theta, m: float, gamma: float = GAMMA) -> Column:
    theta = num(theta)
    s = F.sin(theta)
    return F.when(theta > 0, pitot_cp(m, gamma) * s * s).otherwise(F.lit(vacuum_cp(m, gamma)))


def laminar_cf(re) -> Column:
    """Blasius; 0 where the Reynolds number isn't positive."""
    re = num(re)
    return F.when(re > 0, 0.664 / F.sqrt(F.greatest(re, F.lit(1.0)))).otherwise(0.0)


# Numerator and exponent of the logarithmic plate laws.
_LOG_LAWS = {"schultz-grunow": (0.370, 2.584), "schlichting": (0.455, 2.58)}


def turbulent_cf(re, method: str = "schultz-grunow") -> Column:
    re = num(re)
    if method == "power-law":
        return F.when(re > 0, 0.0592 / F.pow(F.greatest(re, F.lit(1.0)), F.lit(0.2))).otherwise(0.0)
    if method not in _LOG_LAWS:
        raise ValueError(f"no turbulent friction law named {method!r}")
    top, power = _LOG_LAWS[method]
    return F.when(re > 10, top / F.pow(F.log10(F.greatest(re, F.lit(10.0))), F.lit(power))).otherwise(0.0)


def compressible_cf(cf, m, t_wall, t_inf, gamma: float = GAMMA, method: str = "reference-temperature", flow: str = "turbulent") -> Column:
    """Friction corrected for compressibility by a reference temperature or by the adiabatic-wall ratio."""
    cf, m, t_wall, t_inf = map(num, (cf, m, t_wall, t_inf))
    turbulent = flow == "turbulent"
    if method == "reference-temperature":
        recovery = 0.85 if turbulent else 0.72
        star = t_inf * (0.5 * (1.0 + fdiv(t_wall, t_inf)) + 0.22 * recovery * 0.5 * (gamma - 1.0) * m * m)
        ratio = fdiv(star, t_inf)
        factor = F.when((t_inf > 0) & (ratio > 0), F.pow(ratio, F.lit(-0.5 if flow == "laminar" else -0.4))).otherwise(1.0)
        return cf * F.when(finite(factor) & (factor > 0), factor).otherwise(1.0)
    if method == "van-driest-II":
        recovery = 0.89 if turbulent else 0.72
        adiabatic = t_inf * (1.0 + recovery * (gamma - 1.0) / 2.0 * m * m)
        ratio = adiabatic / F.greatest(t_wall, F.lit(1.0))
        factor = F.when((m > 0.3) & (ratio > 0), F.pow(ratio, F.lit(0.4))).otherwise(1.0)
        return cf / F.when(finite(factor) & (factor > 0), factor).otherwise(1.0)
    raise ValueError(f"no compressibility correction named {method!r}")


def inclination(x, cone_deg=7.0, cone_end=0.2069, flare_start=0.3847, flare_deg=10.0, blend=0.005) -> tuple[Column, Column]:
    """(angle, section) of a cone-cylinder-flare body; angles blend by a cubic over `blend` on each side of a joint."""
    x = num(x)
    cone, flare = math.radians(cone_deg), math.radians(flare_deg)

    def step(joint: float) -> Column:
        t = F.least(F.greatest((x - (joint - blend)) / (2.0 * blend), F.lit(0.0)), F.lit(1.0))
        return t * t * (3.0 - 2.0 * t)

    pieces = (
        (x < cone_end - blend, F.lit(cone), "cone"),
        (x < cone_end + blend, cone * (1.0 - step(cone_end)), "cyl-junc"),
        (x < flare_start - blend, F.lit(0.0), "cylinder"),
        (x < flare_start + blend, flare * step(flare_start), "flare-junc"),
    )
    angle, section = None, None
    for where, a, s in pieces:
        angle = F.when(where, a) if angle is None else angle.when(where, a)
        section = F.when(where, F.lit(s)) if section is None else section.when(where, F.lit(s))
    return angle.otherwise(flare), section.otherwise("flare")


def nan_if(where: Column, value: Column) -> Column:
    return F.when(where, F.lit(NAN)).otherwise(value)
