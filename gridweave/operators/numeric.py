"""Vectorised kernels: Savitzky-Golay and median smoothing, oblique shocks, cone flow."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gas import GAMMA, pitot_cp, vacuum_cp
from .grid import KEYS


def savgol(y: np.ndarray, window: int, order: int = 3) -> np.ndarray:
    """Least-squares polynomial smoothing; the ends take the fit of the first and last window."""
    if window % 2 == 0 or window <= order or window > len(y):
        raise ValueError("the window is odd, larger than the order, and no longer than the data")
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    project = basis @ np.linalg.pinv(basis)  # rows: the fit at each place of a window
    out = np.empty(len(y))
    out[half : len(y) - half] = np.lib.stride_tricks.sliding_window_view(y, window) @ project[half]
    out[:half] = project[:half] @ y[:window]
    out[len(y) - half :] = project[half + 1 :] @ y[-window:]
    return out


def running_median(y: np.ndarray, window: int) -> np.ndarray:
    """Median of an odd window, the ends reflected about their edge."""
    half = window // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(y, half, mode="symmetric"), window), axis=1)


def adaptive_windows(n: int, length: float) -> tuple[int, int]:
    """(median, polynomial) windows for n points over an arc length in metres: about 5 mm and 15 mm."""
    per_mm = n / ((length if length > 0 else 1.0) * 1000.0)
    most = n if n % 2 else n - 1
    median = max(3, int(per_mm * 5))
    poly = max(3 * median + 1, 21)
    return min(median | 1, most), min(poly | 1, most)


def adaptive_smooth(y: np.ndarray, length: float) -> np.ndarray:
    """Spikes by a median and then the trend by a cubic; gaps are bridged and come back as NaN. Too few
    finite points, or fewer than 5 points, come back as they are."""
    y = np.asarray(y, float)
    ok = np.isfinite(y)
    if len(y) < 5:
        return y
    median, poly = adaptive_windows(len(y), length)
    if ok.sum() < poly or poly <= 3:
        return y
    at = np.arange(len(y))
    full = np.where(ok, y, np.interp(at, at[ok], y[ok]))
    return np.where(ok, savgol(running_median(full, median), poly), np.nan)


def smoothed(df: DataFrame, columns, keys, order: str, length: str | None = None, window: int | None = None) -> DataFrame:
    """df with <column>_smooth: by a fixed window, or by windows adapted to the last value of an arc-length column."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}_smooth` double" for c in columns)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        size = float(table[length][-1].as_py()) if length else 0.0
        for c in columns:
            y = np.asarray(table[c].to_numpy(zero_copy_only=False), float)
            got = (savgol(y, window) if len(y) >= window else y) if window else adaptive_smooth(y, size)
            table = table.append_column(f"{c}_smooth", pa.array(got, pa.float64()))
        return table

    return df.groupBy(*keys).applyInArrow(run, schema)


def outward_normals(x: np.ndarray, y: np.ndarray, upper: bool, window: int = 51) -> dict[str, np.ndarray]:
    """y_smooth, nx, ny, theta, tangent_x, tangent_y of a surface in order of its points: y smoothed by cubics if
    there are more points than the window, tangents by differences of neighbours, normals that point to +y
    on an upper surface and to -y on a lower one. A single point has no tangent: NaNs."""
    smooth = savgol(y, window) if len(y) > window else y
    dx, dy = (np.gradient(x), np.gradient(smooth)) if len(x) > 1 else (np.full(len(x), np.nan),) * 2
    size = np.sqrt(dx**2 + dy**2) + 1e-10
    tx, ty = dx / size, dy / size
    turn = np.where(tx >= 0 if upper else tx <= 0, 1.0, -1.0)
    return {"y_smooth": smooth, "nx": -ty * turn, "ny": tx * turn, "theta": np.arctan2(dy, dx), "tangent_x": tx, "tangent_y": ty}


def surface_normals(surface: DataFrame, keys=KEYS, window: int = 51) -> DataFrame:
    """surface (keys, side, idx, x, y_interp) with y_smooth, nx, ny, theta, tangent_x, tangent_y of each case and side."""
    names = ("y_smooth", "nx", "ny", "theta", "tangent_x", "tangent_y")
    keys = [k for k in keys if k in surface.columns]
    surface = surface.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in surface.schema), *(f"{c} double" for c in names)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        x, y = (np.asarray(table[c].to_numpy(zero_copy_only=False), float) for c in ("x", "y_interp"))
        got = outward_normals(x, y, table["side"][0].as_py() == "upper", window)
        for c in names:
            table = table.append_column(c, pa.array(got[c], pa.float64()))
        return table

    return surface.groupBy(*keys, "side").applyInArrow(run, schema)


# --- shocks ----------------------------------------------------------------------------------------


def deflection(beta, m, gamma: float = GAMMA):
    """Flow angle behind an oblique shock of angle beta."""
    n2 = (m * np.sin(beta)) ** 2
    return np.arctan2(2 * (n2 - 1) / np.tan(beta), m**2 * (gamma + np.cos(2 * beta)) + 2)


def oblique_shock(m: np.ndarray, theta: np.ndarray, gamma: float = GAMMA) -> np.ndarray:
    """Rows (cp, beta, m2, p_ratio) of the weak solution. No deflection or a subsonic stream: (0, NaN, m, 1);
    beyond 98 % of the largest deflection: NaNs."""
    m, theta = np.broadcast_arrays(np.asarray(m, float), np.asarray(theta, float))
    out = np.full((len(m), 4), np.nan)
    still = (theta <= 0) | (m <= 1)
    out[still] = np.stack([np.zeros(still.sum()), np.full(still.sum(), np.nan), m[still], np.ones(still.sum())], 1)
    todo = np.flatnonzero(~still & np.isfinite(m) & np.isfinite(theta))
    if not len(todo):
        return out
    mm, tt = m[todo], theta[todo]
    low, high = np.arcsin(1 / mm) + 1e-8, np.full(len(mm), np.pi / 2 - 1e-8)
    scan = low[:, None] + np.linspace(0, 1, 200) * (high - low)[:, None]
    turn = deflection(scan, mm[:, None], gamma)
    top = turn.argmax(1)
    good = tt <= 0.98 * turn.max(1)
    a, b = low, scan[np.arange(len(mm)), top]
    for _ in range(60):
        c = (a + b) / 2
        under = deflection(c, mm, gamma) < tt
        a, b = np.where(under, c, a), np.where(under, b, c)
    beta = (a + b) / 2
    n2 = (mm * np.sin(beta)) ** 2
    p = 1 + 2 * gamma / (gamma + 1) * (n2 - 1)
    after = (1 + 0.5 * (gamma - 1) * n2) / (gamma * n2 - 0.5 * (gamma - 1))
    good &= after >= 0
    rows = np.stack([(p - 1) / (0.5 * gamma * mm**2), beta, np.sqrt(np.maximum(after, 0)) / np.sin(beta - tt), p], 1)
    out[todo[good]] = rows[good]
    return out


def _cone_slope(t, vr, vt, gamma):
    a2 = (gamma - 1) / 2 * (1 - vr**2 - vt**2)
    d = a2 - vt**2
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (vt**2 * vr - a2 * (2 * vr + vt / np.tan(t))) / d
    stop = (a2 <= 0) | (np.abs(t) < 1e-10) | (np.abs(d) < 1e-12)
    return np.where(stop, 0, vt), np.where(stop, 0, s)


def _cone_march(beta, theta, m, gamma, steps: int = 400, unscaled: bool = False):
    """(Vr, Vtheta) at the cone for shock angles beta, by Runge-Kutta steps from the shock; NaN without a shock.
    Speeds are over the largest speed; unscaled: over the stagnation speed of sound, as an older convention did."""
    n2 = (m * np.sin(beta)) ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        delta = np.arctan(2 / np.tan(beta) * (n2 - 1) / (m**2 * (gamma + np.cos(2 * beta)) + 2))
        m2 = np.sqrt((1 + 0.5 * (gamma - 1) * n2) / (gamma * n2 - 0.5 * (gamma - 1))) / np.sin(beta - delta)
        v = m2 / np.sqrt(1 + (gamma - 1) / 2 * m2**2) * (1 if unscaled else np.sqrt((gamma - 1) / 2))
    vr, vt = v * np.cos(beta - delta), -v * np.sin(beta - delta)
    h = (theta - beta) / steps
    t = beta
    for _ in range(steps):
        k1 = _cone_slope(t, vr, vt, gamma)
        k2 = _cone_slope(t + h / 2, vr + h / 2 * k1[0], vt + h / 2 * k1[1], gamma)
        k3 = _cone_slope(t + h / 2, vr + h / 2 * k2[0], vt + h / 2 * k2[1], gamma)
        k4 = _cone_slope(t + h, vr + h * k3[0], vt + h * k3[1], gamma)
        vr = vr + h / 6 * (k1[0] + 2 * k2[0] + 2 * k3[0] + k4[0])
        vt = vt + h / 6 * (k1[1] + 2 * k2[1] + 2 * k3[1] + k4[1])
        t = t + h
    lost = (n2 <= 1) | (beta <= theta)
    return np.where(lost, np.nan, vr), np.where(lost, 1.0, vt)


def cone_flow(m: np.ndarray, theta: np.ndarray, gamma: float = GAMMA, unscaled: bool = False) -> np.ndarray:
    """Rows (cp, beta, surface Mach) of the conical flow over cones of half-angle theta: the first shock angle
    of a scan of 30 where the flow normal to the cone changes sign, refined by bisection. Under 0.1 degrees
    or in a subsonic stream: (0, NaN, m); no solution: NaNs. unscaled keeps an older normalisation, in which
    supersonic flow behind the shock has no solution, so that tables fall back to modified Newton."""
    m, theta = np.broadcast_arrays(np.asarray(m, float), np.asarray(theta, float))
    out = np.full((len(m), 3), np.nan)
    still = (theta < np.radians(0.1)) | (m <= 1)
    out[still] = np.stack([np.zeros(still.sum()), np.full(still.sum(), np.nan), m[still]], 1)
    todo = np.flatnonzero(~still & np.isfinite(m) & np.isfinite(theta))
    if not len(todo):
        return out
    mm, tt = m[todo], theta[todo]
    low = np.arcsin(1 / mm) + 0.002
    high = 0.9 * np.minimum(np.pi / 2 - 0.01, tt + np.radians(50))
    scan = low[:, None] + np.linspace(0, 1, 30) * (high - low)[:, None]
    sign = np.sign(_cone_march(scan, tt[:, None], mm[:, None], gamma, 120, unscaled)[1])
    change = (sign[:, 1:] != sign[:, :-1]) & (scan[:, :-1] > tt[:, None])  # a shock lies outside its cone
    has = change.any(1)
    at = change.argmax(1)
    rows = np.arange(len(mm))
    a, b = scan[rows, at], scan[rows, at + 1]
    first = sign[rows, at]
    for _ in range(40):
        c = (a + b) / 2
        same = np.sign(_cone_march(c, tt, mm, gamma, 200, unscaled)[1]) == first
        a, b = np.where(same, c, a), np.where(same, b, c)
    beta = (a + b) / 2
    vr = np.abs(_cone_march(beta, tt, mm, gamma, unscaled=unscaled)[0])
    with np.errstate(invalid="ignore", divide="ignore"):
        ms2 = vr**2 / ((gamma - 1) / 2 * (1 - vr**2))
        n2 = (mm * np.sin(beta)) ** 2
        k = gamma / (gamma - 1)
        loss = ((gamma + 1) * n2 / ((gamma - 1) * n2 + 2)) ** k * ((gamma + 1) / (2 * gamma * n2 - (gamma - 1))) ** (1 / (gamma - 1))
        p = loss * (1 + (gamma - 1) / 2 * mm**2) ** k * (1 + (gamma - 1) / 2 * ms2) ** -k
        got = np.stack([(p - 1) / (0.5 * gamma * mm**2), beta, np.sqrt(ms2)], 1)
    good = has & np.isfinite(got).all(1) & (ms2 > 0)
    out[todo[good]] = got[good]
    return out


def cone_table(m: float, low: float, high: float, gamma: float = GAMMA, n: int = 50, unscaled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(angles, cp) between angles in radians, widened by half a degree below and two above; angles without
    a conical solution take the modified Newton value."""
    angles = np.radians(np.linspace(max(0.2, np.degrees(low) - 0.5), min(50.0, np.degrees(high) + 2.0), n))
    cp = cone_flow(np.full(n, m), angles, gamma, unscaled)[:, 0]
    return angles, np.where(np.isfinite(cp), cp, pitot_cp(m, gamma) * np.sin(angles) ** 2)


def oblique_shock_column(m, theta, gamma: float = GAMMA) -> Column:
    """struct(cp, beta, m2, p_ratio), computed by batches."""

    @F.pandas_udf("cp double, beta double, m2 double, p_ratio double")
    def run(ms: pd.Series, ts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(oblique_shock(ms.to_numpy(float), ts.to_numpy(float), gamma), columns=["cp", "beta", "m2", "p_ratio"])

    return run(m, theta)


def cone_flow_column(m, theta, gamma: float = GAMMA) -> Column:
    """struct(cp, beta, m_surface), computed by batches."""

    @F.pandas_udf("cp double, beta double, m_surface double")
    def run(ms: pd.Series, ts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(cone_flow(ms.to_numpy(float), ts.to_numpy(float), gamma), columns=["cp", "beta", "m_surface"])

    return run(m, theta)


def tangent_cone(df: DataFrame, theta: str, m: float, out: str = "cp_tangent_cone", gamma: float = GAMMA, unscaled: bool = False) -> DataFrame:
    """df with the tangent-cone pressure coefficient: a 50-entry table over the angles present (two numbers are
    collected), splined; at 0.1 degrees and below the vacuum value."""
    from .interp import spline_at, spline_moments

    least = float(np.radians(0.1))
    lo, hi = df.filter(F.col(theta) > least).agg(F.min(theta), F.max(theta)).head()
    if lo is None:
        return df.withColumn(out, F.lit(vacuum_cp(m, gamma)))
    angles, cp = cone_table(m, lo, hi, gamma, unscaled=unscaled)
    moments = spline_moments(angles, cp)

    @F.pandas_udf("double")
    def run(ts: pd.Series) -> pd.Series:
        t = ts.to_numpy(float)
        got = spline_at(angles, cp, moments, np.clip(t, angles[0], angles[-1]))
        return pd.Series(np.where(t > least, got, vacuum_cp(m, gamma)))

    return df.withColumn(out, run(theta))
