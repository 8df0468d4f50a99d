"""Kernels against closed forms and plain loops."""

import numpy as np
import pytest

from gridweave.functions import gas
from gridweave.operators import boundary_layer as bl
from gridweave.operators import interp, numeric


def test_savgol_keeps_cubics_and_rejects_bad_windows():
    x = np.arange(40.0)
    y = 2 - x + 0.3 * x**2 - 0.01 * x**3
    assert np.allclose(numeric.savgol(y, 15), y)
    for window in (4, 3, 41):
        with pytest.raises(ValueError):
            numeric.savgol(y, window)


def test_savgol_equals_a_loop_of_polynomial_fits():
    y = np.random.default_rng(0).standard_normal(30)
    want = []
    for k in range(30):
        lo = min(max(k - 5, 0), 30 - 11)
        at = np.arange(lo, lo + 11)
        want.append(np.polyval(np.polyfit(at - k, y[at], 3), 0))
    assert np.allclose(numeric.savgol(y, 11), want)


def test_running_median_reflects_its_ends():
    assert numeric.running_median(np.array([9.0, 1, 2, 3, 100]), 3).tolist() == [9, 2, 2, 3, 100]


def test_adaptive_smooth_keeps_gaps_and_short_input():
    y = np.linspace(0, 1, 60)
    y[10] = np.nan
    got = numeric.adaptive_smooth(y, 0.06)
    assert np.isnan(got[10]) and np.isfinite(np.delete(got, 10)).all()
    assert numeric.adaptive_smooth(np.array([1.0, 2.0, 3.0]), 1.0).tolist() == [1, 2, 3]


def test_oblique_shock_golden_and_edges():
    cp, beta, m2, p = numeric.oblique_shock([2.0], np.radians([10.0]))[0]
    assert np.degrees(beta) == pytest.approx(39.31393, abs=1e-4)
    assert (cp, m2, p) == pytest.approx((0.2523495, 1.6405222, 1.7065786), abs=1e-6)
    edges = numeric.oblique_shock([2.0, 0.9, 2.0], [0.0, 0.1, 1.0])
    assert edges[0, 0] == 0 and np.isnan(edges[0, 1]) and edges[0, 2] == 2 and edges[0, 3] == 1
    assert edges[1, 2] == 0.9 and np.isnan(edges[2]).all()


def test_cone_flow_agrees_with_tables():
    got = numeric.cone_flow(np.array([2.0, 3.0]), np.radians([10.0, 20.0]))
    assert np.degrees(got[:, 1]) == pytest.approx([31.206, 29.61], abs=0.02)
    assert got[0, 0] == pytest.approx(0.1045, abs=5e-4)
    assert np.isnan(numeric.cone_flow(np.array([7.7]), np.radians([7.0]), unscaled=True)).all()


def test_pitot_goldens():
    assert gas.pitot_cp(2.0) == pytest.approx(1.6573003, abs=1e-7)
    assert gas.pitot_cp(7.7) == pytest.approx(1.8264030, abs=1e-7)
    assert gas.vacuum_cp(7.7) == pytest.approx(-0.0240946438, abs=1e-9)


def test_cubic_spline_is_exact_on_cubics_and_nan_outside():
    x, y = np.linspace(0, 1, 7), np.linspace(-1, 2, 9)
    f = x[:, None] ** 3 + x[:, None] * y**2 - y**3
    px, py = np.array([0.13, 0.77, 2.0]), np.array([0.4, 1.9, 0.0])
    got = interp.cubic_grid_at(x, y, f, px, py)
    assert np.allclose(got[:2], px[:2] ** 3 + px[:2] * py[:2] ** 2 - py[:2] ** 3) and np.isnan(got[2])


@pytest.mark.parametrize("n", [4, 5, 23])
def test_spline_moments_solve_their_equations(n):
    r = np.random.default_rng(n)
    x, f = np.cumsum(r.uniform(0.1, 1.0, n)), r.standard_normal((3, n))
    f[1, n // 2] = np.nan
    m, h = interp.spline_moments(x, f), np.diff(x)
    assert np.isnan(m[1]).all()
    for k in (0, 2):
        want = 6 * np.diff(np.diff(f[k]) / h)
        assert np.allclose(h[:-1] * m[k, :-2] + 2 * (h[:-1] + h[1:]) * m[k, 1:-1] + h[1:] * m[k, 2:], want)
        jump = np.diff(m[k]) / h  # third derivatives: equal over the first two and the last two pieces
        assert jump[0] == pytest.approx(jump[1]) and jump[-1] == pytest.approx(jump[-2])
    assert np.allclose(interp.spline_moments(x, f[0]), m[0])


def test_layer_of_a_linear_profile():
    s = np.linspace(0, 2, 201)
    got = bl.layer_of(s, 100 * np.minimum(s, 1.0), bl.FreeStream(100.0, 1.0), False, False)
    assert got["u_edge"] == pytest.approx(100.0)
    assert got["H"] == pytest.approx(3.0, rel=0.02) and got["delta_star"] == pytest.approx(0.5, rel=0.01)


def test_single_point_recovers_the_wall_slope():
    x, y = np.linspace(0, 1, 8), np.linspace(-0.001, 0.02, 43)
    u = np.broadcast_to(2e4 * y - 3e5 * y**2, (8, 43)).copy()
    grid = bl.Grid(x, y, {"u": u, "v": 0 * u, "T": 0 * u + 300, "p": u, "rho": u}, False, False)
    got = bl.single_point(grid, 3, 0.0, 1.0, 0.0, bl.FreeStream(300.0, 0.02), height=0.01, n=100)
    assert got["tau_w"] == pytest.approx(bl.mu(300.0) * 2e4, rel=1e-9)
    assert got["T_wall"] == pytest.approx(300.0)
    with pytest.raises(ValueError):
        bl.single_point(grid, 3, 0.0, 1.0, 0.0199, bl.FreeStream(300.0, 0.02))
