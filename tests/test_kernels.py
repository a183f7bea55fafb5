"""Searches over one sequence, against every segmentation of short ones."""

from itertools import combinations, product
from math import erf, hypot, sqrt

import numpy as np
import pytest

from wayfold.operators import kernels

NAN = float("nan")


def chunk(rng, n, high, holes):
    t = np.cumsum(rng.integers(1, 4, n)) * 100_000_000
    x, y = np.cumsum(rng.normal(0, 1, n)).round(1), np.cumsum(rng.normal(0, 1, n)).round(1)
    if n > 3:
        x[2], y[2] = x[1], y[1]  # a sample that doesn't move
    v = rng.normal(0, 3, (2, n))
    v[:, rng.random(n) < holes] = NAN
    return {"t": t, "x": x, "y": y, "z": np.cumsum(rng.normal(0, 0.2, n)) if high else np.full(n, NAN), "vx": v[0], "vy": v[1]}


def keeps(c, s, e, kind, bound, velocity_bound):
    """Whether one segment represents its interior within the bounds, sample by sample."""
    known = [not (np.isnan(a) or np.isnan(b)) for a, b in zip(c["vx"], c["vy"])]
    high = not np.isnan(c["z"]).any()
    ends = known[s] and known[e]
    if kind == "cubic_hermite" and not ends:
        return False
    if kind == "hold" and any((c[a][i] != c[a][s]) for i in range(s, e + 1) for a in ("x", "y", *(["z"] if high else []))):
        return False
    T = (c["t"][e] - c["t"][s]) / 1e9
    for i in range(s + 1, e):
        u = (c["t"][i] - c["t"][s]) / (c["t"][e] - c["t"][s])
        state = {}
        for p, v in (("x", "vx"), ("y", "vy")):
            a, b, va, vb = c[p][s], c[p][e], c[v][s], c[v][e]
            if kind == "cubic_hermite":
                state[p] = (2 * u**3 - 3 * u**2 + 1) * a + (u**3 - 2 * u**2 + u) * T * va + (3 * u**2 - 2 * u**3) * b + (u**3 - u**2) * T * vb
                state[v] = (6 * u**2 - 6 * u) * (a - b) / T + (3 * u**2 - 4 * u + 1) * va + (3 * u**2 - 2 * u) * vb
            else:
                state[p] = a if kind == "hold" else a + (b - a) * u
                state[v] = va + (vb - va) * u
        dz = c["z"][s] + (c["z"][e] - c["z"][s]) * u - c["z"][i] if high else 0.0
        if hypot(state["x"] - c["x"][i], state["y"] - c["y"][i], dz) > bound + 1e-9:
            return False
        if velocity_bound is not None and known[i] and (not ends or hypot(state["vx"] - c["vx"][i], state["vy"] - c["vy"][i]) > velocity_bound + 1e-9):
            return False
    return True


def least(c, kinds, bound, velocity_bound):
    n = len(c["t"])
    for k in range(n):
        for inner in combinations(range(1, n - 1), k):
            cuts = [0, *inner, n - 1]
            if all(any(keeps(c, a, b, kind, bound, velocity_bound) for kind in kinds) for a, b in zip(cuts, cuts[1:])):
                return k + 1
    return None


@pytest.mark.parametrize("ends", [2, 256])
def test_fewest_segments(monkeypatch, ends):
    monkeypatch.setattr(kernels, "ENDS", ends)
    rng = np.random.default_rng(5)
    for trial in range(60):
        c = chunk(rng, int(rng.integers(2, 9)), trial % 2 == 0, 0.2)
        bound, slow = float(rng.uniform(0.1, 1.5)), float(rng.uniform(1, 6))
        for got, kinds, limit in (
            (kernels.linear_dp(c, bound), ("linear",), None), (kernels.hermite_dp(c, bound), kernels.PRIMITIVES, None), (kernels.dual_bound_dp(c, bound, slow), kernels.PRIMITIVES, slow),
        ):
            assert len(got) == least(c, kinds, bound, limit)
            assert got[0][0] == 0 and got[-1][1] == len(c["t"]) - 1 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
            assert all(keeps(c, s, e, kind, bound, limit) for s, e, kind in got)


def test_sign_flips_against_all_signs():
    rng = np.random.default_rng(3)
    for n in range(1, 11):
        d = rng.normal(0.3, 1, n).round(2)
        d[0] = -d[-1]
        seen = abs(d.sum())
        want = np.mean([abs(sum(s * x for s, x in zip(signs, d))) >= seen - 1e-9 for signs in product((-1, 1), repeat=n)])
        p, how, flips = kernels.sign_flip_p(d, 500, 1)
        assert (how, flips, p) == (("exact", 2**n, pytest.approx(want)) if d.any() else ("exact", 1, 1.0)) or (p, how, flips) == (pytest.approx(want), "exact", 2**n)


def test_resampling_of_many_units():
    rng = np.random.default_rng(4)
    d = rng.normal(0.2, 1, 400)
    low, high = kernels.bootstrap_interval(d, 4000, 7)
    error = d.std() / sqrt(len(d))
    assert low == pytest.approx(d.mean() - 1.96 * error, abs=0.15 * error) and high == pytest.approx(d.mean() + 1.96 * error, abs=0.15 * error)
    p, how, flips = kernels.sign_flip_p(d, 4000, 7)
    normal = 1 - erf(abs(d.sum()) / sqrt((d * d).sum()) / sqrt(2))
    assert how == "monte_carlo" and flips == 4000 and abs(p - normal) < 0.01
