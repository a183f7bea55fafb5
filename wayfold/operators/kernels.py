"""Searches over one sequence that no relational plan expresses, in NumPy; testable without Spark.

A chunk is a dict of arrays t (int64 ns), x, y, z (z all NaN where there is no elevation), vx, vy (NaN: unknown).
Encoders return segments (start, end, primitive) by place in the chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np

GUARD = 1e-12
PRIMITIVES = ("hold", "linear", "cubic_hermite")


def rdp(x: np.ndarray, y: np.ndarray, z: np.ndarray, tolerance: float) -> np.ndarray:
    """Places kept by Ramer-Douglas-Peucker: strictly farther than tolerance from the clamped chord; earliest on ties."""
    flat = np.isnan(z).all()
    p = np.stack([x, y] if flat else [x, y, z], axis=1)
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, rel = p[b] - p[a], p[a + 1 : b] - p[a]
        size = float(chord @ chord)
        along = np.clip(rel @ chord / size, 0.0, 1.0) if size > 0 else np.zeros(len(rel))
        far = np.sqrt(((rel - along[:, None] * chord) ** 2).sum(axis=1))
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


#: Ends of segments looked at together: bounds the arrays of a start to so many rows.
ENDS = 256


def _fractions(c: dict, s: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For start s: seconds to each end, the share u of each end's span at every sample from s to the last end, and which are interior."""
    t = c["t"]
    span = (t[ends] - t[s])[:, None]
    inside = np.arange(s, ends[-1] + 1)[None, :] < ends[:, None]
    inside[:, 0] = False
    return span / 1e9, np.where(inside, (t[s : ends[-1] + 1][None, :] - t[s]) / span, 0.0), inside


def candidates(c: dict, position_bound: float, velocity_bound: float | None, primitives: tuple[str, ...], counters: dict | None = None) -> list[list[tuple]]:
    """Per start: (end, primitive rank, sum of squared position errors, of velocity errors) of every segment within the bounds.

    With a velocity bound every known velocity inside must be represented and close; without one velocities only count.
    """
    n, out = len(c["t"]), []
    x, y, z, vx, vy = (c[k] for k in ("x", "y", "z", "vx", "vy"))
    high, known = not np.isnan(z).any(), ~np.isnan(vx) & ~np.isnan(vy)
    count = counters if counters is not None else {}
    for s in range(n - 1):
        same = (x[s:] == x[s]) & (y[s:] == y[s]) & ((z[s:] == z[s]) if high else True)
        still_to = np.logical_and.accumulate(same)
        mine = []
        for low in range(s + 1, n, ENDS):
            e = np.arange(low, min(low + ENDS, n))
            to = slice(s, e[-1] + 1)
            seconds, u, inside = _fractions(c, s, e)
            both, still = known[s] & known[e], still_to[e - s]
            for rank, kind in enumerate(primitives):
                if kind == "cubic_hermite":
                    u2, u3 = u * u, u * u * u
                    ok = both.copy()
                    axes = []
                    for p, v in ((x, vx), (y, vy)):
                        a, b, va, vb = p[s], p[e][:, None], v[s], v[e][:, None]
                        axes.append(((2 * u3 - 3 * u2 + 1) * a + (u3 - 2 * u2 + u) * seconds * va + (3 * u2 - 2 * u3) * b + (u3 - u2) * seconds * vb, ((6 * u2 - 6 * u) * (a - b)) / seconds + (3 * u2 - 4 * u + 1) * va + (3 * u2 - 2 * u) * vb))
                    (rx, rvx), (ry, rvy) = axes
                else:
                    ok = still.copy() if kind == "hold" else np.ones(len(e), bool)
                    move = 0.0 if kind == "hold" else u
                    rx, ry = (p[s] + (p[e][:, None] - p[s]) * move for p in (x, y))
                    rvx, rvy = (v[s] + (v[e][:, None] - v[s]) * u for v in (vx, vy))
                off = (rx - x[to]) ** 2 + (ry - y[to]) ** 2
                if high:
                    off = off + (z[s] + (z[e][:, None] - z[s]) * u - z[to]) ** 2
                off = np.where(inside, off, 0.0)
                near = np.isfinite(off).all(axis=1) & (np.sqrt(off.max(axis=1)) <= position_bound + GUARD)
                judged = inside & known[to][None, :] & both[:, None]
                slip = np.where(judged, (rvx - vx[to]) ** 2 + (rvy - vy[to]) ** 2, 0.0)
                smooth = np.ones(len(e), bool)
                if velocity_bound is not None:
                    missing = (inside & known[to][None, :] & ~both[:, None]).any(axis=1)
                    smooth = ~missing & (np.sqrt(slip.max(axis=1)) <= velocity_bound + GUARD)
                for name, v in (("intervals", len(e)), ("contract", (~ok).sum()), ("position", (ok & ~near).sum()), ("velocity", (ok & near & ~smooth).sum()), ("accepted", (ok & near & smooth).sum())):
                    count[name] = count.get(name, 0) + int(v)
                for k in np.flatnonzero(ok & near & smooth).tolist():
                    mine.append((low + k, rank, float(off[k].sum()), float(slip[k].sum())))
        out.append(mine)
    return out


def fewest(n: int, edges: list[list[tuple]], primitives: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """The path from 0 to n-1 with the fewest segments, then least squared position error, then velocity error, then later breaks, then primitives in order.

    Error sums are kept as exact fractions, so ties don't depend on the order of addition.
    """
    if n == 1:
        return [(0, 0, "hold")]
    best: list = [None] * n
    best[-1] = (0, Fraction(0), Fraction(0), (), (), ())
    for s in range(n - 2, -1, -1):
        fewest_left = min((best[e][0] for e, *_ in edges[s] if best[e] is not None), default=None)
        for e, rank, p2, v2 in edges[s]:
            tail = best[e]
            if tail is None or tail[0] > fewest_left:
                continue
            key = (tail[0] + 1, Fraction(p2) + tail[1], Fraction(v2) + tail[2])
            if best[s] is not None and key > best[s][:3]:
                continue
            full = (*key, (-e, *tail[3]) if e < n - 1 else (), (rank, *tail[4]), ((s, e, primitives[rank]), *tail[5]))
            if best[s] is None or full[:5] < best[s][:5]:
                best[s] = full
    if best[0] is None:
        raise ValueError("no segmentation keeps the bounds")
    return list(best[0][5])


def linear_dp(c: dict, bound: float) -> list[tuple[int, int, str]]:
    """Fewest straight segments within the position bound; later breaks on ties.  A segment that doesn't move is a hold."""
    n = len(c["t"])
    if n == 1:
        return [(0, 0, "hold")]
    edges = candidates(c | {"vx": np.full(n, np.nan), "vy": np.full(n, np.nan)}, bound, None, ("linear",))
    left = [math.inf] * n
    left[-1], nxt = 0, [0] * n
    for s in range(n - 2, -1, -1):
        for e, *_ in edges[s]:
            if left[e] + 1 <= left[s]:  # ends come in order, so the last of the best is the latest
                left[s], nxt[s] = left[e] + 1, e
    out, s = [], 0
    while s < n - 1:
        e = nxt[s]
        still = all((c[k][s : e + 1] == c[k][s]).all() or np.isnan(c[k][s]) for k in ("x", "y", "z"))
        out.append((s, e, "hold" if still else "linear"))
        s = e
    return out


def hermite_dp(c: dict, bound: float) -> list[tuple[int, int, str]]:
    return fewest(len(c["t"]), candidates(c, bound, None, PRIMITIVES), PRIMITIVES)


def dual_bound_dp(c: dict, bound: float, velocity_bound: float, counters: dict | None = None) -> list[tuple[int, int, str]]:
    return fewest(len(c["t"]), candidates(c, bound, velocity_bound, PRIMITIVES, counters), PRIMITIVES)


def greedy_pairs(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """One-to-one matches of closed intervals by greatest overlap (IoU > 0), then nearest ends, then order."""
    scored = []
    for i, (a, b) in enumerate(left):
        for j, (p, q) in enumerate(right):
            both = max(0, min(b, q) - max(a, p))
            union = (b - a) + (q - p) - both
            iou = both / union if union > 0 else float(a == p and b == q)
            if iou > 0:
                scored.append((-iou, abs(a - p), abs(b - q), i, j))
    used_i, used_j, out = set(), set(), []
    for minus, _, _, i, j in sorted(scored):
        if i not in used_i and j not in used_j:
            used_i.add(i), used_j.add(j)
            out.append((i, j, -minus))
    return sorted(out)


def complete_link(n: int, compatible: np.ndarray) -> list[int]:
    """Greedy clustering in order: each joins the first cluster all of whose members it is compatible with."""
    groups: list[list[int]] = []
    place = [0] * n
    for i in range(n):
        for g, members in enumerate(groups):
            if compatible[i, members].all():
                members.append(i)
                place[i] = g
                break
        else:
            place[i] = len(groups)
            groups.append([i])
    return place


def edit_similarity(a: list, b: list) -> float:
    """1 - edit distance / longer length; 1 for two empty sequences."""
    if not a and not b:
        return 1.0
    row = np.arange(len(b) + 1)
    for i, v in enumerate(a, 1):
        step = np.minimum(row[:-1] + np.array([v != w for w in b], int), row[1:] + 1)
        new = np.empty_like(row)
        new[0] = i
        for j in range(len(b)):
            new[j + 1] = min(step[j], new[j] + 1)
        row = new
    return 1.0 - float(row[-1]) / max(len(a), len(b))


#: Fixed values that seeded results depend on: the generator is numpy's PCG64, drawn from in blocks of so many resamples.
BLOCK = 512
#: Pairs up to which every flip is counted.
EXACT_PAIRS = 16


def _blocks(total: int) -> Iterator[int]:
    yield from [BLOCK] * (total // BLOCK) + ([total % BLOCK] if total % BLOCK else [])


def bootstrap_interval(d: np.ndarray, resamples: int, seed: int, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean: units drawn with replacement, as counts of how often each was drawn."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n, means = len(d), []
    for size in _blocks(resamples):
        drawn = rng.integers(0, n, size=(size, n))
        times = np.zeros((size, n))
        np.add.at(times, (np.arange(size)[:, None], drawn), 1)
        means.append(times @ d / n)
    tail = (1 - level) / 2
    low, high = np.quantile(np.concatenate(means), (tail, 1 - tail))
    return float(low), float(high)


def flip_sums(q: np.ndarray) -> np.ndarray:
    """Sums of whole numbers under every choice of signs, by doubling: each number comes once with either sign."""
    sums = np.zeros(1, np.int64)
    for x in q.tolist():
        sums = np.concatenate((sums + x, sums - x))
    return sums


def sign_flip_p(d: np.ndarray, resamples: int, seed: int) -> tuple[float, str, int]:
    """Two-sided sign-flip test of a paired mean: (p, method, flips).

    Differences are compared as whole millionths of the largest, so that a flip equal to what was seen counts.  Up to
    EXACT_PAIRS pairs every flip is counted; beyond, `resamples` seeded ones and the one seen.
    """
    largest = float(np.abs(d).max()) if len(d) else 0.0
    if largest == 0:
        return 1.0, "exact", 1
    q = np.rint(d / largest * 1e12).astype(np.int64)
    near = len(q)  # what rounding may take from or add to a sum
    seen = abs(int(q.sum()))
    if len(q) <= EXACT_PAIRS:
        sums = flip_sums(q)
        return float(np.mean(np.abs(sums) >= seen - near)), "exact", len(sums)
    rng, extreme = np.random.Generator(np.random.PCG64(seed)), 0
    for size in _blocks(resamples):
        plus = rng.integers(0, 2, size=(size, len(q))) == 1
        sums = 2 * (plus @ q) - q.sum()
        extreme += int(np.count_nonzero(np.abs(sums) >= seen - near))
    return (1 + extreme) / (1 + resamples), "monte_carlo", resamples
