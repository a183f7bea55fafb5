"""The Pitman-Yor process in numbers: generalised Stirling numbers and Gibbs draws of table counts."""

from __future__ import annotations

import math

import numpy as np

#: Customers up to which table counts are drawn from their exact conditional.
EXACT = 256

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for c, t up to `most`: the weight of all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for c in range(most):
            stay = np.log(np.maximum(c - d * t, 0))
            out[c + 1] = out[c] + stay
            out[c + 1, 1:] = np.logaddexp(out[c + 1, 1:], out[c, :-1])
    return out


def saddle_log_stirling(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log S_d(c, t) for many customers, up to a term of c alone, by the saddle point of its generating function.

    d^t t! S / c! is the chance that t Sibuya variables add up to c; the tilt that makes c their mean is found by
    bisection on log(1 - x).  The ratio for one table more is off by some per cent where tables are few, by less with
    more of them.
    """
    c, t = c.astype(float), t.astype(float)

    def mean(log_y):
        return d * -np.expm1(log_y) * np.exp((d - 1) * log_y) / np.maximum(-np.expm1(d * log_y), 1e-300)

    low, high = np.full(len(c), -600.0 / max(1 - d, 0.05)), np.full(len(c), -1e-9)
    low = np.maximum(low, -690.0)
    for _ in range(60):
        mid = (low + high) / 2
        more = t * mean(mid) > c
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    at = (low + high) / 2
    log_x = np.log(-np.expm1(at))
    eps = 1e-4 * np.abs(at)
    slope = (mean(at + eps) - mean(at - eps)) / (2 * eps)  # in log y
    spread = np.maximum(np.abs(slope) * np.exp(log_x - at), 1e-12)  # d log y = -x / y d log x
    f = t * np.log(np.maximum(-np.expm1(d * at), 1e-300)) - c * log_x
    return f - _lgamma(t + 1) - t * math.log(d) - 0.5 * np.log(2 * math.pi * t * spread)


def draw_tables(rng: np.random.Generator, table: np.ndarray, d: float, theta: float, c: np.ndarray, t: np.ndarray, others: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A Gibbs step: new table counts of dishes with c customers (now at t tables), all else fixed.

    others: tables of the restaurant's other dishes; base: chance of the dish under the parent.  Up to EXACT customers
    the whole seating of the dish is drawn anew: P(t) ~ S_d(c, t) base^t prod_{i<t} (theta + d (others + i)).  Beyond
    that t moves by Metropolis steps under the same weights.
    """
    new = np.where(c >= 1, np.clip(t, 1, np.maximum(c, 1)), 0)
    few = np.flatnonzero((c >= 2) & (c <= EXACT))
    few = few[np.argsort(c[few], kind="stable")]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], c[few][1:] != c[few][:-1]))), len(few)) if len(few) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        k = int(c[few[a]])
        for x in range(a, b, max(1, 2_000_000 // k)):
            i = few[x : min(b, x + max(1, 2_000_000 // k))]
            weight = np.cumsum(np.log(theta + d * (others[i, None] + np.arange(k))) + np.log(base[i, None]), axis=1)
            weight += table[k, 1 : k + 1] - np.log(-np.log(rng.random((len(i), k))))
            new[i] = weight.argmax(axis=1) + 1
    many = np.flatnonzero(c > EXACT)
    if len(many):
        n, o, p, now = c[many], others[many], np.log(base[many]), new[many]
        now = np.clip(now, 1, n - 1)

        def weight(t):
            opened = _lgamma(theta / d + o + t) - _lgamma(theta / d + o) + t * math.log(d)
            return saddle_log_stirling(d, n, t) + t * p + opened

        at = weight(now)
        for _ in range(4):
            step = np.rint(rng.normal(0, 1 + 0.05 * n.astype(float) ** d)).astype(np.int64)
            to = now + step
            inside = (to >= 1) & (to < n)
            there = weight(np.where(inside, to, now))
            take = inside & (np.log(rng.random(len(n))) < there - at)
            now, at = np.where(take, to, now), np.where(take, there, at)
        new[many] = now
    return new
