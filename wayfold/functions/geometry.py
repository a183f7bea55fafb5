"""Little-endian ISO WKB, box clips and measures of small geometries, as Arrow functions over whole columns."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CODES = {"point": 1, "linestring": 2, "polygon": 3}


def encode_wkb(kind: str, points: list[tuple[float, ...]]) -> bytes:
    """WKB of a point, line or ring (closed if it isn't); three-dimensional if every point has a z."""
    high = all(len(p) > 2 and p[2] is not None for p in points)
    if kind == "polygon" and points[0] != points[-1]:
        points = [*points, points[0]]
    head = struct.pack("<BI", 1, _CODES[kind] + 1000 * high) + {"point": b"", "linestring": struct.pack("<I", len(points)), "polygon": struct.pack("<II", 1, len(points))}[kind]
    return head + np.array([p[: 2 + high] for p in points], "<f8").tobytes()


def decode_wkb(wkb: bytes) -> tuple[str, np.ndarray]:
    """(kind, points) of what encode_wkb writes; anything malformed is refused."""
    if len(wkb) < 5 or wkb[0] != 1:
        raise ValueError("not little-endian WKB")
    (code,) = struct.unpack_from("<I", wkb, 1)
    kind, dims = {v: k for k, v in _CODES.items()}.get(code % 1000), 3 if code >= 1000 else 2
    if kind is None or code // 1000 > 1:
        raise ValueError(f"unsupported geometry {code}")
    at, n = 5, 1
    if kind == "polygon":
        rings, n = struct.unpack_from("<II", wkb, 5)
        at = 13
        if rings != 1:
            raise ValueError("polygons have one ring here")
    elif kind == "linestring":
        (n,) = struct.unpack_from("<I", wkb, 5)
        at = 9
    if len(wkb) != at + 8 * dims * n:
        raise ValueError("length doesn't match the count")
    points = np.frombuffer(wkb, "<f8", offset=at).reshape(n, dims)
    if not np.isfinite(points).all():
        raise ValueError("coordinates must be finite")
    return kind, points


def _points(v) -> list[tuple[float, ...]]:
    return [(p["x"], p["y"], p.get("z")) for p in v]


def _wkb(kind: str, column: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def make(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else encode_wkb(kind, _points(v)))

    return make(column)


def wkb_linestring(points: Column) -> Column:
    """WKB of an array of structs x, y, z."""
    return _wkb("linestring", points)


def wkb_polygon(points: Column) -> Column:
    return _wkb("polygon", points)


def wkb_valid(column: Column) -> Column:
    """Whether a binary column decodes, line strings have two points and rings four with equal ends."""

    @F.pandas_udf(T.BooleanType())
    def test(s: pd.Series) -> pd.Series:
        def one(w):
            try:
                kind, p = decode_wkb(bytes(w))
            except (ValueError, TypeError, struct.error):
                return False
            return {"point": True, "linestring": len(p) >= 2, "polygon": len(p) >= 4 and bool((p[0] == p[-1]).all())}[kind]

        return s.map(one)

    return test(column)


def measure(points: np.ndarray, kind: str) -> float:
    """Length of a line, area of a ring, 0 for a point."""
    if kind == "linestring":
        return float(np.hypot(*(points[1:, :2] - points[:-1, :2]).T).sum())
    if kind == "polygon":
        x, y = points[:, 0], points[:, 1]
        return float(abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2)
    return 0.0


def clip_ring(points: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Closed ring cut to a box (min_x, min_y, max_x, max_y), edge by edge; empty if nothing is left."""
    ring = [tuple(p) for p in points[:-1, :2]]
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ina, inb = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                u = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + u * (b[0] - a[0]), a[1] + u * (b[1] - a[1])))
        ring = out
        if not ring:
            return np.zeros((0, 2))
    return np.array([*ring, ring[0]])


def clipped_measure(wkb: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Length or area of a geometry inside a box; for a point 1 if it is inside."""

    @F.pandas_udf(T.DoubleType())
    def run(w: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        def one(blob, *box):
            kind, p = decode_wkb(bytes(blob))
            if kind == "point":
                return float(box[0] <= p[0, 0] <= box[2] and box[1] <= p[0, 1] <= box[3])
            if kind == "polygon":
                ring = clip_ring(p, box)
                return measure(ring, kind) if len(ring) > 3 else 0.0
            total = 0.0
            for q, r in zip(p[:-1, :2], p[1:, :2]):
                low, high = 0.0, 1.0
                for k in (0, 1):
                    step = r[k] - q[k]
                    if step == 0:
                        if not box[k] <= q[k] <= box[k + 2]:
                            low = 2.0
                    else:
                        u, v = sorted(((box[k] - q[k]) / step, (box[k + 2] - q[k]) / step))
                        low, high = max(low, u), min(high, v)
                total += max(0.0, high - low) * float(np.hypot(*(r - q)))
            return total

        return pd.Series([one(*r) for r in zip(w, a, b, c, d)], dtype=float)

    return run(wkb, min_x, min_y, max_x, max_y)
