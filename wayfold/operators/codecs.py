"""Encoders that search, as grouped Arrow kernels over one chunk of one run at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .grouped import per_group
from .sequence import TRACK, chunks, numbered, segments

_KEYS = (*TRACK, "run_index", "chunk_index")
_KEY_DDL = "scenario_id string, trajectory_id string, run_index int, chunk_index int"
_OUT = f"{_KEY_DDL}, start_sample_index int, end_sample_index int, primitive_type string"
_SAMPLE = ("sample_index", "timestamp_ns", "x_m", "y_m", "z_m", "heading_rad", "velocity_x_mps", "velocity_y_mps")
_INPUT = ("sample_index", "timestamp_ns", "x_m", "y_m", "z_m", "velocity_x_mps", "velocity_y_mps")


def _chunk(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"t": c["timestamp_ns"]} | {n: np.asarray(c[k], float) for n, k in (("x", "x_m"), ("y", "y_m"), ("z", "z_m"), ("vx", "velocity_x_mps"), ("vy", "velocity_y_mps"))}


def _search(valid: DataFrame, encode: Callable[[dict], list[tuple[int, int, str]]]) -> DataFrame:
    """Segments found by `encode` in each chunk, joined back to the samples at their ends."""

    def kernel(key: tuple, c: dict) -> Iterable[tuple]:
        i = c["sample_index"]
        return [(int(i[a]), int(i[b]), kind) for a, b, kind in encode(_chunk(c))]

    cut = chunks(valid)
    found = per_group(cut, _KEYS, ("sample_index",), _INPUT, kernel, _OUT)
    ends = cut.select(*TRACK, "run_index", "agent_id", *_SAMPLE)
    start = ends.select(*TRACK, "run_index", "agent_id", *[F.col(c).alias(f"start_{c}") for c in _SAMPLE])
    end = ends.select(*TRACK, "run_index", *[F.col(c).alias(f"end_{c}") for c in _SAMPLE])
    on = [*TRACK, "run_index"]
    return numbered(found.join(start, [*on, "start_sample_index"]).join(end, [*on, "end_sample_index"]))


def encode_linear(valid: DataFrame, bound: float) -> DataFrame:
    """Fewest straight segments with every replayed position within the bound."""
    return _search(valid, lambda c: kernels.linear_dp(c, bound))


def encode_hermite(valid: DataFrame, bound: float) -> DataFrame:
    """Fewest segments of any primitive within the position bound; squared velocity error breaks ties."""
    return _search(valid, lambda c: kernels.hermite_dp(c, bound))


def encode_dual_bound(valid: DataFrame, bound: float, velocity_bound: float) -> DataFrame:
    """Fewest segments within the position and the velocity bound."""
    return _search(valid, lambda c: kernels.dual_bound_dp(c, bound, velocity_bound))


def dual_bound_counters(valid: DataFrame, bound: float, velocity_bound: float) -> DataFrame:
    """How many candidate segments of each track were tried, refused (by reason) and accepted."""
    names = ("intervals", "contract", "position", "velocity", "accepted")

    def kernel(key: tuple, c: dict) -> Iterable[tuple]:
        got: dict[str, int] = {}
        kernels.candidates(_chunk(c), bound, velocity_bound, kernels.PRIMITIVES, got)
        return [tuple(got.get(k, 0) for k in names)]

    per_chunk = per_group(chunks(valid), _KEYS, ("sample_index",), _INPUT, kernel, f"{_KEY_DDL}, " + ", ".join(f"{k} long" for k in names))
    return per_chunk.groupBy(*TRACK).agg(*[F.sum(k).alias(k) for k in names])


def rdp_keyframes(valid: DataFrame, tolerance: float) -> DataFrame:
    """Samples kept by Ramer-Douglas-Peucker in each chunk."""

    def kernel(key: tuple, c: dict) -> Iterable[tuple]:
        x = _chunk(c)
        return [(int(i),) for i in c["sample_index"][kernels.rdp(x["x"], x["y"], x["z"], tolerance)]]

    cut = chunks(valid)
    kept = per_group(cut, _KEYS, ("sample_index",), _INPUT, kernel, f"{_KEY_DDL}, sample_index int")
    return cut.join(kept, [*_KEYS, "sample_index"], "left_semi")


def encode_rdp(valid: DataFrame, tolerance: float) -> DataFrame:
    return segments(rdp_keyframes(valid, tolerance))
