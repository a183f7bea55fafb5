"""Known answers: sixteen synthetic scenes, hand cases, exhaustive search."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import codecs, events, kernels, layout, metrics, replay, sequence, validate
from wayfold.sources import synthetic


@pytest.fixture(scope="module")
def scenes(spark):
    s = synthetic.samples(spark).cache()
    return s, sequence.runs(s).cache()


def kinds(segs):
    got = {r.primitive_type: r["count"] for r in segs.groupBy("primitive_type").count().collect()}
    return sum(got.values()), got.get("hold", 0), got.get("linear", 0), got.get("cubic_hermite", 0)


def test_totals(scenes):
    s, valid = scenes
    assert s.select("scenario_id").distinct().count() == 16 and s.select("trajectory_id").distinct().count() == 27
    assert s.count() == 293 and valid.count() == 291 and sequence.run_table(valid).count() == 28


def test_exact(scenes):
    segs = sequence.exact_segments(scenes[1])
    assert kinds(segs) == (263, 3, 260, 0)
    err = metrics.errors(scenes[1], segs)
    assert err.where("missing or position_error_m > 0").isEmpty() and validate.segment_chain_problems(segs).isEmpty()


def test_linear(scenes):
    segs = codecs.encode_linear(scenes[1], 0.1)
    assert kinds(segs) == (55, 1, 54, 0)
    assert validate.bound_problems(metrics.errors(scenes[1], segs), 0.1).isEmpty()


def test_hermite(scenes):
    assert kinds(codecs.encode_hermite(scenes[1], 0.1)) == (39, 1, 32, 6)


def test_dual_bound(scenes):
    segs = codecs.encode_dual_bound(scenes[1], 0.1, 1.0)
    assert kinds(segs) == (39, 1, 32, 6)
    assert validate.bound_problems(metrics.errors(scenes[1], segs), 0.1, 1.0).isEmpty()


def test_events_and_categories(scenes):
    s, valid = scenes
    found = events.events(s, valid)
    assert {r.event_type: r.events for r in events.summary(found).collect()} == {"stop": 3, "left_turn": 4, "right_turn": 5, "acceleration": 2, "braking": 2, "gap": 1}
    assert events.waypoints(valid, found).count() == 156 and validate.event_chain_problems(found).isEmpty()
    labels = {r.category: r["count"] for r in layout.categories(valid, found).groupBy("category").count().collect()}
    assert labels == {"stop_and_go": 2, "left_turn": 4, "right_turn": 5, "straight": 15, "gap_affected": 1}
    t = layout.templates(layout.routes(valid, found))
    assert t.count() == 28 and t.select("template_id").distinct().count() == 28


def test_events_survive_exact_replay(scenes):
    s, valid = scenes
    found = events.events(s, valid)
    same = metrics.preservation(metrics.matches(found, found)).collect()
    assert all(r.precision == r.recall == r.f1 == 1.0 for r in same)


def chunk(x, y=None, z=None, t=None, v=None):
    n = len(x)
    nan = np.full(n, np.nan)
    return {"t": np.arange(n) * 10**9 if t is None else np.asarray(t), "x": np.asarray(x, float), "y": np.zeros(n) if y is None else np.asarray(y, float), "z": nan if z is None else np.asarray(z, float), "vx": nan if v is None else np.asarray(v[0], float), "vy": nan if v is None else np.asarray(v[1], float)}


def test_linear_tie_goes_to_the_later_break():
    assert [b for _, b, _ in kernels.linear_dp(chunk([0, 1, 2, 3], [0, 1, 1, 0]), 0.5)] == [2, 3]


@pytest.mark.parametrize("y,bound", [((0, 0.2, -0.1, 0.4, 0), 0.15), ((0, 1, 1, 0), 0.5), ((0, 0, 0, 0), 0), ((0, 0.4, 0.8, 1.2, 1.6), 0)])
def test_linear_is_exhaustive(y, bound):
    c = chunk(range(len(y)), y)
    n = len(y)

    def fits(a, b):
        return all(math.hypot(c["x"][a] + (c["x"][b] - c["x"][a]) * (k - a) / (b - a) - c["x"][k], y[a] + (y[b] - y[a]) * (k - a) / (b - a) - y[k]) <= bound + 1e-12 for k in range(a + 1, b))

    best = None
    for size in range(n - 1):
        for inner in itertools.combinations(range(1, n - 1), size):
            path = (0, *inner, n - 1)
            if all(fits(a, b) for a, b in itertools.pairwise(path)):
                best = max(best, inner) if best and len(best) == len(inner) else best or inner
        if best is not None:
            break
    assert tuple(b for _, b, _ in kernels.linear_dp(c, bound))[:-1] == best


def test_dual_bound_is_exhaustive():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(2, 6)
        c = chunk(np.cumsum([rng.random() for _ in range(n)]), [rng.random() for _ in range(n)], v=([rng.random() * 2 for _ in range(n)], [rng.random() - 0.5 for _ in range(n)]))
        edges = kernels.candidates(c, 0.3, 1.0, kernels.PRIMITIVES)
        best = None
        stack = [(0, ())]
        while stack:
            at, path = stack.pop()
            if at == n - 1:
                key = (len(path), math.fsum(p[3] for p in path), math.fsum(p[4] for p in path), tuple(-p[1] for p in path[:-1]), tuple(p[2] for p in path))
                best = min(best, (key, path)) if best else (key, path)
                continue
            stack += [(e, (*path, (at, e, r, p, v))) for e, r, p, v in edges[at]]
        assert [(a, b) for a, b, _ in kernels.dual_bound_dp(c, 0.3, 1.0)] == [(p[0], p[1]) for p in best[1]]


def test_rdp():
    assert kernels.rdp(np.array([0, 1, 2, 3, 4.0]), np.array([0, 1, 0, 1, 0.0]), np.full(5, np.nan), 0.5).tolist() == [0, 1, 2, 3, 4]
    assert kernels.rdp(np.arange(5.0), np.zeros(5), np.full(5, np.nan), 0.0).tolist() == [0, 4]


def test_gaps_by_hand(spark):
    rows = [("s", "a", "t", i, i * 10**9, float(i), 0.0, i not in (0, 3, 4, 7)) for i in range(8)]
    s = spark.createDataFrame(rows, "scenario_id string, agent_id string, trajectory_id string, sample_index int, timestamp_ns long, x_m double, y_m double, is_valid boolean").withColumns({c: F.lit(None).cast("double") for c in ("z_m", "heading_rad", "velocity_x_mps", "velocity_y_mps", "speed_mps")})
    g = events.gaps(s, sequence.runs(s)).collect()
    assert [(r.start_time_ns, r.end_time_ns, r.invalid_samples) for r in g] == [(2 * 10**9, 5 * 10**9, 2)]
    runs = sequence.run_table(sequence.runs(s))
    assert [r.timestamp_ns for r in replay.gap_midpoints(runs).collect()] == [3_500_000_000]
    probe = spark.createDataFrame([("s", "t", t) for t in (2 * 10**9, 3 * 10**9, 5 * 10**9)], "scenario_id string, trajectory_id string, timestamp_ns long")
    assert {r.timestamp_ns: r.in_gap for r in replay.in_gap(runs, probe).collect()} == {2 * 10**9: False, 3 * 10**9: True, 5 * 10**9: False}


def test_clustering_by_hand(spark):
    path = lambda y, back=False: [{"point": i, "x_m": float(10 - i if back else i), "y_m": float(y)} for i in range(11)]
    rows = [("s", "c", "g", f"t{k}", 0, path(y, back), 10.0) for k, (y, back) in enumerate([(0, False), (1, False), (2, False), (0, True)])]
    r = spark.createDataFrame(rows, "scenario_id string, category string, signature string, trajectory_id string, run_index int, path array<struct<point:int,x_m:double,y_m:double>>, length_m double")
    config = layout.RouteConfig(points=11, start_m=9, end_m=9, mean_m=1.5, maximum_m=9)
    got = {x.trajectory_id: x.cluster for x in layout.templates(r, config).collect()}
    assert got == {"t0": 0, "t1": 0, "t2": 1, "t3": 2}
    assert {(x.a_trajectory_id, x.b_trajectory_id) for x in layout.pairs(r, config).where("compatible").collect()} == {("t0", "t1"), ("t1", "t2")}


def test_matching_and_edit_distance():
    assert kernels.greedy_pairs([(0, 10), (20, 30)], [(1, 9), (0, 10), (29, 40)]) == [(0, 1, 1.0), (1, 2, 1 / 20)]
    assert kernels.greedy_pairs([(5, 5)], [(5, 5)]) == [(0, 0, 1.0)]
    assert kernels.edit_similarity([], []) == 1.0 and kernels.edit_similarity(list("kitten"), list("sitting")) == 1 - 3 / 7


def test_sign_flip():
    assert kernels.sign_flip_p(np.array([1.0, 2.0, 3.0]), 10, 1) == (0.25, "exact", 8)
    assert kernels.sign_flip_p(np.zeros(3), 10, 1) == (1.0, "exact", 1)
    low, high = kernels.bootstrap_interval(np.arange(50.0), 2000, 7)
    assert low < 24.5 < high


def test_partitioning_changes_nothing(spark, scenes):
    s, _ = scenes
    one = sequence.runs(s.coalesce(1))
    many = sequence.runs(s.repartition(13))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    a, b = codecs.encode_linear(one, 0.1), codecs.encode_linear(many, 0.1)
    assert a.exceptAll(b.select(*a.columns)).isEmpty()
