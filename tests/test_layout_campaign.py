"""Feasibility, tapes and campaigns on hand-made or synthetic input."""

import pytest
from pyspark.sql import functions as F

from wayfold.operators import campaign, codecs, feasibility, sequence, statistics, tape
from wayfold.schemas import TABLES, assert_schema, violations
from wayfold.sources import synthetic

PATH = "scenario_id string, track string, path array<struct<x_m:double,y_m:double,z_m:double>>"


def line(track, *points, z=None):
    return ("s", track, [(float(x), float(y), z) for x, y in points])


def test_crossings(spark):
    paths = spark.createDataFrame([line("a", (-10, 0), (0, 0), (10, 0)), line("b", (0.3, -10), (0.3, 10)), line("c", (5.6, -10), (5.6, 10), z=4.0), line("d", (-10, 0), (-10, 9))], PATH)
    got = {(r.x, r.y): r.reading for r in feasibility.crossings(paths).collect()}
    assert got == {(0, 0): "geometric_only_ambiguous", (6, 0): "geometric_only_ambiguous"}
    high = paths.where("track <> 'a'").unionByName(spark.createDataFrame([line("a", (-10, 0), (10, 0), z=0.0)], PATH))
    assert {(r.x, r.y): r.reading for r in feasibility.crossings(high).collect()}[6, 0] == "elevation_separated"
    turning = paths.unionByName(spark.createDataFrame([line("e", (1, 1), (1, 2), (3, 2))], PATH))
    assert {(r.x, r.y): r.reading for r in feasibility.crossings(turning).collect()}[0, 0] == "observed_transition_supported"


def test_shared_space_and_groups(spark):
    rows = [line("a", (0, 0), (5, 0), (11, 0)), line("b", (0.5, 0.5), (5.5, 0.5), (11, 0.5)), line("c", (11, 1), (5, 1), (0, 1)), line("d", (0, 0), (0, 50), (0, 99))]
    paths = spark.createDataFrame(rows, PATH)
    pairs = feasibility.agreeing_pairs(paths)
    assert {(r.a, r.b): r.relation for r in pairs.collect()} == {("a", "b"): "directional", ("a", "c"): "opposing", ("b", "c"): "opposing"}
    g = feasibility.support_groups(spark, paths, pairs).first()
    assert (g.support_groups, g.tracks, g.fragmentation) == (2, 4, 0.5)
    e = feasibility.shared_ends(paths).first()
    assert (e.repeated_starts, e.splits, e.repeated_ends, e.merges) == (1, 1, 1, 0)
    c = feasibility.shared_cells(paths).first()
    assert (c.occupied_cells, c.repeated_cells, c.supported_tracks) == (5, 3, 4)


def test_lanes_and_frames(spark):
    seq = spark.createDataFrame([("s", "t", 0, ["a", "b", "c"])], "scenario_id string, trajectory_id string, run_index int, lanes array<string>")
    elements = spark.createDataFrame([("a", ["b"], []), ("b", [], []), ("c", [], ["x"])], "map_element_id string, successor_ids array<string>, predecessor_ids array<string>")
    r = feasibility.lane_transitions(seq, elements).first()
    assert (r.transitions, r.consistent) == (2, 1)
    points = spark.createDataFrame([(1, "s", 0.0), (2, "s", 3.0), (3, "s", 0.1)], "id long, scenario_id string, heading double")
    near = spark.createDataFrame([(1, "a", 0.5), (2, "a", 9.0)], "id long, lane_id string, distance_m double")
    lanes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 0.0)], "lane_id string, x0 double, y0 double, x1 double, y1 double")
    a = feasibility.lane_agreement(points, lanes, near, 1.0, 0.3).first()
    assert (a.points, a.near_points, a.compared, a.aligned) == (3, 1, 2, 1)
    f = spark.createDataFrame([("EPSG:1", "p", [1.0]), ("EPSG:1", "p", None)], "source_crs string, parent_frame_id string, transform_to_parent_4x4 array<double>")
    assert not feasibility.comparable_frames(f).first().comparable and feasibility.comparable_frames(f.limit(1)).first().comparable


@pytest.fixture(scope="module")
def taped(spark):
    s = synthetic.samples(spark)
    v = sequence.runs(s)
    segs = sequence.exact_segments(v)
    agents = s.select("scenario_id", "agent_id", F.lit("vehicle").alias("agent_class")).distinct()
    tracks = tape.track_table(s, segs, agents, "exact")
    return tape.tape_table(tracks, "exact", "1", "synthetic", "none"), tracks, tape.segment_table(segs, "exact")


def test_tape_tables(taped):
    for df, name in zip(taped, ("procedural_tape_manifest", "procedural_tracks", "procedural_segments")):
        assert_schema(df, TABLES[name])
        assert violations(df, TABLES[name]).isEmpty()
    assert taped[0].count() == 16 and tape.tape_problems(*taped).isEmpty()
    lost = tape.tape_problems(taped[0], taped[1].where("run_count = 1"), taped[2])
    assert {(r.table, r.problem) for r in lost.collect()} == {("tapes", "totals"), ("segments", "no track")}


def test_package(taped):
    tapes, tracks, segments = taped
    p = tape.Package(tapes=tapes, tracks=tracks, segments=segments)
    one = tracks.where("trajectory_id = 'trajectory:synthetic:missing_gap:0'").first()
    got = p.replay(one.procedural_track_id, [0, 1_500_000_000, 4_500_000_000, 10**11]).orderBy("timestamp_ns").collect()
    assert [r.replay_x_m for r in got] == [0.0, 1.5, None, None]
    assert p.tape(scenario_id=one.scenario_id).count() == 1 and p.track(one.procedural_track_id).first().run_count == 2
    assert [r.segment_index for r in p.segments(one.procedural_track_id).collect()] == [0, 1, 2, 0, 1, 2, 3]
    with pytest.raises(ValueError):
        p.tape()


def test_campaign(spark):
    v = sequence.runs(synthetic.samples(spark))
    rows = campaign.execute(v, {"exact": sequence.exact_segments, "linear": lambda x: codecs.encode_linear(x, 0.1)})
    per = campaign.ratios(rows, sequence.exact_segments(v), v)
    totals = {r.configuration: r for r in campaign.configuration_totals(per).collect()}
    assert totals["exact"].segment_ratio == 1.0 and totals["linear"].segments == 55 and totals["linear"].maximum_error_m <= 0.1 + 1e-9
    c = campaign.compare(per, "segments", {"exact": 0, "linear": 1}, 200)
    r = c.first()
    assert r.wins + r.ties == 16 and r.losses == 0 and r.adjusted == r.p_value and r.rank_biserial == 1.0
    assert campaign.multiplicity(c).first().tests == 1
    assert campaign.consistency(c, c).first().same_sign
    order = campaign.execution_order(spark.createDataFrame([("b", 1), ("a", 0)], "configuration string, place int"), spark.createDataFrame([("u", 2), ("v", 1)], "unit string, rank int"))
    assert [(r.configuration, r.unit) for r in order.orderBy("step").collect()] == [("a", "v"), ("a", "u"), ("b", "v"), ("b", "u")]


def test_effects_without_variance(spark):
    d = spark.createDataFrame([("a", "b", i, 1.0) for i in range(4)] + [("a", "c", 0, 0.0)], "method_a string, method_b string, unit int, difference double")
    got = {r.method_b: r for r in statistics.effects(d).collect()}
    assert got["b"].effect is None and got["b"].wins == 4 and got["c"].ties == 1
    assert [r.method_b for r in statistics.rank_biserial(d).collect()] == ["b"]
