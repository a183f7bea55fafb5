"""Tables, files, adapters, geometry, identities and the stream."""

import json
import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry, identity
from wayfold.operators import sequence, spatial, split, statistics
from wayfold.schemas import TABLES, assert_schema, violations
from wayfold.sources import canonical, providers, synthetic
from wayfold.streaming.runs import stream_runs


def test_schemas():
    assert {n: len(t.schema) for n, t in TABLES.items()} == {"scenario_manifest": 20, "coordinate_frame_metadata": 16, "agent_metadata": 14, "trajectory_samples": 18, "vector_map_elements": 14, "procedural_tape_manifest": 18, "procedural_tracks": 15, "procedural_segments": 25, "semantic_waypoints": 15, "motion_events": 15, "motion_categories": 9, "route_templates": 14, "route_template_memberships": 15}
    assert len({t.fingerprint() for t in TABLES.values()}) == 13


def test_canonical_round_trip(spark, tmp_path):
    spec = TABLES["trajectory_samples"]
    s = synthetic.samples(spark)
    assert violations(s, spec).isEmpty()
    canonical.write_parts(s, f"{tmp_path}/t", spec, max_rows=50)
    back = canonical.scan(spark, str(tmp_path), ["t"], spec)
    assert back.exceptAll(s).isEmpty() and back.count() == 293
    assert canonical.order_problems(spark, f"{tmp_path}/t", spec).isEmpty()
    with pytest.raises(Exception):
        canonical.write_parts(s, f"{tmp_path}/t", spec)
    with pytest.raises(ValueError):
        canonical.scan(spark, str(tmp_path), ["../t"], spec)
    bad = s.limit(2).withColumn("x_m", F.lit(float("nan"))).withColumn("agent_id", F.lit(" "))
    assert {r.problem for r in violations(bad, spec).collect()} == {"x_m:not_finite", "agent_id:blank"}
    assert {r.problem for r in violations(s.limit(1).unionByName(s.limit(1)), spec).collect()} == {"key:repeated"}
    with pytest.raises(ValueError):
        assert_schema(s.drop("z_m"), spec)
    with pytest.raises(ValueError):
        canonical.guarded(s, 292)
    canonical.write_jsonl(s.limit(3), f"{tmp_path}/j", ["trajectory_id", "sample_index"])
    assert all("x_m" in json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").collect())


def test_inventory(spark, tmp_path):
    (tmp_path / "a").write_text("one")
    (tmp_path / "b").write_text("two")
    saved = canonical.inventory(spark, str(tmp_path), 10, 100)
    saved = spark.createDataFrame(saved.collect(), saved.schema)
    assert saved.count() == 2 and canonical.inventory_problems(saved, canonical.inventory(spark, str(tmp_path), 10, 100)).isEmpty()
    (tmp_path / "b").write_text("TWO")
    (tmp_path / "c").write_text("new")
    (tmp_path / "a").unlink()
    assert {r.path[-1]: r.problem for r in canonical.inventory_problems(saved, canonical.inventory(spark, str(tmp_path), 10, 100)).collect()} == {"a": "missing", "b": "changed", "c": "new"}
    with pytest.raises(ValueError):
        canonical.inventory(spark, str(tmp_path), 1, 100)


def test_materialize_does_each_unit_once(spark, tmp_path):
    work = spark.range(6).withColumn("cache_key", canonical.cache_key("square", "1", "id"))
    seen = []

    def worker(df):
        seen.append(df.count())
        return df.withColumn("y", F.col("id") * F.col("id"))

    path = f"{tmp_path}/cache"
    assert canonical.materialize(spark, work.where("id < 4"), path, worker).count() == 4
    assert canonical.materialize(spark, work, path, worker).count() == 6 and seen == [4, 2]
    states = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "completed"), ("a", 3, "failed"), ("b", 1, "failed"), ("b", 2, "failed")], "unit string, attempt int, state string")
    assert {r.unit: (r.attempt, r.state) for r in canonical.latest_states(states).collect()} == {"a": (2, "completed"), "b": (2, "failed")}


def test_listings(spark):
    lines = spark.createDataFrame([('{"key":"r/x/scenario_x.parquet","size":3}',), ("2024-01-01 00:00:00   7 r/x/log_map_archive_x.json",), ("2024-01-01 00:00:00   7 other/y",), ("nonsense",), ('{"key":"r/y/scenario_y.parquet","size":1}',)], "value string")
    keys = canonical.parse_listing(lines, "r/")
    assert {(r.key, r.size) for r in keys.collect()} == {("r/x/scenario_x.parquet", 3), ("r/x/log_map_archive_x.json", 7), ("r/y/scenario_y.parquet", 1)}
    assert [tuple(r) for r in canonical.file_pairs(keys.select(F.col("key").alias("path"))).collect()] == [("x", "r/x/scenario_x.parquet", "r/x/log_map_archive_x.json")]


MOTION = "observed boolean, track_id string, object_type string, object_category int, timestep int, position_x double, position_y double, heading double, velocity_x double, velocity_y double, scenario_id string, start_timestamp long, end_timestamp long, num_timestamps int, focal_track_id string, city string"


def test_motion_source(spark):
    row = lambda tr, kind, step, x, h=0.0: (True, tr, kind, 3, step, x, 200.0, h, 3.0, 4.0, "s1", 10**9, 5 * 10**9, 5, "f", "PIT")
    rows = spark.createDataFrame([row("f", "vehicle", k, 100.0 + 2 * k) for k in range(5)] + [row(" b ", "bus", 1, 101.0, 6.383), row("b", "bus", 3, 103.0, -3.5)], MOTION)
    s = providers.motion_samples(rows)
    assert_schema(s, TABLES["trajectory_samples"])
    b = s.where("agent_id = 'agent:s1:b'").orderBy("sample_index").collect()
    assert [(r.timestamp_ns, r.x_m, r.y_m, r.speed_mps) for r in b] == [(2 * 10**9, 1.0, 0.0, 5.0), (4 * 10**9, 3.0, 0.0, 5.0)]
    assert abs(b[0].heading_rad - (6.383 - 2 * math.pi)) < 1e-12 and -math.pi <= b[1].heading_rad < math.pi
    assert {r.agent_id: (r.agent_class, r.is_focal_agent) for r in providers.motion_agents(rows).collect()} == {"agent:s1:f": ("vehicle", True), "agent:s1:b": ("vehicle", False)}
    assert providers.motion_problems(rows).isEmpty()
    bad = rows.unionByName(spark.createDataFrame([row("f", "bus", 4, 1.0)], MOTION))
    assert [r.problem for r in providers.motion_problems(bad).collect()] == ["object_type"]
    with pytest.raises(ValueError):
        providers.motion_samples(rows.drop("city"))


def test_map_source(spark, tmp_path):
    line = lambda *xs: [{"x": x, "y": y, "z": 0.0} for x, y in xs]
    lane = {"id": 1, "is_intersection": False, "lane_type": "VEHICLE", "left_lane_boundary": line((0, 1), (5, 1)), "right_lane_boundary": line((0, 0), (5, 0)), "left_neighbor_id": 9, "right_neighbor_id": 2, "predecessors": [77], "successors": [2], "left_lane_mark_type": "NONE", "right_lane_mark_type": "NONE"}
    m = {"lane_segments": {"1": lane, "2": lane | {"id": 2, "successors": [], "predecessors": [1], "right_neighbor_id": None}}, "drivable_areas": {"5": {"id": 5, "area_boundary": line((0, 0), (4, 0), (4, 3), (0, 3))}}, "pedestrian_crossings": {"6": {"id": 6, "edge1": line((0, 0), (2, 0)), "edge2": line((0, 1), (2, 1))}}}
    (tmp_path / "m.json").write_text(json.dumps(m))
    e = providers.map_elements(spark, f"{tmp_path}/m.json", "scenario:1").cache()
    assert {r.element_type: r.elements for r in providers.map_counts(e).collect()} == {"lane_centerline": 2, "lane_boundary": 4, "road_area": 1, "crosswalk": 1}
    one = e.where("map_element_id = 'lane:1'").first()
    assert (one.successor_ids, one.predecessor_ids, one.right_neighbor_id, one.left_neighbor_id, one.external_ids) == (["lane:2"], [], "lane:2", None, ["77"])
    assert e.where(~geometry.wkb_valid(F.col("geometry_wkb"))).isEmpty()
    size = e.select("map_element_id", geometry.clipped_measure(F.col("geometry_wkb"), F.lit(1.0), F.lit(-1.0), F.lit(3.0), F.lit(2.0)).alias("m"))
    assert {r.map_element_id: round(r.m, 9) for r in size.collect() if r.map_element_id in ("lane:1", "area:5", "crossing:6")} == {"lane:1": 2.0, "area:5": 4.0, "crossing:6": 1.0}


def test_centerlines_lie_between_boundaries(spark):
    import math

    point = "array<struct<x:double,y:double,z:double>>"
    left = [(0.0, 4.0, 0.0), (3.0, 4.0, 1.0), (3.0, 4.0, 1.0), (10.0, 6.0, 1.0)]
    right = [(0.0, 0.0, 0.0), (12.0, 0.0, 0.0)]
    row = spark.createDataFrame([(left, right), ([(1.0, 1.0, 1.0)] * 2, right)], f"l {point}, r {point}")
    got = row.select(providers.midline(F.col("l"), F.col("r"), 7).alias("m"), providers.sample_line(F.col("l"), 2.5).alias("s")).collect()

    def at(points, share):
        steps = [math.dist(a, b) for a, b in zip(points, points[1:])]
        left_over = share * sum(steps)
        for a, b, d in zip(points, points[1:], steps):
            if d and left_over <= d + 1e-12:
                return [p + (q - p) * left_over / d for p, q in zip(a, b)]
            left_over -= d
        return list(points[-1])

    want = [[(p + q) / 2 for p, q in zip(at(left, k / 6), at(right, k / 6))] for k in range(7)]
    assert [[round(v, 9) for v in m] for m in got[0].m] == [[round(v, 9) for v in w] for w in want]
    assert got[1].m is None and got[1].s is None  # no length
    total = sum(math.dist(a, b) for a, b in zip(left, left[1:]))
    n = math.ceil(total / 2.5) + 1
    assert [[round(v, 9) for v in m] for m in got[0].s] == [[round(v, 9) for v in at(left, k / (n - 1))] for k in range(n)]


def test_wkb():
    for kind, p in (("point", [(1.0, 2.0, None)]), ("linestring", [(0.0, 0.0, 1.0), (1.0, 1.0, 2.0)]), ("polygon", [(0, 0, None), (1, 0, None), (1, 1, None)])):
        back, points = geometry.decode_wkb(geometry.encode_wkb(kind, p))
        assert back == kind and len(points) == len(p) + (kind == "polygon")
    for bad in (b"", b"\0\1\0\0\0", geometry.encode_wkb("point", [(1.0, 2.0)])[:-1], geometry.encode_wkb("point", [(math.inf, 2.0)])):
        with pytest.raises(ValueError):
            geometry.decode_wkb(bad)


def test_identity(spark):
    assert identity.canonical_json({"b": -0.0, "a": [1, {"é": {3, 1}}]}, False) == '{"a":[1,{"é":[1,3]}],"b":0.0}'
    for bad in (float("nan"), {1: 2}, object()):
        with pytest.raises((ValueError, TypeError)):
            identity.canonical_json(bad)
    one = spark.createDataFrame([('{"b": 1, "a": 2.0}', " x ", "agent:1:2", "nope"), (None, "y", "a: ", "a:b")], "j string, p string, good string, other string")
    r = one.select(identity.canonical_json_column("j").alias("j"), identity.identifier("k", F.col("p")).alias("i"), identity.is_identifier(F.col("good")).alias("g"), identity.is_identifier(F.col("other")).alias("o")).collect()
    assert [tuple(x) for x in r] == [('{"a":2.0,"b":1}', "k:x", True, False), (None, "k:y", False, True)]
    flags = spark.createDataFrame([([[" a", "b"], ["a", "", "c"]],)], "l array<array<string>>").select(identity.merged_flags(F.col("l")).alias("f")).first().f
    assert flags == ["a", "b", "c"]


def test_split_by_groups(spark):
    tiles = spark.createDataFrame([(x, 0) for x in (0, 1, 2, 10, 11, 30)], "grid_x long, grid_y long")
    g = spatial.leakage_groups(spark, tiles, spatial.Grid(10.0, 2.0))
    assert {r.grid_x: r.group_x for r in g.collect()} == {0: 0, 1: 0, 2: 0, 10: 10, 11: 10, 30: 30}
    s = split.layout_split(g, {"development": 1, "test": 9}, 3)
    assert s.count() == 6 and split.overlap_problems(s).isEmpty()
    with pytest.raises(ValueError):
        statistics.projection(1, 0, 1.0, 1)
    assert statistics.projection(300, 25, 10.0, 7) == {"seconds": 120.0, "bytes": 84} and len(statistics.parameter_grid()) == 14


def test_stream_equals_batch(spark, tmp_path):
    s = synthetic.samples(spark)
    for k, part in enumerate(("sample_index < 5", "sample_index >= 5")):
        s.where(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(s.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_runs(stream).writeStream.format("memory").queryName("runs_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        got = spark.table("runs_out")
        want = sequence.runs(s).select(*got.columns)
        assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    finally:
        q.stop()
