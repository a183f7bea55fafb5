"""Artifacts, selection, validation and analysis on cases with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.operators import analysis, selection, spatial, statistics, validate
from wayfold.operators.split import numbered
from wayfold.sources import artifacts
from wayfold.schemas import TABLES


def test_quantiles_narrow_down(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = [*rng.normal(size=4000).round(2).tolist(), *[7.0] * 3000, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = statistics.quantiles(df, "v", (0.0, 0.25, 0.5, 0.95, 1.0), most=50)
    known = np.array([v for v in values if v is not None])
    assert got == {q: pytest.approx(float(np.quantile(known, q))) for q in got}
    assert statistics.quantiles(df.limit(0), "v", (0.5,)) == {0.5: None}


def test_numbering_over_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 1013).alias("k"), "id")
    got = sorted((r.place, r.k, r.id) for r in numbered(df, "place", "k", "id").collect())
    assert [g[0] for g in got] == list(range(1, 5001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert numbered(df.limit(0), "place", "k").count() == 0


def test_ranks_and_conditions(spark):
    units = spark.createDataFrame([("a", "x", 1, True), ("b", "x", 2, True), ("c", "y", 1, True), ("c", "y", 3, True), ("a", "z", 1, True)], "unit string, role string, rank int, included boolean")
    assert {(r.role, r.problem) for r in selection.rank_problems(units).collect()} == {("y", "repeated_unit"), (None, "shared_unit")}
    picked = spark.createDataFrame([("p", "d", 1.0, "first", "f1"), ("p", "d", 1.0, "first", "f2"), ("t", "d", 1.0, "first", "f1")], "role string, dimension string, target double, priority string, family string")
    expected = spark.createDataFrame([("d", 1.0, "first", ["f2", "f1"])], "dimension string, target double, priority string, families array<string>")
    assert [(r.role, r.got) for r in selection.condition_problems(picked, expected).collect()] == [("t", ["f1"])]


def test_claims_and_presence(spark):
    row = spark.createDataFrame([(0.05, False), (0.051, False), (None, False), (0.9, True)], "p double, i boolean")
    assert [r[0] for r in row.select(analysis.claim_label(F.col("p"), F.col("i"))).collect()] == ["significant_result", "descriptive_tendency", "descriptive_tendency", "invariant_guarantee"]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(1.5,)], "p double").select(analysis.claim_label(F.col("p"), F.lit(False))).collect()
    n = spark.createDataFrame([(0, 0, 0), (0, 2, 0), (4, 4, 2), (3, 0, 0)], "s long, r long, m long")
    assert [r[0] for r in n.select(analysis.presence_aware(F.col("s"), F.col("r"), F.col("m"))).collect()] == [1.0, 0.0, 0.5, 0.0]
    assert analysis.parameter_grid(spark).count() == 39


def test_validation_tables(spark):
    rows = spark.createDataFrame([("exact", 0.0, 0.0), ("exact", 0.1, 0.0), ("bounded", 0.2, 0.0), ("other", 9.0, 9.0)], "configuration string, maximum_error_m double, v double")
    assert [(r.configuration, r.problem) for r in validate.metric_problems(rows, ("exact",), {"bounded": ("maximum_error_m", 0.1)}).orderBy("problem").collect()] == [("exact", "exact_error"), ("bounded", "maximum_error_m_bound")]
    a, b = (spark.createDataFrame(x, "unit string, split string") for x in ([("u", "test"), ("v", "test")], [("u", "test"), ("v", "pilot")]))
    assert sorted(map(tuple, validate.split_problems(a, b, "unit").collect())) == [("v", "pilot", "right"), ("v", "test", "left")]
    x = spark.createDataFrame([("trajectory", "b", "late"), ("scenario", "z", "early"), ("trajectory", "a", "late"), ("trajectory", "a", "early")], "unit_type string, unit_id string, reason string")
    assert [tuple(r) for r in validate.in_canonical_order(x, ("scenario", "trajectory"), ("early", "late")).collect()] == [("scenario", "z", "early"), ("trajectory", "a", "early"), ("trajectory", "a", "late"), ("trajectory", "b", "late")]


def test_map_tiles(spark):
    pieces = spark.createDataFrame([("m", 1.0, 5.0, 25.0, 5.0)], "map_element_id string, x0 double, y0 double, x1 double, y1 double")
    occupied = spark.createDataFrame([(0, 0), (1, 0), (9, 9)], "grid_x long, grid_y long")
    assert sorted(tuple(r) for r in spatial.map_tiles(pieces, occupied).collect()) == [("m", 0, 0, 9_000_000), ("m", 1, 0, 10_000_000)]


def test_runs_and_manifests(spark, tmp_path):
    spec = TABLES["coordinate_frame_metadata"]
    df = spark.createDataFrame([], spec.schema)
    made = artifacts.write_tables(spark, str(tmp_path), "r1", {spec.name: df}, {"tracks": 3})
    assert made["tables"][0]["row_count"] == 0 and made["summary"] == {"tracks": 3}
    assert set(artifacts.load_tables(spark, str(tmp_path), "r1")) == {spec.name}
    with pytest.raises(FileExistsError):
        artifacts.run_directory(spark, str(tmp_path), "r1")
    artifacts.run_directory(spark, str(tmp_path), "r2")
    assert artifacts.prune(spark, str(tmp_path)) == ["r2"] and artifacts.prune(spark, str(tmp_path), dry_run=False) == ["r2"]
    assert artifacts.incomplete(spark, str(tmp_path)) == []
    manifest = json.loads((tmp_path / "r1/manifest.json").read_text())
    manifest["tables"][0]["row_count"] = 5
    (tmp_path / "r1/manifest.json").write_text(json.dumps(manifest))
    (tmp_path / "r1/.manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        artifacts.load_tables(spark, str(tmp_path), "r1")
    sizes = artifacts.written_sizes(spark, str(tmp_path), "sizes", {"raw": spark.range(5000), "tenth": spark.range(500)}).collect()
    assert {r.representation: r.row_count for r in sizes} == {"raw": 5000, "tenth": 500} and 0 < {r.representation: r.byte_ratio for r in sizes}["tenth"] < 1
    artifacts.write_results({"motion": spark.createDataFrame([("test", 1), ("pilot", 2)], "cohort_role string, v int")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/motion")).where("cohort_role = 'pilot'").first().v == 2


def test_configuration_and_listing(spark):
    assert artifacts.load_config("a = 1\n[b]\nc = 2", {"b.c": 5}, {"a": 0, "b": {"c": 0, "d": 7}}) == {"a": 1, "b": {"c": 5, "d": 7}}
    with pytest.raises(KeyError):
        artifacts.load_config("z = 1", defaults={"a": 0})
    page = '<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><IsTruncated>{}</IsTruncated>{}<Contents><Key>r/{}</Key><Size>3</Size></Contents></ListBucketResult>'
    assert artifacts.parse_listing_page(page.format("true", "<NextContinuationToken>t</NextContinuationToken>", "a"), "r/") == ([("r/a", 3)], "t")
    assert artifacts.parse_listing_page(page.format("false", "", "b"), "r/")[1] is None
    for bad in (page.format("true", "", "a"), page.format("false", "", "a").replace("r/a", "x/a")):
        with pytest.raises(ValueError):
            artifacts.parse_listing_page(bad, "r/")
    pages = spark.createDataFrame([(0, page.format("false", "", "a")), (1, page.format("false", "", "b")), (2, page.format("false", "", "a"))], "page int, xml string")
    assert sorted(map(tuple, artifacts.listing(spark, pages, "r/").collect())) == [("r/a", 3), ("r/b", 3)]


def test_semantic_tables(spark, tmp_path):
    from wayfold.operators import events, layout, semantic
    from wayfold.plans import registry
    from wayfold.schemas import violations
    from wayfold.sources import bindings

    from .conftest import SF

    samples = bindings.samples(spark, SF)
    valid, found = registry._valid(spark, SF).cache(), registry._events(spark, SF).cache()
    points = events.waypoints(valid, found).cache()
    agents = samples.select("scenario_id", "trajectory_id", "agent_id", F.lit("vehicle").alias("agent_class")).distinct()
    stops = found.where("event_type = 'stop'")
    routes = layout.routes(valid, stops, registry.ROUTES)
    members = layout.templates(routes, registry.ROUTES)
    categories, templates, memberships = semantic.route_tables(members, routes, agents, "uniform-5")
    tables = {
        "semantic_waypoints": semantic.waypoint_table(points, valid, "uniform-5"), "motion_events": semantic.event_table(found, points, "uniform-5"),
        "motion_categories": categories, "route_templates": templates, "route_template_memberships": memberships,
    }
    made = artifacts.write_tables(spark, str(tmp_path), "semantic", tables)
    got = artifacts.load_tables(spark, str(tmp_path), "semantic")
    rows = {t["schema"]: t["row_count"] for t in made["tables"]}
    assert rows["semantic_waypoints"] == points.count() and rows["motion_events"] == found.count() and rows["route_template_memberships"] == members.count()
    for name, df in got.items():
        assert violations(df, TABLES[name]).isEmpty()
    events_, ways = got["motion_events"], got["semantic_waypoints"]
    for end in ("start", "anchor", "end"):  # each event's waypoints are there, at its times
        j = events_.join(ways, (events_[f"{end}_waypoint_id"] == ways["waypoint_id"]) & (events_["procedural_track_id"] == ways["procedural_track_id"]))
        assert j.where(F.col(f"{end}_time_ns") == F.col("timestamp_ns")).count() == events_.count()
    assert validate.membership_problems(got["route_templates"], got["route_template_memberships"].withColumnRenamed("procedural_track_id", "member_id").withColumnRenamed("membership_index", "member_index")).isEmpty()
    lead = got["route_template_memberships"].where("membership_index = 0")
    assert lead.where("mean_path_error_m <> 0 or start_distance_m <> 0 or path_length_ratio <> 1").isEmpty() and lead.count() == got["route_templates"].count()
    total = got["motion_categories"].agg(F.sum("template_count")).first()[0]
    assert total == got["route_templates"].count()
