"""Canonical tables of what motion means: waypoints and events of tracks, route templates, their members and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import wkb_linestring
from ..schemas import TABLES
from .events import _ROLES, waypoint_ids
from .layout import RUN
from .sequence import TRACK
from .tape import tape_id, track_id


def _as(df: DataFrame, name: str) -> DataFrame:
    """The columns of a canonical table, of inferred origin and without quality flags."""
    df = df.withColumns({"origin_type": F.lit("inferred"), "quality_flags": F.array().cast("array<string>")})
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].schema])


def _owner(df: DataFrame, codec: str) -> DataFrame:
    return df.withColumns({"tape_id": tape_id(codec), "procedural_track_id": track_id(codec)})


def waypoint_table(points: DataFrame, valid: DataFrame, codec: str) -> DataFrame:
    """semantic_waypoints of events.waypoints, with the state of their source samples."""
    state = valid.select(*TRACK, "sample_index", "x_m", "y_m", "z_m", "heading_rad", "speed_mps")
    p = _owner(waypoint_ids(points, codec), codec).join(state, [*TRACK, "sample_index"])
    p = p.withColumns({"source_sample_index": F.col("sample_index"), "related_event_ids": F.array_compact(F.array("event_id"))})
    return _as(p, "semantic_waypoints")


def event_table(found: DataFrame, points: DataFrame, codec: str) -> DataFrame:
    """motion_events, each with the waypoints where it starts, is anchored and ends."""
    named = waypoint_ids(points, codec).where("event_id is not null")
    # at most three waypoints an event
    at = named.groupBy(*TRACK, "event_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("#", "waypoint_role", F.col("sample_index").cast("string")), "waypoint_id"))).alias("at"))
    roles = F.create_map(*[x for k, v in _ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("event_type")]
    e = _owner(found.join(at, [*TRACK, "event_id"]), codec)
    for i, n in enumerate(("start", "anchor", "end")):
        e = e.withColumn(f"{n}_waypoint_id", F.col("at")[F.concat_ws("#", roles[i], F.col(f"{n}_index").cast("string"))])
    e = e.withColumns({"magnitude_value": F.col("magnitude"), "semantic_attributes_json": F.to_json(F.struct("ordinal", "run_index"))})
    return _as(e, "motion_events")


def category_id(label: Column, agent_class: Column, signature: Column) -> Column:
    return F.concat(F.lit("category-"), F.substring(F.sha2(F.concat_ws("|", label, agent_class, signature), 256), 1, 32))


def route_tables(members: DataFrame, routes: DataFrame, agents: DataFrame, codec: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(motion_categories, route_templates, route_template_memberships).

    members: layout.templates; routes: layout.routes with duration_ns; agents: TRACK, agent_id, agent_class.  The
    representative is member 0, the others follow in key order.
    """
    signature = F.to_json(F.struct(F.filter(F.split("signature", ">"), lambda x: x != "").alias("events")))
    r = routes.select(*RUN, "path", "length_m", "duration_ns")
    m = members.join(r, list(RUN)).join(agents, list(TRACK)).withColumn("event_signature_json", signature)
    m = _owner(m, codec).withColumn("category_id", category_id(F.col("category"), F.col("agent_class"), F.col("signature")))
    lead = m.where("is_representative")
    rep = lead.select("template_id", F.col("path").alias("rep_path"), F.col("length_m").alias("rep_length_m"), F.col("duration_ns").alias("rep_duration_ns"))
    order = F.array_position(F.col("order"), F.struct((~F.col("is_representative")).alias("a"), "trajectory_id", "run_index")) - 1
    listed = m.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_representative")).alias("a"), "trajectory_id", "run_index"))).alias("order"))  # a template is one complete-link group
    gap = lambda i: F.sqrt(sum((F.element_at("path", i)[c] - F.element_at("rep_path", i)[c]) * (F.element_at("path", i)[c] - F.element_at("rep_path", i)[c]) for c in ("x_m", "y_m")))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    members_out = m.join(rep, "template_id").join(listed, "template_id").withColumns({
        "membership_index": order, "mean_path_error_m": F.col("mean_error_m"), "maximum_path_error_m": F.col("maximum_error_m"), "start_distance_m": gap(1), "end_distance_m": gap(-1),
        "path_length_ratio": share("length_m", "rep_length_m"), "duration_ratio": share("duration_ns", "rep_duration_ns"), "map_route_signature_json": F.lit(None).cast("string"),
    })
    line = F.transform("path", lambda p: F.struct(p["x_m"].alias("x"), p["y_m"].alias("y"), F.lit(None).cast("double").alias("z")))
    templates = lead.withColumns({
        "coordinate_frame_id": F.concat(F.lit("frame:"), "scenario_id"), "representative_track_id": F.col("procedural_track_id"), "geometry_type": F.lit("linestring"), "geometry_wkb": wkb_linestring(line),
        "path_length_m": F.col("length_m"), "semantic_attributes_json": F.to_json(F.struct("category", "agent_class")),
    })
    of = m.groupBy("category_id").agg(F.count_distinct("procedural_track_id").alias("track_count"), F.count_distinct("template_id").alias("template_count"), F.min("event_signature_json").alias("event_signature_json"), F.min("category").alias("category_label"), F.min("agent_class").alias("agent_class"))
    # the category's example is the representative of its largest template, ties by id
    best = lead.groupBy("category_id").agg(F.min_by("template_id", F.struct((-F.col("member_count")).alias("n"), "template_id")).alias("representative_template_id"))
    return _as(of.join(best, "category_id"), "motion_categories"), _as(templates, "route_templates"), _as(members_out, "route_template_memberships")
