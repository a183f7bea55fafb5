"""Structural checks and the eligibility cascade, as tables of problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import AGENT_CLASSES, MAP_ELEMENTS, rank_of
from .sequence import TRACK, summaries

#: Reasons in order of precedence (fixed values).
REASONS = ("index_gap", "time_disorder", "unknown_agent", "duplicate_agent", "unsupported_class", "too_few_valid_samples", "too_short")


def foreign_key_problems(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Keys of child rows without a parent; null keys don't count."""
    keys = child.select(*on).distinct().na.drop()
    return keys.join(parent.select(*on).distinct(), on, "left_anti")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with how often: set equality of two tables."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def exclusions(samples: DataFrame, agents: DataFrame, least_valid: int = 10, least_ns: int = 1_000_000_000, classes: tuple[str, ...] = AGENT_CLASSES) -> DataFrame:
    """Trajectories that may not be used, each with the first reason that applies.

    agents: (scenario_id, agent_id, agent_class).
    """
    who = samples.select(*TRACK, "agent_id").distinct()
    known = agents.groupBy("scenario_id", "agent_id").agg(F.count("*").alias("rows"), F.min("agent_class").alias("agent_class"))
    s = summaries(samples).join(who, list(TRACK)).join(known, ["scenario_id", "agent_id"], "left")
    tests = {
        "index_gap": F.col("index_gap"), "time_disorder": F.col("time_disorder"), "unknown_agent": F.col("rows").isNull(), "duplicate_agent": F.col("rows") > 1,
        "unsupported_class": ~F.col("agent_class").isin(*classes), "too_few_valid_samples": F.col("valid_count") < least_valid,
        "too_short": F.coalesce(F.col("last_valid_ns") - F.col("first_valid_ns") < least_ns, F.lit(True)),
    }
    reason = None
    for name in REASONS:
        reason = F.when(tests[name], name) if reason is None else reason.when(tests[name], name)
    return s.withColumn("reason", reason).where("reason is not null").select(*TRACK, "agent_id", "reason")


def cascade(excluded: DataFrame, all_tracks: DataFrame) -> DataFrame:
    """Scenarios all of whose tracks are excluded are excluded too."""
    t = all_tracks.join(excluded.select(*TRACK).withColumn("out", F.lit(1)), list(TRACK), "left")
    return t.groupBy("scenario_id").agg(F.count("*").alias("tracks"), F.count("out").alias("excluded")).where("tracks = excluded")


def segment_chain_problems(segs: DataFrame) -> DataFrame:
    """Segments that don't continue where the one before in their run ended, or are out of number.

    Where a run's elevation comes or goes the next segment starts at the next sample.
    """
    w = Window.partitionBy(*TRACK, "run_index").orderBy("segment_index")
    prev = lambda c: F.lag(c).over(w)
    joined = (F.col("start_sample_index") == prev("end_sample_index")) | ((F.col("start_sample_index") == prev("end_sample_index") + 1) & (F.col("start_z_m").isNull() != prev("end_z_m").isNull()))
    s = segs.withColumn("problem", F.when(F.col("segment_index") != F.row_number().over(w) - 1, "number").when(~joined, "break").when(F.col("end_time_ns") < F.col("start_time_ns"), "time").when(F.col("start_z_m").isNull() != F.col("end_z_m").isNull(), "elevation"))
    return s.where("problem is not null").select(*TRACK, "run_index", "segment_index", "problem")


def bound_problems(errors: DataFrame, bound: float, velocity_bound: float | None = None, slack: float = 1e-9) -> DataFrame:
    """Samples whose replay is off by more than a codec promises, or missing."""
    bad = F.col("missing") | (F.col("position_error_m") > bound + slack)
    if velocity_bound is not None:
        bad = bad | F.coalesce(F.col("velocity_error_mps") > velocity_bound + slack, F.lit(False))
    return errors.where(bad)


def event_chain_problems(events: DataFrame) -> DataFrame:
    """Events of one type of a track that overlap (gaps apart)."""
    w = Window.partitionBy(*TRACK, "event_type").orderBy("start_time_ns", "event_index")
    return events.where("event_type <> 'gap'").withColumn("before", F.lag("end_time_ns").over(w)).where("before > start_time_ns").select(*TRACK, "event_type", "event_index")


def identical_keyframes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tracks whose keyframe counts differ between two methods."""
    j = a.select(*TRACK, F.col("keyframe_count").alias("ka")).join(b.select(*TRACK, F.col("keyframe_count").alias("kb")), list(TRACK), "full_outer")
    return j.where(~F.col("ka").eqNullSafe(F.col("kb")))


def frame_mismatches(scenarios: DataFrame, frames: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Scenarios whose frame is missing ("frame") or differs from them, null-safely, with the first field that does."""
    b = frames.select("scenario_id", *[F.col(f).alias(f"frame_{f}") for f in fields], F.lit(True).alias("has_frame"))
    j = scenarios.join(b, "scenario_id", "left")
    field = F.when(F.col("has_frame").isNull(), "frame")
    for f in fields:
        field = field.when(~F.col(f).eqNullSafe(F.col(f"frame_{f}")), f)
    return j.select("scenario_id", field.alias("field")).where("field is not null")


def in_canonical_order(excluded: DataFrame, units: tuple[str, ...], reasons: tuple[str, ...]) -> DataFrame:
    """excluded (unit_type, unit_id, reason, ...) by kind of unit, id, and reason in their declared orders."""
    return excluded.orderBy(rank_of(F.col("unit_type"), units), "unit_id", rank_of(F.col("reason"), reasons))


#: Type of a geometry, by the code in its WKB (fixed values).
WKB_TYPES = {1: "point", 2: "linestring", 3: "polygon"}


def map_element_problems(elements: DataFrame, kinds: tuple[str, ...] = MAP_ELEMENTS) -> DataFrame:
    """Map elements with the first thing wrong: repeated id, unknown type, itself or one twice as neighbour, or a geometry of another type than declared."""
    w = Window.partitionBy("scenario_id", "map_element_id")
    links = F.concat(F.coalesce("successor_ids", F.array().cast("array<string>")), F.array("left_neighbor_id"), F.array("right_neighbor_id"))
    twice = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    # byte order, then the type; elevation adds 1000 or a high bit
    raw = F.hex(F.substring("geometry_wkb", 2, 4))
    code = F.conv(F.concat(*[F.substring(raw, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long").bitwiseAND(0x0FFFFFFF) % 1000
    stored = F.create_map(*[F.lit(x) for kv in WKB_TYPES.items() for x in kv])[code.cast("int")]
    problem = (
        F.when(F.count("*").over(w) > 1, "repeated_id").when(~F.col("element_type").isin(*kinds), "element_type").when(F.array_contains(F.array_compact(links), F.col("map_element_id")), "own_neighbour")
        .when(twice(F.col("successor_ids")) | twice(F.col("predecessor_ids")), "repeated_neighbour").when(~F.col("geometry_type").eqNullSafe(stored), "geometry_type")
    )
    return elements.withColumn("problem", problem).where("problem is not null").select("scenario_id", "map_element_id", "problem")


def membership_problems(templates: DataFrame, members: DataFrame) -> DataFrame:
    """Members (template_id, member_id, member_index) without a template, or whose indexes aren't 0 to member_count - 1."""
    w = Window.partitionBy("template_id")
    m = members.withColumns({"place": F.row_number().over(w.orderBy("member_index", "member_id")) - 1, "n": F.count("*").over(w)}).join(templates.select("template_id", "member_count"), "template_id", "left")
    problem = F.when(F.col("member_count").isNull(), "unknown_template").when(F.col("n") != F.col("member_count"), "member_count").when(F.col("member_index") != F.col("place"), "index")
    return m.withColumn("problem", problem).where("problem is not null").select("template_id", "member_id", "problem")


def split_problems(recorded: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """Units of a recorded split that aren't in the split made again from its configuration, or the other way round."""
    return differing_rows(recorded.select(key, "split"), again.select(key, "split"))


def metric_problems(rows: DataFrame, exact: tuple[str, ...], bounds: dict[str, tuple[str, float]], slack: float = 1e-9) -> DataFrame:
    """Metric rows (configuration, ...) that break what must hold: no error of exact configurations, bounds of the others.

    bounds: configuration -> (column, limit); exact: configurations whose maximum_error_m must be 0.
    """
    problem = F.when(F.col("configuration").isin(*exact) & (F.col("maximum_error_m") != 0), "exact_error")
    for name, (column, limit) in bounds.items():
        problem = problem.when((F.col("configuration") == name) & (F.col(column) > limit + slack), f"{column}_bound")
    return rows.withColumn("problem", problem).where("problem is not null")
