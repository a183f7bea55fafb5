"""Campaign analysis: typed rows from JSON summaries, event scores, serialised sizes, claims, families and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.motion import exact_sum, wrap
from .statistics import event_scores, holm

#: Statistics of motion and event types of a scenario's summary (fixed values).
MOTION = {"position": ("mean", "median", "p95", "maximum"), "heading": ("mean", "p95"), "velocity": ("mean", "p95", "maximum"), "endpoint_position": ("mean", "p95", "maximum")}
UNITS = {"position": "m", "heading": "rad", "velocity": "mps", "endpoint_position": "m"}
EVENTS = {"stop": ("stop",), "turn": ("left_turn", "right_turn"), "acceleration": ("acceleration",), "braking": ("braking",)}
_COUNTS = "struct<source_event_count:long,replay_event_count:long,matched_event_count:long>"
_STATS = "struct<mean:double,median:double,p95:double,maximum:double>"
MOTION_JSON = "struct<" + ",".join(f"{f}:{_STATS}" for f in MOTION) + ">"
EVENTS_JSON = f"struct<overall:{_COUNTS},by_type:struct<" + ",".join(f"{t}:{_COUNTS}" for ts in EVENTS.values() for t in ts) + ">>"


def bound_violations(family: Column, position: Column, velocity: Column, position_bound: float = 0.1, velocity_bound: float = 1.0, slack: float = 1e-9) -> Column:
    """How many of a bounded family's promises a scenario breaks."""
    over = lambda x, b: F.coalesce((x > b + slack).cast("int"), F.lit(0))
    return F.when(family.isin("position_bounded_linear", "position_velocity_hybrid"), over(position, position_bound)).otherwise(0) + F.when(family == "position_velocity_hybrid", over(velocity, velocity_bound)).otherwise(0)


def scenario_rows(raw: DataFrame) -> DataFrame:
    """raw (any columns, family, motion_summary_json, semantic_summary_json) as wide typed rows.

    Left and right turns are one event type: their counts add up.  Scores are null where undefined.
    """
    r = raw.withColumns({"motion": F.from_json("motion_summary_json", MOTION_JSON), "events": F.from_json("semantic_summary_json", EVENTS_JSON)})
    out = {f"{f}_{s}_{UNITS[f]}": F.col(f"motion.{f}.{s}") for f, stats in MOTION.items() for s in stats}
    groups = {"overall": ("events.overall",)} | {e: tuple(f"events.by_type.{t}" for t in ts) for e, ts in EVENTS.items()}
    for name, parts in groups.items():
        n = {}
        for side in ("source", "replay", "matched"):
            values = [F.coalesce(F.col(f"{p}.{side}_event_count"), F.lit(0).cast("long")) for p in parts]
            n[side] = values[0] if len(values) == 1 else values[0] + values[1]
            out[f"semantic_{name}_{side}_count"] = n[side]
        for score, value in zip(("precision", "recall", "f1"), event_scores(n["source"], n["replay"], n["matched"])):
            out[f"semantic_{name}_{score}"] = value
    out["constraint_violation_count"] = bound_violations(F.col("family"), F.col("motion.position.maximum"), F.col("motion.velocity.maximum"))
    return r.withColumns(out).drop("motion", "events", "motion_summary_json", "semantic_summary_json")


def presence_aware(source: Column, replay: Column, matched: Column) -> Column:
    """F1 where an event is there; without source events 1 if replay has none either, else 0."""
    return F.when(source == 0, F.when(replay == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(2.0 * matched / (source + replay), F.lit(0.0)))


def event_analysis(rows: DataFrame, by: tuple[str, ...] = ("cohort_role", "parameter_identity")) -> DataFrame:
    """Per key and event type of scenario_rows: macro F1 over scenarios where it is defined, and how the others come about."""
    parts = [F.struct(F.lit(e).alias("event_type"), *[F.col(f"semantic_{e}_{c}_count").alias(c) for c in ("source", "replay", "matched")], F.col(f"semantic_{e}_f1").alias("f1")) for e in EVENTS]
    long = rows.select(*by, F.explode(F.array(*parts)).alias("e")).select(*by, "e.*")
    s, r, f1 = F.col("source"), F.col("replay"), F.col("f1")
    aware = presence_aware(s, r, F.col("matched"))
    return long.groupBy(*by, "event_type").agg(
        F.count("*").alias("scenarios"), (exact_sum(f1) / F.nullif(F.count(f1), F.lit(0))).alias("macro_f1"), F.count_if(f1.isNull()).alias("undefined"),
        F.count_if(s == 0).alias("source_absent"), F.count_if((s > 0) & f1.isNull()).alias("source_present_undefined"), F.count_if((s == 0) & (r > 0)).alias("false_positive"),
        (exact_sum(aware) / F.count("*")).alias("presence_aware"),
    )


def serialization_overhead(rows: DataFrame) -> DataFrame:
    """Per role: exact against raw serialised bytes of the scenarios that have both.  rows: (role, representation, scenario, bytes)."""
    side = lambda k: rows.where(F.col("representation") == k).select("role", "scenario", F.col("bytes").alias(k))
    j = side("raw").join(side("exact"), ["role", "scenario"], "full_outer")
    both = F.col("raw").isNotNull() & F.col("exact").isNotNull()
    ratio, more = F.when(both, F.col("exact") / F.col("raw")), F.when(both, F.col("exact") - F.col("raw"))
    return j.groupBy("role").agg(
        F.count_if(both).alias("scenarios"), F.count_if(~both).alias("unpaired"), F.sum("raw").alias("raw_bytes"), F.sum("exact").alias("exact_bytes"),
        (exact_sum(ratio) / F.nullif(F.count(ratio), F.lit(0))).alias("mean_ratio"), F.min(ratio).alias("least_ratio"), F.max(ratio).alias("greatest_ratio"), F.max(more).alias("greatest_increase"),
    )


def file_components(rows: DataFrame) -> DataFrame:
    """Per role, representation and file name the bytes, rows and scenarios of files listed as JSON.

    rows: (role, representation, artifact_summary_json), whose first run lists files (name, size_bytes, row_count).
    """
    kind = "struct<runs:array<struct<files:array<struct<name:string,size_bytes:long,row_count:long>>>>>"
    files = rows.select("role", "representation", F.explode(F.try_element_at(F.from_json("artifact_summary_json", kind)["runs"], F.lit(1))["files"]).alias("f"))
    return files.groupBy("role", "representation", F.col("f.name").alias("name")).agg(F.sum("f.size_bytes").alias("size_bytes"), F.coalesce(F.sum("f.row_count"), F.lit(0)).alias("row_count"), F.count("*").alias("files"))


def descriptive_difference(rows: DataFrame, side: Column, value: str, by: tuple[str, ...], lower_is_better: bool = True) -> DataFrame:
    """Per key the difference of the means of sides a (true) and b over non-null values, positive if b is better; null if a side is empty."""
    mean = lambda test: exact_sum(F.when(test, F.col(value))) / F.nullif(F.count(F.when(test, F.col(value))), F.lit(0))
    a, b = mean(side), mean(~side)
    return rows.groupBy(*by).agg((a - b if lower_is_better else b - a).alias("difference"))


def claim_label(adjusted: Column, invariant: Column) -> Column:
    """What a contrast supports: a guarantee that holds by construction, a significant result, or a tendency."""
    inside = adjusted.between(0.0, 1.0) & ~F.isnan(adjusted)
    wrong = F.raise_error(F.lit("an adjusted p-value lies outside [0, 1]"))
    return F.when(invariant, "invariant_guarantee").when(adjusted.isNull(), "descriptive_tendency").when(~inside, wrong.cast("string")).when(adjusted <= 0.05, "significant_result").otherwise("descriptive_tendency")


#: Predeclared contrasts: (family, context, method a, method b, whether their keyframes must be identical) (fixed values).
_ADAPTIVE = (("position_bounded_linear_0_10_m", "uniform_linear_stride_10"), ("position_bounded_linear_0_10_m", "fixed_interval_1000_ms"), ("uniform_linear_stride_10", "fixed_interval_1000_ms"))
FAMILIES = (
    *[("interpolation_primitive", None, f"uniform_linear_stride_{s}", f"uniform_hermite_stride_{s}", True) for s in (2, 5, 10)],
    *[("adaptive_segmentation_primary_byte", "primary_byte_0.48", a, b, False) for a, b in _ADAPTIVE],
    *[("adaptive_segmentation_primary_keyframe", "primary_keyframe_0.12", a, b, False) for a, b in _ADAPTIVE],
    ("temporal_vs_geometric", None, "position_bounded_linear_0_10_m", "rdp_linear_0_05_m", False),
    ("primitive_vocabulary", None, "position_bounded_linear_0_10_m", "unconstrained_hermite_0_10_m", False),
    ("velocity_constraint", None, "unconstrained_hermite_0_10_m", "position_velocity_hybrid_0_10_m_1_00_mps", False),
    ("bounded_method_tradeoff", None, "position_bounded_linear_0_10_m", "position_velocity_hybrid_0_10_m_1_00_mps", False),
)

#: Values of the parameter grid by method (fixed values): 39 points.
GRID = {
    "raw_samples": [{}], "exact_adjacent": [{}],
    "uniform_linear": [{"stride": s} for s in (2, 3, 5, 8, 10)], "uniform_hermite": [{"stride": s} for s in (2, 3, 5, 8, 10)],
    "fixed_interval_linear": [{"interval_s": s} for s in (0.2, 0.3, 0.5, 0.75, 1.0)], "rdp_linear": [{"tolerance_m": e} for e in (0.05, 0.10, 0.25, 0.50, 1.00)],
    "position_bounded_linear": [{"position_m": e} for e in (0.025, 0.05, 0.10, 0.20)], "unconstrained_hermite": [{"position_m": e} for e in (0.025, 0.05, 0.10, 0.20)],
    "position_velocity_hybrid": [{"position_m": p, "velocity_mps": v} for p in (0.05, 0.10, 0.20) for v in (0.5, 1.0, 2.0)],
}


def families(spark: SparkSession) -> DataFrame:
    """The contrast plan as a table: family, context, method_a, method_b, identical_keyframes."""
    return spark.createDataFrame(list(FAMILIES), "family string, context string, method_a string, method_b string, identical_keyframes boolean")


def parameter_grid(spark: SparkSession) -> DataFrame:
    """The grid as a table: method, place in the grid, parameters map<string,double>."""
    points = [(m, {k: float(v) for k, v in p.items()}) for m, ps in GRID.items() for p in ps]
    return spark.createDataFrame([(m, i, p) for i, (m, p) in enumerate(points)], "method string, place int, parameters map<string,double>")


def ablation(effects: DataFrame, plan: DataFrame, invariants: tuple[str, ...] = ()) -> DataFrame:
    """The plan's contrasts with their effect rows, p-values adjusted within each family and metric, and claim labels.

    effects: (context, metric, method_a, method_b, p_value, ...); plan: as `families`.  A contrast without an effect row
    keeps a null p-value and takes no part in the adjustment.
    """
    wanted = plan.select("family", *[F.col(c).alias(f"plan_{c}") for c in ("context", "method_a", "method_b")])
    same = (F.col("plan_method_a") == F.col("method_a")) & (F.col("plan_method_b") == F.col("method_b")) & F.col("plan_context").eqNullSafe(F.col("context"))
    j = effects.join(F.broadcast(wanted), same).drop("plan_context", "plan_method_a", "plan_method_b")
    name = F.concat_ws(" - ", "method_a", "method_b")
    adjusted = holm(j.where("p_value is not null").withColumn("contrast", name), ("family", "metric"), "contrast").select("family", "metric", "context", "method_a", "method_b", "adjusted")
    keys = ["family", "metric", "method_a", "method_b"]
    out = j.join(adjusted.drop("context"), keys, "left")
    return out.withColumn("claim", claim_label(F.col("adjusted"), F.col("metric").isin(*invariants) if invariants else F.lit(False)))


def cohort_summaries(units: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Per role and over all: units, included ones, and for each metric its five-number summary of included units."""
    role = F.when(F.grouping("role") == 1, "overall").otherwise(F.col("role"))
    aggs = [F.count("*").alias("units"), F.count_if("included").alias("included_units")]
    for m in metrics:
        x = F.when(F.col("included"), F.col(m))
        aggs += [F.min(x).alias(f"{m}_minimum"), *[F.percentile(x, F.lit(q)).alias(f"{m}_q{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.max(x).alias(f"{m}_maximum")]
    return units.rollup("role").agg(role.alias("of"), *aggs).drop("role").withColumnRenamed("of", "role")


def histogram(units: DataFrame, column: str) -> DataFrame:
    """Per role and over all the units by value."""
    role = F.when(F.grouping("role") == 1, "overall").otherwise(F.col("role"))
    return units.cube("role", column).agg(role.alias("of"), F.grouping(column).alias("g"), F.count("*").alias("units")).where("g = 0").select(F.col("of").alias("role"), column, "units")


def validation_status(scenarios: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per scenario (scenario_id, source_id) whether it is included, and why not.  excluded: (scenario_id, reason or null)."""
    one = excluded.groupBy("scenario_id").agg(F.coalesce(F.min("reason"), F.lit("other_documented_reason")).alias("reason"))
    return scenarios.join(one, "scenario_id", "left").select("source_id", F.col("reason").isNull().alias("included"), "reason")


def path_features(samples: DataFrame, keys: tuple[str, ...], order: str, least_step_m: float = 0.1) -> DataFrame:
    """Per key: samples, length, duration, summed heading changes of steps of at least least_step_m, speed range, extents."""
    w = Window.partitionBy(*keys).orderBy(order)
    dx, dy = F.col("x_m") - F.lag("x_m").over(w), F.col("y_m") - F.lag("y_m").over(w)
    s = samples.withColumns({"dx": dx, "dy": dy})
    s = s.withColumns({"d": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))})
    s = s.withColumn("h", F.when(F.col("d") >= least_step_m, F.atan2("dy", "dx")))
    # the heading of the last long step before this one
    before = F.last("h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("turn", F.abs(wrap(F.col("h") - before)))
    speed = F.coalesce("speed_mps", F.lit(0.0))
    ex, ey = F.max("x_m") - F.min("x_m"), F.max("y_m") - F.min("y_m")
    return s.groupBy(*keys).agg(
        F.count("*").alias("sample_count"), F.coalesce(exact_sum(F.col("d")), F.lit(0.0)).alias("path_length_m"), ((F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9).alias("duration_s"),
        F.coalesce(exact_sum(F.col("turn")), F.lit(0.0)).alias("heading_change_rad"), (F.max(speed) - F.min(speed)).alias("speed_range_mps"), ex.alias("extent_x_m"), ey.alias("extent_y_m"),
    )


def candidate_features(paths: DataFrame, exact: DataFrame, hybrid: DataFrame, counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row a candidate: path features with segment reduction, event preservation and annotation density.

    exact: keys, exact_segments; hybrid: keys, hybrid_segments, position_maximum_m, velocity_maximum_mps; counts: keys,
    event_type, source, replay, matched.
    """
    c = counts.groupBy(*keys).agg(F.sum("source").alias("source_events"), F.sum("replay").alias("replay_events"), F.sum("matched").alias("matched_events"), F.count_if(F.col("source") > 0).alias("event_types"))
    j = paths.join(exact, list(keys)).join(hybrid, list(keys)).join(c, list(keys), "left").na.fill(0, ["source_events", "replay_events", "matched_events", "event_types"])
    both = F.col("source_events") + F.col("replay_events")
    return j.withColumns({
        "segment_reduction_ratio": (F.col("exact_segments") - F.col("hybrid_segments")) / F.col("exact_segments"),
        "preservation_f1": F.when(both > 0, 2.0 * F.col("matched_events") / F.nullif(both, F.lit(0))).otherwise(1.0),
        "extent_m": F.sqrt(F.col("extent_x_m") * F.col("extent_x_m") + F.col("extent_y_m") * F.col("extent_y_m")),
        "annotation_density": F.col("source_events") / F.greatest("path_length_m", F.lit(1.0)),
    })


#: Eligibility clauses of a candidate: (what must hold, label of its failure) (fixed values).
CLAUSES = (
    ("sample_count >= 25", "fewer_than_25_valid_samples"), ("path_length_m > 0", "nonpositive_path_length"), ("source_events >= 1", "no_required_semantic_event"),
    ("heading_change_rad >= 0.35 or speed_range_mps >= 1.0", "no_nontrivial_maneuver"), ("exact_segments > hybrid_segments", "no_segment_reduction"),
    ("position_maximum_m <= 0.10", "position_bound_exceeded"), ("velocity_maximum_mps <= 1.00", "velocity_bound_exceeded"), ("extent_m >= 1.0", "insufficient_spatial_extent"),
    ("source_events <= 8", "excessive_event_count"), ("annotation_density <= 0.75", "excessive_annotation_density"),
)


def eligibility_failures(candidates: DataFrame, clauses: tuple[tuple[str, str], ...] = CLAUSES) -> DataFrame:
    """candidates with the labels of the clauses that fail, in order."""
    return candidates.withColumn("failures", F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(test), F.lit(False)), label) for test, label in clauses])))


def rank_candidates(candidates: DataFrame, identity: str) -> DataFrame:
    """The best candidates first: kinds of events, segment reduction, turning, preservation, samples, then low density."""
    order = [F.desc(c) for c in ("event_types", "segment_reduction_ratio", "heading_change_rad", "preservation_f1", "sample_count")]
    return candidates.where(F.size("failures") == 0).orderBy(*order, "annotation_density", identity)
