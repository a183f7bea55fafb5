"""Motion events by islands over per-sample features: stops, turns, acceleration, braking and gaps; and waypoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.motion import wrap
from ..schemas import EVENT_TYPES, WAYPOINT_ROLES, rank_of
from .replay import replay
from .sequence import TRACK, islands, run_table


@dataclass(frozen=True)
class EventConfig:
    stop_speed_mps: float = 0.5
    stop_ns: int = 1_000_000_000
    turn_deadband_rad: float = 0.01
    turn_rad: float = 0.35
    turn_ns: int = 300_000_000
    acceleration_deadband: float = 0.2
    speed_change_mps: float = 1.0
    acceleration_ns: int = 300_000_000
    heading_speed_mps: float = 0.5


RUN = (*TRACK, "run_index")


def features(valid: DataFrame, config: EventConfig = EventConfig()) -> DataFrame:
    """Adds speed, heading and where they came from.

    Speed: stored, else of the velocity, else by finite differences, else 0.  Heading: stored, else of a velocity faster
    than the threshold, else of the finite difference if it moves, else null.
    """
    w = Window.partitionBy(*RUN).orderBy("sample_index")
    at = lambda c, f: F.coalesce(f(c).over(w), F.col(c))
    seconds = (at("timestamp_ns", F.lead) - at("timestamp_ns", F.lag)).cast("double") / 1e9
    f = valid.withColumns({"dt": F.when(seconds > 0, seconds), "dx": at("x_m", F.lead) - at("x_m", F.lag), "dy": at("y_m", F.lead) - at("y_m", F.lag)})
    fx, fy = F.col("dx") / F.col("dt"), F.col("dy") / F.col("dt")
    diff, v = F.sqrt(fx * fx + fy * fy), F.sqrt(F.col("velocity_x_mps") * F.col("velocity_x_mps") + F.col("velocity_y_mps") * F.col("velocity_y_mps"))
    by_v = F.coalesce(v > config.heading_speed_mps, F.lit(False))
    by_d = F.coalesce(diff > 1e-12, F.lit(False))
    stored, stored_h = F.col("speed_mps").isNotNull(), F.col("heading_rad").isNotNull()
    return f.withColumns({
        "speed": F.coalesce("speed_mps", v, diff, F.lit(0.0)),
        "speed_source": F.when(stored, "stored").when(v.isNotNull(), "velocity").when(diff.isNotNull(), "finite_difference").otherwise("none"),
        "heading": F.when(stored_h, F.col("heading_rad")).when(by_v, F.atan2("velocity_y_mps", "velocity_x_mps")).when(by_d, F.atan2(fy, fx)),
        "heading_source": F.when(stored_h, "stored").when(by_v, "velocity").when(by_d, "finite_difference").otherwise("none"),
    }).drop("dt", "dx", "dy")


def _event(kind: Column, magnitude: Column) -> list[Column]:
    return [kind.alias("event_type"), "start_index", "anchor_index", "end_index", "start_time_ns", "anchor_time_ns", "end_time_ns", magnitude.cast("double").alias("magnitude"), F.col("ordinal").cast("int").alias("ordinal")]


def stops(feat: DataFrame, config: EventConfig = EventConfig()) -> DataFrame:
    """Stretches at or under the stop speed that last long enough; anchored at the slowest sample, earliest on ties.

    Ordinals count all stretches, the short ones too.
    """
    w = Window.partitionBy(*RUN).orderBy("sample_index")
    slow = F.col("speed") <= config.stop_speed_mps
    f = feat.withColumns({"slow": slow, "before": F.lag("speed").over(w), "after": F.lead("speed").over(w)})
    f = f.withColumn("ordinal", islands(F.col("slow") & ~F.coalesce(F.lag("slow").over(w), F.lit(False)), w)).where("slow")
    g = f.groupBy(*RUN, "ordinal").agg(
        F.min("sample_index").alias("start_index"), F.max("sample_index").alias("end_index"), F.min("timestamp_ns").alias("start_time_ns"), F.max("timestamp_ns").alias("end_time_ns"),
        F.min_by(F.struct("sample_index", "timestamp_ns"), F.struct("speed", "sample_index")).alias("anchor"), F.max("speed").alias("maximum_speed"), F.min("speed").alias("minimum_speed"),
        F.min_by("before", "sample_index").alias("before"), F.max_by("after", "sample_index").alias("after"), F.sort_array(F.collect_set("speed_source")).alias("speed_sources"),
    )
    g = g.where(F.col("end_time_ns") - F.col("start_time_ns") >= config.stop_ns)
    g = g.withColumns({"anchor_index": F.col("anchor.sample_index"), "anchor_time_ns": F.col("anchor.timestamp_ns")})
    moving = lambda c: F.coalesce(F.col(c) > config.stop_speed_mps, F.lit(False))
    return g.select(*RUN, *_event(F.lit("stop"), F.col("maximum_speed")), "minimum_speed", "maximum_speed", moving("before").alias("motion_before"), moving("after").alias("motion_after"), "speed_sources")


def _signed(feat: DataFrame, delta: Column, deadband: float, extra: list) -> DataFrame:
    """Steps between neighbouring samples, grouped while the step keeps its sign; steps inside the deadband break groups."""
    w = Window.partitionBy(*RUN).orderBy("sample_index")
    # a step belongs to its left sample
    s = feat.select(*RUN, "sample_index", "timestamp_ns", *extra, delta.alias("raw"), F.lead("sample_index").over(w).alias("next_index"), F.lead("timestamp_ns").over(w).alias("next_time_ns"))
    s = s.where("next_index is not null").withColumn("step", F.when(F.coalesce(F.abs("raw") < deadband, F.lit(True)), 0.0).otherwise(F.col("raw")))
    s = s.withColumn("sign", F.signum("step"))
    return s.withColumn("grp", islands(F.coalesce(F.col("sign") != F.lag("sign").over(w), F.lit(True)), w)).where("sign <> 0")


def turns(feat: DataFrame, config: EventConfig = EventConfig()) -> DataFrame:
    """Heading changes of one sign whose sum and duration suffice; anchored where the summed change is largest, earliest on ties."""
    w = Window.partitionBy(*RUN).orderBy("sample_index")
    delta = wrap(F.lead("heading").over(w) - F.col("heading"))
    s = _signed(feat, delta, config.turn_deadband_rad, [])
    inside = Window.partitionBy(*RUN, "grp").orderBy("sample_index").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("turned", F.abs(F.sum("step").over(inside)))
    g = s.groupBy(*RUN, "grp", "sign").agg(
        F.min("sample_index").alias("start_index"), F.max("next_index").alias("end_index"), F.min("timestamp_ns").alias("start_time_ns"), F.max("next_time_ns").alias("end_time_ns"),
        F.sum("step").alias("angle"), F.max_by(F.struct("next_index", "next_time_ns"), F.struct("turned", -F.col("next_index"))).alias("anchor"), F.max(F.abs("step")).alias("largest_step"),
    )
    g = g.where((F.abs("angle") >= config.turn_rad) & (F.col("end_time_ns") - F.col("start_time_ns") >= config.turn_ns))
    g = g.withColumns({"anchor_index": F.col("anchor.next_index"), "anchor_time_ns": F.col("anchor.next_time_ns"), "kind": F.when(F.col("sign") > 0, "left_turn").otherwise("right_turn")})
    g = g.withColumn("ordinal", F.row_number().over(Window.partitionBy(*RUN, "kind").orderBy("start_index")) - 1)
    return g.select(*RUN, *_event(F.col("kind"), F.col("angle")), "largest_step")


def accelerations(feat: DataFrame, config: EventConfig = EventConfig()) -> DataFrame:
    """Speed changes of one sign whose net and duration suffice; anchored at the left sample of the strongest step."""
    w = Window.partitionBy(*RUN).orderBy("sample_index")
    seconds = (F.lead("timestamp_ns").over(w) - F.col("timestamp_ns")).cast("double") / 1e9
    delta = (F.lead("speed").over(w) - F.col("speed")) / F.when(seconds > 0, seconds)
    s = _signed(feat, delta, config.acceleration_deadband, ["speed", F.lead("speed").over(w).alias("next_speed")])
    g = s.groupBy(*RUN, "grp", "sign").agg(
        F.min("sample_index").alias("start_index"), F.max("next_index").alias("end_index"), F.min("timestamp_ns").alias("start_time_ns"), F.max("next_time_ns").alias("end_time_ns"),
        F.min_by("speed", "sample_index").alias("speed_before"), F.max_by("next_speed", "sample_index").alias("speed_after"),
        F.max_by(F.struct("sample_index", "timestamp_ns", "step"), F.struct(F.abs("step"), -F.col("sample_index"))).alias("anchor"),
    )
    change = F.col("speed_after") - F.col("speed_before")
    g = g.where((F.abs(change) >= config.speed_change_mps) & (F.col("end_time_ns") - F.col("start_time_ns") >= config.acceleration_ns))
    g = g.withColumns({"anchor_index": F.col("anchor.sample_index"), "anchor_time_ns": F.col("anchor.timestamp_ns"), "kind": F.when(F.col("sign") > 0, "acceleration").otherwise("braking")})
    g = g.withColumn("ordinal", F.row_number().over(Window.partitionBy(*RUN, "kind").orderBy("start_index")) - 1)
    return g.select(*RUN, *_event(F.col("kind"), change), F.col("anchor.step").alias("peak_acceleration"))


def gaps(samples: DataFrame, valid: DataFrame) -> DataFrame:
    """Between neighbouring runs; with the invalid samples inside.

    One pass over each track in order: an invalid sample belongs to the gap after the last valid run before it.
    """
    w = Window.partitionBy(*TRACK).orderBy("run_index")
    lead = lambda c: F.lead(c).over(w)
    r = run_table(valid).select(*TRACK, "run_index", F.col("end_index").alias("a"), F.col("end_time_ns").alias("at"), lead("start_index").alias("b"), lead("start_time_ns").alias("bt")).where("b is not null")
    every = Window.partitionBy(*TRACK).orderBy("sample_index")
    starts = F.col("is_valid") & ~F.coalesce(F.lag("is_valid").over(every), F.lit(False))
    s = samples.select(*TRACK, "sample_index", "timestamp_ns", "is_valid", islands(starts, every).cast("int").alias("run_index"))
    bad = s.where("not is_valid and run_index >= 0").groupBy(*TRACK, "run_index").agg(F.count("*").alias("invalid_samples"), F.min("timestamp_ns").alias("first_invalid_ns"), F.max("timestamp_ns").alias("last_invalid_ns"))
    g = r.join(bad, [*TRACK, "run_index"])
    g = g.withColumns({"start_index": F.col("a"), "anchor_index": F.col("a"), "end_index": F.col("b"), "start_time_ns": F.col("at"), "anchor_time_ns": F.col("at"), "end_time_ns": F.col("bt"), "ordinal": F.col("run_index")})
    return g.select(*RUN, *_event(F.lit("gap"), F.lit(None)), "invalid_samples", "first_invalid_ns", "last_invalid_ns")


_COMMON = [*RUN, "event_type", "start_index", "anchor_index", "end_index", "start_time_ns", "anchor_time_ns", "end_time_ns", "magnitude", "ordinal"]


def events(samples: DataFrame, valid: DataFrame, config: EventConfig = EventConfig()) -> DataFrame:
    """All events of all tracks with event_index and event_id."""
    feat = features(valid, config)
    parts = [stops(feat, config), turns(feat, config), accelerations(feat, config), gaps(samples, valid)]
    out = parts[0].select(*_COMMON)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_COMMON))
    # a run's ordinal isn't unique within a track, so the run is part of the id
    out = out.withColumn("event_id", F.concat(F.lit("event-"), F.substring(F.sha2(F.concat_ws("|", *TRACK, F.col("run_index").cast("string"), "event_type", F.col("ordinal").cast("string")), 256), 1, 32)))
    w = Window.partitionBy(*TRACK).orderBy("start_time_ns", "end_time_ns", rank_of(F.col("event_type"), EVENT_TYPES), "event_id")
    return out.withColumn("event_index", (F.row_number().over(w) - 1).cast("int"))


_ROLES = {
    "gap": ("gap_start", "gap_start", "gap_end"), "stop": ("stop_start", "stop_start", "stop_end"), "left_turn": ("turn_entry", "turn_apex", "turn_exit"),
    "right_turn": ("turn_entry", "turn_apex", "turn_exit"), "acceleration": ("acceleration_start", "acceleration_start", "acceleration_end"), "braking": ("braking_start", "braking_start", "braking_end"),
}


def waypoints(valid: DataFrame, found: DataFrame) -> DataFrame:
    """Track and run ends, and start, anchor and end of every event (once per role and sample of an event), in order."""
    r = run_table(valid)
    t = r.groupBy(*TRACK).agg(F.min("start_index").alias("start_index"), F.min("start_time_ns").alias("start_time_ns"), F.max("end_index").alias("end_index"), F.max("end_time_ns").alias("end_time_ns"))
    none = F.lit(None).cast("string")

    def ends(df: DataFrame, kind: str) -> DataFrame:
        pair = F.array(F.struct(F.lit(f"{kind}_start").alias("waypoint_role"), F.col("start_index").alias("sample_index"), F.col("start_time_ns").alias("timestamp_ns")), F.struct(F.lit(f"{kind}_end").alias("waypoint_role"), F.col("end_index").alias("sample_index"), F.col("end_time_ns").alias("timestamp_ns")))
        return df.select(*TRACK, F.explode(pair).alias("w"), none.alias("event_id"))

    roles = F.create_map(*[x for k, v in _ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("event_type")]
    three = F.array_distinct(F.array(*[F.struct(roles[i].alias("waypoint_role"), F.col(f"{n}_index").alias("sample_index"), F.col(f"{n}_time_ns").alias("timestamp_ns")) for i, n in enumerate(("start", "anchor", "end"))]))
    all_ = ends(t, "track").unionByName(ends(r, "run")).unionByName(found.select(*TRACK, F.explode(three).alias("w"), "event_id"))
    out = all_.select(*TRACK, "w.*", "event_id")
    w = Window.partitionBy(*TRACK).orderBy("timestamp_ns", "sample_index", rank_of(F.col("waypoint_role"), WAYPOINT_ROLES), F.col("event_id").asc_nulls_first())
    return out.withColumn("waypoint_index", (F.row_number().over(w) - 1).cast("int"))


def waypoint_ids(points: DataFrame, tape: str) -> DataFrame:
    """waypoints with role_ordinal (its place among the track's waypoints of that role) and an id made from what names it."""
    w = Window.partitionBy(*TRACK, "waypoint_role").orderBy("waypoint_index")
    p = points.withColumn("role_ordinal", (F.row_number().over(w) - 1).cast("int"))
    name = F.concat_ws("|", F.lit(tape), *TRACK, "waypoint_role", F.col("sample_index").cast("string"), F.coalesce("event_id", F.lit("")), F.col("role_ordinal").cast("string"))
    return p.withColumn("waypoint_id", F.concat(F.lit("semantic-waypoint:"), F.sha2(name, 256)))


def waypoint_replay(points: DataFrame, valid: DataFrame, segs: DataFrame) -> DataFrame:
    """One row a track: its waypoints' replay errors against the source samples, in waypoint order, and the greatest (0 if none).

    An elevation that only one side has counts as 0 on the other; a velocity error is there where both sides have one.
    Waypoints without a source sample or a replayed state are counted as unresolved.
    """
    source = valid.select(*TRACK, "sample_index", *[F.col(c).alias(f"source_{c}") for c in ("x_m", "y_m", "z_m", "velocity_x_mps", "velocity_y_mps")])
    r = replay(segs, points).join(source, [*TRACK, "sample_index"], "left")
    d = lambda c: F.coalesce(f"replay_{c}", F.lit(0.0)) - F.coalesce(f"source_{c}", F.lit(0.0))
    ok = F.col("replay_x_m").isNotNull() & F.col("source_x_m").isNotNull()
    e = F.when(ok, F.sqrt(d("x_m") * d("x_m") + d("y_m") * d("y_m") + d("z_m") * d("z_m")))
    vx, vy = (F.col(f"replay_{c}") - F.col(f"source_{c}") for c in ("velocity_x_mps", "velocity_y_mps"))
    r = r.withColumns({"position_error_m": e, "velocity_error_mps": F.sqrt(vx * vx + vy * vy)})
    listed = lambda c: F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("waypoint_index", c))), lambda x: x[c]))
    return r.groupBy(*TRACK).agg(
        F.count("*").alias("waypoints"), F.count_if(~ok).alias("unresolved"), listed("position_error_m").alias("position_errors_m"), listed("velocity_error_mps").alias("velocity_errors_mps"),
        F.coalesce(F.max("position_error_m"), F.lit(0.0)).alias("maximum_position_error_m"), F.coalesce(F.max("velocity_error_mps"), F.lit(0.0)).alias("maximum_velocity_error_mps"),
    )


def summary(found: DataFrame) -> DataFrame:
    """Events and tracks with one, by type; types without events are there with 0."""
    types = found.sparkSession.createDataFrame([(t,) for t in EVENT_TYPES], "event_type string")
    got = found.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(*TRACK).alias("t"))
    return types.join(got, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).cast("long").alias("events"), F.coalesce("t", F.lit(0)).cast("long").alias("tracks"))
