"""Replay errors of a codec against its source, per track and over all; event preservation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.motion import describe, exact_sum, heading_error, interval_iou, nearest_rank, position_error, velocity_error
from ..schemas import EVENT_TYPES
from . import kernels
from .graph import written
from .grouped import per_group
from .replay import BUCKET_NS, gap_probes, replay
from .sequence import TRACK, run_table
from .statistics import quantiles


def errors(valid: DataFrame, segs: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """One row a valid sample: position, heading and velocity error (null where undefined), missing state, run end."""
    r = replayed if replayed is not None else replay(segs, valid)
    c = F.col
    ends = run_table(valid).select(*TRACK, "run_index", "start_index", "end_index")
    r = r.join(ends, [*TRACK, "run_index"])
    return r.select(
        *TRACK, "run_index", "sample_index", "timestamp_ns",
        position_error(c("x_m"), c("y_m"), c("z_m"), c("replay_x_m"), c("replay_y_m"), c("replay_z_m")).alias("position_error_m"),
        heading_error(c("heading_rad"), c("replay_heading_rad")).alias("heading_error_rad"),
        velocity_error(c("velocity_x_mps"), c("velocity_y_mps"), c("replay_velocity_x_mps"), c("replay_velocity_y_mps")).alias("velocity_error_mps"),
        c("replay_x_m").isNull().alias("missing"),
        ((c("sample_index") == c("start_index")).cast("int") + (c("sample_index") == c("end_index")).cast("int")).alias("run_ends"),
    )


def track_metrics(err: DataFrame) -> DataFrame:
    """One row a track: error statistics, missing states, end errors (a run of one sample counts at both ends)."""
    return err.groupBy(*TRACK).agg(
        describe(F.col("position_error_m")).alias("position"), describe(F.col("velocity_error_mps")).alias("velocity"), describe(F.col("heading_error_rad")).alias("heading"),
        F.count_if("missing").alias("missing_states"), F.sum("run_ends").cast("long").alias("endpoint_probes"),
        F.max(F.when(F.col("run_ends") > 0, F.col("position_error_m"))).alias("endpoint_max_error_m"),
    )


def describe_all(df: DataFrame, x: Column) -> DataFrame:
    """functions.motion.describe over a whole table: sums by partial aggregation, quantiles by narrowing, so that no task holds all values."""
    values = written(df.sparkSession, df.select(x.alias("v")))
    v = F.col("v")
    found = quantiles(values, "v", (0.5, 0.95))
    n = F.count(v)
    return values.agg(
        n.alias("count"), (exact_sum(v) / F.nullif(n, F.lit(0))).alias("mean"), F.lit(found[0.5]).cast("double").alias("median"), F.lit(found[0.95]).cast("double").alias("p95"),
        F.max(v).alias("maximum"), F.coalesce(exact_sum(v), F.lit(0.0)).alias("sum"), F.coalesce(exact_sum(v * v), F.lit(0.0)).alias("sum_of_squares"),
    )


def micro(err: DataFrame) -> DataFrame:
    """Statistics over all samples."""
    return describe_all(err, F.col("position_error_m"))


def macro(err: DataFrame) -> DataFrame:
    """Statistics over the tracks' mean errors; tracks without errors don't count."""
    means = err.groupBy(*TRACK).agg(describe(F.col("position_error_m"))["mean"].alias("m"))
    return describe_all(means, F.col("m"))


def gap_metrics(valid: DataFrame, segs: DataFrame) -> DataFrame:
    """Per track: gap probes and how many found a state that shouldn't be."""
    return gap_probes(segs, run_table(valid)).groupBy(*TRACK).agg(F.count("*").alias("probes"), F.count_if("unexpected").alias("unexpected"))


def overlapping_pairs(source: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of events of one track and type that overlap, with their IoU.

    Events are put into the time buckets that they touch; a pair counts in the bucket where the later one starts.
    """
    pick = lambda df, p: df.select(*TRACK, "event_type", F.col("event_id").alias(f"{p}_id"), F.col("start_time_ns").alias(f"{p}_start"), F.col("end_time_ns").alias(f"{p}_end"))
    bucket = lambda c: F.floor(F.col(c) / BUCKET_NS)
    wide = lambda df, p: pick(df, p).withColumn("bucket", F.explode(F.sequence(bucket(f"{p}_start"), bucket(f"{p}_end"))))
    j = wide(source, "a").join(wide(other, "b"), [*TRACK, "event_type", "bucket"]).where("a_start <= b_end and b_start <= a_end")
    j = j.where(F.col("bucket") == F.floor(F.greatest("a_start", "b_start") / BUCKET_NS)).drop("bucket")
    return j.withColumn("iou", interval_iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))).where("iou > 0")


def matches(source: DataFrame, other: DataFrame) -> DataFrame:
    """One-to-one matches by greatest overlap, per track and type: sources, others, matched, and the ends' differences."""
    side = lambda df, s: df.select(*TRACK, "event_type", F.lit(s).alias("side"), "event_index", "start_time_ns", "end_time_ns")
    both = side(source, 0).unionByName(side(other, 1))
    schema = "scenario_id string, trajectory_id string, event_type string, source_events long, other_events long, matched long, start_differences array<long>, end_differences array<long>, ious array<double>"

    def kernel(key: tuple, c: dict) -> Iterable[tuple]:
        spans = [[(int(p), int(q)) for p, q in zip(c["start_time_ns"][c["side"] == s], c["end_time_ns"][c["side"] == s])] for s in (0, 1)]
        m = kernels.greedy_pairs(*spans)
        a, b = spans
        return [(len(a), len(b), len(m), [b[j][0] - a[i][0] for i, j, _ in m], [b[j][1] - a[i][1] for i, j, _ in m], [x for _, _, x in m])]

    return per_group(both, (*TRACK, "event_type"), ("side", "event_index"), ("side", "start_time_ns", "end_time_ns"), kernel, schema)


def preservation(found: DataFrame) -> DataFrame:
    """By type and over all ("all"): precision, recall, F1 and end errors of matches.

    Without any events on a side, precision or recall is 1 if the other side has none either, else 0.
    """
    types = found.sparkSession.createDataFrame([(t,) for t in EVENT_TYPES], "event_type string")
    rolled = found.rollup("event_type").agg(F.sum("source_events").alias("s"), F.sum("other_events").alias("o"), F.sum("matched").alias("m"))
    rolled = rolled.withColumn("event_type", F.coalesce("event_type", F.lit("all")))
    full = types.unionByName(found.sparkSession.createDataFrame([("all",)], "event_type string")).join(rolled, "event_type", "left").na.fill(0, ["s", "o", "m"])
    share = lambda n: F.when(F.col(n) > 0, F.col("m") / F.col(n)).otherwise(F.when(F.col("s") + F.col("o") == 0, 1.0).otherwise(0.0))
    p, r = share("o"), share("s")
    ends = found.select("event_type", F.explode("start_differences").alias("d")).rollup("event_type").agg(nearest_rank(F.abs("d").cast("double"), 0.95).alias("p95_start_ns")).withColumn("event_type", F.coalesce("event_type", F.lit("all")))
    return full.select("event_type", F.col("s").alias("source_events"), F.col("o").alias("other_events"), F.col("m").alias("matched"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")).join(ends, "event_type", "left").na.fill(0.0, ["p95_start_ns"])


def replayed_samples(samples: DataFrame, segs: DataFrame) -> DataFrame:
    """samples with state replaced by replay where there is one; stored speed and acceleration are dropped, so that events are detected on what the codec keeps."""
    r = replay(segs, samples)
    null = F.lit(None).cast("double")
    kept = {c: F.when(F.col("is_valid"), F.col(f"replay_{c}")).otherwise(F.col(c)) for c in ("x_m", "y_m", "z_m")}
    moved = {c: F.when(F.col("is_valid"), F.col(f"replay_{c}")) for c in ("heading_rad", "velocity_x_mps", "velocity_y_mps")}
    out = r.withColumns(kept | moved | {c: null for c in ("speed_mps", "acceleration_x_mps2", "acceleration_y_mps2")})
    return out.withColumn("is_valid", F.col("is_valid") & F.col("x_m").isNotNull()).select(*samples.columns)
