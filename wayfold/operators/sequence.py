"""Runs, chunks, islands and keyframes: window operators over samples ordered within a trajectory.

All windows here partition by (scenario_id, trajectory_id), so one exchange serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRACK = ("scenario_id", "trajectory_id")


def islands(flag: Column, window) -> Column:
    """Number, from 0, of the group that a row is in, where flag starts a new group."""
    return F.sum(flag.cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1


def runs(samples: DataFrame) -> DataFrame:
    """Valid samples with run_index: maximal stretches without an invalid sample."""
    w = Window.partitionBy(*TRACK).orderBy("sample_index")
    starts = F.col("is_valid") & ~F.coalesce(F.lag("is_valid").over(w), F.lit(False))
    return samples.withColumn("run_index", islands(starts, w).cast("int")).where("is_valid")


def chunks(valid: DataFrame) -> DataFrame:
    """Adds chunk_index: a run splits where elevation appears or vanishes."""
    w = Window.partitionBy(*TRACK, "run_index").orderBy("sample_index")
    none = F.col("z_m").isNull()
    return valid.withColumn("chunk_index", islands(F.coalesce(none != F.lag(none).over(w), F.lit(True)), w).cast("int"))


def run_table(valid: DataFrame) -> DataFrame:
    """One row a run: first and last index and time, samples."""
    return valid.groupBy(*TRACK, "run_index").agg(
        F.min("sample_index").alias("start_index"), F.max("sample_index").alias("end_index"), F.min("timestamp_ns").alias("start_time_ns"),
        F.max("timestamp_ns").alias("end_time_ns"), F.count("*").alias("samples"),
    )


def summaries(samples: DataFrame) -> DataFrame:
    """One row a trajectory: counts, time bounds, order faults, runs."""
    w = Window.partitionBy(*TRACK).orderBy("sample_index")
    s = samples.withColumns({
        "gap": F.col("sample_index") != F.coalesce(F.lag("sample_index").over(w) + 1, F.lit(0)),
        "late": F.coalesce(F.col("timestamp_ns") <= F.lag("timestamp_ns").over(w), F.lit(False)),
        "starts": F.col("is_valid") & ~F.coalesce(F.lag("is_valid").over(w), F.lit(False)),
    })
    valid_time = F.when(F.col("is_valid"), F.col("timestamp_ns"))
    return s.groupBy(*TRACK).agg(
        F.count("*").alias("sample_count"), F.count_if("is_valid").alias("valid_count"), F.min("timestamp_ns").alias("first_time_ns"),
        F.max("timestamp_ns").alias("last_time_ns"), F.min(valid_time).alias("first_valid_ns"), F.max(valid_time).alias("last_valid_ns"),
        F.bool_or("gap").alias("index_gap"), F.bool_or("late").alias("time_disorder"), F.count_if("starts").alias("run_count"),
    )


def eligible(samples: DataFrame, least_valid: int = 10, least_ns: int = 1_000_000_000) -> DataFrame:
    """Trajectories with enough valid samples over enough time: track keys and the two figures."""
    valid_time = F.when(F.col("is_valid"), F.col("timestamp_ns"))
    out = samples.groupBy(*TRACK).agg(F.count_if("is_valid").alias("valid_count"), (F.max(valid_time) - F.min(valid_time)).alias("valid_ns"))
    return out.where((F.col("valid_count") >= least_valid) & (F.col("valid_ns") >= least_ns))


def included(samples: DataFrame, **limits: int) -> DataFrame:
    """Samples of eligible trajectories."""
    return samples.join(eligible(samples, **limits), list(TRACK), "left_semi")


def uniform_keyframes(valid: DataFrame, stride: int) -> DataFrame:
    """Every stride-th sample of a run and its last, and both samples around a change of elevation; with chunk_index."""
    run = Window.partitionBy(*TRACK, "run_index")
    w = run.orderBy("sample_index")
    none = F.col("z_m").isNull()
    place = F.row_number().over(w) - 1
    edge = F.coalesce(none != F.lag(none).over(w), F.lit(False)) | F.coalesce(none != F.lead(none).over(w), F.lit(False))
    last = F.lead("sample_index").over(w).isNull()
    return chunks(valid).withColumn("keep", (place % stride == 0) | last | edge).where("keep").drop("keep")


def fixed_interval_keyframes(valid: DataFrame, interval_ns: int) -> DataFrame:
    """The first sample at or after each multiple of the interval since the run's start, and the last; and around changes of elevation.

    A sample is one of those iff it is the first of its run at or after some boundary: the boundary that follows the
    sample before it isn't later than it.  No boundaries are generated.
    """
    w = Window.partitionBy(*TRACK, "run_index").orderBy("sample_index")
    start = F.first("timestamp_ns").over(w.rowsBetween(Window.unboundedPreceding, 0))
    since, before = F.col("timestamp_ns") - start, F.lag("timestamp_ns").over(w) - start
    none = F.col("z_m").isNull()
    edge = F.coalesce(none != F.lag(none).over(w), F.lit(False)) | F.coalesce(none != F.lead(none).over(w), F.lit(False))
    first = before.isNull() | ((F.floor(before / interval_ns) + 1) * interval_ns <= since)
    return chunks(valid).withColumn("keep", first | F.lead("sample_index").over(w).isNull() | edge).where("keep").drop("keep")


_ENDS = ("sample_index", "timestamp_ns", "x_m", "y_m", "z_m", "heading_rad", "velocity_x_mps", "velocity_y_mps")


def segments(keyframes: DataFrame, cubic: bool = False) -> DataFrame:
    """Segments between neighbouring keyframes of a chunk; a keyframe alone in its chunk is a hold of no duration.

    cubic: a segment whose four end velocities are known is cubic.
    """
    w = Window.partitionBy(*TRACK, "run_index", "chunk_index").orderBy("sample_index")
    nxt = {f"end_{c}": F.lead(c).over(w) for c in _ENDS}
    k = keyframes.withColumns(nxt | {"alone": F.count("*").over(Window.partitionBy(*TRACK, "run_index", "chunk_index")) == 1})
    k = k.where(F.col("end_sample_index").isNotNull() | F.col("alone"))
    start = [F.col(c).alias(f"start_{c}") for c in _ENDS]
    end = [F.when(F.col("alone"), F.col(c)).otherwise(F.col(f"end_{c}")).alias(f"end_{c}") for c in _ENDS]
    out = k.select(*TRACK, "agent_id", "run_index", "chunk_index", "alone", *start, *end)
    known = F.lit(cubic)
    for c in ("start_velocity_x_mps", "start_velocity_y_mps", "end_velocity_x_mps", "end_velocity_y_mps"):
        known = known & F.col(c).isNotNull()
    return numbered(out.withColumn("primitive_type", F.when(F.col("alone"), "hold").when(known, "cubic_hermite").otherwise("linear")).drop("alone"))


def numbered(segs: DataFrame) -> DataFrame:
    """Adds segment_index within the run, and time columns under their table names."""
    w = Window.partitionBy(*TRACK, "run_index").orderBy("start_sample_index", "end_sample_index")
    out = segs.withColumn("segment_index", (F.row_number().over(w) - 1).cast("int"))
    return out.withColumnRenamed("start_timestamp_ns", "start_time_ns").withColumnRenamed("end_timestamp_ns", "end_time_ns")


def exact_segments(valid: DataFrame) -> DataFrame:
    """Segments between neighbouring samples: a hold where the position doesn't change; lossless.

    Elevation may come and go between neighbours of a run; such a pair is no hold.
    """
    keyed = valid.withColumn("chunk_index", F.lit(0))
    segs = segments(keyed)
    same = (F.col("start_x_m") == F.col("end_x_m")) & (F.col("start_y_m") == F.col("end_y_m")) & F.col("start_z_m").eqNullSafe(F.col("end_z_m"))
    return segs.withColumn("primitive_type", F.when(same, "hold").otherwise("linear"))


def keyframe_count(segs: DataFrame) -> DataFrame:
    """Distinct segment ends of each run, summed over a track."""
    ends = segs.select(*TRACK, "run_index", F.explode(F.array("start_sample_index", "end_sample_index")).alias("i"))
    return ends.groupBy(*TRACK).agg(F.count_distinct("run_index", "i").alias("keyframe_count"))
