"""Replay: the state of a track at any time, by a range join of query times with segments.

The join is an equi-join on the track and a time bucket.  Segments are exploded over the buckets they touch, so a long
track is many small groups; a query time is in one bucket, and of the segments that hold it the first counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.motion import segment_state
from .sequence import TRACK

BUCKET_NS = 10_000_000_000


def replay(segs: DataFrame, times: DataFrame, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """times (track keys, timestamp_ns, any others) with the replayed x_m ... columns; null where the track has no state then."""
    keys = [*TRACK, "bucket"]
    b = lambda c: F.floor(F.col(c) / bucket_ns)
    wide = segs.withColumn("bucket", F.explode(F.sequence(b("start_time_ns"), b("end_time_ns"))))
    asked = times.select(*TRACK, F.col("timestamp_ns").alias("query_ns")).distinct().withColumn("bucket", b("query_ns"))
    hit = asked.join(wide, keys).where("query_ns between start_time_ns and end_time_ns")
    state = segment_state(F.col("query_ns"), F.col("primitive_type"))
    # the first segment in (run, segment) order, as one aggregate: no sort
    first = hit.groupBy(*TRACK, "query_ns").agg(F.min_by(F.struct(*[c.alias(f"replay_{n}") for n, c in state.items()], "run_index"), F.struct("run_index", "segment_index")).alias("s"))
    first = first.select(*TRACK, F.col("query_ns").alias("timestamp_ns"), "s.*").withColumnRenamed("run_index", "replay_run_index")
    return times.join(first, [*TRACK, "timestamp_ns"], "left")


def raw_lookup(samples: DataFrame, times: DataFrame) -> DataFrame:
    """The valid sample at exactly each time; null elsewhere."""
    cols = ("x_m", "y_m", "z_m", "heading_rad", "velocity_x_mps", "velocity_y_mps")
    exact = samples.where("is_valid").select(*TRACK, "timestamp_ns", *[F.col(c).alias(f"replay_{c}") for c in cols])
    return times.join(exact, [*TRACK, "timestamp_ns"], "left")


def gap_midpoints(runs: DataFrame) -> DataFrame:
    """Between neighbouring runs the middle of the gap, if it lies strictly inside."""
    from pyspark.sql import Window

    w = Window.partitionBy(*TRACK).orderBy("run_index")
    g = runs.select(*TRACK, "run_index", F.col("end_time_ns").alias("gap_start_ns"), F.lead("start_time_ns").over(w).alias("gap_end_ns")).where("gap_end_ns is not null")
    g = g.withColumn("timestamp_ns", F.floor((F.col("gap_start_ns") + F.col("gap_end_ns")) / 2).cast("long"))
    return g.where("timestamp_ns > gap_start_ns and timestamp_ns < gap_end_ns")


def gap_probes(segs: DataFrame, runs: DataFrame) -> DataFrame:
    """Gap midpoints, and whether replay wrongly has a state there."""
    return replay(segs, gap_midpoints(runs)).withColumn("unexpected", F.col("replay_x_m").isNotNull())


def in_gap(runs: DataFrame, times: DataFrame, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """times with in_gap: strictly between the end of one run and the start of the next."""
    from pyspark.sql import Window

    w = Window.partitionBy(*TRACK).orderBy("run_index")
    b = lambda c: F.floor(F.col(c) / bucket_ns)
    gaps = runs.select(*TRACK, F.col("end_time_ns").alias("a"), F.lead("start_time_ns").over(w).alias("b")).where("b is not null")
    wide = gaps.withColumn("bucket", F.explode(F.sequence(b("a"), b("b"))))
    asked = times.select(*TRACK, "timestamp_ns").distinct().withColumn("bucket", b("timestamp_ns"))
    hit = asked.join(wide, [*TRACK, "bucket"]).where("timestamp_ns > a and timestamp_ns < b").select(*TRACK, "timestamp_ns").distinct().withColumn("in_gap", F.lit(True))
    return times.join(hit, [*TRACK, "timestamp_ns"], "left").withColumn("in_gap", F.coalesce("in_gap", F.lit(False)))


def endpoint_states(segs: DataFrame) -> DataFrame:
    """The state at each source sample that segments start or end at, once each, and whether segments disagree about it."""
    names = ("x_m", "y_m", "z_m", "heading_rad", "velocity_x_mps", "velocity_y_mps")
    side = lambda e: segs.select(*TRACK, F.col(f"{e}_sample_index").alias("sample_index"), F.struct(*[F.col(f"{e}_{n}").alias(n) for n in names]).alias("state"))
    g = side("start").unionByName(side("end")).groupBy(*TRACK, "sample_index").agg(F.min("state").alias("state"), (F.min("state") != F.max("state")).alias("conflict"))
    return g.select(*TRACK, "sample_index", "state.*", "conflict")


def densify(segs: DataFrame, step_ns: int) -> DataFrame:
    """States every step_ns along each segment, ends included."""
    times = F.array_distinct(F.concat(F.sequence("start_time_ns", "end_time_ns", F.lit(step_ns)), F.array("end_time_ns")))
    d = segs.withColumn("timestamp_ns", F.explode(times))
    state = segment_state(F.col("timestamp_ns"), F.col("primitive_type"))
    return d.select(*TRACK, "run_index", "segment_index", "timestamp_ns", *[c.alias(n) for n, c in state.items()])
