"""All queries of the engine, by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, motion
from ..operators import campaign, codecs, events, feasibility, graph, layout, metrics, replay, sequence, spatial, split, statistics, tape, validate
from ..operators.sequence import TRACK
from ..sources import bindings
from .oracle import CTES, PI, sql, stats

#: Event thresholds for the test binding, whose speeds are large.
CONFIG = events.EventConfig(stop_speed_mps=40.0, stop_ns=500_000_000)
ROUTES = layout.RouteConfig(points=8, start_m=60, end_m=60, mean_m=60, maximum_m=120, ratio_low=0.5, ratio_high=2.0)
GRID = spatial.Grid()
COUNTS = {"smoke": 2, "development": 5, "pilot": 3, "test": 8}
LANES = 12

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, so that the last bits don't matter."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), own.get(f.name, digits)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return sequence.runs(bindings.samples(spark, d))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return sequence.segments(sequence.uniform_keyframes(_valid(spark, d), 5))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.errors(_valid(spark, d), _segments(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return events.events(bindings.samples(spark, d), _valid(spark, d), CONFIG)


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


_STATS = {"sum": 4, "sum_of_squares": 2}

# --- sequences ---------------------------------------------------------------------------------------------------


@query(sql("SELECT scenario_id, trajectory_id, run_index, start_index, end_index, start_time_ns, end_time_ns, samples FROM runs", "runs"))
def valid_runs(spark, d):
    return sequence.run_table(_valid(spark, d))


@query(sql("SELECT scenario_id, trajectory_id, run_index, chunk_index, min(sample_index) AS start_index, count(*) AS samples, bool_or(z_m IS NOT NULL) AS elevated FROM cut GROUP BY ALL", "cut"))
def z_chunks(spark, d):
    return sequence.chunks(_valid(spark, d)).groupBy(*TRACK, "run_index", "chunk_index").agg(F.min("sample_index").alias("start_index"), F.count("*").alias("samples"), F.bool_or(F.col("z_m").isNotNull()).alias("elevated"))


_VALID_T = "CASE WHEN is_valid THEN timestamp_ns END"


@query(sql(f"SELECT scenario_id, trajectory_id, count(*) FILTER (is_valid) AS valid_count, max({_VALID_T}) - min({_VALID_T}) AS valid_ns FROM samples GROUP BY ALL HAVING count(*) FILTER (is_valid) >= 10 AND max({_VALID_T}) - min({_VALID_T}) >= 1000000000", "samples"))
def eligible_trajectories(spark, d):
    return sequence.eligible(bindings.samples(spark, d))


@query(
    sql(
        f"SELECT scenario_id, trajectory_id, count(*) AS sample_count, count(*) FILTER (is_valid) AS valid_count, min(timestamp_ns) AS first_time_ns, max(timestamp_ns) AS last_time_ns, min({_VALID_T}) AS first_valid_ns, max({_VALID_T}) AS last_valid_ns, bool_or(gap) AS index_gap, bool_or(late) AS time_disorder, CAST(sum(st) AS BIGINT) AS run_count FROM (SELECT *, sample_index <> coalesce(lag(sample_index) OVER w + 1, 0) AS gap, coalesce(timestamp_ns <= lag(timestamp_ns) OVER w, false) AS late FROM flagged WINDOW w AS (PARTITION BY trajectory_id ORDER BY sample_index)) GROUP BY ALL",
        "valid",
    )
)
def trajectory_summaries(spark, d):
    return sequence.summaries(bindings.samples(spark, d))


@query(sql("SELECT scenario_id, trajectory_id, run_index, sample_index, chunk_index FROM keys", "keys"))
def uniform_keyframes(spark, d):
    return sequence.uniform_keyframes(_valid(spark, d), 5).select(*TRACK, "run_index", "sample_index", "chunk_index")


_FIXED = """SELECT scenario_id, trajectory_id, run_index, sample_index FROM (SELECT *, first_value(timestamp_ns) OVER w AS t0, lag(timestamp_ns) OVER w AS tb, lead(sample_index) OVER w IS NULL AS is_last,
 coalesce((z_m IS NULL) <> lag(z_m IS NULL) OVER w, false) OR coalesce((z_m IS NULL) <> lead(z_m IS NULL) OVER w, false) AS edge FROM valid WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index))
 WHERE is_last OR edge OR tb IS NULL OR EXISTS (SELECT 1 FROM (SELECT unnest(range(0, timestamp_ns - t0 + 1, 500000000)) AS b) WHERE b <= timestamp_ns - t0 AND b > tb - t0)"""


@query(sql(_FIXED, "valid"))
def fixed_interval_keyframes(spark, d):
    return sequence.fixed_interval_keyframes(_valid(spark, d), 500_000_000).select(*TRACK, "run_index", "sample_index")


_SEG = "scenario_id, trajectory_id, run_index, segment_index, primitive_type, {i} AS start_sample_index, {j} AS end_sample_index, {s} AS start_time_ns, {e} AS end_time_ns"
_SEG_COLS = [*TRACK, "run_index", "segment_index", "primitive_type", "start_sample_index", "end_sample_index", "start_time_ns", "end_time_ns"]


@query(sql("SELECT " + _SEG.format(i="s_i", j="e_i", s="s_t", e="e_t") + " FROM segs", "segs"))
def uniform_segments(spark, d):
    return _segments(spark, d).select(*_SEG_COLS)


@query(
    sql(
        """SELECT scenario_id, trajectory_id, run_index, CAST(row_number() OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index) - 1 AS INTEGER) AS segment_index,
 CASE WHEN nx IS NULL OR (x_m = nx AND y_m = ny AND z_m IS NOT DISTINCT FROM nz) THEN 'hold' ELSE 'linear' END AS primitive_type, sample_index AS start_sample_index, coalesce(ni, sample_index) AS end_sample_index, timestamp_ns AS start_time_ns, coalesce(nt, timestamp_ns) AS end_time_ns
 FROM (SELECT *, lead(x_m) OVER w AS nx, lead(y_m) OVER w AS ny, lead(z_m) OVER w AS nz, lead(sample_index) OVER w AS ni, lead(timestamp_ns) OVER w AS nt, count(*) OVER (PARTITION BY trajectory_id, run_index) AS n FROM valid WINDOW w AS (PARTITION BY trajectory_id, run_index ORDER BY sample_index)) WHERE ni IS NOT NULL OR n = 1""",
        "valid",
    )
)
def exact_segments(spark, d):
    return sequence.exact_segments(_valid(spark, d)).select(*_SEG_COLS)


@query(sql("SELECT scenario_id, trajectory_id, count(DISTINCT (run_index, i)) AS keyframe_count FROM (SELECT scenario_id, trajectory_id, run_index, unnest([s_i, e_i]) AS i FROM segs) GROUP BY ALL", "segs"))
def keyframe_counts(spark, d):
    return sequence.keyframe_count(_segments(spark, d))


@query()
def rdp_keyframes(spark, d):
    return codecs.rdp_keyframes(_valid(spark, d), 20.0).select(*TRACK, "run_index", "chunk_index", "sample_index")


@query()
def linear_dp(spark, d):
    return codecs.encode_linear(_valid(spark, d), 20.0).select(*_SEG_COLS)


@query()
def hermite_dp(spark, d):
    return codecs.encode_hermite(_valid(spark, d), 40.0).select(*_SEG_COLS)


@query()
def dual_bound_dp(spark, d):
    return codecs.encode_dual_bound(_valid(spark, d), 40.0, 60.0).select(*_SEG_COLS)


@query()
def dual_bound_counters(spark, d):
    return codecs.dual_bound_counters(_valid(spark, d), 40.0, 60.0)


# --- replay and errors -------------------------------------------------------------------------------------------

_R = "round({}, 6) AS {}"


@query(sql("SELECT scenario_id, trajectory_id, sample_index, timestamp_ns, " + ", ".join(_R.format(a, b) for a, b in (("r_x", "x"), ("r_y", "y"), ("r_z", "z"), ("r_vx", "vx"), ("r_vy", "vy"))) + " FROM replayed", "replayed"))
def replay_linear(spark, d):
    r = replay.replay(_segments(spark, d), _valid(spark, d))
    return rounded(r.select(*TRACK, "sample_index", "timestamp_ns", *[F.col(f"replay_{a}").alias(b) for a, b in (("x_m", "x"), ("y_m", "y"), ("z_m", "z"), ("velocity_x_mps", "vx"), ("velocity_y_mps", "vy"))]))


_HB = "(2*u*u*u - 3*u*u + 1) * s_{0} + (u*u*u - 2*u*u + u) * sec * s_v{0} + (3*u*u - 2*u*u*u) * e_{0} + (u*u*u - u*u) * sec * e_v{0}"


def _cubic(axis: str) -> str:
    return f"round(CASE WHEN timestamp_ns = s_t THEN s_{axis} WHEN timestamp_ns = e_t THEN e_{axis} WHEN cubic THEN {_HB.format(axis)} ELSE s_{axis} + (e_{axis} - s_{axis}) * u END, 5) AS {axis}"


@query(sql(f"SELECT scenario_id, trajectory_id, sample_index, CASE WHEN primitive_type = 'hold' THEN 'hold' WHEN cubic THEN 'cubic_hermite' ELSE 'linear' END AS primitive_type, {_cubic('x')}, {_cubic('y')} FROM (SELECT *, s_vx IS NOT NULL AND s_vy IS NOT NULL AND e_vx IS NOT NULL AND e_vy IS NOT NULL AND primitive_type <> 'hold' AS cubic, CAST(e_t - s_t AS DOUBLE) / 1e9 AS sec FROM lerped)", "replayed"))
def replay_hermite(spark, d):
    v = _valid(spark, d)
    segs = sequence.segments(sequence.uniform_keyframes(v, 5), cubic=True)
    r = replay.replay(segs, v)
    kind = segs.select(*TRACK, F.col("run_index").alias("replay_run_index"), "segment_index", "primitive_type", "start_time_ns", "end_time_ns")
    first = r.join(kind, [*TRACK, "replay_run_index"]).where("timestamp_ns between start_time_ns and end_time_ns").groupBy(*TRACK, "sample_index").agg(F.min_by("primitive_type", "segment_index").alias("primitive_type"))
    return rounded(r.select(*TRACK, "sample_index", F.col("replay_x_m").alias("x"), F.col("replay_y_m").alias("y")).join(first, [*TRACK, "sample_index"]), 5)


@query(sql("SELECT q.scenario_id, q.trajectory_id, q.timestamp_ns, s.x_m AS replay_x_m, s.z_m AS replay_z_m FROM samples q LEFT JOIN samples s ON q.trajectory_id = s.trajectory_id AND q.timestamp_ns = s.timestamp_ns AND s.is_valid", "samples"))
def raw_lookup(spark, d):
    s = bindings.samples(spark, d)
    return replay.raw_lookup(s, s.select(*TRACK, "timestamp_ns")).select(*TRACK, "timestamp_ns", "replay_x_m", "replay_z_m")


@query(sql("""SELECT g.scenario_id, g.trajectory_id, g.run_index, g.t AS timestamp_ns, EXISTS (SELECT 1 FROM segs s WHERE s.trajectory_id = g.trajectory_id AND g.t BETWEEN s.s_t AND s.e_t) AS unexpected FROM (SELECT *, (end_time_ns + nx) // 2 AS t FROM (SELECT *, lead(start_time_ns) OVER (PARTITION BY trajectory_id ORDER BY run_index) AS nx FROM runs) WHERE nx IS NOT NULL) g WHERE t > end_time_ns AND t < nx""", "segs", "runs"))
def gap_probes(spark, d):
    v = _valid(spark, d)
    return replay.gap_probes(_segments(spark, d), sequence.run_table(v)).select(*TRACK, "run_index", "timestamp_ns", "unexpected")


@query(sql(f"SELECT {stats('pe')} FROM errs", "errs"))
def error_stats_micro(spark, d):
    return rounded(metrics.micro(_errors(spark, d)), **_STATS)


@query(sql(f"SELECT {stats('m')} FROM (SELECT CAST(sum(CAST(round(pe * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 / count(pe) AS m FROM errs GROUP BY trajectory_id)", "errs"))
def error_stats_macro(spark, d):
    return rounded(metrics.macro(_errors(spark, d)), **_STATS)


@query(sql(f"SELECT scenario_id, trajectory_id, {stats('ve')} FROM errs GROUP BY scenario_id, trajectory_id", "errs"))
def velocity_error_stats(spark, d):
    return rounded(metrics.track_metrics(_errors(spark, d)).select(*TRACK, "velocity.*"), **_STATS)


@query(sql("SELECT scenario_id, trajectory_id, CAST(sum(run_ends) AS BIGINT) AS endpoint_probes, round(max(CASE WHEN run_ends > 0 THEN pe END), 6) AS endpoint_max_error_m FROM errs GROUP BY ALL", "errs"))
def endpoint_errors(spark, d):
    return rounded(metrics.track_metrics(_errors(spark, d)).select(*TRACK, "endpoint_probes", "endpoint_max_error_m"))


@query(sql("SELECT scenario_id, trajectory_id, primitive_type, count(*) AS segments FROM segs GROUP BY ALL", "segs"))
def primitive_counts(spark, d):
    return _segments(spark, d).groupBy(*TRACK, "primitive_type").agg(F.count("*").alias("segments"))


_DENSE = ", ".join(f"round(CASE WHEN t = s_t THEN s_{a} WHEN t = e_t THEN e_{a} ELSE s_{a} + (e_{a} - s_{a}) * (CAST(t - s_t AS DOUBLE) / CAST(nullif(e_t - s_t, 0) AS DOUBLE)) END, 6) AS {a}_m" for a in "xy")


@query(sql(f"SELECT scenario_id, trajectory_id, run_index, segment_index, t AS timestamp_ns, {_DENSE} FROM (SELECT *, unnest(list_distinct(list_concat(range(s_t, e_t + 1, 50000000), [e_t]))) AS t FROM segs)", "segs"))
def densified_segments(spark, d):
    return rounded(replay.densify(_segments(spark, d), 50_000_000).select(*TRACK, "run_index", "segment_index", "timestamp_ns", "x_m", "y_m"))


# --- events ------------------------------------------------------------------------------------------------------


@query(sql("SELECT scenario_id, trajectory_id, sample_index, round(speed, 6) AS speed, speed_source, round(heading, 6) AS heading, heading_source FROM feat", "feat"))
def motion_features(spark, d):
    return rounded(events.features(_valid(spark, d), CONFIG).select(*TRACK, "sample_index", "speed", "speed_source", "heading", "heading_source"))


_EV = "scenario_id, trajectory_id, run_index, event_type, start_index, anchor_index, end_index, start_time_ns, anchor_time_ns, end_time_ns, round(magnitude, 5) AS magnitude, ordinal"


def _ev(df: DataFrame, *more: str) -> DataFrame:
    return rounded(df.select(*TRACK, "run_index", "event_type", "start_index", "anchor_index", "end_index", "start_time_ns", "anchor_time_ns", "end_time_ns", "magnitude", "ordinal", *more), 5)


@query(sql(f"SELECT {_EV}, round(minimum_speed, 5) AS minimum_speed, round(maximum_speed, 5) AS maximum_speed, motion_before, motion_after FROM stops", "stops"))
def stop_events(spark, d):
    return _ev(events.stops(events.features(_valid(spark, d), CONFIG), CONFIG), "minimum_speed", "maximum_speed", "motion_before", "motion_after")


@query(sql(f"SELECT {_EV} FROM turns", "turns"))
def turn_events(spark, d):
    return _ev(events.turns(events.features(_valid(spark, d), CONFIG), CONFIG))


@query(sql(f"SELECT {_EV}, round(peak, 5) AS peak_acceleration FROM accs", "accs"))
def acceleration_events(spark, d):
    return _ev(events.accelerations(events.features(_valid(spark, d), CONFIG), CONFIG), "peak_acceleration")


@query(sql(f"SELECT {_EV}, invalid_samples, first_invalid_ns, last_invalid_ns FROM gaps", "gaps"))
def gap_events(spark, d):
    return _ev(events.gaps(bindings.samples(spark, d), _valid(spark, d)), "invalid_samples", "first_invalid_ns", "last_invalid_ns")


@query(sql("SELECT scenario_id, trajectory_id, event_index, event_id, event_type, start_index, end_index FROM found", "found"))
def all_events(spark, d):
    return _events(spark, d).select(*TRACK, "event_index", "event_id", "event_type", "start_index", "end_index")


_ROLES_SQL = "CASE event_type WHEN 'gap' THEN ['gap_start','gap_start','gap_end'] WHEN 'stop' THEN ['stop_start','stop_start','stop_end'] WHEN 'acceleration' THEN ['acceleration_start','acceleration_start','acceleration_end'] WHEN 'braking' THEN ['braking_start','braking_start','braking_end'] ELSE ['turn_entry','turn_apex','turn_exit'] END"


@query(
    sql(
        f"""SELECT scenario_id, trajectory_id, waypoint_role, sample_index, timestamp_ns, event_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY timestamp_ns, sample_index, list_position(['track_start','track_end','run_start','run_end','gap_start','gap_end','stop_start','stop_end','turn_entry','turn_apex','turn_exit','acceleration_start','acceleration_end','braking_start','braking_end'], waypoint_role), event_id NULLS FIRST) - 1 AS INTEGER) AS waypoint_index FROM (
 SELECT scenario_id, trajectory_id, 'run_start' AS waypoint_role, start_index AS sample_index, start_time_ns AS timestamp_ns, CAST(NULL AS VARCHAR) AS event_id FROM runs UNION ALL SELECT scenario_id, trajectory_id, 'run_end', end_index, end_time_ns, NULL FROM runs
 UNION ALL SELECT scenario_id, trajectory_id, 'track_start', min(start_index), min(start_time_ns), NULL FROM runs GROUP BY ALL UNION ALL SELECT scenario_id, trajectory_id, 'track_end', max(end_index), max(end_time_ns), NULL FROM runs GROUP BY ALL
 UNION ALL SELECT DISTINCT scenario_id, trajectory_id, roles[i], [start_index, anchor_index, end_index][i], [start_time_ns, anchor_time_ns, end_time_ns][i], event_id FROM (SELECT *, {_ROLES_SQL} AS roles, unnest([1, 2, 3]) AS i FROM found))""",
        "found",
        "runs",
    )
)
def waypoints(spark, d):
    return events.waypoints(_valid(spark, d), _events(spark, d))


@query(sql("SELECT t.event_type, coalesce(n, 0) AS events, coalesce(k, 0) AS tracks FROM (SELECT unnest(['stop','left_turn','right_turn','acceleration','braking','gap']) AS event_type) t LEFT JOIN (SELECT event_type, count(*) AS n, count(DISTINCT trajectory_id) AS k FROM found GROUP BY ALL) f ON t.event_type = f.event_type", "found"))
def event_summary(spark, d):
    return events.summary(_events(spark, d))


def _both_events(spark, d):
    """Events of the source, and of its replay under stride-5 keyframes."""
    s = bindings.samples(spark, d)
    r = graph.written(spark, metrics.replayed_samples(s, _segments(spark, d)))  # read by every kind of event
    return _events(spark, d), events.events(r, sequence.runs(r), CONFIG)


_PAIR_SQL = """SELECT a.scenario_id, a.trajectory_id, a.event_type, a.event_id AS a_id, b.event_id AS b_id, round(o / CAST((a.end_time_ns - a.start_time_ns) + (b.end_time_ns - b.start_time_ns) - o AS DOUBLE), 6) AS iou
 FROM (SELECT a.*, b.event_id AS bid, greatest(0, least(a.end_time_ns, b.end_time_ns) - greatest(a.start_time_ns, b.start_time_ns)) AS o FROM found a JOIN found b ON a.trajectory_id = b.trajectory_id AND a.event_type = b.event_type) a JOIN found b ON b.event_id = a.bid AND b.trajectory_id = a.trajectory_id WHERE o > 0"""


@query(sql(_PAIR_SQL, "found"))
def event_pairs_iou(spark, d):
    e = _events(spark, d)
    return rounded(metrics.overlapping_pairs(e, e).where("iou > 0").select(*TRACK, "event_type", "a_id", "b_id", "iou"))


@query()
def event_matches(spark, d):
    return metrics.matches(*_both_events(spark, d)).select(*TRACK, "event_type", "source_events", "other_events", "matched")


@query()
def event_preservation(spark, d):
    return metrics.preservation(metrics.matches(*_both_events(spark, d)))


# --- routes ------------------------------------------------------------------------------------------------------


@query(sql("SELECT scenario_id, trajectory_id, run_index, round(length_m, 5) AS length_m, duration_ns FROM lengths WHERE length_m > 0", "lengths"))
def path_lengths(spark, d):
    return rounded(layout.path_lengths(_valid(spark, d)), 5)


_CAT = "CASE WHEN list_contains(ty, 'gap') THEN 'gap_affected' WHEN length_m <= 0.5 THEN 'stationary' WHEN list_contains(ty, 'stop') THEN 'stop_and_go' WHEN list_contains(ty, 'left_turn') AND list_contains(ty, 'right_turn') THEN 'mixed' WHEN list_contains(ty, 'left_turn') THEN 'left_turn' WHEN list_contains(ty, 'right_turn') THEN 'right_turn' WHEN list_contains(ty, 'acceleration') AND list_contains(ty, 'braking') THEN 'mixed' WHEN list_contains(ty, 'acceleration') THEN 'accelerating' WHEN list_contains(ty, 'braking') THEN 'braking' ELSE 'straight' END"
_CATS_SQL = f"""SELECT l.scenario_id, l.trajectory_id, round(length_m, 4) AS length_m, {_CAT.replace("(ty,", "(coalesce(types, []),")} AS category, {_CAT.replace("(ty,", "(list_filter(coalesce(types, []), lambda x: x <> 'gap'),")} AS moving_category FROM (SELECT scenario_id, trajectory_id, sum(length_m) AS length_m FROM lengths GROUP BY ALL) l LEFT JOIN (SELECT trajectory_id, list(DISTINCT event_type) AS types FROM found GROUP BY ALL) f ON l.trajectory_id = f.trajectory_id"""


@query(sql(_CATS_SQL, "lengths", "found"))
def motion_categories(spark, d):
    """With all events, and (moving_category) as if there were no gaps: every track of the test binding has one."""
    v, found = _valid(spark, d), _events(spark, d)
    moving = layout.categories(v, found.where("event_type <> 'gap'")).select(*TRACK, F.col("category").alias("moving_category"))
    return rounded(layout.categories(v, found).join(moving, list(TRACK)), 4)


@query(sql("SELECT s.scenario_id, s.trajectory_id, coalesce(string_agg(event_type, '>' ORDER BY event_index), '') AS signature, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in ("stop", "left_turn", "right_turn", "acceleration", "braking", "gap")) + " FROM (SELECT DISTINCT scenario_id, trajectory_id FROM samples) s LEFT JOIN found f ON s.trajectory_id = f.trajectory_id GROUP BY ALL", "found", "samples"))
def event_signatures(spark, d):
    return layout.signatures(_events(spark, d), bindings.samples(spark, d))


_RESAMPLE = """SELECT scenario_id, trajectory_id, run_index, CAST(p AS INTEGER) AS point, round(x0 + (target - prev) / d * (x_m - x0), 4) AS x_m, round(y0 + (target - prev) / d * (y_m - y0), 4) AS y_m FROM (SELECT *, total * p / 7 AS target FROM (SELECT *, max(along_m) OVER (PARTITION BY trajectory_id, run_index) AS total, lag(along_m) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index) AS prev FROM alongs), (SELECT unnest(range(8)) AS p) WHERE d > 0)
 WHERE (target > prev OR prev = 0) AND (target <= along_m OR along_m = total) AND total > 0"""


@query(sql(_RESAMPLE, "lengths"))
def resampled_paths(spark, d):
    return rounded(layout.resample(_valid(spark, d), 8), 4)


_SAME = ("scenario_id",)


def _routes(spark, d):
    """Path and length of all runs that move, in one pass over the samples."""
    p = layout.resample(_valid(spark, d), 8, "total").groupBy(*layout.RUN)
    return p.agg(F.array_sort(F.collect_list(F.struct("point", "x_m", "y_m"))).alias("path"), F.max("total").alias("length_m"))


_PAIRS = """pts AS (SELECT p.*, l.length_m FROM (RESAMPLE) p JOIN lengths l ON p.trajectory_id = l.trajectory_id AND p.run_index = l.run_index)""".replace("RESAMPLE", _RESAMPLE.replace("round(x0", "(x0").replace("round(y0", "(y0").replace(", 4) AS", ") AS"))
_PAIRS_SQL = """SELECT a.scenario_id, a.trajectory_id AS a_trajectory_id, a.run_index AS a_run_index, b.trajectory_id AS b_trajectory_id, b.run_index AS b_run_index, round(avg(e), 4) AS mean_error_m, round(max(e), 4) AS maximum_error_m, round(max(la / lb), 4) AS length_ratio,
 max(CASE WHEN point = 0 THEN e END) <= 60 AND max(CASE WHEN point = 7 THEN e END) <= 60 AND max(la / lb) BETWEEN 0.5 AND 2.0 AND avg(e) <= 60 AND max(e) <= 120 AS compatible
 FROM (SELECT a.scenario_id, a.trajectory_id, a.run_index, a.point, {0} AS b, sqrt((a.x_m - b.x_m) * (a.x_m - b.x_m) + (a.y_m - b.y_m) * (a.y_m - b.y_m)) AS e, a.length_m AS la, b.length_m AS lb FROM pts a JOIN pts b ON a.scenario_id = b.scenario_id AND a.point = b.point AND a.trajectory_id <> b.trajectory_id AND (a.trajectory_id < b.trajectory_id)) a GROUP BY ALL""".format("{{'trajectory_id': b.trajectory_id, 'run_index': b.run_index}}".replace("{{", "{").replace("}}", "}"))


@query(sql(_PAIRS_SQL, "lengths", recursive=_PAIRS))
def route_pairs(spark, d):
    """Compatibility of all moving runs of different tracks in a scenario."""
    p = layout.pairs(_routes(spark, d), ROUTES, _SAME)
    return rounded(p.drop("start_distance_m", "end_distance_m"), 4)


@query()
def route_templates(spark, d):
    v = _valid(spark, d)
    return layout.templates(layout.routes(v, _events(spark, d), ROUTES), ROUTES)


def _lanes(spark):
    """Straight synthetic lanes across the plane of the test binding."""
    return spark.range(LANES).select(F.concat(F.lit("lane:"), F.col("id").cast("string")).alias("lane_id"), F.lit(0.0).alias("x0"), (F.col("id") * 9.0).alias("y0"), F.lit(500.0).alias("x1"), (F.col("id") * 9.0 + 3.0).alias("y1"))


_LANE = """SELECT trajectory_id || '#' || sample_index AS id, arg_min(lane_id, (dist, lane_id)) AS lane_id, round(min(dist), 6) AS distance_m FROM (SELECT v.*, lane_id, sqrt((x_m - u * 500) * (x_m - u * 500) + (y_m - y0 - u * 3) * (y_m - y0 - u * 3)) AS dist FROM (SELECT v.trajectory_id, v.sample_index, x_m, y_m, 'lane:' || i AS lane_id, i * 9.0::DOUBLE AS y0, least(1.0, greatest(0.0, (x_m * 500 + (y_m - i * 9.0::DOUBLE) * 3) / (500.0::DOUBLE * 500 + 9))) AS u FROM valid v, (SELECT unnest(range(12)) AS i)) v) WHERE dist <= 4 GROUP BY ALL"""


@query(sql(_LANE, "valid"))
def nearest_lanes(spark, d):
    p = _valid(spark, d).select(F.concat_ws("#", "trajectory_id", F.col("sample_index").cast("string")).alias("id"), "x_m", "y_m")
    return rounded(layout.nearest_lanes(p, _lanes(spark), 4.0).where("lane_id is not null").select("id", "lane_id", "distance_m"))


_LANE_OF = _LANE.replace("SELECT trajectory_id || '#' || sample_index AS id, ", "SELECT scenario_id, trajectory_id, run_index, sample_index, ").replace("(SELECT v.trajectory_id, v.sample_index,", "(SELECT v.scenario_id, v.trajectory_id, v.run_index, v.sample_index,")


@query(sql("SELECT scenario_id, trajectory_id, run_index, list(lane_id ORDER BY sample_index) AS lanes FROM (SELECT *, lag(lane_id) OVER (PARTITION BY trajectory_id, run_index ORDER BY sample_index) AS before FROM at_lane) WHERE before IS DISTINCT FROM lane_id GROUP BY ALL", "valid", recursive=f"at_lane AS ({_LANE_OF})"))
def lane_sequences(spark, d):
    v = _valid(spark, d).withColumn("id", F.concat_ws("#", "trajectory_id", F.col("sample_index").cast("string")))
    m = layout.nearest_lanes(v.select("id", "x_m", "y_m"), _lanes(spark), 4.0).select("id", "lane_id")
    return layout.lane_sequences(v.select("id", *layout.RUN, "sample_index").join(m, "id"))


# --- tiles and splits --------------------------------------------------------------------------------------------


@query(sql("SELECT CAST(floor(x_m / 10) AS BIGINT) AS grid_x, CAST(floor(y_m / 10) AS BIGINT) AS grid_y, count(*) AS samples, list_sort(list(DISTINCT trajectory_id)) AS tracks FROM valid GROUP BY ALL", "valid"))
def tile_points(spark, d):
    return spatial.tile_of(_valid(spark, d), GRID).groupBy("grid_x", "grid_y").agg(F.count("*").alias("samples"), F.array_sort(F.collect_set("trajectory_id")).alias("tracks"))


@query(sql("SELECT scenario_id, trajectory_id, grid_x, grid_y, length_um // 1000 AS length_mm FROM tiled", "tiled"))
def tile_lengths(spark, d):
    return spatial.tile_lengths(_valid(spark, d), GRID).select(*TRACK, "grid_x", "grid_y", F.floor(F.col("length_um") / 1000).alias("length_mm"))


#: The tiles' contexts: the same clipping with a margin of 2 around each box.
_NEAR = CTES["tiled"][1]
for _a, _b in (("cand2", "nearcand2"), ("cand AS", "nearcand AS"), ("FROM cand)", "FROM nearcand)"), ("box AS", "nearbox AS"), ("FROM box)", "FROM nearbox)"), ("par AS", "nearpar AS"), ("FROM par", "FROM nearpar"), ("clipped", "nearclipped"), ("tiled AS", "near AS"),
               ("least(x0, x1) / 10.0", "(least(x0, x1) - 2) / 10.0"), ("greatest(x0, x1) / 10.0", "(greatest(x0, x1) + 2) / 10.0"), ("least(y0, y1) / 10.0", "(least(y0, y1) - 2) / 10.0"), ("greatest(y0, y1) / 10.0", "(greatest(y0, y1) + 2) / 10.0"),
               ("AS DOUBLE) AS min_x", "AS DOUBLE) - 2 AS min_x"), ("+ 10 AS max_x", "+ 12 AS max_x"), ("AS DOUBLE) AS min_y", "AS DOUBLE) - 2 AS min_y"), ("+ 10 AS max_y", "+ 12 AS max_y")):
    _NEAR = _NEAR.replace(_a, _b)


@query(
    sql(
        "SELECT i.grid_x, i.grid_y, i.tracks, i.length_um // 1000000 AS length_m, coalesce(n.k, 0) AS context_tracks, coalesce(o.samples, 0) AS samples FROM (SELECT grid_x, grid_y, list_sort(list(DISTINCT trajectory_id)) AS tracks, CAST(sum(length_um) AS BIGINT) AS length_um FROM tiled GROUP BY ALL) i LEFT JOIN (SELECT grid_x, grid_y, count(DISTINCT trajectory_id) AS k FROM near GROUP BY ALL) n ON n.grid_x = i.grid_x AND n.grid_y = i.grid_y LEFT JOIN (SELECT CAST(floor(x_m / 10) AS BIGINT) AS grid_x, CAST(floor(y_m / 10) AS BIGINT) AS grid_y, count(*) AS samples FROM valid GROUP BY ALL) o ON o.grid_x = i.grid_x AND o.grid_y = i.grid_y",
        "tiled", "valid", recursive=_NEAR,
    )
)
def tiles(spark, d):
    t = spatial.tiles(_valid(spark, d), GRID)
    return t.select("grid_x", "grid_y", "tracks", F.floor(F.col("length_um") / 1000000).alias("length_m"), "context_tracks", "samples")


def _busy(spark, d):
    """All valid samples with the tiles that own them."""
    return spatial.tile_of(_valid(spark, d), spatial.Grid(4.0, 1.0))


_BUSY = "busy AS (SELECT DISTINCT CAST(floor(x_m / 4) AS BIGINT) AS grid_x, CAST(floor(y_m / 4) AS BIGINT) AS grid_y, CAST(floor(x_m / 4) AS BIGINT) * 2147483648 + CAST(floor(y_m / 4) AS BIGINT) AS code FROM valid), reach AS (SELECT code AS id, code FROM busy UNION SELECT b.code AS id, r.code FROM reach r JOIN busy a ON a.code = r.id JOIN busy b ON abs(a.grid_x - b.grid_x) <= 1 AND abs(a.grid_y - b.grid_y) <= 1)"


@query(
    sql(
        "SELECT t.grid_x, t.grid_y, CAST(min(r.code) // 2147483648 AS BIGINT) AS group_x FROM busy t JOIN reach r ON r.id = t.code GROUP BY t.grid_x, t.grid_y",
        "valid",
        recursive=_BUSY,
    )
)
def leakage_groups(spark, d):
    return spatial.leakage_groups(spark, _busy(spark, d), spatial.Grid(4.0, 1.0)).select("grid_x", "grid_y", "group_x")


_SEED = "CAST('0x' || substr(h, 2, 15) AS BIGINT) + (strpos('0123456789abcdef', substr(h, 1, 1)) - 1) % 8 * 1152921504606846976"


def _seed_sql(root: int, parts: str, unit: str) -> str:
    return f"""sha256('{{"components":[{parts},"' || {unit} || '"],"root_seed":{root}}}')"""


@query(f"""SELECT unit, {_SEED} AS seed, CAST(row_number() OVER (ORDER BY {_SEED}, unit) AS INTEGER) AS rank FROM (SELECT 'customer:' || c_custkey AS unit, {_seed_sql(17, '"rank"', "'customer:' || c_custkey")} AS h FROM customer)""")
def seeded_rank(spark, d):
    return split.ranked(read(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("unit")), "unit", 17, "rank")


_SPLIT = f"""SELECT scenario_id, city, 'held_out_city' AS split FROM s WHERE city = 'r0' UNION ALL SELECT scenario_id, city, CASE WHEN r <= 2 THEN 'smoke' WHEN r <= 7 THEN 'development' WHEN r <= 10 THEN 'pilot' WHEN r <= 18 THEN 'test' END FROM (SELECT *, row_number() OVER (ORDER BY {_SEED}, scenario_id) AS r FROM (SELECT *, {_seed_sql(17, '"split"', 'scenario_id')} AS h FROM s WHERE city <> 'r0')) WHERE r <= 18"""


@query("WITH s AS (SELECT 'scenario:' || n_name AS scenario_id, 'r' || n_regionkey AS city FROM nation) " + _SPLIT)
def motion_split(spark, d):
    n = read(spark, d, "nation").select(F.concat(F.lit("scenario:"), "n_name").alias("scenario_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("city"))
    return split.motion_split(n, "r0", COUNTS, 17)


_LAYOUT = "grouped AS (SELECT t.grid_x, t.grid_y, CAST(min(r.code) // 2147483648 AS BIGINT) AS group_x, CAST(min(r.code) % 2147483648 AS BIGINT) AS group_y FROM busy t JOIN reach r ON r.id = t.code GROUP BY t.grid_x, t.grid_y)"


@query(
    sql(
        f"""SELECT g.*, CASE WHEN r <= 3 THEN 'development' ELSE 'test' END AS split FROM grouped g JOIN (SELECT unit, row_number() OVER (ORDER BY {_SEED}, unit) AS r FROM (SELECT unit, {_seed_sql(17, '"layout"', 'unit')} AS h FROM (SELECT DISTINCT group_x || ':' || group_y AS unit FROM grouped))) u ON u.unit = g.group_x || ':' || g.group_y""",
        "valid",
        recursive=_BUSY + ", " + _LAYOUT,
    )
)
def layout_split(spark, d):
    g = spatial.leakage_groups(spark, _busy(spark, d), spatial.Grid(4.0, 1.0))
    return split.layout_split(g, {"development": 3, "test": 10_000_000}, 17)


def _cohort_sql(table: str, key: str, role: str) -> str:
    return f"SELECT unit, {_SEED} AS seed, CAST(row_number() OVER (ORDER BY {_SEED}, unit) AS INTEGER) AS rank, '{role}' AS role FROM (SELECT '{key}:' || k AS unit, sha256('{{\"components\":[\"{role}\",\"{key}:' || k || '\"],\"root_seed\":17}}') AS h FROM {table})"


@query(f"""WITH a AS (SELECT * FROM ({_cohort_sql('(SELECT c_custkey AS k FROM customer)', 'u', 'development')}) WHERE rank <= 20),
 b AS (SELECT * FROM ({_cohort_sql('(SELECT DISTINCT o_custkey AS k FROM orders)', 'u', 'pilot')}) WHERE unit NOT IN (SELECT unit FROM a) ORDER BY rank LIMIT 10) SELECT * FROM a UNION ALL SELECT * FROM b""")
def cohort_select(spark, d):
    u = lambda c: F.concat(F.lit("u:"), F.col(c).cast("string")).alias("unit")
    return split.cohort(read(spark, d, "customer").select(u("c_custkey")), read(spark, d, "orders").select(u("o_custkey")).distinct(), 20, 10, 17)


@query("SELECT s_suppkey, s_nationkey, s_acctbal, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS rank, count(*) OVER (PARTITION BY s_nationkey) AS candidate_count FROM supplier")
def stable_rank(spark, d):
    return split.stable_rank(read(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_acctbal", "s_suppkey", True, ("s_nationkey",))


@query("SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE r = (n - 1) // 2 + 1")
def median_selection(spark, d):
    return split.select_by_rule(stable_rank(spark, d), "median").select("s_nationkey", "s_suppkey")


# --- validation --------------------------------------------------------------------------------------------------


def _agents(spark, d):
    c = F.col("c_custkey")
    kind = F.when(c % 11 == 0, "tram").when(c % 3 == 0, "pedestrian").otherwise("vehicle")
    one = read(spark, d, "customer").select(F.concat(F.lit("scenario:"), F.pmod(c, F.lit(10)).cast("string")).alias("scenario_id"), F.concat(F.lit("agent:"), c.cast("string")).alias("agent_id"), kind.alias("agent_class"), c.alias("k"))
    return one.where("k % 13 <> 0").unionByName(one.where("k % 17 = 0")).drop("k")


_AGENTS = "agents AS (SELECT 'scenario:' || (c_custkey % 10) AS scenario_id, 'agent:' || c_custkey AS agent_id, CASE WHEN c_custkey % 11 = 0 THEN 'tram' WHEN c_custkey % 3 = 0 THEN 'pedestrian' ELSE 'vehicle' END AS agent_class FROM (SELECT * FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT * FROM customer WHERE c_custkey % 17 = 0))"


@query(
    "WITH " + _AGENTS + ", " + sql("", "samples").removeprefix("WITH ").strip()
    + f""" SELECT * FROM (SELECT s.scenario_id, s.trajectory_id, s.agent_id, CASE WHEN a.n IS NULL THEN 'unknown_agent' WHEN a.n > 1 THEN 'duplicate_agent' WHEN a.agent_class NOT IN ('vehicle','pedestrian','cyclist','other_dynamic','unknown') THEN 'unsupported_class' WHEN vc < 55 THEN 'too_few_valid_samples' WHEN coalesce(vt < 1000000000, true) THEN 'too_short' END AS reason
 FROM (SELECT scenario_id, trajectory_id, agent_id, count(*) FILTER (is_valid) AS vc, max({_VALID_T}) - min({_VALID_T}) AS vt FROM samples GROUP BY ALL) s LEFT JOIN (SELECT scenario_id, agent_id, count(*) AS n, min(agent_class) AS agent_class FROM agents GROUP BY ALL) a ON s.agent_id = a.agent_id AND s.scenario_id = a.scenario_id) WHERE reason IS NOT NULL"""
)
def validation_exclusions(spark, d):
    return validate.exclusions(bindings.samples(spark, d), _agents(spark, d), least_valid=55)


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def foreign_key_problems(spark, d):
    return validate.foreign_key_problems(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), read(spark, d, "customer").where("c_custkey % 7 <> 0"), ["c_custkey"])


@query("SELECT ps.l_partkey, ps.l_suppkey, count(*) AS rows FROM lineitem ps GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return validate.repeated_keys(read(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("(SELECT n_nationkey, 'left' AS side FROM nation WHERE n_regionkey = 1) UNION ALL (SELECT n_nationkey, 'right' FROM nation WHERE n_regionkey = 2)")
def differing_rows(spark, d):
    n = read(spark, d, "nation")
    return validate.differing_rows(n.where("n_regionkey <> 2").select("n_nationkey"), n.where("n_regionkey <> 1").select("n_nationkey"))


@query("SELECT CAST('' AS VARCHAR) AS scenario_id, CAST('' AS VARCHAR) AS trajectory_id, CAST(0 AS INTEGER) AS run_index, CAST(0 AS INTEGER) AS segment_index, CAST('' AS VARCHAR) AS problem WHERE false")
def segment_chain_problems(spark, d):
    """Of well-formed segments: none."""
    return validate.segment_chain_problems(_segments(spark, d))


@query()
def linear_bound_problems(spark, d):
    """Samples off by more than the linear codec's bound: none."""
    v = _valid(spark, d)
    return validate.bound_problems(metrics.errors(v, codecs.encode_linear(v, 20.0)), 20.0)


@query()
def dual_bound_problems(spark, d):
    v = _valid(spark, d)
    return validate.bound_problems(metrics.errors(v, codecs.encode_dual_bound(v, 40.0, 60.0)), 40.0, 60.0)


# --- statistics --------------------------------------------------------------------------------------------------


def _metrics(spark, d, unit="l_suppkey"):
    li = read(spark, d, "lineitem")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double")
    return li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("method"), F.col(unit).alias("unit")).agg((cents / 100 / F.count("*")).alias("value"))


def _methods(m):
    from pyspark.sql import Window

    return m.select("method").distinct().withColumn("place", F.row_number().over(Window.orderBy("method")))


def _diffs(spark, d, unit="l_suppkey"):
    m = _metrics(spark, d, unit)
    return statistics.paired_differences(m, _methods(m), "unit")


@query(sql("SELECT count(*) FILTER (a.value IS NULL) AS missing_a, count(*) FILTER (b.value IS NULL) AS missing_b, count(*) FILTER (a.value IS NULL OR b.value IS NULL) AS missing_either, count(*) AS units FROM (SELECT * FROM metrics WHERE method LIKE 'A%' AND unit % 3 <> 0) a FULL JOIN (SELECT * FROM metrics WHERE method LIKE 'R%' AND unit % 5 <> 0) b ON a.unit = b.unit", "metrics"))
def paired_alignment(spark, d):
    m = _metrics(spark, d)
    return statistics.align(m.where("method like 'A%' and unit % 3 <> 0"), m.where("method like 'R%' and unit % 5 <> 0"), "unit")[1]


_MICRO = "CAST(sum(CAST(round(difference * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 / count(*)"


@query(sql(f"SELECT method_a, method_b, count(*) AS n, round({_MICRO}, 5) AS mean, round(avg(difference) / nullif(stddev_samp(difference), 0), 6) AS effect, count(*) FILTER (difference > 0) AS wins, count(*) FILTER (difference = 0) AS ties, count(*) FILTER (difference < 0) AS losses FROM diffs2 GROUP BY ALL", "diffs2"))
def paired_effects(spark, d):
    return rounded(statistics.effects(_diffs(spark, d)), mean=5)


@query(sql("SELECT method_a, method_b, round(CAST(sum(CASE WHEN difference > 0 THEN r ELSE -r END) AS DOUBLE) / sum(r), 6) AS rank_biserial FROM (SELECT *, 2 * rank() OVER (PARTITION BY method_a, method_b ORDER BY abs(difference)) + count(*) OVER (PARTITION BY method_a, method_b, abs(difference)) - 1 AS r FROM diffs2 WHERE difference <> 0) GROUP BY ALL", "diffs2"))
def rank_biserial(spark, d):
    return rounded(statistics.rank_biserial(_diffs(spark, d)))


@query("SELECT family, o_orderkey, round(max(st) OVER (PARTITION BY family ORDER BY p_value, o_orderkey ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, o_orderkey) + 1) * p_value) AS st FROM (SELECT o_orderpriority AS family, o_orderkey, (o_orderkey * 7919 % 1000) / 1e6 AS p_value FROM orders))")
def holm_adjusted(spark, d):
    p = read(spark, d, "orders").select(F.col("o_orderpriority").alias("family"), "o_orderkey", ((F.col("o_orderkey") * 7919 % 1000) / F.lit(1e6)).alias("p_value"))
    return rounded(statistics.holm(p, ("family",), "o_orderkey").select("family", "o_orderkey", "adjusted"), 9)


@query()
def bootstrap_and_sign_flip(spark, d):
    return statistics.resampled(_diffs(spark, d), 1000, 17, "unit")


_FLIPS = """SELECT f.method_a, f.method_b, count(*) AS flips, CAST(count(*) FILTER (abs(fs) >= seen) AS DOUBLE) / count(*) AS p_value FROM (SELECT method_a, method_b, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN q ELSE -q END) AS fs FROM (SELECT *, unnest(range(CAST(pow(2, n) AS BIGINT))) AS mask FROM small) GROUP BY ALL) f JOIN (SELECT method_a, method_b, abs(sum(q)) AS seen FROM small GROUP BY ALL) s ON s.method_a = f.method_a AND s.method_b = f.method_b GROUP BY ALL"""
_SMALL = "small AS (SELECT *, CAST(row_number() OVER (PARTITION BY method_a, method_b ORDER BY unit) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY method_a, method_b) AS n, CAST(round(difference * 1e6) AS BIGINT) AS q FROM diffs2)"


@query(sql(_FLIPS, "diffs2", recursive=_SMALL).replace("l_suppkey AS unit", "l_linenumber AS unit"))
def exact_sign_flip(spark, d):
    """Units are line numbers, few enough for all flips."""
    return statistics.sign_flip(_diffs(spark, d, "l_linenumber"), 1000, 17)


@query()
def sampled_sign_flip(spark, d):
    """Over all suppliers: exact for pairs of few units, sampled flips for larger ones."""
    return statistics.sign_flip(_diffs(spark, d), 1000, 17)


_BUDGET = "SELECT p_brand AS family, p_name AS configuration, p_retailprice AS budget, target, CASE WHEN p_retailprice = target THEN 'equal' WHEN p_retailprice <= target THEN 'under' ELSE 'over' END AS relation, round(p_retailprice - target, 6) AS mismatch FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, target ORDER BY (p_retailprice <= target) DESC, CASE WHEN p_retailprice <= target THEN -p_retailprice ELSE p_retailprice END, p_name) AS r FROM part, (SELECT unnest([500.0::DOUBLE, 1000.0, 1500.0, 5000.0]) AS target)) WHERE r = 1"


@query(_BUDGET)
def matched_budgets(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_name").alias("configuration"), F.col("p_retailprice").alias("budget"))
    return rounded(statistics.match_budgets(p, spark.createDataFrame([(500.0,), (1000.0,), (1500.0,), (5000.0,)], "target double")))


def _wide(c: str) -> str:
    s = f"CAST(sum(CAST(round({c} * 1e6) AS BIGINT)) AS DOUBLE) / 1e6"
    return f"SELECT l_returnflag, '{c}' AS metric, count({c}) AS \"count\", round({s} / count({c}), 5) AS mean, round(quantile_cont({c}, 0.5), 5) AS median, round(stddev_samp({c}), 5) AS sd, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 5) AS iqr, round(min({c}), 5) AS minimum, round(max({c}), 5) AS maximum FROM lineitem GROUP BY l_returnflag"


@query(" UNION ALL ".join(_wide(c) for c in ("l_quantity", "l_discount", "l_tax")))
def described_metrics(spark, d):
    return rounded(statistics.describe_wide(read(spark, d, "lineitem"), ("l_returnflag",), ("l_quantity", "l_discount", "l_tax")), 5)


@query("SELECT coalesce(l_returnflag, 'all') AS role, coalesce(l_linestatus, 'all') AS status, count(*) AS n, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS BIGINT) AS quantity_cents FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_overall(spark, d):
    r = read(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_quantity") * 100).cast("long")).alias("quantity_cents"))
    return r.select(F.coalesce("l_returnflag", F.lit("all")).alias("role"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity_cents")


@query("SELECT n_name, CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'single' ELSE 'mixed' END AS stratum, customers FROM (SELECT n_name, count(DISTINCT c_mktsegment) AS k, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)")
def strata(spark, d):
    c = read(spark, d, "customer")
    j = read(spark, d, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.size(F.collect_set("c_mktsegment")).alias("k"), F.count("c_custkey").alias("customers"))
    return j.select("n_name", F.when(F.col("k") == 0, "none").when(F.col("k") == 1, "single").otherwise("mixed").alias("stratum"), "customers")


@query("SELECT s_suppkey, CASE WHEN abs(e) < 0.2 THEN 'negligible' WHEN abs(e) < 0.5 THEN 'small' WHEN abs(e) < 0.8 THEN 'moderate' ELSE 'large' END AS magnitude FROM (SELECT s_suppkey, s_acctbal / 10000 AS e FROM supplier)")
def practical_magnitudes(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", motion.practical_magnitude(F.col("s_acctbal") / 10000).alias("magnitude"))


@query("SELECT o_orderkey, 'order:' || o_orderkey AS identifier, 'unit-' || substr(sha256('wayfold|unit|' || o_orderkey), 1, 16) AS safe FROM orders")
def identifiers(spark, d):
    o = read(spark, d, "orders")
    return o.select("o_orderkey", identity.identifier("order", F.col("o_orderkey")).alias("identifier"), identity.safe_identifier("unit", F.col("o_orderkey")).alias("safe"))


@query(f"SELECT o_orderkey, round(((a % (2 * {PI}) + 2 * {PI}) % (2 * {PI})) - {PI}, 6) AS heading FROM (SELECT o_orderkey, o_totalprice / 1000 + {PI} AS a FROM orders)")
def wrapped_headings(spark, d):
    return rounded(read(spark, d, "orders").select("o_orderkey", motion.wrap(F.col("o_totalprice") / 1000).alias("heading")))


# --- feasibility of layouts ----------------------------------------------------------------------------------------

FEASIBILITY = feasibility.FeasibilityConfig(cell_m=20.0, end_cell_m=25.0, end_exclusion_m=1.0, turn_radius_m=3.0, turn_rad=1.0, start_m=80, end_m=80, mean_m=80, maximum_m=150)


def _paths(spark, d):
    """All runs that move, as paths of eight points."""
    p = layout.resample(_valid(spark, d), 8).groupBy(*layout.RUN).agg(F.array_sort(F.collect_list(F.struct("point", "x_m", "y_m"))).alias("path"))
    return p.select("scenario_id", F.col("trajectory_id").alias("track"), "run_index", "path")


_PTS = "pts AS (SELECT scenario_id, trajectory_id AS track, run_index, point, x_m, y_m FROM (RESAMPLE))".replace("RESAMPLE", _RESAMPLE.replace("round(x0", "(x0").replace("round(y0", "(y0").replace(", 4) AS", ") AS"))


@query(sql("SELECT c.scenario_id, count(*) AS occupied_cells, count(*) FILTER (n >= 2) AS repeated_cells, coalesce(max(t.k), 0) AS supported_tracks FROM (SELECT scenario_id, cx, cy, count(*) AS n FROM at_ GROUP BY ALL) c LEFT JOIN (SELECT a.scenario_id, count(DISTINCT a.track) AS k FROM at_ a JOIN at_ b ON a.scenario_id = b.scenario_id AND a.cx = b.cx AND a.cy = b.cy AND a.track <> b.track GROUP BY ALL) t ON t.scenario_id = c.scenario_id GROUP BY c.scenario_id", "lengths", recursive=_PTS + ", at_ AS (SELECT DISTINCT scenario_id, track, CAST(floor(x_m / 20) AS BIGINT) AS cx, CAST(floor(y_m / 20) AS BIGINT) AS cy FROM pts)"))
def shared_cells(spark, d):
    return feasibility.shared_cells(_paths(spark, d), FEASIBILITY)


_SIDE = "SELECT scenario_id, count(*) FILTER (n >= 2) AS {0}, count(*) FILTER (n >= 2 AND m >= 2) AS {1} FROM (SELECT scenario_id, {2}, count(DISTINCT track) AS n, count(DISTINCT {3}) AS m FROM ends_ GROUP BY scenario_id, {2}) GROUP BY scenario_id"


@query(sql("SELECT a.scenario_id, repeated_starts, splits, repeated_ends, merges FROM (" + _SIDE.format("repeated_starts", "splits", "s", "e") + ") a JOIN (" + _SIDE.format("repeated_ends", "merges", "e", "s") + ") b ON a.scenario_id = b.scenario_id", "lengths", recursive=_PTS + ", ends_ AS (SELECT scenario_id, track, run_index, max((floor(x_m / 25), floor(y_m / 25))) FILTER (point = 0) AS s, max((floor(x_m / 25), floor(y_m / 25))) FILTER (point = 7) AS e FROM pts GROUP BY ALL)"))
def shared_ends(spark, d):
    return feasibility.shared_ends(_paths(spark, d), FEASIBILITY)


_CROSS = """, pc AS (SELECT *, lead(x_m) OVER w AS x1, lead(y_m) OVER w AS y1, first_value(x_m) OVER v AS fx, first_value(y_m) OVER v AS fy, last_value(x_m) OVER v AS lx, last_value(y_m) OVER v AS ly FROM pts WINDOW w AS (PARTITION BY scenario_id, track ORDER BY point), v AS (PARTITION BY scenario_id, track ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
hit2 AS (SELECT *, ax + u * (ax1 - ax) AS x, ay + u * (ay1 - ay) AS y FROM (SELECT *, ((bx - ax) * (by1 - by_) - (by_ - ay) * (bx1 - bx)) / nullif(det, 0) AS u, ((bx - ax) * (ay1 - ay) - (by_ - ay) * (ax1 - ax)) / nullif(det, 0) AS v FROM (SELECT a.scenario_id, a.x_m AS ax, a.y_m AS ay, a.x1 AS ax1, a.y1 AS ay1, b.x_m AS bx, b.y_m AS by_, b.x1 AS bx1, b.y1 AS by1, a.fx AS afx, a.fy AS afy, a.lx AS alx, a.ly AS aly, b.fx AS bfx, b.fy AS bfy, b.lx AS blx, b.ly AS bly, (a.x1 - a.x_m) * (b.y1 - b.y_m) - (a.y1 - a.y_m) * (b.x1 - b.x_m) AS det FROM pc a JOIN pc b ON a.scenario_id = b.scenario_id AND a.track < b.track WHERE a.x1 IS NOT NULL AND b.x1 IS NOT NULL)) WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1),
kept AS (SELECT * FROM hit2 WHERE least(sqrt((x-afx)^2+(y-afy)^2), sqrt((x-alx)^2+(y-aly)^2), sqrt((x-bfx)^2+(y-bfy)^2), sqrt((x-blx)^2+(y-bly)^2)) > 1),
tv AS (SELECT scenario_id, x_m AS tx, y_m AS ty FROM (SELECT *, h - lag(h) OVER (PARTITION BY scenario_id, track ORDER BY point) AS dh FROM (SELECT *, atan2(y1 - y_m, x1 - x_m) AS h FROM pc WHERE x1 IS NOT NULL)) WHERE abs(atan2(sin(dh), cos(dh))) >= 1.0)"""


@query(sql("SELECT scenario_id, CAST(round_even(x, 0) AS BIGINT) AS x, CAST(round_even(y, 0) AS BIGINT) AS y, CASE WHEN bool_or(EXISTS (SELECT 1 FROM tv WHERE tv.scenario_id = kept.scenario_id AND sqrt((x - tx)^2 + (y - ty)^2) <= 3)) THEN 'observed_transition_supported' ELSE 'geometric_only_ambiguous' END AS reading FROM kept GROUP BY 1, 2, 3", "lengths", recursive=_PTS.replace("trajectory_id AS track", "trajectory_id || '#' || run_index AS track") + _CROSS))
def crossings(spark, d):
    return feasibility.crossings(_paths(spark, d), FEASIBILITY)


@query()
def support_groups(spark, d):
    p = _paths(spark, d)
    return feasibility.support_groups(spark, p, feasibility.linking_pairs(spark, p, FEASIBILITY))


# --- tapes and campaigns -------------------------------------------------------------------------------------------


def _tape(spark, d):
    s = bindings.samples(spark, d)
    segs = _segments(spark, d)
    agents = s.select("scenario_id", "agent_id", F.lit("vehicle").alias("agent_class")).distinct()
    tracks = tape.track_table(s, segs, agents, "uniform-5")
    return tape.tape_table(tracks, "uniform-5", "1", "events", "stride=5"), tracks, tape.segment_table(segs, "uniform-5")


@query("SELECT CAST('' AS VARCHAR) AS \"table\", CAST('' AS VARCHAR) AS key, CAST('' AS VARCHAR) AS problem WHERE false")
def tape_problems(spark, d):
    return tape.tape_problems(*_tape(spark, d))


@query(sql("SELECT s.scenario_id, count(DISTINCT s.trajectory_id) AS track_count, CAST(max(k) AS BIGINT) AS segment_count, count(*) AS source_sample_count, count(*) FILTER (is_valid) AS encoded_valid_sample_count, bool_or(is_valid AND z_m IS NOT NULL) AS has_elevation FROM samples s JOIN (SELECT scenario_id, count(*) AS k FROM segs GROUP BY ALL) g ON g.scenario_id = s.scenario_id GROUP BY s.scenario_id", "samples", "segs"))
def tape_manifest(spark, d):
    return _tape(spark, d)[0].select("scenario_id", F.col("track_count").cast("long").alias("track_count"), F.col("segment_count").cast("long").alias("segment_count"), "source_sample_count", "encoded_valid_sample_count", "has_elevation")


ENCODERS = {
    "exact": sequence.exact_segments,
    "uniform-2": lambda v: sequence.segments(sequence.uniform_keyframes(v, 2)),
    "uniform-5": lambda v: sequence.segments(sequence.uniform_keyframes(v, 5)),
    "linear-20": lambda v: codecs.encode_linear(v, 20.0),
}


def _campaign(spark, d):
    v = _valid(spark, d)
    return campaign.ratios(campaign.execute(v, ENCODERS), sequence.exact_segments(v), v)


@query()
def campaign_ratios(spark, d):
    return _campaign(spark, d)


@query()
def campaign_totals(spark, d):
    return campaign.configuration_totals(_campaign(spark, d))


@query()
def campaign_comparisons(spark, d):
    return campaign.compare(_campaign(spark, d), "segment_ratio", {k: i for i, k in enumerate(ENCODERS)})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, keyframes, segments, replay and error statistics over one table of events."""
    return error_stats_micro(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


from . import analysis  # noqa: E402, F401 - registers its queries
