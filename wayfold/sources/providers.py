"""Adapters of provider files: motion Parquet (a row per track and time step) and lane maps in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import wkb_linestring, wkb_polygon
from ..functions.motion import wrap

#: Columns a motion file must have (fixed values).
MOTION_COLUMNS = ("observed", "track_id", "object_type", "object_category", "timestep", "position_x", "position_y", "heading", "velocity_x", "velocity_y", "scenario_id", "start_timestamp", "end_timestamp", "num_timestamps", "focal_track_id", "city")
#: Provider object types by agent class (fixed values).
AGENT_CLASS = {
    "vehicle": "vehicle", "bus": "vehicle", "pedestrian": "pedestrian", "cyclist": "cyclist", "motorcyclist": "other_dynamic", "unknown": "unknown",
    "static": "unknown", "background": "unknown", "construction": "unknown", "riderless_bicycle": "unknown",
}


def check_motion_schema(schema: T.StructType) -> None:
    missing = [c for c in MOTION_COLUMNS if c not in schema.fieldNames()]
    if missing:
        raise ValueError(f"motion source lacks {missing}")
    for c in ("start_timestamp", "end_timestamp"):
        if not isinstance(schema[c].dataType, (T.IntegerType, T.LongType, T.DoubleType)):
            raise ValueError(f"{c} must be whole numbers")


def motion_problems(rows: DataFrame) -> DataFrame:
    """Tracks with several types or categories, repeated steps, or a time grid that isn't whole."""
    g = rows.groupBy("scenario_id", F.trim("track_id").alias("track_id")).agg(
        F.count_distinct("object_type").alias("types"), F.count_distinct("object_category").alias("categories"), F.count("*").alias("rows"), F.count_distinct("timestep").alias("steps"),
        F.bool_or((F.col("num_timestamps") < 2) | (F.pmod(F.col("end_timestamp").cast("long") - F.col("start_timestamp").cast("long"), F.col("num_timestamps").cast("long") - 1) != 0)).alias("grid"),
        F.bool_or((F.col("timestep") < 0) | (F.col("timestep") >= F.col("num_timestamps"))).alias("outside"),
    )
    problem = F.when(F.col("types") > 1, "object_type").when(F.col("categories") > 1, "object_category").when(F.col("rows") > F.col("steps"), "repeated_step").when(F.col("grid"), "time_grid").when(F.col("outside"), "step_outside")
    return g.withColumn("problem", problem).where("problem is not null").select("scenario_id", "track_id", "problem")


def motion_samples(rows: DataFrame) -> DataFrame:
    """trajectory_samples; the origin is the focal track's first state, x and y are relative to it."""
    check_motion_schema(rows.schema)
    r = rows.withColumn("track_id", F.trim("track_id"))
    origin = r.where(F.col("track_id") == F.trim("focal_track_id")).groupBy("scenario_id").agg(F.min_by(F.struct("position_x", "position_y"), "timestep").alias("o"))
    w = Window.partitionBy("scenario_id", "track_id").orderBy("timestep")
    step = (F.col("end_timestamp").cast("long") - F.col("start_timestamp").cast("long")) / (F.col("num_timestamps").cast("long") - 1)
    key = lambda kind, *p: F.concat_ws(":", F.lit(kind), *p)
    null = F.lit(None).cast("double")
    return r.join(origin, "scenario_id").select(
        key("scenario", "scenario_id").alias("scenario_id"), key("agent", "scenario_id", "track_id").alias("agent_id"), key("trajectory", "scenario_id", "track_id").alias("trajectory_id"),
        (F.row_number().over(w) - 1).cast("int").alias("sample_index"), (F.col("start_timestamp").cast("long") + F.col("timestep") * F.round(step).cast("long")).alias("timestamp_ns"),
        (F.col("position_x") - F.col("o.position_x")).alias("x_m"), (F.col("position_y") - F.col("o.position_y")).alias("y_m"), null.alias("z_m"), wrap(F.col("heading")).alias("heading_rad"),
        F.col("velocity_x").alias("velocity_x_mps"), F.col("velocity_y").alias("velocity_y_mps"), F.hypot("velocity_x", "velocity_y").alias("speed_mps"), null.alias("acceleration_x_mps2"), null.alias("acceleration_y_mps2"),
        F.col("observed").alias("is_observed"), F.lit(True).alias("is_valid"), F.lit("source_ground_truth").alias("origin_type"), F.array().cast("array<string>").alias("quality_flags"),
    )


def motion_agents(rows: DataFrame) -> DataFrame:
    """agent_id, agent_class, time bounds and samples of each track."""
    classes = F.create_map(*[F.lit(x) for kv in AGENT_CLASS.items() for x in kv])
    s = motion_samples(rows).groupBy("scenario_id", "agent_id").agg(F.min("timestamp_ns").alias("first_time_ns"), F.max("timestamp_ns").alias("last_time_ns"), F.count("*").cast("int").alias("sample_count"))
    k = rows.groupBy(F.concat_ws(":", F.lit("agent"), "scenario_id", F.trim("track_id")).alias("agent_id")).agg(classes[F.min("object_type")].alias("agent_class"), F.bool_or(F.trim("track_id") == F.trim("focal_track_id")).alias("is_focal_agent"))
    return s.join(k, "agent_id")


def resample_points(points: Column, count: Column) -> Column:
    """`count` points at equal steps of arc length along an array of (x, y, z); the ends stay as they are.

    In columns only: running lengths by `aggregate`, then for each target the piece that holds it.  A line without
    length gives null.
    """
    step = lambda p, q: F.sqrt(sum((q[c] - p[c]) * (q[c] - p[c]) for c in "xyz"))
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: step(points[i - 1], points[i]))
    along = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))

    def of(t: Column) -> Column:
        p, s, n = t["p"], t["s"], t["n"]
        total = F.element_at(s, -1)

        def at(k: Column) -> Column:
            target = total * k / (n - 1)
            i = F.greatest(F.lit(1), F.least(F.size(F.filter(s, lambda v: v < target)), F.size(p) - 1)) - 1
            u = (target - s[i]) / F.nullif(s[i + 1] - s[i], F.lit(0.0))
            return F.struct(*[F.when(k == 0, p[0][c]).when(k == n - 1, F.element_at(p, -1)[c]).otherwise(p[i][c] + (p[i + 1][c] - p[i][c]) * u).alias(c) for c in "xyz"])

        return F.when(total > 0, F.transform(F.sequence(F.lit(0), n - 1), at))

    named = F.struct(points.alias("p"), along.alias("s"), count.cast("int").alias("n"))
    return F.when(F.size(points) > 1, F.transform(F.array(named), of)[0])


#: Points of a centerline (fixed value).
CENTERLINE_POINTS = 50


def midline(left: Column, right: Column, count: int = CENTERLINE_POINTS) -> Column:
    """The mean of two boundaries, each at equal steps of its own length."""
    n = F.lit(count)
    return F.zip_with(resample_points(left, n), resample_points(right, n), lambda p, q: F.struct(*[((p[c] + q[c]) / 2).alias(c) for c in "xyz"]))


def sample_line(points: Column, interval: float) -> Column:
    """Points at equal steps of at most `interval` along an array of (x, y, z), both ends included; null without length."""
    step = lambda p, q: F.sqrt(sum((q[c] - p[c]) * (q[c] - p[c]) for c in "xyz"))
    length = F.aggregate(F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: step(points[i - 1], points[i])), F.lit(0.0), lambda s, d: s + d)
    return resample_points(points, F.greatest(F.lit(2), F.ceil(length / interval) + 1))


_POINT = "struct<x:double,y:double,z:double>"
_MAP = f"""lane_segments map<string,struct<id:long,is_intersection:boolean,lane_type:string,left_lane_boundary:array<{_POINT}>,right_lane_boundary:array<{_POINT}>,left_lane_mark_type:string,right_lane_mark_type:string,left_neighbor_id:long,right_neighbor_id:long,predecessors:array<long>,successors:array<long>>>,
drivable_areas map<string,struct<id:long,area_boundary:array<{_POINT}>>>, pedestrian_crossings map<string,struct<id:long,edge1:array<{_POINT}>,edge2:array<{_POINT}>>>"""


def map_elements(spark: SparkSession, path: str, scenario: str, centerline_points: int = CENTERLINE_POINTS) -> DataFrame:
    """Lane boundaries, drivable areas and crossings of a map file, with WKB; references that leave the map are kept apart."""
    m = spark.read.schema(_MAP.replace("\n", " ")).json(path, multiLine=True)
    ids = F.transform(F.map_values("lane_segments"), lambda s: s["id"])
    lanes = m.select(ids.alias("known"), F.explode(F.map_values("lane_segments")).alias("l"))
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    refs = lambda c: F.transform(F.array_intersect(c, F.col("known")), lambda i: F.concat(F.lit("lane:"), i.cast("string")))
    none, no_refs = F.lit(None).cast("string"), F.array().cast("array<string>")

    def rows(df, element, kind, wkb, direction, geometry, parent=none, succ=no_refs, pred=no_refs, left=none, right=none, outside=no_refs):
        return df.select(F.lit(scenario).alias("scenario_id"), element.alias("map_element_id"), F.lit(kind).alias("element_type"), F.lit(geometry).alias("geometry_type"), wkb.alias("geometry_wkb"), F.lit(direction).alias("directionality"), parent.alias("parent_element_id"), succ.alias("successor_ids"), pred.alias("predecessor_ids"), left.alias("left_neighbor_id"), right.alias("right_neighbor_id"), outside.alias("external_ids"))

    near = lambda c: F.when(F.array_contains("known", c), name("lane", c))
    outside = F.transform(F.array_except(F.array_union(F.col("l.successors"), F.col("l.predecessors")), F.col("known")), lambda i: i.cast("string"))
    # made row by row (explode of one), as a Python UDF takes columns that are there already
    lanes = lanes.withColumn("middle", F.explode(F.array(midline(F.col("l.left_lane_boundary"), F.col("l.right_lane_boundary"), centerline_points))))
    middle = F.col("middle")
    out = [rows(lanes, name("lane", F.col("l.id")), "lane_centerline", wkb_linestring(middle), "directed", "linestring", succ=refs(F.col("l.successors")), pred=refs(F.col("l.predecessors")), left=near(F.col("l.left_neighbor_id")), right=near(F.col("l.right_neighbor_id")), outside=outside)]
    for side in ("left", "right"):
        out.append(rows(lanes, name(f"boundary:{side}", F.col("l.id")), "lane_boundary", wkb_linestring(F.col(f"l.{side}_lane_boundary")), "not_applicable", "linestring", parent=name("lane", F.col("l.id"))))
    areas = m.select(F.explode(F.map_values("drivable_areas")).alias("a"))
    out.append(rows(areas, name("area", F.col("a.id")), "road_area", wkb_polygon(F.col("a.area_boundary")), "not_applicable", "polygon"))
    walks = m.select(F.explode(F.map_values("pedestrian_crossings")).alias("c"))
    out.append(rows(walks, name("crossing", F.col("c.id")), "crosswalk", wkb_polygon(F.concat(F.col("c.edge1"), F.reverse(F.col("c.edge2")))), "bidirectional", "polygon"))
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first


def map_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("scenario_id", "element_type").agg(F.count("*").alias("elements"))
