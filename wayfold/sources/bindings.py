"""Canonical tables drawn from the test tables: `events` as trajectory samples, others as agents, scenarios and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trajectory_samples from events: a user is a trajectory; ten hours become one second."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    by_user = Window.partitionBy("user_id")
    e = e.withColumns({"k": k, "us": F.unix_micros(F.col("ts").cast("timestamp"))})
    e = e.withColumns({"first_us": F.min("us").over(by_user), "n": F.row_number().over(by_user.orderBy("ts", "event_id"))})
    us = (F.col("us") - F.col("first_us")) * 1000
    text = F.col("user_id").cast("string")
    null = F.lit(None).cast("double")
    return e.select(
        F.concat(F.lit("scenario:"), F.pmod("user_id", F.lit(10)).cast("string")).alias("scenario_id"),
        F.concat(F.lit("agent:"), text).alias("agent_id"), F.concat(F.lit("trajectory:"), text).alias("trajectory_id"),
        (F.col("n") - 1).cast("int").alias("sample_index"), F.floor(us / 36000).cast("long").alias("timestamp_ns"),
        F.col("value").alias("x_m"), F.col("k").cast("double").alias("y_m"),
        F.when((F.col("user_id") % 3 == 0) & (F.col("event_type") != "view"), F.col("value") / 10).alias("z_m"),
        F.when(F.col("k") % 5 != 0, (F.col("k") % 63) / F.lit(10.0) - F.lit(3.1)).alias("heading_rad"),
        F.when(F.col("k") % 7 != 0, F.col("k") - F.lit(50.0)).alias("velocity_x_mps"),
        F.when(F.col("k") % 7 != 0, F.col("value") / 10 - 20).alias("velocity_y_mps"),
        F.when(F.col("k") % 3 == 0, F.col("value") / 8).alias("speed_mps"),
        null.alias("acceleration_x_mps2"), null.alias("acceleration_y_mps2"), F.lit(True).alias("is_observed"),
        (F.col("event_type") != "error").alias("is_valid"), F.lit("source").alias("origin_type"), F.array().cast("array<string>").alias("quality_flags"),
    )


#: The same binding in DuckDB, as the first CTEs of every oracle that needs it.
SAMPLES_SQL = """ev AS (SELECT *, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
samples AS (SELECT 'scenario:' || (user_id % 10) AS scenario_id, 'agent:' || user_id AS agent_id, 'trajectory:' || user_id AS trajectory_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS sample_index,
  ((us - min(us) OVER (PARTITION BY user_id)) * 1000) // 36000 AS timestamp_ns, value AS x_m, CAST(k AS DOUBLE) AS y_m,
  CASE WHEN user_id % 3 = 0 AND event_type <> 'view' THEN value / 10 END AS z_m,
  CASE WHEN k % 5 <> 0 THEN (k % 63) / CAST(10.0 AS DOUBLE) - CAST(3.1 AS DOUBLE) END AS heading_rad,
  CASE WHEN k % 7 <> 0 THEN CAST(k AS DOUBLE) - 50 END AS velocity_x_mps,
  CASE WHEN k % 7 <> 0 THEN value / 10 - 20 END AS velocity_y_mps,
  CASE WHEN k % 3 = 0 THEN value / 8 END AS speed_mps, event_type <> 'error' AS is_valid FROM ev)"""
