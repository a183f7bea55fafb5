"""Campaigns: many configurations over many tracks in one plan; ratios, budgets, comparisons, strata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, sequence, statistics
from .sequence import TRACK

Encoder = Callable[[DataFrame], DataFrame]


def execute(valid: DataFrame, encoders: dict[str, Encoder]) -> DataFrame:
    """One row a configuration and track: segments, keyframes, position error statistics, missing states.

    A configuration is one branch of the plan, so all of them share the scan, and each runs over all tracks at once.
    """
    out = None
    for name, encode in encoders.items():
        segs = encode(valid)
        n = segs.groupBy(*TRACK).agg(F.count("*").alias("segments")).join(sequence.keyframe_count(segs), list(TRACK))
        m = metrics.track_metrics(metrics.errors(valid, segs)).join(n, list(TRACK)).withColumn("configuration", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def ratios(rows: DataFrame, exact: DataFrame, valid: DataFrame) -> DataFrame:
    """Per configuration and scenario: sums and ratios of segments to exact segments and keyframes to valid samples; 0 over 0 is 0."""
    e = exact.groupBy("scenario_id").agg(F.count("*").alias("exact_segments"))
    v = valid.groupBy("scenario_id").agg(F.count("*").alias("valid_samples"))
    g = rows.groupBy("configuration", "scenario_id").agg(F.sum("segments").alias("segments"), F.sum("keyframe_count").alias("keyframes"), F.max("position.maximum").alias("maximum_error_m"))
    j = g.join(e, "scenario_id").join(v, "scenario_id")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0))), F.lit(0.0))
    return j.withColumns({"segment_ratio": share("segments", "exact_segments"), "keyframe_ratio": share("keyframes", "valid_samples")})


def configuration_totals(per_scenario: DataFrame) -> DataFrame:
    """Per configuration: ratios of sums over scenarios."""
    g = per_scenario.groupBy("configuration").agg(*[F.sum(c).alias(c) for c in ("segments", "keyframes", "exact_segments", "valid_samples")], F.max("maximum_error_m").alias("maximum_error_m"))
    return g.withColumns({"segment_ratio": F.col("segments") / F.col("exact_segments"), "keyframe_ratio": F.col("keyframes") / F.col("valid_samples")})


def budget_ranges(totals: DataFrame, family: str = "family") -> DataFrame:
    return totals.groupBy(family).agg(*[f(c).alias(f"{n}_{c}") for c in ("segment_ratio", "keyframe_ratio") for n, f in (("least", F.min), ("most", F.max))], F.count("*").alias("configurations"))


def compare(per_scenario: DataFrame, metric: str, order: dict[str, int], resamples: int = 1000, seed: int = 17) -> DataFrame:
    """Every two configurations on one metric over scenarios: effects, ranks, interval, p-value, and p adjusted over all pairs."""
    spark = per_scenario.sparkSession
    m = per_scenario.select(F.col("configuration").alias("method"), F.col("scenario_id").alias("unit"), F.col(metric).cast("double").alias("value"))
    methods = spark.createDataFrame(list(order.items()), "method string, place int")
    d = statistics.paired_differences(m, methods, "unit")
    j = statistics.effects(d).join(statistics.rank_biserial(d), list(statistics.PAIR), "left").join(statistics.resampled(d, resamples, seed, "unit"), list(statistics.PAIR))
    j = j.withColumns({"metric": F.lit(metric), "pair": F.concat_ws("|", *statistics.PAIR)})
    return statistics.holm(j, ("metric",), "pair").drop("pair")


def consistency(first: DataFrame, second: DataFrame) -> DataFrame:
    """Comparisons made twice (method_a, method_b, metric, mean, low, high): same sign, overlapping intervals."""
    key = [*statistics.PAIR, "metric"]
    a, b = (df.select(*key, *[F.col(c).alias(f"{c}_{k}") for c in ("mean", "low", "high")]) for df, k in ((first, 1), (second, 2)))
    return a.join(b, key).withColumns({"same_sign": F.signum("mean_1") == F.signum("mean_2"), "overlap": (F.col("low_1") <= F.col("high_2")) & (F.col("low_2") <= F.col("high_1"))})


def multiplicity(comparisons: DataFrame, level: float = 0.05) -> DataFrame:
    """Per metric: tests, and how many are significant before and after adjustment."""
    return comparisons.groupBy("metric").agg(F.count("*").alias("tests"), F.count_if(F.col("p_value") < level).alias("raw"), F.count_if(F.col("adjusted") < level).alias("adjusted"))


def agreement(strata: DataFrame, overall: DataFrame) -> DataFrame:
    """strata (stratum, metric, effect) against overall (metric, effect): how often the direction agrees."""
    o = overall.select("metric", F.col("effect").alias("whole"))
    return strata.join(o, "metric").groupBy("metric").agg(F.count("*").alias("strata"), F.count_if(F.signum("effect") == F.signum("whole")).alias("agree"))


def failures_first(attempts: DataFrame) -> DataFrame:
    """Per configuration: units that completed, failed or never ran."""
    return attempts.groupBy("configuration").pivot("state", ["completed", "failed", "pending"]).agg(F.count("unit")).na.fill(0)


def execution_order(configurations: DataFrame, units: DataFrame) -> DataFrame:
    """All (configuration, unit) pairs, configuration by configuration, units by rank; both are declared lists."""
    w = Window.orderBy("place", "rank", "unit")
    return configurations.crossJoin(F.broadcast(units)).withColumn("step", F.row_number().over(w) - 1)
