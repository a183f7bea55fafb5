"""Choosing from ranked tables: cohort roles, budget targets, conditions, scenarios and trajectories to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import match_budgets


def cohort_role(units: DataFrame, role: str, count: int) -> DataFrame:
    """The first `count` included units of a role in rank order; units: (unit, role, rank, included).

    The filter reaches the scan (and prunes a table partitioned by role), the limit is a top-k.
    """
    return units.where((F.col("role") == role) & F.col("included") & (F.col("rank") <= count)).orderBy("rank").limit(count)


def rank_problems(units: DataFrame) -> DataFrame:
    """Roles whose ranks aren't 1 to n once each, or that hold a unit twice; units of two roles come under role null."""
    by_role = units.groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("unit").alias("units"))
    problem = F.when(F.col("units") < F.col("n"), "repeated_unit").when((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("ranks") < F.col("n")), "ranks")
    own = by_role.select("role", problem.alias("problem")).where("problem is not null")
    shared = units.groupBy("unit").agg(F.count_distinct("role").alias("roles")).where("roles > 1").agg(F.count("*").alias("k")).where("k > 0")
    return own.unionByName(shared.select(F.lit(None).cast("string").alias("role"), F.lit("shared_unit").alias("problem")))


def budget_selections(configs: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target the nearest configuration under it of every included family, and whether it is near enough.

    configs: (family, configuration, one column a dimension); targets, a declared short list: (dimension, target,
    families array, maximum_mismatch, priority).  A family that a target names but no configuration has comes with a
    null configuration.
    """
    names = [c for c in configs.columns if c not in ("family", "configuration")]
    long = configs.unpivot(["family", "configuration"], names, "dimension", "budget")
    wanted = targets.select("dimension", "target", "maximum_mismatch", "priority", F.explode("families").alias("family"))
    j = long.join(F.broadcast(wanted), ["dimension", "family"])
    under = F.col("budget") <= F.col("target")
    order = F.struct((~under).alias("over"), F.when(under, -F.col("budget")).otherwise(F.col("budget")).alias("far"), "configuration")
    keys = ["dimension", "target", "priority", "family"]
    best = j.groupBy(*keys).agg(F.min_by(F.struct("configuration", "budget"), order).alias("b"))
    out = wanted.join(best, keys, "left").select(*keys, "maximum_mismatch", "b.configuration", "b.budget")
    mismatch = F.abs(F.col("budget") - F.col("target"))
    return out.withColumns({
        "relation": F.when(F.col("budget") == F.col("target"), "equal").when(F.col("budget") < F.col("target"), "below").when(F.col("budget").isNotNull(), "above"),
        "mismatch": mismatch, "accepted": F.coalesce(mismatch <= F.col("maximum_mismatch"), F.lit(False)),
    })


def condition_problems(selections: DataFrame, expected: DataFrame) -> DataFrame:
    """Conditions (role, dimension, target, priority) whose selected families aren't the expected ones.

    expected: (dimension, target, priority, families array), one row a condition; selections also has role and family.
    """
    got = selections.groupBy("role", "dimension", "target", "priority").agg(F.array_sort(F.collect_list("family")).alias("got"))
    every = selections.select("role").distinct().join(F.broadcast(expected))  # roles by conditions, both short lists
    j = every.join(got, ["role", "dimension", "target", "priority"], "left")
    return j.where(~F.array_sort("families").eqNullSafe(F.col("got"))).select("role", "dimension", "target", "priority", "got")


#: The rules that pick an example: first and last take the ends of the order, median the lower middle.
RULES = ("smallest", "median", "largest")


def pick_examples(candidates: DataFrame, rules: list[tuple[str, str, str]], identity: str) -> DataFrame:
    """(category, metric, value, and identity) of the candidate each rule (category, metric, one of RULES) picks.

    One pass: the metrics become rows, are ranked once each, and every rule is a filter on the rank.  Ties go to the
    smaller identity; null values don't take part.
    """
    spark = candidates.sparkSession
    metrics = sorted({m for _, m, _ in rules})
    long = candidates.unpivot([identity], metrics, "metric", "value").where("value is not null")
    w = Window.partitionBy("metric")
    ranked = long.withColumns({"up": F.row_number().over(w.orderBy("value", identity)), "down": F.row_number().over(w.orderBy(F.desc("value"), identity)), "n": F.count("*").over(w)})
    table = F.broadcast(spark.createDataFrame(rules, "category string, metric string, rule string"))
    place = F.when(F.col("rule") == "smallest", F.col("up") == 1).when(F.col("rule") == "largest", F.col("down") == 1).otherwise(F.col("up") == F.floor((F.col("n") - 1) / 2) + 1)
    return ranked.join(table, "metric").where(place).select("category", "metric", identity, "value")


def disagreement_examples(rows: DataFrame, top: int = 2) -> DataFrame:
    """Per family and metric the `top` strata with the largest effects against the overall sign, each with its smallest |effect| beside it.

    rows: (family, metric, stratum, unit, effect, overall).
    """
    against = F.signum("effect") * F.signum("overall") < 0
    w = Window.partitionBy("family", "metric").orderBy(F.desc(F.abs("effect")), "stratum", "unit")
    strong = rows.where(against).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    low = rows.groupBy("family", "metric", "stratum").agg(F.min_by(F.struct("unit", "effect"), F.struct(F.abs("effect").alias("size"), "unit")).alias("least"))
    return strong.join(low, ["family", "metric", "stratum"]).select("family", "metric", "stratum", "place", "unit", "effect", F.col("least.unit").alias("least_unit"), F.col("least.effect").alias("least_effect"))


def worst_track(metrics: DataFrame, group: tuple[str, ...], metric: str, identity: str) -> DataFrame:
    """Per group the row of the largest metric, ties by identity; one aggregate, no sort."""
    others = [c for c in metrics.columns if c not in group]
    best = metrics.where(F.col(metric).isNotNull()).groupBy(*group).agg(F.min_by(F.struct(*others), F.struct((-F.col(metric)).alias("m"), identity)).alias("b"))
    return best.select(*group, "b.*")


def explained(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """rows (category, ...) with the explanation of the longest prefix in `texts` that its category starts with."""
    out: Column | None = None
    for prefix in sorted(texts, key=lambda p: (-len(p), p)):
        test = F.col("category").startswith(prefix)
        out = F.when(test, texts[prefix]) if out is None else out.when(test, texts[prefix])
    return rows.withColumn("explanation", F.lit(None).cast("string") if out is None else out)


def nearest_targets(configs: DataFrame, targets: DataFrame) -> DataFrame:
    """One dimension: see statistics.match_budgets."""
    return match_budgets(configs, targets)
