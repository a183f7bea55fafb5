"""Seeded ranks, cohorts and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import seed
from .graph import written

def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the place of each row in order, from 1, without bringing all rows into one task.

    Rows are dealt out by ranges of the order and written once, numbered within each range, and moved up by the
    number of rows in the ranges before (as many numbers as there are partitions).
    """
    spark, part = df.sparkSession, f"{name}_part"
    ranges = written(spark, df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = sorted((r[part], r["n"]) for r in ranges.groupBy(part).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, f"{part} int, {name}_before long"))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ranges.join(offsets, part).withColumn(name, (own + F.col(f"{name}_before")).cast("int" if total < 1 << 31 else "long")).drop(part, f"{name}_before")


def ranked(units: DataFrame, unit: str, root: int, *parts: str) -> DataFrame:
    """units with seed and rank (from 1), by seed and then unit."""
    s = units.withColumn("seed", seed(root, *map(F.lit, parts), F.col(unit)))
    return numbered(s, "rank", "seed", unit)


def allocate(rank: Column, counts: dict[str, int]) -> Column:
    """Split of a rank by cumulative counts, in the dict's order; null beyond."""
    out, total = None, 0
    for name, n in counts.items():
        total += n
        out = F.when(rank <= total, name) if out is None else out.when(rank <= total, name)
    return out


def motion_split(scenarios: DataFrame, held_out_city: str, counts: dict[str, int], root: int) -> DataFrame:
    """(scenario_id, city) with split: those of the held-out city, the rest by seeded rank."""
    held = scenarios.where(F.col("city") == held_out_city).select("scenario_id", "city", F.lit("held_out_city").alias("split"))
    rest = ranked(scenarios.where(~F.col("city").eqNullSafe(held_out_city)), "scenario_id", root, "split")
    return held.unionByName(rest.select("scenario_id", "city", allocate(F.col("rank"), counts).alias("split")).where("split is not null"))


def layout_split(groups: DataFrame, counts: dict[str, int], root: int) -> DataFrame:
    """Tiles (grid_x, grid_y, group_x, group_y) with the split of their whole leakage group."""
    units = groups.select(F.concat_ws(":", F.col("group_x").cast("string"), F.col("group_y").cast("string")).alias("unit")).distinct()
    chosen = ranked(units, "unit", root, "layout").select("unit", allocate(F.col("rank"), counts).alias("split"))
    return groups.withColumn("unit", F.concat_ws(":", F.col("group_x").cast("string"), F.col("group_y").cast("string"))).join(chosen, "unit").where("split is not null").drop("unit")


def cohort(first: DataFrame, second: DataFrame, n_first: int, n_second: int, root: int) -> DataFrame:
    """The n_first best-ranked of `first`, and of `second` the n_second best not among those; ranks stay as they were."""
    a = ranked(first, "unit", root, "development").where(F.col("rank") <= n_first).withColumn("role", F.lit("development"))
    b = ranked(second, "unit", root, "pilot").join(a.select("unit"), "unit", "left_anti").orderBy("rank").limit(n_second).withColumn("role", F.lit("pilot"))
    return a.unionByName(b)


def overlap_problems(tiles: DataFrame, reach: int = 1) -> DataFrame:
    """Pairs of tiles within reach whose splits differ: must be empty."""
    moved = tiles.select("grid_x", "grid_y", "split", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    a = moved.select((F.col("grid_x") + F.col("i")).alias("grid_x"), (F.col("grid_y") + F.col("j")).alias("grid_y"), F.col("split").alias("other"))
    return tiles.join(a, ["grid_x", "grid_y"]).where("split <> other").select("grid_x", "grid_y", "split", "other")


def stable_rank(df: DataFrame, metric: str, identity: str, descending: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """df with rank (from 1) by metric, ties by identity, and candidate_count."""
    m = F.col(metric).desc() if descending else F.col(metric).asc()
    if not by:
        return numbered(df, "rank", m, identity).withColumn("candidate_count", F.lit(df.count()))
    w = Window.partitionBy(*by)
    return df.withColumns({"rank": F.row_number().over(w.orderBy(m, identity)), "candidate_count": F.count("*").over(w)})


def select_by_rule(ranked_df: DataFrame, rule: str) -> DataFrame:
    """first, lower median or last of a ranking."""
    place = {"first": F.lit(1), "median": F.floor((F.col("candidate_count") - 1) / 2) + 1, "last": F.col("candidate_count")}[rule]
    return ranked_df.where(F.col("rank") == place)
