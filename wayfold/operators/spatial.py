"""Tiles: grid cells, ownership, context, line clipping, membership, and leakage groups of overlapping contexts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .sequence import TRACK


@dataclass(frozen=True)
class Grid:
    size: float = 10.0
    context: float = 2.0
    origin_x: float = 0.0
    origin_y: float = 0.0


RUN = (*TRACK, "run_index")


def cell(x: Column, origin: float, size: float) -> Column:
    """Half-open ownership: floor((x - origin) / size)."""
    return F.floor((x - F.lit(origin)) / F.lit(size))


def tile_of(points: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """points (x_m, y_m, any others) with the grid_x, grid_y that own them."""
    return points.withColumns({"grid_x": cell(F.col("x_m"), grid.origin_x, grid.size), "grid_y": cell(F.col("y_m"), grid.origin_y, grid.size)})


def tile_bounds(tiles: DataFrame, grid: Grid = Grid(), context: bool = False) -> DataFrame:
    """grid_x, grid_y with their box; with the margin around it if context."""
    m = grid.context if context else 0.0
    x0, y0 = F.col("grid_x") * grid.size + grid.origin_x, F.col("grid_y") * grid.size + grid.origin_y
    return tiles.withColumns({"min_x": x0 - m, "max_x": x0 + grid.size + m, "min_y": y0 - m, "max_y": y0 + grid.size + m})


def candidate_tiles(boxes: DataFrame, grid: Grid = Grid(), context: bool = False) -> DataFrame:
    """boxes (min_x, min_y, max_x, max_y, any others) with every tile whose closed box they touch."""
    m = grid.context if context else 0.0
    span = lambda a, b, o: F.sequence(F.ceil((F.col(a) - m - o) / grid.size) - 1, F.floor((F.col(b) + m - o) / grid.size))
    return boxes.withColumn("grid_x", F.explode(span("min_x", "max_x", grid.origin_x))).withColumn("grid_y", F.explode(span("min_y", "max_y", grid.origin_y)))


def steps(valid: DataFrame) -> DataFrame:
    """Straight pieces between neighbouring samples of a run: x0, y0, x1, y1."""
    w = Window.partitionBy(*RUN).orderBy("sample_index")
    s = valid.select(*RUN, "sample_index", F.col("x_m").alias("x0"), F.col("y_m").alias("y0"), F.lead("x_m").over(w).alias("x1"), F.lead("y_m").over(w).alias("y1"))
    return s.where("x1 is not null")


def clip(pieces: DataFrame) -> DataFrame:
    """The share of each piece (x0, y0, x1, y1) inside its box (min_x ...): u0, u1 and clipped_m; pieces without length inside go.

    Liang-Barsky, as one expression.
    """
    c = F.col
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    out = F.lit(False)
    for a, b, lo, hi in (("x0", "x1", "min_x", "max_x"), ("y0", "y1", "min_y", "max_y")):
        d = c(b) - c(a)
        p, q = (c(lo) - c(a)) / F.nullif(d, F.lit(0.0)), (c(hi) - c(a)) / F.nullif(d, F.lit(0.0))
        low.append(F.coalesce(F.least(p, q), F.lit(0.0)))
        high.append(F.coalesce(F.greatest(p, q), F.lit(1.0)))
        out = out | ((d == 0) & ((c(a) < c(lo)) | (c(a) > c(hi))))
    dx, dy = c("x1") - c("x0"), c("y1") - c("y0")
    r = pieces.withColumns({"u0": F.greatest(*low), "u1": F.least(*high), "outside": out}).where("not outside and u1 > u0").drop("outside")
    return r.withColumn("clipped_m", (c("u1") - c("u0")) * F.sqrt(dx * dx + dy * dy)).where("clipped_m > 0")


def tile_lengths(valid: DataFrame, grid: Grid = Grid(), context: bool = False) -> DataFrame:
    """Length of each track's path in each tile (or its context)."""
    s = steps(valid).withColumns({"min_x": F.least("x0", "x1"), "max_x": F.greatest("x0", "x1"), "min_y": F.least("y0", "y1"), "max_y": F.greatest("y0", "y1")})
    t = candidate_tiles(s, grid, context).drop("min_x", "max_x", "min_y", "max_y")
    return clip(tile_bounds(t, grid, context)).groupBy(*TRACK, "grid_x", "grid_y").agg(F.sum(F.round(F.col("clipped_m") * 1e6).cast("long")).alias("length_um"))


def tiles(valid: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Tiles that some path crosses: their tracks in order, samples they own, and length inside."""
    inside = tile_lengths(valid, grid).groupBy("grid_x", "grid_y").agg(F.array_sort(F.collect_set("trajectory_id")).alias("tracks"), F.sum("length_um").alias("length_um"))
    near = tile_lengths(valid, grid, True).groupBy("grid_x", "grid_y").agg(F.count_distinct(*TRACK).alias("context_tracks"))
    owned = tile_of(valid, grid).groupBy("grid_x", "grid_y").agg(F.count("*").alias("samples"))
    return inside.join(near, ["grid_x", "grid_y"], "left").join(owned, ["grid_x", "grid_y"], "left").na.fill(0, ["samples", "context_tracks"])


def tile_id(grid: Grid = Grid()) -> Column:
    return F.concat(F.lit("tile-"), F.substring(F.sha2(F.concat_ws("|", F.lit(str(grid.size)), F.col("grid_x").cast("string"), F.col("grid_y").cast("string")), 256), 1, 16))


def leakage_groups(spark: SparkSession, found: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Tiles (grid_x, grid_y) with the group of tiles linked by contexts that overlap; named by its smallest tile in (x, y) order.

    Two contexts overlap only within a few cells, so neighbours meet by an equi-join on cell offsets.
    """
    reach = int(-(-2 * grid.context // grid.size)) if grid.context > 0 else 0
    code = F.col("grid_x") * F.lit(1 << 31) + F.col("grid_y")
    t = found.select("grid_x", "grid_y").distinct().withColumn("id", code)
    near = 2 * grid.context
    spread = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(reach + 1) for j in range(-reach, reach + 1) if (i, j) > (0, 0) and (i == 0 or (i - 1) * grid.size < near) and (j == 0 or (abs(j) - 1) * grid.size < near)]
    if not spread:
        return t.select("grid_x", "grid_y", F.col("grid_x").alias("group_x"), F.col("grid_y").alias("group_y"))
    moved = t.withColumn("o", F.explode(F.array(*spread))).select(F.col("id").alias("a"), (F.col("grid_x") + F.col("o.i")).alias("grid_x"), (F.col("grid_y") + F.col("o.j")).alias("grid_y"))
    edges = moved.join(t.withColumnRenamed("id", "b"), ["grid_x", "grid_y"]).select("a", "b")
    g = t.join(connected_components(spark, edges), "id", "left").withColumn("c", F.coalesce("component", "id"))
    names = t.select(F.col("id").alias("c"), F.col("grid_x").alias("group_x"), F.col("grid_y").alias("group_y"))
    return g.join(names, "c").select("grid_x", "grid_y", "group_x", "group_y")


def source_lines(valid: DataFrame, origin_x: Column, origin_y: Column) -> DataFrame:
    """A line for each run of two samples or more, moved into the source frame; with elevation only if all its samples have one."""
    point = F.struct("sample_index", (F.col("x_m") + origin_x).alias("x"), (F.col("y_m") + origin_y).alias("y"), F.col("z_m").alias("z"))
    runs = valid.groupBy(*RUN).agg(F.array_sort(F.collect_list(point)).alias("p"), (F.count("z_m") == F.count("*")).alias("elevated"))  # a run is one unit of all operators
    line = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), F.when(F.col("elevated"), q["z"]).alias("z")))
    return runs.where(F.size("p") > 1).select(*RUN, line.alias("line"))


def moved(points: Column, origin_x: Column, origin_y: Column) -> Column:
    """An array of (x, y, z) moved by an origin; elevations stay."""
    return F.transform(points, lambda p: F.struct((p["x"] + origin_x).alias("x"), (p["y"] + origin_y).alias("y"), p["z"].alias("z")))


def map_tiles(pieces: DataFrame, occupied: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Map elements (map_element_id and straight pieces x0 ... y1) in tiles that motion occupies, with the length inside."""
    s = pieces.withColumns({"min_x": F.least("x0", "x1"), "max_x": F.greatest("x0", "x1"), "min_y": F.least("y0", "y1"), "max_y": F.greatest("y0", "y1")})
    t = candidate_tiles(s, grid).drop("min_x", "max_x", "min_y", "max_y").join(occupied.select("grid_x", "grid_y").distinct(), ["grid_x", "grid_y"], "left_semi")
    return clip(tile_bounds(t, grid)).groupBy("map_element_id", "grid_x", "grid_y").agg(F.sum(F.round(F.col("clipped_m") * 1e6).cast("long")).alias("length_um"))
