"""Queries over whole tables whose SQL is slow or missing, against brute force."""

from itertools import combinations, product
from math import dist, erfc

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.operators import statistics
from wayfold.plans import registry

from .conftest import SF


def smallest(nodes, linked):
    """The smallest node that each node reaches."""
    out = {}
    for start in sorted(nodes):
        todo = [] if start in out else [start]
        while todo:
            if (n := todo.pop()) not in out:
                out[n] = start
                todo += linked(n)
    return out


def test_leakage_groups_of_all_samples(spark):
    tiles = {(int(r.x_m // 4), int(r.y_m // 4)) for r in registry._valid(spark, SF).collect()}
    near = lambda t: [n for i in (-1, 0, 1) for j in (-1, 0, 1) if (n := (t[0] + i, t[1] + j)) in tiles]
    want = smallest(tiles, near)
    assert {(r.grid_x, r.grid_y): r.group_x for r in registry.leakage_groups(spark, SF).collect()} == {t: g[0] for t, g in want.items()}
    split = {(r.grid_x, r.grid_y): (r.group_x, r.group_y, r.split) for r in registry.layout_split(spark, SF).collect()}
    assert {t: v[:2] for t, v in split.items()} == want
    assert len(set(split.values())) == len(set(want.values()))  # one split a group


def test_sign_flip_of_larger_pairs(spark):
    d = {"few": [1.0, -2.0, 3.5], "some": [(-1.0) ** (i % 3) * (i + 1) for i in range(12)], "many": [(-1.0) ** (i % 2) * (i + 1) for i in range(40)]}
    rows = spark.createDataFrame([(a, "z", i, x) for a, v in d.items() for i, x in enumerate(v)], "method_a string, method_b string, unit long, difference double")
    got = {r.method_a: (r.flips, r.p_value) for r in statistics.sign_flip(rows, 1000, 17).collect()}
    for a in ("few", "some"):
        extreme = sum(abs(sum(s * x for s, x in zip(signs, d[a]))) >= abs(sum(d[a])) for signs in product((-1, 1), repeat=len(d[a])))
        assert got[a] == (2 ** len(d[a]), pytest.approx(extreme / 2 ** len(d[a])))
    sd = sum(x * x for x in d["many"]) ** 0.5
    normal = erfc(abs(sum(d["many"])) / sd / 2**0.5)
    assert got["many"][0] == 1000 and abs(got["many"][1] - normal) < 0.08


def test_groups_of_all_runs(spark):
    c, paths = registry.FEASIBILITY, {}
    for r in registry.layout.resample(registry._valid(spark, SF), 8).orderBy("point").collect():
        paths.setdefault((r.scenario_id, r.trajectory_id, r.run_index), []).append((r.x_m, r.y_m))

    def alike(p, q):
        d = [dist(a, b) for a, b in zip(p, q)]
        return d[0] <= c.start_m and d[-1] <= c.end_m and sum(d) / 8 <= c.mean_m and max(d) <= c.maximum_m

    links = {k[:2]: set() for k in paths}
    for (a, p), (b, q) in combinations(paths.items(), 2):
        if a[0] == b[0] and a[1] != b[1] and (alike(p, q) or alike(p, q[::-1])):
            links[a[:2]].add(b[:2])
            links[b[:2]].add(a[:2])
    groups = set(smallest(links, lambda n: links[n]).values())
    want = {s: (sum(g[0] == s for g in groups), sum(k[0] == s for k in paths)) for s, _ in links}
    assert {r.scenario_id: (r.support_groups, r.tracks) for r in registry.support_groups(spark, SF).collect()} == want


def test_cells_of_standing_samples(spark, tmp_path):
    """Copies of events under new event_ids stand still for many samples.  DuckDB's sums over a window then depend on rows after the last step, and ends get lost, unless each is taken in order."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.crossJoin(spark.range(60).withColumnRenamed("id", "i")).withColumn("event_id", F.col("event_id") + F.col("i") * 100_000).drop("i").write.parquet(f"{tmp_path}/events.parquet")
    paths = registry._paths(spark, str(tmp_path))
    assert paths.where("size(path) <> 8").isEmpty() and paths.count() == registry._paths(spark, SF).count()
    duck = duckdb.connect()
    duck.execute("pragma debug_window_mode='separate'")
    duck.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = duck.execute(registry.ORACLE["shared_cells"]).fetchall()
    got = registry.shared_cells(spark, str(tmp_path)).select("scenario_id", "occupied_cells", "repeated_cells", "supported_tracks").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_standing_copies_change_no_cells(spark, tmp_path):
    """A step of length zero adds nothing to a path, so copies under new event_ids have the cells that the SQL, as it is, gives for the originals."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.crossJoin(spark.range(60).withColumnRenamed("id", "i")).withColumn("event_id", F.col("event_id") + F.col("i") * 100_000).drop("i").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    want = duck.execute(registry.ORACLE["shared_cells"]).fetchall()
    got = registry.shared_cells(spark, str(tmp_path)).select("scenario_id", "occupied_cells", "repeated_cells", "supported_tracks").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
