"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles.  Documents of equal sets are one class, joined as one.  In each of
`TREES` independent trees a class walks down from the root: at every level it goes to the child named by its minwise
token, so two sets of similarity s are still together after k levels with probability s^k, while unlike ones part.  A
node of at most `LEAF` classes is compared exhaustively; a larger one branches again, up to `DEPTH` levels.  Repeating
independent trees brings recall to the target: a pair at the threshold of 0.8 is lost by all trees with probability
(1 - 0.8^k)^TREES, which is 4e-9 for leaves under the first level, 5e-6 under the second and 0.002 under the fourth.

A node still larger at the last level is a big family of near copies (or shares a long passage).  It is cut into
blocks of its classes, differently in each tree, and each block gets the node's first classes as pivots; classes that
are not linked to the pivots' component after all trees are compared with the whole node, block by block.  So no task
holds a whole family, and no pair is given up because a family is large.

Within leaves all pairs meet.  Their signatures rule out pairs far below the threshold, an estimate under `SURE`: of a
pair at 0.8 at least 28 of 48 minwise tokens differ with a chance of 6e-9, which the trees multiply at most by their
number.  All others are confirmed on the full sets.  Confirmed links become components without collecting anything.

Cases: null or blank text: no shingles, a component of its own.  A text of fewer words than a shingle: the whole
sequence is its one shingle.  Null doc_id: in no component (component_id null), kept.  Repeated rows, and rows of one doc_id with
several texts: one result each, by their own text; `dedup` keeps one row of a component, that of the smallest doc_id,
then of the smallest text digest, and any one of equal ones.  Empty table: empty result.  Columns of the input other
than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, U, drop, fresh, grams, mix, released, slices, table, texts, tune, words
from .components import connected_components
from .exchange import groups_for

SHINGLE = 4
TREES, DEPTH, LEAF = 12, 4, 48
BLOCK, PIVOTS = 256, 8
SURE = 0.43
#: Bytes of sets in one call of the exhaustive comparison.
COMPARE_BYTES = 8 << 20
_MULTIPLIERS = mix(np.arange(1, TREES * DEPTH + 1, dtype=U)) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, h, rows = words(LOWER[data], offsets, NOT_SPACE)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    g = grams(h, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out.append(np.unique(g[a : b - k + 1]) if b - a >= k else grams(h[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=U).astype(np.int64)), int(mix(s ^ U(0xA5A5A5A55A5A5A5A)).sum(dtype=U).astype(np.int64))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (32 bits of them) of non-empty sets under TREES * DEPTH orders."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    return np.stack([np.minimum.reduceat(flat * m, starts) >> U(32) for m in _MULTIPLIERS], axis=1).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """The columns of docs but text, n (set size), f1, f2 (fingerprint), sig (null if empty) of each row."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(len(kept)))
            n, f1, f2, sig = [], [], [], []
            for a, b in slices(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                full = [s for s in sets if len(s)]
                made = iter(signature(full)) if full else iter(())
                for s in sets:
                    x, y = fingerprint(s)
                    n.append(len(s)), f1.append(x), f2.append(y), sig.append(next(made) if len(s) else None)
            made = [pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], [*(f.name for f in kept), "n", "f1", "f2", "sig"])

    more = T.StructType([*kept]).add("n", "long").add("f1", "long").add("f2", "long").add("sig", T.ArrayType(T.IntegerType()))
    return docs.select(*[f.name for f in kept], "text").mapInArrow(released(run), more)


def _leaves(spark: SparkSession, classes: DataFrame, made: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(leaf, id) of all small nodes, and of those still large at the last level; tables written for them are added to `made`."""
    now = classes.select("id", F.posexplode(F.array(*[F.slice("sig", t * DEPTH + 1, DEPTH) for t in range(TREES)])).alias("tree", "path"))
    now = now.select("id", F.xxhash64("tree", F.col("path")[0]).alias("leaf"), "path")
    small = []
    for level in range(1, DEPTH + 1):
        sizes = now.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1")
        now = table(spark, now.join(sizes, "leaf"), f"level-{level}")
        made.append(now)
        small.append(now.where(F.col("size") <= LEAF).select("leaf", "id"))
        now = now.where(F.col("size") > LEAF)
        if level < DEPTH:
            now = now.select("id", F.xxhash64("leaf", F.col("path")[level]).alias("leaf"), "path")
    out = small[0]
    for s in small[1:]:
        out = out.unionByName(s)
    made.append(table(spark, now.select("leaf", "id"), "large-leaves"))
    return out, made[-1]


def _blocks(spark: SparkSession, large: DataFrame) -> DataFrame:
    """Large leaves cut into blocks of about BLOCK classes, each with its leaf's PIVOTS smallest ids."""
    sizes = large.groupBy("leaf").agg(F.count("*").alias("size"))
    joined = large.join(sizes, "leaf").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    blocks = joined.select("leaf", "blocks", "id", F.pmod(F.xxhash64("leaf", "id"), "blocks").alias("block"))
    # the smallest ids of a leaf, from the smallest of each of its blocks: no leaf is sorted in one task
    tops = blocks.groupBy("leaf", "blocks", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("part")).agg(F.min("id").alias("id"))
    pivots = tops.select("leaf", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return blocks.select("leaf", "id", "block").unionByName(pivots).distinct().select(F.xxhash64("leaf", "block").alias("leaf"), "id")


def _candidates(members: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """(team, id): of each leaf the classes that have a likely partner in it; equal teams of different trees are one."""
    rows = members.join(classes.select("id", "n", "sig"), "id").withColumn("bucket", F.pmod("leaf", F.lit(buckets)))

    def likely(t: pa.Table) -> pa.Table:
        leaf, ids, n = (t.column(c).to_numpy() for c in ("leaf", "id", "n"))
        sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, TREES * DEPTH)
        order = np.lexsort((ids, leaf))
        leaf, ids, n, sig = leaf[order], ids[order], n[order], sig[order]
        first = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
        size = np.diff(np.append(first, len(leaf)))
        flag = np.zeros(len(leaf), bool)
        for s in np.unique(size[size > 1]).tolist():
            at = first[size == s]
            for i in range(s):
                for j in range(i + 1, s) if s <= 8 else (slice(i + 1, s),):
                    if s <= 8:
                        a, b = at + i, at + j
                        good = ((sig[a] == sig[b]).mean(axis=1) >= SURE) & (100 * np.minimum(n[a], n[b]) >= 80 * np.maximum(n[a], n[b]))
                        flag[a[good]] = flag[b[good]] = True
                    else:
                        for x in at.tolist():
                            rest = np.arange(x + i + 1, x + s)
                            good = ((sig[rest] == sig[x + i]).mean(axis=1) >= SURE) & (100 * np.minimum(n[rest], n[x + i]) >= 80 * np.maximum(n[rest], n[x + i]))
                            if good.any():
                                flag[x + i] = True
                                flag[rest[good]] = True
        team = np.add.reduceat(np.where(flag, mix(ids.view(U)), U(0)), first) if len(first) else np.zeros(0, U)
        team = np.repeat(team, size)[flag]
        return pa.table({"team": pa.array(team.view(np.int64)), "id": pa.array(ids[flag])})

    found = rows.groupBy("bucket").applyInArrow(likely, "team long, id long")
    return found.distinct()


def confirm(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what is linked among a few sets: 100 * intersection >= 80 * union, each pair in question compared exactly."""
    m, size = len(ids), np.array([len(s) for s in sets])
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                if root(i) != root(j) and 100 * min(size[i], size[j]) >= 80 * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= 80 * (size[i] + size[j] - both):
                        parent[max(root(i), root(j))] = min(root(i), root(j))
    else:
        flat = np.concatenate(sets)
        tokens, column = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(m), size)
        both = np.zeros((m, m))
        for a in range(0, len(tokens), 1 << 14):
            part = (column >= a) & (column < a + (1 << 14))
            x = np.zeros((m, min(1 << 14, len(tokens) - a)), np.float32)
            x[row[part], column[part] - a] = 1
            both += x @ x.T
        linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
        for i, j in zip(*np.nonzero(np.triu(linked, 1))):
            a, b = root(int(i)), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(int(ids[i]), int(ids[root(i)])) for i in range(m) if root(i) != i]


def _links(spark: SparkSession, docs: DataFrame, classes: DataFrame, teams: DataFrame, k: int) -> DataFrame:
    """Edges (a, b) among the members of each team, confirmed on full sets."""
    wanted = teams.select("id").distinct().join(classes.select("id", "doc_id", "f1", "f2"), "id")
    total = teams.join(classes.select("id", "n"), "id").agg(F.sum("n") * 8).first()[0] or 0
    buckets = groups_for(total, COMPARE_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            sets = [s for a, b in slices(offsets) for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)]
            f1, f2 = zip(*map(fingerprint, sets)) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["f1", "f2", "shingles"])

    sets = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(released(cut), "f1 long, f2 long, shingles binary")
    sets = sets.join(wanted.select("id", "f1", "f2"), ["f1", "f2"]).select("id", "shingles")
    rows = teams.join(sets.select("id", "shingles"), "id").withColumn("bucket", F.pmod("team", F.lit(buckets)))

    def compare(t: pa.Table) -> pa.Table:
        team, ids = t.column("team").to_numpy(), t.column("id").to_numpy()
        blobs = t.column("shingles").to_pylist()
        order = np.lexsort((ids, team))
        a_out, b_out = [], []
        bounds = np.flatnonzero(np.concatenate(([True], team[order][1:] != team[order][:-1], [True])))
        for x, y in zip(bounds[:-1], bounds[1:]):
            own = order[x:y]
            own = own[np.concatenate(([True], ids[own][1:] != ids[own][:-1]))]  # a repeated row comes once
            for a, b in confirm(ids[own], [np.frombuffer(blobs[i], U) for i in own]):
                a_out.append(a), b_out.append(b)
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return rows.groupBy("bucket").applyInArrow(compare, "a long, b long")


def _rest(large: DataFrame, parts: DataFrame) -> DataFrame:
    """Blocks that hold the whole of a large leaf, each with some of the classes not yet in the leaf's main component."""
    named = large.join(parts, "id", "left").withColumn("part", F.coalesce("component", "id"))
    per_part = named.groupBy("leaf", "part").agg(F.count("*").alias("size"))
    main = per_part.groupBy("leaf").agg(F.max(F.struct("size", "part")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("n_parts")).where("n_parts > 1")
    named = named.join(main, "leaf")
    blocks = F.ceil(F.col("size") / BLOCK)
    every = named.select("leaf", "id", F.pmod(F.xxhash64("id"), blocks).alias("block"), ((F.col("size") - F.col("main.size")) / BLOCK).cast("long").alias("last"))
    rest = named.where(F.col("part") != F.col("main.part")).select("leaf", "id", F.pmod(F.xxhash64("id", F.lit(1)), ((F.col("size") - F.col("main.size")) / BLOCK).cast("long") + 1).alias("turn"), F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"))
    whole = every.select("leaf", "id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("turn"))
    return whole.unionByName(rest).distinct().select(F.xxhash64("leaf", "block", "turn").alias("leaf"), "id")


def _components(docs: DataFrame, shingle: int) -> DataFrame:
    """The columns of docs (doc_id, text and others) but text, n, and least: doc_id of the class of each row's component (null without a set or an id)."""
    spark = docs.sparkSession
    tune(spark)
    drawn = table(spark, sketches(docs, shingle), "sketches")
    some = drawn.where("n > 0 and doc_id is not null")
    # rows that share a doc_id but not a set stay apart; a class is numbered once, as its row is written
    classes = some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    classes = table(spark, classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    made = [classes]
    small, large = _leaves(spark, classes, made)
    buckets = groups_for(classes.count(), 4000)
    members = small.unionByName(_blocks(spark, large))
    teams = table(spark, _candidates(members, classes, buckets), "teams")
    edges = table(spark, _links(spark, docs, classes, teams, shingle), "links")
    parts = connected_components(spark, edges)
    made += [teams, edges, parts]
    if not large.isEmpty():
        more = table(spark, _candidates(_rest(large, parts), classes, buckets), "teams")
        made.append(more)
        if not more.isEmpty():
            edges = table(spark, edges.unionByName(_links(spark, docs, classes, more, shingle)), "links")
            parts = connected_components(spark, edges)
            made += [edges, parts]
    members_of = table(spark, classes.join(parts, "id", "left").select("f1", "f2", "n", "doc_id", F.coalesce("component", "id").alias("component")), "members")
    for t in made:  # the result needs the sketches and the members only
        drop(spark, t)
    least = members_of.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = members_of.join(least, "component").select("f1", "f2", "n", "least")
    return drawn.drop("sig").join(named, ["f1", "f2", "n"], "left").withColumn("least", F.when(F.col("doc_id").isNotNull(), F.col("least"))).drop("f1", "f2")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    out = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle)
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component; the columns stay.

    Rows are told apart by doc_id and a digest of the text.  Rows of one component that share the smallest doc_id are
    ordered by the digest; rows that share both are merged, which shuffles only them.
    """
    spark = docs.sparkSession
    lost, key = fresh(docs, "lost_id", "text_key")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    judged = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest.alias("digest")), shingle)
    rows = judged.groupBy("doc_id", "digest", "n", "least").agg(F.count("*").alias("copies"))
    best = rows.where("doc_id = least").groupBy("least").agg(F.min("digest").alias("best"))
    # of the rows with a set and an id, one of each component; without a set each text, without an id each row stays
    rows = table(spark, rows.join(best, "least", "left").select(
        F.col("doc_id").alias(lost), F.col("digest").alias(key), "copies",
        F.coalesce((F.col("doc_id") == F.col("least")) & (F.col("digest") == F.col("best")), F.lit(True)).alias("stays")), "row-verdicts")
    keyed = docs.withColumn(key, digest)
    gone = rows.where("not stays").select(lost, F.col(key).alias(f"{key}_"))
    out = keyed.join(gone, (keyed["doc_id"] == gone[lost]) & (keyed[key] == gone[f"{key}_"]), "left_anti")
    twice = rows.where(f"stays and copies > 1 and {lost} is not null").select(lost, F.col(key).alias(f"{key}_"))
    if not twice.isEmpty():
        same = (out["doc_id"] == twice[lost]) & (out[key] == twice[f"{key}_"])
        single = out.join(twice, same, "left_anti")
        repeated = out.join(twice, same, "left_semi").dropDuplicates(["doc_id", key])
        out = single.unionByName(repeated)
    return out.drop(key)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
