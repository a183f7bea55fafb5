"""Benchmark decontamination: a hash set of the test items' word n-grams against every training window.

Words are lower-cased runs of digits, ASCII letters and all that is not ASCII.  A window is `n` consecutive words of an
item (an item of fewer is one window).  A document's rolling n-gram hashes are looked up in the set and each hit is
verified on the words themselves; words inside a verified occurrence are hit.

The set is broadcast when the benchmark's texts are at most `max_broadcast_bytes`, checked before.  A larger benchmark
takes another way with the same results: its window hashes fill a bitmap of fixed size, windows of documents that
pass the bitmap are dealt out by hash and joined to the table of windows.

Cases: null or empty text: no words, never contaminated; as an item: no windows.  A null item_id is named "null"; items
of the same id are one.  Repeated rows: one result each.  Empty benchmark: nothing is hit.  Columns of the input other
than doc_id are not returned by `contamination`; `decontaminate` returns the input's columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, U, fresh, grams, released, slices, texts, tune, words

N = 13
#: Texts of a benchmark up to this size are broadcast (about 700,000 windows).
MAX_BROADCAST_BYTES = 4 << 20
#: Bits of the filter in front of the exact lookup, and of the larger benchmark's bitmap.
FILTER_BITS = 20
BITMAP_BITS = 24


def item_windows(text: str | None, n: int = N) -> set[tuple[int, bytes]]:
    """(words, window) of an item."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _, _ = words(data, np.array([0, len(data)]), ALNUM)
    each = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    size = min(n, len(each))
    return {(size, b" ".join(each[i : i + size])) for i in range(len(each) - size + 1)} if each else set()


def window_hash(window: bytes) -> int:
    data = np.frombuffer(window, np.uint8)
    _, _, h, _ = words(data, np.array([0, len(data)]), ALNUM)
    return int(grams(h, len(h))[0])


class WindowSet:
    """The windows of all items: hashes to find them, bytes to verify them, and whose they are."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = N):
        owners: dict[bytes, set[str]] = {}
        sizes: dict[int, set[bytes]] = {}
        for item, text in items:
            for size, window in item_windows(text, n):
                owners.setdefault(window, set()).add(item)
                sizes.setdefault(size, set()).add(window)
        self.owners = {w: tuple(sorted(o)) for w, o in owners.items()}
        self.hashes = {size: np.unique(np.array([window_hash(w) for w in ws], U)) for size, ws in sizes.items()}
        self.filters = {size: bitmap(h, FILTER_BITS) for size, h in self.hashes.items()}


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, bool)
    out[(hashes >> U(64 - bits)).astype(np.int64)] = True
    return out


def candidates(h: np.ndarray, rows: np.ndarray, size: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows inside one text whose hash passes the filter, and the hashes."""
    g = grams(h, size)
    at = np.flatnonzero(seen[(g >> U(64 - int(len(seen)).bit_length() + 1)).astype(np.int64)])
    at = at[rows[at] == rows[at + size - 1]]
    return at, g[at]


def scan(data: np.ndarray, offsets: np.ndarray, windows: WindowSet) -> tuple[np.ndarray, list[np.ndarray], list[tuple[str, ...]]]:
    """For each text: number of words, positions of hit words, sorted item ids."""
    n_rows = len(offsets) - 1
    data = LOWER[data]
    starts, ends, h, rows = words(data, offsets, ALNUM)
    cover = np.zeros(len(starts) + 1, np.int64)
    found: dict[int, set[str]] = {}
    for size, known in windows.hashes.items():
        at, g = candidates(h, rows, size, windows.filters[size])
        for i in at[known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g].tolist():
            window = b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist()))
            if owners := windows.owners.get(window):
                cover[i] += 1
                cover[i + size] -= 1
                found.setdefault(int(rows[i]), set()).update(owners)
    n_words = np.bincount(rows, minlength=n_rows)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    first = np.concatenate(([0], np.cumsum(n_words)))
    cuts = np.searchsorted(hit, first)
    return n_words, [hit[cuts[r] : cuts[r + 1]] - first[r] for r in range(n_rows)], [tuple(sorted(found.get(r, ()))) for r in range(n_rows)]


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_words array<int>"


def benchmark_bytes(bench: DataFrame) -> int:
    return bench.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0


def _window_set(bench: DataFrame, n: int) -> WindowSet:
    """On the driver, of a benchmark whose size was checked."""
    return WindowSet([tuple(r) for r in bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").collect()], n)


def _broadcast_way(docs: DataFrame, bench: DataFrame, n: int, share: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_window_set(bench, n))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            data, offsets = texts(batch.column(1))
            n_words, hits, items = [], [], []
            for a, b in slices(offsets):
                got = scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], windows)
                n_words += got[0].tolist()
                hits += got[1]
                items += got[2]
            n_hit = [len(x) for x in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array([k > 0 and share * k >= w for k, w in zip(n_hit, n_words)], pa.bool_()), pa.array(hits, pa.list_(pa.int32())),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_words"],
            )

    return docs.mapInArrow(released(run), f"doc_id {id_type}, {RESULT}")


def _shuffle_way(docs: DataFrame, bench: DataFrame, n: int, share: int) -> DataFrame:
    """For a benchmark too large to broadcast.  Works on distinct texts; a text's rows meet its result at the end."""
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, size, hashes, window = [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, w in item_windows(t, n):
                    item.append(i)
                    size.append(k)
                    hashes.append(np.uint64(window_hash(w)).astype(np.int64))
                    window.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(hashes, pa.int64()), pa.array(window, pa.binary())], ["item", "size", "hash", "window"])

    pieces = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").mapInArrow(cut, "item string, size int, hash long, window binary")
    table = pieces.groupBy("size", "hash", "window").agg(F.collect_set("item").alias("items"))
    top = table.withColumn("top", F.shiftrightunsigned("hash", 64 - BITMAP_BITS))
    bits = top.groupBy("size", F.shiftright("top", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(top % 64 as int)))").alias("bits"))
    filters: dict[int, np.ndarray] = {}
    for r in bits.toLocalIterator():  # at most 13 * 2^18 numbers, whatever the benchmark's size
        filters.setdefault(r["size"], np.zeros(1 << BITMAP_BITS - 6, np.int64))[r["at"]] = r["bits"]
    shared = spark.sparkContext.broadcast({k: np.unpackbits(v.view(np.uint8), bitorder="little").view(bool) for k, v in filters.items()})

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            keys = batch.column(0).to_pylist()
            for a, b in slices(offsets):
                part, cuts = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                starts, ends, h, rows = words(part, cuts, ALNUM)
                first = np.searchsorted(rows, np.arange(b - a))
                out = [[], [], [], [], []]
                for size, seen in shared.value.items():
                    at, g = candidates(h, rows, size, seen)
                    for i, x in zip(at.tolist(), g.view(np.int64).tolist()):
                        w = b" ".join(part[p:q].tobytes() for p, q in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist()))
                        for column, v in zip(out, (keys[a + rows[i]], i - int(first[rows[i]]), size, x, w)):
                            column.append(v)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["key", "pos", "size", "hash", "window"])

    keyed = docs.select("doc_id", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("key"))
    distinct = keyed.groupBy("key").agg(F.first("text").alias("text"))
    hits = distinct.mapInArrow(survivors, "key string, pos int, size int, hash long, window binary").join(table, ["size", "hash", "window"])
    covered = hits.select("key", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos")).groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("hit_words"))
    owners = hits.select("key", F.explode("items").alias("item")).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = covered.join(owners, "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(2))
            n_words = []
            for a, b in slices(offsets):
                _, _, _, rows = words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], ALNUM)
                n_words += np.bincount(rows, minlength=b - a).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64())], ["doc_id", "key", "n_words"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    counted = keyed.select("doc_id", "key", "text").mapInArrow(count, f"doc_id {id_type}, key string, n_words long")
    none, no_words = F.array().cast("array<string>"), F.array().cast("array<int>")
    out = counted.join(found, "key", "left").withColumns({"items": F.coalesce("items", none), "hit_words": F.coalesce("hit_words", no_words)})
    n_hit = F.size("hit_words").cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "hit_words")


def contamination(docs: DataFrame, bench: DataFrame, n: int = N, share: int = 20, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words, some hit), hit_words of each row of docs."""
    tune(docs.sparkSession)
    way = _broadcast_way if benchmark_bytes(bench) <= max_broadcast_bytes else _shuffle_way
    return way(docs.select("doc_id", "text"), bench.select("item_id", "text"), n, share)


def cut_words(text: str, hits: np.ndarray) -> str:
    """text without the words at the given positions."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _, _ = words(LOWER[data], np.array([0, len(data)]), ALNUM)
    keep = np.ones(len(data), bool)
    for w in hits:
        keep[starts[w] : ends[w]] = False
    return data[keep].tobytes().decode()


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "documents", n: int = N, share: int = 20, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs without its contaminated documents, or ("spans") with the hit words cut out of those; the columns stay."""
    tune(docs.sparkSession)
    (key,) = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    if benchmark_bytes(bench) > max_broadcast_bytes:
        verdict = _shuffle_way(keyed.groupBy(F.col(key).alias("doc_id")).agg(F.first("text").alias("text")), bench.select("item_id", "text"), n, share)
        verdict = verdict.where("contaminated").select(F.col("doc_id").alias(key), "hit_words")
        if mode == "documents":
            return keyed.join(verdict, key, "left_anti").drop(key)
        (hit,) = fresh(keyed, "hit_words")
        joined = keyed.join(verdict.withColumnRenamed("hit_words", hit), key, "left").select(*docs.columns, hit)
    else:
        windows = docs.sparkSession.sparkContext.broadcast(_window_set(bench, n))
        joined, hit = docs, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            column = batch.column(at)
            if hit:
                hits = batch.column(batch.num_columns - 1).to_pylist()
                bad = [bool(h) for h in hits]
                batch = batch.select(range(batch.num_columns - 1))
            else:
                data, offsets = texts(column)
                n_words, hits = [], []
                for a, b in slices(offsets):
                    got = scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], windows.value)
                    n_words += got[0].tolist()
                    hits += got[1]
                bad = [len(h) > 0 and share * len(h) >= w for h, w in zip(hits, n_words)]
            if mode == "documents":
                yield batch.filter(pa.array([not x for x in bad], pa.bool_()))
            else:
                yield batch.set_column(at, batch.schema.field(at), pa.array([cut_words(t, h) if x else t for t, h, x in zip(column.to_pylist(), hits, bad)], column.type))

    return joined.mapInArrow(released(run), docs.schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hit_words")
