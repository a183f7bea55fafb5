"""Toxicity: a factorization machine over hashed terms.

The score of a document is the logistic of a bias, a weight for each of its terms, and for each pair of its terms the
product of their factors; so a pair such as an insult and the mention of a group can count for more than its parts.

Terms are lower-cased words hashed to 2^20 buckets.  The model is fitted on the driver from at most `MAX_LABELLED`
labelled documents, those of smallest hashed doc_id.  A bucket takes part if its presence tells the labels apart by
`LEAST_Z` standard errors, or if it is half of a pair that does so beyond what a machine over the former buckets
explains (`LEAST_PAIR_Z`; pairs of those buckets and of the `FREQUENT` most frequent ones are looked at).  So a term
that matters only beside another is found, though its own presence says nothing.  A machine over all buckets at once,
sparse and regularised, was tried and caught 0.52 to 0.68 of the held-out toxic documents of sf0.1 at a usable
precision, this one 0.8: a toxic word is rare, and tens of thousands of other rare words drown it.  Every document is
scored on all of its text.

Only counts by bucket (2^20 at most) and the chosen buckets of the labelled documents come to the driver.

Cases: null or empty text: the bias alone, from which no term is known.  No labels of both kinds: every score is the
share of label 1 (0 without labels).  Several labels of an id: toxic if one says so.  Several rows of an id in docs:
one of them, of the smallest hashed text, is learned from; each is scored.  Null doc_id: scored, never learned from.
Repeated rows: one result each.  Empty table: empty result.  Columns of the input other than doc_id and text are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, U, drop, released, slices, table, texts, tune, words

BUCKET_BITS = 20
MAX_LABELLED = 20_000
FACTORS = 8
#: Standard errors by which a bucket's presence, or a pair's beyond its parts, has to differ between the labels.
LEAST_Z, LEAST_PAIR_Z = 4.0, 6.0
#: Documents that have to hold a bucket (or pair), and frequent buckets whose pairs are looked at.
LEAST_DOCS, FREQUENT = 3, 1024


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct term of every text, by row."""
    _, _, h, rows = words(LOWER[data], offsets, ALNUM)
    key = np.unique(rows.astype(U) << U(BUCKET_BITS) | h >> U(64 - BUCKET_BITS))
    return (key >> U(BUCKET_BITS)).astype(np.int64), (key & U((1 << BUCKET_BITS) - 1)).astype(np.int64)


class FactorizationMachine:
    """Second-order factorization machine over 0/1 features, fitted by Adagrad on the logistic loss."""

    def __init__(self, n: int, factors: int = FACTORS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = rng.normal(0, 0.05, (n, factors))

    def sparse_margin(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """Of n rows given by (row, column) of their ones."""
        v = self.v[columns]
        s = np.stack([np.bincount(rows, weights=v[:, k], minlength=n) for k in range(v.shape[1])], axis=1)
        own = self.w - 0.5 * (self.v * self.v).sum(axis=1)
        return self.bias + np.bincount(rows, weights=own[columns], minlength=n) + 0.5 * (s * s).sum(axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((s * s) - x @ (self.v * self.v)).sum(axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 2000, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        weight = float(np.sqrt((1 - share) / share))  # label 1 is rare
        self.bias = float(np.log(share / (1 - share)))
        gb, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(-(-steps * batch // max(batch, len(y)))):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                xb = x[rows].astype(np.float64)
                error = (sigmoid(self.margin(xb)) - y[rows]) * np.where(y[rows] > 0, weight, 1.0) / len(rows)
                s = xb @ self.v
                db = error.sum()
                dw = xb.T @ error + decay * self.w
                dv = xb.T @ (error[:, None] * s) - (xb.T @ error)[:, None] * self.v + decay * self.v
                gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
                self.bias -= rate * db / np.sqrt(gb)
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= rate * dv / np.sqrt(gv)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Chooser:
    """Which buckets may take part, from the labelled documents that hold each: (bucket, toxic ones, others)."""

    def __init__(self, counts: np.ndarray, toxic: int, others: int):
        bucket, in1, in0 = counts.T if len(counts) else np.zeros((3, 0), np.int64)
        enough = in1 + in0 >= LEAST_DOCS
        bucket, in1, in0 = bucket[enough], in1[enough], in0[enough]
        p = (in1 + in0) / max(1, toxic + others)
        z = np.abs(in1 / max(1, toxic) - in0 / max(1, others)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(1, toxic) + 1 / max(1, others)))
        self.telling = np.sort(bucket[z >= LEAST_Z])
        frequent = bucket[np.lexsort((bucket, -(in1 + in0)))[:FREQUENT]]
        self.known = np.union1d(self.telling, frequent)


def telling_pairs(x: np.ndarray, error: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Columns of x (0/1) that are half of a pair whose presence goes with the error of a fitted model."""
    n = x.shape[1]
    both, sums, spread = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for a in range(0, len(x), 1024):
        part = x[a : a + 1024].astype(np.float32)
        both += part.T @ part
        sums += part.T @ (part * error[a : a + 1024, None].astype(np.float32))
        spread += part.T @ (part * noise[a : a + 1024, None].astype(np.float32))
    z = np.abs(sums) / np.sqrt(np.maximum(spread, 1e-9))
    np.fill_diagonal(z, 0)
    return np.flatnonzero(((z >= LEAST_PAIR_Z) & (both >= 5 * LEAST_DOCS)).any(axis=1))


class Model:
    """Which buckets take part, and the machine over them.

    rows: the buckets of each labelled document among those of `chooser`; y: its label.
    """

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, chooser: Chooser | None = None):
        self.share = float(y.mean()) if len(y) else 0.0
        self.machine = None
        if not len(y) or y.all() or not y.any():
            return
        column = np.full(1 << BUCKET_BITS, -1, np.int32)
        column[chooser.known] = np.arange(len(chooser.known))
        x = np.zeros((len(y), len(chooser.known)), np.uint8)
        for i, r in enumerate(rows):
            c = column[r]
            x[i, c[c >= 0]] = 1
        taken = column[chooser.telling]
        machine = FactorizationMachine(len(taken))
        machine.fit(x[:, taken], y)
        p = sigmoid(np.concatenate([machine.margin(x[a : a + 1024, taken].astype(float)) for a in range(0, len(y), 1024)]))
        more = telling_pairs(x, y - p, np.maximum(p * (1 - p), 1e-3))
        if len(np.setdiff1d(more, taken)):
            taken = np.union1d(taken, more)
            machine = FactorizationMachine(len(taken))
            machine.fit(x[:, taken], y)
        self.column = np.full(1 << BUCKET_BITS, -1, np.int16)
        self.column[chooser.known[taken]] = np.arange(len(taken))
        self.machine = machine

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.machine is None:
            return np.full(n, self.share)
        rows, buckets = terms(data, offsets)
        c = self.column[buckets]
        return sigmoid(self.machine.sparse_margin(rows[c >= 0], c[c >= 0], n))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """labels: (doc_id, toxic); docs: (doc_id, text)."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(2))
            out = []
            for a, b in slices(offsets):
                rows, buckets = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out += np.split(buckets.astype(np.int32), np.searchsorted(rows, np.arange(1, b - a)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in out], pa.binary())], ["doc_id", "toxic", "buckets"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    drawn = drawn.mapInArrow(released(run), f"doc_id {id_type}, toxic int, buckets binary")
    one = F.min(F.struct(F.xxhash64("buckets"), "toxic", "buckets")).alias("r")  # one row an id, however many docs has
    sample = table(spark, drawn.groupBy("doc_id").agg(one).select("r.toxic", "r.buckets"), "labelled-terms")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            for toxic, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[toxic, np.frombuffer(blob, np.int32)] += 1
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[1, seen].astype(np.int64)), pa.array(total[0, seen].astype(np.int64))], ["bucket", "in1", "in0"])

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = sample.mapInArrow(count, "bucket long, in1 long, in0 long").groupBy("bucket").agg(F.sum("in1").alias("in1"), F.sum("in0").alias("in0"))
    counts = counts.where(F.col("in1") + F.col("in0") >= LEAST_DOCS).toPandas().to_numpy(np.int64).reshape(-1, 3)  # of at most 2^20 buckets
    chooser = Chooser(counts[np.argsort(counts[:, 0])], sizes.get(1, 0), sizes.get(0, 0))
    wanted = spark.sparkContext.broadcast(chooser.known)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column(1).to_pylist():
                r = np.frombuffer(blob, np.int32)
                out.append(r[np.isin(r, wanted.value)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["toxic", "buckets"])

    rows = sorted(map(tuple, sample.mapInArrow(select, "toxic int, buckets binary").collect()))  # at most max_labelled, of known buckets
    drop(spark, sample)
    return Model([np.frombuffer(r[1], np.int32) for r in rows], np.array([float(r[0]) for r in rows]), chooser)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            parts = [shared.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {id_type}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
