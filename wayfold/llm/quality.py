"""Quality rules: exact rule statistics of whole texts, and an isolation forest over them as the judge.

Statistics (words end at ASCII white space): words, their code points, symbols, repeated lines, and words inside
three-word windows that occur twice or more.  The forest sees rates, not lengths.  Each tree splits a small random
sample at random; a document that few splits isolate is anomalous.  There is a forest over each rate and one over all;
the score above which a document goes is calibrated for each from labelled rows: the highest balance of bad rows caught
against good rows lost (which weigh COST times as much), among thresholds that lose at most `max_loss` of the good.

A tree is grown on PART rows, as the method has it; the trees' parts are drawn from all documents, one after another in
the order of hashed doc_ids.  Thresholds are exact for all labelled rows: these are scored where they are, and the
driver gets the highest scores of good rows (as many as may be lost) and how many bad rows lie between them.  All
documents are counted and judged.

Cases: null or empty text: all counts 0, base_failed true (fewer than 50 words).  Repeated rows: one result each.  No
labels of both kinds: no threshold, so only base_failed decides.  Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, U, grams, lut, mix, released, slices, table, texts, tune, words

SYMBOLS = lut(b"#*$%&|<>")
#: Bytes that begin a code point.
STARTS = (np.arange(256) & 0xC0) != 0x80
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Trees of a forest, and rows that each is grown on.
TREES, PART = 100, 256
#: Rows of counts that one task scores.
ROWS_PER_TASK = 8192
#: What losing a share of the good rows costs, in shares of the bad rows caught.
COST = 50


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each text but n_dup_lines."""
    n_rows = len(offsets) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])

    _, _, h, rows = words(data, offsets, NOT_SPACE)
    g = grams(h, 3)
    at = np.flatnonzero(rows[: len(g)] == rows[2:]) if len(g) else np.zeros(0, np.int64)
    key = mix(g[at] ^ mix(rows[at].astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return {
        "n_words": np.bincount(rows, minlength=n_rows),
        "word_chars": per_row(NOT_SPACE[data] & STARTS[data]),
        "n_symbols": per_row(SYMBOLS[data]),
        "n_repeat_words": np.bincount(rows[covered], minlength=n_rows),
    }


def dup_lines(text: str | None) -> int:
    lines = [line for line in (text or "").split("\n") if line.strip(SPACE)]
    return len(lines) - len(set(lines))


def count_batch(column: pa.Array) -> np.ndarray:
    """COUNTS of each text of a column, a row each."""
    data, offsets = texts(column)
    parts = [rule_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    got = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in COUNTS if k != "n_dup_lines"}
    got["n_dup_lines"] = np.array([dup_lines(t) for t in column.to_pylist()], np.int64)
    return np.stack([got[k] for k in COUNTS], axis=1).astype(np.int64)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row of docs."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, count_batch(batch.column(1)).T)], ["doc_id", *COUNTS])

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(run), f"doc_id {id_type}, " + ", ".join(f"{k} long" for k in COUNTS))


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from rows of COUNTS, on scales where random splits can tell odd rows from usual ones."""
    n = np.maximum(counts[:, 0], 1.0)
    return np.stack([counts[:, 1] / n, np.log1p(20 * counts[:, 2] / n), np.log1p(200 * counts[:, 3] / n), counts[:, 4] / n], axis=1)


class IsolationForest:
    """Trees of random splits over small subsamples; the score is 2^(-mean path length / usual path length)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = PART, seed: int = 17):
        """rows, if enough for all trees, are in random order: each tree takes its own; else each draws from all of them."""
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(2, self.sample)))))
        own = len(rows) >= trees * sample
        parts = (rows[k * sample : (k + 1) * sample] if own else rows[rng.choice(len(rows), self.sample, replace=False)] for k in range(trees))
        self.trees = [self._grow(part, depth, rng) for part in parts] if len(rows) else []

    @staticmethod
    def _usual(n: np.ndarray | float) -> np.ndarray:
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, length = [], [], [], []
        todo = [(rows, 0, None)]
        while todo:
            part, level, parent = todo.pop(0)
            me = len(feature)
            if parent is not None and left[parent] < 0:
                left[parent] = me
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if level >= depth or len(part) < 2 or not len(open_):
                feature.append(0), cut.append(np.inf), left.append(me), length.append(level + float(self._usual(len(part))))
                continue
            f = int(rng.choice(open_))
            at = rng.uniform(low[f], high[f])
            feature.append(f), cut.append(at), left.append(-1), length.append(0.0)
            todo += [(part[part[:, f] <= at], level + 1, me), (part[part[:, f] > at], level + 1, me)]
        return np.array(feature), np.array(cut), np.array(left), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1 for each row, higher: more anomalous."""
        if not self.trees:
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, length in self.trees:
            node = np.zeros(len(rows), np.int64)
            while True:
                leaf = np.isinf(cut[node])
                if leaf.all():
                    break
                node = np.where(leaf, node, left[node] + (rows[every, feature[node]] > cut[node]))
            total += length[node]
        return 2.0 ** (-total / len(self.trees) / max(float(self._usual(self.sample)), 1e-9))


def calibrate(top: np.ndarray, below: np.ndarray, after: np.ndarray, n_good: int, n_bad: int, max_loss: float) -> float:
    """The threshold (a row with a higher score goes), half way to the next score; infinite if none helps.

    top: distinct scores of good rows, ascending, with all that a loss of max_loss may reach and one below; below: good and
    bad rows with at most each of these scores; after: the least score of any row above each (infinite: none).
    """
    if not n_good or not n_bad:
        return float("inf")
    lost, caught = 1 - below[0] / n_good, 1 - below[1] / n_bad
    gain = np.where(lost <= max_loss, caught - COST * lost, 0.0)
    best = int(np.argmax(gain))
    return float((top[best] + after[best]) / 2) if gain[best] > 0 else float("inf")


class Judge:
    """One forest over each statistic and one over all of them, each with its own calibrated threshold.

    A lone statistic's forest sees what the joint one hides among other kinds of odd rows.
    """

    def __init__(self, rows: np.ndarray):
        x = features(rows)
        self.views = [*([k] for k in range(x.shape[1])), list(range(x.shape[1]))]
        self.forests = [IsolationForest(x[:, v]) for v in self.views]
        self.most = [float("inf")] * len(self.views)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The forests' scores, a row each."""
        x = features(counts)
        return np.stack([f.score(x[:, v]) for f, v in zip(self.forests, self.views)])

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The highest of the forests' scores over their thresholds; above 1: anomalous."""
        return np.max([s / t if np.isfinite(t) else np.zeros(len(s)) for s, t in zip(self.scores(counts), self.most)], axis=0)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def fit(counted: DataFrame, labels: DataFrame, max_loss: float = 0.001) -> Judge:
    """The judge of a table of COUNTS.  labels: (doc_id, quality), 1 for good."""
    spark = counted.sparkSession
    passed = counted.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    drawn = passed.orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(TREES * PART)
    out = Judge(np.array(drawn.select(*COUNTS).collect(), float).reshape(-1, len(COUNTS)))
    shared, views = spark.sparkContext.broadcast(out), len(out.views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(COUNTS))], axis=1).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(len(COUNTS)).to_numpy(zero_copy_only=False) == 1), *map(pa.array, shared.value.scores(counts))], ["good", *[f"s{k}" for k in range(views)]])

    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = passed.join(known, "doc_id").select(*COUNTS, "quality")
    known = known.repartition(4 * spark.sparkContext.defaultParallelism)  # few bytes, much work
    known = table(spark, known.mapInArrow(run, "good boolean, " + ", ".join(f"s{k} double" for k in range(views))), "rule-labelled")
    n = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    n_good, n_bad = n.get(True, 0), n.get(False, 0)
    if not n_good or not n_bad:
        return out
    reach = int(max_loss * n_good) + 2
    tops = [np.unique([r[0] for r in known.where("good").select(f"s{k}").orderBy(F.desc(f"s{k}")).limit(reach).collect()]) for k in range(views)]
    bounds = spark.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows have a score at most each of tops and above the one before, and the least of these scores above that one."""
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for k, top in enumerate(bounds.value):
                score = batch.column(1 + k).to_numpy()
                place = np.searchsorted(top, score, "left")
                least = np.full(len(top) + 1, np.inf)
                np.minimum.at(least, place, score)
                at = np.unique(place)
                both = [np.bincount(place[of], minlength=len(top) + 1)[at] for of in (good, ~good)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), *map(pa.array, both), pa.array(least[at])], ["view", "place", "good", "bad", "least"])

    dealt = known.mapInArrow(deal, "view long, place long, good long, bad long, least double")
    rows = dealt.groupBy("view", "place").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("least").alias("least")).collect()
    for k, top in enumerate(tops):
        within, least = np.zeros((2, len(top) + 1)), np.full(len(top) + 1, np.inf)
        for r in rows:
            if r["view"] == k:
                within[:, r["place"]], least[r["place"]] = (r["good"], r["bad"]), r["least"]
        out.most[k] = calibrate(top, within.cumsum(axis=1)[:, :-1], least[1:], n_good, n_bad, max_loss)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and score of each row of docs."""
    spark = docs.sparkSession
    counted = table(spark, statistics(docs), "rule-statistics")
    shared = spark.sparkContext.broadcast(fit(counted, labels))  # trees x sample splits, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(COUNTS))], axis=1).astype(float)
            failed, score = base_failed(counts), shared.value.score(counts)
            for name, values in (("base_failed", failed), ("kept", ~failed & (score <= 1)), ("score", score)):
                batch = batch.append_column(name, pa.array(values))
            yield batch

    # the table of counts is small in bytes, so that its files would be read in few tasks
    tasks = max(spark.sparkContext.defaultParallelism, -(-counted.count() // ROWS_PER_TASK))
    more = [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())]
    return counted.repartition(tasks).mapInArrow(run, T.StructType([*counted.schema.fields, *more]))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that `judge` keeps, with all their columns; texts are read twice and never shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(table(spark, statistics(docs), "rule-statistics"), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_batch(batch.column(batch.schema.get_field_index("text"))).astype(float)
            yield batch.filter(pa.array(~base_failed(counts) & (shared.value.score(counts) <= 1)))

    return docs.mapInArrow(released(run), docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
