"""LM scoring by a hierarchical Pitman-Yor model over word bigrams.

Each context has a restaurant whose customers are the words seen after it; the restaurants share one parent, whose
customers are their tables and whose base is uniform over the known words and one unknown.  Contexts are all words and
the start of a text.  The `CONTEXTS` most frequent training words by exact counts are listed: their totals are arrays that
every group has.  The totals of a rarer context lie with the group of that word, which adds them up after each sweep.

Seating is sampled by Gibbs: given all else, the tables of a (context, word) are drawn from their exact conditional
(see pitman_yor).  Sweeps run in parallel over hash groups of words with the restaurants' totals of the sweep before,
as in distributed Gibbs samplers; after each sweep the totals are added up again.  The probability of a word is the
mean of its predictive probability over the samples after the first (burn-in) sweep.

Movement of data: documents become chunks of word hashes once; a chunk sends its distinct (context, word) pairs with
their counts, packed, to the words' groups, and gets one number per pair back.  A listed word is dealt out by (word,
context), or goes with its context if that is rarer, so no group has to hold a hot word; the totals of listed words and
contexts are arrays of fixed size.  After each sweep a group tells the homes of its rarer contexts their tables and is
told the totals.  All else is local to a group, whose number follows the input.

Cases: null text: empty, only the end token.  Null doc_id: a training text (held_out false).  Repeated rows: one
result each, each counted.  Nothing to learn from: every token is unknown (N and V are 0).  Empty table: empty result.
Columns of the input other than doc_id and text are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, U, drop, mix, release, slices, table, texts, tune, words
from .exchange import REPLY, SENT, cut_by, dealt, groups_for, pack, planes, rows, small, unpack
from .pitman_yor import draw_tables, log_stirling

#: Listed words; with the start, as contexts, and the mark of rarer ones their numbers fit two bytes.
CONTEXTS = 65_000
CHUNK_TEXT = 8 << 20
GROUP_TEXT = 16 << 20
SAMPLES = 2
#: Answers are made in so many parts, one after the other, as an exchange of all would lie on disk at once.
PARTS = 3
THETA = 1.0
END = U(0x5851F42D4C957F2D)
#: Words of the frequent list are the CONTEXTS and the end token; contexts also have the start, and rarer words from _CONTEXTS on.
_WORDS = CONTEXTS + 1
_START, _CONTEXTS = _WORDS, _WORDS + 1
_RARE = _CONTEXTS


def chunk_words(docs: DataFrame) -> DataFrame:
    """(chunk, n_bytes, words, counts, payload): texts as indexes into each chunk's own list of word hashes; words: that list; counts: of each in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            known, token = np.unique(np.concatenate([h for _, h, _, _ in held]), return_inverse=True)
            n = np.concatenate([k for _, _, k, _ in held])
            train = ~np.concatenate([x for _, _, _, x in held])
            order = np.argsort(-np.bincount(token, minlength=len(known)), kind="stable")  # frequent words first: their numbers take less room
            place = np.empty(len(known), np.int64)
            place[order] = np.arange(len(known))
            known, token = known[order], place[token]
            count = np.bincount(token, weights=np.repeat(train, n), minlength=len(known)).astype(np.int64)
            ids = pa.concat_arrays([i for i, _, _, _ in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as writer:
                writer.write_batch(pa.record_batch([ids], ["doc_id"]))
            payload = planes(ids=sink.getvalue().to_pybytes(), n=small(n), train=train, token=small(token))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(v, pa.int64())) for v in (known.view(np.int64), count)]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([size], pa.int64()), *lists, pa.array([payload], pa.binary())], ["chunk", "n_bytes", "words", "counts", "payload"])

        for batch in batches:
            data, offsets = texts(batch.column(1))
            held_out = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(offsets):
                _, _, h, row = words(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], NOT_SPACE)
                n = np.bincount(row, minlength=b - a) + 1
                ends = np.cumsum(n) - 1
                full = np.empty(len(h) + b - a, U)
                full[ends] = END
                inner = np.ones(len(full), bool)
                inner[ends] = False
                full[inner] = h
                held.append((batch.column(0).slice(a, b - a), full, n, held_out[a:b]))
                size += int(offsets[b] - offsets[a])
                if size >= CHUNK_TEXT:
                    yield out()
                    chunk, held, size = chunk + 1, [], 0
                    release()
        if held:
            yield out()

    tune(docs.sparkSession)
    return table(docs.sparkSession, docs.mapInArrow(run, "chunk long, n_bytes long, words array<long>, counts array<long>, payload binary"), "lm-chunks")


def home(h: np.ndarray, groups: int) -> np.ndarray:
    """The group of each word that is not listed, also as a context."""
    return ((mix(h ^ U(0x1234567)) >> U(32)) * U(groups) >> U(32)).astype(np.int64)


class Pairs:
    """The distinct (word, context) pairs of a chunk, in order of group, word and context; the same whenever it is opened."""

    def __init__(self, payload: bytes, words: np.ndarray, frequent: np.ndarray, groups: int):
        p = unpack(payload)
        self.ids = pa.ipc.open_stream(p["ids"]).read_all().column(0).combine_chunks()
        order = np.argsort(words.view(U))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.n, self.train, self.known = p["n"].astype(np.int64), p["train"], words.view(U)[order]
        self.token = place[p["token"]]
        spot = np.minimum(np.searchsorted(frequent, self.known), len(frequent) - 1)
        self.listed = np.where(frequent[spot] == self.known, spot, -1)  # place in the frequent list
        first = np.cumsum(self.n) - self.n
        before = np.empty(len(self.token), np.int64)
        before[1:] = np.where(self.listed[self.token[:-1]] >= 0, self.listed[self.token[:-1]], _CONTEXTS + self.token[:-1])
        before[first] = _START
        every = _CONTEXTS + len(self.known)
        code, self.pair = np.unique(self.token * every + before, return_inverse=True)
        count = np.bincount(self.pair, weights=np.repeat(self.train, self.n), minlength=len(code)).astype(np.int64)
        word, context = code // every, code % every
        h = self.known[word]
        by = np.where(context < _CONTEXTS, h ^ mix(context.astype(U) + U(7)), self.known[np.maximum(context - _CONTEXTS, 0)])
        group = home(np.where(self.listed[word] >= 0, by, h), groups)
        self.order = np.argsort(group, kind="stable")
        self.group, self.word, self.context, self.count = group[self.order], word[self.order], context[self.order], count[self.order]


ARRAYS = ("context_count", "context_tables", "word_count", "word_tables", "scalars")
_EMPTY = {"context_count": _CONTEXTS, "context_tables": _CONTEXTS, "word_count": _WORDS, "word_tables": _WORDS, "scalars": 8}


def _add_up(partial: DataFrame) -> dict[str, np.ndarray]:
    """Sums arrays of fixed size (column sums), in two steps; the driver gets at most 16 of them."""

    def add(t: pa.Table) -> pa.Table:
        total = {k: np.zeros(n, np.int64) for k, n in _EMPTY.items()}
        for blob in t.column("sums").to_pylist():
            for k, v in unpack(blob).items():
                total[k] += v
        return pa.table({"sums": pa.array([pack(**total)], pa.binary())})

    total = {k: np.zeros(n, np.int64) for k, n in _EMPTY.items()}
    for r in partial.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(16))).groupBy("part").applyInArrow(add, "sums binary").collect():
        for k, v in unpack(r[0]).items():
            total[k] += v
    return total


def message(words: np.ndarray, context: np.ndarray, known: np.ndarray, count: np.ndarray) -> bytes:
    """What a chunk sends to a group: pairs of words (hashes) and contexts (from _CONTEXTS on: places in known) with counts."""
    w, wi = np.unique(words, return_inverse=True)
    h = known[context[context >= _CONTEXTS] - _CONTEXTS]
    r = np.setdiff1d(h, w)  # a rarer context whose home is the group is one of its words
    spot = np.minimum(np.searchsorted(w, h), len(w) - 1)
    ri = np.where(w[spot] == h, spot, len(w) + np.searchsorted(r, h))
    return planes(w=w, wi=small(wi), u=small(np.minimum(context, _RARE)), c=small(count), r=r, ri=small(ri))


def links(rare: np.ndarray, groups: int, **totals: np.ndarray) -> pa.Array:
    """One group's part of the totals of its rarer contexts, for their homes."""
    at = home(rare, groups)
    order = np.argsort(at, kind="stable")
    out = [{"to": g, "blob": planes(h=rare[order][part], **{k: small(v[order][part]) for k, v in totals.items()})} for g, part in cut_by(at[order], groups)]
    return pa.array([out], pa.list_(pa.struct([("to", pa.int64()), ("blob", pa.binary())])))


def settle(t: pa.Table) -> pa.Table:
    """At the home of rarer contexts: adds up their totals (to, g, blob) and tells each group those it has part in."""
    parts = [unpack(b) for b in t.column("blob").to_pylist()]
    known, at = np.unique(np.concatenate([p["h"] for p in parts]), return_inverse=True)
    sizes = np.cumsum([len(p["h"]) for p in parts])[:-1]
    totals = {k: np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(known)).astype(np.int64) for k in parts[0] if k != "h"}
    told = [planes(**{k: small(v[i]) for k, v in totals.items()}) for i in np.split(at, sizes)]
    return pa.table({"g": t.column("g"), "home": t.column("to"), "blob": pa.array(told, pa.binary())})


def merge(t: pa.Table, frequent: np.ndarray, groups: int = 1) -> pa.Table:
    """One group: its distinct pairs with their counts over all chunks, which of them each chunk asked for, and its rarer contexts."""
    release()
    parts = [unpack(b) for b in t.column("blob").to_pylist()]
    sizes = [len(p["c"]) for p in parts]
    word_h = np.concatenate([p["w"][p["wi"]] for p in parts])
    context = np.concatenate([p["u"] for p in parts]).astype(np.int64)
    far = [np.append(p["w"], p["r"])[p["ri"]] if "ri" in p else p["w"][p["u"][p["u"] >= _CONTEXTS] - _CONTEXTS] for p in parts]  # without ri: places in w
    rare, place = np.unique(np.concatenate(far), return_inverse=True)
    context[context >= _CONTEXTS] = _CONTEXTS + place
    order = np.lexsort((context, word_h))
    w, u = word_h[order], context[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (u[1:] != u[:-1])
    index = np.empty(len(w), np.int64)
    index[order] = np.cumsum(new) - 1
    count = np.bincount(index, weights=np.concatenate([p["c"] for p in parts])).astype(np.int64)
    w, u = w[new], u[new]
    known, wi = np.unique(w, return_inverse=True)
    spot = np.minimum(np.searchsorted(frequent, known), len(frequent) - 1)
    listed = np.where(frequent[spot] == known, spot, -1)
    seen = (count > 0).astype(np.int64)
    by_word, types = np.bincount(wi, weights=count).astype(np.int64), np.bincount(wi, weights=seen).astype(np.int64)
    own, some = listed < 0, count[count > 0]
    by_context = {k: np.bincount(u, weights=v, minlength=_CONTEXTS + len(rare)).astype(np.int64) for k, v in (("context_count", count), ("context_tables", seen))}
    sums = {k: v[:_CONTEXTS] for k, v in by_context.items()}
    for name, values in (("word_count", by_word), ("word_tables", types)):
        sums[name] = np.bincount(listed[~own], weights=values[~own], minlength=_WORDS).astype(np.int64)
    sums["scalars"] = np.array([by_word.sum(), (by_word[own] > 0).sum(), (some == 1).sum(), (some == 2).sum(), (types[own] == 1).sum(), (types[own] == 2).sum(), types.sum(), 0])
    asked = [np.diff(x, prepend=0) for x in np.split(index, np.cumsum(sizes)[:-1])]
    state = planes(wi=small(np.diff(wi, prepend=0)), u=small(np.minimum(u, _RARE)), ur=small(u[u >= _CONTEXTS] - _CONTEXTS), c=small(count), listed=small(listed + 1), rare=rare)
    replies = planes(chunk=t.column("chunk").to_numpy(), asked=[small(x) for x in asked])
    told = links(rare, groups, n=by_context["context_count"][_CONTEXTS:], t=by_context["context_tables"][_CONTEXTS:])
    blob = lambda x: pa.array([x], pa.binary())
    return pa.table([pa.array([t.column("g")[0].as_py()], pa.int64()), blob(state), blob(replies), blob(pack(**sums)), told], ["g", "state", "asked", "sums", "links"])


class Group:
    """A group's restaurants while they are sampled."""

    def __init__(self, g: int, state: bytes, totals: dict, d: float, d0: float, groups: int = 1):
        s = unpack(state)
        self.g, self.d, self.d0 = g, d, d0
        self.wi, self.u = np.cumsum(s["wi"].astype(np.int64)), s["u"].astype(np.int64)
        self.u[self.u == _RARE] = _CONTEXTS + s["ur"].astype(np.int64)
        self.c, self.listed = s["c"].astype(np.int64), s["listed"].astype(np.int64) - 1
        self.rare, self.groups = s["rare"], groups
        self.rare_count, self.rare_tables = np.zeros((2, len(self.rare)), np.int64)
        self.t = np.minimum(self.c, 1)
        self.by_word = self.sum_words(self.c)
        self.by_word[self.listed >= 0] = totals["word_count"][self.listed[self.listed >= 0]]

    def told(self, replies: list[bytes]) -> Group:
        """Takes what the homes of its rarer contexts, in their order, told of these."""
        order = np.argsort(home(self.rare, self.groups), kind="stable")
        parts = [unpack(b) for b in replies]
        for k, v in (("n", self.rare_count), ("t", self.rare_tables)):
            if parts and k in parts[0]:
                v[order] = np.concatenate([p[k] for p in parts])
        return self

    def seated(self, seats: bytes) -> Group:
        p = unpack(seats)
        self.t, self.s = p["t"].astype(np.int64), p["s"].astype(np.int64)
        return self

    def links(self) -> pa.Array:
        return links(self.rare, self.groups, t=np.bincount(self.u, weights=self.t, minlength=_CONTEXTS + len(self.rare)).astype(np.int64)[_CONTEXTS:])

    def sum_words(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.wi, weights=values, minlength=len(self.listed)).astype(np.int64)

    def customers(self, totals: dict) -> np.ndarray:
        """Customers of each word in the parent: the tables of all restaurants."""
        out = self.sum_words(self.t)
        out[self.listed >= 0] = totals["word_tables"][self.listed[self.listed >= 0]]
        return out

    def sweep(self, number: int, totals: dict, stirling: np.ndarray, stirling0: np.ndarray) -> None:
        rng = np.random.default_rng([self.g, number])
        if number == 0:
            self.s = np.minimum(self.sum_words(self.t), 1)
            self.s[self.listed >= 0] = totals["root_of_listed"][self.listed[self.listed >= 0]]
        customers = self.customers(totals)
        new = (THETA + self.d0 * totals["root_tables"]) / (totals["vocabulary"] + 1)
        own = np.maximum(customers[self.wi] - self.t - self.d0 * np.minimum(self.s[self.wi], np.maximum(customers[self.wi] - self.t, 0)), 0)
        base = (own + new) / (totals["root_customers"] + THETA)
        many = np.flatnonzero(self.c >= 2)
        others = np.maximum(np.append(totals["context_tables"], self.rare_tables)[self.u[many]] - self.t[many], 0)
        self.t[many] = draw_tables(rng, stirling, self.d, THETA, self.c[many], self.t[many], others, base[many])
        mine = np.flatnonzero(self.listed < 0)
        customers = self.sum_words(self.t)
        self.s[mine] = draw_tables(rng, stirling0, self.d0, THETA, customers[mine], self.s[mine], np.maximum(totals["root_tables"] - self.s[mine], 0), np.full(len(mine), 1 / (totals["vocabulary"] + 1)))

    def sums(self) -> dict[str, np.ndarray]:
        own = self.listed < 0
        tables = self.sum_words(self.t)
        return {
            "context_tables": np.bincount(self.u, weights=self.t, minlength=_CONTEXTS).astype(np.int64)[:_CONTEXTS],
            "word_tables": np.bincount(self.listed[~own], weights=tables[~own], minlength=_WORDS).astype(np.int64),
            "scalars": np.array([0, 0, 0, 0, 0, 0, tables.sum(), self.s[own].sum()]),
        }

    def predictive(self, totals: dict) -> np.ndarray:
        """Probability of each pair's word after its context, given the totals after the sweep (so that they add up to 1)."""
        tables = self.s.copy()
        tables[self.listed >= 0] = totals["root_of_listed"][self.listed[self.listed >= 0]]
        new = (THETA + self.d0 * totals["root_tables"]) / (totals["vocabulary"] + 1)
        base = ((self.customers(totals) - self.d0 * tables + new) / (totals["root_customers"] + THETA))[self.wi]
        n = np.append(totals["context_count"], self.rare_count)[self.u]
        told = self.c - self.d * self.t + (THETA + self.d * np.append(totals["context_tables"], self.rare_tables)[self.u]) * base
        return np.where(n > 0, told / (n + THETA), base)


def _totals(first: dict, now: dict, d0: float, stirling0: np.ndarray, number: int) -> dict:
    """What every group needs to know of the whole: sizes, tables of contexts and of frequent words, and the parent's tables."""
    vocabulary = int(first["scalars"][1] + (first["word_count"] > 0).sum())
    customers = now["word_tables"]
    before = now.get("root_of_listed", np.minimum(customers, 1))
    own_tables = int(now["scalars"][7]) if number else int(first["scalars"][1])
    total = own_tables + int(before.sum())
    rng = np.random.default_rng([1 << 40, number])
    listed = draw_tables(rng, stirling0, d0, THETA, customers, before, np.maximum(total - before, 0), np.full(len(customers), 1 / (vocabulary + 1)))
    return {"vocabulary": vocabulary, "root_customers": int(now["scalars"][6]), "root_tables": own_tables + int(listed.sum()), "root_of_listed": listed, "context_tables": now["context_tables"], "word_tables": customers, "context_count": first["context_count"], "word_count": first["word_count"], "n": int(first["scalars"][0])}


def score(docs: DataFrame, samples: int = SAMPLES, contexts: int = CONTEXTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text, held)."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunks = chunk_words(docs.select("doc_id", "text", "held"))
    # exact counts of all words, of which the most frequent become contexts
    end = int(END.astype(np.int64))
    tops = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("top")).select("top.*").where((F.col("counts") > 0) & (F.col("words") != end))
    tops = tops.groupBy("words").agg(F.sum("counts").alias("c")).select(F.col("words").alias("h"), "c")
    top = np.array([r["h"] for r in tops.orderBy(F.desc("c"), "h").limit(contexts).collect()], np.int64).view(U)
    frequent = np.sort(np.append(top, END))
    n_groups = groups_for(chunks.agg(F.sum("n_bytes")).first()[0] or 0, GROUP_TEXT)
    listed = spark.sparkContext.broadcast(frequent)  # contexts hashes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                p, out = Pairs(payload, known.values.to_numpy(), listed.value, n_groups), [[], [], []]
                for g, part in cut_by(p.group, n_groups):
                    for column, v in zip(out, (g, chunk, message(p.known[p.word[part]], p.context[part], p.known, p.count[part]))):
                        column.append(v)
                del p
                release()
                yield rows(SENT, *out)

    sent = dealt(chunks.select("chunk", "payload", "words").mapInArrow(send, SENT), "g", n_groups)
    told = "links array<struct<to:long,blob:binary>>"
    states = table(spark, sent.groupBy("g").applyInArrow(lambda t: merge(t, listed.value, n_groups), f"g long, state binary, asked binary, sums binary, {told}"), "lm-groups", "none")
    del sent, tops

    def settled(df: DataFrame) -> DataFrame:
        """What the homes of rarer contexts tell each group."""
        out = dealt(df.select("g", F.explode("links").alias("l")).select("l.to", "g", "l.blob"), "to", n_groups)
        out = table(spark, out.groupBy("to").applyInArrow(settle, "g long, home long, blob binary"), "lm-contexts", "none")
        spark.sparkContext._jvm.System.gc()  # exchanges that nothing reads again leave the disk
        return out

    def gathered(**parts: DataFrame) -> DataFrame:
        """The named blobs of each group, dealt out by group."""
        every = [df.select("g", F.lit(k).alias("part"), "home" if "home" in df.columns else F.lit(0).cast("long").alias("home"), "blob") for k, df in parts.items()]
        return dealt(functools.reduce(DataFrame.union, every), "g", n_groups).groupBy("g")

    def opened(t: pa.Table) -> dict[str, list[bytes]]:
        out: dict[str, list[bytes]] = {}
        for k, _, blob in sorted(zip(*(t.column(c).to_pylist() for c in ("part", "home", "blob"))), key=lambda x: x[:2]):
            out.setdefault(k, []).append(blob)
        return out

    first = _add_up(states.select("g", "sums"))
    n1, n2, r1, r2 = (int(x) for x in first["scalars"][2:6])
    d = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
    d0 = min(0.95, max(0.1, r1 / max(1, r1 + 2 * r2)))
    stirling0 = log_stirling(d0)
    history = [_totals(first, first, d0, stirling0, 0)]

    state = states.select("g", F.col("state").alias("blob"))
    contexts_told, seats = [settled(states)], []

    def sweeping(number: int, known):
        def sweep(t: pa.Table) -> pa.Table:
            release()
            g, p = t.column("g")[0].as_py(), opened(t)
            group = Group(g, p["state"][0], known.value[0], d, d0, n_groups).told(p.get("told", []))
            if number:
                group.seated(p["seats"][0])
            group.sweep(number, known.value[number], log_stirling(d), log_stirling(d0))
            blob = lambda x: pa.array([x], pa.binary())
            return pa.table([pa.array([g], pa.int64()), blob(planes(t=small(group.t), s=small(group.s))), blob(pack(**group.sums())), group.links()], ["g", "blob", "sums", "links"])

        return sweep

    for number in range(samples + 1):
        before = {"seats": seats[-1].select("g", "blob")} if number else {}
        run = sweeping(number, spark.sparkContext.broadcast(history))
        seats.append(table(spark, gathered(state=state, told=contexts_told[-1], **before).applyInArrow(run, f"g long, blob binary, sums binary, {told}"), "lm-seats", "none"))
        contexts_told.append(settled(seats[-1]))
        now = _add_up(seats[-1].select("g", "sums"))
        history = [*history, _totals(first, now | {"root_of_listed": history[-1]["root_of_listed"]}, d0, stirling0, number + 1)]
    known = spark.sparkContext.broadcast(history)

    def answer(t: pa.Table) -> pa.Table:
        release()
        g, p, total = t.column("g")[0].as_py(), opened(t), 0.0
        group = Group(g, p["state"][0], known.value[0], d, d0, n_groups).told(p.get("told0", []))
        for number in range(1, samples + 1):  # the first sweep is burn-in
            group.seated(p[f"seats{number}"][0]).told(p.get(f"told{number + 1}", []))
            total = total + group.predictive(known.value[number + 1])
        log_p, replies, out = np.log10(total / samples).astype(np.float32), unpack(p["asked"][0]), []
        for asked in replies["asked"]:
            at = np.cumsum(asked.astype(np.int64))
            out.append(planes(p=log_p[at], c=small(group.by_word[np.unique(group.wi[at])])))
        return pa.table([pa.array(replies["chunk"], pa.int64()), pa.array([g] * len(out), pa.int64()), pa.array(out, pa.binary())], ["chunk", "g", "blob"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        p, totals = Pairs(left.column("payload")[0].as_py(), left.column("words")[0].values.to_numpy(), listed.value, n_groups), known.value[0]
        replies = dict(zip(right.column("g").to_pylist(), right.column("blob").to_pylist()))
        log_p, count = np.zeros(len(p.order)), np.zeros(len(p.known), np.int64)
        for g, part in cut_by(p.group, n_groups):
            got = unpack(replies[g])
            log_p[p.order[part]] = got["p"]
            count[np.unique(p.word[part])] = got["c"]
        base = np.log10((count + 0.5) / (totals["n"] + 0.5 * (totals["vocabulary"] + 1)))
        row = np.repeat(np.arange(len(p.n)), p.n)
        per_row = lambda v: np.bincount(row, weights=v, minlength=len(p.n))
        columns = [p.ids, pa.array(~p.train), pa.array(p.n), pa.array(per_row(count[p.token] > 0).astype(np.int64)), pa.array(np.full(len(p.n), totals["n"], np.int64)), pa.array(per_row(base[p.token])), pa.array(per_row(log_p[p.pair]))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    of = lambda key, i: F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(PARTS)) == i
    told_of = {f"told{i}": contexts_told[i] for i in (0, *range(2, samples + 2))}
    seats_of = {f"seats{i}": seats[i].select("g", "blob") for i in range(1, samples + 1)}
    for done in (seats[0], contexts_told[1]):
        drop(spark, done)
    asked, replies = states.select("g", F.col("asked").alias("blob")), []
    for i in range(PARTS):
        part = {k: df.where(of("g", i)) for k, df in (("state", state), ("asked", asked), *told_of.items(), *seats_of.items())}
        replies.append(table(spark, gathered(**part).applyInArrow(answer, REPLY), "lm-replies", "none"))
        del part
        spark.sparkContext._jvm.System.gc()
    for done in (states, *seats[1:], contexts_told[0], *contexts_told[2:]):
        drop(spark, done)
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    n_chunks = -(-chunks.count() // PARTS)
    scores = []
    for i in range(PARTS):
        left = dealt(chunks.select("chunk", "payload", "words").where(of("chunk", i)), "chunk", n_chunks)
        right = dealt(functools.reduce(DataFrame.union, replies).where(of("chunk", i)), "chunk", n_chunks)
        scores.append(table(spark, left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(finish, schema), "lm-scores"))
        del left, right
        spark.sparkContext._jvm.System.gc()
    for done in (chunks, *replies):
        drop(spark, done)
    return functools.reduce(DataFrame.union, scores)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return score(docs.withColumn("held", held))
