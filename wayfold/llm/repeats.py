"""Suffix-array dedup: every byte covered by a long string that also starts earlier goes.

Full suffix sorting of a large corpus is a sort of all its bytes.  Here it is done only where it can matter:

1. A string of `length` bytes belongs to the class of the smallest hash among its 32-byte substrings.  Consecutive
   strings of a class make a run (about 35 bytes on); two equal strings are always in runs of one class.
2. Runs are dealt out by class as (class, digest of all bytes that the run's strings cover).  A run whose bytes were
   seen earlier is covered as a whole.  A class with one kind of run holds no other repeats.  Both need no text.  The
   digest has 126 bits: a polynomial modulo 2^64 and two modulo primes, so that no pattern made to cheat the first
   cheats all.
3. Only the runs left, where repeats begin, end or differ, send their bytes.  Their group builds an enhanced suffix
   array, scans it with a stack into the tree of common-prefix intervals, tests each interval's left
   extension for diversity, and so finds the maximal repeats with all their occurrences.  All but the first occurrence
   are covered.

Copies in a chunk are settled before anything is sent, so a passage that many documents share sends one run a chunk.

Order is by doc_id (null first), then position.  Cases: null or empty text: no bytes, nothing removed.  Texts under
`length` bytes are kept.  Of rows that repeat a doc_id and a text one stays and the others are copies of it.  Other
columns, whatever their names, pass through `dedup`.  Removal is by bytes; half characters left at a cut are dropped
from `text`, while kept_sha256 is of the bytes.  Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, inverse_powers, lanes, mix, prefix_hash, span_check, span_hash, table, texts
from .exchange import REPLY, SENT, chunk_table, cut_by, groups_for, open_chunk, pack, rows, small, unpack

LENGTH = 100
GRAM = 32
#: Bytes of text for which there is one hash group, and that one kernel call works on.
GROUP_BYTES = 4 << 20
PIECE_BYTES = 1 << 19
#: Bits for a place in one kernel call's bytes (fewer than twice PIECE_BYTES).
PLACE_BITS = 21

NULL_ID = np.iinfo(np.int64).min


def sliding(a: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best over every n consecutive values, by doubling."""
    width = 1
    while width * 2 <= n:
        a = best(a[:-width], a[width:])
        width *= 2
    return best(a[: len(a) - (n - width)], a[n - width :]) if n > width else a


class Runs:
    """Runs of strings with one anchor: row of the text, first start in it, number of strings, class, digest of covered bytes (two columns).

    A string's anchor is its leftmost substring of least hash; the class is that hash.  No two strings of a run are
    equal, as their anchors stand at different places in them.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        parts = [self._of(data, *piece, length) for piece in _pieces(offsets, length)]
        for k, name in enumerate(("row", "start", "count", "kind", "cover", "check")):
            setattr(self, name, np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, U if k > 2 else np.int64))

    @staticmethod
    def _of(data, row, begin, end, length):
        bounds = np.concatenate(([0], np.cumsum(end - begin)))
        part = np.concatenate([data[a:b] for a, b in zip(begin.tolist(), end.tolist())])
        sums, h = gram_hashes(part, GRAM)
        spot = U((1 << PLACE_BITS) - 1)
        least = sliding((h & ~spot) | np.arange(len(h), dtype=U), length - GRAM + 1, np.minimum)  # hash, then place
        valid = np.ones(len(least), bool)
        for b in bounds[1:].tolist():
            valid[max(0, b - length + 1) : b] = False
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        starts = np.flatnonzero(new)
        stops = np.append(starts, len(valid))[1:]
        dead = np.flatnonzero(~valid)
        if len(dead):
            stops = np.minimum(stops, np.append(dead, len(valid))[np.searchsorted(dead, starts)])
        piece = np.searchsorted(bounds, starts, "right") - 1
        return row[piece], starts - bounds[piece] + begin[piece], stops - starts, h[(least[starts] & spot).astype(np.int64)], span_hash(sums, starts, stops + length - 1), span_check(part, starts, stops + length - 1)


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, begin, end) of stretches of texts, at most PIECE_BYTES together; a longer text is cut so that no string is lost."""
    held, size = [], 0
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b - a >= length:
            end = min(b, a + PIECE_BYTES)
            held.append((r, a, end))
            size += end - a
            if size >= PIECE_BYTES:
                yield tuple(np.array(x) for x in zip(*held))
                held, size = [], 0
            if end == b:
                break
            a = end - length + 1
    if held:
        yield tuple(np.array(x) for x in zip(*held))


def gram_hashes(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a stretch of bytes, and a cheap hash of every n bytes in it."""
    sums = prefix_hash(data)
    return sums, (sums[n:] - sums[:-n]) * inverse_powers(len(data))[: len(data) - n + 1] * U(0xD6E8FEB86659FD93)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before (of all rows but the first)."""
    out = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        out = out | (c[1:] != c[:-1])
    return out


class Chunk:
    """A chunk's texts with their runs; the same whenever it is opened."""

    def __init__(self, payload: bytes, at: int, length: int):
        self.table = open_chunk(payload)
        self.data, self.offsets = texts(self.table.column(at))
        self.runs = Runs(self.data, self.offsets, length)

    def sent(self, ids: np.ndarray, groups: int):
        """Indexes of the runs that are sent, by group: of equal runs the first; and the groups."""
        r = self.runs
        by_row = ids[r.row]
        order = np.arange(len(by_row)) if (by_row[1:] >= by_row[:-1]).all() else np.lexsort((r.start, by_row))
        order = order[np.lexsort((r.kind[order], r.check[order], r.cover[order]))]
        new = np.ones(len(order), bool)
        new[1:] = changes(r.kind[order], r.check[order], r.cover[order])
        chosen = order[new]
        return chosen, group_of(r.kind[chosen], groups)


def group_of(h: np.ndarray, groups: int) -> np.ndarray:
    """Groups in order of the hash; mixed first, as classes are small values."""
    return ((h * U(0x9E3779B97F4A7C15) >> U(32)) * U(groups) >> U(32)).astype(np.int64)


def doc_ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy()


def _send(chunk: int, c: Chunk, groups: int, chosen: np.ndarray, g: np.ndarray, with_bytes: int = 0) -> pa.RecordBatch:
    order = np.argsort(g, kind="stable")
    chosen, g, r, ids = chosen[order], g[order], c.runs, doc_ids(c.table)
    out = [[], [], []]
    for k, part in cut_by(g, groups):
        i = chosen[part]
        known, which = np.unique(ids[r.row[i]], return_inverse=True)
        what = {"kind": r.kind[i], "ids": known, "id": small(which), "start": small(r.start[i] - c.offsets[r.row[i]]), "row": small(r.row[i])}
        if with_bytes:
            ends = r.start[i] + r.count[i] + with_bytes - 1
            what |= {"count": small(r.count[i]), "bytes": b"".join(c.data[a:b].tobytes() for a, b in zip(r.start[i].tolist(), ends.tolist()))}
        else:
            what |= {"cover": r.cover[i], "check": r.check[i]}
        for column, v in zip(out, (k, chunk, pack(**what))):
            column.append(v)
    return rows(SENT, *out)


def _gather(table: pa.Table):
    """The packed arrays of a group, put together; and where each chunk's part lies."""
    parts = [unpack(b) for b in table.column("blob").to_pylist()]
    sizes = [len(p["kind"]) for p in parts]
    chunk = np.repeat(table.column("chunk").to_numpy(), sizes)
    get = lambda k, kind: np.concatenate([p[k] for p in parts]).astype(kind)
    ids = np.concatenate([p["ids"][p["id"]] for p in parts])
    return parts, sizes, chunk, get, ids


def settle(table: pa.Table) -> pa.Table:
    """What becomes of each run sent to a group.  0: not repeated; 1: covered; 2: its bytes are needed."""
    parts, sizes, chunk, get, ids = _gather(table)
    kind, cover, check = get("kind", U), get("cover", U), get("check", U)
    order = np.lexsort((get("row", np.int64), chunk, get("start", np.int64), ids, check, cover, kind))
    new_kind, new = np.ones(len(order), bool), np.ones(len(order), bool)
    new_kind[1:] = changes(kind[order])
    new[1:] = changes(kind[order], cover[order], check[order])
    covers = np.bincount(np.cumsum(new_kind) - 1, weights=new)[np.cumsum(new_kind) - 1]
    state = np.empty(len(order), np.uint8)
    state[order] = np.where(~new, 1, np.where(covers > 1, 2, 0))
    g = table.column("g").to_pylist()
    blobs = [pack(state=s) for s in np.split(state, np.cumsum(sizes)[:-1])]
    return pa.Table.from_batches([rows(REPLY, table.column("chunk").to_pylist(), g, blobs)])


def suffix_ranks(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(those of `at` whose next `depth` bytes recur in `at`, rank of each among them by these bytes).

    Candidates meet by a hash of the bytes; those whose hash recurs are ranked by the bytes themselves.
    """
    eight, spare = lanes(data), -depth % 8
    keep = np.full(8, 255, np.uint8)
    keep[8 - spare :] = 0  # bytes of the last lane that lie beyond
    masks = [U(2**64 - 1)] * (-(-depth // 8) - 1) + [keep.view("<u8")[0]]
    h = np.full(len(at), U(depth), U)
    for k, m in enumerate(masks):
        h = mix(h ^ (eight[at + 8 * k] & m))
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = changes(h[order])
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    some = order[np.repeat(size > 1, size)]
    if not len(some):
        return some, some
    keys = [(eight[at[some] + 8 * k] & m).byteswap() for k, m in enumerate(masks)]  # in order of the bytes
    fine = np.lexsort(keys[::-1])
    fresh = np.ones(len(fine), bool)
    fresh[1:] = changes(*[k[fine] for k in keys])
    rank = np.cumsum(fresh) - 1
    size = np.bincount(rank)
    recurs = size[rank] > 1
    return some[fine][recurs], rank[recurs]


def interval_tree(lcp: list[int], left: list[int], order: list[int], least: int, groups: list | None = None) -> list[int]:
    """Scans an enhanced suffix array with a stack.

    lcp[i]: common prefix of suffixes i-1 and i; left[i]: the byte before suffix i (a value of its own if none);
    order[i]: its place in reading order.  Returns for each suffix the length of the longest maximal repeat of at least
    `least` bytes of which it isn't the first occurrence, or 0; groups, if given, gets (length, first, last) of each
    maximal repeat: all its occurrences are the suffixes first..last.

    An interval whose suffixes all follow the same byte is no maximal repeat: the one a byte to the left is.
    Each suffix loses to an earlier one in just one interval, so the work is linear.
    """
    n, cover = len(left), [0] * len(left)
    stack: list[list] = []  # [length, first suffix, byte to the left or None if they differ, earliest suffix, those that lost]
    for i in range(1, n + 1):
        now = lcp[i] if i < n else 0
        child = (i - 1, left[i - 1], i - 1)
        while True:
            if stack and stack[-1][0] >= max(now, least):
                top = stack[-1]
                if child[1] != top[2]:
                    top[2] = None
                if order[child[2]] < order[top[3]]:
                    top[4].append(top[3])
                    top[3] = child[2]
                else:
                    top[4].append(child[2])
                if top[0] == now:
                    break
                stack.pop()
                if top[2] is None:
                    for x in top[4]:
                        cover[x] = max(cover[x], top[0])
                    if groups is not None:
                        groups.append((top[0], top[1], i - 1))
                child = (top[1], top[2], top[3])
                continue
            if now >= least:
                stack.append([now, child[0], child[1], child[2], []])
            break
    return cover


def repeats(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, at: np.ndarray, place: np.ndarray, length: int, groups: list | None = None):
    """Suffixes among `at` (positions in data, each of a stretch from begins[k] to ends[k], `length` bytes on at least) that repeat.

    place: rank of each in reading order.  Returns (positions, cover) in suffix order, see interval_tree.
    """
    k, rank = suffix_ranks(data, at, length)
    if not len(k):
        return k, []
    room = ends[k] - at[k] - length
    deep = int(room.max()) if len(room) else 0
    if deep:  # beyond `length` bytes, up to the end of each stretch
        padded = np.concatenate((data, np.zeros(deep + length, np.uint8)))
        step = max(1, (32 << 20) // max(1, deep))
        tail = np.concatenate([np.where(np.arange(deep) < room[i : i + step, None], padded[at[k][i : i + step, None] + length + np.arange(deep)], 0).astype(np.uint8) for i in range(0, len(k), step)])
        wide = -(-deep // 8) * 8
        keys = np.ascontiguousarray(np.pad(tail, ((0, 0), (0, wide - deep)))).view(">u8").astype(U)
        fine = np.lexsort((*[keys[:, j] for j in range(keys.shape[1] - 1, -1, -1)], rank))
        k, rank, room, tail = k[fine], rank[fine], room[fine], tail[fine]
        differ = tail[1:] != tail[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), deep)
        common = np.minimum(common, np.minimum(room[1:], room[:-1]))
    else:
        fine = np.argsort(rank, kind="stable")
        k, rank = k[fine], rank[fine]
        common = np.zeros(len(k) - 1, np.int64)
    lcp = np.zeros(len(k), np.int64)
    lcp[1:] = np.where(rank[1:] == rank[:-1], common + length, 0)
    p = at[k]
    left = np.where(p == begins[k], -1 - np.arange(len(p)), data[np.maximum(p - 1, 0)].astype(np.int64))
    return k, interval_tree(lcp.tolist(), left.tolist(), place[k].tolist(), length, groups)


def resolve(table: pa.Table, length: int) -> pa.Table:
    """Which bytes of the runs sent to a group are covered: (run, start in it, length)."""
    parts, sizes, chunk, get, ids = _gather(table)
    count, start, row = get("count", np.int64), get("start", np.int64), get("row", np.int64)
    data = np.frombuffer(b"".join(p["bytes"] for p in parts), np.uint8)
    size = count + length - 1
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    run = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[run] + inside
    place = np.empty(len(at), np.int64)
    place[np.lexsort((row[run], chunk[run], start[run] + inside, ids[run]))] = np.arange(len(at))
    k, cover = repeats(data, begin[run], (begin + size)[run], at, place, length)
    cover = np.array(cover, np.int64)
    k, cover = k[cover > 0], cover[cover > 0]
    order = np.argsort(run[k], kind="stable")
    k, cover = k[order], cover[order]
    first = np.concatenate(([0], np.cumsum(sizes)))
    cuts = np.searchsorted(run[k], first)
    blobs = [pack(run=small(run[k[a:b]] - f), start=small(inside[k[a:b]]), cover=small(cover[a:b])) for a, b, f in zip(cuts[:-1], cuts[1:], first)]
    return pa.Table.from_batches([rows(REPLY, table.column("chunk").to_pylist(), [-1 - g for g in table.column("g").to_pylist()], blobs)])


DIGEST = (("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()))


def dedup(docs: DataFrame, length: int = LENGTH, digest: tuple[str, str, str, str] | None = None) -> DataFrame:
    """docs (doc_id, text and any others) with the repeated bytes cut from text.

    digest: names under which n_bytes, n_removed, n_spans and kept_sha256 are added; else they are left out.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")
    chunks = chunk_table(docs, "repeats-chunks")
    groups = groups_for(chunks.agg(F.sum("n_bytes")).first()[0] or 0, GROUP_BYTES)
    schema = docs.schema if digest is None else T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, (_, t) in zip(digest, DIGEST))])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                c = Chunk(payload, at, length)
                yield _send(chunk, c, groups, *c.sent(doc_ids(c.table), groups))

    def states(c: Chunk, replies: dict[int, dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State of each run, and what was sent: runs and groups in order."""
        chosen, g = c.sent(doc_ids(c.table), groups)
        order = np.argsort(g, kind="stable")
        state = np.ones(len(c.runs.row), np.uint8)  # a run that wasn't sent is a copy of one that was
        for k, part in cut_by(g[order], groups):
            state[chosen[order][part]] = replies[k]["state"]
        return state, chosen[order], g[order]

    def opened(left: pa.Table, right: pa.Table) -> tuple[int, Chunk, dict[int, dict]]:
        return left.column("chunk")[0].as_py(), Chunk(left.column("payload")[0].as_py(), at, length), {g: unpack(b) for g, b in zip(right.column("g").to_pylist(), right.column("blob").to_pylist())}

    def send_bytes(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([rows(SENT, [], [], [])])
        chunk, c, replies = opened(left, right)
        state, chosen, g = states(c, replies)
        open_ = state[chosen] == 2
        return pa.Table.from_batches([_send(chunk, c, groups, chosen[open_], g[open_], with_bytes=length)])

    names = [f.name for f in schema.fields]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        _, c, replies = opened(left, right)
        state, chosen, g = states(c, replies)
        r, edge = c.runs, np.zeros(len(c.data) + 1, np.int64)
        whole = state == 1
        np.add.at(edge, r.start[whole], 1)
        np.add.at(edge, r.start[whole] + r.count[whole] + length - 1, -1)
        open_ = state[chosen] == 2
        for k, part in cut_by(g[open_], groups):
            got = replies[-1 - k]
            starts = r.start[chosen[open_][part][got["run"].astype(np.int64)]] + got["start"].astype(np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + got["cover"].astype(np.int64), -1)
        gone = np.cumsum(edge[:-1]) > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        at_start = c.offsets[:-1][c.offsets[:-1] < len(gone)]
        begin[at_start] |= gone[at_start]
        total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[c.offsets])
        removed, spans = total(gone), total(begin)
        old, new, hashes = c.table.column(at).to_pylist(), [], []
        for k, (a, b) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist())):
            kept = c.data[a:b][~gone[a:b]].tobytes() if removed[k] else c.data[a:b].tobytes()
            new.append(kept.decode("utf-8", "ignore") if removed[k] else old[k])
            hashes.append(hashlib.sha256(kept).hexdigest() if digest else None)
        columns = list(c.table.columns)
        columns[at] = pa.array(new, c.table.column(at).type)
        if digest:
            columns += [pa.array(np.diff(c.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())]
        return pa.table(columns, names)

    settled = chunks.mapInArrow(send, SENT).groupBy("g").applyInArrow(settle, REPLY)
    settled = table(spark, settled, "repeats-settled", "none")
    left = chunks.select("chunk", "payload")
    bytes_sent = left.groupBy("chunk").cogroup(settled.groupBy("chunk")).applyInArrow(send_bytes, SENT)
    resolved = bytes_sent.groupBy("g").applyInArrow(lambda t: resolve(t, length), REPLY)
    answers = settled.unionByName(resolved)
    return left.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def maximal_repeats(corpus: list[bytes], length: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Maximal repeats of at least `length` bytes in a few texts, with all occurrences (text, position), in one suffix array."""
    data = np.frombuffer(b"".join(corpus), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in corpus])))
    at = np.concatenate([np.arange(a, max(a, b - length + 1)) for a, b in zip(bounds[:-1], bounds[1:])]) if corpus else np.zeros(0, np.int64)
    if not len(at):
        return []
    row = np.searchsorted(bounds, at, "right") - 1
    groups: list[tuple[int, int, int]] = []
    k, _ = repeats(data, bounds[row], bounds[row + 1], at, np.arange(len(at)), length, groups)
    return [(data[at[k[a]] : at[k[a]] + size].tobytes(), sorted((int(row[k[i]]), int(at[k[i]] - bounds[row[k[i]]])) for i in range(a, b + 1))) for size, a, b in groups]


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, digest=tuple(n for n, _ in DIGEST)).drop("text")
