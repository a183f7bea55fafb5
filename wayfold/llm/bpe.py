"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 state machine.

Encoding.  In the encoding of any text each two neighbouring tokens, put together and encoded alone, give the same two
tokens again, and only one sequence over the text has that property.  So merges need no priority queue: a
non-deterministic transducer reads bytes, guesses where tokens end (the tokens form a trie) and keeps the guesses whose
neighbours are compatible.  Its subset construction is built lazily, one (state, byte) at a time: a deterministic state
is the set of live guesses after what all of them agree on, and what they agree on is emitted at once, which happens
within a bounded lookahead because a guess lives no longer than the longest token.  A piece that is itself in the
vocabulary is that token, as in the tiktoken library.

Each match of the split pattern is encoded separately.  A transition is stored where a piece first leaves what is known;
those after it are made by the same construction and stored when another piece comes by.  Distinct pieces,
transitions and pairs of tokens are kept on each worker in caches bounded by their bytes; a machine that is full keeps
what it has, and a partition begins with a new one if it was full.

Cases: null text: as empty (0 tokens, both digests of the empty string).  Repeated rows: one result each.  Extra
columns pass through; a result column replaces an input column of its name.  Empty table: empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import release, tune

#: Bytes, by the estimates below, that a worker keeps of distinct pieces (in each of two generations), of transitions
#: and of pairs of tokens before it starts afresh.
PIECE_BYTES = 96 << 20
TRANSITION_BYTES = 40 << 20
PAIR_BYTES = 24 << 20
#: What an entry of the caches takes beside its own text, ids or guesses: dictionary slots, tuples, numbers.
_PIECE, _TRANSITION, _STATE, _GUESS, _PAIR = 320, 240, 240, 110, 160
#: Bytes after which a run that isn't stored looks for what can be emitted (stored transitions look after each byte), so
#: the lookahead is that of the longest token and so many bytes.
EMIT_EVERY = 8
#: Characters of a text from which pieces are taken from an iterator instead of a list.
LONG_TEXT = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Bytes of one piece -> token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._child: dict[int, int] = {}  # trie of the tokens: node << 8 | byte -> node
        self._info = [1]  # of a node: token that ends there + 1 (0: none), doubled, and 1 if a longer token goes on
        self._halves: dict[int, tuple[int, int]] = {}  # the two tokens whose merge makes one; a byte twice
        for t, i in ranks.items():
            halves = self.merge(t, i) if len(t) > 1 else [i, i]
            if len(halves) != 2:
                continue  # merging never ends in this token
            self._halves[i] = tuple(halves)
            node = 0
            for byte in t:
                self._info[node] |= 1
                node = self._child.setdefault(node << 8 | byte, len(self._info))
                if node == len(self._info):
                    self._info.append(0)
            self._info[node] |= i + 1 << 1
        self._pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (None, (((), 0),))
        self._ids = {start: 0}
        self._states = [start]
        self._next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.held = 0

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """Plain merging by rank, of ranks under `below`; used on single tokens, and as the yardstick in tests."""
        parts, none = [piece[i : i + 1] for i in range(len(piece))], 1 << 60
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            if (least := min(ranks)) >= below:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, a: int, b: int) -> bool:
        """True if a, b put together are encoded as a, b.

        Merges across the border come from the right edge of a's merge tree and the left edge of b's.  Both trees are
        taken apart from the last merge back; a pair at the border that would have merged before the edge did is a
        conflict.
        """
        pair, limit, known = a << 20 | b, 1 << 60, True
        rank, spelled, halves = self.ranks.get, self.bytes_of, self._halves
        inner, outer = halves[a][1], halves[b][0]
        while True:
            if rank(spelled[a] + spelled[b], limit) < limit:
                known = False
                break
            if a > b and inner != a or outer == b:
                if inner == a:
                    break
                limit, a = a, inner
                inner = halves[a][1]
            else:
                limit, b = b + 1, outer
                outer = halves[b][0]
        if len(self._pairs) * _PAIR > PAIR_BYTES:
            self._pairs.clear()
        self._pairs[pair] = known
        return known

    def _run(self, before: int | None, live: tuple, piece: bytes, out: list[int], every: int) -> tuple[int | None, tuple]:
        """The transition function over some bytes: appends what is emitted to `out`, returns the state after them.

        A state is (last token, guesses); a guess is (tokens after what is agreed, trie node of the token under way;
        0: none).  What all guesses agree on is emitted after every `every` bytes; guesses are tuples in order, so what
        the least and the greatest share all share.  As a text has one sequence of compatible neighbours, at each byte
        at most one guess can end a token.
        """
        step, fitting, infos = self._child.get, self._pairs.get, self._info
        dones, nodes = map(list, zip(*live)) if live else ([], [])
        for count, byte in enumerate(piece, 1):
            kept, at, ended = [], [], None
            for done, node in zip(dones, nodes):
                if (node := step(node << 8 | byte)) is None:
                    continue
                info = infos[node]
                if info & 1:
                    kept.append(done)
                    at.append(node)
                if ended is None and info > 1:
                    t = (info >> 1) - 1
                    if (last := done[-1] if done else before) is not None:
                        if (fits := fitting(last << 20 | t)) is None:
                            fits = self._compatible(last, t)
                        if not fits:
                            continue
                    ended = (*done, t)
            if ended is not None:
                kept.append(ended)
                at.append(0)
            dones, nodes = kept, at
            if count % every:
                continue
            if len(dones) == 1:
                emitted, dones = dones[0], [()]
            else:
                low, high = min(dones), max(dones)
                agreed, most = 0, min(len(low), len(high))
                while agreed < most and low[agreed] == high[agreed]:
                    agreed += 1
                emitted = low[:agreed]
                if agreed:
                    dones = [done[agreed:] for done in dones]
            if emitted:
                before = emitted[-1]
                out += emitted
        return before, tuple(zip(dones, nodes))

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """One transition of the determinised machine, stored when it is first taken."""
        out: list[int] = []
        before, live = self._run(*self._states[state], bytes((byte,)), out, 1)
        if all(done for done, _ in live):
            before = None  # no guess looks back at it
        key = (before, live)
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
            self.held += _STATE + _GUESS * len(live)
        self.held += _TRANSITION
        self._next[state << 8 | byte] = got = (to, tuple(out))
        return got

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of a piece.

        The stored machine grows by one transition where a piece first leaves what is known, until it is full.
        """
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out: list[int] = []
        state, known = 0, self._next
        for i, byte in enumerate(piece):
            got = known.get(state << 8 | byte)
            if got is None:
                if self.held < TRANSITION_BYTES:
                    state, emitted = self._step(state, byte)
                    out += emitted
                    i += 1
                _, live = self._run(*self._states[state], piece[i:], out, EMIT_EVERY)
                break
            state, emitted = got
            out += emitted
        else:
            live = self._states[state][1]
        for done, node in live:
            if not node:
                out += done
                break
        return out


class Pieces(dict):
    """piece -> (its ids as decimals joined by commas, the bytes that these decode to), made once per distinct piece.

    Two generations: what was used lately survives when the older generation goes.
    """

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine
        self.older: dict[str, tuple[str, bytes]] = {}
        self.held = 0

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        both = self.older.get(piece)
        if both is None:
            ids = self.machine.encode(piece.encode())
            both = (",".join(map(str, ids)), b"".join(map(self.machine.bytes_of.__getitem__, ids)))
        if len(piece) < 200:
            if self.held >= PIECE_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self.held += _PIECE + 5 * len(piece) + len(both[0])
            self[piece] = both
        return both


class Utf8Stream:
    """Incremental UTF-8 state machine: feed bytes in any blocks, get the text that is complete so far.

    The state is the number of continuation bytes that the last character still waits for, with the bytes it has.
    Malformed bytes become U+FFFD, as a decoder over the whole would give.
    """

    def __init__(self):
        self.held = b""

    def feed(self, block: bytes) -> str:
        block = self.held + block
        cut = len(block)
        for back in range(1, min(4, len(block)) + 1):
            b = block[-back]
            if b & 0xC0 == 0x80:
                continue
            wants = 4 if 0xF0 <= b <= 0xF4 else 3 if 0xE0 <= b < 0xF0 else 2 if 0xC2 <= b < 0xE0 else 1
            if wants > back:
                try:
                    block[-back:].decode()
                except UnicodeDecodeError as e:  # "unexpected end": it may still become a character
                    if e.end == back and "unexpected end" in e.reason:
                        cut = len(block) - back
            break
        self.held = block[cut:]
        return block[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


_codecs: dict[tuple[str, str], tuple] = {}


def codec(path: str, pattern: str) -> tuple[regex.Pattern, Pieces, Transducer]:
    """One per worker: compiled pattern, piece cache, transducer."""
    if (path, pattern) not in _codecs:
        machine = Transducer(load_ranks(path))
        _codecs[path, pattern] = (regex.compile(pattern), Pieces(machine), machine)
    return _codecs[path, pattern]


def id_blocks(text: str, pattern: regex.Pattern, pieces: Pieces) -> Iterator[tuple[str, bytes]]:
    """The ids of a text, comma-joined, and the bytes that they decode to; one block unless the text is very long."""
    if len(text) < LONG_TEXT:
        if text:
            yield _block(map(pieces.__getitem__, pattern.findall(text)))
        return
    found = (m.group() for m in pattern.finditer(text))
    while block := list(islice(found, 50_000)):
        yield _block(map(pieces.__getitem__, block))


def _block(both: Iterable[tuple[str, bytes]]) -> tuple[str, bytes]:
    ids, raw = zip(*both)
    return ",".join(ids), b"".join(raw)


def encode_decode(df: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 (and ids, array<int>, if keep_ids) to each row of df, which has `text`."""
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        new.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in names and f.name != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, machine = codec(path, pattern)
        if machine.held >= TRANSITION_BYTES:
            machine.reset()
        for batch in batches:
            counts, id_hashes, text_hashes, all_ids = [], [], [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                n, ids_hash, text_hash, stream = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream()
                for ids, raw in id_blocks(text or "", split, pieces):
                    if n:
                        ids_hash.update(b",")
                    ids_hash.update(ids.encode())
                    n += ids.count(",") + 1
                    text_hash.update(stream.feed(raw).encode())
                    if keep_ids:
                        all_ids.append(np.array(ids.split(",")).astype(np.int32))
                text_hash.update(stream.finish().encode())
                counts.append(n)
                id_hashes.append(ids_hash.hexdigest())
                text_hashes.append(text_hash.hexdigest())
            made = [pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            if keep_ids:
                ends = np.cumsum([0, *counts]).astype(np.int32)  # a batch of at most BATCH_ROWS texts
                made.append(pa.ListArray.from_arrays(ends, np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)))
            old = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays(old + made, [f.name for f in kept] + [f.name for f in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        on = gc.isenabled()
        gc.disable()  # the caches hold no cycles, and scanning them costs more than all else
        try:
            yield from rows(batches)
        finally:
            if on:
                gc.enable()

    tune(df.sparkSession)
    return df.select(*[f"`{f.name}`" for f in kept], "text").mapInArrow(run, T.StructType(kept + new))


def decode(ids: Iterator[int], bytes_of: Callable[[int], bytes], block: int = 4096) -> Iterator[str]:
    """Streams the text of a stream of ids, each part as soon as its characters are complete."""
    stream, ids = Utf8Stream(), iter(ids)
    while some := list(islice(ids, block)):
        yield stream.feed(b"".join(map(bytes_of, some)))
    yield stream.finish()


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
