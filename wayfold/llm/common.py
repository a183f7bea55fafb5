"""Shared plumbing of the training-data operators: tables in the shared folder, Arrow columns, byte kernels.

All kernels take whole texts as UTF-8 bytes.  A null text is an empty text.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch; a bound on bytes follows from slicing in `slices`.
BATCH_ROWS = 256
#: Bytes of text that one numpy kernel call works on (a longer text is one slice of its own).
SLICE_BYTES = 2 << 20

U = np.uint64
_P = U(0x9E3779B97F4A7C55 | 1)
_P_INV = U(pow(int(_P), -1, 1 << 64))


def tune(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for very long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base


def table(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns it read again: lineage ends there and a lost executor costs no recomputation."""
    path = f"{shared_dir(spark)}/wayfold/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.wayfold_path = path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)  # what a lazy result still reads goes with the application
    return out


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table made by `table` that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df.wayfold_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system, for the workers of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable) -> Callable:
    """A function of batches that releases memory at the end of its partition."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def lut(pattern: bytes) -> np.ndarray:
    """A table of 256 booleans, true for the given byte values."""
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern, np.uint8)] = True
    return out


#: Bytes of words that end at ASCII white space: everything but \x20 and \x09-\x0D.
NOT_SPACE = ~lut(b" \t\n\x0b\x0c\r")
#: Bytes of words of digits, lower-case letters and all that is not ASCII (after lower-casing).
ALNUM = lut(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; a word never crosses from one text to the next."""
    w = inside[data]
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = w.copy()
    first[1:] &= ~w[:-1]
    at = offsets[:-1]
    at = at[at < len(w)]
    first[at] |= w[at]
    starts = np.flatnonzero(first)
    stop = ~w
    stop[at] = True  # a text that begins ends the word before it
    stops = np.append(np.flatnonzero(stop), len(w))
    return starts, stops[np.searchsorted(stops, starts, "right")]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: Bytes of a stretch that polynomial hashes work on at once: the tables of powers never grow.
STRETCH = 1 << 20
#: Words up to this many bytes are hashed by lanes of eight bytes, longer ones by a library digest.
LANE_BYTES = 64
#: Moduli and bases of the polynomial hash: 2^64 and two primes, as patterns that cheat a power of two don't cheat a prime.
_PRIMES = ((2147483647, 1103515245), (2147483629, 762939453))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(modulus: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash's base and of its inverse, for the places of a stretch; modulus 0 is 2^64."""
    if modulus not in _tables:
        if modulus:
            base = dict(_PRIMES)[modulus]
            pair = []
            for b in (base, pow(base, -1, modulus)):
                out = np.ones(1, U)
                while len(out) <= STRETCH:
                    out = np.concatenate((out, out * U(pow(b, len(out), modulus)) % U(modulus)))
                pair.append(out[: STRETCH + 1])
            _tables[modulus] = tuple(pair)
        else:
            pair = []
            for b in (_P, _P_INV):
                out = np.full(STRETCH + 1, b, U)
                out[0] = 1
                pair.append(np.cumprod(out, dtype=U))
            _tables[0] = tuple(pair)
    return _tables[modulus]


def inverse_powers(n: int) -> np.ndarray:
    """Inverse powers of the hash's base for the first n places of a stretch."""
    return _powers()[1][:n]


def prefix_hash(data: np.ndarray, modulus: int = 0) -> np.ndarray:
    """Running sums of a polynomial over at most STRETCH bytes; `span_hash` cuts any span's hash out of them.

    Under a prime the terms stay below 2^39, so that sums over a stretch need no reduction.
    """
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * _powers(modulus)[0][: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    h = (sums[ends] - sums[starts]) * _powers()[1][starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def span_check(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62 more bits of data[start:end], by two primes; with `span_hash` a digest of 126 bits."""
    out = np.zeros(len(starts), U)
    for modulus, _ in _PRIMES:
        sums = prefix_hash(data, modulus)
        m = U(modulus)
        out = out << U(31) | (sums[ends] - sums[starts]) % m * _powers(modulus)[1][starts] % m
    return out


def lanes(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes that begin at each place (zeros after the end)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] by bytes alone: each lane of eight bytes is mixed into what came before."""
    size = ends - starts
    h = size.astype(U) * U(0xD6E8FEB86659FD93)
    eight, at, own, left = lanes(data), starts, None, size
    for k in range(0, LANE_BYTES, 8):
        if k:
            own = np.flatnonzero(size > k)
            if not len(own):
                break
            at, left = starts[own] + k, size[own] - k
        lane = eight[at] & _MASKS[np.minimum(left, 8)]
        if own is None:
            h = mix(h ^ mix(lane))
        else:
            h[own] = mix(h[own] ^ mix(lane))
    for i in np.flatnonzero(size > LANE_BYTES).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes of all words, and the row of each."""
    starts, ends = spans(data, offsets, inside)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, word_hashes(data, starts, ends), rows


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive values (positions 0 to len-n)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for k in range(n):
        out *= U(0xC2B2AE3D27D4EB4F)
        out += hashes[k : k + m]
    return mix(out + U(n))
