"""Bulk exchange between chunks of documents and hash groups.

Operators that must look up millions of n-grams ship packed arrays instead of rows: the documents are written once as
chunks (a few MB each) to the shared folder; a chunk sends one packed array per hash group, a group answers with one
packed array per chunk.  Rows are few, bytes are what the arrays need, and each group and chunk has a bounded size
because their number follows the input.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import released, table, texts, tune

CHUNK_BYTES = 4 << 20

#: What is dealt out: to hash group g, from a chunk.
SENT = "g long, chunk long, blob binary"
#: What comes back: to a chunk, from group g.
REPLY = "chunk long, g long, blob binary"


def pack(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def planes(**arrays) -> bytes:
    """As pack; numbers of several bytes (arrays or lists of arrays) lie byte by byte, which takes less room."""

    def plane(a):
        if isinstance(a, list):
            return [plane(x) for x in a]
        if not isinstance(a, np.ndarray) or a.dtype.itemsize == 1:
            return a
        return a.dtype.str, np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T)

    return pack(**{k: plane(v) for k, v in arrays.items()})


def unpack(blob: bytes) -> dict:
    def whole(a):
        if isinstance(a, list):
            return [whole(x) for x in a]
        return np.ascontiguousarray(a[1].T).reshape(-1).view(a[0]) if isinstance(a, tuple) else a

    return {k: whole(v) for k, v in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)).items()}


def small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers (none negative) in the fewest bytes."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def chunk_table(df: DataFrame, name: str, size: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, n_bytes, payload): rows of df, with all their columns, in chunks of about `size` bytes of text."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, held_bytes = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([held_bytes], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_bytes", "payload"])

        for batch in batches:
            _, offsets = texts(batch.column(at))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size - held_bytes, "right")) - 1)
                held.append(batch.slice(a, b - a))
                held_bytes += int(offsets[b] - offsets[a])
                a = b
                if held_bytes >= size or a < batch.num_rows:
                    yield out()
                    chunk, held, held_bytes = chunk + 1, [], 0
        if held:
            yield out()

    tune(df.sparkSession)
    return table(df.sparkSession, df.mapInArrow(released(run), "chunk long, n_bytes long, payload binary"), name, "none")


def open_chunk(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def groups_for(total_bytes: int, each: int) -> int:
    return max(1, -(-int(total_bytes) // each))


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df dealt out by key over n partitions, as many as there are groups or chunks: what a task reads doesn't grow with the input."""
    return df.repartition(max(1, n), key)


def rows(schema: str | T.StructType, *columns) -> pa.RecordBatch:
    """A batch of the columns in the order of a DDL schema of longs and binaries."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names])


def cut_by(group: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(g, slice) of each group present in sorted `group`."""
    bounds = np.searchsorted(group, np.arange(n + 1))
    for g in np.flatnonzero(np.diff(bounds)).tolist():
        yield g, slice(int(bounds[g]), int(bounds[g + 1]))
