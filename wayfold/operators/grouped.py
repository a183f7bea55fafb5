"""Kernels over many small groups: a sorted partition is streamed and cut into groups, instead of one call a group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], kernel: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that kernel(key, columns) returns for each group, after the group's key.

    columns: the group's `values` as NumPy arrays, in `order` (numbers; nulls are NaN).  schema: DDL of the keys and then
    the kernel's columns.  A task holds one Arrow batch and the group that its end cuts; groups of any number cost no
    call of their own.
    """
    kinds = [c.split(" ", 1) for c in schema.split(", ")]
    out_schema = pa.schema([(n, _ARROW[k]) for n, k in kinds])

    def cut(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        """Results of the groups that are whole, and the rest."""
        n = t.num_rows
        new = np.zeros(n, bool)
        if n:
            new[0] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        stop = n if last else int(starts[-1])
        bounds = [*starts[starts < stop].tolist(), stop]
        named = [t.column(k).take(pa.array(bounds[:-1], pa.int64())).to_pylist() for k in keys]
        columns = {v: t.column(v).to_numpy() for v in values}
        rows: list[tuple] = []
        for g, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            key = tuple(c[g] for c in named)
            rows += [(*key, *r) for r in kernel(key, {v: c[a:b] for v, c in columns.items()})]
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema) if rows else None
        return made, t.slice(stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [*(rest.to_batches() if rest is not None else []), batch]
            made, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
            if made is not None:
                yield made
        if rest is not None and rest.num_rows:
            made, _ = cut(rest.combine_chunks(), True)
            if made is not None:
                yield made

    # a number that isn't coalesced: what takes time here is the kernel, not the bytes
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*dict.fromkeys([*keys, *order, *values])).repartition(n, *keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)
