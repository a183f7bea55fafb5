"""Run segmentation of a stream of samples: what a batch does with lag, a stream does with a little state per track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators.sequence import TRACK

OUT = "scenario_id string, trajectory_id string, sample_index int, timestamp_ns long, run_index int"


def stream_runs(samples: DataFrame) -> DataFrame:
    """Valid samples with their run_index, as they come in.

    samples must come in order within a track, batch by batch; a sample at or before the last one seen is an error, as
    it would be in an ordered scan.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, before, run = state.get if state.exists else (-1, False, -1)
        for pdf in [pd.concat(list(batches)).sort_values("sample_index")]:
            out = []
            for i, t, ok in zip(pdf.sample_index, pdf.timestamp_ns, pdf.is_valid):
                if i <= last:
                    raise ValueError(f"sample {i} of {key} comes after {last}")
                run += bool(ok and not before)
                if ok:
                    out.append((*key, i, t, run))
                last, before = int(i), bool(ok)
            state.update((last, before, run))
            yield pd.DataFrame(out, columns=[*TRACK, "sample_index", "timestamp_ns", "run_index"])

    return samples.groupBy(*TRACK).applyInPandasWithState(step, OUT, "last int, before boolean, run int", "append", "NoTimeout")
