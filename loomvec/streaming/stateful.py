"""Streams whose constants and totals live in the checkpointed state of the query: a restart goes on with them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "lo double, hi double, seen long"


def first_batch_ranges(stream: DataFrame, key: str = "label", row: str = "vec_id", column: str = "vec", bits: int = 4) -> DataFrame:
    """(key, row, codes, lo, hi, before) of streaming rows: uniform codes over the range of the first batch that brought a key.

    The range and the number of rows so far are state by key: later batches, and a query that starts
    again from its checkpoint, use the first batch's range, and clamp what lies outside. before: the
    key's rows in earlier batches. Rows of later batches pass a chunk at a time; of a key's first batch
    its rows are held until their range is known, so a trigger's limits bound them. Null vectors and
    vectors with nulls are left out; a key without others has no range yet.
    """
    most = float(2**bits - 1)

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[[v is not None and not np.isnan(np.asarray(v, np.float64)).any() for v in f[column]]]
            if len(f):
                yield f

    def run(name: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts: Iterator[pd.DataFrame] = chunks(frames)
        if state.exists:
            lo, hi, seen = state.get
        else:
            held = list(parts)
            if not held:
                return
            flat = [np.concatenate([np.asarray(v, np.float64) for v in f[column]]) for f in held]
            lo, hi, seen = min(x.min() for x in flat), max(x.max() for x in flat), 0
            parts = iter(held)
        before, scale = seen, max((hi - lo) / most, 1e-8)
        for f in parts:
            seen += len(f)
            codes = [np.clip(np.rint((np.asarray(v, np.float64) - lo) / scale), 0, most).astype(np.int32).tolist() for v in f[column]]
            yield pd.DataFrame({key: name[0], row: f[row].to_numpy(), "codes": codes, "lo": lo, "hi": hi, "before": before})
        state.update((float(lo), float(hi), int(seen)))

    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, row)}
    t = stream.where(stream[key].isNotNull()).select(key, row, column).groupBy(key)
    return t.applyInPandasWithState(run, f"{key} {kinds[key]}, {row} {kinds[row]}, codes array<int>, lo double, hi double, before long", STATE, "append", GroupStateTimeout.NoTimeout)
