"""Rolling order statistics, by a sorted window that slides over Arrow batches."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofly.functions.factors import W
from asofly.operators.timeblocks import in_blocks


def sliding_rank(frame: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """The frame with the percentile rank of x among the last n rows of an asset, ties averaged; null unless all n have one.

    The rows of a window over (asset, event_time) arrive in order; a sorted list holds the last n values, takes the new one
    and gives up the oldest one. Nothing is built anew for a row, so the cost hardly depends on n.
    """
    schema = T.StructType([*frame.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, missing = deque(), [], 0
        for b in batches:
            at, out = b.num_columns - 2, []
            for first, v in zip(b.column(at + 1).to_pylist(), b.column(at).to_pylist(), strict=True):
                if first:
                    last, held, missing = deque(), [], 0
                if len(last) == n:
                    old = last.popleft()
                    if old is None:
                        missing -= 1
                    else:
                        del held[bisect_left(held, old)]
                last.append(v)
                if v is None:
                    missing += 1
                    out.append(None)
                    continue
                insort(held, v)
                low = bisect_left(held, v)
                out.append((low + (bisect_right(held, v) - low + 1) / 2) / n if len(last) == n and not missing else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.float64())], names=schema.names)

    value = F.nullif(F.col(x).cast("double"), F.lit(float("nan")))
    return frame.withColumns({"_value": value, "_first": F.row_number().over(W()) == 1}).mapInArrow(run, schema)


def rolling_rank(frame: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """sliding_rank chunk by chunk, so that no task holds an asset's history."""
    return in_blocks(frame, lambda f: sliding_rank(f, x, n, name), before=n - 1)
