"""Whole series in tasks: rows come sorted by series and date, and one series after the other is held.

A series has one row per date, so its length is bounded by the calendar; a task holds one series, or
a small batch of them, however many its partition has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_series(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by series to as many tasks as the session has for a shuffle.

    The number is given, as tasks would else be merged by the little that they read, and work on a
    series takes much longer than reading it: some cores would have two of them and others none.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series")


def in_runs(series: DataFrame) -> DataFrame:
    return by_series(series.select("series", "ds", "qty")).sortWithinPartitions("series", "ds")


def each_series(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, pa.Scalar, np.ndarray, bool]]:
    """(series, last date, quantities in order, whether one is null) from batches of ``in_runs``; a null quantity is NaN."""
    key, day, parts, nulls = None, None, [], False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, days, qty = batch.column(0), batch.column(1), batch.column(2)
        values = qty.to_numpy(zero_copy_only=False).astype(float)
        ends = pa.compute.run_end_encode(keys).run_ends.to_pylist()
        start = 0
        for end in ends:
            found = keys[start]
            if parts and found != key:
                yield key, day, np.concatenate(parts), nulls
                parts, nulls = [], False
            key, day = found, days[end - 1]
            parts.append(values[start:end].copy())
            nulls = nulls or qty.slice(start, end - start).null_count > 0
            start = end
    if parts:
        yield key, day, np.concatenate(parts), nulls
