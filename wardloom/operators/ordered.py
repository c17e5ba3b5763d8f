"""Ordered scans over entities of any size.

Rows are range-partitioned by (entity, time, tie-break), so an entity that holds a third of all
rows is spread over as many partitions as its size asks for; each partition is sorted and read
once, in order, with constant memory. Whatever touches a partition's edge is marked, and only
those rows, at most two for each partition and entity, are put together afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, a TIMESTAMP or a BIGINT column.

    The wall clock of a zone-less timestamp is taken as UTC whatever the session's zone is.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))


def from_micros(c: str | Column) -> Column:
    """TIMESTAMP_NTZ of microseconds since 1970, the inverse of :func:`micros`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.from_utc_timestamp(F.timestamp_micros(c), F.current_timezone()).cast("timestamp_ntz")


def range_sorted(df: DataFrame, entity: list[str], order: list[str]) -> DataFrame:
    """``df`` range-partitioned by entity and order columns and sorted within each partition."""
    by = [F.col(c) for c in (*entity, *order)]
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def changes(arr: pa.Array, before: object) -> np.ndarray:
    """Where a value differs from the one before it; ``before`` precedes the first. Nulls are equal."""
    out = np.empty(len(arr), dtype=bool)
    if not len(arr):
        return out
    out[0] = arr[0].as_py() != before
    a, b = arr.slice(1), arr.slice(0, len(arr) - 1)
    differ = pc.not_equal(a, b)
    if arr.null_count:
        differ = pc.if_else(pc.and_(a.is_valid(), b.is_valid()), differ, pc.not_equal(a.is_valid(), b.is_valid()))
    out[1:] = differ.to_numpy(zero_copy_only=False)
    return out
