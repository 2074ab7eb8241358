"""Partitions by the size of what a plan reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Stored bytes for a partition, and the partitions up to which the session's number is left as it is.
PART, FEW = 8 << 20, 8
#: Sizes from here on are Spark's way of saying that it doesn't know.
UNKNOWN = 1 << 50


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a plan reads, once for each time it reads them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows dealt by keys into partitions whose number grows with the input.

    What a task holds of a grouping, a distinct or a sort of nearly all rows then stays the same, whatever number of partitions the session has.
    """
    n = -(-stored_bytes(df) // PART)
    return df.repartition(n, *keys) if n > FEW else df
