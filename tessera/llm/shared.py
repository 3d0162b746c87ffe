"""Skew-safe joins, shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes; beyond it the join shuffles both sides.
BROADCAST_BYTES = 16 << 20


def rehashed(key: str) -> Column:
    """The same key as a new expression. An aggregate joined by it is shuffled anew, and of a join
    between two fresh exchanges adaptive execution can split a hot key."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("bigint"))


def semi_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (a materialised table of the key alone). The ids are broadcast only
    if their counted size is small; otherwise both sides are shuffled by the key."""
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def small(df: DataFrame, size: int) -> DataFrame:
    """df, to be broadcast if its `size` in bytes, known to the driver that made it, allows."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
