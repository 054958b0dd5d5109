"""Joins of a large table with a lookup side, safe against growth of the lookup and hot keys.

* The lookup is broadcast only while the optimizer's size estimate stays under a fixed bound.
* Beyond the bound the join is shuffled on (key, salt): every lookup row is copied once per salt
  and each large-side row takes a salt from a hash of its content, so one key that holds a third of
  all rows spreads over several tasks.  A content hash gives the same salt when a lost task reruns.
* The number of salts falls as the lookup grows, so that its copies stay within a fixed volume.
  Without salts, as in the join of two table-sized sides, adaptive execution splits hot partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16
COPIED_BYTES = 64 * 1024 * 1024 * 1024
_SALT = "__salt"
#: Bytes of the tables read for one piece of :func:`dealt`.
PIECE_BYTES = 4 * 1024 * 1024
#: Pieces past which an estimate is not believed.
MOST_PIECES = 1 << 16


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate (file sizes scaled by the plan), or ``None`` if not available."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session has no plan to ask; take the shuffled way
        return None


def input_bytes(df: DataFrame) -> int | None:
    """Estimated bytes of all that the plan reads, or ``None`` if not available; joins don't multiply it."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except AttributeError:  # as above
        return None


def dealt(df: DataFrame, *keys: str, piece: int = PIECE_BYTES) -> DataFrame:
    """``df`` shuffled by ``keys`` into pieces whose number follows the bytes read, for groups about as many as rows.

    A task's memory then depends on ``piece`` and not on the size of the tables, whatever the session's number of shuffle
    partitions, and nothing is grouped before the shuffle.  Rows without a file, and checkpoints of joins, have no estimate to
    go by, or one far too high: they are left to the session's partitions.
    """
    size = input_bytes(df)
    if size is None or size > MOST_PIECES * piece:
        return df
    return df.repartition(max(-(-size // piece), df.sparkSession.sparkContext.defaultParallelism), *keys)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    size = estimated_bytes(df)
    return size is not None and size <= limit


def salts_for(size: int | None, most: int = SALTS) -> int:
    """Copies of a lookup of ``size`` bytes; one when more than one would exceed the volume."""
    if size is None:
        return most
    return max(1, min(most, COPIED_BYTES // max(size, 1)))


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_BYTES,
    salts: int | None = None,
) -> DataFrame:
    """Join ``big`` with ``lookup`` on equally named columns (inner, left, left_semi, left_anti).

    ``salts`` fixes the number of copies beyond the broadcast bound.  Callers whose lookup is a narrow
    set of keys pass ``SALTS``: estimates of derived sets are often far too high, and copies of keys
    are cheap beside the rows they meet.
    """
    keys = [on] if isinstance(on, str) else list(on)
    size = estimated_bytes(lookup)
    if size is not None and size <= limit:
        return big.join(F.broadcast(lookup), keys, how)
    if salts is None:
        salts = salts_for(size)
    others = [c for c in big.columns if c not in keys]
    if not others or salts < 2:
        return big.join(lookup, keys, how)
    salted = big.withColumn(_SALT, F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    copies = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, _SALT], how).drop(_SALT)


def spread(df: DataFrame, limit: int = 4 * BROADCAST_BYTES) -> DataFrame:
    """Deal out a small input to all cores before work that is heavy per row.

    Only inputs under ``limit`` are moved: they may come as a single file split.  Larger ones have
    at least as many splits as that and stay where they are read.
    """
    if not fits_broadcast(df, limit):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
