"""Joins that hold when one key owns a large part of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows looked at to find hot keys. Only the join strategy depends on it, never the result.
SAMPLE_ROWS = 200_000
#: A key is hot above this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.01
#: Rows of the right side that hot keys may have to be broadcast.
WARM_ROWS = 100_000
#: Slots of a sieve, seven to a byte: a constant of 19 kB in the plan.
SLOTS = 1 << 17


def hot_keys(df: DataFrame, key: str, floor_rows: int = 100_000, rows: int | None = None) -> list:
    """Keys that own more than ``HOT_SHARE`` of the rows, estimated on a sample: a bounded list.

    Tables of fewer than ``floor_rows`` rows have none: any plan does for them. ``rows`` is their number, where it is known.
    """
    rows = df.count() if rows is None else rows
    if rows < floor_rows:
        return []
    share = min(1.0, SAMPLE_ROWS / rows)
    seen = df.select(key).where(F.col(key).isNotNull())
    if share < 1.0:
        seen = seen.sample(share, seed=7)
    found = seen.groupBy(key).count().where(F.col("count") > HOT_SHARE * rows * share)
    return [r[0] for r in found.orderBy(F.desc("count")).limit(int(2 / HOT_SHARE)).collect()]


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None, unique: bool = True) -> DataFrame:
    """Join ``left`` with ``right``, which has at most one row for each ``key`` (or not ``unique``).

    Rows of hot keys are joined where they lie with the few (at most ``2 / HOT_SHARE``) rows of
    ``right`` they need, which are broadcast; all others go through a shuffle. No row is dropped.
    A right side that isn't ``unique`` is measured: where hot keys have more than ``WARM_ROWS`` rows in
    it, the join is a plain one, whose skewed partitions adaptive execution splits.
    Null keys match nothing: ``inner`` leaves them out, ``left`` keeps them.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if hot and not unique:
        found = right.where(F.col(key).isin(hot)).groupBy(key).count().collect()  # at most as many rows as hot keys
        hot = hot if sum(r["count"] for r in found) <= WARM_ROWS else []
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    cold = left.where(~F.coalesce(is_hot, F.lit(False))).join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def sieve(keys: DataFrame, key: str, slots: int = SLOTS) -> Callable[[Column], Column]:
    """A test that holds for every value of ``keys[key]`` and, while there are few keys, for few others: what to keep before a join.

    Each key marks a slot by its hash. The marks travel as a constant of ``slots`` / 7 bytes, however
    many keys there are: with very many it lets more through, never less than all that is needed.
    Only marks are collected, seven to a row.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    marks = keys.where(F.col(key).isNotNull()).select(slot(F.col(key)).alias("s")).groupBy(F.expr("s div 7").alias("w")).agg(F.bit_or(F.expr("shiftleft(1, CAST(s % 7 AS INT))")).alias("b"))
    held = bytearray(slots // 7 + 1)
    for r in marks.collect():
        held[r["w"]] = r["b"]
    whole = F.lit(bytes(held))

    def test(c: Column) -> Column:
        byte = F.ascii(F.substring(whole, F.floor(slot(c) / 7).cast("int") + 1, F.lit(1)).cast("string"))
        return F.getbit(byte, (slot(c) % 7).cast("int")) == 1

    return test
