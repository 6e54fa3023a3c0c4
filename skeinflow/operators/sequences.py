"""Folds over ordered rows: bounded chunks, intervals without overlap, context of neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.operators.ranking import numbered_per_key
from skeinflow.runtime import Scratch


def greedy_chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Number the parts when each key's rows are filled, in order, into parts of bounded count and size.

    A part is closed before a row that would make it exceed ``most_rows`` rows or ``most_size`` in
    total; a row larger than ``most_size`` is a part of its own. Adds ``part_no`` from 1. Null sizes
    count 0. The fold keeps a handful of numbers, never a group: rows are partitioned by key, sorted,
    and streamed through in Arrow batches.
    """
    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    key_at, size_at = [columns.index(k) for k in keys], columns.index(size)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held, total = None, 0, 0, 0
        for b in batches:
            out = []
            for *key, n in zip(*(b.column(i).to_pylist() for i in [*key_at, size_at])):
                n = n or 0
                if key != now:
                    now, part, held, total = key, 1, 0, 0
                elif held and (held + 1 > most_rows or total + n > most_size):
                    part, held, total = part + 1, 0, 0
                held, total = held + 1, total + n
                out.append(part)
            yield pa.record_batch([*b.columns, pa.array(out, pa.int64())], names=[*columns, "part_no"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, f"{schema}, part_no bigint")


#: Rows of a key that one task of a blocked window has at most.
BLOCK = 10_000


def without_overlap(spans: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Spans of each key, in order of start, without what an earlier one covers.

    A span inside what came before is dropped; one that begins inside it begins after its end
    instead. What came before always ends at the largest end so far, a running maximum: over the
    rows of a block, and over the maxima of the key's earlier blocks, so a hot key is many tasks.
    Closed integer intervals; spans with a null key or bound or an end before the start are dropped.
    """
    valid = spans.where((F.col(end) >= F.col(start)) & F.col(key).isNotNull()).withColumn("_down", -F.col(end))
    rows = numbered_per_key(valid, key, [start, "_down", tie], "_n").withColumn("_block", F.expr(f"(_n - 1) div {BLOCK}"))
    rows = Scratch(spans.sparkSession, "overlap").save(rows)
    tops = rows.groupBy(key, "_block").agg(F.max(end).alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(key, "_block", F.max("_top").over(earlier).alias("_before"))
    here = Window.partitionBy(key, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.join(tops, [key, "_block"]).withColumn("_upto", F.greatest(F.max(end).over(here), F.col("_before")))
    return (
        seen.where(F.col("_upto").isNull() | (F.col(end) > F.col("_upto")))
        .withColumn("trimmed", F.coalesce(F.col(start) <= F.col("_upto"), F.lit(False)))
        .withColumn(start, F.when(F.col("trimmed"), F.col("_upto") + 1).otherwise(F.col(start)))
        .drop("_upto", "_before", "_block", "_n", "_seq", "_down")
    )


def context(rows: DataFrame, key: str, order: Sequence[str], text: str, size: int, out: str = "context", separator: str = "\n") -> DataFrame:
    """Each row with the texts of ``size`` rows around it: (size - 1) // 2 before it, the rest after.

    Null texts are skipped; null keys are a key of their own. Windows run over blocks of a key's
    rows, to which the rows next to a block are lent, so a hot key is many tasks.
    """
    before = (size - 1) // 2
    after = size - 1 - before
    block = max(BLOCK, size)
    placed = numbered_per_key(rows, key, order, "_n").withColumn("_own", F.expr(f"(_n - 1) div {block}"))
    blocks = F.array_distinct(F.array(F.col("_own"), F.expr(f"(_n - 1 + {before}) div {block}"), F.expr(f"greatest(_n - 1 - {after}, 0) div {block}")))
    lent = placed.withColumn("_block", F.explode(blocks))
    w = Window.partitionBy(key, "_block").orderBy("_n").rowsBetween(-before, after)
    return lent.withColumn(out, F.array_join(F.collect_list(text).over(w), separator)).where("_own = _block").drop("_n", "_own", "_block", "_seq")


def recency_weight(rows: DataFrame, at: str, steps: Sequence[tuple[int, float]], out: str = "recency") -> DataFrame:
    """A weight by age in days before the newest row of all; the first step that is old enough counts, beyond all 1."""
    newest = rows.agg(F.max(F.unix_micros(at))).collect()[0][0]  # one number
    age = F.lit(newest).cast("long") - F.unix_micros(at)
    weight = F.lit(1.0)
    for days, w in reversed(steps):
        weight = F.when(age <= F.lit(days * 86_400_000_000), F.lit(w)).otherwise(weight)
    return rows.withColumn(out, weight)


def last_before(points: DataFrame, events: DataFrame, key: str, at: str, value: str, out: str = "last", largest: bool = False) -> DataFrame:
    """As-of join: each point with the ``value`` of its key's last event at or before it, null where there is none.

    With ``largest`` it is the largest value of all events up to then. Of events at one time the largest value counts. Points and events are numbered together by key
    and time; blocks of a key carry their last value over to the next, so a hot key is many tasks.
    Points with a null key or time have a null result and are kept.
    """
    happened = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(key, at).agg(F.max(value).alias("_value"))
    valid = F.col(key).isNotNull() & F.col(at).isNotNull()
    both = happened.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(0).alias("_point"), "_value", F.lit(None).cast(points.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    asked = points.where(valid).select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_point"), F.lit(None).cast(happened.schema["_value"].dataType).alias("_value"), F.struct(*points.columns).alias("_row"))
    rows = numbered_per_key(both.unionByName(asked), "_k", ["_at", "_point"], "_n").withColumn("_block", F.expr(f"(_n - 1) div {BLOCK}"))
    rows = Scratch(points.sparkSession, "asof").save(rows)
    of_block = F.max("_value") if largest else F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_n")))
    running = (lambda c, w: F.max(c).over(w)) if largest else (lambda c, w: F.last(c, ignorenulls=True).over(w))
    carried = rows.groupBy("_k", "_block").agg(of_block.alias("_carry"))
    earlier = Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("_k", "_block", running("_carry", earlier).alias("_carry"))
    here = Window.partitionBy("_k", "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(carried, ["_k", "_block"]).withColumn("_last", F.greatest(running("_value", here), F.col("_carry")) if largest else F.coalesce(running("_value", here), F.col("_carry"))).where("_point = 1")
    done = found.select("_row.*", F.col("_last").alias(out))
    return done.unionByName(points.where(~F.coalesce(valid, F.lit(False))).withColumn(out, F.lit(None).cast(happened.schema["_value"].dataType)))


def previous(rows: DataFrame, key: str, order: Sequence[str], value: str, keep: int, out: str = "previous") -> DataFrame:
    """Each row with the list of its key's last ``keep`` values before it, in order.

    Windows run over blocks of a key's rows, to which the rows before a block are lent, so a hot
    key is many tasks. Null keys are a key of their own; null values are skipped.
    """
    block = max(BLOCK, keep)
    placed = numbered_per_key(rows, key, order, "_n").withColumn("_own", F.expr(f"(_n - 1) div {block}"))
    lent = placed.withColumn("_block", F.explode(F.array_distinct(F.array(F.col("_own"), F.expr(f"(_n - 1 + {keep}) div {block}")))))
    w = Window.partitionBy(key, "_block").orderBy("_n").rowsBetween(-keep, -1)
    return lent.withColumn(out, F.collect_list(value).over(w)).where("_own = _block").drop("_n", "_own", "_block", "_seq")
