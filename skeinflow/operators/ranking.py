"""Ranking, latest rows, sequences and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.operators.skew import lookup_join
from skeinflow.runtime import Scratch


def best_row(df: DataFrame, keys: Sequence[str], rank: Column, smallest: bool = False) -> DataFrame:
    """The row of the largest (or smallest) ``rank`` of each key, as a hash or sort aggregate with map-side combining.

    ``rank`` should be a struct that ends in something unique. Null keys are a key of their own.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if smallest else F.max_by
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, number: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, numbered.

    Spark turns the filter on row_number into a group limit: every task keeps at most ``k`` rows of
    a key before the shuffle, so a hot key costs no more than any other.
    """
    return df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(number) <= k)


def numbered(df: DataFrame, order: Sequence[str], number: str = "seq") -> DataFrame:
    """Rows numbered from 1 in a global order, without a single-partition window.

    Rows are range-partitioned and sorted, the partitions written and counted, and each row gets
    the number of rows in the partitions before its own: one small row for each partition is broadcast.
    """
    scratch = Scratch(df.sparkSession, "numbered")
    at, part, before = "__numbered_at", "__numbered_part", "__numbered_before"
    ordered = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    held = scratch.save(ordered.withColumn(at, F.monotonically_increasing_id()))
    held = held.withColumn(part, F.shiftright(at, 33))
    sizes = {r[part]: r["count"] for r in held.groupBy(part).count().collect()}
    so_far, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, so_far))
        so_far += sizes[p]
    starts = df.sparkSession.createDataFrame(offsets, f"{part} bigint, {before} bigint")
    row = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(starts), part).withColumn(number, F.col(before) + row + 1).drop(part, at, before)


def numbered_per_key(df: DataFrame, key: str, order: Sequence[str], number: str) -> DataFrame:
    """Rows numbered from 1 in each key: ``row_number`` that no hot key can put into one task.

    Rows are numbered globally by key and order; each key's numbers then start where its first row
    is. Nulls come first. ``order`` should end in something unique.
    """
    rows = numbered(df, [key, *order], "_seq")
    starts = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_seq").alias("_first"))
    keyed = lookup_join(rows.withColumn("_key", F.col(key)), starts, "_key", "left")
    first = F.coalesce("_first", F.lit(1))  # null keys are sorted first
    return keyed.withColumn(number, F.col("_seq") - first + 1).drop("_key", "_first")


def weighted_two_level(df: DataFrame, outer: str, inner: str, score: str, ties: str, weights: Sequence[float]) -> DataFrame:
    """Rank rows in their ``inner`` key, weigh the score by that rank, and rank again in ``outer``.

    Ranks beyond ``weights`` have the last weight. Scores are numbers, larger ones first.
    """
    weight = F.lit(weights[-1])
    for i in reversed(range(len(weights) - 1)):
        weight = F.when(F.col("inner_rank") == i + 1, F.lit(weights[i])).otherwise(weight)
    first = numbered_per_key(df.withColumn("_down", -F.col(score)), inner, ["_down", ties], "inner_rank").drop("_seq", "_down")
    second = first.withColumn("weighted", F.round(F.col(score) * weight, 6)).withColumn("_down", -F.col("weighted"))
    return numbered_per_key(second, outer, ["_down", ties], "outer_rank").drop("_seq", "_down")


def round_robin(df: DataFrame, key: str, order: Sequence[str], number: str = "turn") -> DataFrame:
    """Each row's turn when keys take turns: its place among the rows of its key."""
    return numbered_per_key(df, key, order, number).drop("_seq")


def sequence(df: DataFrame, key: str, order: Sequence[str], identifier: str) -> DataFrame:
    """A running number in each key and the identifier of the row before, the prerequisite."""
    rows = numbered_per_key(df, key, order, "sequence_no")
    before = rows.select((F.col("_seq") + 1).alias("_seq"), F.col(identifier).alias("_before"))
    joined = rows.join(before, "_seq", "left")
    return joined.withColumn("requires", F.when(F.col("sequence_no") > 1, F.col("_before"))).drop("_seq", "_before")


def budget_prefix(df: DataFrame, key: str, order: Sequence[str], text: str, rows: int, chars: int) -> DataFrame:
    """The first ``rows`` rows of each key as long as their texts fit into ``chars`` characters; the last one is cut.

    Sizes are only added up over those first rows, so a key holds no more than ``rows`` of them.
    """
    first = top_per_key(df, [key], [F.col(c).asc_nulls_first() for c in order], rows, "place")
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    room = F.lit(chars) - (F.col("_upto") - size)
    return first.withColumn("_upto", F.sum(size).over(w)).where(room > 0).withColumn("kept_chars", F.least(size, room)).drop("_upto")


def first_tier(df: DataFrame, key: str, tier: str) -> DataFrame:
    """The rows of the smallest ``tier`` that each key has; rows without key or tier are left out."""
    best = df.groupBy(F.col(key).alias("_key")).agg(F.min(tier).alias("_best"))
    return lookup_join(df.withColumn("_key", F.col(key)), best, "_key").where(F.col(tier) == F.col("_best")).drop("_key", "_best")
