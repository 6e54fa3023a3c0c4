"""Unions, upserts, differences and partitions of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.ranking import best_row
from skeinflow.operators.skew import lookup_join


def union_first_wins(tables: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """All rows of all tables, one for each ``key``: the earlier table's, in it the first by ``order``.

    Rows with a null or empty key are all kept. Tables may lack columns of others.
    """
    parts = [t.withColumn("_source", F.lit(i)) for i, t in enumerate(tables)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    keyless = F.coalesce(F.col(key) == "", F.lit(True))
    kept = best_row(rows.where(~keyless), [key], F.struct("_source", *order), smallest=True)
    return kept.unionByName(rows.where(keyless)).drop("_source")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``current`` with rows of ``changes`` in place of those with the same key; the last by ``order`` counts."""
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return best_row(rows, [key], F.struct("_new", *order)).drop("_new")


def version_diff(before: DataFrame, after: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """``key, change``: added, removed or updated; rows equal in all ``values`` (nulls equal nulls) are left out."""
    old = before.select(F.col(key).alias("_k"), F.struct(*values).alias("_old"))
    new = after.select(F.col(key).alias("_k2"), F.struct(*values).alias("_new"))
    joined = old.join(new, F.col("_k") == F.col("_k2"), "full_outer")
    change = F.when(F.col("_k").isNull(), F.lit("added")).when(F.col("_k2").isNull(), F.lit("removed")).when(~F.col("_old").eqNullSafe(F.col("_new")), F.lit("updated"))
    return joined.select(F.coalesce("_k", "_k2").alias(key), change.alias("change")).where("change IS NOT NULL")


def filtered_or_all(df: DataFrame, keep: Column, key: str, untagged: bool = False) -> DataFrame:
    """The rows of each ``key`` for which ``keep`` holds; all rows of a key, with ``fell_back``, where it holds for none.

    Rows without key are a group of their own, whose answer is one number; with ``untagged`` they
    are kept whatever holds. Keys that own many rows are joined where they lie.
    """
    keep = F.coalesce(keep, F.lit(False))
    keyed, keyless = df.where(F.col(key).isNotNull()), df.where(F.col(key).isNull())
    hits = keyed.where(keep).select(F.col(key).alias("_key")).distinct().withColumn("_any", F.lit(True))
    joined = lookup_join(keyed.withColumn("_key", F.col(key)), hits, "_key", "left").withColumn("fell_back", F.col("_any").isNull())
    named = joined.where(keep | F.col("fell_back")).drop("_any", "_key")
    if untagged:
        return named.unionByName(keyless.withColumn("fell_back", F.lit(False)))
    some = not keyless.where(keep).isEmpty()
    rest = keyless.where(keep) if some else keyless
    return named.unionByName(rest.withColumn("fell_back", F.lit(not some)))


def pending(items: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Items whose key is in none of the ``done`` tables' columns of the same name."""
    for d in done:
        items = items.join(d.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return items


def dangling(children: DataFrame, ref: str, parents: DataFrame, key: str, issue: str) -> DataFrame:
    """``issue, ref``: references that lead nowhere."""
    known = parents.select(F.col(key).alias(ref)).distinct()
    return children.where(F.col(ref).isNotNull()).select(ref).distinct().join(known, ref, "left_anti").select(F.lit(issue).alias("issue"), F.col(ref).alias("reference"))


def remapped(rows: DataFrame, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """References replaced by what they were merged into; the original stays as ``original_`` column. Unmapped ones stay.

    ``mapping`` has one row for each ``old`` value; a null ``new`` maps nothing.
    """
    table = mapping.where(F.col(new).isNotNull()).select(F.col(old).alias("_old"), F.col(new).alias("_new"))
    joined = lookup_join(rows.withColumn("_old", F.col(column)), table, "_old", "left")
    return joined.withColumn(f"original_{column}", F.col(column)).withColumn(column, F.coalesce("_new", F.col(column))).drop("_old", "_new")


def remapped_lists(rows: DataFrame, key: str, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """``key, column``: lists of references with each replaced by what it was merged into, in order, without repetition.

    ``key`` is unique; null and empty lists stay as they are.
    """
    each = rows.select(F.col(key), F.posexplode(column).alias("_pos", "_ref"))
    done = remapped(each, "_ref", mapping, old, new).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_ref"))).alias("_list"))
    renewed = done.select(F.col(key), F.array_distinct(F.transform("_list", lambda x: x["_ref"])).alias("_renewed"))
    return rows.select(key, column).join(renewed, key, "left").select(key, F.coalesce("_renewed", F.col(column)).alias(column))
