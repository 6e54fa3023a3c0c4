"""Keyword scores, routes, votes and quality gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.operators.ranking import top_per_key


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """How many different ``words`` the lower-cased text contains; 0 for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for w in words:
        total = total + F.contains(low, F.lit(w.lower())).cast("int")
    return total


def weighted_score(hits: Mapping[str, Column], weights: Mapping[str, float], base: float = 0.0) -> Column:
    """The weighted sum of hit counts, between 0 and 1."""
    total = F.lit(base)
    for name, count in hits.items():
        total = total + F.lit(weights[name]) * count
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def route(score: Column, threshold: float, margin: float = 0.2, floor: float = 0.35) -> Column:
    """accept from ``threshold``, review from ``threshold - margin`` (at least ``floor``), else drop; null drops."""
    return F.when(score >= threshold, F.lit("accept")).when(score >= max(floor, threshold - margin), F.lit("review")).otherwise(F.lit("drop"))


def vote(votes: DataFrame, key: str, choice: str, weight: str, current: str, margin: float = 0.75) -> DataFrame:
    """The choice with most weight for each key, if it beats the current one by ``margin``; else the current one.

    Equal totals go to the choice first in order. Null choices don't vote.
    """
    totals = votes.where(F.col(choice).isNotNull()).groupBy(key, choice).agg(F.round(F.sum(weight), 6).alias("total"))
    w = Window.partitionBy(key).orderBy(F.desc("total"), choice)
    first = totals.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, F.col(choice).alias("top"), F.col("total").alias("top_total"))
    now = votes.where(F.col(current).isNotNull()).groupBy(key).agg(F.min(current).alias("current"))
    held = totals.select(key, F.col(choice).alias("current"), F.col("total").alias("current_total"))
    joined = first.join(now, key, "left").join(held, [key, "current"], "left")
    switch = F.col("current").isNull() | (F.col("top_total") - F.coalesce("current_total", F.lit(0.0)) >= margin)
    return joined.select(key, F.when(switch, F.col("top")).otherwise(F.col("current")).alias("chosen"), "top_total", (switch & ~F.col("top").eqNullSafe(F.col("current"))).alias("switched"))


def cooccurrence(rows: DataFrame, items: str) -> DataFrame:
    """``a, b, together``: in how many rows two different entries of the array ``items`` stand together, a < b.

    Pairs are formed inside one row's array, never among the rows of a key.
    """
    own = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    pairs = rows.select(own.alias("_x")).where(F.size("_x") > 1).select("_x", F.posexplode("_x").alias("_i", "a"))
    return pairs.select("a", F.explode(F.slice("_x", F.col("_i") + 2, F.size("_x"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))


def activated(current: DataFrame, learned: DataFrame, marker: str, count: str, least: int) -> DataFrame:
    """Marker counts of both tables added up; ``active`` from ``least`` on."""
    rows = current.select(marker, count).unionByName(learned.select(marker, count)).where(F.col(marker).isNotNull())
    return rows.groupBy(marker).agg(F.sum(count).alias(count)).withColumn("active", F.col(count) >= least)


def validated(rows: DataFrame, rules: Mapping[str, Column], group: str, order: Sequence[str], headline: Column, cap: int) -> DataFrame:
    """``status`` (accepted or rejected) and ``reason`` for each row.

    Rules come first, in order. Of the rows that pass, a repeated headline in the group is a
    duplicate, and rows beyond ``cap`` in the group are over the cap: nothing is lost, rejects stay as
    rows. ``order`` must be unique.
    """
    broken = None
    for name, bad in rules.items():
        bad = F.coalesce(bad, F.lit(True))
        broken = F.when(bad, F.lit(name)) if broken is None else broken.when(bad, F.lit(name))
    own = F.struct(*order)
    marked = rows.withColumn("_broken", broken).withColumn("_headline", headline).withColumn("_order", own)
    # Nothing here holds a group in one task: the first of each headline is a minimum, and the
    # first ``cap`` of a group are a group limit.
    passing = marked.where("_broken IS NULL")
    first = passing.groupBy(group, "_headline").agg(F.min("_order").alias("_order"))
    kept = top_per_key(first, [group], [F.col("_order")], cap, "_place")
    state = first.join(kept.select("_order", F.lit(True).alias("_kept")), "_order", "left").select("_order", F.coalesce("_kept", F.lit(False)).alias("_kept"))
    out = marked.join(state, "_order", "left")
    reason = F.coalesce(F.col("_broken"), F.when(F.col("_kept").isNull(), F.lit("duplicate")), F.when(~F.col("_kept"), F.lit("over_cap")))
    return out.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))).drop("_broken", "_headline", "_order", "_kept")
