"""Components, closures and edges as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.skew import lookup_join
from skeinflow.runtime import Scratch


def reachable_minimum(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``vertex, component``: the smallest vertex each vertex is linked with, directly or through others.

    Every round gives each vertex the smallest label around it and then that label's own label, so
    chains halve. Null ends and self loops link nothing. Labels are kept in the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "minimum")
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = scratch.save(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = scratch.save(links.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("x"), F.least("u", "v").alias("c")))
    while True:
        known = labels.select(F.col("x").alias("v"), "c")
        heard = lookup_join(links, known, "v").groupBy("u").agg(F.min("c").alias("d")).select(F.col("u").alias("x"), "d")
        step = labels.join(heard, "x").select("x", F.col("c").alias("was"), F.least("c", "d").alias("c"))
        step = scratch.save(step)
        jumped = lookup_join(step, step.select(F.col("x").alias("c"), F.col("c").alias("further")), "c", "left")
        following = scratch.save(jumped.select("x", F.least("c", F.coalesce("further", "c")).alias("c"), "was"))
        settled = following.where("c <> was").isEmpty()
        scratch.drop(labels)
        scratch.drop(step)
        labels = following.select("x", "c")
        labels._scratch_path = following._scratch_path
        if settled:
            return labels.select(F.col("x").alias("vertex"), F.col("c").alias("component"))


def reachable_from(edges: DataFrame, a: str, b: str, starts: DataFrame, start: str) -> DataFrame:
    """``start, vertex``: what each start is linked with, directly or through others; a start reaches itself.

    Links have no direction, so this is the start's component; starts without a link are alone.
    """
    groups = Scratch(edges.sparkSession, "reached").save(reachable_minimum(edges, a, b))
    begun = starts.select(F.col(start).alias("start")).where("start IS NOT NULL").distinct()
    of_start = begun.join(groups.select(F.col("vertex").alias("start"), "component"), "start", "left")
    linked = lookup_join(groups, of_start.where("component IS NOT NULL").select("component", "start"), "component", unique=False).select("start", "vertex")
    return linked.unionByName(of_start.where("component IS NULL").select("start", F.col("start").alias("vertex")))


def final_targets(moves: DataFrame, source: str, target: str) -> DataFrame:
    """``source, final, hops``: where a chain of merges ends. Sources that run in a cycle have a null ``final``.

    ``source`` must be unique; pointer jumping takes log2 of the longest chain rounds.
    """
    scratch = Scratch(moves.sparkSession, "targets")
    state = scratch.save(moves.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s IS NOT NULL AND t IS NOT NULL AND s <> t").withColumn("hops", F.lit(1).cast("long")))
    rounds = max(state.count(), 2).bit_length() + 1
    for _ in range(rounds):
        nxt = state.select(F.col("s").alias("t"), F.col("t").alias("t2"), F.col("hops").alias("more"))
        moved = lookup_join(state, nxt, "t", "left").select("s", F.coalesce("t2", "t").alias("t"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("t2").isNotNull().alias("on"))
        moved = scratch.save(moved)
        going = moved.where("on")
        if going.isEmpty():
            break
        scratch.drop(state)
        state = moved.select("s", "t", "hops")
        state._scratch_path = moved._scratch_path
    left = state.join(state.select(F.col("s").alias("t")).distinct().withColumn("_again", F.lit(True)), "t", "left")
    return left.select(F.col("s").alias(source), F.when(F.col("_again").isNull(), F.col("t")).alias("final"), F.when(F.col("_again").isNull(), F.col("hops")).alias("hops"))


def weighted_edges(edges: DataFrame, source: str, target: str, kind: str, weight: str | None = None) -> DataFrame:
    """One row for each (source, target, kind): how often it was given, and the largest weight."""
    strongest = F.max(weight) if weight else F.lit(None).cast("double")
    return edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(source, target, kind).agg(F.count(F.lit(1)).alias("evidence"), strongest.alias("weight"))


def degrees(edges: DataFrame, source: str, target: str, distinct: bool = True) -> DataFrame:
    """``node, outgoing, incoming`` over the distinct edges, or over all."""
    pairs = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s IS NOT NULL AND t IS NOT NULL")
    pairs = pairs.distinct() if distinct else pairs
    ends = pairs.select(F.col("s").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(pairs.select(F.col("t").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))
