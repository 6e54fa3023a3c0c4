"""One group identifier for all records linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.text import is_blank, name_fold
from skeinflow.operators.skew import hot_keys, lookup_join
from skeinflow.runtime import Scratch, table


def seed_tree_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the undirected ``edges`` by seed-tree pruning.

    Returns ``vertex, component`` for every vertex of an edge, ``component`` being the smallest
    vertex (in binary order) that it reaches. Null ends and self loops connect nothing (a vertex
    that only has such edges has no row); repeated and reversed edges count once; an empty table
    gives no rows; other columns are ignored.

    Each round has a min-selection and a pruning step. Selection: every vertex u tells itself and
    its neighbours m(u), the smallest of them. Pruning: a vertex keeps edges only between the
    smallest value v it was told and the others; a vertex that is nobody's minimum drops out of the
    graph and becomes a child of v in the propagation forest. The graph shrinks geometrically, and
    when it is empty the remaining vertices are the seeds. Identifiers then flow down the forest,
    round by round in reverse, as every parent dropped out later than its child or is a seed.

    Neighbourhoods are never gathered: both steps are ``min`` aggregates with map-side combining and
    joins on a vertex, which split hot vertices (``lookup_join``); hot ones are only looked for where
    a round has rows enough for it to matter. Each round's tables go to the shared folder, and
    superseded ones are deleted. On the way down each round writes its own labels only.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    graph = scratch.save(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    first, rows, rounds = graph, graph.count(), []
    while rows:
        lowest = graph.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        heard = lookup_join(graph, lowest, "u", hot=hot_keys(graph, "u", rows=rows))
        told = heard.select(F.col("v").alias("x"), F.col("m").alias("w")).union(lowest.select(F.col("u").alias("x"), F.col("m").alias("w"))).distinct()
        told = scratch.save(told)
        best = scratch.save(told.groupBy("x").agg(F.min("w").alias("p"), F.max(F.col("w") == F.col("x")).alias("stays")))
        rounds.append(best)
        spokes = lookup_join(told, best.select("x", "p"), "x", hot=hot_keys(told, "x", rows=rows)).where("w <> p").select(F.col("w").alias("u"), F.col("p").alias("v"))
        following = scratch.save(spokes.union(spokes.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        scratch.drop(told)
        if graph is not first:
            scratch.drop(graph)
        graph, rows = following, following.count()
    if not rounds:
        return pairs.select(F.col("u").alias("vertex"), F.col("u").alias("component"))
    forest = [best.where("NOT stays").select("x", "p") for best in rounds]
    dropped = forest[0].select("x")
    for part in forest[1:]:
        dropped = dropped.union(part.select("x"))
    # Seeds never dropped out. The first graph holds every vertex.
    seeds = first.select(F.col("u").alias("x")).distinct().join(dropped, "x", "left_anti")
    labels = scratch.save(seeds.select("x", F.col("x").alias("c")))
    for part in reversed(forest):
        # A parent is a seed or dropped out in a later round, whose labels are there.
        found = lookup_join(part, labels.select(F.col("x").alias("p"), "c"), "p").select("x", "c")
        labels = labels.unionByName(scratch.save(found))
    return labels.select(F.col("x").alias("vertex"), F.col("c").alias("component"))


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted identity pairs with both ends resolved to entities: ``a, b``.

    An end is its id if an entity has it; without id (null or blank), the entity whose canonical
    name equals the end's name, letter case and surplus blanks ignored. Pairs with an end that is
    no entity are left out.
    """
    seeds = table(spark, sf_dir, "entity_seed").where(F.col("entity_id").isNotNull())
    by_id = seeds.select(F.col("entity_id").alias("known")).distinct()
    by_name = seeds.where(~is_blank(F.col("canonical_name"))).groupBy(name_fold(F.col("canonical_name")).alias("name_key")).agg(F.min("entity_id").alias("named"))
    merges = table(spark, sf_dir, "identity_merges").select(
        *[F.when(~is_blank(F.col(f"{s}_entity_id")), F.col(f"{s}_entity_id")).alias(f"{s}_id") for s in ("source", "target")],
        *[name_fold(F.col(f"{s}_entity_name")).alias(f"{s}_name") for s in ("source", "target")],
    ).distinct()
    merges = Scratch(spark, "links").save(merges)
    ends, rows = merges, merges.count()
    for side in ("source", "target"):
        by = F.when(F.col(f"{side}_id").isNull(), F.col(f"{side}_name"))
        hot_ids = hot_keys(merges, f"{side}_id", rows=rows)
        hot_names = hot_keys(merges.select(by.alias("name_key")), "name_key", rows=rows)
        ends = lookup_join(ends.withColumn("known", F.col(f"{side}_id")), by_id.withColumn("_ok", F.lit(True)), "known", "left", hot=hot_ids).withColumn(f"{side}_ok", F.col("_ok")).drop("known", "_ok")
        ends = lookup_join(ends.withColumn("name_key", by), by_name, "name_key", "left", hot=hot_names)
        end = F.when(F.col(f"{side}_id").isNull(), F.col("named")).when(F.col(f"{side}_ok"), F.col(f"{side}_id"))
        ends = ends.withColumn(f"{side}_end", end).drop("name_key", "named")
    return ends.select(F.col("source_end").alias("a"), F.col("target_end").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity with its group identifier; an entity that nothing links is a group of its own."""
    linked = seed_tree_components(entity_links(spark, sf_dir), "a", "b").select(F.col("vertex").alias("entity_id"), "component")
    entities = table(spark, sf_dir, "entity_seed").where(F.col("entity_id").isNotNull()).select("entity_id").distinct()
    return entities.join(linked, "entity_id", "left").select(F.coalesce("component", "entity_id").alias("group_entity_id"), "entity_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = seed_tree_components(entity_links(spark, sf_dir), "a", "b")
    return linked.select(F.col("component").alias("group_entity_id"), F.col("vertex").alias("entity_id"))
