"""Small cases of operators added in the second round: nulls, ties, empty tables."""

from __future__ import annotations

from conftest import values
from pyspark.sql import functions as F

from skeinflow.operators import graph, matching, sequences, sets, skew


def test_names_around_triggers(spark):
    docs = spark.createDataFrame([(1, "Ann Lee became Bob. Bob became Cy"), (2, "Cy, formerly Bob"), (3, None), (4, "Bob became Bob"), (5, "became Cy")], "d int, t string")
    names = spark.createDataFrame([("e1", "Ann Lee"), ("e2", "Bob"), ("e3", "cy"), ("e4", None), ("e9", "CY")], "e string, n string")
    got = matching.pairs_around(docs, "d", "t", names, "e", "n", {"became": False, "formerly": True})
    assert values(got) == [(1, "became", "e1", "e2"), (2, "formerly", "e2", "e3")]
    assert matching.pairs_around(docs.where("false"), "d", "t", names, "e", "n", {"became": False}).count() == 0
    assert values(matching.named(docs, "d", "t", names.where("e <> 'e9'"), "e", "n").where("d < 3").select("d", "name")) == [(1, "ann lee"), (1, "bob"), (1, "cy"), (2, "bob"), (2, "cy")]


def test_previous_reachable_and_sieve(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 3)
    rows = spark.createDataFrame([("a", i, str(i)) for i in range(8)] + [(None, 1, "n")], "k string, i int, v string")
    got = {(r.k, r.i): r.p for r in sequences.previous(rows, "k", ["i"], "v", 2, "p").collect()}
    assert got == {**{("a", i): [str(x) for x in range(max(0, i - 2), i)] for i in range(8)}, (None, 1): []}
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", None), ("y", "z")], "s string, t string")
    starts = spark.createDataFrame([("a",), ("q",), (None,)], "start string")
    assert values(graph.reachable_from(edges, "s", "t", starts, "start")) == [("a", "a"), ("a", "b"), ("a", "c"), ("q", "q")]
    keep = skew.sieve(starts, "start")
    assert {r[0] for r in starts.where(keep(F.col("start"))).collect()} == {"a", "q"}
    many = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    assert many.where(skew.sieve(many.where("CAST(k AS INT) < 50"), "k")(F.col("k"))).count() in range(50, 200)


def test_filter_falls_back_for_each_key(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 9), ("b", 1), (None, 1), (None, 2)], "k string, v int")
    assert values(sets.filtered_or_all(rows, F.col("v") > 5, "k").select("k", "v", "fell_back")) == [("a", 9, False), ("b", 1, True), (None, 1, True), (None, 2, True)]
    assert sets.filtered_or_all(rows, F.col("v") > 1, "k").where("k IS NULL").count() == 1
    assert sets.filtered_or_all(rows, F.col("v") > 5, "k", untagged=True).where("k IS NULL AND NOT fell_back").count() == 2
