from __future__ import annotations

import pytest
from conftest import values
from pyspark.sql import functions as F

from skeinflow.functions import columns as C
from skeinflow.operators import graph, matching, ranking, scoring, sequences, sets, skew


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()[0][0]


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (C.clean_text, " a\x00b  \n c ", "ab c"),
        (C.name_key, "  Mount  X-9! ", "mount x 9"),
        (C.slug, "A & B", "a-b"),
        (C.clamp01, "7", 1.0),
        (C.clamp01, "no", 0.0),
        (lambda c: C.ellipsis(c, 6), "abcdefgh", "abc..."),
        (lambda c: F.array_join(C.sentences(c), "|"), "One. Two? three", "One.|Two?|three"),
        (lambda c: C.without_sentences(c, "(?i)bad"), "Good one. Bad one! Fine.", "Good one. Fine."),
        (C.word_count, "it's a well-known x", 4),
        (C.without_repeats, "..the The cat cat sat!", "the cat sat"),
        (C.paragraphs, "a\nb\n\n c\r\nd", "a b\n\nc d"),
        (lambda c: C.number_after(c, "Year"), "in year 12, x", 12),
        (lambda c: C.one_of(c, ["a", "b"], "term", {"bee": "b"}), " Bee ", "b"),
        (lambda c: C.one_of(c, ["a", "b"], "term"), None, "term"),
        (lambda c: C.display_name(c, {"x y": "The X"}), "x  Y", "The X"),
        (lambda c: C.display_name(c), "NASA", "NASA"),
        (lambda c: F.date_format(C.utc(c), "HH:mm"), "2024-01-01T10:00:00+02:00", "08:00"),
        (lambda c: F.date_format(C.utc(c), "HH:mm"), "2024-01-01T10:00:00", "10:00"),
    ],
)
def test_column_functions(spark, expr, value, want):
    assert one(spark, value, expr) == want


def test_ids_lists_and_maps(spark):
    assert one(spark, "a", lambda c: C.stable_id("p", c, F.lit("b"))) == one(spark, "ab", lambda c: C.stable_id("p", c))
    assert one(spark, [" a ", "", None, "b", "a"], lambda c: C.clean_list(c, 2), "array<string>") == ["a", "b"]
    assert one(spark, {"a": ["1"]}, lambda c: C.merge_list_maps(c, F.create_map(F.lit("a"), F.array(F.lit("2")))), "map<string,array<string>>") == {"a": ["1", "2"]}
    assert one(spark, {"old": "1"}, lambda c: C.rename_keys(c, {"old": "new"}), "map<string,string>") == {"new": "1"}


def test_numbering_is_global_and_complete(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    assert values(ranking.numbered(df, ["v"]).select("v", "seq")) == [tuple(x) for x in sorted(((i, i + 1) for i in range(500)), key=repr)]
    assert ranking.numbered(df.where("false"), ["v"]).count() == 0


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None), (None, 1, "z")], "k string, n int, t string")
    assert values(ranking.best_row(df, ["k"], F.struct("n", "t")).select("k", "t")) == [("a", "y"), ("b", None), (None, "z")]
    assert values(ranking.top_per_key(df, ["k"], [F.desc("n")], 1).select("k", "n")) == [("a", 3), ("b", 2), (None, 1)]
    assert values(ranking.sequence(df, "k", ["n"], "t").select("k", "sequence_no", "requires")) == [("a", 1, None), ("a", 2, "x"), ("b", 1, None), (None, 1, None)]
    assert values(ranking.first_tier(df, "k", "n").select("k", "n")) == [("a", 1), ("b", 2)]
    text = spark.createDataFrame([("a", 1, "abcd"), ("a", 2, "efgh"), ("a", 3, "i")], "k string, n int, t string")
    assert values(ranking.budget_prefix(text, "k", ["n"], "t", 9, 6).select("n", "kept_chars")) == [(1, 4), (2, 2)]


def test_sets(spark):
    a = spark.createDataFrame([("x", 1), ("", 2), (None, 3)], "k string, v int")
    b = spark.createDataFrame([("x", 9, "e"), ("y", 8, "e"), ("", 7, "e")], "k string, v int, extra string")
    assert values(sets.union_first_wins([a, b], "k", ["v"]).select("k", "v")) == [("", 2), ("", 7), ("x", 1), ("y", 8), (None, 3)]
    assert values(sets.upsert(a.where("k = 'x'"), b.where("k <> ''").drop("extra"), "k", ["v"])) == [("x", 9), ("y", 8)]
    assert values(sets.version_diff(a.where("k <> ''"), b.where("k <> ''"), "k", ["v"])) == [("x", "updated"), ("y", "added")]
    assert values(sets.filtered_or_all(b, F.col("v") > 8, "k").select("k", "fell_back")) == [("", True), ("x", False), ("y", True)]
    assert values(sets.pending(b, "k", a).select("k")) == [("y",)]
    assert values(sets.dangling(b, "k", a, "k", "lost")) == [("lost", "y")]


def test_mentions_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "Mount Ember, mount ember! Mountain Ember"), (2, None), (3, ""), (4, "ember")], "d int, t string")
    names = spark.createDataFrame([("e1", "Mount Ember"), ("e2", "ember"), ("e3", None), ("e4", "  ")], "e string, n string")
    assert values(matching.mentions(docs, "d", "t", names, "e", "n")) == [(1, "e1", 2), (1, "e2", 3), (4, "e2", 1)]
    assert matching.mentions(docs, "d", "t", names.where("false"), "e", "n").count() == 0


def test_links_take_the_longest_name_first(spark):
    docs = spark.createDataFrame([(1, "the Order of Ember and Ember, Order of Ember; order"), (2, None), (3, "Mount Order of Ember")], "d int, t string")
    names = spark.createDataFrame([("e1", "Order of Ember"), ("e2", "Ember"), ("e3", "Mount Order"), ("e4", "of Ember"), ("e5", None), ("e0", "ember")], "e string, n string")
    assert values(matching.first_links(docs, "d", "t", names, "e", "n")) == [(1, "e0", 5, 1), (1, "e1", 1, 3), (3, "e3", 0, 2), (3, "e4", 2, 2)]
    assert matching.first_links(docs.where("false"), "d", "t", names, "e", "n").count() == 0


def test_remapped_references(spark):
    mapping = spark.createDataFrame([("a", "z"), ("b", "z"), ("c", None)], "o string, n string")
    rows = spark.createDataFrame([("1", "a", ["a", "b", "c", "a"]), ("2", "c", None), ("3", None, [])], "k string, r string, l array<string>")
    assert values(sets.remapped(rows, "r", mapping, "o", "n").select("k", "r", "original_r")) == [("1", "z", "a"), ("2", "c", "c"), ("3", None, None)]
    assert values(sets.remapped_lists(rows, "k", "l", mapping, "o", "n")) == [("1", ["z", "c"]), ("2", None), ("3", [])]


def test_references_and_prefixes(spark):
    rows = spark.createDataFrame([("1", "a"), ("9", "b"), (None, None)], "id string, name string")
    by_id = spark.createDataFrame([("1", "E1")], "key string, value string")
    by_name = spark.createDataFrame([("a", "E2"), ("b", "E3")], "key string, value string")
    got = matching.resolve(rows, [("id", F.col("id")), ("name", F.col("name"))], [by_id, by_name], "e")
    assert values(got.select("id", "e", "e_by")) == [("1", "E1", "id"), ("9", "E3", "name"), (None, None, None)]
    refs = spark.createDataFrame([("abcdef",), ("abcdefg1",), ("zzzzzz",)], "r string")
    known = spark.createDataFrame([("abcdefg1",), ("abcdefg2",), ("zzzzzz9",)], "k string")
    assert values(matching.unique_prefix(refs, "r", known, "k")) == [("abcdefg1", "abcdefg1"), ("zzzzzz", "zzzzzz9")]


def test_nearest_interval(spark):
    points = spark.createDataFrame([("a", 0), ("a", 25), ("a", 60), ("b", 5)], "k string, at long")
    spans = spark.createDataFrame([("a", 20, 30), ("a", 33, 40)], "k string, s long, e long")
    assert values(matching.nearest_interval(points, spans, "k", "at", "s", "e", 20)) == [("a", 0, 20), ("a", 25, 0), ("a", 60, 20), ("b", 5, None)]


def test_sequences(spark):
    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, 3, 3, 9, 1, None])], "k string, i int, n long")
    assert [r[0] for r in sequences.greedy_chunks(rows, ["k"], ["i"], "n", 2, 8).orderBy("i").select("part_no").collect()] == [1, 1, 2, 3, 4, 4]
    spans = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 4, "y"), ("a", 4, 9, "z"), ("a", 1, 5, "w")], "k string, s long, e long, t string")
    assert values(sequences.without_overlap(spans, "k", "s", "e", "t").select("t", "s", "e")) == [("w", 1, 5), ("z", 6, 9)]
    texts = spark.createDataFrame([("a", i, c) for i, c in enumerate("pqrs")], "k string, i int, t string")
    assert [r[0] for r in sequences.context(texts, "k", ["i"], "t", 3, separator="").orderBy("i").select("context").collect()] == ["pq", "pqr", "qrs", "rs"]


def test_blocks_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 7)
    rows = [("a", i, str(i % 10)) for i in range(40)] + [("b", i, "x") for i in range(3)] + [(None, 1, "n"), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, i int, t string")
    got = {(r.k, r.i): r.c for r in sequences.context(df, "k", ["i"], "t", 4, "c", "").collect()}
    for k in ("a", "b", None):
        texts = [t or "" for kk, _, t in rows if kk == k]
        for n, (kk, i, _) in enumerate(r for r in rows if r[0] == k):
            assert got[(kk, i)] == "".join(texts[max(0, n - 1) : n + 3])
    spans = [("a", i * 3, i * 3 + (50 if i == 5 else 4), str(i)) for i in range(40)]
    upto, want = None, []
    for k, s, e, t in spans:
        if upto is None or e > upto:
            want.append((t, s if upto is None or s > upto else upto + 1, e))
        upto = e if upto is None else max(upto, e)
    assert values(sequences.without_overlap(spark.createDataFrame(spans, "k string, s int, e int, t string"), "k", "s", "e", "t").select("t", "s", "e")) == sorted(want, key=repr)


def test_last_before(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 4)
    events = [("a", 5 * i, f"e{i:02d}") for i in range(12)] + [("a", 10, "e99"), ("b", 7, "x"), (None, 1, "n"), ("a", None, "n"), ("b", 8, None)]
    points = [("a", t, i) for i, t in enumerate([-1, 0, 4, 5, 10, 12, 31, 500])] + [("b", 9, 20), ("c", 9, 21), (None, 9, 22), ("a", None, 23)]
    got = sequences.last_before(spark.createDataFrame(points, "k string, _at int, _row int"), spark.createDataFrame(events, "k string, _at int, v string"), "k", "_at", "v")
    want = {0: None, 1: "e00", 2: "e00", 3: "e01", 4: "e99", 5: "e99", 6: "e06", 7: "e11", 20: "x", 21: None, 22: None, 23: None}
    assert {r["_row"]: r["last"] for r in got.collect()} == want


def test_graph(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("y", "x"), ("z", "z"), (None, "q")], "s string, t string")
    assert values(graph.reachable_minimum(edges, "s", "t")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")]
    assert values(graph.final_targets(edges, "s", "t")) == [("b", "a", 1), ("c", "a", 2), ("d", "a", 3), ("y", "x", 1)]
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "s string, t string")
    assert values(graph.final_targets(loop, "s", "t")) == [("a", None, None), ("b", None, None), ("c", "d", 1)]
    assert graph.reachable_minimum(edges.where("false"), "s", "t").count() == 0


def test_scoring(spark):
    rows = spark.createDataFrame([("k", "a", 1.0, "b"), ("k", "b", 0.5, "b"), ("m", "a", 2.0, "b"), ("n", "a", 0.1, None)], "k string, c string, w double, now string")
    assert values(scoring.vote(rows, "k", "c", "w", "now").select("k", "chosen", "switched")) == [("k", "b", False), ("m", "a", True), ("n", "a", True)]
    tags = spark.createDataFrame([(["x", "y", "x", None],), (["y", "x"],), (None,)], "t array<string>")
    assert values(scoring.cooccurrence(tags, "t")) == [("x", "y", 2)]
    claims = spark.createDataFrame([(i, "g", t) for i, t in enumerate(["a", "a", "", "b", "c"])], "i int, g string, t string")
    got = scoring.validated(claims, {"empty": F.col("t") == ""}, "g", ["i"], F.col("t"), 2)
    assert [r[0] for r in got.orderBy("i").select("reason").collect()] == [None, "duplicate", "empty", None, "over_cap"]


def test_hot_keys_are_split_off_and_nothing_is_lost(spark):
    left = spark.range(150_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    left = left.unionByName(spark.createDataFrame([(None,)], "k string"))
    right = left.where("k IS NOT NULL").distinct().withColumn("v", F.lit(1))
    hot = skew.hot_keys(left, "k")
    assert hot == ["hot"]
    assert skew.lookup_join(left, right, "k", hot=hot).count() == 150_000
    assert skew.lookup_join(left, right, "k", "left", hot=hot).count() == 150_001
