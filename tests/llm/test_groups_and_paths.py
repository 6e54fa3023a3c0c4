from __future__ import annotations

import random

from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skeinflow.llm.conversations import conversation_turns, reply_paths
from skeinflow.llm.groups import p5_found, seed_tree_components


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((v, find(v)) for v in list(parent))


def test_components_of_a_chain_a_star_and_a_ring(spark):
    rng = random.Random(1)
    names = [f"{i:04d}" for i in range(300)]
    rng.shuffle(names)
    pairs = list(zip(names[:80], names[1:80])) + [(names[90], n) for n in names[91:180]] + list(zip(names[200:240], names[201:241])) + [(names[240], names[200])]
    pairs += [(b, a) for a, b in pairs[:20]] + [("x", "x"), (None, "y"), ("z", None)]
    got = seed_tree_components(spark.createDataFrame([(a, b, "clash") for a, b in pairs], "a string, b string, u string"), "a", "b")
    assert values(got) == components(pairs)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=14))
def test_components_like_union_find(spark, pairs):
    df = spark.createDataFrame([(f"{a:02d}", f"{b:02d}") for a, b in pairs], "a string, b string")
    assert values(seed_tree_components(df, "a", "b")) == components([(f"{a:02d}", f"{b:02d}") for a, b in pairs])


SEED = "entity_id string, canonical_name string, extra int"
MERGE = "source_entity_id string, source_entity_name string, target_entity_id string, target_entity_name string"


def test_ends_by_id_and_by_name(spark, tables):
    seeds = [("e1", "Ann Lee", 1), ("e1", "Ann Lee", 1), ("e2", "Bob", 1), ("e3", "Cy", 1), ("e4", None, 1), (None, "Nobody", 1)]
    merges = [(None, " ANN  lee ", "e2", None), ("", "bob", "e3", "x"), ("gone", "Cy", "e1", None), (None, None, "e4", None), (None, "Nobody", "e4", None), ("e4", "a", "e4", "b")]
    assert values(p5_found(spark, tables(entity_seed=(seeds, SEED), identity_merges=(merges, MERGE)))) == [("e1", "e1"), ("e1", "e2"), ("e1", "e3")]
    assert p5_found(spark, tables(entity_seed=([], SEED), identity_merges=([], MERGE))).count() == 0


def test_paths_orphans_and_cycles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "a"), ("o", "gone"), ("p", "o"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), (None, "a"), ("b", "a")]
    got = {r.node: (r.root, r.depth, r.state) for r in reply_paths(spark.createDataFrame(rows, "n string, p string"), "n", "p").collect()}
    assert got == {
        "a": ("a", 0, "ok"), "b": ("a", 1, "ok"), "c": ("a", 2, "ok"), "d": ("a", 3, "ok"), "e": ("a", 1, "ok"), "o": (None, None, "orphan"), "p": (None, None, "orphan"),
        **{k: (None, None, "cycle") for k in "xyzws"},
    }
    assert reply_paths(spark.createDataFrame([], "n string, p string"), "n", "p").count() == 0


def test_long_chains(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    rows = [(str(a), str(b)) for a, b in zip(order[1:], order)] + [(str(order[0]), None)]
    got = {r.node: r.depth for r in reply_paths(spark.createDataFrame(rows, "n string, p string"), "n", "p").collect()}
    assert got == {str(x): i for i, x in enumerate(order)}


MESSAGE = "message_id string, thread_id string, partner_id string, timestamp_utc timestamp, author_id string, is_bot_or_application boolean, content_raw string, conversation_id string, ingested_at_utc timestamp"
CONFIG = "config_id int, section string, enabled boolean, max_gap_hours double, self_user_id string, model_window_max_messages int, model_window_max_chars int"
SEGMENT = "conversation_id string, message_ids array<string>"


def test_conversations(spark, tables):
    import datetime as dt

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)

    def m(conv, mid, at, author, text="hi", partner="P", bot=False, thread="t"):
        return (mid, thread, partner, None if at is None else t(at), author, bot, text, conv, t(0))

    rows = [
        m("ok", "2", 5, "P"), m("ok", " 1 ", 5, "O", " "), m("ok", "1", 5, "O", "late text", None), m("ok", "3", 9, "B", bot=True), m("ok", "0", 9, "O", partner="unknown"),
        m("blank", "4", 1, "O"), m("blank", "5", 2, "P", "  \n"),
        m("more", "6", 1, "O"), m("more", "7", 2, "P"), m("more", "8", 3, "P"),
        m("less", "9", 1, "O"), m("less", "10", 2, "P"),
        m("untimed", "11", None, "O"), m("untimed", "12", 2, "P"),
        m("stranger", "13", 1, "O"), m("stranger", "14", 2, "P"), m("stranger", "15", 3, "X"),
        m("nobody", "16", 1, "O"), m("nobody", "17", 2, None), m("nobody", "17b", 2, "P"),
        m("nosegment", "18", 1, "O"), m("nosegment", "19", 2, "P"),
        m("two", "20", 1, "O", partner="P"), m("two", "21", 2, "P", partner="Q"),
        m(None, "22", 1, "O"),
    ]
    lists = {"ok": ["3", "1", "2", "0", "0"], "blank": ["4", "5"], "more": ["6", "7"], "less": ["9", "10", "99"], "untimed": ["11", "12"], "stranger": ["13", "14", "15"], "nobody": ["16", "17", "17b"], "two": ["20", "21"], "gone": ["1"]}
    config = [(1, "conversation_segmentation", True, 1.0, "O", 1, 1)]
    path = tables(messages_relevant_conversations=(rows, MESSAGE), pipeline_config=(config, CONFIG), conversation_segments=([*lists.items(), ("none", None)], SEGMENT))
    assert values(conversation_turns(spark, path)) == [("ok", 1, "1", "owner"), ("ok", 2, "2", "partner"), ("ok", 3, "0", "owner"), ("ok", 4, "3", "bot")]
    empty = tables(messages_relevant_conversations=([], MESSAGE), pipeline_config=(config, CONFIG), conversation_segments=([], SEGMENT))
    assert conversation_turns(spark, empty).count() == 0
