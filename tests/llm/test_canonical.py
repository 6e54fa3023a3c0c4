from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skeinflow.llm.canonical import CountingTrie, canonical, p3_claims, p3_found, radix_counts

SAME = [
    ["Site: A B; era: year 5", "era=YEAR-5 | site=a b", '{"era": "Year 5", "site": "A B"}', "SITE : a b.\nERA : year 5.", "site=a b;era=year 5;", "{“site”: “a b”, “era”: “year 5”}", "site: A B, era: year 5"],
    ["The cat, sat!", "the​  CAT sat", "THECATSAT"],
    ["Éloise", "Éloise!", "éLOISE"],
    ['{"a": 1, "b": "x"}', "b: x; a: 1"],
]
DIFFERENT = ["site: A B", "Éloise", "Eloise", "a: 1; b: 2", "a1b2", "a: 1; b: 2; a: 1", "a: 1b; 2: x", "two words: 1; b: 2", "ab: 1; 2", "a: b", "0", "o"]


@pytest.mark.parametrize("group", SAME)
def test_other_dress_is_equal(group):
    assert len({canonical(t) for t in group}) == 1


def test_different_texts_stay_apart():
    assert len({canonical(t) for t in DIFFERENT}) == len(DIFFERENT)
    assert [canonical(t) for t in (None, "", " \n", "?!", "​")] == [None] * 5


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), max_size=60))
def test_trie_counts(keys):
    trie, want = CountingTrie(), Counter(keys)
    for i, k in enumerate(keys):
        trie.add(k, 1, f"{i:03d}")
    assert {k: (n, low) for k, n, low in trie.terminals()} == {k: (n, f"{keys.index(k):03d}") for k, n in want.items()}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab", min_size=1, max_size=12), max_size=60), st.integers(1, 1600))
def test_radix_counts_at_any_bucket_size(spark, keys, limit):
    df = spark.createDataFrame([(f"{i:03d}", bytearray(k.encode())) for i, k in enumerate(keys)], "id string, canon binary")
    got = {bytes(r.canon).decode(): (r.n, r.low) for r in radix_counts(df, limit).collect()}
    assert got == {k: (n, f"{keys.index(k):03d}") for k, n in Counter(keys).items()}


CLAIM = "claim_id string, claim_text string, canon string, n int"


def test_claims(spark, tables):
    texts = [t for g in SAME for t in g] + [None, "", "!", "?"] + DIFFERENT + ["x" * 50_000, "X " * 50_000]
    rows = [(f"c{(i * 37) % 1000:03d}", t, "clash", i) for i, t in enumerate(texts)]
    path = tables(claims=([*rows, (None, "The cat sat", "", 0)], CLAIM))
    groups = defaultdict(list)
    for i, t, *_ in rows:
        if canonical(t):
            groups[canonical(t)].append(i)
    assert values(p3_found(spark, path)) == sorted((min(g), i) for g in groups.values() if len(g) > 1 for i in g)
    assert values(p3_claims(spark, path)) == sorted((min(g), len(g)) for g in groups.values())
    assert p3_found(spark, tables(claims=([], CLAIM))).count() == 0


def test_a_hot_text(spark, tables):
    rows = [(f"c{i:05d}", "Hot claim!" if i % 3 == 0 else f"claim number {i}", "", 0) for i in range(9000)]
    got = p3_found(spark, tables(claims=(rows, CLAIM)))
    assert got.count() == 3000 and got.select("group_claim_id").distinct().collect()[0][0] == "c00000"
