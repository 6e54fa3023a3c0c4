from __future__ import annotations

import random

import pytest
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.llm.names import Context, abbreviates, deletions, edits, fits, form, p6_found, pairs_within, parse

CTX = Context({"margaret": 9, "matthias": 9, "vespera": 9, "hespera": 9, "mount": 9, "trading": 9, "company": 9, "dorothea": 9, "theodora": 9}, {"peggy": {"margaret": 5}, "thea": {"dorothea": 3, "theodora": 3}, "mt": {"mount": 5}})


@pytest.mark.parametrize(
    "name",
    ["Margaret Fainevastul", "FAINEVASTUL, Margaret", "margaret_fainevastul", "MargaretFainevastul", "margaretfainevastul", "Peggy Fainevastul", "Cpt. Margaret C. Fainevastul", "“Margaret” Fáinevastul", "Fainevastul (old) Margaret", " Margarte  Fainevastul —"],
)
def test_one_form_for_all_dresses(name):
    got = form(name, CTX)
    assert (got.root, got.full) == ("fainevastul", "margaret")


def test_other_names_stay_other():
    assert form("Vespera Abcdefgh", CTX).full != form("Hespera Abcdefgh", CTX).full
    assert form("Mt. Abcdefgh", CTX).full == "mount"
    assert [form(n, CTX) for n in (None, "", "???", "-", "Margaret", "the Captain", "unknown", "n/a")] == [None] * 8
    bare = form("Abcdefgh", CTX)
    assert (bare.context, bare.full) == ("", None)
    assert fits(form("M. Abcdefgh", CTX).context, "vespera") is None
    assert fits(form("M. Abcdefgh", CTX).context, "margaret") < 0
    assert fits(form("Thea Abcdefgh", CTX).context, "dorothea") < 0 and form("Thea Abcdefgh", CTX).full is None
    assert form("the Hollow Weaver of Abcdef", CTX).full == ""


def test_parse_and_abbreviations():
    assert parse("O'Neil-Smith, Dr. A.").words == ("oneil", "smith") and parse("O'Neil, A.").letters == ("a",)
    assert abbreviates("mtn", "mountain") and abbreviates("trdg", "trading") and not abbreviates("gtrd", "trading")


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_near_words_share_a_deletion(a, b):
    def slow(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    assert edits(a, b, 2) == min(slow(a, b), 3)
    if min(len(a), len(b)) >= 7 and slow(a, b) <= 2:
        assert deletions(a) & deletions(b)


SEED = "entity_id string, canonical_name string, entity_type string, aliases array<string>, root string"
CAND = "candidate_id string, candidate_name string, proposed_entity_type string"
GIVEN = ["Margaret", "Matthias", "Vespera", "Hespera", "Corvane"]


def test_records_of_one_name_are_linked(spark, tables):
    rng = random.Random(4)
    roots = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5)).capitalize() for _ in range(25)]
    seeds = [(f"f{i:02d}", f"{g} {roots[i]}", "character", [], "clash") for i, g in enumerate(GIVEN * 5)]
    seeds += [("e1", "Margaret Fainevastul", "character", ["Peggy Fainevastul", "the Stranger", "the Pale Envoy of Rupicukir"], None)] * 2
    seeds += [("e2", "Matthias Fainevastul", "character", ["the Stranger"], None), ("e3", "Margaret Lodipesorth", "character", ["Peggy Lodipesorth"], None), ("e4", "Margaret Lodipsorth", "character", None, None), ("e5", None, None, None, None)]
    found = ["Margaret Fainevastul", "MARGARET FAINEVASUTL", "Fainevastul", "Peggy Fainevastul", "the Pale Envoy of Rupicukir", "the Stranger", "the Stranger", None, "???", "Lodipesorth", f"Hespera {roots[3]}", "Matthias Fainevastul", "Unseeded Wakmuvethol", "Unseeded Wakmuvethol", " "]
    path = tables(entity_seed=(seeds, SEED), entity_candidates=([(f"c{i:02d}", n, None) for i, n in enumerate(found)], CAND))
    groups = [["c00", "c01", "c03", "c04", "e1"], ["c11", "e2"], ["c09", "e3", "e4"], ["c10", "f03"], ["c12", "c13"]]
    want = sorted((a, b) for g in groups for a in g for b in g if a < b)
    assert values(p6_found(spark, path)) == want
    assert p6_found(spark, tables(entity_seed=([], SEED), entity_candidates=([], CAND))).count() == 0


def test_large_groups_give_all_pairs_from_blocks(spark):
    rows = spark.createDataFrame([(f"{i:03d}", "g") for i in range(60)] + [("x", "h"), ("y", "h"), ("y", "h"), ("z", "k")], "record string, group_key string")
    got = pairs_within(rows, block=7)
    assert got.count() == 60 * 59 // 2 + 1 == got.distinct().count()
