"""Queries that once did less than the whole job, against plain Python on small tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest

from skeinflow.plans import evidence, relational

MERGES = "source_entity_id string, target_entity_id string, created_at_utc timestamp, proposal_id string"


def followed(pairs):
    """source -> (final, hops), final and hops null in or into a cycle."""
    to = {}
    for s, t in pairs:
        if s is not None and t is not None and s != t:
            to[s] = t  # the last one counts
    out = {}
    for s in to:
        at, seen = s, []
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        out[s] = (None, None) if at in to else (at, len(seen))
    return out


def test_merges_whatever_the_order_of_ids(spark, tables):
    pairs = [("z", "m"), ("m", "q"), ("q", "b"), ("d", "c"), ("d", "x"), ("a", "a"), ("a", "k"), ("s", "s"), ("u", "v"), ("v", "u"), ("t", "u"), (None, "z"), ("y", None)]
    pairs += [(f"n{i:02}", f"n{i - 1:02}") for i in range(1, 40)]
    began = datetime(2025, 1, 1, tzinfo=timezone.utc)
    merges = [(s, t, began + timedelta(hours=i // 2), f"p{i:03}") for i, (s, t) in enumerate(pairs)]
    sf = tables(identity_merges=(merges, MERGES), claims=([(f"c{i}", t) for i, t in enumerate(["z", "d", "a", "s", "t", "n39", "b", None])], "claim_id string, target_entity_id string"))
    got = {r.source_entity_id: (r.final, r.hops) for r in relational.merge_targets(spark, sf).collect()}
    assert got == followed(pairs) and got["z"] == ("b", 3) and got["a"] == ("k", 1) and got["t"] == (None, None) and "s" not in got
    claims = {r.claim_id: r.target_entity_id for r in evidence.merged_claims(spark, sf).collect()}
    assert claims == {"c0": "b", "c1": "x", "c2": "k", "c3": "s", "c4": "t", "c5": "n00", "c6": "b"}


CONFIG = "config_id int, section string, enabled boolean, max_gap_hours double, self_user_id string, model_window_max_messages int, model_window_max_chars int"
ROWS = "message_id string, conversation_id string, dm_pair_id string, author_id string, timestamp_utc timestamp, content_normalized string, thread_id string, content_raw string, ingested_at_utc timestamp, provenance struct<json_path:string,export_batch:string,parser_version:string,content_hash:string>"


def config(messages, chars):
    return [(1, "conversation_segmentation", True, 12.0, "me", messages, chars), (2, "conversation_segmentation", False, 6.0, "me", 1, 1), (3, "other", True, None, None, 2, 2)], CONFIG


def said(sizes, conversation="c"):
    """Messages of these sizes, a minute apart."""
    began = datetime(2025, 1, 1, tzinfo=timezone.utc)
    return [(f"m{i:03}", conversation, "p", "me", began + timedelta(minutes=i), "x" * n, "t", None, began, None) for i, n in enumerate(sizes)]


@pytest.mark.parametrize(
    ("messages", "chars", "want"),
    [
        (3, 100, [(1, 3, 30), (2, 3, 30), (3, 1, 10)]),
        (80, 20, [(1, 2, 20), (2, 2, 20), (3, 2, 20), (4, 1, 10)]),
        (7, 70, [(1, 7, 70)]),
        (80, 9, [(i, 1, 10) for i in range(1, 8)]),
    ],
)
def test_windows_are_bounded_as_configured(spark, tables, messages, chars, want):
    sf = tables(pipeline_config=config(messages, chars), messages_relevant_conversations=(said([10] * 7), ROWS))
    assert sorted((r.part_no, r.messages, r.chars) for r in relational.model_windows(spark, sf).collect()) == want


def test_ids_without_white_space_of_any_kind(spark, tables):
    rows = said([10] * 9)
    dressed = [("\t" + rows[0][0], *rows[0][1:]), (rows[0][0] + "\n", *rows[0][1:]), (f"\u00a0{rows[8][0]}\r\n", *rows[8][1:]), *rows[:8]]
    segments = [("c", "p", [r[0] for r in rows], rows[8][4])], "conversation_id string, dm_pair_id string, message_ids array<string>, timestamp_start_utc timestamp"
    sf = tables(pipeline_config=config(80, 1000), messages_relevant_conversations=(dressed, ROWS), conversation_segments=segments)
    assert [tuple(r) for r in relational.segment_messages(spark, sf).select("found", "deliveries").collect()] == [(9, 11)]
    assert sorted(r.message_id for r in relational.message_context(spark, sf).collect()) == [r[0] for r in rows]
    assert sorted((r.place, r.message_id) for r in relational.conversation_openings(spark, sf).collect()) == [(i + 1, rows[i][0]) for i in range(8)]
    assert [(r.messages, r.chars) for r in relational.model_windows(spark, sf).collect()] == [(9, 90)]
    assert [r.owner_message for r in evidence.owner_before_segment(spark, sf).collect()] == [rows[8][0]]
