from __future__ import annotations

import datetime as dt

from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinflow.operators.delivery import first_delivery
from skeinflow.operators.sessions import gap_sessions

HOUR = 3_600_000_000


def events(spark, rows):
    return spark.createDataFrame(rows, "k string, us bigint, extra string").select("k", F.timestamp_micros("us").alias("ts"), F.col("extra").alias("session_no"))


def test_exact_gap_stays_one_session_and_more_splits(spark):
    rows = [("a", 0, None), ("a", HOUR, None), ("a", 2 * HOUR + 1, None)]
    got = gap_sessions(events(spark, rows), "k", "ts", HOUR)
    assert values(got.select("session_no", "start_us", "end_us", "duration_us", "event_count")) == [(1, 0, HOUR, HOUR, 2), (2, 2 * HOUR + 1, 2 * HOUR + 1, 0, 1)]


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [("a", 5, "x"), ("a", 5, "x"), ("a", None, "x"), (None, 5, "x"), ("b", -3, None)]
    got = gap_sessions(events(spark, rows), "k", "ts", 1)
    assert values(got.select("k", "event_count")) == [("a", 2), ("b", 1)]


def test_empty_table_and_zero_gap(spark):
    assert gap_sessions(events(spark, []), "k", "ts", 10).count() == 0
    got = gap_sessions(events(spark, [("a", 1, None), ("a", 1, None), ("a", 2, None)]), "k", "ts", 0)
    assert values(got.select("start_us", "event_count")) == [(1, 2), (2, 1)]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-50, 50)), max_size=30), st.integers(0, 12))
def test_like_a_plain_loop(spark, rows, gap):
    want = []
    for key in "ab":
        last = None
        for t in sorted(t for k, t in rows if k == key):
            if last is None or t - last > gap:
                want.append([key, t, t, 0])
            want[-1][2], want[-1][3], last = t, want[-1][3] + 1, t
    got = gap_sessions(events(spark, [(k, t, None) for k, t in rows]), "k", "ts", gap)
    assert values(got.select("k", "start_us", "end_us", "event_count")) == sorted(map(tuple, want), key=repr)


MESSAGE = "thread string, mid string, at timestamp, `a.b` string, m map<string,string>, copies string"


def test_first_delivery_is_kept_whatever_the_order(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("t", " 1\n", t + dt.timedelta(1), "late", {"x": "1"}, "c"), ("t", "1", t, "first", None, None), ("t", "1", None, "untimed", None, None), ("u", "1", t, "other", None, None)]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, MESSAGE)
        got = first_delivery(df, {"thread": F.col("thread"), "mid": F.trim(F.regexp_replace("mid", "\n", ""))}, F.col("at"), [])
        assert values(got.select("thread", "mid", "`a.b`", "copies")) == [("t", "1", "first", 3), ("u", "1", "other", 1)]


def test_rows_without_identity_stay_and_ties_are_settled(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("t", None, t, "x", None, None)] * 2 + [("t", "1", t, "b", None, None), ("t", "1", t, "a", None, None)], MESSAGE)
    got = first_delivery(df, {"thread": F.col("thread"), "mid": F.col("mid")}, F.col("at"), [F.col("`a.b`")])
    assert values(got.select("mid", "`a.b`", "copies")) == [("1", "a", 2), (None, "x", 1), (None, "x", 1)]
    assert first_delivery(df.where("false"), {"mid": F.col("mid")}, F.col("at"), []).count() == 0
