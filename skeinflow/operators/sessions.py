"""Sessions separated by inactivity gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered_slots(events: DataFrame, key: str, ts: str, gap_us: int) -> DataFrame:
    """``_key, _slot, _start, _end, _n, _no``: each key's occupied slots with the number of their session."""
    width = max(int(gap_us), 1)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = (
        events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .select(F.col(key).alias("_key"), us.alias("_us"))
        .groupBy("_key", F.expr(f"(_us - pmod(_us, {width}L)) div {width}L").alias("_slot"))
        .agg(F.min("_us").alias("_start"), F.max("_us").alias("_end"), F.count(F.lit(1)).alias("_n"))
    )
    ordered = Window.partitionBy("_key").orderBy("_slot")
    opens = F.coalesce(F.col("_start") - F.lag("_end").over(ordered) > F.lit(int(gap_us)), F.lit(True))
    return slots.withColumn("_opens", opens.cast("long")).withColumn("_no", F.sum("_opens").over(ordered))


def session_numbers(events: DataFrame, key: str, ts: str, gap_us: int, number: str = "session_no") -> DataFrame:
    """Each event with the number of its session, as ``gap_sessions`` counts them.

    Events with a null key or time have no session and are left out. Events meet their session by
    (key, slot), so a hot key is as many join keys as it has slots.
    """
    if gap_us < 0:
        raise ValueError("gap_us must not be negative")
    width = max(int(gap_us), 1)
    slots = _numbered_slots(events, key, ts, gap_us).select("_key", "_slot", F.col("_no").alias(number))
    placed = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_key", F.col(key)).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    placed = placed.withColumn("_slot", F.expr(f"(_us - pmod(_us, {width}L)) div {width}L"))
    return placed.drop(number).join(slots, ["_key", "_slot"]).drop("_key", "_slot", "_us")


def gap_sessions(events: DataFrame, key: str, ts: str, gap_us: int) -> DataFrame:
    """Split each ``key``'s events into sessions wherever the pause is strictly greater than ``gap_us``.

    Returns ``key, session_no, start_us, end_us, duration_us, event_count``; ``session_no`` counts
    from 1 in time order.

    Raw rows meet no window. Two events in one time slot of width ``gap_us`` can't be further apart
    than the gap, so a slot is never cut and a hash aggregation with map-side combining reduces
    each (key, slot) to one row. The lag and the running sum of gap flags then see at most
    (time span / gap) rows for a key, however many rows it has, so a hot key needs no salt.

    Null keys and null times count nowhere. Repeated rows count as often as they appear: remove
    repeated deliveries first. Equal times are one session. An empty table gives no rows. Extra
    columns are ignored.
    """
    if gap_us < 0:
        raise ValueError("gap_us must not be negative")
    numbered = _numbered_slots(events, key, ts, gap_us)
    return (
        numbered.groupBy("_key", "_no")
        .agg(F.min("_start").alias("start_us"), F.max("_end").alias("end_us"), F.sum("_n").alias("event_count"))
        .select(
            F.col("_key").alias(key),
            F.col("_no").alias("session_no"),
            "start_us",
            "end_us",
            (F.col("end_us") - F.col("start_us")).alias("duration_us"),
            "event_count",
        )
    )
