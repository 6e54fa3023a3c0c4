"""Streaming forms: sessions, incremental work, marker counts, prior context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skeinflow.operators.scoring import activated
from skeinflow.runtime import Scratch, ship
from skeinflow.sources.sinks import VersionedTable


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a stream, each emitted once the watermark has passed its end.

    A pause longer than ``gap`` starts a new session, one of exactly ``gap`` doesn't, as in the batch
    operator ``gap_sessions``. Rows later than ``late`` are dropped.
    """
    rows = events.where(F.col(key).isNotNull()).withWatermark(ts, late)
    by = rows.groupBy(F.col(key), F.session_window(ts, f"{gap} 1 microsecond")).agg(F.count(F.lit(1)).alias("event_count"), F.max(ts).alias("last"))
    return by.select(key, F.col("session_window.start").alias("start"), F.col("last").alias("end"), "event_count")


def first_deliveries(rows: DataFrame, identity: list[str], ts: str, late: str) -> DataFrame:
    """The first delivery of each identity within the watermark; state is dropped as it passes."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(identity)


def incremental(rows: DataFrame, key: str, done: VersionedTable, work: Callable[[DataFrame], DataFrame]) -> int:
    """Do ``work`` for rows whose key isn't in ``done`` yet and add the results: how many keys were new.

    Only the batch's own results are written, beside what is there. For ``foreachBatch``: a batch that is delivered again after a failure adds nothing twice.
    """
    fresh = Scratch(rows.sparkSession, "fresh").save(rows.join(done.read().select(key).distinct(), key, "left_anti"))
    n = fresh.select(key).distinct().count()
    if n:
        done.append(work(fresh))
    return n


def count_markers(rows: DataFrame, marker: str, counts: VersionedTable, least: int) -> None:
    """Add a batch's marker counts to the stored ones and switch on markers that have become frequent."""
    fresh = rows.where(F.col(marker).isNotNull()).groupBy(marker).agg(F.count(F.lit(1)).alias("uses"))
    counts.write(activated(counts.read(), fresh, marker, "uses", least))


def prior_context(events: DataFrame, key: str, ts: str, text: str, keep: int, late: str, idle: str) -> DataFrame:
    """``key, ts, text, prior``: each event with the last ``keep`` texts of its key that came before it.

    The rows of a key in one batch are taken in order of time (then text), after those of earlier
    batches. Rows later than ``late`` are dropped; a key without events for ``idle`` is forgotten, so
    state ends. Events without key or time are left out.
    """
    ship(events.sparkSession)
    pause = int(pd.Timedelta(idle) / pd.Timedelta("1ms"))

    def update(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([ts, text], kind="stable", na_position="first")
        prior = []
        for value in rows[text]:
            prior.append("\n".join(held))
            held = [*held, value or ""][-keep:]
        state.update((held,))
        newest = int(rows[ts].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + pause)
        yield pd.DataFrame({key: found[0], ts: rows[ts], text: rows[text], "prior": prior})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, text).withWatermark(ts, late)
    return rows.groupBy(key).applyInPandasWithState(update, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, `{text}` string, prior string", "held array<string>", "append", GroupStateTimeout.EventTimeTimeout)
