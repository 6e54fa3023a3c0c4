"""Plans over the message table: distinct messages and their sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.text import WHITESPACE, trimmed
from skeinflow.operators.delivery import delivery_counts, first_delivery
from skeinflow.operators.sessions import gap_sessions
from skeinflow.runtime import table

MESSAGES = "messages_relevant_conversations"


def config_in_force(spark: SparkSession, sf_dir: str) -> dict:
    """The enabled segmentation row of the configuration: a table of fixed size, smallest id first."""
    rows = (
        table(spark, sf_dir, "pipeline_config")
        .where(F.col("enabled") & (F.col("section") == "conversation_segmentation"))
        .orderBy("config_id")
        .limit(1)
        .collect()
    )
    if not rows:
        raise ValueError("pipeline_config has no enabled row of section conversation_segmentation")
    return rows[0].asDict()


def _identity() -> dict:
    return {"thread_id": F.col("thread_id"), "message_id": trimmed(F.col("message_id"))}


#: Between deliveries of one time; after these the hash of the whole row decides.
_TIES = ["provenance.export_batch", "provenance.json_path", "provenance.content_hash"]


def distinct_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (thread_id, trimmed message_id), with the number of deliveries."""
    return first_delivery(table(spark, sf_dir, MESSAGES), _identity(), F.col("ingested_at_utc"), [F.col(t) for t in _TIES])


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages as the text queries need them: identity, conversation, pair, author, time and text.

    The text is the normalised one, the raw one where that is empty, else empty.
    """
    text = F.coalesce(F.nullif("content_normalized", F.lit("")), "content_raw", F.lit(""))
    return distinct_messages(spark, sf_dir).select("thread_id", "message_id", "conversation_id", "dm_pair_id", "author_id", "timestamp_utc", F.unix_micros("timestamp_utc").alias("us"), text.alias("text"), "copies")


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each pair with number, start, end, duration and message count."""
    gap_us = round(config_in_force(spark, sf_dir)["max_gap_hours"] * 3_600_000_000)
    # Rows of a message agree in pair and time, so distinct rows of these four are distinct messages.
    messages = (
        table(spark, sf_dir, MESSAGES)
        .where(F.col("timestamp_utc").isNotNull() & F.col("dm_pair_id").isNotNull())
        .select("thread_id", trimmed(F.col("message_id")).alias("message_id"), "dm_pair_id", "timestamp_utc")
        .distinct()
    )
    return gap_sessions(messages, "dm_pair_id", "timestamp_utc", gap_us).withColumnRenamed("event_count", "message_count")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_sessions(spark, sf_dir).select("dm_pair_id", "start_us", "end_us", "message_count")


def p2_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message once; timestamps as microseconds."""
    return distinct_messages(spark, sf_dir).select(
        "thread_id",
        "message_id",
        "dm_pair_id",
        "conversation_id",
        "author_id",
        "content_raw",
        F.col("provenance.export_batch").alias("export_batch"),
        F.unix_micros("timestamp_utc").alias("sent_us"),
        F.unix_micros("ingested_at_utc").alias("ingested_us"),
        "copies",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages delivered more than once, from the counts that decide which delivery is kept."""
    counts = delivery_counts(table(spark, sf_dir, MESSAGES), _identity(), F.col("ingested_at_utc"), [F.col(t) for t in _TIES])
    return counts.where("copies > 1").select("thread_id", "message_id")


QUERIES = {"p1_found": p1_found, "p1_sessions": p1_sessions, "p2_found": p2_found, "p2_messages": p2_messages}

_TRIM = "trim(message_id, '" + WHITESPACE + "')"
#: The messages of ``said``, as TESTDATA's identity and the order of deliveries define them.
DISTINCT = f"""(SELECT thread_id, {_TRIM} AS message_id, conversation_id, dm_pair_id, author_id, timestamp_utc, epoch_us(timestamp_utc) AS us, coalesce(nullif(content_normalized, ''), content_raw, '') AS text,
  count(*) OVER (PARTITION BY thread_id, {_TRIM}) AS copies FROM messages_relevant_conversations
  QUALIFY row_number() OVER (PARTITION BY thread_id, {_TRIM} ORDER BY ingested_at_utc NULLS LAST, provenance.export_batch NULLS FIRST, provenance.json_path NULLS FIRST, provenance.content_hash NULLS FIRST, content_raw NULLS FIRST) = 1)"""
GAP_US = "(SELECT CAST(round(max_gap_hours * 3600000000) AS BIGINT) FROM pipeline_config WHERE enabled AND section = 'conversation_segmentation' ORDER BY config_id LIMIT 1)"
_SESSIONS = f"""
WITH m AS (
  SELECT thread_id, {_TRIM} AS mid, max(dm_pair_id) AS dm_pair_id, max(epoch_us(timestamp_utc)) AS us
  FROM messages_relevant_conversations WHERE timestamp_utc IS NOT NULL AND dm_pair_id IS NOT NULL GROUP BY 1, 2
), f AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY dm_pair_id ORDER BY us) <= {GAP_US} THEN 0 ELSE 1 END AS opens FROM m
), s AS (
  SELECT *, sum(opens) OVER (PARTITION BY dm_pair_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM f
)
"""
SQL = {
    "p1_found": _SESSIONS + "SELECT dm_pair_id, min(us) AS start_us, max(us) AS end_us, count(*) AS message_count FROM s GROUP BY dm_pair_id, no",
    "p1_sessions": _SESSIONS + "SELECT dm_pair_id, CAST(no AS BIGINT) AS session_no, min(us) AS start_us, max(us) AS end_us, max(us) - min(us) AS duration_us, count(*) AS message_count FROM s GROUP BY dm_pair_id, no",
    "p2_found": f"SELECT thread_id, {_TRIM} AS message_id FROM messages_relevant_conversations GROUP BY 1, 2 HAVING count(*) > 1",
    "p2_messages": f"""
SELECT thread_id, mid AS message_id, dm_pair_id, conversation_id, author_id, content_raw, export_batch, sent_us, ingested_us, copies FROM (
  SELECT *, {_TRIM} AS mid, provenance.export_batch AS export_batch, epoch_us(timestamp_utc) AS sent_us, epoch_us(ingested_at_utc) AS ingested_us,
    count(*) OVER (PARTITION BY thread_id, {_TRIM}) AS copies,
    row_number() OVER (PARTITION BY thread_id, {_TRIM} ORDER BY ingested_at_utc NULLS LAST, provenance.export_batch NULLS FIRST,
      provenance.json_path NULLS FIRST, provenance.content_hash NULLS FIRST, content_raw NULLS FIRST) AS rn
  FROM messages_relevant_conversations) WHERE rn = 1""",
}
