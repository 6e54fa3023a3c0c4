"""Queries that go through sources, sinks, the model boundary and streams, run to their end, with SQL for what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.operators import ranking
from skeinflow.plans import messages
from skeinflow.plans.messages import DISTINCT, GAP_US, MESSAGES, config_in_force
from skeinflow.plans.normalising import CLEAN
from skeinflow.runtime import Scratch, table
from skeinflow.sources import models, readers, sinks
from skeinflow.streaming import streams

#: Messages on one page of an export.
PAGE = 100


def _n(name: str):
    return F.count(F.lit(1)).alias(name)


def exported_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages written as pages of an export, a JSON array to a file, and read again as flat messages."""
    root = Scratch(spark, "export").base
    said = messages.said(spark, sf_dir).select("thread_id", "message_id", "author_id", "us", F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "text")
    placed = ranking.numbered_per_key(said, "thread_id", ["us", "message_id"], "n").withColumn("page", F.expr(f"(n - 1) div {PAGE}"))
    one = F.struct(F.col("message_id").alias("id"), "timestamp", F.col("text").alias("content"), F.struct(F.col("author_id").alias("id")).alias("author"))
    placed.groupBy("thread_id", "page").agg(F.to_json(F.collect_list(one)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/pages")
    flat = readers.normalised(readers.pages(spark, f"{root}/pages", "*.txt"), f"{root}/pages")
    return flat.select("message_id", "author_id", F.unix_micros("timestamp_utc").alias("us"), F.md5("content_normalized").alias("text"))


def line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted claims written as lines, the others appended, all read again and counted."""
    path = f"{Scratch(spark, 'lines').base}/claims"
    rows = table(spark, sf_dir, "claims").select("claim_id", "status", "source_snippet_ids", "confidence")
    sinks.write_lines(rows.where("status = 'accepted'"), path)
    sinks.write_lines(rows.where("status <> 'accepted'"), path, append=True)
    read = readers.json_lines(spark, path, rows.schema)
    return read.groupBy("status").agg(_n("claims"), F.sum(F.size(F.coalesce("source_snippet_ids", F.array().cast("array<string>")))).cast("long").alias("snippets"), F.max("confidence").alias("confidence"))


def settings_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings (a table of fixed size) written as one document, replaced once, and read again."""
    path = f"{Scratch(spark, 'document').base}/settings.json"
    rows = [r.asDict() for r in table(spark, sf_dir, "pipeline_config").select("config_id", "section", "enabled", "max_gap_hours").collect()]
    sinks.write_document(spark, path, {"settings": []})
    sinks.write_document(spark, path, {"settings": rows})
    item = T.StructType([T.StructField("config_id", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("enabled", T.BooleanType()), T.StructField("max_gap_hours", T.DoubleType())])
    return readers.json_array(spark, path, "settings", item)


def versioned_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated table as versions: blocked entities archived by an upsert, a failed transaction rolled back, a stored view of the result."""
    root = Scratch(spark, "versions").base
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name", "seed_status").distinct()
    kept, log = sinks.VersionedTable(spark, f"{root}/seeds"), sinks.VersionedTable(spark, f"{root}/log")
    kept.write(seeds)
    log.write(seeds.where("false"))
    kept.upsert(seeds.where("seed_status = 'blocked_seed'").withColumn("seed_status", F.lit("archived")), "entity_id", ["canonical_name"])
    try:
        with sinks.Transaction() as t:
            t.write(kept, seeds.where("false"))
            t.write(log, seeds)
            raise InterruptedError
    except InterruptedError:
        pass
    log.append(seeds.where("seed_status = 'blocked_seed'"))
    return sinks.view(spark, f"{root}/view", {"seeds": sinks.fingerprint(kept.read())}, lambda: kept.read().join(log.read().select("entity_id", F.lit(True).alias("logged")), "entity_id", "left").select("entity_id", "seed_status", F.coalesce("logged", F.lit(False)).alias("logged")))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards rendered as pages and their search index: the digest of each page beside its entry."""
    path = f"{Scratch(spark, 'site').base}/pages"
    cards = table(spark, sf_dir, "documents").where("source = 'wiki_cards' AND text IS NOT NULL").select(F.concat(F.lit("card-"), F.col("doc_id").cast("string")).alias("slug"), F.col("snippet_id").alias("title"), "text")
    index = sinks.pages(cards, path, "slug", "title", "text")
    return index.join(spark.read.parquet(path), "slug").select("slug", "name", "path", F.md5("excerpt").alias("excerpt"), F.md5("html").alias("html"))


def answered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments asked of a (deterministic) model: its first label where it gives one, else a rule's, and the message it points at by number."""
    client = models.StubClient([("Reviewer note", 'Sure:\n```json\n{"items": [{"label": "note", "ref": "1"}, {"label": "x"}]}\n```'), ("Open question", '{"items": [{"label": "question", "ref": "9999"}]}'), ("Patch", '[{"label": "patch", "ref": "2"}]')], "no idea")
    rows = table(spark, sf_dir, "conversation_segments").select("conversation_id", F.coalesce("topic_summary", F.lit("")).alias("topic_summary"), "message_ids")
    found = Scratch(spark, "answers").save(models.answers(rows, "conversation_id", "topic_summary", client, "items", ["label", "ref"]))
    labelled = models.with_fallback(rows, "conversation_id", found, "label", F.when(F.col("topic_summary").endswith("?"), "question").otherwise("statement"))
    ref = found.where("ok AND item_no = 1").select("conversation_id", "ref")
    return labelled.join(ref, "conversation_id", "left").select("conversation_id", "label", "by", models.resolved_reference(F.col("ref"), F.col("message_ids")).alias("message_id"))


def _stream(spark: SparkSession, df: DataFrame, base: str) -> DataFrame:
    df.write.parquet(f"{base}/in")
    return spark.readStream.schema(df.schema).parquet(f"{base}/in")


def _drained(out: DataFrame, base: str) -> DataFrame:
    query = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all pairs as a stream gives them: one far later message moves the watermark past the last of them."""
    base = Scratch(spark, "sessions").base
    rows = messages.said(spark, sf_dir).where("dm_pair_id IS NOT NULL AND timestamp_utc IS NOT NULL").select("dm_pair_id", "timestamp_utc")
    mark = spark.createDataFrame([("mark",)], "dm_pair_id string").withColumn("timestamp_utc", F.lit("2100-01-01 00:00:00").cast("timestamp"))
    hours = config_in_force(spark, sf_dir)["max_gap_hours"]
    out = streams.sessions(_stream(spark, rows.unionByName(mark), base), "dm_pair_id", "timestamp_utc", f"{round(hours * 3600)} seconds", "1 hour")
    return _drained(out, base).where("dm_pair_id <> 'mark'").select("dm_pair_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "event_count")


def streamed_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each pair as a stream passes them on, each once however often it was delivered."""
    base = Scratch(spark, "deliveries").base
    rows = table(spark, sf_dir, MESSAGES).where("timestamp_utc IS NOT NULL").select("dm_pair_id", "thread_id", messages.trimmed(F.col("message_id")).alias("message_id"), "timestamp_utc")
    out = streams.first_deliveries(_stream(spark, rows, base), ["thread_id", "message_id"], "timestamp_utc", "1 hour")
    return _drained(out, base).groupBy("dm_pair_id").agg(_n("messages"))


def streamed_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the two that came before them about the same target, as a stateful stream gives them."""
    base = Scratch(spark, "prior").base
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("target_entity_id", "created_at_utc", "claim_id")
    out = streams.prior_context(_stream(spark, rows, base), "target_entity_id", "created_at_utc", "claim_id", 2, "1 hour", "30 days")
    return _drained(out, base).select("claim_id", F.replace("prior", F.lit("\n"), F.lit(",")).alias("prior"))


def incremental_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims taken in two batches, the second one delivered twice: tag uses counted up, and claims worked on once."""
    root = Scratch(spark, "incremental").base
    done, counts = sinks.VersionedTable(spark, f"{root}/done"), sinks.VersionedTable(spark, f"{root}/counts")
    rows = table(spark, sf_dir, "claims").select("claim_id", "status", F.explode("thematic_tags").alias("tag"))
    first, second = rows.where("status = 'accepted'"), rows.where("status <> 'accepted' OR status IS NULL")
    counts.write(spark.createDataFrame([], "tag string, uses long"))
    streams.count_markers(first, "tag", counts, 25)
    streams.count_markers(second, "tag", counts, 25)
    done.write(first)
    for _ in range(2):
        streams.incremental(second, "claim_id", done, lambda fresh: fresh)
    worked = done.read().groupBy("tag").agg(_n("worked"))
    return counts.read().join(worked, "tag").select("tag", "uses", "active", "worked")


QUERIES = {f.__name__: f for f in [exported_pages, line_files, settings_document, versioned_seeds, site_pages, answered_segments, streamed_sessions, streamed_deliveries, streamed_prior, incremental_tags]}
_ESC = "replace(replace(replace(replace(replace(%s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
_HTML = f"'<!doctype html><title>' || {_ESC % 'snippet_id'} || '</title><h1>' || {_ESC % 'snippet_id'} || '</h1>' || coalesce(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '[^\\s\\x{{00a0}}]')), lambda p: '<p>' || {_ESC % 'p'} || '</p>'), ''), '')"
SQL = {
    "exported_pages": f"SELECT message_id, author_id, us, md5({CLEAN % 'text'}) AS text FROM {DISTINCT} WHERE us IS NOT NULL",
    "line_files": "SELECT status, count(*) AS claims, CAST(sum(coalesce(len(source_snippet_ids), 0)) AS BIGINT) AS snippets, max(confidence) AS confidence FROM claims WHERE status IS NOT NULL GROUP BY 1",
    "settings_document": "SELECT config_id, section, enabled, max_gap_hours FROM pipeline_config",
    "versioned_seeds": "SELECT DISTINCT entity_id, CASE WHEN seed_status = 'blocked_seed' THEN 'archived' ELSE seed_status END AS seed_status, coalesce(seed_status = 'blocked_seed', false) AS logged FROM entity_seed",
    "site_pages": f"SELECT 'card-' || doc_id AS slug, snippet_id AS name, 'card-' || doc_id || '.html' AS path, md5(substr(text, 1, 160)) AS excerpt, md5({_HTML}) AS html FROM documents WHERE source = 'wiki_cards' AND text IS NOT NULL",
    "answered_segments": """WITH s AS (SELECT conversation_id, message_ids, coalesce(topic_summary, '') AS t FROM conversation_segments),
      l AS (SELECT *, CASE WHEN contains(t, 'Reviewer note') THEN 'note' WHEN contains(t, 'Open question') THEN 'question' WHEN contains(t, 'Patch') THEN 'patch' END AS m FROM s)
      SELECT conversation_id, coalesce(m, CASE WHEN ends_with(t, '?') THEN 'question' ELSE 'statement' END) AS label, CASE WHEN m IS NOT NULL THEN 'model' ELSE 'heuristic' END AS by, CASE m WHEN 'note' THEN message_ids[1] WHEN 'patch' THEN message_ids[2] END AS message_id FROM l""",
    "streamed_sessions": f"""WITH f AS (SELECT dm_pair_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY dm_pair_id ORDER BY us) <= {GAP_US} THEN 0 ELSE 1 END AS opens FROM {DISTINCT} WHERE us IS NOT NULL AND dm_pair_id IS NOT NULL),
      s AS (SELECT *, sum(opens) OVER (PARTITION BY dm_pair_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM f) SELECT dm_pair_id, min(us) AS start_us, max(us) AS end_us, count(*) AS event_count FROM s GROUP BY dm_pair_id, no""",
    "streamed_deliveries": f"SELECT dm_pair_id, count(*) AS messages FROM {DISTINCT} WHERE us IS NOT NULL GROUP BY 1",
    "streamed_prior": "SELECT claim_id, coalesce(array_to_string(list(claim_id) OVER (PARTITION BY target_entity_id ORDER BY created_at_utc, claim_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS prior FROM claims WHERE target_entity_id IS NOT NULL AND created_at_utc IS NOT NULL",
    "incremental_tags": "SELECT tag, count(*) AS uses, count(*) >= 25 AS active, count(*) AS worked FROM (SELECT unnest(thematic_tags) AS tag FROM claims) GROUP BY 1",
}
