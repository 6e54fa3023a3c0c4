"""Queries over texts and names: keys, ids, flags, sentences, features, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import columns as C
from skeinflow.operators import scoring
from skeinflow.plans.messages import MESSAGES
from skeinflow.runtime import table

#: Word lists are inputs of the operators; these are the ones the queries below use.
STORY_WORDS = ["chapter", "canon", "chronicle", "edict", "oath", "grudge"]
WORK_WORDS = ["patch", "draft", "backlog", "playtest", "shader", "typos"]
_QSQL = "'[ \\t\\n\\r\\f\\x0B\\x1c-\\x1f\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'"
CLEAN = f"trim(regexp_replace(replace(%s, chr(0), ''), {_QSQL}, ' ', 'g'))"
KEY = "trim(regexp_replace(lower(%s), '[^a-z0-9]+', ' ', 'g'))"


def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = C.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("clean_chars"), F.md5(text).alias("clean_md5"), C.word_count(F.col("text")).alias("words"))


def claim_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("target_entity_name")
    return table(spark, sf_dir, "claims").select("claim_id", C.name_key(name).alias("name_key"), C.slug(name).alias("slug"), C.stable_id("claim", name, F.col("claim_text")).alias("content_id"), C.clamp01(F.col("confidence"), 0.5).alias("confidence"))


def claim_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = C.one_of(F.col("claim_type"), ["role", "relationship", "background", "timeline", "alias"], "term", {"inspiration": "background"})
    return table(spark, sf_dir, "claims").groupBy(kind.alias("kind"), "status").agg(F.count(F.lit(1)).alias("claims"))


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    found = C.flags(non_ascii=t.rlike(r"[^\x00-\x7F]"), shouting=(F.upper(t) == t) & t.rlike("[A-Z]{4}"), markdown=t.rlike(r"(^|\n)#"), empty=F.trim(t) == "")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("flags"))


def sentence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = C.sentences(F.col("text"))
    longest = F.array_max(F.transform(parts, lambda s: F.length(s)))
    asked = F.size(F.filter(parts, lambda s: s.endswith("?")))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(parts).cast("long").alias("sentences"), F.coalesce(longest, F.lit(0)).cast("long").alias("longest"), asked.cast("long").alias("questions"))


def regex_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.regexp_count(t, F.lit("[0-9]+")).cast("long").alias("numbers"),
        F.regexp_count(F.lower(t), F.lit("chapter [0-9]+")).cast("long").alias("chapters"),
        F.nullif(F.regexp_extract(t, r"(^|[^A-Za-z])[Cc]hapter ([0-9]{1,4})", 2), F.lit("")).try_cast("long").alias("first_chapter"),
        F.regexp_count(t, F.lit(r"(^|\n)- ")).cast("long").alias("bullets"),
    )


def keyword_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    hits = {"story": scoring.keyword_hits(t, STORY_WORDS), "work": scoring.keyword_hits(t, WORK_WORDS)}
    score = scoring.weighted_score(hits, {"story": 0.24, "work": 0.12})
    return table(spark, sf_dir, "documents").select("doc_id", hits["story"].cast("long").alias("story"), hits["work"].cast("long").alias("work"), score.alias("score")).withColumn("route", scoring.route(F.col("score"), 0.6))


def relevance_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_routes(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "route").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 4).alias("mean_score"))


def heading_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of card-like texts, each once, with the number of texts that have it."""
    heads = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"(?:^|\n)# ([^\n]+)"), 1)
    return table(spark, sf_dir, "documents").select(F.explode(heads).alias("heading")).withColumn("heading", F.trim("heading")).groupBy("heading").agg(F.count(F.lit(1)).alias("texts"))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = C.clean_text(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", F.coalesce("source", F.lit("none")), "snippet_id").alias("path"), C.slug(F.coalesce("knowledge_track", F.lit("none"))).alias("kind"), F.substring(text, 1, 80).alias("excerpt"))


def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the searched words in their name or one of their aliases."""
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name", "entity_type", "aliases").distinct()
    blob = C.name_key(F.concat_ws(" ", F.array(F.col("canonical_name")), F.coalesce("aliases", F.array().cast("array<string>"))))
    return seeds.where(F.contains(blob, F.lit("observ"))).select("entity_id", "canonical_name", "entity_type", F.size(F.coalesce("aliases", F.array().cast("array<string>"))).cast("long").alias("aliases"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties of events as columns, counted."""
    props = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"), "value")
    return props.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))


def message_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, MESSAGES)
    return rows.select(F.explode_outer("sensitivity_flags").alias("flag"), "dm_pair_id").groupBy("flag").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("dm_pair_id").alias("pairs"))


def bot_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of bots and applications by which of four signs tells."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    some = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    sign = C.first_reason(("bot", on("author_is_bot")), ("application", some("application_id")), ("webhook", some("webhook_id")), ("marked", on("is_bot_or_application")))
    return table(spark, sf_dir, MESSAGES).groupBy(F.coalesce(sign, F.lit("person")).alias("sign")).agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {
    f.__name__: f
    for f in [normalised_texts, claim_keys, claim_types, text_flags, sentence_statistics, regex_features, keyword_routes, relevance_by_source, heading_seeds, search_index, entity_search, event_properties, message_sensitivity, bot_messages]
}


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{w}') AS INT)" for w in words)


_ROUTES = f"""WITH h AS (SELECT doc_id, source, CAST({_hits(STORY_WORDS)} AS BIGINT) AS story, CAST({_hits(WORK_WORDS)} AS BIGINT) AS work FROM documents),
r AS (SELECT *, round(least(1.0, CAST(0.24 AS DOUBLE) * story + CAST(0.12 AS DOUBLE) * work), 6) AS score FROM h),
k AS (SELECT *, CASE WHEN score >= 0.6 THEN 'accept' WHEN score >= 0.4 THEN 'review' ELSE 'drop' END AS route FROM r) """
_SENT = "list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
SQL = {
    "normalised_texts": f"SELECT doc_id, length({CLEAN % 'text'}) AS clean_chars, md5({CLEAN % 'text'}) AS clean_md5, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_][''\\-A-Za-z0-9_]*')), 0) AS words FROM documents",
    "claim_keys": f"""SELECT claim_id, {KEY % 'target_entity_name'} AS name_key, replace({KEY % 'target_entity_name'}, ' ', '-') AS slug,
      'claim_' || substr(sha256(coalesce(target_entity_name, '') || coalesce(claim_text, '')), 1, 16) AS content_id, greatest(0.0, least(1.0, coalesce(confidence, 0.5))) AS confidence FROM claims""",
    "claim_types": """SELECT CASE WHEN k IN ('role', 'relationship', 'background', 'timeline', 'alias') THEN k ELSE 'term' END AS kind, status, count(*) AS claims
      FROM (SELECT CASE WHEN lower(trim(claim_type)) = 'inspiration' THEN 'background' ELSE lower(trim(claim_type)) END AS k, status FROM claims) GROUP BY 1, 2""",
    "text_flags": """SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'non_ascii' END, CASE WHEN upper(text) = text AND regexp_matches(text, '[A-Z]{4}') THEN 'shouting' END,
      CASE WHEN regexp_matches(text, '(^|\\n)#') THEN 'markdown' END, CASE WHEN trim(text) = '' THEN 'empty' END) AS flags FROM documents""",
    "sentence_statistics": f"SELECT doc_id, CAST(len({_SENT}) AS BIGINT) AS sentences, coalesce(list_max(list_transform({_SENT}, lambda s: length(s))), 0) AS longest, CAST(len(list_filter({_SENT}, lambda s: ends_with(s, '?'))) AS BIGINT) AS questions FROM documents WHERE text IS NOT NULL",
    "regex_features": """SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS BIGINT) AS numbers, CAST(len(regexp_extract_all(lower(coalesce(text, '')), 'chapter [0-9]+')) AS BIGINT) AS chapters,
      TRY_CAST(nullif(regexp_extract(coalesce(text, ''), '(^|[^A-Za-z])[Cc]hapter ([0-9]{1,4})', 2), '') AS BIGINT) AS first_chapter, CAST(len(regexp_extract_all(coalesce(text, ''), '(^|\\n)- ')) AS BIGINT) AS bullets FROM documents""",
    "keyword_routes": _ROUTES + "SELECT doc_id, story, work, score, route FROM k",
    "relevance_by_source": _ROUTES + "SELECT source, route, count(*) AS documents, round(avg(score), 4) AS mean_score FROM k GROUP BY 1, 2",
    "heading_seeds": "SELECT trim(h) AS heading, count(*) AS texts FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '(?:^|\\n)# ([^\\n]+)', 1)) AS h FROM documents) GROUP BY 1",
    "search_index": f"SELECT coalesce(source, 'none') || '/' || snippet_id AS path, replace({KEY % "coalesce(knowledge_track, 'none')"}, ' ', '-') AS kind, substr({CLEAN % "coalesce(text, '')"}, 1, 80) AS excerpt FROM documents",
    "entity_search": f"""SELECT DISTINCT entity_id, canonical_name, entity_type, coalesce(len(aliases), 0) AS aliases FROM entity_seed
      WHERE contains({KEY % "concat_ws(' ', canonical_name, array_to_string(aliases, ' '))"}, 'observ')""",
    "event_properties": "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "message_sensitivity": f"""SELECT flag, count(*) AS rows, count(DISTINCT dm_pair_id) AS pairs FROM (
      SELECT unnest(CASE WHEN sensitivity_flags IS NULL OR len(sensitivity_flags) = 0 THEN [NULL] ELSE sensitivity_flags END) AS flag, dm_pair_id FROM {MESSAGES}) GROUP BY 1""",
    "bot_messages": f"""SELECT CASE WHEN author_is_bot THEN 'bot' WHEN trim(application_id) <> '' THEN 'application' WHEN trim(webhook_id) <> '' THEN 'webhook' WHEN is_bot_or_application THEN 'marked' ELSE 'person' END AS sign,
      count(*) AS rows FROM {MESSAGES} GROUP BY 1""",
}
