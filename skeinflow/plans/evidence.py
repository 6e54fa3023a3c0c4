"""Queries about evidence, priorities, histories and views of the curated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import columns as C
from skeinflow.operators import graph, matching, ranking, sequences, sets
from skeinflow.operators.skew import sieve
from skeinflow.plans import messages
from skeinflow.plans.messages import DISTINCT, config_in_force
from skeinflow.plans.normalising import KEY
from skeinflow.plans.relational import entity_inventory, merge_targets, relationship_edges
from skeinflow.plans.relational_sql import SQL as _OTHERS
from skeinflow.runtime import table


def _n(name: str):
    return F.count(F.lit(1)).alias(name)


def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted score of each segment from its anchors, size, label and track; without any anchor or label capped."""
    # The weights of the score.
    anchors = F.size(F.coalesce("anchor_entities", F.array().cast("array<string>")))
    signal = (anchors > 0) | F.col("topic_label").isNotNull()
    total = F.lit(0.34) * (anchors > 0).cast("int") + F.least(F.lit(0.36), F.lit(0.12) * anchors) + F.lit(0.12) * F.col("topic_label").isNotNull().cast("int") + F.lit(0.1) * (F.col("message_count") >= 8).cast("int") - F.lit(0.16) * F.coalesce((F.col("track") == "meta").cast("int"), F.lit(0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return table(spark, sf_dir, "conversation_segments").select("conversation_id", F.round(F.when(signal, score).otherwise(F.least(score, F.lit(0.18))), 4).alias("score"))


def tag_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How strongly a tag belongs to a target: by number of claims and mean confidence, between 0 and 1."""
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("target_entity_id", "confidence", F.explode("thematic_tags").alias("tag"))
    by = rows.groupBy("target_entity_id", "tag").agg(_n("n"), F.avg("confidence").alias("c"))
    strength = F.least(F.lit(1.0), F.lit(0.35) + F.least(F.lit(0.35), F.lit(0.08) * F.col("n")) + F.lit(0.15) * F.coalesce("c", F.lit(0.0)))
    return by.select("target_entity_id", "tag", F.round(strength, 6).alias("strength"))


def confident_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities still linked when pairs of low confidence are taken out."""
    return graph.reachable_minimum(table(spark, sf_dir, "identity_merges").where("confidence >= 0.7"), "source_entity_id", "target_entity_id")


def canonical_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of each component that most pairs name; then the one of the longer name, then of the smaller id."""
    merges = table(spark, sf_dir, "identity_merges")
    groups = graph.reachable_minimum(merges, "source_entity_id", "target_entity_id")
    ends = merges.where("source_entity_id <> target_entity_id").select("source_entity_id", "target_entity_id").distinct()
    degree = ends.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("vertex")).where("vertex IS NOT NULL").groupBy("vertex").agg(_n("pairs"))
    names = table(spark, sf_dir, "entity_seed").groupBy(F.col("entity_id").alias("vertex")).agg(F.max(F.length("canonical_name")).alias("size"))
    rows = groups.join(degree, "vertex").join(names, "vertex", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    best = ranking.best_row(rows, ["component"], F.struct((-F.col("pairs")).alias("p"), (-F.col("size")).alias("s"), "vertex"), smallest=True)
    return best.select("component", F.col("vertex").alias("canonical"), "pairs")


def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest claims of each target."""
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("target_entity_id", "claim_id", F.unix_micros("created_at_utc").alias("us"))
    return ranking.top_per_key(rows, ["target_entity_id"], [F.desc_nulls_last("us"), F.col("claim_id")], 3).select("target_entity_id", "claim_id", F.col("rank").cast("long").alias("rank"))


def entity_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entities want review first: evidence, rejected claims, relationships and claims, weighed; the 100 first."""
    none = F.array().cast("array<string>")
    by = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").groupBy(F.col("target_entity_id").alias("entity_id")).agg(_n("claims"), F.sum(F.size(F.coalesce("source_snippet_ids", none))).alias("evidence"), F.sum(F.coalesce((F.col("status") == "rejected").cast("long"), F.lit(0))).alias("rejected"))
    edges = relationship_edges(spark, sf_dir).groupBy("entity_id").agg(_n("edges"))
    score = F.col("evidence") + 6 * F.col("rejected") + 3 * F.coalesce("edges", F.lit(0)) + F.col("claims")
    return by.join(edges, "entity_id", "left").select("entity_id", score.cast("long").alias("priority")).orderBy(F.desc("priority"), "entity_id").limit(100)


def quoted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted phrases of claims and whether one of the cited texts has them, letter case ignored.

    Phrases go to the documents: only texts that are cited by a claim with a quotation leave their task.
    """
    rows = table(spark, sf_dir, "claims").where(F.contains("claim_text", F.lit('"')))
    phrases = rows.select("claim_id", "source_snippet_ids", F.explode(F.array_distinct(F.regexp_extract_all("claim_text", F.lit('"([^"]+)"'), 1))).alias("phrase"))
    asked = phrases.select("claim_id", "phrase", F.explode_outer("source_snippet_ids").alias("snippet_id"))
    wanted = sieve(asked, "snippet_id")
    texts = table(spark, sf_dir, "documents").where(wanted(F.col("snippet_id"))).select("snippet_id", F.lower("text").alias("text"))
    cited = asked.join(texts, "snippet_id", "left")
    return cited.groupBy("claim_id", "phrase").agg(F.coalesce(F.bool_or(F.contains("text", F.lower("phrase"))), F.lit(False)).alias("supported"))


def distinct_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the same messages, whatever their order, once: the one of the smallest id."""
    ids = F.sha2(F.array_join(F.array_sort("message_ids"), ","), 256)
    return table(spark, sf_dir, "conversation_segments").groupBy(ids.alias("ids")).agg(F.min("conversation_id").alias("conversation_id"), _n("copies")).select("conversation_id", "copies")


def running_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of names as their candidates come in: each adds to what its number so far allows; the largest counts."""
    rows = table(spark, sf_dir, "entity_candidates").select(C.name_key(F.col("candidate_name")).alias("key"), F.unix_micros("first_seen_timestamp_utc").alias("us"), "candidate_id", "confidence").where("key <> ''")
    placed = ranking.numbered_per_key(rows, "key", ["us", "candidate_id"], "n")
    value = F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)) + F.least(F.lit(0.2), F.lit(0.03) * F.col("n")))
    return placed.groupBy("key").agg(F.round(F.max(value), 4).alias("confidence"), F.max("n").alias("candidates"))


def owner_before_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner's last message in the pair at or before each segment's start."""
    owner = config_in_force(spark, sf_dir)["self_user_id"]
    by_owner = messages.said(spark, sf_dir).where((F.col("author_id") == owner) & F.col("us").isNotNull()).select("dm_pair_id", "us", "message_id")
    points = table(spark, sf_dir, "conversation_segments").select("conversation_id", "dm_pair_id", F.unix_micros("timestamp_start_utc").alias("us"))
    return sequences.last_before(points, by_owner, "dm_pair_id", "us", "message_id", "owner_message").select("conversation_id", "owner_message")


def inventory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the inventory: one bucket, by documents and id, the first 50."""
    return entity_inventory(spark, sf_dir).where("bucket = 'ready'").orderBy(F.desc("documents"), "entity_id").limit(50).select("entity_id", "entity_type", "documents")


def visible_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 strongest edges, and how many of them each of their nodes has."""
    edges = relationship_edges(spark, sf_dir).orderBy(F.desc("evidence"), "entity_id", "target", "relation").limit(50)
    return edges.select(F.explode(F.array("entity_id", "target")).alias("node")).groupBy("node").agg(_n("edges"))


def claims_of_kept_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose target isn't a blocked entity, neither by id nor by name."""
    blocked = table(spark, sf_dir, "entity_seed").where("seed_status = 'blocked_seed'").select(F.col("entity_id").alias("target_entity_id"), C.name_key(F.col("canonical_name")).alias("key")).distinct()
    rows = table(spark, sf_dir, "claims").select("claim_id", "target_entity_id", C.name_key(F.col("target_entity_name")).alias("key"))
    return sets.pending(sets.pending(rows, "target_entity_id", blocked), "key", blocked).select("claim_id")


def merged_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their target replaced by the entity that it was merged into in the end."""
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("claim_id", "target_entity_id")
    return sets.remapped(rows, "target_entity_id", merge_targets(spark, sf_dir), "source_entity_id", "final")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text would link to each entity: longest names first, each entity once."""
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name").distinct()
    return matching.first_links(table(spark, sf_dir, "documents"), "doc_id", "text", seeds, "entity_id", "canonical_name")


QUERIES = {
    f.__name__: f
    for f in [segment_scores, tag_strengths, confident_components, canonical_members, recent_history, entity_priorities, quoted_evidence, distinct_segments, running_confidence, owner_before_segment, inventory_page, visible_graph, claims_of_kept_entities, merged_claims, page_links]
}
_REACH = "r AS (SELECT a AS v, least(a, b) AS low FROM d UNION SELECT d.b, r.low FROM r JOIN d ON d.a = r.v)"
_OWNER = "(SELECT self_user_id FROM pipeline_config WHERE enabled AND section = 'conversation_segmentation' ORDER BY config_id LIMIT 1)"
_NAMED = f"(SELECT name, min(entity_id) AS entity_id FROM (SELECT entity_id, {KEY % 'canonical_name'} AS name FROM entity_seed) WHERE name <> '' GROUP BY 1)"
SQL = {
    "page_links": f"""WITH RECURSIVE n AS {_NAMED}, w AS (SELECT doc_id, string_split({KEY % 'text'}, ' ') AS words FROM documents WHERE text IS NOT NULL), z AS (SELECT DISTINCT len(string_split(name, ' ')) AS size FROM n),
      g AS (SELECT doc_id, i - 1 AS p, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS name FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, z WHERE len(words) >= size)),
      s AS (SELECT doc_id, p, size, entity_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, size DESC) AS k FROM g JOIN n USING (name)),
      f AS (SELECT doc_id, k, p, size, entity_id, p + size AS upto, true AS taken FROM s WHERE k = 1 UNION ALL SELECT s.doc_id, s.k, s.p, s.size, s.entity_id, CASE WHEN s.p < f.upto THEN f.upto ELSE s.p + s.size END, s.p >= f.upto FROM f JOIN s ON s.doc_id = f.doc_id AND s.k = f.k + 1)
      SELECT doc_id, entity_id, CAST(min(p) AS BIGINT) AS word_no, CAST(arg_min(size, (p, -size)) AS BIGINT) AS words FROM f WHERE taken GROUP BY 1, 2""",
    "segment_scores": """WITH s AS (SELECT conversation_id, coalesce(len(anchor_entities), 0) AS a, topic_label IS NOT NULL AS t, message_count >= 8 AS m, coalesce(track = 'meta', false) AS k FROM conversation_segments),
      p AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.34::DOUBLE * (a > 0)::INT + least(0.36::DOUBLE, 0.12::DOUBLE * a) + 0.12::DOUBLE * t::INT + 0.1::DOUBLE * m::INT - 0.16::DOUBLE * k::INT)) AS s FROM s)
      SELECT conversation_id, round(CASE WHEN a > 0 OR t THEN s ELSE least(s, 0.18::DOUBLE) END, 4) AS score FROM p""",
    "tag_strengths": """SELECT target_entity_id, tag, round(least(1.0::DOUBLE, 0.35::DOUBLE + least(0.35::DOUBLE, 0.08::DOUBLE * count(*)) + 0.15::DOUBLE * coalesce(avg(confidence), 0)), 6) AS strength
      FROM (SELECT target_entity_id, confidence, unnest(thematic_tags) AS tag FROM claims WHERE target_entity_id IS NOT NULL) GROUP BY 1, 2""",
    "confident_components": f"WITH RECURSIVE p AS (SELECT source_entity_id AS a, target_entity_id AS b FROM identity_merges WHERE source_entity_id <> target_entity_id AND confidence >= 0.7), d AS (SELECT a, b FROM p UNION SELECT b, a FROM p), {_REACH} SELECT v AS vertex, min(low) AS component FROM r GROUP BY 1",
    "canonical_members": f"""WITH RECURSIVE p AS (SELECT DISTINCT source_entity_id AS a, target_entity_id AS b FROM identity_merges WHERE source_entity_id <> target_entity_id), d AS (SELECT a, b FROM p UNION SELECT b, a FROM p), {_REACH},
      g AS (SELECT v, min(low) AS component FROM r GROUP BY 1), k AS (SELECT v, count(*) AS pairs FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p) GROUP BY 1), n AS (SELECT entity_id, max(length(canonical_name)) AS size FROM entity_seed GROUP BY 1)
      SELECT component, v AS canonical, pairs FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY pairs DESC, coalesce(size, 0) DESC, v) AS rn FROM g JOIN k USING (v) LEFT JOIN n ON n.entity_id = v) WHERE rn = 1""",
    "recent_history": "SELECT target_entity_id, claim_id, rank FROM (SELECT target_entity_id, claim_id, row_number() OVER (PARTITION BY target_entity_id ORDER BY created_at_utc DESC NULLS LAST, claim_id) AS rank FROM claims WHERE target_entity_id IS NOT NULL) WHERE rank <= 3",
    "entity_priorities": f"""WITH c AS (SELECT target_entity_id AS entity_id, count(*) AS claims, sum(coalesce(len(source_snippet_ids), 0)) AS evidence, count(*) FILTER (status = 'rejected') AS rejected FROM claims WHERE target_entity_id IS NOT NULL GROUP BY 1),
      e AS (SELECT entity_id, count(*) AS edges FROM ({_OTHERS['relationship_edges']}) GROUP BY 1) SELECT entity_id, CAST(evidence + 6 * rejected + 3 * coalesce(edges, 0) + claims AS BIGINT) AS priority FROM c LEFT JOIN e USING (entity_id) ORDER BY 2 DESC, 1 LIMIT 100""",
    "quoted_evidence": """WITH p AS (SELECT claim_id, source_snippet_ids, unnest(list_distinct(regexp_extract_all(claim_text, '"([^"]+)"', 1))) AS phrase FROM claims WHERE contains(claim_text, '"')),
      s AS (SELECT claim_id, phrase, unnest(source_snippet_ids) AS snippet_id FROM p)
      SELECT p.claim_id, p.phrase, coalesce(bool_or(contains(lower(d.text), lower(p.phrase))), false) AS supported FROM p LEFT JOIN s ON s.claim_id = p.claim_id AND s.phrase = p.phrase LEFT JOIN documents d ON d.snippet_id = s.snippet_id GROUP BY 1, 2""",
    "distinct_segments": "SELECT min(conversation_id) AS conversation_id, count(*) AS copies FROM conversation_segments GROUP BY array_to_string(list_sort(message_ids), ',')",
    "running_confidence": f"""WITH k AS (SELECT {KEY % 'candidate_name'} AS key, confidence, row_number() OVER (PARTITION BY {KEY % 'candidate_name'} ORDER BY first_seen_timestamp_utc NULLS FIRST, candidate_id) AS n FROM entity_candidates)
      SELECT key, round(max(least(1.0::DOUBLE, coalesce(confidence, 0) + least(0.2::DOUBLE, 0.03::DOUBLE * n))), 4) AS confidence, max(n) AS candidates FROM k WHERE key <> '' GROUP BY 1""",
    "owner_before_segment": f"""WITH o AS (SELECT dm_pair_id, us, max(message_id) AS m FROM {DISTINCT} WHERE author_id = {_OWNER} AND us IS NOT NULL GROUP BY 1, 2),
      s AS (SELECT conversation_id, dm_pair_id, epoch_us(timestamp_start_utc) AS us FROM conversation_segments)
      SELECT conversation_id, m AS owner_message FROM s LEFT JOIN (SELECT s.conversation_id AS c, max_by(o.m, o.us) AS m FROM s JOIN o ON o.dm_pair_id = s.dm_pair_id AND o.us <= s.us GROUP BY 1) ON c = conversation_id""",
    "merged_claims": f"""{_OTHERS['merge_targets'].replace('SELECT s AS source_entity_id', ', t AS (SELECT s AS source_entity_id', 1)}) SELECT claim_id, coalesce(t.final, target_entity_id) AS target_entity_id, target_entity_id AS original_target_entity_id
      FROM claims LEFT JOIN t ON t.source_entity_id = target_entity_id WHERE target_entity_id IS NOT NULL""",
    "inventory_page": f"SELECT entity_id, entity_type, documents FROM ({_OTHERS['entity_inventory']}) WHERE bucket = 'ready' ORDER BY documents DESC, entity_id LIMIT 50",
    "visible_graph": f"WITH e AS (SELECT * FROM ({_OTHERS['relationship_edges']}) ORDER BY evidence DESC, entity_id, target, relation NULLS FIRST LIMIT 50) SELECT node, count(*) AS edges FROM (SELECT entity_id AS node FROM e UNION ALL SELECT target FROM e) GROUP BY 1",
    "claims_of_kept_entities": f"""WITH b AS (SELECT entity_id, {KEY % 'canonical_name'} AS key FROM entity_seed WHERE seed_status = 'blocked_seed')
      SELECT claim_id FROM claims WHERE coalesce(target_entity_id NOT IN (SELECT entity_id FROM b), true) AND coalesce({KEY % 'target_entity_name'} NOT IN (SELECT key FROM b WHERE key IS NOT NULL), true)""",
}
