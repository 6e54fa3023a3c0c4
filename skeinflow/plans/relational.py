"""Queries that join, aggregate, rank and diff the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import columns as C
from skeinflow.operators import graph, matching, ranking, scoring, sequences, sets
from skeinflow.operators.sessions import session_numbers
from skeinflow.operators.skew import lookup_join
from skeinflow.plans import messages
from skeinflow.plans.messages import MESSAGES, config_in_force
from skeinflow.plans.relational_sql import SQL  # noqa: F401
from skeinflow.runtime import table


def _n(name: str):
    return F.count(F.lit(1)).alias(name)


def timeline_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters over all rows, those included that a cutoff later removes."""
    cutoff = F.col("timestamp_utc") >= F.lit("2024-07-01 00:00:00").cast("timestamp")
    rows = table(spark, sf_dir, MESSAGES)
    return rows.agg(
        _n("rows"), F.sum(F.coalesce(cutoff, F.lit(False)).cast("long")).alias("kept"), F.sum(F.col("timestamp_utc").isNull().cast("long")).alias("untimed"),
        F.min(F.unix_micros("timestamp_utc")).alias("first_us"), F.max(F.unix_micros("timestamp_utc")).alias("last_us"),
    )


def timeline_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros("timestamp_utc")
    return table(spark, sf_dir, MESSAGES).groupBy("thread_id").agg(_n("rows"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), F.countDistinct("author_id").alias("authors"))


def batch_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export batches with a message after the cutoff, by their latest message."""
    late = F.col("timestamp_utc") >= F.lit("2024-07-01 00:00:00").cast("timestamp")
    by = table(spark, sf_dir, MESSAGES).groupBy(F.col("provenance.export_batch").alias("batch")).agg(F.max(F.unix_micros("timestamp_utc")).alias("last_us"), F.bool_or(late).alias("wanted"), _n("rows"))
    return by.where("wanted").select("batch", "last_us", "rows")


def global_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "conversation_segments").select("conversation_id", F.unix_micros("timestamp_start_utc").alias("start_us"))
    return ranking.numbered(segments, ["start_us", "conversation_id"])


def account_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person who wrote in most threads, then most rows, then of the largest id; bots only if there is no one else."""
    by = table(spark, sf_dir, MESSAGES).where("author_id IS NOT NULL").groupBy("author_id").agg(F.countDistinct("thread_id").alias("threads"), _n("rows"), F.bool_and(F.coalesce("is_bot_or_application", F.lit(False))).alias("bot"))
    return by.orderBy("bot", F.desc("threads"), F.desc("rows"), F.desc("author_id")).limit(1).select("author_id", "threads", "rows")


def last_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, MESSAGES).where("author_id IS NOT NULL AND author_name IS NOT NULL")
    return rows.groupBy("author_id").agg(F.max_by("author_name", F.struct("timestamp_utc", "author_name")).alias("label"))


def conversation_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent author of each conversation who isn't the owner; ties to the smallest id."""
    owner = config_in_force(spark, sf_dir)["self_user_id"]
    rows = table(spark, sf_dir, MESSAGES).where(F.col("conversation_id").isNotNull() & F.col("author_id").isNotNull() & (F.col("author_id") != owner))
    counted = rows.groupBy("conversation_id", "author_id").agg(_n("rows"))
    return ranking.best_row(counted, ["conversation_id"], F.struct((-F.col("rows")).alias("n"), "author_id"), smallest=True)


def thread_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each pair by whether their own partner agrees with the thread's."""
    rows = table(spark, sf_dir, MESSAGES)
    known = rows.where("partner_id IS NOT NULL AND partner_id <> 'unknown'").groupBy("thread_id").agg(F.min("partner_id").alias("thread_partner"))
    joined = lookup_join(rows, known, "thread_id", "left")
    state = F.when(F.col("thread_partner").isNull(), "none").when(F.col("partner_id").eqNullSafe(F.col("thread_partner")), "same").otherwise("filled")
    return joined.groupBy("dm_pair_id", state.alias("partner")).agg(_n("rows"))


def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's messages in order, with what the segment says about them; an id listed twice counts once."""
    listed = table(spark, sf_dir, "conversation_segments").select("conversation_id", "track", "topic_label", F.explode(F.array_distinct("message_ids")).alias("message_id"))
    found = listed.join(messages.said(spark, sf_dir).where("conversation_id IS NOT NULL"), ["conversation_id", "message_id"])
    placed = ranking.numbered_per_key(found.select("conversation_id", "track", "topic_label", "thread_id", "message_id", "us", "copies"), "conversation_id", ["us", "message_id", "thread_id"], "place")
    return placed.select("conversation_id", "track", "topic_label", "thread_id", "message_id", "copies", "place")


def segment_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its listed messages each segment has, and how often they were delivered."""
    listed = table(spark, sf_dir, "conversation_segments").select("conversation_id", F.explode("message_ids").alias("message_id")).distinct()
    delivered = messages.said(spark, sf_dir).select("conversation_id", "message_id", "copies")
    return listed.join(delivered, ["conversation_id", "message_id"]).groupBy("conversation_id").agg(_n("found"), F.sum("copies").alias("deliveries"))


def unsegmented_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, MESSAGES).where("conversation_id IS NOT NULL")
    return sets.pending(rows.groupBy("conversation_id").agg(_n("rows")), "conversation_id", table(spark, sf_dir, "conversation_segments"))


def segment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries by how near (within three hours) their pair's nearest segment is."""
    points = table(spark, sf_dir, MESSAGES).where("timestamp_utc IS NOT NULL AND dm_pair_id IS NOT NULL").groupBy("dm_pair_id", F.unix_seconds("timestamp_utc").alias("at")).agg(_n("rows"))
    spans = table(spark, sf_dir, "conversation_segments").where("dm_pair_id IS NOT NULL AND timestamp_end_utc >= timestamp_start_utc").select("dm_pair_id", F.unix_seconds("timestamp_start_utc").alias("s"), F.unix_seconds("timestamp_end_utc").alias("e"))
    near = matching.nearest_interval(points, spans, "dm_pair_id", "at", "s", "e", 3 * 3600)
    kind = F.when(F.col("distance") == 0, "inside").when(F.col("distance").isNotNull(), "near").otherwise("far")
    return near.groupBy("dm_pair_id", kind.alias("kind")).agg(F.sum("rows").alias("rows"))


def claim_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by what resolves their target: id, name, alias of one entity alone, or nothing."""
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name", "aliases").distinct()
    ids = seeds.select(F.col("entity_id").alias("key"), F.col("entity_id").alias("value")).distinct()
    names = seeds.groupBy(C.name_key(F.col("canonical_name")).alias("key")).agg(F.min("entity_id").alias("value"))
    alias = seeds.select("entity_id", F.explode("aliases").alias("a")).groupBy(C.name_key(F.col("a")).alias("key")).agg(F.min("entity_id").alias("value"), F.max("entity_id").alias("high")).where("value = high AND key <> ''").drop("high")
    key = C.name_key(F.col("target_entity_name"))
    out = matching.resolve(table(spark, sf_dir, "claims").select("claim_id", "target_entity_id", "target_entity_name"), [("id", F.col("target_entity_id")), ("name", key), ("alias", key)], [ids, names, alias], "entity")
    return out.select("claim_id", "entity", "entity_by")


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each entity's name stands in each text, word for word."""
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name").distinct()
    return matching.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", seeds, "entity_id", "canonical_name")


def claim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims grouped by track and target, with their sorted tags and number of snippets."""
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("thematic_tags", F.array().cast("array<string>"))))))
    rows = table(spark, sf_dir, "claims").where("target_entity_name IS NOT NULL")
    grouped = rows.groupBy("knowledge_track", C.name_key(F.col("target_entity_name")).alias("target")).agg(_n("claims"), F.array_join(tags, ",").alias("tags"), F.sum(F.size(F.coalesce("source_snippet_ids", F.array().cast("array<string>")))).cast("long").alias("snippets"))
    return grouped


def snippet_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how many claims and candidates cite them."""
    cites = lambda t, k: table(spark, sf_dir, t).select(F.explode("source_snippet_ids").alias("snippet_id")).groupBy("snippet_id").agg(_n(k))
    docs = table(spark, sf_dir, "documents").select("doc_id", "snippet_id", "source")
    joined = docs.join(cites("claims", "claims"), "snippet_id", "left").join(cites("entity_candidates", "candidates"), "snippet_id", "left")
    return joined.select("doc_id", F.coalesce("claims", F.lit(0)).cast("long").alias("claims"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"))


def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cooccurrence(table(spark, sf_dir, "claims"), "thematic_tags")


def type_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity type that candidates of one name vote for, against the curated one."""
    seeds = table(spark, sf_dir, "entity_seed").groupBy(C.name_key(F.col("canonical_name")).alias("key")).agg(F.min("entity_type").alias("current"))
    votes = table(spark, sf_dir, "entity_candidates").select(C.name_key(F.col("candidate_name")).alias("key"), F.col("proposed_entity_type").alias("type"), F.round(F.coalesce("confidence", F.lit(0.5)), 3).alias("weight")).where("key <> ''")
    return scoring.vote(votes.join(seeds, "key", "left"), "key", "type", "weight", "current")


def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that at least two candidates have, with the evidence they add up to."""
    rows = table(spark, sf_dir, "entity_candidates").withColumn("key", C.name_key(F.col("candidate_name"))).where("key <> ''")
    return rows.groupBy("key").agg(_n("candidates"), F.sum(F.col("evidence_count").cast("long")).alias("evidence"), F.min(F.unix_micros("first_seen_timestamp_utc")).alias("first_us"), F.max("confidence").alias("confidence")).where("candidates >= 2")


def candidate_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "entity_candidates").select("candidate_id", "last_seen_timestamp_utc", F.col("evidence_count").cast("long").alias("evidence"))
    weighed = sequences.recency_weight(rows, "last_seen_timestamp_utc", [(14, 1.5), (45, 1.35)])
    return weighed.select("candidate_id", "recency", F.round(F.col("evidence") * F.col("recency"), 4).alias("adjusted"))


def candidate_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = C.name_key(F.col("candidate_name"))
    reason = C.first_reason(("unnamed", F.coalesce(key == "", F.lit(True))), ("long", F.size(F.split(key, " ")) > 12), ("digits", ~key.rlike("[a-z]")), ("weak", F.coalesce("confidence", F.lit(0.0)) < 0.35), ("single", F.col("evidence_count") <= 1))
    return table(spark, sf_dir, "entity_candidates").select("candidate_id", F.coalesce(reason, F.lit("review")).alias("bucket"))


def latest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest claim of each target."""
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("target_entity_id", "claim_id", "status", F.unix_micros("created_at_utc").alias("us"))
    return ranking.best_row(rows, ["target_entity_id"], F.struct("us", "claim_id"))


def undecided_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open claims that no accepted identity pair cites."""
    cited = table(spark, sf_dir, "identity_merges").select(F.explode("evidence_claim_ids").alias("claim_id"))
    return sets.pending(table(spark, sf_dir, "claims").where("status IN ('draft', 'needs_more_context')").select("claim_id", "status"), "claim_id", cited)


def targets_with_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "entity_seed").select(F.col("entity_id").alias("target_entity_id")).distinct()
    return table(spark, sf_dir, "claims").join(seeds, "target_entity_id", "left_semi").groupBy("claim_type").agg(_n("claims"), F.countDistinct("target_entity_id").alias("targets"))


def entity_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated entities with counts from three other tables and a display bucket."""
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name", "entity_type", "seed_status").distinct()
    claims = table(spark, sf_dir, "claims").groupBy(F.col("target_entity_id").alias("entity_id")).agg(_n("claims"), F.sum((F.col("status") == "accepted").cast("long")).alias("accepted"))
    docs = table(spark, sf_dir, "documents").groupBy("entity_id").agg(_n("documents"))
    found = table(spark, sf_dir, "entity_candidates").groupBy(C.name_key(F.col("candidate_name")).alias("key")).agg(_n("candidates"))
    joined = seeds.join(claims, "entity_id", "left").join(docs, "entity_id", "left").withColumn("key", C.name_key(F.col("canonical_name"))).join(found, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    bucket = C.first_reason(("blocked", F.col("seed_status") != "active"), ("ready", F.col("accepted") > 0), ("drafted", F.col("claims") > 0), ("mentioned", F.col("documents") > 0))
    return joined.select("entity_id", "entity_type", zero("claims"), zero("accepted"), zero("documents"), zero("candidates"), F.coalesce(bucket, F.lit("empty")).alias("bucket"))


def claim_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims ranked in their target, weighed by that rank, and ranked in their track."""
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL AND knowledge_track IS NOT NULL AND confidence IS NOT NULL").select("claim_id", "knowledge_track", "target_entity_id", "confidence")
    ranked = ranking.weighted_two_level(rows, "knowledge_track", "target_entity_id", "confidence", "claim_id", [1.0, 0.62, 0.42, 0.3])
    return ranked.select("claim_id", F.col("inner_rank").cast("long").alias("inner_rank"), "weighted", F.col("outer_rank").cast("long").alias("outer_rank"))


def top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each source: reviewed ones first, then by quality, length and id."""
    labels = table(spark, sf_dir, "review_labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(labels, "doc_id", "left")
    return ranking.top_per_key(rows, ["source"], [F.col("quality").isNull(), F.desc("quality"), F.desc("n_chars"), F.col("doc_id")], 20).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


def segment_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversation_segments").where("dm_pair_id IS NOT NULL").select("dm_pair_id", "conversation_id", F.unix_micros("timestamp_start_utc").alias("us"))
    return ranking.sequence(rows, "dm_pair_id", ["us", "conversation_id"], "conversation_id").select("conversation_id", F.col("sequence_no").cast("long").alias("sequence_no"), "requires")


def review_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft claims in the order in which types take turns."""
    rows = table(spark, sf_dir, "claims").where("status = 'draft'").select("claim_id", "claim_type")
    return ranking.round_robin(rows, "claim_type", ["claim_id"]).select("claim_id", "claim_type", F.col("turn").cast("long").alias("turn"))


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated entities and candidates as one table, curated ones first where names are equal."""
    seeds = table(spark, sf_dir, "entity_seed").select(C.name_key(F.col("canonical_name")).alias("key"), F.col("entity_id").alias("record")).distinct()
    found = table(spark, sf_dir, "entity_candidates").select(C.name_key(F.coalesce("candidate_name", F.lit(""))).alias("key"), F.col("candidate_id").alias("record"))
    return sets.union_first_wins([seeds, found], "key", ["record"]).select("key", "record")


def seed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What blocking removes and the status an update changes, as a difference of two versions."""
    now = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name", "seed_status").distinct()
    updated = sets.upsert(now, now.where("seed_status = 'blocked_seed'").withColumn("seed_status", F.lit("archived")), "entity_id", ["canonical_name"])
    return sets.version_diff(now, updated.where("canonical_name NOT LIKE 'Port %'"), "entity_id", ["canonical_name", "seed_status"])


def confident_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's claims of high confidence, or all where it has none."""
    rows = table(spark, sf_dir, "claims").select("claim_id", "target_entity_id", "confidence")
    return sets.filtered_or_all(rows, F.col("confidence") >= 0.8, "target_entity_id").select("claim_id", "fell_back")


def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "review_labels"), "doc_id")
    by = rows.groupBy("source").agg(_n("reviewed"), F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg((F.col("quality") >= 4).cast("double")), 4).alias("good_share"), F.countDistinct("reviewer").alias("reviewers"))
    return by.withColumn("gate", F.when((F.col("quality") >= 3) & (F.col("good_share") >= 0.35), F.lit("pass")).otherwise(F.lit("fail")))


def validated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims through rules, duplicate check and a cap of five for each target; rejects keep their reason."""
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("claim_id", "target_entity_id", "claim_text", "confidence", "status")
    rules = {"no_text": F.coalesce(F.trim("claim_text"), F.lit("")) == "", "rejected": F.col("status") == "rejected", "unsure": F.coalesce("confidence", F.lit(0.0)) < 0.4}
    return scoring.validated(rows, rules, "target_entity_id", ["claim_id"], C.name_key(F.col("claim_text")), 5).select("claim_id", "status", "reason")


def tag_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags used often enough in accepted and other claims together to become markers."""
    tags = table(spark, sf_dir, "claims").select("status", F.explode("thematic_tags").alias("tag"))
    by = lambda rows: rows.groupBy("tag").agg(_n("uses"))
    return scoring.activated(by(tags.where("status = 'accepted'")), by(tags.where("status <> 'accepted'")), "tag", "uses", 25)


def target_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most used tags of each target."""
    counted = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("target_entity_id", F.explode("thematic_tags").alias("tag")).groupBy("target_entity_id", "tag").agg(_n("uses"))
    return ranking.top_per_key(counted, ["target_entity_id"], [F.desc("uses"), F.col("tag")], 3).select("target_entity_id", "tag", "uses", F.col("rank").cast("long").alias("rank"))


def claim_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one target with equal cleaned texts: a representative and its copies."""
    text = F.lower(C.clean_text(F.coalesce("claim_text", F.lit(""))))
    return table(spark, sf_dir, "claims").groupBy("target_entity_id", text.alias("text")).agg(F.min("claim_id").alias("representative"), _n("copies")).where("copies > 1").select("representative", "copies")


def claim_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why claims want attention, all reasons of each."""
    rows = table(spark, sf_dir, "claims").withColumn("_key", F.sha2(F.concat_ws("\x1f", F.coalesce("target_entity_id", F.lit("\x1e")), C.name_key(F.col("claim_text"))), 256)).withColumn("_key", F.when(F.col("claim_text").isNotNull(), F.col("_key")))
    rows = lookup_join(rows, rows.where("_key IS NOT NULL").groupBy("_key").agg(_n("_n")), "_key", "left")
    found = C.flags(untargeted=F.col("target_entity_id").isNull(), no_evidence=F.size(F.coalesce("source_snippet_ids", F.array().cast("array<string>"))) == 0, unsure=F.coalesce("confidence", F.lit(0.0)) < 0.65, repeated=F.col("_n") > 1, undecided=F.col("status").isin("draft", "defer"))
    return rows.select("claim_id", F.array_join(found, ",").alias("reasons"))


def alias_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that only one entity has."""
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "aliases").distinct()
    keys = seeds.select("entity_id", F.explode("aliases").alias("alias")).select("entity_id", C.name_key(F.col("alias")).alias("key"))
    return keys.where("key <> ''").groupBy("key").agg(F.min("entity_id").alias("entity_id"), F.countDistinct("entity_id").alias("owners")).where("owners = 1").select("key", "entity_id")


def seed_majorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each name key of aliases: its entities and their most frequent type, ties in order of the alphabet."""
    rows = table(spark, sf_dir, "entity_seed").select("entity_id", "entity_type", F.explode("aliases").alias("alias")).distinct().withColumn("key", C.name_key(F.col("alias"))).where("key <> ''")
    counted = rows.groupBy("key", "entity_type").agg(F.countDistinct("entity_id").alias("n"))
    return ranking.best_row(counted, ["key"], F.struct((-F.col("n")).alias("m"), "entity_type"), smallest=True).select("key", "entity_type", "n")


def cited_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations without their last two characters that still name exactly one snippet."""
    refs = table(spark, sf_dir, "claims").select(F.explode("source_snippet_ids").alias("s")).select(F.expr("substring(s, 1, length(s) - 2)").alias("ref"))
    return matching.unique_prefix(refs, "ref", table(spark, sf_dir, "documents"), "snippet_id")


def segment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's segments cut so that none overlaps an earlier one."""
    rows = table(spark, sf_dir, "conversation_segments").where("dm_pair_id IS NOT NULL AND timestamp_start_utc IS NOT NULL").select("conversation_id", "dm_pair_id", F.unix_micros("timestamp_start_utc").alias("start_us"), F.unix_micros("timestamp_end_utc").alias("end_us"))
    return sequences.without_overlap(rows, "dm_pair_id", "start_us", "end_us", "conversation_id").select("conversation_id", "start_us", "end_us", "trimmed")


def _in_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.said(spark, sf_dir).where("conversation_id IS NOT NULL").select("conversation_id", "thread_id", "message_id", "us", "text")


def message_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct messages with the digest of the five messages around each in its conversation."""
    around = sequences.context(_in_conversations(spark, sf_dir), "conversation_id", ["us", "message_id", "thread_id"], "text", 5)
    return around.select("conversation_id", "thread_id", "message_id", F.md5("context").alias("context_md5"))


def conversation_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first messages of each conversation, up to eight and 400 characters."""
    kept = ranking.budget_prefix(_in_conversations(spark, sf_dir), "conversation_id", ["us", "message_id", "thread_id"], "text", 8, 400)
    return kept.select("conversation_id", "message_id", F.col("place").cast("long").alias("place"), "kept_chars")


def model_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's sessions cut into windows that a model takes: rows and characters bounded as configured.

    A message counts at least one character. The fold runs within sessions, so a pair with most of
    the rows is as many keys as it has sessions.
    """
    config = config_in_force(spark, sf_dir)
    rows = messages.said(spark, sf_dir).select("dm_pair_id", "timestamp_utc", "us", "message_id", "thread_id", F.greatest(F.length("text"), F.lit(1)).cast("long").alias("chars"))
    rows = session_numbers(rows, "dm_pair_id", "timestamp_utc", round(config["max_gap_hours"] * 3_600_000_000)).drop("timestamp_utc")
    parts = sequences.greedy_chunks(rows, ["dm_pair_id", "session_no"], ["us", "message_id", "thread_id"], "chars", config["model_window_max_messages"], config["model_window_max_chars"])
    return parts.groupBy("dm_pair_id", "session_no", "part_no").agg(_n("messages"), F.sum("chars").alias("chars"))


def last_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_entity_id, target_entity_id``: of several accepted merges of one entity the last one counts (then the larger proposal id)."""
    moves = table(spark, sf_dir, "identity_merges").where("source_entity_id <> target_entity_id")
    latest = F.struct(F.unix_micros("created_at_utc").alias("at"), "proposal_id")
    return moves.groupBy("source_entity_id").agg(F.max_by("target_entity_id", latest).alias("target_entity_id"))


def merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each merged entity's chain of accepted merges ends; null for those that run in or into a cycle.

    Pairs of an entity with itself are no merges.
    """
    return graph.final_targets(last_merges(spark, sf_dir), "source_entity_id", "target_entity_id")


def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities linked by pairs that name both ends by id."""
    return graph.reachable_minimum(table(spark, sf_dir, "identity_merges"), "source_entity_id", "target_entity_id")


def relationship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship hints as edges; targets that are no entity stay as names."""
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name", "relationship_hints").distinct()
    hints = seeds.select("entity_id", F.explode("relationship_hints").alias("h")).select("entity_id", C.name_key(F.col("h.target_name")).alias("key"), F.col("h.relation_type").alias("relation"))
    names = seeds.groupBy(C.name_key(F.col("canonical_name")).alias("key")).agg(F.min("entity_id").alias("target_id"))
    edges = hints.join(names, "key", "left").select("entity_id", F.coalesce("target_id", F.concat(F.lit("unresolved:"), F.col("key"))).alias("target"), "relation")
    return graph.weighted_edges(edges, "entity_id", "target", "relation").select("entity_id", "target", "relation", "evidence")


def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(relationship_edges(spark, sf_dir), "entity_id", "target")


def reference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between tables that lead nowhere."""
    docs, claims = table(spark, sf_dir, "documents"), table(spark, sf_dir, "claims")
    seeds = table(spark, sf_dir, "entity_seed")
    cited = claims.select(F.explode("source_snippet_ids").alias("snippet_id"))
    parts = [
        sets.dangling(cited, "snippet_id", docs, "snippet_id", "claim cites unknown snippet"),
        sets.dangling(claims, "target_entity_id", seeds, "entity_id", "claim of unknown entity"),
        sets.dangling(docs, "entity_id", seeds, "entity_id", "document of unknown entity"),
        sets.dangling(docs, "conversation_id", table(spark, sf_dir, "conversation_segments"), "conversation_id", "document of unknown conversation"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of records as one table of database, id and title."""
    seeds = table(spark, sf_dir, "entity_seed").where("seed_status = 'active'").select(F.lit("entities").alias("database"), F.col("entity_id").alias("id"), F.col("canonical_name").alias("title")).distinct()
    claims = table(spark, sf_dir, "claims").where("status = 'accepted'").select(F.lit("claims").alias("database"), F.col("claim_id").alias("id"), F.substring(C.clean_text(F.coalesce("claim_text", F.lit(""))), 1, 60).alias("title"))
    segments = table(spark, sf_dir, "conversation_segments").select(F.lit("conversations").alias("database"), F.col("conversation_id").alias("id"), F.coalesce("topic_label", F.lit("untitled")).alias("title"))
    return seeds.unionByName(claims).unionByName(segments)


def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim metrics before and after a date."""
    period = F.when(F.col("created_at_utc") < F.lit("2025-01-01 00:00:00").cast("timestamp"), "before").otherwise("after")
    return table(spark, sf_dir, "claims").where("created_at_utc IS NOT NULL").groupBy(period.alias("period"), "knowledge_track").agg(_n("claims"), F.countDistinct("target_entity_id").alias("targets"), F.round(F.avg("confidence"), 4).alias("confidence"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by Spark's own session windows: a pause of more than 30 minutes ends one."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    by = rows.groupBy("user_id", F.session_window("ts", "30 minutes 1 microsecond")).agg(_n("events"), F.max(F.unix_micros("ts")).alias("last_us"))
    return by.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "last_us", "events")


QUERIES = {
    f.__name__: f
    for f in [
        timeline_statistics, timeline_index, batch_selection, global_sequence, account_owner, last_labels, conversation_partners, thread_identity, segment_rows, segment_messages, unsegmented_conversations,
        segment_distance, claim_targets, entity_mentions, claim_clusters, snippet_support, tag_pairs, type_votes, candidate_groups, candidate_recency, candidate_triage, latest_claims, undecided_claims,
        targets_with_seeds, entity_inventory, claim_rankings, top_documents, segment_sequences, review_turns, known_names, seed_changes, confident_claims, source_quality, validated_claims, tag_activation,
        target_tags, claim_duplicates, claim_attention, alias_owners, seed_majorities, cited_snippets, segment_spans, message_context, conversation_openings, model_windows, merge_targets,
        identity_components, relationship_edges, node_degrees, reference_issues, export_records, period_comparison, event_sessions,
    ]
}
