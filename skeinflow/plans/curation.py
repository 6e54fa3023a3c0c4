"""Queries that curate entities, claims and identities: clusters, merges, decisions, profiles, packets, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import columns as C
from skeinflow.operators import graph, matching, ranking, sequences, sets
from skeinflow.operators.skew import lookup_join
from skeinflow.plans import messages
from skeinflow.plans.messages import DISTINCT, config_in_force
from skeinflow.plans.normalising import CLEAN, KEY
from skeinflow.plans.relational import merge_targets
from skeinflow.plans.relational_sql import SQL as _OTHERS
from skeinflow.runtime import Scratch, table


def _n(name: str):
    return F.count(F.lit(1)).alias(name)


def _list(column: str):
    return F.coalesce(column, F.array().cast("array<string>"))


def _seeds(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "entity_seed").where("entity_id IS NOT NULL").select("entity_id", *columns).distinct()


def known_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct accepted pairs whose ends are both entities of the curated table, with the proposals behind them."""
    known = _seeds(spark, sf_dir).withColumn("_ok", F.lit(True))
    rows = table(spark, sf_dir, "identity_merges").where("source_entity_id <> target_entity_id").select("proposal_id", "source_entity_id", "target_entity_id")
    for side in ("source", "target"):
        rows = lookup_join(rows, known.select(F.col("entity_id").alias(f"{side}_entity_id"), "_ok"), f"{side}_entity_id").drop("_ok")
    return rows


def identity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of entities that accepted pairs link, with the member that names the cluster: by incoming and outgoing pairs and the shape of its name."""
    pairs = Scratch(spark, "pairs").save(known_pairs(spark, sf_dir))
    groups = graph.reachable_minimum(pairs, "source_entity_id", "target_entity_id")
    degree = graph.degrees(pairs, "source_entity_id", "target_entity_id", distinct=False)
    names = _seeds(spark, sf_dir, "canonical_name").groupBy(F.col("entity_id").alias("vertex")).agg(F.max("canonical_name").alias("name"))
    rows = groups.join(degree.withColumnRenamed("node", "vertex"), "vertex").join(names, "vertex", "left")
    clean = C.clean_text(F.coalesce("name", F.lit("")))
    words = F.size(F.split(clean, " "))
    # What an edge, a letter and a word count.
    score = 5.0 * F.col("incoming") - F.col("outgoing") + F.least(F.length(clean), F.lit(40)) / 10.0 + 1.5 * words
    score = score - F.when((words == 1) & (F.length(clean) <= 5), 5.0).otherwise(0.0) - F.when((clean == F.upper(clean)) & (F.length(clean) <= 8), 1.0).otherwise(0.0)
    score = F.when(clean == "", F.lit(-1000.0)).otherwise(score)
    best = rows.groupBy("component").agg(F.max(F.struct(F.round(score, 4).alias("score"), F.lower(clean).alias("low"), F.col("vertex").alias("canonical"))).alias("b"), _n("members"))
    return best.select("component", F.col("b.canonical").alias("canonical"), F.col("b.score").alias("score"), "members")


def kept_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each cluster still linked with its first one when rejected pairs are taken out: those that cite a rejected claim."""
    pairs = Scratch(spark, "pairs").save(known_pairs(spark, sf_dir))
    rejected = table(spark, sf_dir, "claims").where("status = 'rejected'").select("claim_id")
    cited = table(spark, sf_dir, "identity_merges").select("proposal_id", F.explode("evidence_claim_ids").alias("claim_id")).join(rejected, "claim_id", "left_semi").select("proposal_id").distinct()
    whole = graph.reachable_minimum(pairs, "source_entity_id", "target_entity_id")
    kept = pairs.join(cited, "proposal_id", "left_anti")
    reached = graph.reachable_from(kept, "source_entity_id", "target_entity_id", whole.select(F.col("component").alias("start")).distinct(), "start")
    return whole.join(reached.select("start", "vertex"), "vertex", "left").where("component = start").select("component", F.col("vertex").alias("member"))


def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated table after all merges: sources fold into what they were merged into, with their names as aliases; cycles merge nothing."""
    targets = Scratch(spark, "targets").save(merge_targets(spark, sf_dir).where("final IS NOT NULL").select(F.col("source_entity_id").alias("entity_id"), "final"))
    seeds = _seeds(spark, sf_dir, "canonical_name", "aliases")
    known = _seeds(spark, sf_dir).select(F.col("entity_id").alias("final"))
    valid = targets.join(known, "final", "left_semi")
    moved = lookup_join(seeds, valid, "entity_id", "left").withColumn("into", F.coalesce("final", "entity_id"))
    names = moved.select("into", F.explode(F.concat(F.when(F.col("final").isNotNull(), F.array("canonical_name")).otherwise(F.array().cast("array<string>")), _list("aliases"))).alias("name")).where("trim(name) <> ''").distinct()
    own = seeds.select(F.col("entity_id").alias("into"), "canonical_name")
    aliases = names.groupBy("into").agg(_n("aliases"), F.min("name").alias("first_alias"))
    sizes = moved.groupBy("into").agg(F.sum(F.col("final").isNotNull().cast("long")).alias("merged"))
    rows = sizes.join(aliases, "into", "left").join(own, "into")
    return rows.select(F.col("into").alias("entity_id"), "canonical_name", "merged", F.coalesce("aliases", F.lit(0)).cast("long").alias("aliases"), "first_alias")


def pruned_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations left when blocked entities are deleted: they go, and so do others' relations to their names."""
    seeds = _seeds(spark, sf_dir, "canonical_name", "seed_status", "relationship_hints")
    gone = seeds.where("seed_status = 'blocked_seed'").select(C.name_key(F.col("canonical_name")).alias("key")).distinct().withColumn("_gone", F.lit(True))
    hints = seeds.where("seed_status <> 'blocked_seed'").select("entity_id", F.explode_outer("relationship_hints").alias("h")).select("entity_id", C.name_key(F.col("h.target_name")).alias("key"), F.col("h").isNotNull().alias("is_hint"))
    marked = lookup_join(hints, gone, "key", "left")
    return marked.groupBy("entity_id").agg(F.sum((F.col("is_hint") & F.col("_gone").isNull()).cast("long")).alias("kept"), F.sum((F.col("is_hint") & F.col("_gone").isNotNull()).cast("long")).alias("pruned"))


def decided_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each candidate name: a reviewer's on a merge of that name first, else the latest automatic one on a claim about it."""
    human = table(spark, sf_dir, "identity_merges").select(C.name_key(F.col("source_entity_name")).alias("key"), F.struct(F.unix_micros("created_at_utc").alias("at"), "proposal_id").alias("o"), F.col("review_status").alias("d")).where("key <> ''").groupBy("key").agg(F.max_by("d", "o").alias("human"))
    auto = table(spark, sf_dir, "claims").select(C.name_key(F.col("target_entity_name")).alias("key"), F.struct(F.unix_micros("created_at_utc").alias("at"), "claim_id").alias("o"), F.col("status").alias("d")).where("key <> '' AND d IN ('accepted', 'rejected', 'defer')").groupBy("key").agg(F.max_by("d", "o").alias("auto"))
    rows = table(spark, sf_dir, "entity_candidates").select("candidate_id", C.name_key(F.col("candidate_name")).alias("key"))
    joined = lookup_join(lookup_join(rows, human, "key", "left"), auto, "key", "left")
    decision = F.when(F.col("human").isin("accept", "approve"), "accepted").otherwise(F.coalesce("human", "auto", F.lit("pending")))
    by = F.when(F.col("human").isNotNull(), "reviewer").when(F.col("auto").isNotNull(), "auto").otherwise("none")
    return joined.select("candidate_id", decision.alias("decision"), by.alias("by"))


def carried_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New candidates (of the later half of time) that keep the confidence noted for the same name before."""
    rows = table(spark, sf_dir, "entity_candidates").select("candidate_id", C.name_key(F.col("candidate_name")).alias("key"), "confidence", F.unix_micros("first_seen_timestamp_utc").alias("us")).where("key <> '' AND us IS NOT NULL")
    cut = F.unix_micros(F.lit("2025-01-01 00:00:00").cast("timestamp"))
    before = rows.where((F.col("us") < cut) & F.col("confidence").isNotNull()).groupBy("key").agg(F.max_by("confidence", F.struct("us", "candidate_id")).alias("noted"))
    return lookup_join(rows.where(F.col("us") >= cut), before, "key", "left").select("candidate_id", F.coalesce("noted", "confidence").alias("confidence"), F.col("noted").isNotNull().alias("carried"))


def note_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's note as an item of its track, with the messages that support it: the ones it names, else all of the note's, else the conversation's.

    An item names the listed messages whose id ends in an even digit. Items whose support isn't exactly what they name go to review.
    """
    notes = table(spark, sf_dir, "conversation_segments").select("conversation_id", "track", "topic_label", "topic_summary", _list("anchor_entities").alias("anchors"), F.array_distinct(_list("message_ids")).alias("ids"))
    notes = notes.withColumn("asked", F.filter("ids", lambda x: x.rlike("[02468]$")))
    said = Scratch(spark, "said").save(messages.said(spark, sf_dir).where("conversation_id IS NOT NULL").select("conversation_id", "message_id").distinct())
    listed = notes.select("conversation_id", F.explode("ids").alias("message_id"), F.lit(True).alias("in_note"))
    met = said.join(listed, ["conversation_id", "message_id"], "left")
    by = met.groupBy("conversation_id").agg(_n("of_conversation"), F.count("in_note").alias("of_note"), F.sum((F.col("in_note").isNotNull() & F.col("message_id").rlike("[02468]$")).cast("long")).alias("of_item"))
    rows = notes.join(by, "conversation_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    kind = F.when(F.col("track") == "lore", "lore_development").when(F.col("track") == "meta", "meta_development").otherwise("open_question")
    summary = F.trim(F.coalesce("topic_summary", F.lit("")))
    prefix = F.when(kind == "lore_development", F.array_join("anchors", ", ")).when(kind == "meta_development", F.coalesce("topic_label", F.lit(""))).otherwise(F.lit(""))
    text = F.when(prefix == "", summary).otherwise(F.concat(prefix, F.lit(": "), summary))
    support = F.when(n("of_item") > 0, "item").when(n("of_note") > 0, "note").when(n("of_conversation") > 0, "conversation").otherwise("none")
    count = F.when(n("of_item") > 0, n("of_item")).when(n("of_note") > 0, n("of_note")).otherwise(n("of_conversation"))
    return rows.select("conversation_id", kind.alias("item"), F.md5(text).alias("text"), support.alias("support"), count.alias("messages"), ((n("of_item") > 0) & (n("of_item") == F.size("asked"))).alias("exact"))


def trigger_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that texts say turned into others: the nearest name before and after the first of each trigger phrase."""
    seeds = _seeds(spark, sf_dir, "canonical_name")
    return matching.pairs_around(table(spark, sf_dir, "documents"), "doc_id", "text", seeds, "entity_id", "canonical_name", TRIGGERS).groupBy("source", "target", "trigger").agg(_n("texts"))


TRIGGERS = {"became": False, "becomes": False, "was left to": False, "formerly": True, "met the": False, "is older than": True}


def prior_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim with the last three claims about its target that came before it."""
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("target_entity_id", "claim_id", F.unix_micros("created_at_utc").alias("us"))
    return sequences.previous(rows, "target_entity_id", ["us", "claim_id"], "claim_id", 3, "prior").select("claim_id", F.array_join("prior", ",").alias("prior"))


def name_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile for each name that candidates share: first label, latest type, snippets and the largest confidence."""
    rows = table(spark, sf_dir, "entity_candidates").withColumn("key", C.name_key(F.col("candidate_name"))).where("key <> ''")
    order = F.struct(F.unix_micros("first_seen_timestamp_utc").alias("at"), "candidate_id")
    by = rows.groupBy("key").agg(F.min_by("candidate_name", order).alias("label"), F.max_by("proposed_entity_type", F.when(F.col("proposed_entity_type").isNotNull(), order)).alias("type"), F.max("confidence").alias("confidence"), _n("candidates"))
    cited = rows.select("key", F.explode("source_snippet_ids").alias("s")).distinct().groupBy("key").agg(_n("snippets"))
    return by.join(cited, "key", "left").select("key", "label", "type", "confidence", "candidates", F.coalesce("snippets", F.lit(0)).cast("long").alias("snippets"))


def evidence_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence from three tables, the best 40 of each, equal texts once (of the first table), at most 90 in all."""
    take = lambda df, order: df.orderBy(*order).limit(40)
    claims = take(table(spark, sf_dir, "claims").where("status = 'accepted' AND confidence IS NOT NULL").select(F.lit(0).alias("source"), F.col("claim_id").alias("id"), F.col("confidence").alias("score"), C.name_key(F.col("claim_text")).alias("key")), [F.desc("score"), F.col("id")])
    names = take(table(spark, sf_dir, "entity_candidates").where("confidence IS NOT NULL").select(F.lit(1).alias("source"), F.col("candidate_id").alias("id"), F.col("confidence").alias("score"), C.name_key(F.col("candidate_name")).alias("key")), [F.desc("score"), F.col("id")])
    parts = take(table(spark, sf_dir, "conversation_segments").where("relevance_confidence IS NOT NULL").select(F.lit(2).alias("source"), F.col("conversation_id").alias("id"), F.col("relevance_confidence").alias("score"), C.name_key(F.col("topic_summary")).alias("key")), [F.desc("score"), F.col("id")])
    best = sets.union_first_wins([claims, names, parts], "key", ["id"])
    return best.withColumn("key", F.coalesce("key", F.lit(""))).where("key <> ''").orderBy("source", F.desc("score"), "id").limit(90).select("source", "id", "score")


def tag_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag profiles after an update: what accepted claims say, overwritten by drafts where they say something, lists united, confidence the largest."""
    rows = table(spark, sf_dir, "claims").select("claim_id", "status", "claim_type", "confidence", "knowledge_track", F.explode("thematic_tags").alias("tag")).where("status IN ('accepted', 'draft')")
    is_new = F.col("status") == "draft"
    newest = F.struct(is_new.cast("int").alias("new"), "claim_id")
    by = rows.groupBy("tag").agg(F.max_by("claim_type", F.when(F.col("claim_type").isNotNull(), newest)).alias("type"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("knowledge_track")), ",").alias("tracks"), F.bool_and(is_new).alias("added"))
    return by


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each active entity: slug (numbered where several have the same), kind and path."""
    rows = _seeds(spark, sf_dir, "canonical_name", "entity_type", "seed_status").where("seed_status = 'active' AND canonical_name IS NOT NULL").withColumn("base", C.slug(F.col("canonical_name")))
    placed = ranking.numbered_per_key(rows, "base", ["entity_id"], "n")
    slug = F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base"))
    return placed.select("entity_id", slug.alias("slug"), F.concat(F.lit("entities/"), slug, F.lit(".html")).alias("path"), F.coalesce("entity_type", F.lit("term")).alias("kind"))


def cluster_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each entity the pair that says most about it: one of its own first, then by review and confidence."""
    rows = table(spark, sf_dir, "identity_merges").select("proposal_id", "source_entity_id", "target_entity_id", "review_status", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    ends = rows.select(F.col("source_entity_id").alias("entity_id"), F.lit(0).alias("far"), "proposal_id", "review_status", "confidence").unionByName(rows.select(F.col("target_entity_id").alias("entity_id"), F.lit(1).alias("far"), "proposal_id", "review_status", "confidence")).where("entity_id IS NOT NULL")
    rank = F.struct("far", (F.col("review_status") != "approve").cast("int").alias("r"), (-F.col("confidence")).alias("c"), "proposal_id")
    return ranking.best_row(ends, ["entity_id"], rank, smallest=True).select("entity_id", "proposal_id", (F.col("far") == 0).alias("own"))


def entity_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is remembered of each entity: claims by its id or by its name, each once, by status."""
    seeds = _seeds(spark, sf_dir, "canonical_name")
    claims = table(spark, sf_dir, "claims").select("claim_id", "status", "target_entity_id", C.name_key(F.col("target_entity_name")).alias("key"))
    by_id = claims.where("target_entity_id IS NOT NULL").select("claim_id", "status", F.col("target_entity_id").alias("entity_id")).join(seeds.select("entity_id").distinct(), "entity_id", "left_semi")
    names = seeds.groupBy(C.name_key(F.col("canonical_name")).alias("key")).agg(F.min("entity_id").alias("entity_id")).where("key <> ''")
    by_name = lookup_join(claims.select("claim_id", "status", "key"), names, "key").select("claim_id", "status", "entity_id")
    return by_id.unionByName(by_name.select("entity_id", "claim_id", "status")).distinct().groupBy("entity_id", "status").agg(_n("claims"))


def entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations in which each entity is the one end or the other, counted by kind."""
    seeds = _seeds(spark, sf_dir, "canonical_name", "relationship_hints")
    names = seeds.groupBy(C.name_key(F.col("canonical_name")).alias("key")).agg(F.min("entity_id").alias("other"))
    hints = seeds.select("entity_id", F.explode("relationship_hints").alias("h")).select("entity_id", C.name_key(F.col("h.target_name")).alias("key"), F.col("h.relation_type").alias("relation"))
    edges = lookup_join(hints, names, "key")
    ends = edges.select(F.explode(F.array_distinct(F.array("entity_id", "other"))).alias("entity_id"), "relation")
    return ends.groupBy("entity_id", "relation").agg(_n("relations"))


def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that claims propose for a target that isn't decided: the first five in order, how many, and the best confidence."""
    rows = table(spark, sf_dir, "claims").where("alias_text IS NOT NULL AND target_entity_id IS NOT NULL AND status IN ('draft', 'defer')").groupBy("target_entity_id", C.clean_text(F.col("alias_text")).alias("alias")).agg(F.max("confidence").alias("confidence"), _n("claims"))
    first = ranking.top_per_key(rows, ["target_entity_id"], [F.col("alias")], 5).groupBy("target_entity_id").agg(F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("first"))
    by = rows.groupBy("target_entity_id").agg(_n("aliases"), F.sum("claims").alias("claims"), F.max("confidence").alias("confidence"))
    return by.join(first, "target_entity_id").select("target_entity_id", "first", "aliases", "claims", "confidence")


def tag_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets each accepted tag has, and the one it belongs to where there is only one."""
    rows = table(spark, sf_dir, "claims").where("status = 'accepted' AND target_entity_name IS NOT NULL").select(F.explode("thematic_tags").alias("tag"), "knowledge_track", C.name_key(F.col("target_entity_name")).alias("target"))
    return rows.groupBy("tag", "knowledge_track").agg(F.countDistinct("target").alias("targets"), F.min("target").alias("low"), F.max("target").alias("high")).select("tag", "knowledge_track", "targets", F.when(F.col("low") == F.col("high"), F.col("low")).alias("owner"))


def entity_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each entity over its name and aliases, the best claim for each, the eight best."""
    seeds = _seeds(spark, sf_dir, "canonical_name", "aliases")
    keys = seeds.select("entity_id", F.explode(F.concat(F.array("canonical_name"), _list("aliases"))).alias("name")).select("entity_id", C.name_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    tags = table(spark, sf_dir, "claims").select(C.name_key(F.col("target_entity_name")).alias("key"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.explode(F.array_distinct("thematic_tags")).alias("tag")).where("key <> ''").groupBy("key", "tag").agg(F.max("confidence").alias("confidence"))
    best = keys.join(tags, "key").groupBy("entity_id", "tag").agg(F.max("confidence").alias("confidence"))
    return ranking.top_per_key(best, ["entity_id"], [F.desc("confidence"), F.col("tag")], 8).select("entity_id", "tag", "confidence", F.col("rank").cast("long").alias("rank"))


def tagged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams of segments as one, each row with its scope and a number in the order of start, end, scope and id."""
    rows = table(spark, sf_dir, "conversation_segments").select("conversation_id", "track", F.unix_micros("timestamp_start_utc").alias("start_us"), F.unix_micros("timestamp_end_utc").alias("end_us"))
    strict = rows.where("track = 'lore'").select(F.lit("strict").alias("scope"), "conversation_id", "start_us", "end_us")
    rest = rows.where("track IS NULL OR track <> 'lore'").select(F.lit("rescue").alias("scope"), "conversation_id", "start_us", "end_us")
    return ranking.numbered(strict.unionByName(rest), ["start_us", "end_us", "scope", "conversation_id"]).select("scope", "conversation_id", "seq")


def all_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all claims: those made, and for the others the one that follows from their confidence."""
    claims = table(spark, sf_dir, "claims").select("claim_id", "status", "confidence")
    made = claims.where("status IN ('accepted', 'rejected')").select("claim_id", F.col("status").alias("decision"), F.lit("made").alias("by"))
    rest = sets.pending(claims, "claim_id", made)
    default = rest.select("claim_id", F.when(F.col("confidence") >= 0.65, "accepted").otherwise("defer").alias("decision"), F.lit("default").alias("by"))
    return made.unionByName(default)


def ledger_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims recorded before a date and after it, with the index of each part: rows, targets, first and last."""
    part = F.when(F.col("created_at_utc") < F.lit("2025-03-01 00:00:00").cast("timestamp"), "pinned").otherwise("open")
    us = F.unix_micros("created_at_utc")
    return table(spark, sf_dir, "claims").groupBy(part.alias("part")).agg(_n("claims"), F.countDistinct("target_entity_id").alias("targets"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


def candidate_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a candidate's name belongs to: the entity of that name, else the one whose longest name or alias it contains."""
    seeds = _seeds(spark, sf_dir, "canonical_name", "aliases")
    every = seeds.select("entity_id", F.explode(F.concat(F.array("canonical_name"), _list("aliases"))).alias("name")).select("entity_id", C.name_key(F.col("name")).alias("name")).where("length(name) >= 4").distinct()
    exact = seeds.groupBy(C.name_key(F.col("canonical_name")).alias("key")).agg(F.min("entity_id").alias("same")).where("key <> ''")
    rows = table(spark, sf_dir, "entity_candidates").select("candidate_id", "candidate_name", C.name_key(F.col("candidate_name")).alias("key"))
    owner = every.groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    inside = matching.named(rows, "candidate_id", "candidate_name", owner, "entity_id", "name").groupBy("candidate_id").agg(F.max(F.struct(F.length("name").alias("size"), "name", "entity_id")).alias("b"))
    joined = lookup_join(rows, exact, "key", "left").join(inside, "candidate_id", "left")
    return joined.select("candidate_id", F.coalesce("same", F.col("b.entity_id")).alias("entity_id"), F.when(F.col("same").isNotNull(), "name").when(F.col("b").isNotNull(), "part").otherwise("none").alias("by"))


def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target its five most confident accepted claims and how many snippets and tags they bring."""
    rows = table(spark, sf_dir, "claims").where("status = 'accepted' AND target_entity_id IS NOT NULL").select("target_entity_id", "claim_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), _list("source_snippet_ids").alias("s"), _list("thematic_tags").alias("t"))
    best = ranking.top_per_key(rows, ["target_entity_id"], [F.desc("confidence"), F.col("claim_id")], 5)
    flat = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")  # noqa: E731  (five lists at most)
    return best.groupBy("target_entity_id").agg(F.array_join(F.array_sort(F.collect_list("claim_id")), ",").alias("claims"), flat("s").alias("snippets"), flat("t").alias("tags"))


def unreserved_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided claims whose snippets no open question cites."""
    claims = table(spark, sf_dir, "claims")
    reserved = claims.where("claim_type = 'open_question' AND status = 'draft'").select(F.explode("source_snippet_ids").alias("snippet_id"))
    waiting = claims.where("status IN ('draft', 'defer') AND claim_type <> 'open_question'").select("claim_id", F.explode_outer("source_snippet_ids").alias("snippet_id"))
    held = waiting.join(reserved.distinct(), "snippet_id", "left_semi").select("claim_id").distinct()
    return waiting.select("claim_id").distinct().join(held, "claim_id", "left_anti")


def accepted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments rebuilt from their listed messages and cut again for a model of the rerun's size."""
    size = table(spark, sf_dir, "pipeline_config").where("enabled AND section = 'theme_aware_rerun'").orderBy("config_id").limit(1).collect()  # a table of fixed size
    most = (size[0]["model_window_max_messages"], size[0]["model_window_max_chars"]) if size else (config_in_force(spark, sf_dir)["model_window_max_messages"], config_in_force(spark, sf_dir)["model_window_max_chars"])
    listed = table(spark, sf_dir, "conversation_segments").select("conversation_id", F.explode("message_ids").alias("message_id")).distinct()
    rows = listed.join(messages.said(spark, sf_dir).where("conversation_id IS NOT NULL"), ["conversation_id", "message_id"]).select("conversation_id", "us", "message_id", "thread_id", F.greatest(F.length("text"), F.lit(1)).cast("long").alias("chars"))
    parts = sequences.greedy_chunks(rows, ["conversation_id"], ["us", "message_id", "thread_id"], "chars", *most)
    return parts.groupBy("conversation_id", "part_no").agg(_n("messages"), F.sum("chars").alias("chars"))


def tiered_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document is about by the first way that tells: its noted entity, else names in its text, else nothing."""
    docs = table(spark, sf_dir, "documents")
    noted = docs.where("entity_id IS NOT NULL").select("doc_id", "entity_id", F.lit(1).alias("tier"))
    said = matching.mentions(docs, "doc_id", "text", _seeds(spark, sf_dir, "canonical_name"), "entity_id", "canonical_name").select("doc_id", "entity_id", F.lit(2).alias("tier"))
    return ranking.first_tier(noted.unionByName(said), "doc_id", "tier").groupBy("doc_id", "tier").agg(_n("entities"))


def claim_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim texts with their own alias written as the target's name, whole words only, letter case ignored."""
    alias = F.concat(F.lit(r"(?i)(^|[^A-Za-z0-9])\Q"), F.replace("alias_text", F.lit("\\E"), F.lit("")), F.lit(r"\E($|[^A-Za-z0-9])"))
    rows = table(spark, sf_dir, "claims").where("alias_text <> '' AND target_entity_name IS NOT NULL AND claim_text IS NOT NULL")
    new = F.regexp_replace("claim_text", alias, F.concat(F.lit("$1"), F.regexp_replace("target_entity_name", r"([\\$])", ""), F.lit("$2")))
    return rows.select("claim_id", F.md5(new).alias("text"), (new != F.col("claim_text")).alias("changed"))


QUERIES = {
    f.__name__: f
    for f in [
        known_pairs, identity_clusters, kept_members, merged_entities, pruned_hints, decided_candidates, carried_notes, note_items, trigger_pairs, prior_claims, name_profiles, evidence_packets, tag_profiles, page_entries, cluster_edges, entity_memory, entity_relations, alias_groups,
        tag_owners, entity_tags, tagged_segments, all_decisions, ledger_split, candidate_owners, evidence_bundles, unreserved_claims, accepted_windows, tiered_mentions, claim_prose,
    ]
}

_PAIRS = "(SELECT proposal_id, source_entity_id, target_entity_id FROM identity_merges WHERE source_entity_id <> target_entity_id AND source_entity_id IN (SELECT entity_id FROM entity_seed) AND target_entity_id IN (SELECT entity_id FROM entity_seed))"
_REACH = "d AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS v, least(a, b) AS low FROM d UNION SELECT d.b, r.low FROM r JOIN d ON d.a = r.v), g AS (SELECT v, min(low) AS component FROM r GROUP BY 1)"
_TARGETS = _OTHERS["merge_targets"]
_SEEDS = "(SELECT DISTINCT entity_id, canonical_name, entity_type, aliases, seed_status, relationship_hints FROM entity_seed)"
_HINTS = f"(SELECT entity_id, {KEY % 'h.target_name'} AS key, h.relation_type AS relation FROM (SELECT entity_id, unnest(relationship_hints) AS h FROM {_SEEDS}))"
_SPELLED = f"(SELECT DISTINCT entity_id, {KEY % 'x'} AS name FROM (SELECT entity_id, unnest(list_prepend(canonical_name, coalesce(aliases, []))) AS x FROM {_SEEDS}))"
SQL = {
    "known_pairs": f"SELECT * FROM {_PAIRS}",
    "identity_clusters": f"""WITH RECURSIVE p AS (SELECT source_entity_id AS a, target_entity_id AS b FROM {_PAIRS}), {_REACH}, n AS (SELECT entity_id, max({CLEAN % "coalesce(canonical_name, '')"}) AS name FROM entity_seed GROUP BY 1),
      i AS (SELECT b AS v, count(*) AS n FROM p GROUP BY 1), o AS (SELECT a AS v, count(*) AS n FROM p GROUP BY 1),
      s AS (SELECT component, g.v, name, len(string_split(name, ' ')) AS w, coalesce(i.n, 0) AS inc, coalesce(o.n, 0) AS out FROM g LEFT JOIN n ON n.entity_id = g.v LEFT JOIN i ON i.v = g.v LEFT JOIN o ON o.v = g.v),
      k AS (SELECT *, round(CASE WHEN name = '' THEN -1000.0::DOUBLE ELSE 5.0::DOUBLE * inc - out + least(length(name), 40) / 10.0::DOUBLE + 1.5::DOUBLE * w - CASE WHEN w = 1 AND length(name) <= 5 THEN 5 ELSE 0 END - CASE WHEN name = upper(name) AND length(name) <= 8 THEN 1 ELSE 0 END END, 4) AS score FROM s)
      SELECT component, v AS canonical, score, members FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY score DESC, lower(name) DESC, v DESC) AS rn, count(*) OVER (PARTITION BY component) AS members FROM k) WHERE rn = 1""",
    "kept_members": f"""WITH RECURSIVE q AS (SELECT * FROM {_PAIRS}), p AS (SELECT source_entity_id AS a, target_entity_id AS b FROM q), {_REACH},
      x AS (SELECT DISTINCT proposal_id FROM (SELECT proposal_id, unnest(evidence_claim_ids) AS c FROM identity_merges) WHERE c IN (SELECT claim_id FROM claims WHERE status = 'rejected')), k AS (SELECT source_entity_id AS a, target_entity_id AS b FROM q WHERE proposal_id NOT IN (SELECT proposal_id FROM x)),
      e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), t AS (SELECT DISTINCT component AS s, component AS v FROM g UNION SELECT t.s, e.b FROM t JOIN e ON e.a = t.v) SELECT s AS component, v AS member FROM t""",
    "merged_entities": f"""{_TARGETS.replace('SELECT s AS source_entity_id', ', tt AS (SELECT s AS source_entity_id', 1)}), v AS (SELECT source_entity_id AS e, final FROM tt WHERE final IN (SELECT entity_id FROM entity_seed)),
      u AS (SELECT s.entity_id, canonical_name, aliases, final, coalesce(final, s.entity_id) AS target FROM {_SEEDS} s LEFT JOIN v ON v.e = s.entity_id),
      a AS (SELECT DISTINCT target, unnest(list_concat(CASE WHEN final IS NOT NULL THEN [canonical_name] ELSE [] END, coalesce(aliases, []))) AS name FROM u)
      SELECT z.target AS entity_id, o.canonical_name, merged, coalesce(n, 0) AS aliases, f AS first_alias FROM (SELECT target, count(final) AS merged FROM u GROUP BY 1) z JOIN (SELECT entity_id, canonical_name FROM u) o ON o.entity_id = z.target
      LEFT JOIN (SELECT target, count(*) AS n, min(name) AS f FROM a WHERE trim(name) <> '' GROUP BY 1) w ON w.target = z.target""",
    "pruned_hints": f"""WITH b AS (SELECT {KEY % 'canonical_name'} AS key FROM entity_seed WHERE seed_status = 'blocked_seed') SELECT s.entity_id, count(h.entity_id) FILTER (coalesce(h.key NOT IN (SELECT key FROM b WHERE key IS NOT NULL), true)) AS kept,
      count(h.entity_id) FILTER (h.key IN (SELECT key FROM b)) AS pruned FROM {_SEEDS} s LEFT JOIN {_HINTS} h ON h.entity_id = s.entity_id WHERE s.seed_status <> 'blocked_seed' GROUP BY 1""",
    "decided_candidates": f"""WITH h AS (SELECT {KEY % 'source_entity_name'} AS key, arg_max(review_status, (created_at_utc, proposal_id)) AS d FROM identity_merges GROUP BY 1), a AS (SELECT {KEY % 'target_entity_name'} AS key, arg_max(status, (coalesce(epoch_us(created_at_utc), -9e18), claim_id)) AS d FROM claims WHERE status IN ('accepted', 'rejected', 'defer') GROUP BY 1),
      c AS (SELECT candidate_id, {KEY % 'candidate_name'} AS key FROM entity_candidates) SELECT candidate_id, CASE WHEN h.d IN ('accept', 'approve') THEN 'accepted' ELSE coalesce(h.d, a.d, 'pending') END AS decision, CASE WHEN h.d IS NOT NULL THEN 'reviewer' WHEN a.d IS NOT NULL THEN 'auto' ELSE 'none' END AS by
      FROM c LEFT JOIN h ON h.key = c.key AND c.key <> '' LEFT JOIN a ON a.key = c.key AND c.key <> ''""",
    "carried_notes": f"""WITH c AS (SELECT candidate_id, {KEY % 'candidate_name'} AS key, confidence, first_seen_timestamp_utc AS t FROM entity_candidates WHERE first_seen_timestamp_utc IS NOT NULL), b AS (SELECT key, arg_max(confidence, (t, candidate_id)) AS noted FROM c WHERE t < TIMESTAMPTZ '2025-01-01 00:00:00+00' AND confidence IS NOT NULL AND key <> '' GROUP BY 1)
      SELECT candidate_id, coalesce(noted, confidence) AS confidence, noted IS NOT NULL AS carried FROM c LEFT JOIN b USING (key) WHERE t >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND key <> ''""",
    "note_items": f"""WITH m AS (SELECT DISTINCT conversation_id, message_id FROM {DISTINCT} WHERE conversation_id IS NOT NULL), s AS (SELECT *, list_distinct(coalesce(message_ids, [])) AS ids FROM conversation_segments), l AS (SELECT conversation_id, unnest(ids) AS message_id FROM s),
      b AS (SELECT m.conversation_id, count(*) AS c, count(l.message_id) AS n, count(l.message_id) FILTER (regexp_matches(m.message_id, '[02468]$')) AS i FROM m LEFT JOIN l USING (conversation_id, message_id) GROUP BY 1),
      k AS (SELECT s.conversation_id, CASE track WHEN 'lore' THEN 'lore_development' WHEN 'meta' THEN 'meta_development' ELSE 'open_question' END AS item, array_to_string(coalesce(anchor_entities, []), ', ') AS anchors, coalesce(topic_label, '') AS label, trim(coalesce(topic_summary, ''), ' ') AS summary, len(list_filter(ids, lambda x: regexp_matches(x, '[02468]$'))) AS asked,
        coalesce(b.c, 0) AS c, coalesce(b.n, 0) AS n, coalesce(b.i, 0) AS i FROM s LEFT JOIN b USING (conversation_id))
      SELECT conversation_id, item, md5(CASE WHEN item = 'lore_development' AND anchors <> '' THEN anchors || ': ' || summary WHEN item = 'meta_development' AND label <> '' THEN label || ': ' || summary ELSE summary END) AS text,
        CASE WHEN i > 0 THEN 'item' WHEN n > 0 THEN 'note' WHEN c > 0 THEN 'conversation' ELSE 'none' END AS support, CASE WHEN i > 0 THEN i WHEN n > 0 THEN n ELSE c END AS messages, i > 0 AND i = asked AS exact FROM k""",
    "trigger_pairs": f"""WITH n AS (SELECT name, min(entity_id) AS entity_id FROM (SELECT entity_id, {KEY % 'canonical_name'} AS name FROM entity_seed) WHERE name <> '' GROUP BY 1), t AS (SELECT unnest({list(TRIGGERS)}) AS name), w AS (SELECT doc_id, string_split({KEY % 'text'}, ' ') AS words FROM documents),
      z AS (SELECT DISTINCT len(string_split(name, ' ')) AS size FROM (SELECT name FROM n UNION ALL SELECT name FROM t)), g AS (SELECT doc_id, i, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS name FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, z WHERE len(words) >= size)),
      m AS (SELECT doc_id, i, i + size AS e, entity_id FROM g JOIN n USING (name)), f AS (SELECT doc_id, name, min(i) AS i, min(i) + any_value(size) AS e FROM g JOIN t USING (name) GROUP BY 1, 2),
      x AS (SELECT f.doc_id, f.name, arg_max(b.entity_id, (b.e, b.i)) AS before FROM f JOIN m b ON b.doc_id = f.doc_id AND b.e <= f.i GROUP BY 1, 2), y AS (SELECT f.doc_id, f.name, arg_min(a.entity_id, (a.i, a.e)) AS after FROM f JOIN m a ON a.doc_id = f.doc_id AND a.i >= f.e GROUP BY 1, 2),
      p AS (SELECT CASE WHEN name IN ({", ".join(f"'{k}'" for k, v in TRIGGERS.items() if v)}) THEN after ELSE before END AS source, CASE WHEN name IN ({", ".join(f"'{k}'" for k, v in TRIGGERS.items() if v)}) THEN before ELSE after END AS target, name AS trigger FROM x JOIN y USING (doc_id, name))
      SELECT source, target, trigger, count(*) AS texts FROM p WHERE source <> target GROUP BY 1, 2, 3""",
    "prior_claims": """SELECT claim_id, coalesce(array_to_string(list(claim_id) OVER (PARTITION BY target_entity_id ORDER BY created_at_utc NULLS FIRST, claim_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS prior FROM claims WHERE target_entity_id IS NOT NULL""",
    "name_profiles": f"""WITH c AS (SELECT *, {KEY % 'candidate_name'} AS key, row_number() OVER (ORDER BY first_seen_timestamp_utc NULLS FIRST, candidate_id) AS o FROM entity_candidates), s AS (SELECT key, count(DISTINCT s) AS n FROM (SELECT key, unnest(source_snippet_ids) AS s FROM c) GROUP BY 1)
      SELECT c.key, arg_min(candidate_name, o) AS label, arg_max(proposed_entity_type, o) FILTER (proposed_entity_type IS NOT NULL) AS type, max(confidence) AS confidence, count(*) AS candidates, coalesce(any_value(s.n), 0) AS snippets FROM c LEFT JOIN s ON s.key = c.key WHERE c.key <> '' GROUP BY 1""",
    "evidence_packets": f"""WITH a AS (SELECT 0 AS source, claim_id AS id, confidence AS score, {KEY % 'claim_text'} AS key FROM claims WHERE status = 'accepted' AND confidence IS NOT NULL ORDER BY score DESC, id LIMIT 40), b AS (SELECT 1, candidate_id, confidence, {KEY % 'candidate_name'} FROM entity_candidates WHERE confidence IS NOT NULL ORDER BY confidence DESC, candidate_id LIMIT 40),
      c AS (SELECT 2, conversation_id, relevance_confidence, {KEY % 'topic_summary'} FROM conversation_segments WHERE relevance_confidence IS NOT NULL ORDER BY relevance_confidence DESC, conversation_id LIMIT 40), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
      SELECT source, id, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, id) AS n FROM u WHERE key <> '') WHERE n = 1 ORDER BY source, score DESC, id LIMIT 90""",
    "tag_profiles": """WITH r AS (SELECT claim_id, status = 'draft' AS new, claim_type, confidence, knowledge_track, unnest(thematic_tags) AS tag FROM claims WHERE status IN ('accepted', 'draft'))
      SELECT tag, arg_max(claim_type, (new, claim_id)) FILTER (claim_type IS NOT NULL) AS type, max(confidence) AS confidence, coalesce(array_to_string(list_sort(list(DISTINCT knowledge_track) FILTER (knowledge_track IS NOT NULL)), ','), '') AS tracks, bool_and(new) AS added FROM r GROUP BY 1""",
    "page_entries": f"""WITH s AS (SELECT entity_id, replace({KEY % 'canonical_name'}, ' ', '-') AS base, entity_type, row_number() OVER (PARTITION BY {KEY % 'canonical_name'} ORDER BY entity_id) AS n FROM (SELECT DISTINCT entity_id, canonical_name, entity_type FROM entity_seed WHERE seed_status = 'active' AND canonical_name IS NOT NULL)),
      k AS (SELECT *, CASE WHEN n > 1 THEN base || '-' || n ELSE base END AS slug FROM s) SELECT entity_id, slug, 'entities/' || slug || '.html' AS path, coalesce(entity_type, 'term') AS kind FROM k""",
    "cluster_edges": """WITH e AS (SELECT source_entity_id AS entity_id, 0 AS far, * FROM identity_merges UNION ALL SELECT target_entity_id, 1, * FROM identity_merges)
      SELECT entity_id, proposal_id, far = 0 AS own FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY far, review_status <> 'approve' NULLS FIRST, coalesce(confidence, 0) DESC, proposal_id) AS n FROM e WHERE entity_id IS NOT NULL) WHERE n = 1""",
    "entity_memory": f"""WITH n AS (SELECT {KEY % 'canonical_name'} AS key, min(entity_id) AS entity_id FROM entity_seed GROUP BY 1), u AS (SELECT claim_id, status, target_entity_id AS entity_id FROM claims WHERE target_entity_id IN (SELECT entity_id FROM entity_seed)
      UNION SELECT claim_id, status, n.entity_id FROM claims JOIN n ON n.key = {KEY % 'target_entity_name'} AND n.key <> '') SELECT entity_id, status, count(*) AS claims FROM u GROUP BY 1, 2""",
    "entity_relations": f"""WITH n AS (SELECT {KEY % 'canonical_name'} AS key, min(entity_id) AS other FROM entity_seed GROUP BY 1), e AS (SELECT h.entity_id, other, relation FROM {_HINTS} h JOIN n USING (key))
      SELECT entity_id, relation, count(*) AS relations FROM (SELECT entity_id, relation FROM e UNION ALL SELECT other, relation FROM e WHERE other <> entity_id) GROUP BY 1, 2""",
    "alias_groups": f"""WITH r AS (SELECT target_entity_id, {CLEAN % 'alias_text'} AS alias, max(confidence) AS confidence, count(*) AS n FROM claims WHERE alias_text IS NOT NULL AND target_entity_id IS NOT NULL AND status IN ('draft', 'defer') GROUP BY 1, 2)
      SELECT target_entity_id, array_to_string(list_slice(list_sort(list(alias)), 1, 5), '|') AS first, count(*) AS aliases, CAST(sum(n) AS BIGINT) AS claims, max(confidence) AS confidence FROM r GROUP BY 1""",
    "tag_owners": f"""WITH r AS (SELECT unnest(thematic_tags) AS tag, knowledge_track, {KEY % 'target_entity_name'} AS target FROM claims WHERE status = 'accepted' AND target_entity_name IS NOT NULL) SELECT tag, knowledge_track, count(DISTINCT target) AS targets, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS owner FROM r GROUP BY 1, 2""",
    "entity_tags": f"""WITH t AS (SELECT {KEY % 'target_entity_name'} AS name, coalesce(confidence, 0) AS c, unnest(list_distinct(thematic_tags)) AS tag FROM claims), b AS (SELECT entity_id, tag, max(c) AS confidence FROM {_SPELLED} s JOIN t USING (name) WHERE name <> '' GROUP BY 1, 2)
      SELECT entity_id, tag, confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, tag) AS rank FROM b) WHERE rank <= 8""",
    "tagged_segments": "WITH s AS (SELECT CASE WHEN track = 'lore' THEN 'strict' ELSE 'rescue' END AS scope, * FROM conversation_segments) SELECT scope, conversation_id, row_number() OVER (ORDER BY timestamp_start_utc NULLS FIRST, timestamp_end_utc NULLS FIRST, scope, conversation_id) AS seq FROM s",
    "all_decisions": "SELECT claim_id, CASE WHEN status IN ('accepted', 'rejected') THEN status WHEN confidence >= 0.65 THEN 'accepted' ELSE 'defer' END AS decision, CASE WHEN status IN ('accepted', 'rejected') THEN 'made' ELSE 'default' END AS by FROM claims",
    "ledger_split": "SELECT CASE WHEN created_at_utc < TIMESTAMPTZ '2025-03-01 00:00:00+00' THEN 'pinned' ELSE 'open' END AS part, count(*) AS claims, count(DISTINCT target_entity_id) AS targets, min(epoch_us(created_at_utc)) AS first_us, max(epoch_us(created_at_utc)) AS last_us FROM claims GROUP BY 1",
    "candidate_owners": f"""WITH x AS (SELECT {KEY % 'canonical_name'} AS key, min(entity_id) AS same FROM entity_seed GROUP BY 1), o AS (SELECT name, min(entity_id) AS entity_id FROM {_SPELLED} WHERE length(name) >= 4 GROUP BY 1), c AS (SELECT candidate_id, {KEY % 'candidate_name'} AS key FROM entity_candidates),
      p AS (SELECT candidate_id, arg_max(entity_id, (length(name), name)) AS part FROM c JOIN o ON contains(' ' || c.key || ' ', ' ' || o.name || ' ') GROUP BY 1)
      SELECT c.candidate_id, coalesce(same, part) AS entity_id, CASE WHEN same IS NOT NULL THEN 'name' WHEN part IS NOT NULL THEN 'part' ELSE 'none' END AS by FROM c LEFT JOIN x ON x.key = c.key AND c.key <> '' LEFT JOIN p USING (candidate_id)""",
    "evidence_bundles": """WITH r AS (SELECT target_entity_id, claim_id, source_snippet_ids AS s, thematic_tags AS t, row_number() OVER (PARTITION BY target_entity_id ORDER BY coalesce(confidence, 0) DESC, claim_id) AS n FROM claims WHERE status = 'accepted' AND target_entity_id IS NOT NULL)
      SELECT target_entity_id, array_to_string(list_sort(list(claim_id)), ',') AS claims, CAST(len(list_distinct(flatten(list(coalesce(s, []))))) AS BIGINT) AS snippets, CAST(len(list_distinct(flatten(list(coalesce(t, []))))) AS BIGINT) AS tags FROM r WHERE n <= 5 GROUP BY 1""",
    "unreserved_claims": """WITH q AS (SELECT DISTINCT unnest(source_snippet_ids) AS s FROM claims WHERE claim_type = 'open_question' AND status = 'draft'), w AS (SELECT claim_id, source_snippet_ids FROM claims WHERE status IN ('draft', 'defer') AND claim_type <> 'open_question'),
      h AS (SELECT DISTINCT claim_id FROM (SELECT claim_id, unnest(source_snippet_ids) AS s FROM w) JOIN q USING (s)) SELECT DISTINCT claim_id FROM w WHERE claim_id NOT IN (SELECT claim_id FROM h)""",
    "accepted_windows": f"""WITH RECURSIVE z AS (SELECT model_window_max_messages AS m, model_window_max_chars AS k FROM pipeline_config WHERE enabled AND section = 'theme_aware_rerun' ORDER BY config_id LIMIT 1), l AS (SELECT DISTINCT conversation_id, unnest(message_ids) AS message_id FROM conversation_segments),
      o AS (SELECT conversation_id, greatest(length(text), 1) AS chars, row_number() OVER (PARTITION BY conversation_id ORDER BY us NULLS FIRST, message_id, thread_id) AS i FROM l JOIN {DISTINCT} USING (conversation_id, message_id)),
      f AS (SELECT conversation_id, i, 1 AS part_no, 1 AS held, chars AS total, chars FROM o WHERE i = 1 UNION ALL SELECT o.conversation_id, o.i, CASE WHEN held >= m OR total + o.chars > k THEN part_no + 1 ELSE part_no END, CASE WHEN held >= m OR total + o.chars > k THEN 1 ELSE held + 1 END,
        CASE WHEN held >= m OR total + o.chars > k THEN o.chars ELSE total + o.chars END, o.chars FROM f JOIN o ON o.conversation_id = f.conversation_id AND o.i = f.i + 1, z)
      SELECT conversation_id, CAST(part_no AS BIGINT) AS part_no, count(*) AS messages, CAST(sum(chars) AS BIGINT) AS chars FROM f GROUP BY 1, 2""",
    "tiered_mentions": f"""WITH m AS ({_OTHERS['entity_mentions']}) SELECT doc_id, CASE WHEN entity_id IS NOT NULL THEN 1 ELSE 2 END AS tier, CASE WHEN entity_id IS NOT NULL THEN 1 ELSE n END AS entities FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM m GROUP BY 1) k USING (doc_id) WHERE entity_id IS NOT NULL OR n > 0""",
    "claim_prose": r"""WITH r AS (SELECT claim_id, claim_text, regexp_replace(claim_text, '(?i)(^|[^A-Za-z0-9])\Q' || alias_text || '\E($|[^A-Za-z0-9])', '\1' || target_entity_name || '\2', 'g') AS t FROM claims WHERE alias_text <> '' AND target_entity_name IS NOT NULL AND claim_text IS NOT NULL)
      SELECT claim_id, md5(t) AS text, t <> claim_text AS changed FROM r""",
}
