"""Queries that score, classify, project and select rows of the domain tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import columns as C
from skeinflow.operators import matching, ranking, scoring
from skeinflow.operators.skew import lookup_join
from skeinflow.plans import messages
from skeinflow.plans.messages import DISTINCT
from skeinflow.plans.normalising import CLEAN, KEY, STORY_WORDS, WORK_WORDS
from skeinflow.runtime import table

STOP_WORDS = ["this", "that", "with", "from", "then", "have", "month", "appears", "segments"]
INTENT = r"\b(i|we)\b.{0,24}\b(need|should|could|plan|planning|schedule|pause|ship|release)\b"
GENERIC = ["architect", "beast", "general", "player", "the stranger", "the narrator"]


def _n(name: str):
    return F.count(F.lit(1)).alias(name)


def _list(column: str):
    return F.coalesce(column, F.array().cast("array<string>"))


def _any_word(text, words):
    return scoring.keyword_hits(text, words) > 0


def shaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim texts as candidate names, clipped lines, paragraphs, and without sentences that speculate."""
    t = F.col("claim_text")
    return table(spark, sf_dir, "claims").where("claim_text IS NOT NULL").select("claim_id", C.ellipsis(t, 40).alias("clipped"), F.md5(C.paragraphs(t)).alias("paragraphs"), F.md5(C.without_sentences(t, r"(?i)briefly|perhaps|though")).alias("sober"))


def shaped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate names without repeated words, as they are shown, and with their aliases' separators cleaned."""
    name = C.clean_text(F.col("candidate_name"))
    shown = C.display_name(F.when(name.rlike("^[A-Za-z ]*$"), name), {"house vushaefitick": "House of Vushaefitick"})
    return table(spark, sf_dir, "entity_candidates").where("candidate_name IS NOT NULL").select("candidate_id", shown.alias("shown"), C.slug(F.col("candidate_name")).alias("slug"))


def shaped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias lists trimmed and without repetition, at most three; tags and snippets of claims as one map of lists."""
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name", "aliases").distinct()
    return seeds.select("entity_id", F.array_join(C.clean_list(F.concat(F.array("canonical_name"), _list("aliases")), 3), "|").alias("names"))


def list_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support lists of each claim: its tags under their current name, its snippets added to both sections."""
    rows = table(spark, sf_dir, "claims").select("claim_id", _list("thematic_tags").alias("t"), _list("source_snippet_ids").alias("s"))
    old = C.rename_keys(F.create_map(F.lit("old_tags"), F.col("t"), F.lit("notes"), F.col("s")), {"old_tags": "tags"})
    merged = C.merge_list_maps(old, F.create_map(F.lit("tags"), F.array_union("s", "t"), F.lit("extra"), F.col("t")))
    return rows.select("claim_id", *[F.array_join(F.try_element_at(merged, F.lit(k)), ",").alias(k) for k in ("tags", "notes", "extra")])


def stamped_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written out with and without offset and read again: seconds of the same moment."""
    rows = table(spark, sf_dir, "claims").select("claim_id", F.date_format("created_at_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("s"))
    return rows.select("claim_id", F.unix_seconds(C.utc(F.concat("s", F.lit("+02:00")))).alias("ahead"), F.unix_seconds(C.utc(F.col("s"))).alias("plain"))


def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first year a text names, the step it speaks of, and its route."""
    low = F.lower("text")
    step = F.when(low.rlike(r"\bfirst\b"), 1).when(low.rlike(r"\bnext\b"), 2).otherwise(C.number_after(F.col("text"), "step"))
    route = F.when(low.rlike(r"\bpublic route\b"), "public").when(low.rlike(r"\broute\b"), "other").otherwise("none")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", C.number_after(F.col("text"), "year").cast("long").alias("year"), step.cast("long").alias("step"), route.alias("route"))


def segment_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each segment: its named entities and its label, each once, at most 20."""
    anchors = F.slice(F.array_distinct(F.filter(F.concat(_list("anchor_entities"), F.array("topic_label")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))), 1, 20)
    return table(spark, sf_dir, "conversation_segments").select("conversation_id", F.array_join(anchors, "|").alias("anchors"), F.size(anchors).cast("long").alias("n"))


def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as one line each: a prefix for their kind, and the name unless the text begins with it."""
    text = C.clean_text(F.coalesce("claim_text", F.lit("")))
    name = F.coalesce(C.clean_text(F.col("target_entity_name")), F.lit("unknown"))
    line = F.when(F.lower(text).startswith(F.lower(name)), text).otherwise(F.concat(name, F.lit(": "), text))
    return table(spark, sf_dir, "claims").select("claim_id", F.md5(F.concat(F.lit("["), F.coalesce("claim_type", F.lit("other")), F.lit("] "), line)).alias("line"))


def review_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question to the reviewer of each candidate."""
    kind = F.coalesce("proposed_entity_type", F.lit("name"))
    ask = F.when(F.col("confidence") >= 0.7, F.lit("Is %s the %s it seems to be?")).otherwise(F.lit("What is %s: a %s, or none?"))
    return table(spark, sf_dir, "entity_candidates").where("candidate_name IS NOT NULL").select("candidate_id", F.replace(F.replace(F.regexp_replace(ask, "%s(.*)%s", "\u0001$1\u0002"), F.lit("\u0001"), F.col("candidate_name")), F.lit("\u0002"), kind).alias("question"))


def evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target's first three claims by evidence: those of the track it mostly has first, missing confidence last."""
    track = F.when(F.col("claim_type").isin("theme", "open_question"), "meta").otherwise("lore")
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("target_entity_id", "claim_id", track.alias("track"), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1e9)).alias("at"))
    return ranking.top_per_key(rows, ["target_entity_id"], [F.col("track"), F.col("at"), F.col("claim_id")], 3).select("target_entity_id", "claim_id", "track", F.col("rank").cast("long").alias("rank"))


def entity_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of an entity, nested fields included, as one: names, aliases, relations and notes."""
    hints = F.transform(F.coalesce("relationship_hints", F.expr("CAST(array() AS array<struct<target_name:string,relation_type:string,note:string>>)")), lambda h: F.concat_ws(" ", h["target_name"], h["relation_type"], F.nullif(h["note"], F.lit(""))))
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name", "aliases", "relationship_hints").distinct()
    return seeds.select("entity_id", F.concat_ws(" / ", F.array("canonical_name"), _list("aliases"), hints).alias("blob"))


def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations worth a model: those with a keyword, a stated intent or a known name in one of their messages, and why."""
    rows = messages.said(spark, sf_dir).where("conversation_id IS NOT NULL").select("conversation_id", "text")
    names = table(spark, sf_dir, "entity_seed").select("entity_id", "canonical_name").distinct()
    named = matching.mentions(rows, "conversation_id", "text", names, "entity_id", "canonical_name").select("conversation_id").distinct().withColumn("named", F.lit(True))
    low = F.lower("text")
    by = rows.groupBy("conversation_id").agg(F.bool_or(_any_word(low, [*STORY_WORDS, *WORK_WORDS])).alias("word"), F.bool_or(low.rlike(INTENT)).alias("intent"))
    joined = by.join(named, "conversation_id", "left")
    why = C.flags(word=F.col("word"), intent=F.col("intent"), name=F.col("named"))
    return joined.select("conversation_id", F.array_join(why, ",").alias("why")).where("why <> ''")


def segment_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each segment's label and anchors (words of four letters or more, stop words out) that its summary has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9'-]{3,}"), 0))
    terms = F.array_except(words(F.concat_ws(" ", F.array("topic_label"), _list("anchor_entities"))), F.array(*[F.lit(w) for w in STOP_WORDS]))
    hit = F.array_sort(F.array_intersect(terms, words(F.coalesce("topic_summary", F.lit("")))))
    return table(spark, sf_dir, "conversation_segments").select("conversation_id", F.size(terms).cast("long").alias("terms"), F.array_join(hit, ",").alias("matched"))


def candidate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each candidate, what class and action follow from them, and on which track: rules in order."""
    seeds = table(spark, sf_dir, "entity_seed").select("canonical_name", "aliases", "seed_status").distinct()
    names = seeds.groupBy(C.name_key(F.col("canonical_name")).alias("key")).agg(F.max(F.col("seed_status") != "active").alias("blocked"))
    alias = seeds.select(F.explode("aliases").alias("a")).select(C.name_key(F.col("a")).alias("key")).where("key <> ''").distinct().withColumn("alias", F.lit(True))
    key = C.name_key(F.col("candidate_name"))
    rows = table(spark, sf_dir, "entity_candidates").select("candidate_id", key.alias("key"), "proposed_entity_type", F.coalesce("evidence_count", F.lit(0)).alias("evidence"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    joined = lookup_join(lookup_join(rows, names.withColumn("known", F.lit(True)), "key", "left"), alias, "key", "left")
    flags = C.flags(
        known=F.col("known"), blocked=F.col("blocked"), alias=F.col("alias"), generic=F.col("key").isin(GENERIC), single_word=F.size(F.split("key", " ")) == 1, frequent=F.col("evidence") >= 3,
        once=F.col("evidence") <= 1, sure=F.col("confidence") >= 0.75, weak=F.col("confidence") < 0.35, typed=F.col("proposed_entity_type").isin("character", "location", "organization", "faction"), unnamed=F.coalesce(F.col("key") == "", F.lit(True)), digits=F.col("key").rlike("[0-9]"),
    )
    kind = C.first_reason(("none", F.coalesce(F.col("key") == "", F.lit(True))), ("removed", F.col("blocked")), ("own", F.col("known") | F.col("alias")), ("phrase", F.col("key").isin(GENERIC)), ("likely", (F.col("evidence") >= 3) & (F.col("confidence") >= 0.35)))
    kind = F.coalesce(kind, F.lit("unclear"))
    action = F.when(kind.isin("none", "removed", "phrase"), "drop").when(kind == "own", "link").when(kind == "likely", "create").otherwise("ask")
    return joined.select("candidate_id", F.array_join(flags, ",").alias("signals"), kind.alias("kind"), action.alias("action"), F.when(F.col("proposed_entity_type") == "term", "meta").otherwise("lore").alias("track"))


def name_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of thing a candidate's name stands for, by the first rule that holds, and whether it is left out of the inventory."""
    key = C.name_key(F.col("candidate_name"))
    kind = C.first_reason(("missing", F.coalesce(key == "", F.lit(True))), ("phrase", key.isin(GENERIC) | (F.size(F.split(key, " ")) > 5)), ("place", key.rlike(r"\b(port|mount|harbour|saint|cafe)\b")), ("group", key.rlike(r"\b(guild|house|order|association|university|corporation|observatory)\b")))
    kind = F.coalesce(kind, F.lit("person"))
    return table(spark, sf_dir, "entity_candidates").select("candidate_id", kind.alias("kind"), kind.isin("missing", "phrase").alias("suppressed"))


def tagging_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with design signals, those of the meta track first, the first 60 of each language."""
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").where(low.rlike("chapter|playtest|shader|quest")).select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce(F.col("knowledge_track") == "meta", F.lit(False)).alias("meta"))
    return ranking.top_per_key(rows, ["lang"], [F.desc("meta"), F.col("doc_id")], 60).select("lang", "doc_id", "meta")


def theme_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that may speak for a theme: not rejected, not of the meta track, not of a class that never does."""
    return table(spark, sf_dir, "claims").where(~F.coalesce(F.col("status").isin("rejected", "defer"), F.lit(False)) & ~F.coalesce(F.col("knowledge_track") == "meta", F.lit(False)) & ~F.coalesce(F.col("claim_type").isin("alias", "other"), F.lit(False))).groupBy("claim_type").agg(_n("claims"), F.sum(F.size(_list("thematic_tags"))).alias("tags"))


def signal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a signal: an anchor, or a document made of their conversation."""
    docs = table(spark, sf_dir, "documents").where("conversation_id IS NOT NULL").groupBy("conversation_id").agg(_n("documents"))
    rows = table(spark, sf_dir, "conversation_segments").join(docs, "conversation_id", "left")
    return rows.where((F.size(_list("anchor_entities")) > 0) | (F.col("documents") > 0)).select("conversation_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


def dropped_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity proposals that can't be taken, with the first reason: an end that is unknown, pointless, without evidence, or unsure."""
    known = table(spark, sf_dir, "entity_seed").select(F.col("entity_id").alias("end")).where("end IS NOT NULL").distinct().withColumn("_ok", F.lit(True))
    rows = table(spark, sf_dir, "identity_merges").select("proposal_id", "source_entity_id", "target_entity_id", "confidence", F.size(_list("evidence_claim_ids")).alias("evidence"))
    for side in ("source", "target"):
        rows = lookup_join(rows.withColumn("end", F.col(f"{side}_entity_id")), known, "end", "left").withColumnRenamed("_ok", f"{side}_ok").drop("end")
    reason = C.first_reason(("unknown_source", F.col("source_ok").isNull()), ("unknown_target", F.col("target_ok").isNull()), ("pointless", F.col("source_entity_id") == F.col("target_entity_id")), ("no_evidence", F.col("evidence") == 0), ("unsure", F.coalesce("confidence", F.lit(0.0)) < 0.6))
    return rows.select("proposal_id", reason.alias("reason")).where("reason IS NOT NULL")


def action_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identity proposal as an action: all errors that keep it from being applied, and whether it is valid."""
    claims = table(spark, sf_dir, "claims").select("claim_id").distinct().withColumn("_there", F.lit(True))
    names = table(spark, sf_dir, "entity_seed").select(C.name_key(F.col("canonical_name")).alias("key")).where("key <> ''").distinct().withColumn("_named", F.lit(True))
    rows = table(spark, sf_dir, "identity_merges").select("proposal_id", C.name_key(F.col("source_entity_name")).alias("key"), "target_entity_id", "evidence_claim_ids")
    cited = lookup_join(rows.select("proposal_id", F.explode(F.array_distinct(_list("evidence_claim_ids"))).alias("claim_id")), claims, "claim_id", "left")
    lost = cited.groupBy("proposal_id").agg(_n("cited"), F.sum(F.col("_there").isNull().cast("long")).alias("lost"))
    joined = lookup_join(rows, names, "key", "left").join(lost, "proposal_id", "left")
    errors = C.flags(source_unresolved=F.col("_named").isNull(), target_missing=F.col("target_entity_id").isNull(), no_claims=F.col("cited").isNull(), unknown_claims=F.col("lost") > 0)
    return joined.select("proposal_id", F.array_join(errors, ",").alias("errors"), (F.size(errors) == 0).alias("valid"))


def segment_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments classified by what they say of themselves: at least 0.82, their own confidence or the keywords' score; mixed ones are lore."""
    text = F.concat_ws(" ", "topic_label", "topic_summary")
    hits = {"story": scoring.keyword_hits(text, STORY_WORDS), "work": scoring.keyword_hits(text, WORK_WORDS)}
    heuristic = scoring.weighted_score(hits, {"story": 0.24, "work": 0.12}, -0.05)
    track = F.lower(F.trim("track"))
    trusted = track.isin("lore", "meta", "mixed")
    own = F.when(hits["story"] + hits["work"] == 0, "unknown").when(hits["work"] > 0, "meta").otherwise("lore")
    score = F.when(trusted, F.greatest(F.lit(0.82), F.least(F.lit(1.0), F.coalesce("relevance_confidence", F.lit(0.82))), heuristic)).otherwise(heuristic)
    return table(spark, sf_dir, "conversation_segments").select("conversation_id", F.round(score, 6).alias("score"), F.when(track == "mixed", "lore").when(trusted, track).otherwise(own).alias("track"))


def fallback_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents when no model answers: a weak prior from keywords, kept between bounds."""
    t = F.col("text")
    story, work = scoring.keyword_hits(t, STORY_WORDS), scoring.keyword_hits(t, WORK_WORDS)
    intent = F.lower(F.coalesce(t, F.lit(""))).rlike(INTENT).cast("int")
    prior = scoring.weighted_score({"s": story, "w": work}, {"s": 0.24, "w": 0.12}, -0.05)
    meta = F.greatest(F.lit(0.38), F.least(F.lit(0.72), F.lit(0.2) + F.lit(0.16) * intent + F.lit(0.44) * prior))
    lore = F.greatest(F.lit(0.38), F.least(F.lit(0.76), F.lit(0.18) + F.lit(0.62) * prior))
    kind = F.when((work > 0) & (intent > 0) & (prior >= 0.1), "meta").when((story > 0) & (work == 0) & (prior >= 0.4) & (intent == 0), "lore").otherwise("unknown")
    score = F.when(kind == "meta", meta).when(kind == "lore", lore).otherwise(F.least(F.lit(0.34), F.lit(0.2) + F.lit(0.2) * prior))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.round(score, 4).alias("score"))


def document_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work a document belongs to: most hints, those of side works counting twice; the main one where there is none."""
    t = F.col("text")
    scores = [("patches", 2 * scoring.keyword_hits(t, ["patch", "build", "typos"])), ("playtests", 2 * scoring.keyword_hits(t, ["playtest", "door"])), ("chronicle", scoring.keyword_hits(t, STORY_WORDS))]
    top = F.greatest(*[s for _, s in scores])
    work = C.first_reason(*[(n, (s == top) & (top > 0)) for n, s in scores])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(work, F.lit("chronicle")).alias("work"), top.cast("long").alias("hints"))


def document_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track for every document: what is noted, else what its conversation's segment says, else what its words suggest."""
    segments = table(spark, sf_dir, "conversation_segments").where("track IN ('lore', 'meta')").groupBy("conversation_id").agg(F.min("track").alias("of_segment"))
    t = F.col("text")
    guess = F.when(scoring.keyword_hits(t, WORK_WORDS) > scoring.keyword_hits(t, STORY_WORDS), "meta").otherwise("lore")
    rows = table(spark, sf_dir, "documents").select("doc_id", "conversation_id", "knowledge_track", guess.alias("guess"))
    joined = lookup_join(rows, segments, "conversation_id", "left")
    by = F.when(F.col("knowledge_track").isNotNull(), "noted").when(F.col("of_segment").isNotNull(), "segment").otherwise("words")
    return joined.select("doc_id", F.coalesce("knowledge_track", "of_segment", "guess").alias("track"), by.alias("by"))


def entity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by how many different accepted snippets they have: tiers and the words a text about them may take."""
    seeds = table(spark, sf_dir, "entity_seed").select("entity_id").distinct()
    cited = table(spark, sf_dir, "claims").where("status = 'accepted' AND target_entity_id IS NOT NULL").select(F.col("target_entity_id").alias("entity_id"), F.explode("source_snippet_ids").alias("s")).distinct().groupBy("entity_id").agg(_n("snippets"))
    n = F.coalesce("snippets", F.lit(0)).cast("long")
    tier = F.when(n >= 80, "main").when(n >= 12, "major").when(n >= 4, "minor").otherwise("stub")  # fixed values
    return seeds.join(cited, "entity_id", "left").select("entity_id", n.alias("snippets"), tier.alias("tier"), F.least(F.lit(1200), 80 + 40 * n).cast("long").alias("words"))


def directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer notes read as operations: what to keep or drop, what moved, what was merged."""
    t = F.coalesce("text", F.lit(""))
    note = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    keep = r"keep the ([a-z -]+) as canon, drop the ([a-z -]+)\."
    op = F.when(note(keep, 1).isNotNull(), "replace").when(note(r"Moved to backlog: ([^,\n]+)", 1).isNotNull(), "move").when(note(r"merged two cards about the ([a-z-]+)", 1).isNotNull(), "alias")
    about = F.coalesce(note(keep, 1), note(r"Moved to backlog: ([^,\n]+)", 1), note(r"merged two cards about the ([a-z-]+)", 1))
    return table(spark, sf_dir, "documents").select("doc_id", op.alias("operation"), about.alias("about"), note(keep, 2).alias("dropped")).where("operation IS NOT NULL")


def card_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards against their rules: words within bounds, no plans of work in the summary, no story in the last section, open questions with a question mark."""
    t = F.col("text")
    head = F.substring_index(t, "\n\n", 2)
    tail = F.substring_index(t, "\n\n", -1)
    words = C.word_count(t)
    found = C.flags(short=words < 40, long=words > 400, work_in_summary=_any_word(head, WORK_WORDS), story_in_last=_any_word(tail, STORY_WORDS) & ~_any_word(head, STORY_WORDS), unasked=F.contains(F.lower(t), F.lit("open question")) & ~F.contains(t, F.lit("?")))
    return table(spark, sf_dir, "documents").where("source = 'wiki_cards' AND text IS NOT NULL").select("doc_id", words.alias("words"), F.array_join(found, ",").alias("issues"))


def card_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of one track, the longest first: the first 20 with the words of all of them."""
    cards = table(spark, sf_dir, "documents").where("source = 'wiki_cards' AND knowledge_track = 'lore'").select("doc_id", C.word_count(F.col("text")).alias("words"))
    whole = cards.agg(F.coalesce(F.sum("words"), F.lit(0))).collect()[0][0]  # one number
    return cards.orderBy(F.desc("words"), "doc_id").limit(20).withColumn("of_all", F.lit(whole).cast("long"))


def log_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three lines of each transcript that report progress, at most 200 characters each."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[0-9]+"))
    tail = F.when(F.size(lines) > 3, F.slice(lines, -3, 3)).otherwise(lines)
    return table(spark, sf_dir, "documents").where("source IN ('session_transcripts', 'dm_export') AND text IS NOT NULL").select("doc_id", F.md5(F.array_join(F.transform(tail, lambda x: F.substring(x, 1, 200)), "\n")).alias("tail"), F.size(lines).cast("long").alias("lines"))


def tag_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by status of their claims, and how many targets each has."""
    rows = table(spark, sf_dir, "claims").select("status", "target_entity_id", F.explode("thematic_tags").alias("tag"))
    count = lambda s: F.sum(F.coalesce((F.col("status") == s).cast("long"), F.lit(0))).alias(s)
    return rows.groupBy("tag").agg(_n("claims"), count("accepted"), count("draft"), count("rejected"), F.countDistinct("target_entity_id").alias("targets"))


def claim_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior and weight of claims by what was decided before (fixed values), summed by target."""
    prior = F.when(F.col("status") == "accepted", 0.88).when(F.col("status") == "rejected", 0.25).otherwise(0.55)
    weight = F.when(F.col("status") == "accepted", 0.72).when(F.col("status") == "rejected", 0.42).otherwise(0.55)
    rows = table(spark, sf_dir, "claims").where("target_entity_id IS NOT NULL").select("target_entity_id", prior.alias("prior"), weight.alias("weight"))
    return rows.groupBy("target_entity_id").agg(_n("claims"), F.round(F.sum(F.col("prior") * F.col("weight")) / F.sum("weight"), 6).alias("prior"))


def hinted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents of each source with most hints, filled up with others where fewer have any."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", scoring.keyword_hits(F.col("text"), STORY_WORDS).cast("long").alias("hints"))
    return ranking.top_per_key(rows, ["source"], [F.desc("hints"), F.col("doc_id")], 5).select("source", "doc_id", "hints", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in [
        shaped_texts, shaped_names, shaped_lists, list_maps, stamped_claims, route_features, segment_anchors, claim_lines, review_questions, evidence_order, entity_blobs, candidate_windows, segment_terms, candidate_signals, name_kinds, tagging_pool, theme_evidence, signal_segments,
        dropped_proposals, action_checks, segment_trust, fallback_scores, document_work, document_tracks, entity_tiers, directives, card_checks, card_totals, log_tails, tag_overview, claim_priors, hinted_documents,
    ]
}


def _hits(words: list[str], text: str = "text") -> str:
    return "(" + " + ".join(f"CAST(contains(lower(coalesce({text}, '')), '{w}') AS INT)" for w in words) + ")"


_IN = "(" + ", ".join(f"'{g}'" for g in GENERIC) + ")"
_ANY = f"{_hits([*STORY_WORDS, *WORK_WORDS], 'text')} > 0"
_WORDS = "coalesce(len(regexp_extract_all(text, '[A-Za-z0-9_][''\\-A-Za-z0-9_]*')), 0)"
_SEED = "(SELECT DISTINCT entity_id, canonical_name, aliases, relationship_hints, seed_status FROM entity_seed)"
_PRIOR = f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, -0.05::DOUBLE + 0.24::DOUBLE * {_hits(STORY_WORDS, '{t}')} + 0.12::DOUBLE * {_hits(WORK_WORDS, '{t}')})), 6)"
_CLIP = CLEAN % "claim_text"
SQL = {
    "shaped_texts": f"""SELECT claim_id, CASE WHEN length({_CLIP}) <= 40 THEN {_CLIP} ELSE rtrim(substr({_CLIP}, 1, 37)) || '...' END AS clipped,
      md5(replace(trim(regexp_replace(regexp_replace(regexp_replace(claim_text, '\\r\\n?', chr(10), 'g'), '\\n[ \\t]*\\n\\s*', chr(1), 'g'), '[ \\t]*\\n[ \\t]*', ' ', 'g'), ' '), chr(1), chr(10) || chr(10))) AS paragraphs,
      md5(array_to_string(list_filter(string_split(regexp_replace(trim(claim_text, ' '), '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)briefly|perhaps|though')), ' ')) AS sober FROM claims WHERE claim_text IS NOT NULL""",
    "shaped_names": f"""WITH c AS (SELECT candidate_id, candidate_name, {CLEAN % 'candidate_name'} AS t FROM entity_candidates WHERE candidate_name IS NOT NULL)
      SELECT candidate_id, CASE WHEN NOT regexp_matches(t, '^[A-Za-z ]*$') THEN NULL WHEN {KEY % 't'} = 'house vushaefitick' THEN 'House of Vushaefitick' WHEN length(t) <= 8 AND t = upper(t) THEN t
        ELSE array_to_string(list_transform(string_split(t, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') END AS shown, replace({KEY % 'candidate_name'}, ' ', '-') AS slug FROM c""",
    "shaped_lists": f"""WITH n AS (SELECT entity_id, list_transform(list_prepend(canonical_name, coalesce(aliases, [])), lambda x: {CLEAN % 'x'}) AS l FROM {_SEED}), d AS (SELECT entity_id, list_filter(l, lambda x: coalesce(x, '') <> '') AS l FROM n)
      SELECT entity_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 3), '|') AS names FROM d""",
    "list_maps": """WITH r AS (SELECT claim_id, coalesce(thematic_tags, []) AS t, coalesce(source_snippet_ids, []) AS s FROM claims), u AS (SELECT *, list_concat(t, s) AS a FROM r)
      SELECT claim_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS tags, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS notes, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS extra FROM u""",
    "stamped_claims": "SELECT claim_id, CAST(floor(epoch_us(created_at_utc) / 1000000) AS BIGINT) - 7200 AS ahead, CAST(floor(epoch_us(created_at_utc) / 1000000) AS BIGINT) AS plain FROM claims",
    "route_features": """SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(?i)\\byear\\s+(\\d{1,9})\\b', 1), '') AS BIGINT) AS year, CASE WHEN regexp_matches(lower(text), '\\bfirst\\b') THEN 1 WHEN regexp_matches(lower(text), '\\bnext\\b') THEN 2
      ELSE TRY_CAST(nullif(regexp_extract(text, '(?i)\\bstep\\s+(\\d{1,9})\\b', 1), '') AS BIGINT) END AS step, CASE WHEN regexp_matches(lower(text), '\\bpublic route\\b') THEN 'public' WHEN regexp_matches(lower(text), '\\broute\\b') THEN 'other' ELSE 'none' END AS route
      FROM documents WHERE text IS NOT NULL""",
    "segment_anchors": """WITH l AS (SELECT conversation_id, list_filter(list_append(coalesce(anchor_entities, []), topic_label), lambda x: coalesce(trim(x), '') <> '') AS l FROM conversation_segments),
      d AS (SELECT conversation_id, list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 20) AS d FROM l) SELECT conversation_id, array_to_string(d, '|') AS anchors, CAST(len(d) AS BIGINT) AS n FROM d""",
    "claim_lines": f"""WITH c AS (SELECT claim_id, claim_type, {CLEAN % "coalesce(claim_text, '')"} AS t, coalesce({CLEAN % 'target_entity_name'}, 'unknown') AS n FROM claims)
      SELECT claim_id, md5('[' || coalesce(claim_type, 'other') || '] ' || CASE WHEN starts_with(lower(t), lower(n)) THEN t ELSE n || ': ' || t END) AS line FROM c""",
    "review_questions": """SELECT candidate_id, CASE WHEN confidence >= 0.7 THEN 'Is ' || candidate_name || ' the ' || coalesce(proposed_entity_type, 'name') || ' it seems to be?' ELSE 'What is ' || candidate_name || ': a ' || coalesce(proposed_entity_type, 'name') || ', or none?' END AS question
      FROM entity_candidates WHERE candidate_name IS NOT NULL""",
    "evidence_order": """WITH r AS (SELECT target_entity_id, claim_id, CASE WHEN claim_type IN ('theme', 'open_question') THEN 'meta' ELSE 'lore' END AS track, coalesce(nullif(confidence, 0), 1e9) AS place FROM claims WHERE target_entity_id IS NOT NULL)
      SELECT target_entity_id, claim_id, track, rank FROM (SELECT *, row_number() OVER (PARTITION BY target_entity_id ORDER BY track, place, claim_id) AS rank FROM r) WHERE rank <= 3""",
    "entity_blobs": f"""SELECT entity_id, array_to_string(list_filter(list_concat([canonical_name], coalesce(aliases, []), list_transform(coalesce(relationship_hints, []), lambda h: concat_ws(' ', h.target_name, h.relation_type, nullif(h.note, '')))), lambda x: x IS NOT NULL), ' / ') AS blob FROM {_SEED}""",
    "candidate_windows": f"""WITH m AS (SELECT conversation_id, text, string_split({KEY % 'text'}, ' ') AS words FROM {DISTINCT} WHERE conversation_id IS NOT NULL), k AS (SELECT DISTINCT {KEY % 'canonical_name'} AS name FROM entity_seed), z AS (SELECT DISTINCT len(string_split(name, ' ')) AS size FROM k WHERE name <> ''),
      g AS (SELECT conversation_id, array_to_string(list_slice(words, i, i + size - 1), ' ') AS name FROM (SELECT conversation_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM m, z WHERE len(words) >= size)),
      d AS (SELECT DISTINCT conversation_id FROM g JOIN k USING (name)), b AS (SELECT conversation_id, bool_or({_ANY}) AS word, bool_or(regexp_matches(lower(text), '{INTENT}')) AS intent FROM m GROUP BY 1),
      o AS (SELECT conversation_id, concat_ws(',', CASE WHEN word THEN 'word' END, CASE WHEN intent THEN 'intent' END, CASE WHEN conversation_id IN (SELECT conversation_id FROM d) THEN 'name' END) AS why FROM b) SELECT * FROM o WHERE why <> ''""",
    "segment_terms": f"""WITH s AS (SELECT conversation_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', topic_label, array_to_string(anchor_entities, ' '))), '[a-z][a-z0-9''-]{{3,}}')) AS t, regexp_extract_all(lower(coalesce(topic_summary, '')), '[a-z][a-z0-9''-]{{3,}}') AS w FROM conversation_segments),
      f AS (SELECT conversation_id, list_filter(t, lambda x: x NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})) AS t, w FROM s) SELECT conversation_id, CAST(len(t) AS BIGINT) AS terms, array_to_string(list_sort(list_filter(t, lambda x: list_contains(w, x))), ',') AS matched FROM f""",
    "candidate_signals": f"""WITH n AS (SELECT {KEY % 'canonical_name'} AS key, bool_or(seed_status <> 'active') AS blocked FROM entity_seed GROUP BY 1), a AS (SELECT DISTINCT {KEY % 'x'} AS key FROM (SELECT unnest(aliases) AS x FROM entity_seed)),
      c AS (SELECT candidate_id, {KEY % 'candidate_name'} AS key, proposed_entity_type AS kind_, coalesce(evidence_count, 0) AS e, coalesce(confidence, 0) AS p FROM entity_candidates),
      j AS (SELECT c.*, n.key IS NOT NULL AS known, coalesce(n.blocked, false) AS blocked, coalesce(c.key <> '' AND c.key IN (SELECT key FROM a WHERE key IS NOT NULL), false) AS alias FROM c LEFT JOIN n ON n.key = c.key),
      k AS (SELECT *, CASE WHEN coalesce(key, '') = '' THEN 'none' WHEN blocked THEN 'removed' WHEN known OR alias THEN 'own' WHEN key IN {_IN} THEN 'phrase' WHEN e >= 3 AND p >= 0.35 THEN 'likely' ELSE 'unclear' END AS kind FROM j)
      SELECT candidate_id, concat_ws(',', CASE WHEN known THEN 'known' END, CASE WHEN blocked THEN 'blocked' END, CASE WHEN alias THEN 'alias' END, CASE WHEN key IN {_IN} THEN 'generic' END, CASE WHEN len(string_split(key, ' ')) = 1 THEN 'single_word' END, CASE WHEN e >= 3 THEN 'frequent' END,
        CASE WHEN e <= 1 THEN 'once' END, CASE WHEN p >= 0.75 THEN 'sure' END, CASE WHEN p < 0.35 THEN 'weak' END, CASE WHEN kind_ IN ('character', 'location', 'organization', 'faction') THEN 'typed' END, CASE WHEN coalesce(key, '') = '' THEN 'unnamed' END, CASE WHEN regexp_matches(key, '[0-9]') THEN 'digits' END) AS signals,
        kind, CASE WHEN kind IN ('none', 'removed', 'phrase') THEN 'drop' WHEN kind = 'own' THEN 'link' WHEN kind = 'likely' THEN 'create' ELSE 'ask' END AS action, CASE WHEN kind_ = 'term' THEN 'meta' ELSE 'lore' END AS track FROM k""",
    "name_kinds": f"""WITH c AS (SELECT candidate_id, {KEY % 'candidate_name'} AS key FROM entity_candidates), k AS (SELECT candidate_id, CASE WHEN coalesce(key, '') = '' THEN 'missing' WHEN key IN {_IN} OR len(string_split(key, ' ')) > 5 THEN 'phrase'
      WHEN regexp_matches(key, '\\b(port|mount|harbour|saint|cafe)\\b') THEN 'place' WHEN regexp_matches(key, '\\b(guild|house|order|association|university|corporation|observatory)\\b') THEN 'group' ELSE 'person' END AS kind FROM c) SELECT *, kind IN ('missing', 'phrase') AS suppressed FROM k""",
    "tagging_pool": """WITH d AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(knowledge_track = 'meta', false) AS meta FROM documents WHERE regexp_matches(lower(text), 'chapter|playtest|shader|quest'))
      SELECT lang, doc_id, meta FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY meta DESC, doc_id) AS n FROM d) WHERE n <= 60""",
    "theme_evidence": """SELECT claim_type, count(*) AS claims, CAST(sum(coalesce(len(thematic_tags), 0)) AS BIGINT) AS tags FROM claims WHERE coalesce(status NOT IN ('rejected', 'defer'), true) AND coalesce(knowledge_track <> 'meta', true) AND coalesce(claim_type NOT IN ('alias', 'other'), true) GROUP BY 1""",
    "signal_segments": """SELECT conversation_id, coalesce(n, 0) AS documents FROM conversation_segments LEFT JOIN (SELECT conversation_id, count(*) AS n FROM documents GROUP BY 1) USING (conversation_id) WHERE len(anchor_entities) > 0 OR n > 0""",
    "dropped_proposals": """WITH e AS (SELECT DISTINCT entity_id FROM entity_seed WHERE entity_id IS NOT NULL), r AS (SELECT proposal_id, CASE WHEN coalesce(source_entity_id NOT IN (SELECT entity_id FROM e), true) THEN 'unknown_source' WHEN coalesce(target_entity_id NOT IN (SELECT entity_id FROM e), true) THEN 'unknown_target'
      WHEN source_entity_id = target_entity_id THEN 'pointless' WHEN coalesce(len(evidence_claim_ids), 0) = 0 THEN 'no_evidence' WHEN coalesce(confidence, 0) < 0.6 THEN 'unsure' END AS reason FROM identity_merges) SELECT * FROM r WHERE reason IS NOT NULL""",
    "action_checks": f"""WITH n AS (SELECT DISTINCT {KEY % 'canonical_name'} AS key FROM entity_seed), x AS (SELECT proposal_id, unnest(list_distinct(evidence_claim_ids)) AS c FROM identity_merges), l AS (SELECT proposal_id, count(*) AS cited, count(*) FILTER (c NOT IN (SELECT claim_id FROM claims WHERE claim_id IS NOT NULL)) AS lost FROM x GROUP BY 1),
      e AS (SELECT m.proposal_id, concat_ws(',', CASE WHEN coalesce({KEY % 'source_entity_name'} NOT IN (SELECT key FROM n WHERE key <> ''), true) THEN 'source_unresolved' END, CASE WHEN target_entity_id IS NULL THEN 'target_missing' END, CASE WHEN cited IS NULL THEN 'no_claims' END, CASE WHEN lost > 0 THEN 'unknown_claims' END) AS errors
      FROM identity_merges m LEFT JOIN l USING (proposal_id)) SELECT proposal_id, errors, errors = '' AS valid FROM e""",
    "segment_trust": f"""WITH s AS (SELECT conversation_id, lower(trim(track)) AS k, relevance_confidence AS c, concat_ws(' ', topic_label, topic_summary) AS tx FROM conversation_segments), h AS (SELECT *, {_hits(STORY_WORDS, 'tx')} AS st, {_hits(WORK_WORDS, 'tx')} AS wk, {_PRIOR.replace('{t}', 'tx')} AS hs FROM s)
      SELECT conversation_id, round(CASE WHEN k IN ('lore', 'meta', 'mixed') THEN greatest(0.82::DOUBLE, least(1.0::DOUBLE, coalesce(c, 0.82::DOUBLE)), hs) ELSE hs END, 6) AS score,
        CASE WHEN k = 'mixed' THEN 'lore' WHEN k IN ('lore', 'meta') THEN k WHEN st + wk = 0 THEN 'unknown' WHEN wk > 0 THEN 'meta' ELSE 'lore' END AS track FROM h""",
    "fallback_scores": f"""WITH h AS (SELECT doc_id, {_hits(STORY_WORDS)} AS st, {_hits(WORK_WORDS)} AS wk, {_PRIOR.replace('{t}', 'text')} AS p, CAST(regexp_matches(lower(coalesce(text, '')), '{INTENT}') AS INT) AS i FROM documents),
      k AS (SELECT *, CASE WHEN wk > 0 AND i > 0 AND p >= 0.1 THEN 'meta' WHEN st > 0 AND wk = 0 AND p >= 0.4 AND i = 0 THEN 'lore' ELSE 'unknown' END AS kind FROM h)
      SELECT doc_id, kind, round(CASE kind WHEN 'meta' THEN greatest(0.38::DOUBLE, least(0.72::DOUBLE, 0.2::DOUBLE + 0.16::DOUBLE * i + 0.44::DOUBLE * p)) WHEN 'lore' THEN greatest(0.38::DOUBLE, least(0.76::DOUBLE, 0.18::DOUBLE + 0.62::DOUBLE * p)) ELSE least(0.34::DOUBLE, 0.2::DOUBLE + 0.2::DOUBLE * p) END, 4) AS score FROM k""",
    "document_work": f"""WITH s AS (SELECT doc_id, 2 * {_hits(['patch', 'build', 'typos'])} AS a, 2 * {_hits(['playtest', 'door'])} AS b, {_hits(STORY_WORDS)} AS c FROM documents)
      SELECT doc_id, CASE WHEN a > 0 AND a >= b AND a >= c THEN 'patches' WHEN b > 0 AND b >= c THEN 'playtests' ELSE 'chronicle' END AS work, CAST(greatest(a, b, c) AS BIGINT) AS hints FROM s""",
    "document_tracks": f"""WITH s AS (SELECT conversation_id, min(track) AS t FROM conversation_segments WHERE track IN ('lore', 'meta') GROUP BY 1)
      SELECT doc_id, coalesce(knowledge_track, s.t, CASE WHEN {_hits(WORK_WORDS)} > {_hits(STORY_WORDS)} THEN 'meta' ELSE 'lore' END) AS track, CASE WHEN knowledge_track IS NOT NULL THEN 'noted' WHEN s.t IS NOT NULL THEN 'segment' ELSE 'words' END AS by FROM documents LEFT JOIN s USING (conversation_id)""",
    "entity_tiers": """WITH c AS (SELECT target_entity_id AS entity_id, unnest(source_snippet_ids) AS s FROM claims WHERE status = 'accepted'), n AS (SELECT entity_id, count(DISTINCT s) AS n FROM c GROUP BY 1), e AS (SELECT DISTINCT entity_id FROM entity_seed)
      SELECT entity_id, coalesce(n, 0) AS snippets, CASE WHEN n >= 80 THEN 'main' WHEN n >= 12 THEN 'major' WHEN n >= 4 THEN 'minor' ELSE 'stub' END AS tier, CAST(least(1200, 80 + 40 * coalesce(n, 0)) AS BIGINT) AS words FROM e LEFT JOIN n USING (entity_id)""",
    "directives": """WITH d AS (SELECT doc_id, nullif(regexp_extract(text, 'keep the ([a-z -]+) as canon, drop the ([a-z -]+)\\.', 1), '') AS k, nullif(regexp_extract(text, 'keep the ([a-z -]+) as canon, drop the ([a-z -]+)\\.', 2), '') AS x,
      nullif(regexp_extract(text, 'Moved to backlog: ([^,\\n]+)', 1), '') AS b, nullif(regexp_extract(text, 'merged two cards about the ([a-z-]+)', 1), '') AS m FROM documents)
      SELECT doc_id, CASE WHEN k IS NOT NULL THEN 'replace' WHEN b IS NOT NULL THEN 'move' ELSE 'alias' END AS operation, coalesce(k, b, m) AS about, x AS dropped FROM d WHERE coalesce(k, b, m) IS NOT NULL""",
    "card_checks": f"""WITH d AS (SELECT doc_id, text, {_WORDS} AS words, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE source = 'wiki_cards' AND text IS NOT NULL), h AS (SELECT *, array_to_string(list_slice(p, 1, 2), chr(10) || chr(10)) AS head, p[len(p)] AS tail FROM d)
      SELECT doc_id, words, concat_ws(',', CASE WHEN words < 40 THEN 'short' END, CASE WHEN words > 400 THEN 'long' END, CASE WHEN {_hits(WORK_WORDS, 'head')} > 0 THEN 'work_in_summary' END, CASE WHEN {_hits(STORY_WORDS, 'tail')} > 0 AND {_hits(STORY_WORDS, 'head')} = 0 THEN 'story_in_last' END,
        CASE WHEN contains(lower(text), 'open question') AND NOT contains(text, '?') THEN 'unasked' END) AS issues FROM h""",
    "card_totals": f"""WITH c AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE source = 'wiki_cards' AND knowledge_track = 'lore') SELECT doc_id, words, (SELECT CAST(sum(words) AS BIGINT) FROM c) AS of_all FROM c ORDER BY words DESC, doc_id LIMIT 20""",
    "log_tails": """WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[0-9]+')) AS l FROM documents WHERE source IN ('session_transcripts', 'dm_export') AND text IS NOT NULL)
      SELECT doc_id, md5(coalesce(array_to_string(list_transform(list_slice(l, greatest(len(l) - 2, 1), len(l)), lambda x: substr(x, 1, 200)), chr(10)), '')) AS tail, CAST(len(l) AS BIGINT) AS lines FROM d""",
    "tag_overview": """SELECT tag, count(*) AS claims, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'rejected') AS rejected, count(DISTINCT target_entity_id) AS targets
      FROM (SELECT status, target_entity_id, unnest(thematic_tags) AS tag FROM claims) GROUP BY 1""",
    "claim_priors": """WITH r AS (SELECT target_entity_id, CASE status WHEN 'accepted' THEN 0.88::DOUBLE WHEN 'rejected' THEN 0.25::DOUBLE ELSE 0.55::DOUBLE END AS p, CASE status WHEN 'accepted' THEN 0.72::DOUBLE WHEN 'rejected' THEN 0.42::DOUBLE ELSE 0.55::DOUBLE END AS w FROM claims WHERE target_entity_id IS NOT NULL)
      SELECT target_entity_id, count(*) AS claims, round(sum(p * w) / sum(w), 6) AS prior FROM r GROUP BY 1""",
    "hinted_documents": f"SELECT source, doc_id, hints, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hints DESC, doc_id) AS rank FROM (SELECT source, doc_id, CAST({_hits(STORY_WORDS)} AS BIGINT) AS hints FROM documents)) WHERE rank <= 5",
}
