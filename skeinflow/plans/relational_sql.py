"""SQL that gives the same rows as the queries in ``relational``."""

from __future__ import annotations

from skeinflow.plans.messages import DISTINCT, GAP_US
from skeinflow.plans.messages import MESSAGES as M
from skeinflow.plans.normalising import CLEAN, KEY

_SEEDS = "(SELECT DISTINCT entity_id, canonical_name, entity_type, seed_status FROM entity_seed)"
_ALIAS = "(SELECT entity_id, entity_type, unnest(aliases) AS alias FROM entity_seed)"
_CONFIG = "(SELECT {} FROM pipeline_config WHERE enabled AND section = 'conversation_segmentation' ORDER BY config_id LIMIT 1)"
_MSG = f"(SELECT * FROM {DISTINCT} WHERE conversation_id IS NOT NULL)"

_NEAR = f"""
WITH p AS (SELECT dm_pair_id, CAST(floor(epoch_us(timestamp_utc) / 1000000) AS BIGINT) AS at, count(*) AS rows FROM {M} WHERE timestamp_utc IS NOT NULL AND dm_pair_id IS NOT NULL GROUP BY 1, 2),
s AS (SELECT dm_pair_id, CAST(floor(epoch_us(timestamp_start_utc) / 1000000) AS BIGINT) AS s, CAST(floor(epoch_us(timestamp_end_utc) / 1000000) AS BIGINT) AS e FROM conversation_segments WHERE dm_pair_id IS NOT NULL AND timestamp_end_utc >= timestamp_start_utc),
d AS (SELECT p.dm_pair_id, p.at, any_value(p.rows) AS rows, min(greatest(0, s.s - p.at, p.at - s.e)) AS d FROM p LEFT JOIN s USING (dm_pair_id) GROUP BY 1, 2)
"""
_TARGETS = f"""
WITH ids AS (SELECT DISTINCT entity_id FROM entity_seed), names AS (SELECT {KEY % 'canonical_name'} AS key, min(entity_id) AS value FROM entity_seed GROUP BY 1),
alias AS (SELECT {KEY % 'alias'} AS key, min(entity_id) AS value FROM {_ALIAS} GROUP BY 1 HAVING min(entity_id) = max(entity_id) AND {KEY % 'any_value(alias)'} <> '')
SELECT c.claim_id, coalesce(i.entity_id, n.value, a.value) AS entity, CASE WHEN i.entity_id IS NOT NULL THEN 'id' WHEN n.value IS NOT NULL THEN 'name' WHEN a.value IS NOT NULL THEN 'alias' END AS entity_by
FROM claims c LEFT JOIN ids i ON i.entity_id = c.target_entity_id LEFT JOIN names n ON n.key = {KEY % 'c.target_entity_name'} LEFT JOIN alias a ON a.key = {KEY % 'c.target_entity_name'}"""
_MENTIONS = f"""
WITH n AS (SELECT DISTINCT entity_id, {KEY % 'canonical_name'} AS name FROM entity_seed), k AS (SELECT entity_id, name, len(string_split(name, ' ')) AS size FROM n WHERE name <> ''),
w AS (SELECT doc_id, string_split({KEY % 'text'}, ' ') AS words FROM documents WHERE text IS NOT NULL), sizes AS (SELECT DISTINCT size FROM k),
g AS (SELECT doc_id, array_to_string(list_slice(words, i, i + size - 1), ' ') AS name FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, sizes WHERE len(words) >= size))
SELECT doc_id, entity_id, count(*) AS mentions FROM g JOIN k USING (name) GROUP BY 1, 2"""
_VOTES = f"""
WITH v AS (SELECT {KEY % 'candidate_name'} AS key, proposed_entity_type AS type, round(coalesce(confidence, 0.5), 3) AS weight FROM entity_candidates),
t AS (SELECT key, type, round(sum(weight), 6) AS total FROM v WHERE key <> '' AND type IS NOT NULL GROUP BY 1, 2),
f AS (SELECT key, type AS top, total AS top_total FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY total DESC, type) AS n FROM t) WHERE n = 1),
c AS (SELECT {KEY % 'canonical_name'} AS key, min(entity_type) AS current FROM entity_seed GROUP BY 1),
j AS (SELECT f.key, top, top_total, current, current IS NULL OR top_total - coalesce(t.total, 0.0) >= 0.75 AS switch FROM f LEFT JOIN c USING (key) LEFT JOIN t ON t.key = f.key AND t.type = c.current)
SELECT key, CASE WHEN switch THEN top ELSE current END AS chosen, top_total, switch AND top IS DISTINCT FROM current AS switched FROM j"""
_INVENTORY = f"""
WITH c AS (SELECT target_entity_id AS entity_id, count(*) AS claims, sum((status = 'accepted')::BIGINT)::BIGINT AS accepted FROM claims GROUP BY 1),
d AS (SELECT entity_id, count(*) AS documents FROM documents GROUP BY 1), f AS (SELECT {KEY % 'candidate_name'} AS key, count(*) AS candidates FROM entity_candidates GROUP BY 1)
SELECT s.entity_id, entity_type, coalesce(claims, 0) AS claims, coalesce(accepted, 0) AS accepted, coalesce(documents, 0) AS documents, coalesce(candidates, 0) AS candidates,
  CASE WHEN seed_status <> 'active' THEN 'blocked' WHEN accepted > 0 THEN 'ready' WHEN claims > 0 THEN 'drafted' WHEN documents > 0 THEN 'mentioned' ELSE 'empty' END AS bucket
FROM {_SEEDS} s LEFT JOIN c USING (entity_id) LEFT JOIN d USING (entity_id) LEFT JOIN f ON f.key = {KEY % 's.canonical_name'}"""
_RANKED = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY target_entity_id ORDER BY confidence DESC, claim_id) AS inner_rank FROM claims WHERE target_entity_id IS NOT NULL AND knowledge_track IS NOT NULL AND confidence IS NOT NULL),
b AS (SELECT *, round(confidence * CASE inner_rank WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.62::DOUBLE WHEN 3 THEN 0.42::DOUBLE ELSE 0.3::DOUBLE END, 6) AS weighted FROM a)
SELECT claim_id, inner_rank, weighted, row_number() OVER (PARTITION BY knowledge_track ORDER BY weighted DESC, claim_id) AS outer_rank FROM b"""
_VALID = f"""
WITH r AS (SELECT claim_id, target_entity_id, {KEY % 'claim_text'} AS headline, CASE WHEN trim(coalesce(claim_text, '')) = '' THEN 'no_text' WHEN coalesce(status = 'rejected', true) THEN 'rejected' WHEN coalesce(confidence, 0) < 0.4 THEN 'unsure' END AS broken
  FROM claims WHERE target_entity_id IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY target_entity_id, headline, broken IS NULL ORDER BY claim_id) AS copy FROM r),
p AS (SELECT *, sum(CASE WHEN broken IS NULL AND copy = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY target_entity_id ORDER BY claim_id ROWS UNBOUNDED PRECEDING) AS place FROM c),
q AS (SELECT claim_id, coalesce(broken, CASE WHEN copy > 1 THEN 'duplicate' END, CASE WHEN place > 5 THEN 'over_cap' END) AS reason FROM p)
SELECT claim_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM q"""
_KNOWN = f"""
WITH u AS (SELECT DISTINCT {KEY % 'canonical_name'} AS key, entity_id AS record, 0 AS s FROM entity_seed UNION ALL SELECT {KEY % "coalesce(candidate_name, '')"}, candidate_id, 1 FROM entity_candidates)
SELECT key, record FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, record) AS n FROM u) WHERE n = 1 OR coalesce(key, '') = ''"""
_CHANGES = f"""
WITH a AS (SELECT DISTINCT entity_id, canonical_name, seed_status FROM entity_seed),
b AS (SELECT entity_id, canonical_name, CASE WHEN seed_status = 'blocked_seed' THEN 'archived' ELSE seed_status END AS seed_status FROM a WHERE canonical_name NOT LIKE 'Port %')
SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN a.entity_id IS NULL THEN 'added' WHEN b.entity_id IS NULL THEN 'removed' ELSE 'updated' END AS change
FROM a FULL JOIN b USING (entity_id) WHERE a.entity_id IS NULL OR b.entity_id IS NULL OR a.canonical_name IS DISTINCT FROM b.canonical_name OR a.seed_status IS DISTINCT FROM b.seed_status"""
_SPANS = """
WITH s AS (SELECT conversation_id, dm_pair_id, epoch_us(timestamp_start_utc) AS a, epoch_us(timestamp_end_utc) AS b FROM conversation_segments WHERE dm_pair_id IS NOT NULL AND timestamp_start_utc IS NOT NULL AND timestamp_end_utc >= timestamp_start_utc),
u AS (SELECT *, max(b) OVER (PARTITION BY dm_pair_id ORDER BY a, b DESC, conversation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM s)
SELECT conversation_id, CASE WHEN a <= upto THEN upto + 1 ELSE a END AS start_us, b AS end_us, coalesce(a <= upto, false) AS trimmed FROM u WHERE upto IS NULL OR b > upto"""
_OPENING = f"""
WITH r AS (SELECT *, row_number() OVER w AS place, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) - length(text) AS before FROM {_MSG} WINDOW w AS (PARTITION BY conversation_id ORDER BY us NULLS FIRST, message_id, thread_id))
SELECT conversation_id, message_id, place, CAST(least(length(text), 400 - before) AS BIGINT) AS kept_chars FROM r WHERE place <= 8 AND before < 400"""
_MOVES = "(SELECT source_entity_id AS s, arg_max(target_entity_id, (created_at_utc, proposal_id)) AS t FROM identity_merges WHERE source_entity_id <> target_entity_id GROUP BY 1)"
_WINDOWS = f"""
WITH RECURSIVE g AS (SELECT dm_pair_id, thread_id, message_id, us, greatest(length(text), 1) AS chars, CASE WHEN us - lag(us) OVER (PARTITION BY dm_pair_id ORDER BY us) <= {GAP_US} THEN 0 ELSE 1 END AS opens
  FROM {DISTINCT} WHERE us IS NOT NULL AND dm_pair_id IS NOT NULL),
n AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY dm_pair_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY dm_pair_id, session_no ORDER BY us, message_id, thread_id) AS i FROM n),
f AS (SELECT dm_pair_id, session_no, i, 1 AS part_no, 1 AS held, chars AS total, chars FROM o WHERE i = 1
  UNION ALL SELECT o.dm_pair_id, o.session_no, o.i, CASE WHEN x.cut THEN part_no + 1 ELSE part_no END, CASE WHEN x.cut THEN 1 ELSE held + 1 END, CASE WHEN x.cut THEN o.chars ELSE total + o.chars END, o.chars
  FROM (SELECT f.*, c.m, c.k FROM f, {_CONFIG.format('model_window_max_messages AS m, model_window_max_chars AS k')} c) f JOIN o ON o.dm_pair_id = f.dm_pair_id AND o.session_no = f.session_no AND o.i = f.i + 1, LATERAL (SELECT f.held >= f.m OR f.total + o.chars > f.k AS cut) x)
SELECT dm_pair_id, session_no, CAST(part_no AS BIGINT) AS part_no, count(*) AS messages, CAST(sum(chars) AS BIGINT) AS chars FROM f GROUP BY 1, 2, 3"""
_EDGES = f"""
WITH s AS (SELECT DISTINCT entity_id, canonical_name, relationship_hints FROM entity_seed), h AS (SELECT entity_id, unnest(relationship_hints) AS h FROM s),
n AS (SELECT {KEY % 'canonical_name'} AS key, min(entity_id) AS target_id FROM s GROUP BY 1),
e AS (SELECT h.entity_id, coalesce(n.target_id, 'unresolved:' || {KEY % 'h.h.target_name'}) AS target, h.h.relation_type AS relation FROM h LEFT JOIN n ON n.key = {KEY % 'h.h.target_name'}),
g AS (SELECT entity_id, target, relation, count(*) AS evidence FROM e WHERE target IS NOT NULL GROUP BY 1, 2, 3) """

SQL = {
    "timeline_statistics": f"SELECT count(*) AS rows, count(*) FILTER (timestamp_utc >= TIMESTAMPTZ '2024-07-01 00:00:00+00') AS kept, count(*) FILTER (timestamp_utc IS NULL) AS untimed, min(epoch_us(timestamp_utc)) AS first_us, max(epoch_us(timestamp_utc)) AS last_us FROM {M}",
    "timeline_index": f"SELECT thread_id, count(*) AS rows, min(epoch_us(timestamp_utc)) AS first_us, max(epoch_us(timestamp_utc)) AS last_us, count(DISTINCT author_id) AS authors FROM {M} GROUP BY 1",
    "batch_selection": f"SELECT provenance.export_batch AS batch, max(epoch_us(timestamp_utc)) AS last_us, count(*) AS rows FROM {M} GROUP BY 1 HAVING bool_or(timestamp_utc >= TIMESTAMPTZ '2024-07-01 00:00:00+00')",
    "global_sequence": "SELECT conversation_id, epoch_us(timestamp_start_utc) AS start_us, row_number() OVER (ORDER BY timestamp_start_utc NULLS FIRST, conversation_id) AS seq FROM conversation_segments",
    "account_owner": f"SELECT author_id, count(DISTINCT thread_id) AS threads, count(*) AS rows FROM {M} WHERE author_id IS NOT NULL GROUP BY 1 ORDER BY bool_and(coalesce(is_bot_or_application, false)), 2 DESC, 3 DESC, 1 DESC LIMIT 1",
    "last_labels": f"SELECT author_id, author_name AS label FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY timestamp_utc DESC NULLS LAST, author_name DESC) AS n FROM {M} WHERE author_id IS NOT NULL AND author_name IS NOT NULL) WHERE n = 1",
    "conversation_partners": f"""SELECT conversation_id, author_id, rows FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY rows DESC, author_id) AS n FROM (
      SELECT conversation_id, author_id, count(*) AS rows FROM {M} WHERE conversation_id IS NOT NULL AND author_id <> {_CONFIG.format('self_user_id')} GROUP BY 1, 2)) WHERE n = 1""",
    "thread_identity": f"""WITH k AS (SELECT thread_id, min(partner_id) AS p FROM {M} WHERE partner_id <> 'unknown' GROUP BY 1)
      SELECT dm_pair_id, CASE WHEN p IS NULL THEN 'none' WHEN partner_id IS NOT DISTINCT FROM p THEN 'same' ELSE 'filled' END AS partner, count(*) AS rows FROM {M} LEFT JOIN k USING (thread_id) GROUP BY 1, 2""",
    "segment_rows": f"""WITH l AS (SELECT DISTINCT conversation_id, track, topic_label, unnest(message_ids) AS message_id FROM conversation_segments)
      SELECT conversation_id, track, topic_label, thread_id, message_id, copies, row_number() OVER (PARTITION BY conversation_id ORDER BY us NULLS FIRST, message_id, thread_id) AS place FROM l JOIN {_MSG} USING (conversation_id, message_id)""",
    "segment_messages": f"""WITH l AS (SELECT DISTINCT conversation_id, unnest(message_ids) AS message_id FROM conversation_segments)
      SELECT conversation_id, count(*) AS found, CAST(sum(copies) AS BIGINT) AS deliveries FROM l JOIN {_MSG} USING (conversation_id, message_id) GROUP BY 1""",
    "unsegmented_conversations": f"SELECT conversation_id, count(*) AS rows FROM {M} WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT conversation_id FROM conversation_segments WHERE conversation_id IS NOT NULL) GROUP BY 1",
    "segment_distance": _NEAR + "SELECT dm_pair_id, CASE WHEN d = 0 THEN 'inside' WHEN d <= 10800 THEN 'near' ELSE 'far' END AS kind, CAST(sum(rows) AS BIGINT) AS rows FROM d GROUP BY 1, 2",
    "claim_targets": _TARGETS,
    "entity_mentions": _MENTIONS,
    "claim_clusters": f"""SELECT knowledge_track, {KEY % 'target_entity_name'} AS target, count(*) AS claims, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(thematic_tags, []))))), ','), '') AS tags,
      CAST(sum(coalesce(len(source_snippet_ids), 0)) AS BIGINT) AS snippets FROM claims WHERE target_entity_name IS NOT NULL GROUP BY 1, 2""",
    "snippet_support": """WITH c AS (SELECT unnest(source_snippet_ids) AS snippet_id FROM claims), k AS (SELECT unnest(source_snippet_ids) AS snippet_id FROM entity_candidates)
      SELECT doc_id, coalesce(a.n, 0) AS claims, coalesce(b.n, 0) AS candidates FROM documents LEFT JOIN (SELECT snippet_id, count(*) AS n FROM c GROUP BY 1) a USING (snippet_id) LEFT JOIN (SELECT snippet_id, count(*) AS n FROM k GROUP BY 1) b USING (snippet_id)""",
    "tag_pairs": """WITH t AS (SELECT DISTINCT claim_id, unnest(thematic_tags) AS tag FROM claims) SELECT x.tag AS a, y.tag AS b, count(*) AS together FROM t x JOIN t y ON x.claim_id = y.claim_id AND x.tag < y.tag GROUP BY 1, 2""",
    "type_votes": _VOTES,
    "candidate_groups": f"""SELECT {KEY % 'candidate_name'} AS key, count(*) AS candidates, CAST(sum(evidence_count) AS BIGINT) AS evidence, min(epoch_us(first_seen_timestamp_utc)) AS first_us, max(confidence) AS confidence
      FROM entity_candidates WHERE {KEY % 'candidate_name'} <> '' GROUP BY 1 HAVING count(*) >= 2""",
    "candidate_recency": """WITH m AS (SELECT *, (SELECT max(epoch_us(last_seen_timestamp_utc)) FROM entity_candidates) - epoch_us(last_seen_timestamp_utc) AS age FROM entity_candidates),
      r AS (SELECT candidate_id, evidence_count, CASE WHEN age <= 14 * 86400000000 THEN 1.5::DOUBLE WHEN age <= 45 * 86400000000 THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END AS recency FROM m)
      SELECT candidate_id, recency, round(evidence_count * recency, 4) AS adjusted FROM r""",
    "candidate_triage": f"""WITH k AS (SELECT *, {KEY % 'candidate_name'} AS key FROM entity_candidates) SELECT candidate_id, CASE WHEN coalesce(key, '') = '' THEN 'unnamed' WHEN len(string_split(key, ' ')) > 12 THEN 'long'
      WHEN NOT regexp_matches(key, '[a-z]') THEN 'digits' WHEN coalesce(confidence, 0) < 0.35 THEN 'weak' WHEN evidence_count <= 1 THEN 'single' ELSE 'review' END AS bucket FROM k""",
    "latest_claims": "SELECT target_entity_id, claim_id, status, epoch_us(created_at_utc) AS us FROM (SELECT *, row_number() OVER (PARTITION BY target_entity_id ORDER BY created_at_utc DESC NULLS LAST, claim_id DESC) AS n FROM claims WHERE target_entity_id IS NOT NULL) WHERE n = 1",
    "undecided_claims": "SELECT claim_id, status FROM claims WHERE status IN ('draft', 'needs_more_context') AND claim_id NOT IN (SELECT x FROM (SELECT unnest(evidence_claim_ids) AS x FROM identity_merges) WHERE x IS NOT NULL)",
    "targets_with_seeds": "SELECT claim_type, count(*) AS claims, count(DISTINCT target_entity_id) AS targets FROM claims WHERE target_entity_id IN (SELECT entity_id FROM entity_seed) GROUP BY 1",
    "entity_inventory": _INVENTORY,
    "claim_rankings": _RANKED,
    "top_documents": """WITH l AS (SELECT doc_id, max(quality) AS quality FROM review_labels GROUP BY 1) SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id) AS rank
      FROM documents LEFT JOIN l USING (doc_id)) WHERE rank <= 20""",
    "segment_sequences": """SELECT conversation_id, row_number() OVER w AS sequence_no, lag(conversation_id) OVER w AS requires FROM conversation_segments WHERE dm_pair_id IS NOT NULL
      WINDOW w AS (PARTITION BY dm_pair_id ORDER BY timestamp_start_utc NULLS FIRST, conversation_id)""",
    "review_turns": "SELECT claim_id, claim_type, row_number() OVER (PARTITION BY claim_type ORDER BY claim_id) AS turn FROM claims WHERE status = 'draft'",
    "known_names": _KNOWN,
    "seed_changes": _CHANGES,
    "confident_claims": """WITH a AS (SELECT claim_id, coalesce(confidence >= 0.8, false) AS hit, bool_or(coalesce(confidence >= 0.8, false)) OVER (PARTITION BY target_entity_id) AS any_hit FROM claims)
      SELECT claim_id, NOT any_hit AS fell_back FROM a WHERE hit OR NOT any_hit""",
    "source_quality": """SELECT source, reviewed, quality, good_share, reviewers, CASE WHEN quality >= 3 AND good_share >= 0.35 THEN 'pass' ELSE 'fail' END AS gate FROM (SELECT source, count(*) AS reviewed, round(avg(quality), 4) AS quality,
      round(avg((quality >= 4)::INT), 4) AS good_share, count(DISTINCT reviewer) AS reviewers FROM documents JOIN review_labels USING (doc_id) GROUP BY 1)""",
    "validated_claims": _VALID,
    "tag_activation": "SELECT tag, count(*) AS uses, count(*) >= 25 AS active FROM (SELECT status, unnest(thematic_tags) AS tag FROM claims) WHERE tag IS NOT NULL AND status IS NOT NULL GROUP BY 1",
    "target_tags": """SELECT target_entity_id, tag, uses, rank FROM (SELECT *, row_number() OVER (PARTITION BY target_entity_id ORDER BY uses DESC, tag) AS rank FROM (
      SELECT target_entity_id, tag, count(*) AS uses FROM (SELECT target_entity_id, unnest(thematic_tags) AS tag FROM claims WHERE target_entity_id IS NOT NULL) GROUP BY 1, 2)) WHERE rank <= 3""",
    "claim_duplicates": f"SELECT min(claim_id) AS representative, count(*) AS copies FROM claims GROUP BY target_entity_id, lower({CLEAN % 'coalesce(claim_text, chr(32))'}) HAVING count(*) > 1",
    "claim_attention": f"""SELECT claim_id, concat_ws(',', CASE WHEN target_entity_id IS NULL THEN 'untargeted' END, CASE WHEN coalesce(len(source_snippet_ids), 0) = 0 THEN 'no_evidence' END, CASE WHEN coalesce(confidence, 0) < 0.65 THEN 'unsure' END,
      CASE WHEN claim_text IS NOT NULL AND count(*) OVER (PARTITION BY target_entity_id, {KEY % 'claim_text'}) > 1 THEN 'repeated' END, CASE WHEN status IN ('draft', 'defer') THEN 'undecided' END) AS reasons FROM claims""",
    "alias_owners": f"SELECT key, min(entity_id) AS entity_id FROM (SELECT entity_id, {KEY % 'alias'} AS key FROM {_ALIAS}) WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT entity_id) = 1",
    "seed_majorities": f"""SELECT key, entity_type, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, entity_type) AS r FROM (
      SELECT {KEY % 'alias'} AS key, entity_type, count(DISTINCT entity_id) AS n FROM {_ALIAS} GROUP BY 1, 2) WHERE key <> '') WHERE r = 1""",
    "cited_snippets": """WITH r AS (SELECT DISTINCT substr(s, 1, length(s) - 2) AS ref FROM (SELECT unnest(source_snippet_ids) AS s FROM claims) WHERE s IS NOT NULL),
      d AS (SELECT snippet_id, unnest([length(snippet_id), length(snippet_id) - 1, length(snippet_id) - 2, length(snippet_id) - 3, length(snippet_id) - 4]) AS n FROM documents)
      SELECT ref, min(snippet_id) AS snippet_id FROM r JOIN d ON ref = substr(snippet_id, 1, CAST(n AS BIGINT)) WHERE length(ref) >= 6 GROUP BY 1 HAVING count(DISTINCT snippet_id) = 1""",
    "segment_spans": _SPANS,
    "message_context": f"""SELECT conversation_id, thread_id, message_id, md5(array_to_string(list(text) OVER (PARTITION BY conversation_id ORDER BY us NULLS FIRST, message_id, thread_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10))) AS context_md5 FROM {_MSG}""",
    "conversation_openings": _OPENING,
    "model_windows": _WINDOWS,
    "merge_targets": f"""WITH RECURSIVE m AS {_MOVES}, c AS (SELECT s, t, [s] AS seen FROM m UNION ALL SELECT c.s, m.t, list_append(seen, c.t) FROM c JOIN m ON m.s = c.t WHERE NOT list_contains(seen, c.t))
      SELECT s AS source_entity_id, t AS final, CAST(hops AS BIGINT) AS hops FROM (SELECT m.s, e.t, e.hops FROM m LEFT JOIN (SELECT s, t, len(seen) AS hops FROM c WHERE t NOT IN (SELECT s FROM m)) e USING (s))""",
    "identity_components": """WITH RECURSIVE p AS (SELECT source_entity_id AS a, target_entity_id AS b FROM identity_merges WHERE source_entity_id <> target_entity_id), d AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
      r AS (SELECT a AS v, least(a, b) AS low FROM d UNION SELECT d.b, r.low FROM r JOIN d ON d.a = r.v) SELECT v AS vertex, min(low) AS component FROM r GROUP BY 1""",
    "relationship_edges": _EDGES + "SELECT entity_id, target, relation, evidence FROM g",
    "node_degrees": _EDGES + """, x AS (SELECT DISTINCT entity_id AS s, target AS t FROM g) SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (
      SELECT s AS node, 1 AS o, 0 AS i FROM x UNION ALL SELECT t, 0, 1 FROM x) GROUP BY 1""",
    "reference_issues": """SELECT 'claim cites unknown snippet' AS issue, x AS reference FROM (SELECT DISTINCT unnest(source_snippet_ids) AS x FROM claims) WHERE x IS NOT NULL AND x NOT IN (SELECT snippet_id FROM documents WHERE snippet_id IS NOT NULL)
      UNION ALL SELECT 'claim of unknown entity', x FROM (SELECT DISTINCT target_entity_id AS x FROM claims) WHERE x IS NOT NULL AND x NOT IN (SELECT entity_id FROM entity_seed)
      UNION ALL SELECT 'document of unknown entity', x FROM (SELECT DISTINCT entity_id AS x FROM documents) WHERE x IS NOT NULL AND x NOT IN (SELECT entity_id FROM entity_seed)
      UNION ALL SELECT 'document of unknown conversation', x FROM (SELECT DISTINCT conversation_id AS x FROM documents) WHERE x IS NOT NULL AND x NOT IN (SELECT conversation_id FROM conversation_segments)""",
    "export_records": f"""SELECT DISTINCT 'entities' AS database, entity_id AS id, canonical_name AS title FROM entity_seed WHERE seed_status = 'active'
      UNION ALL SELECT 'claims', claim_id, substr({CLEAN % "coalesce(claim_text, '')"}, 1, 60) FROM claims WHERE status = 'accepted'
      UNION ALL SELECT 'conversations', conversation_id, coalesce(topic_label, 'untitled') FROM conversation_segments""",
    "period_comparison": "SELECT CASE WHEN created_at_utc < TIMESTAMPTZ '2025-01-01 00:00:00+00' THEN 'before' ELSE 'after' END AS period, knowledge_track, count(*) AS claims, count(DISTINCT target_entity_id) AS targets, round(avg(confidence), 4) AS confidence FROM claims WHERE created_at_utc IS NOT NULL GROUP BY 1, 2",
    "event_sessions": """WITH f AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM events),
      s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM f) SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS events FROM s GROUP BY user_id, no""",
}
