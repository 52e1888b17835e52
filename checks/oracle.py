"""The same queries as DuckDB SQL over the driver's views.

Named fragments stand for the adapters and for shared results; each query takes
the fragments it names, in order.
"""

import re

from checks.fixtures import OPENERS
from parlance import constants as C
from parlance.functions.text import SPACE_CHARS, SPACE_CLASS
from parlance.operators import labelling as rules


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def rows(values) -> str:
    return ", ".join("(" + listed(v) + ")" for v in values)


SPACES = quoted(SPACE_CHARS)
WORD = C.WORD_PATTERN.replace("'", "''")


def cut(text: str) -> str:
    return f"trim(regexp_extract({text}, '(?s)^(.*[.!?])', 1), {SPACES})"


def tidy(text: str) -> str:
    single = f"trim(regexp_replace({text}, '[{SPACE_CLASS}]+', ' ', 'g'), {SPACES})"
    return f"regexp_replace({single}, ' +([.,!?;:])', '\\1', 'g')"


def redact(text: str) -> str:
    """The three replacements; letters are wrapped so that \\b sees them all as letters."""
    mail = f"regexp_replace({text}, '{C.EMAIL_PATTERN}', '{C.EMAIL_MARK}', 'g')"
    done = f"regexp_replace({mail}, '(\\pL)', 'x\\1x', 'g')"
    for pattern, mark in ((C.CARD_PATTERN, C.CARD_MARK), (C.PHONE_PATTERN, C.PHONE_MARK)):
        done = f"regexp_replace({done}, '{pattern}', '{mark}', 'g')"
    return f"regexp_replace({done}, 'x(\\pL)x', '\\1', 'g')"


def nine(expr: str) -> str:
    return f"round({expr}, 9) + 0.0"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def slot_sql(text: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({text}, {quoted(p)}) THEN "
        f"trim(regexp_extract({text}, {quoted(p)}, 1), {SPACES})"
        for _, p in C.SLOT_TEMPLATES
    )
    return f"CASE WHEN {text} IN ({listed(C.NO_SLOT_OPENERS)}) THEN NULL {cases} END"


def template_sql(text: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(name)}"
        for name, p in C.SLOT_TEMPLATES
    )
    return (
        f"CASE WHEN {text} IN ({listed(C.NO_SLOT_OPENERS)}) "
        f"THEN {quoted(C.NO_SLOT_TEMPLATE)} {cases} END"
    )


def empathy_sql(signal: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in C.EMPATHY_SCORES.items())
    return f"CASE {signal} {cases} END"


CLOSING = listed(C.CLOSING_INTENTS)

FRAGMENTS = {
    "first_user": "SELECT conv_id, min(turn) AS first_user FROM conversations"
    " WHERE role = 'user' GROUP BY conv_id",
    "chat_base": f"""
SELECT conv_id AS c, turn AS t, first_user, text,
  CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' ELSE role END AS role,
  (conv_id * 31 + turn * 17) % 21 - 10 AS s10,
  ([{listed(C.INTENT_LABELS)}])[(conv_id * 7 + turn * 5) % 12 + 1] AS intent,
  ([{listed(C.EMPATHY_LABELS)}])[(conv_id * 13 + turn * 3) % 4 + 1] AS signal,
  (conv_id * 11 + turn) % 10 AS lk
FROM conversations LEFT JOIN first_user USING (conv_id)""",
    "chat_raw": f"""
SELECT 'C' || lpad(c::VARCHAR, 7, '0') AS conv_id, t AS turn_index,
  TIMESTAMP '2025-08-01 00:00:00' + to_minutes(c * 8111 % 180000 + t * 37 % 11) AS "timestamp",
  role,
  CASE WHEN t = first_user THEN ([{listed(OPENERS)}])[c % 8 + 1] ELSE text END
    || ' zzqx blorf vvk' AS text_raw,
  CASE WHEN c % 17 = 0 THEN '' ELSE 'Cust' || lpad((c % 50)::VARCHAR, 3, '0') END AS customer_name,
  CASE WHEN c % 19 <> 0 THEN 'Agent' || lpad((c * 7 % 30)::VARCHAR, 3, '0') END AS agent_name,
  CASE WHEN s10 > 2 THEN 'pos' WHEN s10 < -2 THEN 'neg' ELSE 'neu' END AS sentiment_label,
  s10 / 10.0::DOUBLE AS sentiment_score, intent,
  CASE WHEN role = 'customer' THEN 'na' ELSE signal END AS empathy_signal,
  (intent = 'escalation_request')::BIGINT AS is_escalation,
  ((c * 3 + t) % 23 = 0)::BIGINT AS contains_pii,
  CASE WHEN lk < 7 THEN 'en' WHEN lk < 9 THEN 'hi' ELSE 'mixed' END AS language,
  TIMESTAMP '2025-12-03 00:00:00' AS classified_at
FROM chat_base""",
    "chat": f"SELECT *, {cut('text_raw')} AS text_clean, {cut('text_raw')} AS text_clean_en"
    " FROM chat_raw",
    "event_base": """
SELECT *, 'E' || user_id || '-' || strftime(ts, '%Y%m%d') AS conv_id,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY event_id) - 1
    AS turn_index,
  CASE WHEN value < 10 THEN -5 WHEN value < 30 THEN 0 ELSE 5 END AS s10
FROM events""",
    "event_turns": f"""
SELECT conv_id, turn_index, ts AS "timestamp",
  CASE WHEN event_type IN ('signup', 'error') THEN 'agent' ELSE 'customer' END AS role,
  event_type || ' ' || json_extract_string(props, '$.k') || '. zzqx' AS text_raw,
  event_type || ' ' || json_extract_string(props, '$.k') || '.' AS text_clean,
  event_type || ' ' || json_extract_string(props, '$.k') || '.' AS text_clean_en,
  NULL::VARCHAR AS customer_name,
  'Agent' || lpad((user_id % 30)::VARCHAR, 3, '0') AS agent_name,
  CASE WHEN s10 > 0 THEN 'pos' WHEN s10 < 0 THEN 'neg' ELSE 'neu' END AS sentiment_label,
  s10 / 10.0::DOUBLE AS sentiment_score,
  CASE event_type WHEN 'purchase' THEN 'thanks' WHEN 'error' THEN 'complaint'
    WHEN 'signup' THEN 'query' WHEN 'view' THEN 'acknowledgement' ELSE 'other' END AS intent,
  CASE WHEN event_type NOT IN ('signup', 'error') THEN 'na'
    ELSE (['empathetic', 'neutral', 'dismissive'])[event_id % 3 + 1] END AS empathy_signal,
  (event_type = 'error' AND value > 50)::BIGINT AS is_escalation,
  (event_id % 23 = 0)::BIGINT AS contains_pii,
  CASE WHEN event_id % 10 < 7 THEN 'en' WHEN event_id % 10 < 9 THEN 'hi' ELSE 'mixed' END
    AS language,
  TIMESTAMP '2025-12-03 00:00:00' AS classified_at
FROM event_base""",
    "categories": f"SELECT * FROM (VALUES {rows(C.CATEGORIES)}) v(id, label, description)",
    "slots": f"SELECT * FROM (VALUES {rows(C.SLOT_TO_CATEGORY.items())}) v(slot, category)",
    "openers": f"SELECT * FROM (VALUES {rows(C.OPENER_TO_CATEGORY.items())}) v(opener, category)",
}


def folded(turns: str) -> str:
    score = "CASE WHEN role = 'customer' THEN sentiment_score END"
    empathy = f"CASE WHEN role = 'agent' THEN {empathy_sql('empathy_signal')} END"
    return f"""
SELECT conv_id,
  arg_min(customer_name, turn_index) FILTER (coalesce(customer_name, '') <> '') AS customer_name,
  arg_min(agent_name, turn_index) FILTER (coalesce(agent_name, '') <> '') AS agent_name,
  min("timestamp") AS start_ts, max("timestamp") AS end_ts, count(*) AS turn_count,
  arg_min(text_clean, turn_index) FILTER (role = 'customer') AS opener,
  avg({score}) AS customer_sentiment_overall,
  coalesce(list(sentiment_score ORDER BY turn_index)
    FILTER (role = 'customer' AND sentiment_score IS NOT NULL), []) AS scores,
  max((back <= 2 AND role = 'customer' AND intent IN ({CLOSING}))::BIGINT) AS resolution_flag,
  max((is_escalation = 1)::BIGINT) AS escalation_flag,
  avg({empathy}) AS agent_empathy_mean,
  max((contains_pii = 1)::BIGINT) AS contains_pii_any
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index DESC) AS back
      FROM {turns})
GROUP BY conv_id"""


def topic_sql(source: str, opener: str) -> str:
    """All columns of a source and the topic of one of its text columns."""
    return f"""
SELECT f.*, coalesce(
  CASE WHEN f.{opener} IN ({listed(C.NO_SLOT_OPENERS)}) THEN o.category END, s.category, 'unknown'
) AS topic
FROM {source} f
LEFT JOIN openers o ON translate(f.{opener}, '’', '''') = o.opener
LEFT JOIN slots s ON {slot_sql('f.' + opener)} = s.slot"""


def agents_sql(conversations: str, turns: str) -> str:
    return f"""
SELECT a.*, empathy_mean, top_topics FROM (
  SELECT agent_name, count(*) AS conv_count,
    avg(customer_sentiment_overall) AS avg_customer_sentiment,
    avg(coalesce(resolution_flag, 0)) AS resolution_rate,
    avg(coalesce(escalation_flag, 0)) AS escalation_rate
  FROM {conversations} WHERE agent_name IS NOT NULL GROUP BY agent_name) a
LEFT JOIN (
  SELECT agent_name, avg({empathy_sql('empathy_signal')}) AS empathy_mean
  FROM {turns} WHERE role = 'agent' AND agent_name IS NOT NULL GROUP BY agent_name) e
  USING (agent_name)
LEFT JOIN (
  SELECT agent_name, string_agg(topic || ':' || n, ',' ORDER BY n DESC, first_conv) AS top_topics
  FROM (SELECT agent_name, topic, count(*) AS n, min(conv_id) AS first_conv
        FROM {conversations} WHERE agent_name IS NOT NULL GROUP BY agent_name, topic
        QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY n DESC, first_conv) <= 3)
  GROUP BY agent_name) t USING (agent_name)"""


FRAGMENTS |= {
    "chat_folded": folded("chat"),
    "chat_convs": topic_sql("chat_folded", "opener"),
    "chat_agents": agents_sql("chat_convs", "chat"),
    "event_folded": folded("event_turns"),
    "event_convs": topic_sql("event_folded", "opener"),
    "event_agents": agents_sql("event_convs", "event_turns"),
    "chat_openers": "SELECT DISTINCT text_clean FROM chat WHERE role = 'customer' AND turn_index = 0",
    "event_openers": "SELECT DISTINCT text_clean FROM event_turns"
    " WHERE role = 'customer' AND turn_index = 0",
    "lexicon": f"""
SELECT token, round(log10(n * 1e9::DOUBLE / sum(n) OVER ()), 2) AS zipf FROM (
  SELECT lower(w) AS token, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(text, '({WORD})', 1)) AS w FROM benchmark)
  GROUP BY ALL)""",
    "customer_slots": "SELECT c_name AS slot, 'n' || c_nationkey AS category FROM customer",
    "unlabelled": "SELECT * REPLACE (" + ", ".join(
        f"CASE WHEN text_clean LIKE 'click %' OR text_clean LIKE 'view %' THEN {c} END AS {c}"
        for c in ("sentiment_label", "sentiment_score", "intent", "empathy_signal",
                  "is_escalation", "contains_pii", "language", "text_clean_en", "classified_at")
    ) + ") FROM event_turns",
}


def rule_sql(source: str) -> str:
    """The keyword rules over (text_clean, role)."""
    intents = " ".join(
        f"WHEN regexp_matches(text_clean, {quoted(p)}) THEN '{label}'"
        for label, p in rules.INTENT_RULES
    )
    intent = f"CASE {intents} ELSE 'other' END"
    pos = f"len(regexp_extract_all(text_clean, {quoted(rules.POSITIVE_RULE)}))"
    neg = f"len(regexp_extract_all(text_clean, {quoted(rules.NEGATIVE_RULE)}))"
    hindi = f"regexp_matches(text_clean, {quoted(rules.HINDI_RULE)})"
    english = f"regexp_matches(text_clean, {quoted(rules.ENGLISH_RULE)})"
    return f"""
SELECT text_clean, role,
  CASE WHEN {pos} > {neg} THEN 'pos' WHEN {pos} < {neg} THEN 'neg' ELSE 'neu' END AS sentiment_label,
  CASE WHEN {pos} + {neg} = 0 THEN 0.0::DOUBLE
    ELSE ({pos} - {neg}) / ({pos} + {neg})::DOUBLE END AS sentiment_score,
  {intent} AS intent,
  CASE WHEN role <> 'agent' THEN 'na'
    WHEN regexp_matches(text_clean, {quoted(rules.EMPATHETIC_RULE)}) THEN 'empathetic'
    WHEN regexp_matches(text_clean, {quoted(rules.DISMISSIVE_RULE)}) THEN 'dismissive'
    ELSE 'neutral' END AS empathy_signal,
  ({intent} = 'escalation_request')::BIGINT AS is_escalation,
  ({redact('text_clean')} <> text_clean)::BIGINT AS contains_pii,
  CASE WHEN {hindi} AND {english} THEN 'mixed' WHEN {hindi} THEN 'hi' ELSE 'en' END AS language
FROM {source}"""


FRAGMENTS |= {
    "event_seen": "SELECT DISTINCT text_clean, role FROM event_turns"
    " WHERE text_clean LIKE 'purchase %' OR text_clean LIKE 'error %'",
    "event_labels": rule_sql("event_seen"),
    "pending": "SELECT DISTINCT text_clean, role FROM event_turns WHERE text_clean NOT IN"
    " (SELECT text_clean FROM event_labels)",
    "document_pairs": "SELECT DISTINCT text AS text_clean, CASE WHEN doc_id % 2 = 0 THEN 'agent'"
    " ELSE 'customer' END AS role FROM documents",
    "answers": """
SELECT text_clean, role,
  CASE quality WHEN 1 THEN 'pos' WHEN 0 THEN 'neg' ELSE
    CASE WHEN doc_id % 5 = 0 THEN 'happy' ELSE 'neu' END END AS sentiment_label,
  CASE WHEN doc_id % 7 = 0 THEN 1.5 ELSE doc_id % 3 - 1 END::DOUBLE AS sentiment_score,
  CASE WHEN doc_id % 11 = 0 THEN 'chat' ELSE 'query' END AS intent,
  CASE WHEN doc_id % 13 = 0 THEN 'rude' ELSE 'neutral' END AS empathy_signal,
  coalesce(toxic, 0)::BIGINT AS is_escalation,
  CASE WHEN doc_id % 17 = 0 THEN 2 ELSE 0 END::BIGINT AS contains_pii,
  CASE lang WHEN 'de' THEN 'de' WHEN 'en' THEN 'en' ELSE 'mixed' END AS language,
  CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE text_clean END AS text_en
FROM (SELECT text AS text_clean, CASE WHEN doc_id % 2 = 0 THEN 'agent' ELSE 'customer' END AS role,
        doc_id, quality, toxic, lang FROM documents LEFT JOIN labels USING (doc_id))
QUALIFY row_number() OVER (PARTITION BY text_clean, role ORDER BY doc_id) = 1""",
    "judged": f"""
SELECT *, CASE
  WHEN sentiment_label NOT IN ({listed(C.SENTIMENT_LABELS)}) THEN 'bad sentiment_label'
  WHEN sentiment_score NOT BETWEEN -1 AND 1 THEN 'sentiment_score out of range'
  WHEN intent NOT IN ({listed(C.INTENT_LABELS)}) THEN 'bad intent'
  WHEN empathy_signal NOT IN ({listed(C.EMPATHY_LABELS)}) THEN 'bad empathy_signal'
  WHEN is_escalation NOT IN (0, 1) THEN 'bad is_escalation'
  WHEN contains_pii NOT IN (0, 1) THEN 'bad contains_pii'
  WHEN language NOT IN ({listed(C.LANGUAGE_LABELS)}) THEN 'bad language'
  WHEN trim(text_en, {SPACES}) = '' THEN 'text_en is empty' END AS error
FROM answers""",
    "accepted": f"""
SELECT text_clean, role, sentiment_label, sentiment_score, intent,
  CASE WHEN role = 'customer' THEN 'na' ELSE empathy_signal END AS empathy_signal,
  is_escalation, contains_pii, language, trim(text_en, {SPACES}) AS text_clean_en,
  '2025-12-03 00:00:00' AS classified_at, 'rules' AS model
FROM judged WHERE error IS NULL""",
    "history": """
SELECT source AS session_id,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn_idx,
  TIMESTAMP '2025-11-01 00:00:00' + to_minutes(doc_id % 720) AS created_at,
  TIMESTAMP '2025-11-01 00:00:00' + to_minutes(doc_id % 720)
    + to_hours(CASE WHEN quality = 1 THEN 24 ELSE 4 END) AS expires_at,
  text AS question, lang AS answer, toxic
FROM documents JOIN labels USING (doc_id)""",
    "live": "SELECT * FROM history WHERE expires_at >= TIMESTAMP '2025-11-01 12:00:00'",
    "eval_rows": """
SELECT doc_id AS id, text AS answer, coalesce(quality, 0) AS evidence_count,
  CASE doc_id % 4 WHEN 0 THEN ['query_agents'] WHEN 1 THEN ['list_topics', 'semantic_search']
    WHEN 2 THEN ['get_trajectory'] ELSE []::VARCHAR[] END AS tools_used,
  round(n_chars / 37.0::DOUBLE, 2) AS latency_s,
  (quality * 3 + toxic) / 4.0::DOUBLE AS grounding_score,
  doc_id % 29 = 0 AS failed, source AS category, lang AS language,
  CASE n_chars % 3 WHEN 0 THEN ['query_agents', 'semantic_search'] WHEN 1 THEN ['get_trajectory']
    ELSE ['list_topics'] END AS expected_tools,
  CASE lang WHEN 'en' THEN ['The', 'OF', 'zebra'] WHEN 'fr' THEN ['Des', 'xylo']
    WHEN 'es' THEN ['Que'] ELSE []::VARCHAR[] END AS expected_keywords,
  doc_id % 2 AS min_evidence
FROM documents LEFT JOIN labels USING (doc_id)""",
    "eval_checks": """
SELECT *, list_has_any(expected_tools, tools_used) AS tools_ok,
  list_filter(expected_keywords, lambda w: contains(lower(answer), lower(w))) AS matched,
  list_filter(expected_keywords, lambda w: NOT contains(lower(answer), lower(w))) AS missed,
  evidence_count >= min_evidence AS evidence_ok
FROM eval_rows""",
    "eval_scored": """
SELECT *, CASE passed WHEN 3 THEN 'pass' WHEN 2 THEN 'partial' ELSE 'fail' END AS status FROM (
  SELECT *, (tool_pass + (share >= 0.5)::BIGINT + proof_pass) AS passed FROM (
    SELECT *, (tools_ok AND NOT failed)::BIGINT AS tool_pass,
      (evidence_ok AND NOT failed)::BIGINT AS proof_pass,
      CASE WHEN failed THEN 0.0 WHEN len(expected_keywords) = 0 THEN 1.0
        ELSE len(matched) / len(expected_keywords)::DOUBLE END::DOUBLE AS share
    FROM eval_checks))""",
    "vector_docs": """
SELECT vec_id AS conv_id, embedding::DOUBLE[] AS embedding, 'topic' || label AS topic,
  CASE WHEN label % 2 = 0 THEN 'en' ELSE 'hi' END AS language,
  (label % 2)::BIGINT AS escalation_flag, label / 10.0::DOUBLE - 0.5 AS sentiment
FROM embeddings""",
    "vector_queries": """
SELECT query_id, list(x ORDER BY pos) AS query FROM (
  SELECT label AS query_id, pos, avg(embedding[pos]::DOUBLE) AS x
  FROM embeddings, range(1, 65) r(pos) GROUP BY ALL)
GROUP BY query_id""",
}

CONVERSATION_ROW = f"""
SELECT conv_id, customer_name, agent_name, {stamp('start_ts')} AS start_ts,
  {stamp('end_ts')} AS end_ts, turn_count, topic,
  {nine('customer_sentiment_overall')} AS customer_sentiment_overall,
  coalesce(array_to_string(list_transform(scores, lambda x: round(x * 1000)::BIGINT), ','), '')
    AS sentiment_trajectory,
  resolution_flag, escalation_flag, {nine('agent_empathy_mean')} AS agent_empathy_mean,
  contains_pii_any
FROM """
LIST_ROW = f"""
SELECT conv_id, customer_name, agent_name, {stamp('start_ts')} AS start_ts,
  {stamp('end_ts')} AS end_ts, turn_count, topic,
  {nine('customer_sentiment_overall')} AS customer_sentiment_overall, resolution_flag,
  escalation_flag, {nine('agent_empathy_mean')} AS agent_empathy_mean
FROM """
AGENT_ROW = f"""
SELECT agent_name, conv_count::BIGINT AS conv_count,
  {nine('avg_customer_sentiment')} AS avg_customer_sentiment,
  {nine('empathy_mean')} AS empathy_mean, {nine('resolution_rate')} AS resolution_rate,
  {nine('escalation_rate')} AS escalation_rate, top_topics
FROM """
ARC = "array_to_string(list_transform(scores, lambda x: round(x * 1000)::BIGINT), ',')"

PIECES = f"regexp_extract_all(text, '({WORD}|[^A-Za-z]+)', 1)"
ALLOWED = listed(C.DOMAIN_ALLOWLIST)


def pieces_sql(source: str, key: str, threshold: float) -> str:
    """One row per piece of text, flagged if it is gibberish."""
    return f"""
SELECT {key}, pos, piece, regexp_matches(piece, '^[A-Za-z]') AS is_word,
  regexp_matches(piece, '^[A-Za-z]') AND lower(piece) NOT IN ({ALLOWED})
    AND coalesce(zipf, 0) < {threshold} AS bad
FROM (SELECT {key}, unnest({PIECES}) AS piece, generate_subscripts({PIECES}, 1) - 1 AS pos
      FROM {source})
LEFT JOIN lexicon ON lower(piece) = token"""


def metrics(*names: str) -> str:
    known = {
        "count": "count(*)",
        "avg_sentiment": nine("avg(customer_sentiment_overall)"),
        "avg_empathy": nine("avg(agent_empathy_mean)"),
        "escalation_rate": nine("avg(escalation_flag)"),
        "resolution_rate": nine("avg(resolution_flag)"),
    }
    return ", ".join(f'{known[n]} AS "{n}"' for n in names)


def topk_sql(k: int, where: str, columns: str, queries: str = "vector_queries") -> str:
    return f"""
SELECT query_id::BIGINT AS query_id,
  row_number() OVER (PARTITION BY query_id ORDER BY s DESC, conv_id) AS rank, conv_id,
  {nine('s')} AS similarity{columns}
FROM (SELECT *, round(list_cosine_similarity(embedding, query), 9) AS s
      FROM vector_docs, {queries} WHERE {where})
QUALIFY rank <= {k}"""


def asked_sql(text: str, where: str, columns: str = "rank, conv_id, similarity, topic, language") -> str:
    """The five conversations whose letter counts are most like those of a text."""
    vector = "(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id)))::FLOAT::DOUBLE"
    return f"""
WITH texts AS (
  SELECT conv_id, string_agg('[' || role || '] ' || text_clean, chr(10) ORDER BY turn_index) AS document
  FROM chat GROUP BY conv_id
  UNION ALL SELECT NULL, '{text}'
), letters AS (
  SELECT conv_id, i, {vector} AS x FROM (
    SELECT conv_id, i, length(document) - length(replace(document, chr(97 + i::INT), '')) AS n
    FROM texts, range(26) abc(i))
), embedded AS (
  SELECT conv_id, list(x ORDER BY i) AS v FROM letters GROUP BY conv_id
), languages AS (
  SELECT conv_id, CASE WHEN count(*) = 1 THEN min(language) ELSE 'mixed' END AS language FROM (
    SELECT conv_id, language, count(*) AS n FROM chat GROUP BY conv_id, language
    QUALIFY n = max(n) OVER (PARTITION BY conv_id)) GROUP BY conv_id
), hits AS (
  SELECT row_number() OVER (ORDER BY s DESC, conv_id) AS rank, conv_id, round(s, 6) AS similarity,
    topic, language
  FROM (
    SELECT *, round(list_cosine_similarity(v, (SELECT v FROM embedded WHERE conv_id IS NULL)), 9) AS s
    FROM embedded JOIN languages USING (conv_id) JOIN chat_convs USING (conv_id))
  WHERE {where} QUALIFY rank <= 5
)
SELECT {columns} FROM hits"""


QUERIES = {
    "read_turns_csv": f"""
SELECT conv_id, turn_index, {stamp('"timestamp"')} AS "timestamp", role, text_raw,
  nullif(customer_name, '') AS customer_name, nullif(agent_name, '') AS agent_name
FROM chat_raw""",
    "read_turns_csv_split": f"""
SELECT conv_id, turn_index, {stamp('"timestamp"')} AS "timestamp", role,
  text_raw || chr(10) || '"' || role || '",' || chr(10) || text_raw AS text_raw,
  nullif(customer_name, '') AS customer_name, nullif(agent_name, '') AS agent_name
FROM chat_raw""",
    "upsert_turns": f"""
SELECT conv_id, turn_index, role, text_raw || ' again.' AS text_raw, NULL::VARCHAR AS sentiment_label,
  NULL::VARCHAR AS intent, NULL::VARCHAR AS classified_at FROM chat WHERE role = 'customer'
UNION ALL
SELECT conv_id, turn_index + 100, role, text_raw, NULL, NULL, NULL
FROM chat WHERE role = 'customer'
UNION ALL
SELECT conv_id, turn_index, role, text_raw, sentiment_label, intent, {stamp('classified_at')}
FROM chat WHERE role <> 'customer'""",
    "materialize": "SELECT text_clean, 'skipped' AS stage FROM event_openers"
    " UNION ALL SELECT text_clean, 'forced' FROM chat_openers",
    "write_rollups": """
SELECT strftime(start_ts, '%Y-%m') AS part, count(*) AS n, sum(turn_count)::BIGINT AS total
FROM chat_convs GROUP BY ALL
UNION ALL SELECT 'agents', count(*), sum(conv_count)::BIGINT FROM chat_agents""",
    "taxonomy_tables": f"""
SELECT slot, category, label, description, coalesce(n, 0) AS n_turns
FROM slots JOIN categories ON id = category
LEFT JOIN (SELECT {slot_sql('text_clean')} AS slot, count(*) AS n FROM chat
           WHERE role = 'customer' GROUP BY 1) USING (slot)""",
    "write_vectors": "SELECT topic, count(*) AS n, sum(len(embedding))::BIGINT AS n_values,"
    " max(conv_id) AS last_id FROM vector_docs GROUP BY topic",
    "write_eval_results": """
SELECT status, count(*) AS n,
  sum(len(CASE WHEN failed THEN expected_keywords ELSE missed END))::BIGINT AS n_missed
FROM eval_scored GROUP BY status""",
    "truncate_last_terminator": f"SELECT doc_id, {cut('text')} AS text_clean, '' AS none_found"
    " FROM documents",
    "gibberish_tokens": f"""
SELECT doc_id, piece AS token, count(*) AS n, min(pos // 2) AS first_pos, max(pos // 2) AS last_pos
FROM ({pieces_sql('documents', 'doc_id', C.ZIPF_THRESHOLD)}) WHERE bad GROUP BY ALL""",
    "strip_gibberish": f"""
SELECT doc_id, {tidy('kept')} AS stripped FROM (
  SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT bad), '') AS kept
  FROM ({pieces_sql('documents', 'doc_id', C.ZIPF_THRESHOLD)}) GROUP BY doc_id)""",
    "gibberish_ratio": f"""
SELECT doc_id, {nine('coalesce(avg(bad::BIGINT) FILTER (is_word), 0.0)')} AS gibberish_ratio
FROM ({pieces_sql('documents', 'doc_id', 5.5)}) GROUP BY doc_id""",
    "clean_turns": f"""
SELECT conv_id, turn_index, {tidy('kept')} AS text_clean FROM (
  SELECT conv_id, turn_index,
    coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT bad), '') AS kept
  FROM ({pieces_sql("(SELECT conv_id, turn_index, text_clean AS text FROM chat)",
                    'conv_id, turn_index', C.ZIPF_THRESHOLD)})
  GROUP BY conv_id, turn_index)""",
    "cleaning_counts": f"SELECT count(*) AS turns, count(*) FILTER ({cut('text')} = '')"
    " AS empty_texts FROM documents",
    "extract_slot": f"""
SELECT conv_id, turn_index, {slot_sql('text_clean')} AS slot,
  {template_sql('text_clean')} AS template
FROM chat WHERE role = 'customer'""",
    "match_no_slot": """
SELECT DISTINCT replace(text_clean, '''', '’') AS text_clean, category AS opener_category
FROM chat_openers LEFT JOIN openers ON replace(text_clean, '’', '''') = opener""",
    "resolve_topic": topic_sql("chat_openers", "text_clean"),
    "distinct_openers": "SELECT text_clean FROM event_openers",
    "taxonomy_coverage": f"""
WITH all_slots AS (SELECT * FROM slots UNION ALL
  SELECT * FROM customer_slots WHERE category IN ('n1', 'n2')),
seen AS (SELECT text_clean, {slot_sql('text_clean')} AS slot,
  {template_sql('text_clean')} AS template FROM chat_openers)
SELECT DISTINCT 'slot' AS kind, slot AS value FROM seen WHERE slot IS NOT NULL
UNION SELECT 'unmatched_opener', text_clean FROM seen WHERE template IS NULL
UNION SELECT 'unmapped_slot', slot FROM seen
  WHERE slot IS NOT NULL AND slot NOT IN (SELECT slot FROM all_slots)
UNION SELECT 'unknown_category', category FROM all_slots
  WHERE category NOT IN (SELECT id FROM categories)""",
    "category_slot_counts": """
SELECT 'n' || n_nationkey AS id, n_name AS label, count(slot) AS n_slots
FROM nation LEFT JOIN customer_slots ON category = 'n' || n_nationkey GROUP BY ALL""",
    "redact_pii": f"SELECT doc_id, {redact('text')} AS redacted FROM documents",
    "doc_excerpt": r"""
SELECT doc_id, array_to_string(string_split(
  regexp_replace(regexp_replace(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]',
    chr(10), 'g'), '\n$', ''), chr(10))[1:6], chr(10)) AS excerpt
FROM documents""",
    "pending_texts": "SELECT text_clean, role FROM pending",
    "label_texts": "SELECT * REPLACE (md5(text_clean) AS text_clean,"
    f" {nine('sentiment_score')} AS sentiment_score) FROM ({rule_sql('document_pairs')})",
    "label_texts_by_function": r"SELECT role, CASE WHEN regexp_extract(text_clean, '\d+')::INT % 2"
    " = 1 THEN 'neg' ELSE 'neu' END AS sentiment_label, count(*) AS n FROM pending GROUP BY ALL",
    "label_pending": r"SELECT role, CASE WHEN regexp_extract(text_clean, '\d+')::INT % 2"
    " = 1 THEN 'neg' ELSE 'neu' END AS sentiment_label, count(*) AS n"
    " FROM (SELECT text_clean, min(role) AS role FROM pending GROUP BY text_clean) GROUP BY ALL",
    "validate_labels": "SELECT * FROM accepted",
    "validate_labels_rejected": "SELECT text_clean, role, error FROM judged WHERE error IS NOT NULL",
    "upsert_labels": """
SELECT * EXCLUDE (fresh) FROM (
  SELECT *, 1 AS fresh FROM accepted WHERE intent = 'query' AND language <> 'mixed'
  UNION ALL SELECT * REPLACE ('old' AS model), 0 FROM accepted WHERE role = 'customer')
QUALIFY row_number() OVER (PARTITION BY text_clean ORDER BY fresh DESC, role) = 1""",
    "propagate_labels": "SELECT conv_id, turn_index, t.text_clean, " + ", ".join(
        f"CASE WHEN l.text_clean IS NOT NULL THEN l.{c} ELSE t.{c} END AS {c}"
        for c in ("sentiment_label", "sentiment_score", "intent", "empathy_signal",
                  "is_escalation", "contains_pii", "language")
    ) + f""", CASE WHEN l.text_clean IS NOT NULL THEN l.text_clean ELSE t.text_clean_en END
    AS text_clean_en,
  CASE WHEN l.text_clean IS NOT NULL THEN '2025-12-03 00:00:00' ELSE {stamp('t.classified_at')}
    END AS classified_at
FROM unlabelled t LEFT JOIN event_labels l ON t.text_clean = l.text_clean""",
    "latest_turns": "SELECT conv_id, turn_index, role, text_raw FROM chat",
    "unlabelled_gate": "SELECT count(*) AS n_unlabelled FROM unlabelled WHERE sentiment_label IS NULL",
    "require_labelled": "SELECT role, count(*) AS n FROM event_turns GROUP BY role",
    "conversation_rollup": CONVERSATION_ROW + "chat_convs",
    "conversation_rollup_events": CONVERSATION_ROW + "event_convs",
    "conversation_rollup_far": CONVERSATION_ROW + "chat_convs",
    "sentiment_trajectory_parts": """
SELECT conv_id, (turn_index // 2)::BIGINT AS part,
  string_agg(round(sentiment_score * 1000)::BIGINT::VARCHAR, ',' ORDER BY turn_index) AS scores
FROM event_turns WHERE role = 'customer' GROUP BY ALL""",
    "agent_rollup": AGENT_ROW + "chat_agents",
    "agent_rollup_events": AGENT_ROW + "event_agents",
    "updated_conversations": CONVERSATION_ROW + "chat_convs",
    "updated_agents": AGENT_ROW + "chat_agents",
    "updated_turns": f"""
SELECT conv_id, turn_index::BIGINT AS turn_index, role, agent_name, {nine('sentiment_score')} AS sentiment_score,
  text_clean FROM chat""",
    "conversation_document": """
SELECT conv_id, 0::BIGINT AS part,
  string_agg('[' || role || '] ' || text_clean, chr(10) ORDER BY turn_index) AS document
FROM chat GROUP BY conv_id""",
    "conversation_document_parts": """
SELECT conv_id, (turn_index // 3)::BIGINT AS part,
  string_agg('[' || role || '] ' || text_clean, chr(10) ORDER BY turn_index) AS document
FROM event_turns GROUP BY ALL""",
    "majority_language": """
SELECT conv_id, CASE WHEN count(*) = 1 THEN min(language) ELSE 'mixed' END AS language FROM (
  SELECT conv_id, language, count(*) AS n FROM event_turns GROUP BY conv_id, language
  QUALIFY n = max(n) OVER (PARTITION BY conv_id))
GROUP BY conv_id""",
    "document_metadata": f"""
SELECT conv_id, coalesce(agent_name, '') AS agent_name,
  coalesce(customer_name, '') AS customer_name, turn_count, {stamp('start_ts')} AS start_ts,
  {stamp('end_ts')} AS end_ts, topic,
  {nine('coalesce(customer_sentiment_overall, 0)')} AS customer_sentiment_overall,
  escalation_flag, language
FROM chat_convs JOIN (
  SELECT conv_id, CASE WHEN count(*) = 1 THEN min(language) ELSE 'mixed' END AS language FROM (
    SELECT conv_id, language, count(*) AS n FROM chat GROUP BY conv_id, language
    QUALIFY n = max(n) OVER (PARTITION BY conv_id)) GROUP BY conv_id) USING (conv_id)""",
    "document_metadata_from_turns": f"""
SELECT conv_id, coalesce(agent_name, '') AS agent_name, '' AS customer_name, turn_count,
  {stamp('start_ts')} AS start_ts, {stamp('end_ts')} AS end_ts, 'unknown' AS topic,
  {nine('coalesce(customer_sentiment_overall, 0)')} AS customer_sentiment_overall,
  escalation_flag, language
FROM event_folded JOIN (
  SELECT conv_id, CASE WHEN count(*) = 1 THEN min(language) ELSE 'mixed' END AS language FROM (
    SELECT conv_id, language, count(*) AS n FROM event_turns GROUP BY conv_id, language
    QUALIFY n = max(n) OVER (PARTITION BY conv_id)) GROUP BY conv_id) USING (conv_id)""",
    "vector_documents": f"""
SELECT conv_id, 0::BIGINT AS part, n_chars, topic, language,
  {nine('coalesce(customer_sentiment_overall, 0)')} AS customer_sentiment_overall
FROM chat_convs JOIN (
  SELECT conv_id, CASE WHEN count(*) = 1 THEN min(language) ELSE 'mixed' END AS language FROM (
    SELECT conv_id, language, count(*) AS n FROM chat GROUP BY conv_id, language
    QUALIFY n = max(n) OVER (PARTITION BY conv_id)) GROUP BY conv_id) USING (conv_id)
JOIN (SELECT conv_id, sum(length(role) + 3 + length(text_clean))::BIGINT + count(*) - 1 AS n_chars
      FROM chat GROUP BY conv_id) USING (conv_id)""",
    "embed_documents": "SELECT DISTINCT conv_id, 256::BIGINT AS dim, 1.0::DOUBLE AS norm FROM chat",
    "embed_documents_far": "SELECT DISTINCT conv_id, 1.0::DOUBLE AS cosine FROM chat",
    "embed_documents_by_function": """
WITH docs AS (SELECT conv_id,
    string_agg('[' || role || '] ' || text_clean, chr(10) ORDER BY turn_index) AS document
  FROM chat GROUP BY conv_id),
counts AS (SELECT conv_id, i, length(document) - length(replace(document, chr(97 + i::INT), '')) AS n
  FROM docs, range(26) letters(i))
SELECT conv_id, string_agg(round(10000 * (n / sqrt(total))::FLOAT::DOUBLE)::BIGINT::VARCHAR, ',' ORDER BY i)
  AS vector
FROM (SELECT *, sum(n * n) OVER (PARTITION BY conv_id) AS total FROM counts) GROUP BY conv_id""",
    "semantic_topk": topk_sql(10, "true", ", topic, escalation_flag"),
    "semantic_topk_all_cells": topk_sql(10, "true", ", topic, escalation_flag"),
    "semantic_topk_of_documents": topk_sql(
        10, "true", "",
        "(SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0)"),
    "semantic_topk_recall": """
SELECT count(*)::BIGINT AS n_queries, 1::BIGINT AS enough_found, 1::BIGINT AS fewer_scored
FROM embeddings WHERE vec_id % 50 = 0""",
    "semantic_topk_filtered": topk_sql(
        5, "language = 'hi' AND escalation_flag = 1 AND sentiment <= 0.2 AND sentiment >= -0.4",
        ", topic"),
    "app_crashes_in_language": asked_sql("app crash ho rahi hai while using", "language = 'hi'"),
    "app_crashes_transcript": asked_sql(
        "app crash ho rahi hai while using", "language = 'hi'",
        "conv_id, topic, (SELECT count(*) FROM chat WHERE chat.conv_id = hits.conv_id)::BIGINT AS n_turns",
    ) + " WHERE rank = 1",
    "billing_and_refund_problems": asked_sql("billing aur refund ki problems, charged twice", "true"),
    "frustrated_after_escalation": asked_sql(
        "frustrated, escalate, still not resolved", "escalation_flag = 1 AND resolution_flag = 0"),
    "filter_conversations": f"""
SELECT conv_id, {stamp('start_ts')} AS start_ts, topic,
  {nine('customer_sentiment_overall')} AS customer_sentiment_overall
FROM chat_convs
WHERE start_ts >= TIMESTAMP '2025-08-15' AND start_ts <= TIMESTAMP '2025-11-30 23:59:59'
  AND customer_sentiment_overall >= -0.6 AND customer_sentiment_overall <= 0.4
  AND escalation_flag = 0 AND conv_id IN (SELECT conv_id FROM chat WHERE language = 'hi')""",
    "filter_conversations_by_agent": f"""
SELECT conv_id, {stamp('start_ts')} AS start_ts, agent_name, resolution_flag FROM event_convs
WHERE strftime(start_ts, '%Y-%m') = '2024-01' AND agent_name = 'Agent007'
  AND resolution_flag = 1 AND topic = 'unknown'""",
    "list_conversations": LIST_ROW + "(SELECT * FROM chat_convs"
    " ORDER BY chat_convs.customer_sentiment_overall ASC NULLS FIRST, conv_id LIMIT 50)",
    "list_conversations_by_start": LIST_ROW + "(SELECT * FROM event_convs"
    " ORDER BY event_convs.start_ts DESC NULLS LAST, conv_id LIMIT 100)",
    "aggregate_conversations": f"""
SELECT topic AS group_key, {metrics("count", "avg_sentiment", "avg_empathy", "escalation_rate",
                                    "resolution_rate")}
FROM chat_convs GROUP BY topic ORDER BY "count" DESC, group_key LIMIT 100""",
    "aggregate_conversations_by_agent": f"""
SELECT agent_name AS group_key, {metrics("resolution_rate", "count")}
FROM event_convs GROUP BY agent_name ORDER BY "count" ASC, group_key NULLS FIRST LIMIT 20""",
    "aggregate_conversations_by_month": f"""
SELECT strftime(start_ts, '%Y-%m') AS group_key, {metrics("avg_sentiment", "avg_empathy")}
FROM chat_convs GROUP BY 1 ORDER BY avg_empathy DESC NULLS LAST, group_key LIMIT 10""",
    "aggregate_conversations_by_language": f"""
SELECT language AS group_key, {metrics("count", "avg_sentiment")}
FROM event_convs LEFT JOIN (SELECT conv_id, arg_min(language, turn_index) AS language
  FROM event_turns GROUP BY conv_id) USING (conv_id)
GROUP BY language ORDER BY "count" DESC, group_key LIMIT 10""",
    "rank_agents": AGENT_ROW + "(SELECT * FROM chat_agents WHERE conv_count >= 3"
    " ORDER BY chat_agents.resolution_rate DESC NULLS LAST, agent_name LIMIT 15)",
    "conversation_trajectory": f"""
SELECT conv_id, 0::BIGINT AS part, topic,
  {nine('customer_sentiment_overall')} AS customer_sentiment_overall, resolution_flag,
  escalation_flag, coalesce({ARC}, '') AS customer_arc, turn_index, role, sentiment_label,
  {nine('sentiment_score')} AS sentiment_score, intent, empathy_signal, text_clean
FROM chat JOIN (SELECT conv_id, topic, customer_sentiment_overall, resolution_flag,
  escalation_flag, scores FROM chat_convs) USING (conv_id)""",
    "conversation_transcript": f"""
SELECT conv_id, 0::BIGINT AS part, h.customer_name, h.agent_name, {stamp('start_ts')} AS start_ts,
  {stamp('end_ts')} AS end_ts, topic,
  {nine('customer_sentiment_overall')} AS customer_sentiment_overall, resolution_flag,
  escalation_flag, turn_index, role, {stamp('"timestamp"')} AS "timestamp", text_clean,
  NULL::VARCHAR AS text_clean_en, language, sentiment_label,
  {nine('sentiment_score')} AS sentiment_score, intent, empathy_signal, is_escalation, contains_pii
FROM chat t JOIN chat_convs h USING (conv_id)""",
    "conversation_transcript_translated": """
SELECT conv_id, h.agent_name, turn_index, text_clean, text_clean_en, language
FROM event_turns JOIN event_convs h USING (conv_id)""",
    "topic_counts": """
SELECT id, label, description, count(conv_id) AS count_in_dataset
FROM categories LEFT JOIN chat_convs ON topic = id GROUP BY ALL""",
    "topic_example": """
SELECT topic, arg_min(conv_id, (customer_sentiment_overall, conv_id))
  FILTER (customer_sentiment_overall IS NOT NULL) AS conv_id
FROM chat_convs GROUP BY topic""",
    "list_topics": """
SELECT id, label, description, count(conv_id) AS count_in_dataset,
  arg_min(conv_id, (customer_sentiment_overall, conv_id))
    FILTER (customer_sentiment_overall IS NOT NULL) AS example_conv_id
FROM categories LEFT JOIN chat_convs ON topic = id GROUP BY ALL""",
    "top_negative_topics_in_month": f"""
SELECT topic AS group_key, {metrics("avg_sentiment", "count")} FROM chat_convs
WHERE strftime(start_ts, '%Y-%m') = '2025-11' GROUP BY topic
ORDER BY avg_sentiment ASC NULLS FIRST, group_key LIMIT 5""",
    "highest_escalation_topic": f"""
SELECT topic AS group_key, {metrics("escalation_rate", "count")} FROM chat_convs
GROUP BY topic ORDER BY escalation_rate DESC, group_key LIMIT 1""",
    "resolved_vs_unresolved": 'SELECT resolution_flag, count(*) AS "count" FROM event_convs'
    " GROUP BY resolution_flag",
    "low_empathy_agents_with_quote": f"""
SELECT agent_name, conv_count, {nine('empathy_mean')} AS empathy_mean,
  conv_id AS quote_conv_id, turn_index AS quote_turn_index, text_clean AS quote
FROM (SELECT * FROM chat_agents WHERE conv_count >= 2
      ORDER BY chat_agents.empathy_mean ASC NULLS FIRST, agent_name LIMIT 10)
LEFT JOIN (
  SELECT agent_name, conv_id, turn_index, text_clean
  FROM (SELECT *, {empathy_sql('empathy_signal')} AS score FROM chat WHERE role = 'agent')
  WHERE score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY score, conv_id, turn_index) = 1)
  USING (agent_name)""",
    "compare_agents": AGENT_ROW + "chat_agents WHERE agent_name IN ('Agent007', 'Agent014')",
    "sentiment_arc": f"""
SELECT conv_id, 0::BIGINT AS part, topic,
  {nine('customer_sentiment_overall')} AS customer_sentiment_overall,
  coalesce({ARC}, '') AS customer_arc FROM chat_convs""",
    "sentiment_inflections": f"""
WITH scored AS (SELECT conv_id, turn_index, sentiment_score AS score, sentiment_score
    - lag(sentiment_score) OVER (PARTITION BY conv_id ORDER BY turn_index) AS change
  FROM event_turns WHERE role = 'customer'),
moves AS (SELECT *, lag(change) OVER (PARTITION BY conv_id ORDER BY turn_index) AS previous_change
  FROM scored WHERE change <> 0)
SELECT conv_id, turn_index, {nine('score')} AS score, {nine('change')} AS change,
  {nine('previous_change')} AS previous_change
FROM moves WHERE sign(change) <> sign(previous_change)""",
    "severity_ranking_with_example": f"""
SELECT topic, {metrics("count", "avg_sentiment", "escalation_rate")},
  arg_min(conv_id, (customer_sentiment_overall, conv_id))
    FILTER (customer_sentiment_overall IS NOT NULL) AS example_conv_id
FROM chat_convs GROUP BY topic""",
    "high_volume_low_resolution": f"""
WITH per_topic AS (SELECT topic, count(*) AS n, avg(resolution_flag) AS rate FROM chat_convs
  GROUP BY topic)
SELECT topic, n AS "count", {nine('rate')} AS resolution_rate FROM per_topic
WHERE n >= (SELECT avg(n) FROM per_topic)
  AND rate <= (SELECT avg(resolution_flag) FROM chat_convs)""",
    "urgent_turns_by_language": f"""
SELECT conv_id, turn_index, language, {nine('sentiment_score')} AS sentiment_score, text_clean
FROM chat WHERE role = 'customer' AND intent = 'urgency_request' AND language = 'hi'""",
    "agent_drilldown": f"""
SELECT agent_name, conv_count, {nine('empathy_mean')} AS empathy_mean, conv_id, turn_index, role,
  text_clean
FROM (SELECT * FROM chat_agents WHERE agent_name = 'Agent007')
JOIN (SELECT agent_name, min(conv_id) AS conv_id FROM chat_convs GROUP BY agent_name)
  USING (agent_name)
JOIN (SELECT conv_id, turn_index, role, text_clean FROM chat) USING (conv_id)""",
    "escalated_not_resolved": f"""
SELECT conv_id, agent_name, {nine('customer_sentiment_overall')} AS customer_sentiment_overall,
  turn_index AS quote_turn_index, {nine('sentiment_score')} AS quote_score, text_clean AS quote
FROM (SELECT * FROM chat_convs WHERE topic = 'billing_refunds' AND escalation_flag = 1
      AND resolution_flag = 0)
LEFT JOIN (SELECT conv_id, turn_index, sentiment_score, text_clean FROM chat
  WHERE role = 'customer'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY sentiment_score, turn_index) = 1)
  USING (conv_id)""",
    "append_sessions": f"""
SELECT session_id, turn_idx, {stamp('created_at')} AS created_at,
  {stamp('expires_at')} AS expires_at, question, CASE WHEN toxic = 0 THEN answer END AS answer,
  NULL::VARCHAR AS evidence, CASE WHEN toxic = 1 THEN '{{"answer": "cut' END AS broken
FROM live
UNION ALL
SELECT source, coalesce(reached, -1) + row_number() OVER (PARTITION BY source ORDER BY doc_id),
  '2025-11-01 12:00:00', '2025-11-03 12:00:00', {redact('text')},
  {redact("lang || ': ' || text")}, {redact('text')}, NULL
FROM documents LEFT JOIN (SELECT session_id, max(turn_idx) AS reached FROM live GROUP BY ALL)
  ON session_id = source
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "purge_expired": f"SELECT session_id, turn_idx, {stamp('expires_at')} AS expires_at, question"
    " FROM live",
    "recent_turns": """
SELECT session_id, turn_idx, question, answer FROM (
  SELECT * FROM live
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_idx DESC) <= 5)
WHERE toxic = 0""",
    "tool_selection": "SELECT id, tools_ok::BIGINT AS tool_selection_pass FROM eval_checks",
    "keyword_coverage": f"""
SELECT id, {nine('CASE WHEN len(expected_keywords) = 0 THEN 1.0 ELSE len(matched)'
                ' / len(expected_keywords)::DOUBLE END')} AS coverage,
  coalesce(array_to_string(matched, '|'), '') AS coverage_matched,
  coalesce(array_to_string(missed, '|'), '') AS coverage_missed
FROM eval_checks""",
    "evidence_pass": "SELECT id, evidence_ok::BIGINT AS evidence_pass FROM eval_checks",
    "eval_status": "SELECT id, tool_pass AS tool_selection_pass, round(share, 3) AS coverage,"
    " proof_pass AS evidence_pass, status, latency_s FROM eval_scored",
    "eval_summary": """
SELECT count(*) AS n_questions, round(avg((status = 'pass')::BIGINT), 3) AS pass_rate,
  round(avg((status = 'partial')::BIGINT), 3) AS partial_rate,
  round(avg((status = 'fail')::BIGINT), 3) AS fail_rate,
  round(avg(latency_s), 2) AS mean_latency_s, round(median(latency_s), 2) AS median_latency_s,
  round(list_sort(list(latency_s))[(0.95::DOUBLE * (count(*) - 1))::DOUBLE.floor()::BIGINT + 1], 2)
    AS p95_latency_s,
  round(avg(grounding_score), 3) AS mean_grounding
FROM eval_scored""".replace(
        "(0.95::DOUBLE * (count(*) - 1))::DOUBLE.floor()::BIGINT",
        "floor(0.95::DOUBLE * (count(*) - 1))::BIGINT"),
    "pass_rate_by_category": "SELECT category, round(avg((status = 'pass')::BIGINT), 3)"
    " AS pass_rate FROM eval_scored GROUP BY category",
    "pass_rate_by_language": "SELECT language, round(avg((status = 'pass')::BIGINT), 3)"
    " AS pass_rate FROM eval_scored GROUP BY language",
    "table_counts": """
SELECT 'turns' AS metric, count(*) AS n FROM event_turns
UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM event_turns
UNION ALL SELECT 'distinct_agents', count(DISTINCT agent_name) FROM event_turns
UNION ALL SELECT 'distinct_texts', count(DISTINCT text_clean) FROM event_turns""",
    "label_distribution": """
SELECT 'language' AS label, language AS value, count(*) AS n FROM unlabelled GROUP BY language
UNION ALL SELECT 'sentiment_label', sentiment_label, count(*) FROM unlabelled
GROUP BY sentiment_label""",
    "agent_empathy_distribution": "SELECT empathy_signal, count(*) AS n FROM event_turns"
    " WHERE role = 'agent' GROUP BY empathy_signal",
    "date_range": f"SELECT {stamp('min(start_ts)')} AS min_start_ts,"
    f" {stamp('max(start_ts)')} AS max_start_ts FROM chat_convs",
    "agents_by_conv_count": """
SELECT conv_count, count(*) AS n_agents FROM (
  SELECT agent_name, count(DISTINCT conv_id) AS conv_count FROM event_turns GROUP BY agent_name)
GROUP BY conv_count""",
}


def with_fragments(sql: str) -> str:
    """Prefix a query with the fragments it needs, directly or through others."""
    needed: set[str] = set()
    texts = [sql]
    while texts:
        words = set(re.findall(r"[a-z_]+", texts.pop()))
        for name in FRAGMENTS.keys() & words - needed:
            needed.add(name)
            texts.append(FRAGMENTS[name])
    named = [f"{name} AS ({text})" for name, text in FRAGMENTS.items() if name in needed]
    body = sql.strip()
    if named and body.startswith("WITH "):
        return "WITH " + ",\n".join(named) + ",\n" + body[len("WITH "):]
    return ("WITH " + ",\n".join(named) + "\n" if named else "") + body


ORACLE = {name: with_fragments(sql) for name, sql in QUERIES.items()}
