"""Registered queries of sessions, configuration and invariant checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import quality as Q
from docloom.operators import sessions as K
from docloom.plans.bridge import Corpus, digit
from docloom.plans.oracle_base import CTES, OPEN_OPS, OPS, compose, cte, digit as sql_digit
from docloom.plans.registry import register

cte("commands", """
SELECT 'session-' || user_id AS session_id, event_id AS seq, 'cmd-' || CASE WHEN k < 20 THEN k ELSE event_id + 1000 END AS command_id,
  CASE WHEN k % 3 <> 0 THEN k % 37 END AS expected, CASE event_type WHEN 'view' THEN 'focus_chapter' WHEN 'error' THEN 'retry_translation' ELSE 'reading_assistant' END AS type, k % 11 = 5 AS failed, ts
FROM event_keys""")
cte("fresh_commands", """
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY session_id, command_id ORDER BY seq) AS copy FROM commands) WHERE copy = 1""")
cte("recursive_receipts", """
SELECT session_id, rn, command_id, (NOT failed AND (expected IS NULL OR type = 'focus_chapter' OR expected = 0)) AS ok, 0 AS before, expected IS NOT NULL AND type <> 'focus_chapter' AND expected <> 0 AS stale FROM fresh_commands WHERE rn = 1
UNION ALL SELECT c.session_id, c.rn, c.command_id, NOT c.failed AND (c.expected IS NULL OR c.type = 'focus_chapter' OR c.expected = r.before + r.ok::INT), r.before + r.ok::INT,
  c.expected IS NOT NULL AND c.type <> 'focus_chapter' AND c.expected <> r.before + r.ok::INT
FROM recursive_receipts r JOIN fresh_commands c ON c.session_id = r.session_id AND c.rn = r.rn + 1""")
register("K1_replay_commands", lambda c: K.replay_commands(c.commands),
         compose("""SELECT c.session_id, c.seq, c.command_id, CASE WHEN f.rn IS NULL THEN 'duplicate' WHEN r.ok THEN 'accepted' ELSE 'rejected' END AS status, (r.before + r.ok::INT)::BIGINT AS revision,
  CASE WHEN r.ok THEN NULL WHEN r.stale THEN 'stale_revision' ELSE 'action_failed' END AS reason
FROM commands c JOIN recursive_receipts r ON r.session_id = c.session_id AND r.command_id = c.command_id LEFT JOIN fresh_commands f ON f.session_id = c.session_id AND f.seq = c.seq"""))
cte("recursive_starts", """
SELECT session_id, command_id, min(seq) AS seq FROM commands GROUP BY 1, 2
UNION ALL SELECT r.session_id, r.command_id, min(c.seq) FROM recursive_starts r JOIN commands b ON b.session_id = r.session_id AND b.seq = r.seq
JOIN commands c ON c.session_id = r.session_id AND c.command_id = r.command_id AND c.seq > r.seq AND c.ts > b.ts + INTERVAL 24 HOUR GROUP BY 1, 2""")
cte("kept_commands", "SELECT c.*, row_number() OVER (PARTITION BY c.session_id ORDER BY c.seq) AS rn FROM commands c JOIN recursive_starts s ON s.session_id = c.session_id AND s.seq = c.seq")
cte("recursive_kept", CTES["recursive_receipts"].replace("fresh_commands", "kept_commands").replace("recursive_receipts", "recursive_kept").replace("rn, command_id,", "rn, seq, command_id,").replace("c.rn, c.command_id,", "c.rn, c.seq, c.command_id,"))
register("K1_replay_with_expiry", lambda c: K.replay_commands(c.commands, keep=K.KEEP_RECEIPTS),
         compose("""SELECT c.session_id, c.seq, c.command_id, CASE WHEN c.seq <> c.first THEN 'duplicate' WHEN r.ok THEN 'accepted' ELSE 'rejected' END AS status, (r.before + r.ok::INT)::BIGINT AS revision,
  CASE WHEN r.ok THEN NULL WHEN r.stale THEN 'stale_revision' ELSE 'action_failed' END AS reason
FROM (SELECT c.session_id, c.seq, c.command_id, max(s.seq) AS first FROM commands c JOIN recursive_starts s ON s.session_id = c.session_id AND s.command_id = c.command_id AND s.seq <= c.seq GROUP BY 1, 2, 3) c
JOIN recursive_kept r ON r.session_id = c.session_id AND r.seq = c.first"""))
cte("open_log", "SELECT 'doc-' || user_id AS document_id, event_id AS seq, CASE WHEN event_type IN ('view', 'signup') THEN 'open' ELSE 'close' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events")
cte("recursive_counts", """
SELECT document_id, rn, seq, action, CASE WHEN action = 'open' THEN 1 ELSE 0 END AS n FROM open_log WHERE rn = 1
UNION ALL SELECT l.document_id, l.rn, l.seq, l.action, greatest(c.n + CASE WHEN l.action = 'open' THEN 1 ELSE -1 END, 0) FROM recursive_counts c JOIN open_log l ON l.document_id = c.document_id AND l.rn = c.rn + 1""")
register("K2_active_sessions", lambda c: K.active_sessions(c.open_log),
         compose("""SELECT document_id, no::BIGINT AS session_no, min(seq) AS opened_at, max(n)::BIGINT AS peak_subscribers, min(CASE WHEN action = 'close' AND n = 0 THEN seq END) AS closed_at
FROM (SELECT *, count(*) FILTER (action = 'open' AND n = 1) OVER (PARTITION BY document_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS no FROM (
  SELECT *, lag(n, 1, 0) OVER (PARTITION BY document_id ORDER BY rn) AS p FROM recursive_counts)) WHERE no > 0 GROUP BY 1, 2""").replace("action = 'open' AND n = 1", "action = 'open' AND p = 0"))


def _sessions(c: Corpus):
    ch = c.normalized.chapters
    return ch.select(
        F.concat(F.lit("s-"), "chapter_id").alias("session_id"), F.col("doc_id").alias("document_id"),
        F.when(digit("chapter_id") < 6, F.lit("gone")).otherwise(F.col("chapter_id")).alias("active_chapter_id"))


register("K3_remap_active_chapter", lambda c: K.remap_active_chapter(_sessions(c), c.normalized.chapters),
         compose(f"""SELECT 's-' || chapter_id AS session_id, doc_id AS document_id, CASE WHEN {sql_digit('chapter_id')} < 6 THEN first_value(chapter_id) OVER (PARTITION BY doc_id ORDER BY order_index) ELSE chapter_id END AS active_chapter_id
FROM chapters_all"""))
register("K4_live_tokens", lambda c: K.live_tokens(
    c.table("events").select(F.concat(F.lit("tok-"), "event_id").alias("token"), F.col("event_id").alias("issued_at")),
    c.table("events").filter("event_type = 'error'").select(F.concat(F.lit("tok-"), "event_id").alias("token"))),
    "SELECT 'tok-' || event_id AS token, event_id AS issued_at FROM events WHERE event_type <> 'error' ORDER BY event_id DESC LIMIT 32")
HOST = "'host' || (event_id % 20) || '.example.com'"
cte("endpoint_rows", f"""
SELECT *, CASE WHEN o IS NOT NULL THEN sha256(kind || chr(10) || o || p || chr(10) || '1') END AS fingerprint FROM (
SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'translation' ELSE 'mineru' END AS kind,
  CASE event_id % 12 WHEN 0 THEN 'https://' || {HOST} WHEN 1 THEN 'https://' || {HOST} WHEN 2 THEN 'https://' || {HOST} WHEN 4 THEN 'http://localhost:8080' WHEN 7 THEN 'http://127.0.0.1'
    WHEN 9 THEN 'http://[::1]:9' WHEN 10 THEN 'https://' || {HOST} || ':8443' END AS o,
  CASE event_id % 12 WHEN 0 THEN '/v1' WHEN 1 THEN '/v1' WHEN 2 THEN '/v1' WHEN 4 THEN '' WHEN 7 THEN '/api' WHEN 9 THEN '/x' WHEN 10 THEN '' END AS p,
  CASE WHEN event_id % 12 = 3 THEN 'insecure_remote_url' WHEN event_id % 12 IN (5, 6, 8, 11) THEN 'invalid_url' END AS error_code FROM events)""")
register("K5_normalize_endpoints", lambda c: K.normalize_endpoints(c.endpoints).drop("endpoint"),
         compose("SELECT event_id, kind, o AS origin, p AS base_path, fingerprint, error_code FROM endpoint_rows"))


def _profiles(c: Corpus):
    schema = "owner_id string, kind string, origin string, base_path string, fingerprint string, model_id string, context_window long, updated_at long, created_at long"
    good = K.normalize_endpoints(c.profile_updates).filter("error_code IS NULL").withColumn("created_at", F.lit(0).cast("long"))
    names = [p.split()[0] for p in schema.split(", ")]
    return good.groupBy("owner_id", "kind").agg(F.min_by(F.struct(*names[2:]), "updated_at").alias("p")).select("owner_id", "kind", "p.*")


register("K6_upsert_profiles", lambda c: K.upsert_profiles(_profiles(c), c.profile_updates)[0],
         compose("""WITH u AS (SELECT 'u-' || user_id AS owner_id, kind, o AS origin, p AS base_path, fingerprint, CASE WHEN event_id % 5 <> 0 THEN 'model-' || (event_id % 3) END AS model_id,
  (CASE WHEN event_id % 7 = 0 THEN 100 WHEN event_id % 7 < 4 THEN 8192 END)::BIGINT AS context_window, event_id AS updated_at FROM endpoint_rows WHERE error_code IS NULL),
old AS (SELECT * FROM (SELECT *, 0 AS created_at, row_number() OVER (PARTITION BY owner_id, kind ORDER BY updated_at) AS rn FROM u) WHERE rn = 1),
n AS (SELECT * EXCLUDE (rn) FROM old UNION ALL SELECT *, updated_at FROM u WHERE NOT (kind = 'translation' AND model_id IS NULL) AND coalesce(context_window, 8192) >= 1024)
SELECT * EXCLUDE (rn, created_at), (SELECT min(created_at) FROM n m WHERE m.owner_id = q.owner_id AND m.kind = q.kind)::BIGINT AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, kind ORDER BY updated_at DESC) AS rn FROM n) q WHERE rn = 1"""))
register("K7_classify_probes", lambda c: K.classify_probes(c.probes).select("event_id", "code"),
         """SELECT event_id, CASE WHEN s = 401 THEN 'unauthorized' WHEN s = 429 THEN 'rate_limited' WHEN s = 503 THEN 'server_error' WHEN b = 4 THEN 'protocol_incompatible'
  WHEN event_id % 2 = 1 THEN CASE WHEN b IN (1, 2, 8) THEN 'unauthorized' WHEN b IN (0, 7, 9) THEN 'passed' ELSE 'protocol_incompatible' END
  WHEN s = 200 AND b IN (0, 5) THEN 'passed' ELSE 'protocol_incompatible' END AS code
FROM (SELECT event_id, [200, 200, 200, 404, 401, 429, 503][event_id % 7 + 1] AS s, event_id % 10 AS b FROM events)""")


# ---- invariants ------------------------------------------------------------------------
def _checked(c: Corpus):
    ops = c.operations.withColumn("state", F.when(F.col("created_at") % 50 == 3, "odd").otherwise(F.col("state"))).withColumn(
        "progress", F.when(F.col("created_at") % 40 == 2, F.lit(1.5)).otherwise(F.col("progress")))
    messages = c.messages.withColumn("state", F.when(F.col("sequence") == 5, "lost").otherwise(F.col("state")))
    jobs = c.job_columns("id", "kind", "state").withColumn("kind", F.when(digit("id") == 3, "guess").otherwise(F.col("kind"))).withColumn(
        "state", F.when(digit("id") == 4, "waiting_remote").when(digit("id") == 5, "ready").otherwise(F.col("state")))
    blocks = c.normalized.blocks.withColumn("page", F.when(digit("block_id") == 6, 0).when(digit("block_id") == 7, F.lit(None)).otherwise(F.col("page")))
    return {
        "documents": (c.library.withColumn("file_state", F.when(digit("id") == 2, "gone").otherwise(F.col("file_state"))), "id"),
        "jobs": (jobs, "id"), "parse_operations": (ops, "id"),
        "chapters": (c.normalized.chapters.withColumn("depth", F.col("depth") - (F.col("order_index") % 3)), "chapter_id"),
        "blocks": (blocks.withColumn("kind", F.when(digit("block_id") == 8, "box").otherwise(F.col("kind"))), "block_id"),
        "translations": (c.translations.withColumn("state", F.when(digit("block_id") == 9, "lost").otherwise(F.col("state"))), "id"),
        "reading_messages": (messages, "id"), "reading_citations": (c.stored_citations, "block_id")}


register("Q1_check_constraints", lambda c: Q.check_constraints(_checked(c)),
         compose(f"""SELECT 'parse_operations' AS "table", 'state' AS rule, id AS row_key FROM operations WHERE created_at % 50 = 3
UNION ALL SELECT 'parse_operations', 'progress', id FROM operations WHERE created_at % 40 = 2
UNION ALL SELECT 'documents', 'file_state', id FROM library WHERE {sql_digit('id')} = 2
UNION ALL SELECT 'jobs', 'kind', id FROM jobs WHERE {sql_digit('id')} = 3 UNION ALL SELECT 'jobs', 'state', id FROM jobs WHERE {sql_digit('id')} = 5
UNION ALL SELECT 'chapters', 'depth', chapter_id FROM chapters_all WHERE depth - order_index % 3 < 1
UNION ALL SELECT 'blocks', CASE WHEN {sql_digit('block_id')} = 6 THEN 'pages' ELSE 'kind' END, block_id FROM blocks_all WHERE {sql_digit('block_id')} IN (6, 8)
UNION ALL SELECT 'translations', 'state', id FROM translations WHERE {sql_digit('block_id')} = 9
UNION ALL SELECT 'reading_citations', 'page', block_id FROM stored_citations WHERE page < 1
UNION ALL SELECT 'reading_messages', 'shape', id FROM messages WHERE sequence = 5"""))


def _keyed(c: Corpus):
    """Stored tables with keys taken twice."""
    artifacts = c.sources.select(F.col("artifact_id").alias("id"), F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.lit(True).alias("is_active"))
    older = artifacts.select(F.concat(F.lit("old-"), "id").alias("id"), "document_id", (digit("id") == 3).alias("is_active"))
    redone = c.translations.filter(digit("block_id") == 5).withColumn("request_digest", F.sha2("request_digest", 256))
    return {
        "documents": c.library, "parse_operations": c.operations, "job_events": c.job_events, "blocks": c.normalized.blocks,
        "parse_artifacts": artifacts.unionByName(older), "chapters": c.normalized.chapters.withColumn("order_index", F.floor(F.col("order_index") / 2)),
        "translations": c.translations.unionByName(redone), "reading_messages": c.messages, "reading_citations": c.stored_citations,
        "reading_conversations": c.chats.withColumn("document_id", F.concat(F.lit("doc-"), F.col("updated_at").cast("string")))}


register("Q2_check_uniques", lambda c: Q.check_uniques(_keyed(c)),
    compose(f"""SELECT 'documents' AS "table", 'sha256' AS "key", sha256 AS value, count(*) AS copies FROM library GROUP BY sha256 HAVING count(*) > 1
UNION ALL SELECT 'parse_operations', 'job_id', job_id, count(*) FROM operations GROUP BY job_id HAVING count(*) > 1
UNION ALL SELECT 'parse_artifacts', 'document_id', 'doc-' || doc_id, 2 FROM doc_keys WHERE {sql_digit("'art-' || doc_id")} = 3
UNION ALL SELECT 'chapters', 'doc_id,order_index', doc_id || ',' || (order_index // 2), count(*) FROM chapters_all GROUP BY doc_id, order_index // 2 HAVING count(*) > 1
UNION ALL SELECT 'translations', 'block_id', block_id, 2 FROM translations WHERE {sql_digit('block_id')} = 5
UNION ALL SELECT 'reading_conversations', 'document_id', 'doc-' || updated_at, count(*) FROM chats GROUP BY updated_at HAVING count(*) > 1
UNION ALL SELECT 'reading_messages', 'conversation_id', conversation_id, count(*) FROM messages WHERE role = 'assistant' AND state = 'streaming' GROUP BY conversation_id HAVING count(*) > 1
UNION ALL SELECT 'reading_citations', 'message_id,order_index', message_id || ',' || order_index, count(*) FROM stored_citations GROUP BY message_id, order_index HAVING count(*) > 1"""))


def _linked(c: Corpus):
    """Stored tables with a quarter of most parents gone."""
    n = c.normalized
    jobs = c.job_columns("id", "document_id").unionByName(c.chapter_job_states.select("id", F.lit(None).cast("string").alias("document_id")))
    return {
        "documents": c.library.filter(digit("id") < 12), "jobs": jobs.filter(digit("id") < 12), "parse_operations": c.operations, "job_events": c.job_events,
        "parse_artifacts": c.sources.select(F.col("artifact_id").alias("id"), F.concat(F.lit("doc-"), "doc_id").alias("document_id")).filter(digit("id") < 12),
        "chapters": n.chapters.filter(digit("chapter_id") < 12), "blocks": n.blocks.filter(digit("block_id") < 12), "translations": c.translations,
        "reading_messages": c.messages, "reading_conversations": c.chats, "reading_citations": c.stored_citations}


def _orphans(child: str, column: str, rows: str, parents: str) -> str:
    return f"""SELECT '{child}' AS "table", '{column}' AS "column", value, count(*) AS rows FROM (SELECT {column} AS value FROM {rows})
WHERE value IS NOT NULL AND value NOT IN ({parents}) GROUP BY value"""


_D = sql_digit
LEFT_DOCUMENTS = f"SELECT id FROM library WHERE {_D('id')} < 12"
LEFT_JOBS = f"SELECT id FROM jobs WHERE {_D('id')} < 12 UNION ALL SELECT id FROM chapter_jobs WHERE {_D('id')} < 12"
LEFT_BLOCKS = f"SELECT block_id FROM blocks_all WHERE {_D('block_id')} < 12"
LEFT_ARTIFACTS = f"SELECT 'art-' || doc_id FROM doc_keys WHERE {_D(chr(39) + 'art-' + chr(39) + ' || doc_id')} < 12"
LEFT_CHAPTERS = f"SELECT chapter_id FROM chapters_all WHERE {_D('chapter_id')} < 12"
register("Q3_check_references", lambda c: Q.check_references(_linked(c)), compose(" UNION ALL ".join([
    _orphans("jobs", "document_id", f"jobs WHERE {_D('id')} < 12", LEFT_DOCUMENTS),
    _orphans("parse_operations", "document_id", "operations", LEFT_DOCUMENTS),
    _orphans("parse_operations", "job_id", "operations", LEFT_JOBS),
    _orphans("parse_artifacts", "document_id", f"(SELECT 'doc-' || doc_id AS document_id FROM doc_keys WHERE {_D(chr(39) + 'art-' + chr(39) + ' || doc_id')} < 12)", LEFT_DOCUMENTS),
    _orphans("chapters", "artifact_id", f"(SELECT 'art-' || doc_id AS artifact_id FROM chapters_all WHERE {_D('chapter_id')} < 12)", LEFT_ARTIFACTS),
    _orphans("blocks", "chapter_id", f"blocks_all WHERE {_D('block_id')} < 12", LEFT_CHAPTERS),
    _orphans("job_events", "job_id", "job_events", LEFT_JOBS),
    _orphans("translations", "block_id", "translations", LEFT_BLOCKS),
    _orphans("translations", "job_id", "translations", LEFT_JOBS),
    _orphans("reading_conversations", "document_id", "chats", LEFT_DOCUMENTS),
    _orphans("reading_messages", "conversation_id", "messages", "SELECT id FROM chats"),
    _orphans("reading_messages", "responding_to", "messages", "SELECT id FROM messages"),
    _orphans("reading_citations", "message_id", "stored_citations", "SELECT id FROM messages"),
    _orphans("reading_citations", "block_id", "stored_citations", LEFT_BLOCKS)])))
