"""Registered queries of the job and operation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import oplog as J
from docloom.plans.bridge import Corpus, digit
from docloom.plans.oracle_base import OPEN_OPS, compose, digit as sql_digit
from docloom.plans.registry import register

NOW = 9_000_000
CONFIG = J.ParserConfig("endpoint-1")
JOB_COLUMNS = "id, document_id, chapter_id, kind, priority, state, plan_digest, error_code, safe_message, created_at, updated_at, started_at, completed_at"

register("J1_upsert_jobs", lambda c: J.upsert_jobs(c.job_history), compose(f"SELECT {JOB_COLUMNS} FROM jobs"))
register("J2_state_change_events", lambda c: c.job_events, compose("SELECT job_id, sequence, state, created_at FROM job_events"))
register("J3_latest_job", lambda c: J.latest_job(c.jobs).filter("chapter_id IS NOT NULL").select("chapter_id", "id", "state", "plan_digest"),
         compose("""SELECT chapter_id, id, state, plan_digest FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY created_at DESC, rowid DESC) AS rn
FROM jobs WHERE chapter_id IS NOT NULL) WHERE rn = 1"""))


def _sessions(c: Corpus):
    return c.jobs.select("id", F.concat(F.lit("session-"), "document_id").alias("session_id"))


register("J4_latest_operation", lambda c: J.latest_operation(c.operations, _sessions(c), "cloud_mineru").select("document_id", "id", "session_id", "state"),
         compose("""SELECT document_id, id, session_id, state FROM (SELECT o.*, 'session-' || j.document_id AS session_id,
  row_number() OVER (PARTITION BY o.document_id ORDER BY o.created_at DESC, o.id DESC) AS rn FROM operations o JOIN jobs j ON j.id = o.job_id WHERE backend = 'cloud_mineru') WHERE rn = 1"""))
INTERRUPTED = """(SELECT a.* REPLACE (CASE WHEN a.state IN ('queued', 'running', 'interrupted') THEN CASE WHEN EXISTS (SELECT 1 FROM jobs n
    WHERE n.chapter_id = a.chapter_id AND n.plan_digest = a.plan_digest AND (n.created_at > a.created_at OR (n.created_at = a.created_at AND n.rowid > a.rowid)))
  THEN 'cancelled' ELSE 'interrupted' END ELSE a.state END AS state) FROM jobs a)"""
register("J5_mark_interrupted", lambda c: J.mark_interrupted(c.jobs).select("id", "state", "error_code", "completed_at"),
         compose(f"""SELECT i.id, i.state, CASE WHEN i.state = 'cancelled' AND j.state <> 'cancelled' THEN 'superseded' ELSE j.error_code END AS error_code,
  CASE WHEN i.state = 'cancelled' AND j.state <> 'cancelled' THEN j.updated_at ELSE j.completed_at END AS completed_at
FROM {INTERRUPTED} i JOIN jobs j ON j.id = i.id"""))
register("J6_recovery_queue", lambda c: J.recovery_queue(J.mark_interrupted(c.jobs)).select("id", "priority", "created_at", "restart"),
         compose(f"SELECT id, priority, created_at, kind = 'translate' AS restart FROM {INTERRUPTED} WHERE state = 'interrupted'"))
register("J7_recoverable_operations", lambda c: J.recoverable_operations(c.operations, CONFIG).select(
    "document_id", "id", "state", "normalizer_version", "progress", "error_code", "resume"),
    compose(f"""SELECT document_id, id, CASE WHEN same THEN state ELSE 'status_unknown' END AS state, 'mineru-v2' AS normalizer_version,
  CASE WHEN same THEN progress END AS progress, CASE WHEN same THEN error_code ELSE 'provider_settings_changed' END AS error_code, same AS resume
FROM (SELECT *, endpoint_fingerprint = 'endpoint-1' AS same, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS rn FROM operations
  WHERE state IN {OPEN_OPS} AND backend = 'cloud_mineru' AND parser_version = 'mineru-v4-vlm') WHERE rn = 1"""))
register("J8_apply_version_change", lambda c: J.apply_version_change(c.operations, CONFIG, NOW).select(
    "id", "state", "normalizer_version", "progress", "error_code", "updated_at", "completed_at"),
    compose(f"""SELECT id, CASE WHEN dead THEN CASE WHEN batch_id IS NULL THEN 'cancelled' ELSE 'status_unknown' END ELSE state END AS state,
  CASE WHEN up THEN 'mineru-v2' ELSE normalizer_version END AS normalizer_version, CASE WHEN NOT dead THEN progress END AS progress,
  CASE WHEN dead THEN 'parser_version_changed' ELSE error_code END AS error_code, CASE WHEN up OR dead THEN {NOW} ELSE updated_at END AS updated_at,
  CASE WHEN dead AND batch_id IS NULL THEN {NOW} END AS completed_at
FROM (SELECT *, op AND parser_version = 'mineru-v4-vlm' AND normalizer_version <> 'mineru-v2' AS up,
  op AND NOT (parser_version = 'mineru-v4-vlm' AND normalizer_version <> 'mineru-v2') AND NOT (backend = 'cloud_mineru' AND parser_version = 'mineru-v4-vlm' AND normalizer_version = 'mineru-v2') AS dead
  FROM (SELECT *, state IN {OPEN_OPS} AS op FROM operations))"""))


def _pairs(c: Corpus):
    i = F.col("created_at")
    return c.operations.filter(i % 9 >= 7).select(
        F.col("id").alias("old_id"), F.when(i % 4 == 1, F.lit("doc-x")).otherwise(F.col("document_id")).alias("document_id"),
        F.concat("id", F.lit("-again")).alias("replacement_id"),
        F.when(i % 5 == 2, "running").otherwise("queued").alias("replacement_state"))


register("J9_supersede_operations", lambda c: J.supersede_operations(c.operations, _pairs(c), NOW)[0].select("id", "document_id", "state", "batch_id", "updated_at"),
         compose(f"""WITH o AS (SELECT *, created_at % 9 = 8 AND created_at % 4 <> 1 AND created_at % 5 <> 2 AS ok FROM operations)
SELECT id, document_id, CASE WHEN ok THEN 'cancelled' ELSE state END AS state, batch_id, CASE WHEN ok THEN {NOW} ELSE updated_at END AS updated_at FROM o
UNION ALL SELECT id || '-again', document_id, 'queued', NULL, {NOW} FROM o WHERE ok"""))
register("J9_supersede_errors", lambda c: J.supersede_operations(c.operations, _pairs(c), NOW)[1],
         compose("""SELECT id AS old_id, id || '-again' AS replacement_id, CASE WHEN created_at % 4 = 1 OR created_at % 5 = 2 THEN 'invalid_replacement' ELSE 'not_eligible' END AS error_code
FROM operations WHERE created_at % 9 >= 7 AND NOT (created_at % 9 = 8 AND created_at % 4 <> 1 AND created_at % 5 <> 2)"""))


def _ids(c: Corpus):
    return c.jobs.filter(digit("id") < 8).select("id")


register("J10_supersede_jobs", lambda c: J.supersede_interrupted(c.jobs, c.job_translations, _ids(c), NOW)[0].select("id", "state", "error_code", "updated_at"),
         compose(f"""SELECT id, CASE WHEN hit THEN 'cancelled' ELSE state END AS state, CASE WHEN hit THEN 'superseded' ELSE error_code END AS error_code,
  CASE WHEN hit THEN {NOW} ELSE updated_at END AS updated_at FROM (SELECT *, state = 'interrupted' AND {sql_digit('id')} < 8 AS hit FROM jobs)"""))
register("J10_supersede_rows", lambda c: J.supersede_interrupted(c.jobs, c.job_translations, _ids(c), NOW)[1].select("id", "state", "error_code"),
         compose(f"""SELECT t.id, CASE WHEN hit THEN 'cancelled' ELSE t.state END AS state, CASE WHEN hit THEN 'superseded' END AS error_code
FROM (SELECT t.*, j.state = 'interrupted' AND {sql_digit('j.id')} < 8 AND t.is_active AND t.state IN ('queued', 'translating') AS hit FROM job_translations t JOIN jobs j ON j.id = t.job_id) t"""))


def _cancel(c: Corpus, which: int):
    ids = c.jobs.select("document_id").distinct().filter(digit("document_id") < 7)
    return J.cancel_documents(c.jobs, c.job_translations, c.job_events, ids, NOW)[which]


HIT = f"j.state IN ('queued', 'running', 'interrupted') AND {sql_digit('j.document_id')} < 7"
register("J11_cancel_jobs", lambda c: _cancel(c, 0).select("id", "state", "error_code", "completed_at"),
         compose(f"""SELECT id, CASE WHEN {HIT} THEN 'cancelled' ELSE state END AS state, CASE WHEN {HIT} THEN 'cancelled' ELSE error_code END AS error_code,
  CASE WHEN {HIT} THEN {NOW} ELSE completed_at END AS completed_at FROM jobs j"""))
register("J11_cancel_rows", lambda c: _cancel(c, 1).select("id", "state"),
         compose(f"""SELECT t.id, CASE WHEN {HIT} AND t.is_active AND t.state IN ('queued', 'translating') THEN 'cancelled' ELSE t.state END AS state
FROM job_translations t JOIN jobs j ON j.id = t.job_id"""))
register("J11_cancel_events", lambda c: _cancel(c, 2),
         compose(f"""SELECT j.id AS job_id, coalesce(n, 0) + 1 AS sequence, 'translation_state_changed' AS event_type, 'cancelled' AS state, {NOW}::BIGINT AS created_at
FROM jobs j LEFT JOIN (SELECT job_id, max(sequence) AS n FROM job_events GROUP BY 1) e ON e.job_id = j.id WHERE {HIT}"""))


def _artifacts(c: Corpus):
    k = digit("id")
    return c.library.select(
        F.col("id").alias("document_id"), (k % 2 == 0).alias("is_active"), F.lit("cloud_mineru").alias("backend"),
        F.when(k == 4, "old").otherwise("mineru-v4-vlm").alias("parser_version"), F.lit("mineru-v2").alias("normalizer_version"))


register("J12_parse_view", lambda c: J.parse_view(c.library, _artifacts(c), c.operations),
         compose(f"""
WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS rn FROM operations WHERE backend = 'cloud_mineru')
  WHERE rn = 1 AND ((parser_version = 'mineru-v4-vlm' AND normalizer_version = 'mineru-v2') OR (state = 'status_unknown' AND error_code = 'parser_version_changed'))),
v AS (SELECT l.id AS document_id, o.id AS operation_id, o.state AS s, o.progress AS p, {sql_digit('l.id')} % 2 = 0 AND {sql_digit('l.id')} <> 4 AS ready FROM library l LEFT JOIN o ON o.document_id = l.id),
w AS (SELECT *, CASE WHEN s IN {OPEN_OPS} THEN s WHEN ready OR s = 'succeeded' THEN 'ready' WHEN s IS NOT NULL THEN 'failed' ELSE 'not_started' END AS parse_state FROM v)
SELECT document_id, parse_state, CASE WHEN s IN {OPEN_OPS} THEN p WHEN ready THEN 1.0 ELSE p END AS progress, operation_id,
  CASE WHEN s IN ('uploading', 'downloading', 'normalizing') THEN 'running' WHEN s = 'processing' THEN 'waiting_remote' ELSE s END AS job_state,
  CASE WHEN parse_state IN ('queued', 'uploading', 'processing', 'downloading', 'normalizing') THEN 'parsing' WHEN parse_state IN ('ready', 'not_started') THEN 'ready' ELSE 'degraded' END AS lifecycle
FROM w"""))


def _statuses(c: Corpus):
    """One remote batch per user, its results in another order than asked for."""
    e = c.table("events")
    i = F.col("event_id")
    result = F.struct(
        F.concat(F.lit("data-"), F.when(i % 17 == 0, i + 1_000_000).otherwise(i)).alias("data_id"),
        F.get(F.array(*[F.lit(s) for s in ("pending", "running", "done", "failed", "odd")]), (i % 5).cast("int")).alias("state"),
        F.struct((i % 12).cast("int").alias("extracted_pages"), (i % 4 * 2).cast("int").alias("total_pages")).alias("extract_progress"),
        F.when(i % 7 != 0, F.concat(F.lit("https://files/"), i)).alias("full_zip_url"))
    # a batch is one upload of at most a few hundred files
    batch = F.concat(F.lit("b-"), "user_id", F.lit("-"), F.floor(i / 500))
    return e.select(batch.alias("batch_id"), "user_id", i.alias("i"), result.alias("r")).groupBy("batch_id", "user_id").agg(
        F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("i", "r")))), lambda x: x["r"]).alias("results")).select(
        "batch_id", F.when(F.col("user_id") % 10 == 0, -60012).otherwise(0).alias("code"), "results")


def _asked(c: Corpus):
    i = F.col("event_id")
    return c.table("events").select(
        F.concat(F.lit("op-"), i).alias("id"), F.concat(F.lit("b-"), "user_id", F.lit("-"), F.floor(i / 500)).alias("batch_id"),
        F.concat(F.lit("data-"), i).alias("data_id"))


STATUS_SQL = """(SELECT event_id AS i, CASE WHEN user_id % 10 = 0 OR event_id % 17 = 0 THEN 'missing' WHEN event_id % 5 = 2 AND event_id % 7 = 0 THEN 'protocol_error'
    WHEN event_id % 5 = 4 THEN 'protocol_error' ELSE ['pending', 'running', 'done', 'failed'][event_id % 5 + 1] END AS status FROM events)"""
register("J13_align_remote_status", lambda c: J.align_remote_status(_statuses(c), _asked(c)).withColumn("progress", F.round("progress", 6)),
         f"""SELECT 'op-' || i AS id, status, CASE WHEN status = 'running' AND i % 4 > 0 THEN round(least(i % 12, i % 4 * 2) / (i % 4 * 2), 6) END AS progress,
  CASE WHEN status = 'done' THEN 'https://files/' || i END AS download_url FROM {STATUS_SQL}""")
register("J14_next_poll", lambda c: J.next_poll(c.table("events").select(
    F.concat(F.lit("op-"), "event_id").alias("id"), (F.col("event_id") * 10).alias("polling_since"),
    (F.col("event_id") * 10 + F.col("event_id") * 997 % 700_000).alias("polled_at"))),
    """SELECT 'op-' || event_id AS id, CASE WHEN e < 600 THEN event_id * 10 + event_id * 997 % 700000 + 1000 * CASE WHEN e >= 120 THEN 10 WHEN e >= 30 THEN 5 ELSE 2 END END AS due_at,
  CASE WHEN e >= 600 THEN 'status_unknown' ELSE 'processing' END AS state FROM (SELECT event_id, (event_id * 997 % 700000) // 1000 AS e FROM events)""")
register("J15_resolve_ambiguous_uploads", lambda c: J.resolve_ambiguous_uploads(
    c.operations, J.align_remote_status(_statuses(c), _asked(c)).select(
        "id", "status", F.when(F.substring("id", -1, 1) == "7", 401).otherwise(200).alias("http_status"))),
    f"""SELECT 'op-' || i AS id, CASE WHEN i % 10 = 7 THEN 'failed' WHEN status = 'done' THEN 'download' WHEN status = 'failed' THEN 'failed'
    WHEN status IN ('pending', 'running') THEN 'continue' ELSE 'status_unknown' END AS action,
  CASE WHEN i % 10 = 7 THEN 'unauthorized' WHEN status = 'failed' THEN 'remote_failed' WHEN status IN ('missing', 'protocol_error') THEN 'upload_status_unknown' END AS error_code
FROM {STATUS_SQL}""")
register("J16_latest_prefetched", lambda c: J.latest_prefetched(c.jobs),
         compose("""SELECT document_id, arg_max(chapter_id, completed_at) AS chapter_id FROM (SELECT document_id, coalesce(chapter_id, '') AS chapter_id, completed_at FROM jobs
WHERE kind = 'prefetch' AND state = 'succeeded') GROUP BY 1""").replace("arg_max(chapter_id, completed_at)", "nullif(arg_max(chapter_id, completed_at), '')"))
