"""Registered queries of the translation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import translate as T
from docloom.operators.documents import flag_translatable
from docloom.plans.bridge import CONFIG, Corpus, digit
from docloom.plans.oracle_base import DIGEST, NOT_WS_RE2, ROOM, compose, digit as sql_digit, packing
from docloom.plans.registry import register


def _judged(c: Corpus):
    return T.validate_outputs(c.batched.filter("batch IS NOT NULL"), c.records, c.responses)


def _verdicts(c: Corpus):
    """Verdicts alone, for those who need no text."""
    return T.judge_outputs(c.batched.filter("batch IS NOT NULL"), c.records, c.responses, carry=["chapter_id"])


def _commits(judged, text):
    return T.with_messages(judged).select(
        F.concat(F.lit("job-"), "chapter_id").alias("job_id"), "block_id", "code", "safe_message",
        F.lit(None).cast("string").alias("target_json"), text.cast("string").alias("target_plain_text"),
        F.lit(777).cast("long").alias("at"))


register("T1_protect_blocks", lambda c: c.prepared.select("block_id", "source", F.size("markers").alias("marker_count")),
         compose("SELECT block_id, source, len(regexp_extract_all(source, '⟦WEAVE:[^⟧]*⟧'))::INT AS marker_count FROM prepared"))
register("T2_request_digest", lambda c: flag_translatable(c.normalized.blocks).filter("translatable").select(
    "block_id", T.request_digest("source_digest", CONFIG).alias("request_digest")),
    compose("SELECT block_id, request_digest FROM digested"))
register("T3_plan_digest", lambda c: T.plan_digests(c.prepared), compose("SELECT chapter_id, plan_digest FROM plan_digests"))
register("T4_cache_lookup", lambda c: T.cache_lookup(c.prepared, c.translations).select("block_id", "hit"),
         compose("""SELECT block_id, EXISTS (SELECT 1 FROM translations t WHERE t.block_id = p.block_id AND t.request_digest = p.request_digest AND t.state = 'ready') AS hit
FROM prepared p"""))
register("T4_all_cached", lambda c: T.cache_lookup(c.prepared, c.translations).groupBy("chapter_id").agg(F.bool_and("hit").alias("all_cached")),
         compose("""SELECT p.chapter_id, bool_and(t.state IS NOT NULL) AS all_cached FROM prepared p
LEFT JOIN translations t ON t.block_id = p.block_id AND t.request_digest = p.request_digest AND t.state = 'ready' GROUP BY 1"""))
register("T5_active_cache_complete", lambda c: T.active_cache_complete(c.prepared, c.translations),
         compose("""SELECT p.chapter_id, bool_and(coalesce(t.request_digest = p.request_digest AND t.state = 'ready', false)) AS complete
FROM prepared p LEFT JOIN translations t ON t.block_id = p.block_id AND t.is_active GROUP BY 1"""))
register("T6_estimate_tokens", lambda c: c.table("documents").select("doc_id", T.estimate_tokens("text").alias("tokens")),
         "SELECT doc_id, (octet_length(encode(text)) + 2) // 3 AS tokens FROM documents")
register("T7_plan_batches", lambda c: T.plan_batches(c.prepared, CONFIG).select("chapter_id", "block_id", "batch"),
         compose("SELECT chapter_id, block_id, batch FROM batched"))
register("T8_build_requests", lambda c: T.build_requests(c.batched, CONFIG).select(
    "chapter_id", "batch", "block_count", F.sha2("input_json", 256).alias("input_digest"), "input_tokens"),
    compose(f"""SELECT chapter_id, batch, count(*)::INT AS block_count, sha256(any_value(j)) AS input_digest, any_value((octet_length(encode(j)) + 2) // 3) AS input_tokens
FROM (SELECT chapter_id, batch, '{T.REQUEST_HEAD}' || string_agg('{{"id":"' || block_id || '","kind":"' || kind || '","source":' || to_json(source)::VARCHAR || '}}', ',' ORDER BY order_index)
    OVER (PARTITION BY chapter_id, batch ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || ']}}' AS j FROM batched WHERE batch IS NOT NULL) GROUP BY 1, 2"""))
packing("halves_packed", "half_items", "half_key")
from docloom.plans.oracle_base import cte  # noqa: E402

cte("half_items", """
SELECT *, row_number() OVER (PARTITION BY half_key ORDER BY order_index) AS rn FROM (
  SELECT chapter_id, batch AS parent_batch, block_id, order_index, w, h AS half, chapter_id || '|' || batch || '|' || h AS half_key
  FROM (SELECT *, CASE WHEN n > 1 THEN CASE WHEN i < n // 2 THEN 0 ELSE 1 END END AS h FROM (
    SELECT *, count(*) OVER (PARTITION BY chapter_id, batch) AS n, row_number() OVER (PARTITION BY chapter_id, batch ORDER BY order_index) - 1 AS i
    FROM batched WHERE batch IS NOT NULL)))""")
register("T9_split_batches", lambda c: T.split_batches(
    c.batched.filter("batch IS NOT NULL").withColumn("split_once", F.lit(False)), CONFIG).select(
    "block_id", "parent_batch", "half", "batch"),
    compose("""SELECT i.block_id, i.parent_batch, i.half::INT AS half, CASE WHEN i.half IS NOT NULL THEN p.batch END::BIGINT AS batch
FROM half_items i LEFT JOIN halves_packed p ON p.half_key = i.half_key AND p.block_id = i.block_id"""))
register("T10_parse_outputs", lambda c: T.parse_outputs(c.bodies)[0],
         compose("SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY ord) - 1)::INT AS ord, block_id, target FROM records"))
register("T11_validate_outputs", lambda c: _judged(c).select("request_id", "block_id", "code"),
         compose("SELECT request_id, block_id, code FROM judged"))
register("T12_restore_targets", lambda c: T.restore_targets(
    c.prepared.filter("kind <> 'table'").withColumn("target", F.concat(F.lit("译"), "source"))).select(
    "block_id", F.col("restored.plainText").alias("plain_text"), F.size("restored.atoms").alias("atom_count")),
    compose("""WITH p AS (SELECT p.block_id, string_agg(CASE WHEN special AND value LIKE '$%' THEN value[2:-2] ELSE value END, '' ORDER BY akey) AS t,
  count(*) + CASE WHEN min(akey) = 1 THEN 1 ELSE 0 END AS n FROM prepared p JOIN text_atoms a ON a.block_id = p.block_id WHERE kind <> 'table' GROUP BY 1)
SELECT block_id, '译' || t AS plain_text, n::INT AS atom_count FROM p"""))
register("T12_restore_tables", lambda c: T.restore_targets(
    c.prepared.filter("kind = 'table'").withColumn("target", F.replace("source", F.lit("a⟦"), F.lit("甲⟦")))).select(
    "block_id", F.col("restored.plainText").alias("plain_text")),
    compose("""SELECT s.block_id, '甲 | ' || cell || chr(10) || s.pos || ' [1]' || CASE WHEN img_path IS NOT NULL THEN coalesce(alt, '') ELSE '' END AS plain_text
FROM stems s JOIN block_parts b ON b.doc_id = s.doc_id AND b.pos = s.pos AND b.sub = s.sub WHERE s.kind = 'table'""").replace("'甲 | ' || cell", "'甲 | ' || regexp_replace(cell, 'a$', '甲')"))
cte("repair_items", """
SELECT i.* REPLACE (row_number() OVER (PARTITION BY i.chapter_id ORDER BY i.order_index) AS rn)
FROM items i JOIN judged j ON j.block_id = i.block_id WHERE j.code IS NOT NULL""")
packing("repair_packed", "repair_items", "chapter_id")
PLAIN_TARGET = """CASE WHEN j.kind = 'table' THEN NULL ELSE j.target END"""
register("T14_commit_results", lambda c: T.commit_results(c.translations, _commits(_judged(c), F.col("restored.plainText")), c.chapter_job_states)[0].select(
    "id", "state", "is_active", "validation_json", "error_code", "error_message", "updated_at"),
    compose(f"""SELECT t.id, CASE WHEN hit AND j.code IS NULL THEN 'ready' WHEN hit AND t.state <> 'ready' THEN 'failed' ELSE t.state END AS state, t.is_active,
  CASE WHEN hit AND j.code IS NULL THEN '{T.VALIDATION_JSON}' END AS validation_json,
  CASE WHEN hit AND j.code IS NULL THEN NULL WHEN hit AND t.state <> 'ready' THEN j.code ELSE t.error_code END AS error_code,
  CASE WHEN hit AND j.code IS NULL THEN NULL WHEN hit AND t.state <> 'ready' THEN CASE j.code """ + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in T.FAILURE_MESSAGES.items()) + """ END ELSE t.error_message END AS error_message,
  CASE WHEN hit AND (j.code IS NULL OR t.state <> 'ready') THEN 777 ELSE t.updated_at END AS updated_at
FROM (SELECT t.*, t.is_active AND j.block_id IS NOT NULL AND b.id IS NOT NULL AND (j.code IS NOT NULL OR t.job_id NOT IN (
    SELECT b.id FROM judged j JOIN chapter_jobs b ON b.chapter_id = j.chapter_id WHERE j.code IS NULL
      AND (b.id, j.block_id) NOT IN (SELECT (job_id, block_id) FROM translations WHERE is_active))) AS hit
  FROM translations t LEFT JOIN judged j ON j.block_id = t.block_id
  LEFT JOIN chapter_jobs b ON b.id = t.job_id AND b.state <> 'cancelled') t LEFT JOIN judged j ON j.block_id = t.block_id"""))
register("T14_commit_errors", lambda c: T.commit_results(c.translations, _commits(_verdicts(c), F.lit(None)), c.chapter_job_states)[1],
         compose("""SELECT b.id AS job_id, j.block_id, CASE WHEN b.state = 'cancelled' THEN 'job_cancelled' ELSE 'cache_changed' END AS error_code
FROM judged j JOIN chapter_jobs b ON b.chapter_id = j.chapter_id WHERE j.code IS NULL
  AND (b.state = 'cancelled' OR j.block_id NOT IN (SELECT block_id FROM translations WHERE is_active))"""))


def _wanted(c: Corpus):
    return c.prepared.filter(digit("chapter_id") > 4).select(
        F.concat(F.lit("new-"), "block_id").alias("id"), F.when(digit("chapter_id") == 7, "job-gone").otherwise("job-next").alias("job_id"), "block_id", "request_digest",
        "source_digest", F.lit(900).cast("long").alias("at"))


def _next_jobs(c: Corpus):
    """The job of each wanted record; the cancelled one must prepare nothing."""
    return _wanted(c).select(F.col("job_id").alias("id")).distinct().withColumn(
        "state", F.when(F.col("id") == "job-gone", "cancelled").otherwise("running"))


WANTED = f"(SELECT *, {sql_digit('chapter_id')} AS kc FROM prepared)"
register("T15_activate_records", lambda c: T.activate_records(c.translations, _wanted(c), _next_jobs(c))[0].select(
    "id", "job_id", "block_id", "request_digest", "state", "is_active", "error_code", "updated_at"),
    compose(f"""SELECT t.id, CASE WHEN same THEN 'job-next' ELSE job_id END AS job_id, t.block_id, t.request_digest,
  CASE WHEN same AND state <> 'ready' THEN 'queued' ELSE state END AS state, CASE WHEN w IS NULL THEN is_active ELSE same END AS is_active,
  CASE WHEN same AND state <> 'ready' THEN NULL ELSE error_code END AS error_code, CASE WHEN same THEN 900 ELSE updated_at END AS updated_at
FROM (SELECT t.*, p.request_digest AS w, coalesce(p.request_digest = t.request_digest, false) AS same FROM translations t
  LEFT JOIN {WANTED} p ON p.block_id = t.block_id AND p.kc > 4 AND p.kc <> 7) t
UNION ALL SELECT 'new-' || block_id, 'job-next', block_id, request_digest, 'queued', true, NULL, 900 FROM {WANTED} p
WHERE kc > 4 AND kc <> 7 AND NOT EXISTS (SELECT 1 FROM translations t WHERE t.block_id = p.block_id AND t.request_digest = p.request_digest)"""))
register("T15_missing", lambda c: T.activate_records(c.translations, _wanted(c), _next_jobs(c))[1].select("block_id"),
         compose(f"""SELECT block_id FROM {WANTED} p WHERE kc > 4 AND kc <> 7 AND NOT EXISTS (
  SELECT 1 FROM translations t WHERE t.block_id = p.block_id AND t.request_digest = p.request_digest AND t.state = 'ready')"""))
register("T16_active_for_chapter", lambda c: T.active_for_chapter(c.translations, c.normalized.blocks).select(
    "id", "block_id", "chapter_id", "order_index", "state"),
    compose("SELECT id, block_id, chapter_id, order_index, state FROM translations WHERE is_active"))


def _progress_sql(config: bool) -> str:
    job = "b.state"
    plan = "AND b.plan_digest = d.plan_digest" if config else ""
    current = "t.request_digest = p.request_digest" if config else "true"
    waiting = f"""CASE WHEN {job} = 'queued' THEN 'queued' WHEN {job} IN ('running', 'interrupted') THEN 'translating'
      WHEN {job} IN ('failed', 'cancelled') THEN 'failed' ELSE 'not_started' END""" if config else "'not_configured'"
    return compose(f"""
WITH s AS (SELECT x.chapter_id, count(*) FILTER (x.translatable) AS n, count(*) FILTER (x.translatable AND {current} AND t.state = 'ready') AS r,
    count(*) FILTER (x.translatable AND {current} AND t.state = 'failed') AS f, count(*) AS total
  FROM translatable x LEFT JOIN prepared p ON p.block_id = x.block_id LEFT JOIN translations t ON t.block_id = x.block_id AND t.is_active GROUP BY 1)
SELECT s.chapter_id, n AS translatable, r AS ready, f AS failed, n - r - f AS pending, total - n AS skipped,
  CASE WHEN r = n THEN 'complete' WHEN r > 0 THEN 'readable' ELSE {waiting} END AS state,
  CASE WHEN n = 0 THEN 1.0 ELSE round(r / n, 6) END::DOUBLE AS progress, b.id AS job_id,
  coalesce(b.state IN ('queued', 'running', 'interrupted'), false) AS job_active, coalesce(b.kind = 'prefetch', false) AS prefetched, b.safe_message
FROM s LEFT JOIN plan_digests d ON d.chapter_id = s.chapter_id LEFT JOIN chapter_jobs b ON b.chapter_id = s.chapter_id {plan}""")


def _flagged(c: Corpus):
    return flag_translatable(c.normalized.blocks)


def _rounded(df):
    return df.withColumn("progress", F.round("progress", 6))


register("T17_chapter_progress", lambda c: _rounded(T.chapter_progress(_flagged(c), c.translations, c.chapter_jobs, CONFIG)), _progress_sql(True))
register("T17_progress_unconfigured", lambda c: _rounded(T.chapter_progress(_flagged(c), c.translations, c.chapter_jobs, None)), _progress_sql(False))
register("T18_next_body_chapter", lambda c: T.next_body_chapter(c.normalized.chapters, c.normalized.blocks),
         compose("""WITH e AS (SELECT c.doc_id, c.chapter_id, c.order_index, c.role = 'body' AND c.chapter_id IN (SELECT chapter_id FROM prepared) AS ok FROM chapters_all c)
SELECT a.doc_id, a.chapter_id, (SELECT arg_min(b.chapter_id, b.order_index) FROM e b WHERE b.doc_id = a.doc_id AND b.order_index > a.order_index AND b.ok) AS next_chapter_id FROM e a"""))


def _log(c: Corpus):
    e = c.table("events")
    i = F.col("event_id")
    return e.select(
        "event_id", F.get(F.array(*[F.lit(x) for x in (200, 400, 401, 403, 408, 429, 500, 502, 503, 404, 418)]), (i % 11).cast("int")).alias("status"),
        F.when(i % 5 == 1, F.concat(F.lit("Context_Length"), "event_type")).when(i % 5 == 2, "unsupported_api_for_model").alias("error_code"),
        F.when(i % 7 == 3, "TOO MANY TOKENS").alias("error_message"),
        F.when(i % 3 == 0, (i % 100).cast("string")).when(i % 3 == 1, "Mon, 01 Jan 2024 00:00:30 GMT").alias("retry_after"),
        F.when(i % 13 == 0, "timeout").when(i % 13 == 1, "connect").alias("transport_error"),
        (i % 4 + 1).cast("int").alias("attempt"), (F.lit(1704067180) + i % 40).alias("at"))


register("T19_classify_provider_log", lambda c: T.classify_provider_log(_log(c)).select("event_id", "kind", "code", "retry", "delay_s"),
         """
WITH l AS (SELECT event_id AS i, event_type, [200, 400, 401, 403, 408, 429, 500, 502, 503, 404, 418][event_id % 11 + 1] AS s, event_id % 4 + 1 AS attempt FROM events),
k AS (SELECT *, CASE WHEN i % 13 = 0 THEN 'timeout' WHEN i % 13 = 1 THEN 'transport' WHEN s IN (401, 403) THEN 'unauthorized' WHEN s = 429 THEN 'rate_limited'
  WHEN i % 5 = 1 OR i % 7 = 3 THEN 'context_length' WHEN i % 5 = 2 THEN 'protocol' WHEN s IN (408, 502, 503, 504) THEN 'transport' WHEN s >= 500 THEN 'remote' ELSE 'protocol' END AS kind FROM l),
r AS (SELECT *, attempt < 3 AND kind IN ('transport', 'timeout', 'rate_limited') AS retry FROM k)
SELECT i AS event_id, kind, CASE kind WHEN 'transport' THEN 'unreachable' WHEN 'protocol' THEN 'protocol_incompatible' WHEN 'remote' THEN 'remote_failed' ELSE kind END AS code, retry,
  CASE WHEN retry THEN CASE WHEN kind = 'rate_limited' THEN CASE WHEN i % 3 = 0 THEN least(i % 100, 60) WHEN i % 3 = 1 AND 50 - i % 40 > 0 THEN least(50 - i % 40, 60) ELSE 1 END
    WHEN attempt = 1 THEN 1 ELSE 4 END END AS delay_s FROM r""")
register("T13_repair_set", lambda c: T.repair_set(c.prepared, _verdicts(c), CONFIG).select("block_id", "batch"),
         compose("SELECT block_id, batch::BIGINT AS batch FROM repair_packed"))
