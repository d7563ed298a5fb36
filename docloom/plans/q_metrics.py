"""Registered queries of percentiles, quality rates and throttled progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.operators import conversation as C
from docloom.operators import metrics as M
from docloom.operators import translate as T
from docloom.plans.bridge import Corpus, StreamCorpus, digit
from docloom.plans.oracle_base import NOT_WS_RE2, compose, cte, digit as sql_digit
from docloom.plans.registry import register
from docloom.streaming import sinks

METRICS = {"view": "pdf_first_page_ms", "click": "chapter_cache_load_ms", "error": "parse_total_ms", "signup": "app_cold_start_ms"}


def _samples(c: Corpus) -> DataFrame:
    """Every event as a sample of its kind's metric; one in 97 is not a duration."""
    metric = F.lit("reading_chat_first_output_ms")
    for kind, name in METRICS.items():
        metric = F.when(F.col("event_type") == kind, name).otherwise(metric)
    return c.table("events").select(
        metric.alias("metric"), F.to_date("ts").alias("day"),
        F.when(F.col("event_id") % 97 == 0, -1).otherwise(F.floor(F.col("value") * 2000)).cast("long").alias("value_ms"))


cte("samples", f"""
SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in METRICS.items())} ELSE 'reading_chat_first_output_ms' END AS metric,
  ts::DATE AS day, CASE WHEN event_id % 97 = 0 THEN -1 ELSE floor(value * 2000) END::BIGINT AS value_ms FROM events""")


def _exact(group: str) -> str:
    """Quantiles of the samples themselves, then cut to their leading bits."""
    def cut(p: int) -> str:
        value = f"max(CASE WHEN rn = (n * {p} + 99) // 100 THEN value_ms END)"
        return f"({value} >> greatest(0, length(bin({value})) - {M.SKETCH_BITS + 1})) << greatest(0, length(bin({value})) - {M.SKETCH_BITS + 1}) AS p{p}"

    return compose(f"""SELECT metric, period, count(*) AS samples, count(*) FILTER (value_ms > {M.SLOW_MS}) AS slow, {', '.join(cut(p) for p in M.PERCENTILES)} FROM (
  SELECT *, row_number() OVER (PARTITION BY metric, period ORDER BY value_ms) AS rn, count(*) OVER (PARTITION BY metric, period) AS n FROM (
    SELECT metric, strftime({group}, '%Y-%m-%d') AS period, value_ms FROM samples WHERE value_ms >= 0)) GROUP BY metric, period""")


def _weekly(c: Corpus) -> DataFrame:
    """Weeks rolled up from the stored sketches of days; no sample is read again."""
    stored = materialize(M.sketch_samples(_samples(c), ["metric", "day"]), "sketches")
    weeks = stored.withColumn("period", F.trunc("day", "week").cast("string"))
    return M.read_percentiles(weeks, ["metric", "period"])


register("M1_daily_percentiles", lambda c: M.read_percentiles(
    M.sketch_samples(_samples(c).withColumn("period", F.col("day").cast("string")), ["metric", "period"]), ["metric", "period"]), _exact("day"))
register("M1_weekly_percentiles", _weekly, _exact("date_trunc('week', day)"))


def _measures(rows: str, group: str, parts: dict[str, tuple[str, str]], gates: dict[str, int]) -> str:
    each = " UNION ALL ".join(
        f"SELECT {group}, '{m}' AS measure, coalesce(sum({good}), 0)::BIGINT AS good, coalesce(sum({total}), 0)::BIGINT AS total, {gates[m]} AS least FROM rated GROUP BY {group}"
        for m, (good, total) in parts.items())
    return f"""SELECT {group}, measure, good, total, CASE WHEN total > 0 THEN good::DOUBLE / total END AS rate, good * 1000 >= total * least AS passed
FROM (WITH rated AS ({rows}) {each})"""


TOKEN = "⟦WEAVE:[^⟧]*⟧"
register("M2_translation_rates", lambda c: M.translation_rates(
    T.validate_outputs(c.batched.filter("batch IS NOT NULL"), c.records, c.responses), ["chapter_id"]),
    compose(_measures(
        f"""SELECT *, regexp_extract_all(source, '{TOKEN}') AS wanted, regexp_extract_all(target, '{TOKEN}') AS found,
  coalesce(code, '') NOT IN ('missing_block', 'truncated', 'duplicate_block') AS back FROM judged""", "chapter_id", {
            "blocks_kept": ("back::INT", "1"),
            "markers_kept": (f"(back AND found = wanted AND NOT contains(regexp_replace(target, '{TOKEN}', '|', 'g'), '⟦WEAVE:'))::INT", "back::INT"),
            **{m: (f"CASE WHEN back THEN len(list_filter(wanted, lambda t: contains(t, ':{k}:') AND contains(target, t))) END",
                   f"CASE WHEN back THEN len(list_filter(wanted, lambda t: contains(t, ':{k}:'))) END") for m, k in (("citations_kept", "C"), ("equations_kept", "F"))},
            "targets_not_empty": (f"(back AND regexp_matches(target, '{NOT_WS_RE2}'))::INT", "back::INT")}, M.TRANSLATION_GATES)))


def _answer_rates(c: Corpus) -> DataFrame:
    # one answer in sixteen may cite nothing
    _, cites, warnings = C.extract_citations(c.answers, c.allowed.filter(digit("request_id") != 7))
    return M.answer_rates(c.answers, cites, warnings, ["sequence"])


register("M2_answer_rates", _answer_rates, compose(_measures(
    "SELECT sequence, (k <> 7)::INT AS good, (k = 7)::INT + (k % 4 = 1)::INT AS strayed FROM answers", "sequence",
    {"answers_cited": ("good", "1"), "citations_in_context": ("good", "good + strayed")}, M.ANSWER_GATES)))

#: Months of events in seconds, so that slots fill up.
SQUEEZE = 400_000


def _progress(c: Corpus) -> DataFrame:
    return c.table("events").select(
        F.concat(F.lit("job-"), "user_id").alias("job_id"),
        F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / SQUEEZE)).alias("at"), F.col("event_id").alias("seq"),
        (F.col("event_id") % 101).alias("percent"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("job_id", F.unix_micros("slot_end").alias("slot_end_us"), "seq", "percent")


cte("progress_slots", f"""
SELECT job_id, (at_us // 250000 + 1) * 250000 AS slot_end_us, arg_max(event_id, (at_us, event_id)) AS seq FROM (
  SELECT 'job-' || user_id AS job_id, epoch_us(ts) // {SQUEEZE} AS at_us, event_id FROM events) GROUP BY 1, 2""")
SHOWN = "SELECT job_id, slot_end_us, seq, seq % 101 AS percent FROM progress_slots"
register("M3_throttled_progress", lambda c: _shown(M.throttle_progress(_progress(c))), compose(SHOWN))
register("M3_stream_progress", lambda c: _shown(sinks.drain(M.throttle_progress(
    StreamCorpus(c.spark, c.sf_dir).by_turns(_progress(c), "job_id", "seq"), lateness="1 second"))),
    compose(SHOWN + f" WHERE slot_end_us <= 1000 * ((SELECT epoch_us(max(ts)) // {SQUEEZE} FROM events) // 1000 - 1000)"))
