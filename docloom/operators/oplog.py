"""Job and parse-operation logs: folding updates, events, recovery, supersession, views.

Job tables: id, document_id, chapter_id, kind, priority, state, plan_digest, error_code,
safe_message, created_at, updated_at, started_at, completed_at, rowid.
Operation tables: id, document_id, job_id, backend, state, parser_version,
normalizer_version, endpoint_fingerprint, batch_id, progress, error_code, created_at,
updated_at, completed_at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scan import RANGE, lay_out, ordered_row_number, ordered_scan
from docloom.schemas import NORMALIZER_VERSION, PARSER_BACKEND, PARSER_VERSION

# fixed values
TRANSLATION_KINDS = ["translate", "prefetch"]
OPEN_JOB_STATES = ["queued", "running", "interrupted"]
OPEN_OPERATION_STATES = ["queued", "uploading", "processing", "downloading", "normalizing", "status_unknown"]
POLL_FAST_S, POLL_MEDIUM_S, POLL_SLOW_S = 2, 5, 10
POLL_MEDIUM_AFTER_S, POLL_SLOW_AFTER_S, POLL_TIMEOUT_S = 30, 120, 600
REMOTE_MISSING_CODE = -60012
SUPERSEDED_MESSAGE = "A newer translation job superseded this recovery"
CANCELLED_MESSAGE = "Translation was cancelled"


@dataclass(frozen=True)
class ParserConfig:
    endpoint_fingerprint: str | None = None
    backend: str = PARSER_BACKEND
    parser_version: str = PARSER_VERSION
    normalizer_version: str = NORMALIZER_VERSION


def upsert_jobs(history: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Final row per job from its ordered writes.

    The last write wins, but the first cancelled one freezes the row; ``started_at`` is the
    first one written at all, ``created_at`` and the owners are those of the first write. Only
    extremes are needed, so they combine on the map side whatever the number of writes.
    """
    fixed = [c for c in ("document_id", "chapter_id", "job_id", "created_at") if c in history.columns]
    fields = [c for c in history.columns if c not in (key, order, "started_at", *fixed)]
    row = F.struct(*fields)
    folded = history.groupBy(key).agg(
        F.min_by(row, F.when(F.col("state") == "cancelled", F.col(order))).alias("frozen"),
        F.max_by(row, order).alias("last"),
        F.min_by("started_at", F.when(F.col("started_at").isNotNull(), F.col(order))).alias("started_at"),
        F.min_by(F.struct(*fixed), order).alias("fixed"),
    ).withColumn("row", F.coalesce("frozen", "last"))
    return folded.select(key, *[F.col(f"fixed.{c}") for c in fixed], *[F.col(f"row.{c}") for c in fields], "started_at")


def state_change_events(
    history: DataFrame, key: str = "job_id", order: str = "seq", base: DataFrame | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """An event per actual state change, numbered per job after ``base`` (job_id, max_sequence).

    Writes after a cancelled one change nothing and make no event.
    """
    # both scans share one layout, and the second needs no further shuffle
    seen = ordered_scan(
        lay_out(history, [key], order, ranges), [key], order,
        {
            "__prev": ("last", F.struct(F.col(order).alias("o"), F.col("state").alias("s"))),
            "__dead": ("max", (F.col("state") == "cancelled").cast("int")),
        },
        inclusive=False,
    )
    changed = seen.filter(
        (F.coalesce("__dead", F.lit(0)) == 0) & ~F.col("__prev.s").eqNullSafe(F.col("state"))
    ).drop("__prev", "__dead")
    numbered = ordered_row_number(changed, [key], order, "sequence").drop(RANGE)
    if base is not None:
        numbered = numbered.join(base, key, "left").withColumn(
            "sequence", F.col("sequence") + F.coalesce("max_sequence", F.lit(0))).drop("max_sequence")
    return numbered


def latest_job(jobs: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Newest translation job per chapter, optionally only of the given (chapter_id, plan_digest)."""
    rows = jobs.filter(F.col("kind").isin(TRANSLATION_KINDS))
    if plans is not None:
        rows = rows.join(plans, ["chapter_id", "plan_digest"], "left_semi")
    rest = [c for c in jobs.columns if c != "chapter_id"]
    return rows.groupBy("chapter_id").agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "rowid")).alias("j")
    ).select("chapter_id", "j.*")


def latest_operation(ops: DataFrame, jobs: DataFrame, backend: str | None = None) -> DataFrame:
    """Newest operation per document with the session of its job."""
    sessions = jobs.select(F.col("id").alias("job_id"), "session_id")
    rows = ops if backend is None else ops.filter(F.col("backend") == backend)
    joined = rows.join(sessions, "job_id")
    rest = [c for c in joined.columns if c != "document_id"]
    return joined.groupBy("document_id").agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("o")
    ).select("document_id", "o.*")


def mark_interrupted(jobs: DataFrame) -> DataFrame:
    """Open jobs become interrupted; those with a newer twin (chapter and plan) are cancelled.

    A job without chapter or plan has no twin and takes no part in the join.
    """
    translation = F.col("kind").isin(TRANSLATION_KINDS)
    keyed = F.col("chapter_id").isNotNull() & F.col("plan_digest").isNotNull()
    newest = jobs.filter(translation & keyed).groupBy(
        "chapter_id", "plan_digest").agg(F.max(F.struct("created_at", "rowid")).alias("__newest"))
    rows = jobs.filter(keyed).join(newest, ["chapter_id", "plan_digest"], "left").unionByName(
        jobs.filter(~keyed), allowMissingColumns=True)
    state = F.when(translation & F.col("state").isin("queued", "running"), "interrupted").otherwise(F.col("state"))
    old = translation & (state == "interrupted") & F.coalesce(
        F.struct("created_at", "rowid") < F.col("__newest"), F.lit(False))
    changed = {
        "state": F.when(old, "cancelled").otherwise(state),
        "error_code": F.when(old, "superseded").otherwise(F.col("error_code")),
        "safe_message": F.when(old, SUPERSEDED_MESSAGE).otherwise(F.col("safe_message")),
        "completed_at": F.when(old, F.col("updated_at")).otherwise(F.col("completed_at")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in jobs.columns])


def recovery_queue(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Interrupted translation jobs in the order they would restart; prefetch never does."""
    rows = jobs.filter(F.col("kind").isin(TRANSLATION_KINDS) & (F.col("state") == "interrupted")).withColumn(
        "restart", F.col("kind") == "translate"
    ).orderBy(F.col("priority").desc(), "created_at", "rowid")
    return rows if limit is None else rows.limit(limit)


def _settings_changed(ops: DataFrame, when: Column) -> dict[str, Column]:
    return {
        "state": F.when(when, "status_unknown").otherwise(F.col("state")),
        "progress": F.when(when, None).otherwise(F.col("progress")),
        "error_code": F.when(when, "provider_settings_changed").otherwise(F.col("error_code")),
        "completed_at": F.when(when, None).otherwise(F.col("completed_at")),
    }


def recoverable_operations(ops: DataFrame, config: ParserConfig) -> DataFrame:
    """Newest open operation per document of the current backend and parser, with ``resume``.

    An older normalizer is upgraded in place; another endpoint makes the status unknown.
    """
    rows = ops.filter(
        F.col("state").isin(OPEN_OPERATION_STATES) & (F.col("backend") == config.backend)
        & (F.col("parser_version") == config.parser_version)
    ).withColumn("normalizer_version", F.lit(config.normalizer_version))
    rest = [c for c in ops.columns if c != "document_id"]
    newest = rows.groupBy("document_id").agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("o")).select("document_id", "o.*")
    other = ~F.col("endpoint_fingerprint").eqNullSafe(F.lit(config.endpoint_fingerprint))
    if config.endpoint_fingerprint is None:
        other = F.lit(False)
    changed = _settings_changed(newest, other)
    return newest.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in ops.columns],
        (~other & F.lit(config.endpoint_fingerprint is not None)).alias("resume"),
    ).orderBy("created_at", "id")


def apply_version_change(ops: DataFrame, config: ParserConfig, at: int) -> DataFrame:
    """Open operations of an outdated parser end; a newer normalizer alone keeps them."""
    is_open = F.col("state").isin(OPEN_OPERATION_STATES)
    upgrade = is_open & (F.col("parser_version") == config.parser_version) & (
        F.col("normalizer_version") != config.normalizer_version)
    current = (
        (F.col("backend") == config.backend) & (F.col("parser_version") == config.parser_version)
        & (F.col("normalizer_version") == config.normalizer_version))
    outdated = is_open & ~upgrade & ~current
    state = F.when(F.col("batch_id").isNotNull(), "status_unknown").otherwise("cancelled")
    changed = {
        "normalizer_version": F.when(upgrade, config.normalizer_version).otherwise(F.col("normalizer_version")),
        "state": F.when(outdated, state).otherwise(F.col("state")),
        "progress": F.when(outdated, None).otherwise(F.col("progress")),
        "error_code": F.when(outdated, "parser_version_changed").otherwise(F.col("error_code")),
        "updated_at": F.when(upgrade | outdated, at).otherwise(F.col("updated_at")),
        "completed_at": F.when(outdated & F.col("batch_id").isNull(), at).when(outdated, None).otherwise(F.col("completed_at")),
    }
    return ops.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in ops.columns])


def supersede_operations(ops: DataFrame, pairs: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """(operations, errors) for pairs (old_id, document_id, replacement_id, replacement_state).

    A pair is valid if the old operation is of that document and its status is unknown now and
    the replacement is queued; then the old one is cancelled and the new one appended.
    """
    old = ops.select(F.col("id").alias("old_id"), F.col("document_id").alias("__doc"), F.col("state").alias("__state"))
    checked = pairs.join(old, "old_id", "left").withColumn(
        "error_code",
        F.when(~F.col("__doc").eqNullSafe(F.col("document_id")) | (F.col("replacement_state") != "queued"), "invalid_replacement")
        .when(~F.col("__state").eqNullSafe(F.lit("status_unknown")), "not_eligible"))
    good = checked.filter("error_code IS NULL")
    gone = good.select(F.col("old_id").alias("id"), F.lit(True).alias("__gone"))
    hit = F.coalesce("__gone", F.lit(False))
    changed = {
        "state": F.when(hit, "cancelled").otherwise(F.col("state")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
        "completed_at": F.when(hit, at).otherwise(F.col("completed_at")),
    }
    kept = ops.join(gone, "id", "left").select(*[changed[c].alias(c) if c in changed else F.col(c) for c in ops.columns])
    base = good.join(ops.select(F.col("id").alias("old_id"), *[c for c in ops.columns if c not in ("id", "document_id")]), "old_id")
    fresh = {"id": F.col("replacement_id"), "state": F.lit("queued"), "created_at": F.lit(at), "updated_at": F.lit(at)}
    empty = ("batch_id", "progress", "error_code", "completed_at")
    new = base.select(*[
        (fresh[f.name] if f.name in fresh else F.lit(None) if f.name in empty else F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in ops.schema])
    return kept.unionByName(new), checked.filter("error_code IS NOT NULL").select("old_id", "replacement_id", "error_code")


def _end_jobs(jobs: DataFrame, hit: Column, at: Column | int, message: str, code: str) -> DataFrame:
    when = F.lit(at) if isinstance(at, int) else at
    changed = {
        "state": F.when(hit, "cancelled").otherwise(F.col("state")),
        "error_code": F.when(hit, code).otherwise(F.col("error_code")),
        "safe_message": F.when(hit, message).otherwise(F.col("safe_message")),
        "updated_at": F.when(hit, when).otherwise(F.col("updated_at")),
        "completed_at": F.when(hit, when).otherwise(F.col("completed_at")),
    }
    return jobs.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in jobs.columns if not c.startswith("__")])


def _end_translations(translations: DataFrame, dead: DataFrame, at: int, code: str, message: str) -> DataFrame:
    rows = translations.join(dead.select(F.col("id").alias("job_id"), F.lit(True).alias("__dead")), "job_id", "left")
    hit = F.coalesce(F.col("__dead") & F.col("is_active") & F.col("state").isin("queued", "translating"), F.lit(False))
    changed = {
        "state": F.when(hit, "cancelled").otherwise(F.col("state")),
        "error_code": F.when(hit, code).otherwise(F.col("error_code")),
        "error_message": F.when(hit, message).otherwise(F.col("error_message")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in translations.columns])


def supersede_interrupted(jobs: DataFrame, translations: DataFrame, ids: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Named interrupted jobs are cancelled, and so are their unfinished rows."""
    named = ids.select("id", F.lit(True).alias("__named"))
    marked = jobs.join(named, "id", "left")
    hit = F.coalesce(F.col("__named") & (F.col("state") == "interrupted"), F.lit(False))
    dead = jobs.filter("state = 'interrupted'").join(ids, "id", "left_semi")
    return (
        _end_jobs(marked, hit, at, SUPERSEDED_MESSAGE, "superseded").select(*jobs.columns),
        _end_translations(translations, dead, at, "superseded", SUPERSEDED_MESSAGE),
    )


def cancel_documents(
    jobs: DataFrame, translations: DataFrame, events: DataFrame, ids: DataFrame, at: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Open translation jobs of the documents (document_id) end, their rows too, one event each."""
    affected = F.col("kind").isin(TRANSLATION_KINDS) & F.col("state").isin(OPEN_JOB_STATES)
    marked = jobs.join(ids.select("document_id", F.lit(True).alias("__named")), "document_id", "left")
    hit = F.coalesce(F.col("__named") & affected, F.lit(False))
    dead = jobs.filter(affected).join(ids, "document_id", "left_semi").select("id")
    last = events.groupBy("job_id").agg(F.max("sequence").alias("__seq"))
    new = dead.withColumnRenamed("id", "job_id").join(last, "job_id", "left").select(
        "job_id", (F.coalesce("__seq", F.lit(0)) + 1).alias("sequence"), F.lit("translation_state_changed").alias("event_type"),
        F.lit("cancelled").alias("state"), F.lit(at).cast("long").alias("created_at"))
    return (
        _end_jobs(marked, hit, at, CANCELLED_MESSAGE, "cancelled").select(*jobs.columns),
        _end_translations(translations, dead, at, "cancelled", CANCELLED_MESSAGE),
        new,
    )


def job_state_of(state: Column) -> Column:
    """Job state that mirrors an operation state."""
    return (
        F.when(state.isin("uploading", "downloading", "normalizing"), "running")
        .when(state == "processing", "waiting_remote").otherwise(state))


def parse_view(documents: DataFrame, artifacts: DataFrame, ops: DataFrame, config: ParserConfig | None = None) -> DataFrame:
    """What a reader sees per document: open operation, else current artifact, else last operation.

    ``artifacts``: document_id, is_active, backend, parser_version, normalizer_version.
    """
    config = config or ParserConfig()

    def current(df_cols=("backend", "parser_version", "normalizer_version")) -> Column:
        b, p, n = (F.col(c) for c in df_cols)
        return (b == config.backend) & (p == config.parser_version) & (n == config.normalizer_version)

    ready = artifacts.filter(F.col("is_active") & current()).select("document_id", F.lit(True).alias("__ready")).distinct()
    fields = ["id", "state", "progress", "error_code", "backend", "parser_version", "normalizer_version"]
    newest = ops.filter(F.col("backend") == config.backend).groupBy("document_id").agg(
        F.max_by(F.struct(*fields), F.struct("created_at", "id")).alias("o")).select("document_id", "o.*").filter(
        current() | ((F.col("state") == "status_unknown") & F.coalesce(F.col("error_code") == "parser_version_changed", F.lit(False))))
    joined = documents.select(F.col("id").alias("document_id")).join(ready, "document_id", "left").join(
        newest.select("document_id", F.col("id").alias("__op"), F.col("state").alias("__state"),
                      F.col("progress").alias("__progress")), "document_id", "left")
    is_open = F.col("__state").isin(OPEN_OPERATION_STATES)
    shown = (
        F.when(F.col("__state") == "succeeded", "ready").when(F.col("__state").isin("failed", "cancelled"), "failed")
        .otherwise(F.col("__state")))
    state = F.when(is_open, F.col("__state")).when(F.col("__ready"), "ready").otherwise(F.coalesce(shown, F.lit("not_started")))
    lifecycle = (
        F.when(F.col("parse_state").isin("queued", "uploading", "processing", "downloading", "normalizing"), "parsing")
        .when(F.col("parse_state").isin("ready", "not_started"), "ready").otherwise("degraded"))
    return joined.select(
        "document_id", state.alias("parse_state"),
        F.when(is_open, F.col("__progress")).when(F.col("__ready"), 1.0).otherwise(F.col("__progress")).alias("progress"),
        F.col("__op").alias("operation_id"), job_state_of(F.col("__state")).alias("job_state"),
    ).withColumn("lifecycle", lifecycle)


def align_remote_status(statuses: DataFrame, ops: DataFrame) -> DataFrame:
    """Status of each operation from its batch's answer, found by data_id and never by position.

    ``statuses``: batch_id, code, results array<struct<data_id, state, extract_progress, full_zip_url>>.
    ``ops``: operation id, batch_id, data_id.
    """
    found = statuses.select("batch_id", "code", F.posexplode_outer("results").alias("__i", "r")).groupBy(
        "batch_id", F.col("r.data_id").alias("data_id")).agg(F.min_by("r", "__i").alias("r"))
    codes = statuses.select("batch_id", "code")
    joined = ops.join(codes, "batch_id", "left").join(found, ["batch_id", "data_id"], "left")
    state, done = F.col("r.state"), F.coalesce("r.extract_progress.extracted_pages", F.lit(0))
    total = F.coalesce("r.extract_progress.total_pages", F.lit(0))
    status = (
        F.when(F.col("code") == REMOTE_MISSING_CODE, "missing").when(F.col("code") != 0, "protocol_error")
        .when(F.col("r").isNull(), "missing").when((state == "done") & F.col("r.full_zip_url").isNull(), "protocol_error")
        .when(state.isin("pending", "running", "done", "failed"), state).otherwise("protocol_error"))
    return joined.select(
        "id", status.alias("status"),
        F.when((status == "running") & (total > 0), F.least(done, total) / total).alias("progress"),
        F.when(status == "done", F.col("r.full_zip_url")).alias("download_url"))


def next_poll(ops: DataFrame) -> DataFrame:
    """Next due time of operations waiting for the remote parser (id, polling_since, polled_at in ms)."""
    elapsed = F.floor((F.col("polled_at") - F.col("polling_since")) / 1000)
    wait = F.when(elapsed >= POLL_SLOW_AFTER_S, POLL_SLOW_S).when(elapsed >= POLL_MEDIUM_AFTER_S, POLL_MEDIUM_S).otherwise(POLL_FAST_S)
    over = elapsed >= POLL_TIMEOUT_S
    return ops.select(
        "id", F.when(~over, F.col("polled_at") + wait * 1000).alias("due_at"),
        F.when(over, "status_unknown").otherwise("processing").alias("state"))


def resolve_ambiguous_uploads(ops: DataFrame, statuses: DataFrame) -> DataFrame:
    """What follows when an upload's answer was lost: (id, status, http_status) decides."""
    joined = ops.select("id").join(statuses, "id", "left")
    s = F.col("status")
    action = (
        F.when(F.col("http_status").isin(401, 403), "failed").when(s == "done", "download").when(s == "failed", "failed")
        .when(s.isin("pending", "running"), "continue").otherwise("status_unknown"))
    code = (
        F.when(F.col("http_status").isin(401, 403), "unauthorized").when(s == "failed", "remote_failed")
        .when(action == "status_unknown", "upload_status_unknown"))
    return joined.select("id", action.alias("action"), code.alias("error_code"))


def latest_prefetched(jobs: DataFrame) -> DataFrame:
    """Chapter of the last finished prefetch per document."""
    rows = jobs.filter((F.col("kind") == "prefetch") & (F.col("state") == "succeeded"))
    return rows.groupBy("document_id").agg(F.max_by("chapter_id", F.struct("completed_at", "id")).alias("chapter_id"))
