"""Stored tables with fixed schemas, published artifacts and response fragments."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.digest import ordered_digest
from docloom.operators.documents import document_pieces, flag_translatable
from docloom.schemas import (
    BLOCK_KINDS, CHAPTER_ROLES, DOCUMENT_VALUE, FILE_STATES, JOB_STATES, NORMALIZER_VERSION, PARSER_BACKEND,
    MAX_RESPONSE_BYTES, PARSER_VERSION, TRANSLATION_STATES,
)

TABLES = {
    "documents": (
        "id string, sha256 string, title string, authors array<string>, page_count int, file_path string, file_size_bytes long, "
        "file_mtime_ms long, file_state string, last_opened_at long, created_at long, updated_at long"),
    "provider_profiles": (
        "owner_id string, kind string, origin string, base_path string, fingerprint string, model_id string, context_window long, "
        "updated_at long, created_at long"),
    "jobs": (
        "id string, session_id string, document_id string, chapter_id string, kind string, priority int, state string, plan_digest string, "
        "error_code string, safe_message string, created_at long, updated_at long, started_at long, completed_at long, rowid long"),
    "processed_commands": "session_id string, seq long, command_id string, status string, revision long, expires_at long",
    "reading_positions": "document_id string, page int, page_offset_ratio double, scale_value string, updated_at long",
    "settings": "key string, value string",
    "app_metadata": "key string, value string",
    "parse_operations": (
        "id string, document_id string, job_id string, backend string, state string, parser_version string, normalizer_version string, "
        "endpoint_fingerprint string, batch_id string, progress double, error_code string, created_at long, updated_at long, completed_at long"),
    "parse_artifacts": (
        "id string, document_id string, is_active boolean, backend string, parser_version string, normalizer_version string, "
        "source_sha256 string, manifest_path string, content_digest string, created_at long"),
    "chapters": (
        "id string, artifact_id string, document_id string, order_index int, depth int, role string, source_title string, page_start int, "
        "page_end int, content_digest string"),
    "job_events": "job_id string, sequence long, event_type string, state string, created_at long",
    "translations": (
        "id string, job_id string, block_id string, request_digest string, source_digest string, state string, is_active boolean, "
        "target_json string, target_plain_text string, validation_json string, error_code string, error_message string, created_at long, updated_at long"),
    "reading_conversations": "id string, document_id string, created_at long, updated_at long",
    "reading_messages": (
        "id string, conversation_id string, role string, state string, text string, sequence long, responding_to string, selection string, updated_at long"),
    "reading_citations": "message_id string, order_index int, block_id string, page int, label string",
}
ENUMS = {
    ("documents", "file_state"): FILE_STATES, ("jobs", "state"): [*JOB_STATES, "waiting_remote", "status_unknown"],
    ("chapters", "role"): CHAPTER_ROLES, ("blocks", "kind"): BLOCK_KINDS, ("translations", "state"): TRANSLATION_STATES,
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and of the declared types; absent ones are null."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(TABLES[name]).fields
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def write_table(df: DataFrame, root: str, name: str) -> str:
    """A new version of the table; readers see it once its pointer row is written, last."""
    version = uuid.uuid4().hex
    path = f"{root}/{name}/{version}"
    conform(df, name).write.parquet(path)
    pointer = df.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/{name}_pointer")
    return path


def read_table(spark: SparkSession, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows, error rows) of the newest version; unknown enum values are errors, not failures."""
    newest = spark.read.parquet(f"{root}/{name}_pointer").orderBy(F.col("at").desc()).limit(1).first()["version"]
    rows = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}/{newest}")
    known = F.lit(True)
    for (table, column), values in ENUMS.items():
        if table == name:
            known = known & F.coalesce(F.col(column).isin(values), F.lit(False))
    return rows.filter(known), rows.filter(~known)


# ---- artifacts -------------------------------------------------------------------------
def manifests_of(normalized, sources: DataFrame) -> DataFrame:
    """Every document's manifest: (doc_id, artifact_id, manifest_path, place, kind, value).

    A manifest is stored as the pieces of its JSON, which, joined in order, are the file.
    """
    return document_pieces(normalized, sources).withColumn("manifest_path", F.concat("artifact_id", F.lit("/manifest.json")))


def manifest_digests(manifests: DataFrame) -> DataFrame:
    """(manifest_path, content_digest): sha256 of each manifest's whole JSON, for all sizes."""
    return ordered_digest(manifests, ["manifest_path"], "place", F.encode("value", "UTF-8"), None, "content_digest")


def _heads(manifests: DataFrame) -> DataFrame:
    """(manifest_path, document): what stands before a manifest's chapters."""
    head = F.from_json(F.concat("value", F.lit("]}")), DOCUMENT_VALUE)
    return manifests.filter("kind = 'head'").select("manifest_path", head.alias("document"))


def publish_artifacts(normalized, sources: DataFrame, artifacts: DataFrame, at: int) -> dict[str, DataFrame]:
    """New state of artifacts, chapters and blocks after publishing, all derived from one input.

    The newest artifact of a document is its only active one. Writers store the tables under a
    new version and the pointer last, so readers see all of a document or nothing. ``pointers``
    (id, document_id, is_active) are the artifacts without their digests: every manifest has one
    head, so who is published is known without reading the blocks' texts.
    """
    manifests = manifests_of(normalized, sources)
    heads = manifests.filter("kind = 'head'").select(
        F.col("artifact_id").alias("id"), F.col("doc_id").cast("string").alias("document_id"), "manifest_path")
    shas = sources.select(F.col("artifact_id").alias("id"), "source_sha256")
    new = heads.join(manifest_digests(manifests), "manifest_path").join(shas, "id").select(
        "id", "document_id", F.lit(True).alias("is_active"), F.lit(PARSER_BACKEND).alias("backend"), F.lit(PARSER_VERSION).alias("parser_version"),
        F.lit(NORMALIZER_VERSION).alias("normalizer_version"), "source_sha256", "manifest_path", "content_digest", F.lit(at).cast("long").alias("created_at"))
    kept = artifacts.join(heads.select("id"), "id", "left_anti")
    replaced = heads.select("document_id", F.lit(True).alias("__new"))
    old = kept.join(replaced, "document_id", "left").withColumn(
        "is_active", F.col("is_active") & F.col("__new").isNull()).drop("__new")
    return {
        "parse_artifacts": old.select(*new.columns).unionByName(new),
        "pointers": old.select("id", "document_id", "is_active").unionByName(heads.select("id", "document_id", F.lit(True).alias("is_active"))),
        "chapters": normalized.chapters,
        "blocks": flag_translatable(normalized.blocks),
        "manifests": manifests,
    }


def finish_operations(ops: DataFrame, published: DataFrame, at: int) -> DataFrame:
    """Operations of published documents (document_id) in state normalizing succeed."""
    done = published.filter("is_active").select("document_id", F.lit(True).alias("__done")).distinct()
    hit = F.coalesce(F.col("__done") & (F.col("state") == "normalizing"), F.lit(False))
    changed = {
        "state": F.when(hit, "succeeded").otherwise(F.col("state")), "progress": F.when(hit, 1.0).otherwise(F.col("progress")),
        "completed_at": F.when(hit, at).otherwise(F.col("completed_at"))}
    return ops.join(done, "document_id", "left").select(*[changed[c].alias(c) if c in changed else F.col(c) for c in ops.columns])


def safe_path(path: Column) -> Column:
    parts = F.split(path, "/", -1)
    return (path != "") & ~path.startswith("/") & ~F.array_contains(parts, "..")


def read_active_documents(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Active artifact -> head of its document and number of chapters, with a status where it cannot be used.

    ``manifests``: pieces as of :func:`manifests_of`; the blocks of a usable document are those
    ``find_blocks`` gives for its pieces. Status: ok, unsafe_path, unavailable, digest_mismatch,
    wrong_document, or outdated (another parser or normalizer made it).
    """
    counts = manifests.groupBy("manifest_path").agg(F.count_if(F.col("kind") == "chapter").cast("int").alias("__chapters"))
    stored = _heads(manifests).join(manifest_digests(manifests).withColumnRenamed("content_digest", "__digest"), "manifest_path").join(
        counts, "manifest_path")
    rows = artifacts.filter("is_active").select("document_id", "manifest_path", "content_digest").join(stored, "manifest_path", "left")
    current = (
        (F.col("document.parser.backend") == PARSER_BACKEND) & (F.col("document.parser.version") == PARSER_VERSION)
        & (F.col("document.normalizerVersion") == NORMALIZER_VERSION))
    status = (
        F.when(~safe_path(F.col("manifest_path")), "unsafe_path").when(F.col("__digest").isNull(), "unavailable")
        .when(F.col("__digest") != F.col("content_digest"), "digest_mismatch")
        .when(F.col("document.documentId") != F.col("document_id"), "wrong_document")
        .when(~F.coalesce(current, F.lit(False)), "outdated").otherwise("ok"))
    ok = F.col("status") == "ok"
    return rows.withColumn("status", status).select(
        "document_id", "manifest_path", "status", F.when(ok, F.col("document")).alias("document"), F.when(ok, F.col("__chapters")).alias("chapters"))


def resume_finalized(manifests: DataFrame, ops: DataFrame) -> DataFrame:
    """Manifests on disk judged against unfinished operations: adopt or discard.

    ``manifests``: pieces. ``ops``: id, artifact_id, document_id, source_sha256,
    backend, parser_version, normalizer_version, state.
    """
    found = _heads(manifests).withColumnRenamed("document", "d").select(
        "manifest_path", F.col("d.artifactId").alias("artifact_id"), F.col("d.documentId").alias("document_id"),
        F.col("d.sourceSha256").alias("source_sha256"), F.col("d.parser.backend").alias("backend"),
        F.col("d.parser.version").alias("parser_version"), F.col("d.normalizerVersion").alias("normalizer_version"))
    same = ["artifact_id", "document_id", "source_sha256", "backend", "parser_version", "normalizer_version"]
    unfinished = ops.filter(~F.col("state").isin("succeeded", "failed", "cancelled")).select(*same, F.col("id").alias("operation_id"))
    return found.join(unfinished, same, "left").select(
        "manifest_path", "artifact_id", "operation_id", F.when(F.col("operation_id").isNotNull(), "adopt").otherwise("discard").alias("outcome"))


# ---- response fragments ----------------------------------------------------------------
def parse_fragments(events: DataFrame) -> DataFrame:
    """request_id, seq, fragment, finish_reason, error, done from decoded stream events (request_id, seq, data)."""
    data = F.col("data")
    done = F.trim(data) == "[DONE]"
    payload = F.when(~done, data)
    return events.select(
        "request_id", "seq", F.coalesce(F.get_json_object(payload, "$.choices[0].delta.content"), F.lit("")).alias("fragment"),
        F.get_json_object(payload, "$.choices[0].finish_reason").alias("finish_reason"),
        F.get_json_object(payload, "$.error.message").alias("error"),
        (done | F.get_json_object(payload, "$.error").isNotNull()).alias("done"))


def read_response_fragments(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Fragments from a folder of event files, as a batch or as a stream."""
    schema = "request_id string, seq long, data string"
    reader = spark.readStream if stream else spark.read
    return parse_fragments(reader.schema(schema).parquet(path))


def join_fragments(fragments: DataFrame, max_bytes: int = MAX_RESPONSE_BYTES) -> DataFrame:
    """(request_id, body, finish_reason, error, ended): texts joined in order up to the end mark.

    Sizes are summed first. Only responses within the limit are gathered into one row, from
    fragments that hold text; a larger one keeps a null body and the error response_too_large.
    """
    end = fragments.filter("done").groupBy("request_id").agg(F.min("seq").alias("__end"))
    kept = fragments.join(end, "request_id", "left").filter(F.col("__end").isNull() | (F.col("seq") <= F.col("__end")))
    heads = kept.groupBy("request_id").agg(
        F.sum(F.octet_length("fragment").cast("long")).alias("bytes"),
        F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq"))).alias("finish_reason"),
        F.max("error").alias("error"), F.bool_or("done").alias("ended"))
    small = heads.filter(F.col("bytes") <= max_bytes).select("request_id")
    texts = kept.filter("fragment <> ''").join(small, "request_id", "left_semi").groupBy("request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "fragment"))), lambda x: x["fragment"]), "").alias("body"))
    over = F.col("bytes") > max_bytes
    return heads.join(texts, "request_id", "left").select(
        "request_id", F.when(~over, F.coalesce("body", F.lit(""))).alias("body"), "finish_reason",
        F.when(over, "response_too_large").otherwise(F.col("error")).alias("error"), "ended")
