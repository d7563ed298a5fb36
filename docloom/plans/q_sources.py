"""Registered queries of sources, sinks, cascades and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions.stage import materialize, stage_path
from docloom.operators import library as L
from docloom.plans.bridge import Corpus, StreamCorpus, digit, in_turns
from docloom.plans.oracle_base import compose, cte, digit as sql_digit
from docloom.plans.q_library import EXISTING, INCOMING, VALID_POSITION
from docloom.plans.registry import ORACLES, register
from docloom.session import checkpoint_dir
from docloom.sources import files as S
from docloom.sources import tables as T
from docloom.streaming import processors as X
from docloom.streaming import sinks

NOW = 9_000_000

def _folder(c: Corpus) -> str:
    return f"{checkpoint_dir(c.spark)}/docloom-{uuid.uuid4().hex}"


def _inventory(c: Corpus):
    """Every document as a file of its own, a third of them with a PDF's first bytes, listed and read."""
    root = _folder(c)
    mark = F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7 ").otherwise("")
    path = F.concat((F.col("doc_id") % 64).cast("string"), F.lit("/"), "doc_id", F.lit(".pdf"))
    S.write_files(c.table("documents").select(path.alias("path"), F.encode(F.concat(mark, "text", F.lit("\n")), "UTF-8").alias("content")), root)
    return S.scan_pdf_inventory(c.spark, root).select(
        F.regexp_extract("path", "([0-9]+)[.]pdf$", 1).cast("long").alias("doc_id"), "length", "sha256", "has_header")


register("S1_scan_pdf_inventory", _inventory,
         """SELECT doc_id, octet_length(b) AS length, sha256(b) AS sha256, doc_id % 3 = 0 AS has_header
FROM (SELECT doc_id, encode(CASE WHEN doc_id % 3 = 0 THEN '%PDF-1.7 ' ELSE '' END || text || chr(10)) AS b FROM documents)""")


def _parsed(c: Corpus):
    """Parser output of every document as files, a folder for each, scanned."""
    root = _folder(c)
    row = F.struct(*[x for x in c.raw.columns if x not in ("doc_id", "pos")])
    lists = c.raw.groupBy("doc_id").agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(row.alias("r")).alias("s")))), lambda x: x["s"]["r"])).alias("json"))
    layouts = c.layout.select("doc_id", F.to_json(F.struct("pdf_info")).alias("json"))

    def named(rows, name):
        return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"), F.encode("json", "UTF-8").alias("content"))

    S.write_files(named(lists, F.concat("doc_id", F.lit("_content_list.json"))).unionByName(named(layouts, F.lit("layout.json"))), root)
    raw, layout = S.scan_parser_output(c.spark, root)
    return raw.withColumn("doc_id", F.col("doc_id").cast("long")), layout.withColumn("doc_id", F.col("doc_id").cast("long"))


register("S2_scan_parser_output", lambda c: _parsed(c)[0].select("doc_id", "pos", "type", "text", "text_level", "page_idx", "img_path"),
         compose("SELECT doc_id, pos, type, text, text_level, page_idx::INT AS page_idx, img_path FROM raw"))
register("S2_scan_layouts", lambda c: _parsed(c)[1].select(
    "doc_id", F.size("pdf_info").alias("pages")), compose("SELECT doc_id, count(*)::INT AS pages FROM page_rows GROUP BY 1"))


def _images(c: Corpus, folder=None):
    k = digit("doc_id")
    magic = F.when(k < 5, "89504E470D0A1A0A").when(k < 9, "FFD8FFE0").when(k < 12, "524946460000000057454250").otherwise("00")
    ext = F.when(k % 3 == 0, ".png").when(k % 3 == 1, ".JPG").otherwise(".webp")
    content = F.concat(F.unhex(magic), F.encode("text", "UTF-8"))
    return c.table("documents").select(F.concat(F.lit("images/") if folder is None else folder, F.sha2(content, 256), ext).alias("path"), content.alias("content"))


register("S3_verify_assets", lambda c: S.verify_assets(_images(c)).select("path", "sha256", "size_bytes", "mime_type", "ok", "name_matches_hash"),
         compose(f"""SELECT 'images/' || sha256(b) || e AS path, sha256(b) AS sha256, octet_length(b) AS size_bytes, m AS mime_type,
  coalesce(m = CASE e WHEN '.png' THEN 'image/png' WHEN '.JPG' THEN 'image/jpeg' ELSE 'image/webp' END, false) AS ok, true AS name_matches_hash
FROM (SELECT unhex(CASE WHEN k < 5 THEN '89504E470D0A1A0A' WHEN k < 9 THEN 'FFD8FFE0' WHEN k < 12 THEN '524946460000000057454250' ELSE '00' END) || encode(text) AS b,
  CASE k % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' ELSE '.webp' END AS e, CASE WHEN k < 5 THEN 'image/png' WHEN k < 9 THEN 'image/jpeg' WHEN k < 12 THEN 'image/webp' END AS m FROM doc_keys)"""))


def _scanned_assets(c: Corpus):
    """The same images as files below their documents' folders."""
    root = _folder(c)
    S.write_files(_images(c, F.concat("doc_id", F.lit("/images/"))), root)
    return S.scan_assets(c.spark, root).withColumn("path", F.regexp_extract("path", "([0-9]+/images/.*)", 1))


register("S3_scan_assets", lambda c: _scanned_assets(c).select("path", "sha256", "size_bytes", "mime_type", "ok", "name_matches_hash"),
         ORACLES["S3_verify_assets"].replace("'images/' || sha256(b)", "doc_id || '/images/' || sha256(b)").replace("encode(text) AS b,", "encode(text) AS b, doc_id,"))


def _published(c: Corpus):
    old = c.sources.filter(F.col("doc_id") % 2 == 0).select(
        F.concat(F.lit("old-"), "doc_id").alias("id"), F.col("doc_id").cast("string").alias("document_id"), F.lit(True).alias("is_active"),
        F.lit("cloud_mineru").alias("backend"), F.lit("old").alias("parser_version"), F.lit("old").alias("normalizer_version"), "source_sha256",
        F.lit("x").alias("manifest_path"), F.lit("x").alias("content_digest"), F.lit(1).cast("long").alias("created_at"))
    return T.publish_artifacts(c.normalized, c.sources, old, NOW)


GOOD = "(SELECT DISTINCT doc_id FROM chapters_all)"
register("S5_publish_artifacts", lambda c: _published(c)["parse_artifacts"].select("id", "document_id", "is_active", "source_sha256", "created_at"),
         compose(f"""SELECT 'old-' || k.doc_id AS id, k.doc_id::VARCHAR AS document_id, g.doc_id IS NULL AS is_active, sha AS source_sha256, 1::BIGINT AS created_at
FROM doc_keys k LEFT JOIN {GOOD} g ON g.doc_id = k.doc_id WHERE k.doc_id % 2 = 0
UNION ALL SELECT 'art-' || k.doc_id, k.doc_id::VARCHAR, true, sha, {NOW} FROM doc_keys k JOIN {GOOD} g ON g.doc_id = k.doc_id"""))
register("S5_manifests", lambda c: T.manifest_digests(_published(c)["manifests"]).select("manifest_path").join(
    _published(c)["manifests"].groupBy("manifest_path").agg(F.count_if(F.col("kind") == "block").alias("blocks"), F.count_if(F.col("kind") == "chapter").alias("chapters")),
    "manifest_path"),
    compose("SELECT 'art-' || doc_id || '/manifest.json' AS manifest_path, count(*) AS blocks, count(DISTINCT chapter_id) AS chapters FROM blocks_all GROUP BY doc_id"))
register("S5_blocks", lambda c: _published(c)["blocks"].select("block_id", "chapter_id", "order_index", "translatable"),
         compose("SELECT b.block_id, b.chapter_id, b.order_index, t.translatable FROM blocks_all b JOIN translatable t ON t.block_id = b.block_id"))
register("S5_chapters", lambda c: _published(c)["chapters"].select("chapter_id", "order_index", "block_count"),
         compose("SELECT chapter_id, order_index, block_count FROM chapters_all"))
register("S5_finish_operations", lambda c: T.finish_operations(
    c.operations, _published(c)["pointers"].withColumn("document_id", F.concat(F.lit("doc-"), "document_id")), NOW).select("id", "state", "progress"),
    compose(f"""SELECT o.id, CASE WHEN hit THEN 'succeeded' ELSE state END AS state, CASE WHEN hit THEN 1.0 ELSE progress END AS progress
FROM (SELECT o.*, state = 'normalizing' AND (g.doc_id IS NOT NULL OR (k.doc_id % 2 = 0)) AS hit FROM operations o LEFT JOIN doc_keys k ON 'doc-' || k.doc_id = o.document_id
  LEFT JOIN {GOOD} g ON g.doc_id = k.doc_id) o"""))


def _manifests(c: Corpus):
    return T.manifests_of(c.normalized, c.sources)


def _read_back(c: Corpus):
    m = _manifests(c)
    k = digit("artifact_id")
    artifacts = m.filter("kind = 'head'").join(T.manifest_digests(m), "manifest_path").select(
        F.when(k == 0, F.lit("other")).otherwise(F.col("doc_id").cast("string")).alias("document_id"), (k != 1).alias("is_active"),
        F.when(k == 2, F.lit("../x")).when(k == 3, F.lit("none")).otherwise(F.col("manifest_path")).alias("manifest_path"),
        F.when(k == 4, F.lit("bad")).otherwise(F.col("content_digest")).alias("content_digest"))
    return T.read_active_documents(artifacts, m).select("document_id", "status", "chapters")


register("S4_read_active_documents", _read_back,
         compose(f"""SELECT CASE WHEN k = 0 THEN 'other' ELSE doc_id::VARCHAR END AS document_id, status, CASE WHEN status = 'ok' THEN n ELSE -1 END::INT AS chapters
FROM (SELECT *, CASE k WHEN 2 THEN 'unsafe_path' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'digest_mismatch' WHEN 0 THEN 'wrong_document' ELSE 'ok' END AS status
  FROM (SELECT doc_id, count(*) AS n, {sql_digit("'art-' || doc_id")} AS k FROM chapters_all GROUP BY doc_id)) WHERE k <> 1""").replace("ELSE -1 END", "ELSE NULL END"))


def _resumed(c: Corpus):
    k = digit("artifact_id")
    ops = c.sources.select(
        F.concat(F.lit("op-"), "doc_id").alias("id"), F.when(k == 1, F.lit("x")).otherwise(F.col("artifact_id")).alias("artifact_id"),
        F.col("doc_id").cast("string").alias("document_id"), F.when(k == 2, F.lit("x")).otherwise(F.col("source_sha256")).alias("source_sha256"),
        F.lit("cloud_mineru").alias("backend"), F.when(k == 3, "old").otherwise("mineru-v4-vlm").alias("parser_version"),
        F.when(k == 4, "old").otherwise("mineru-v2").alias("normalizer_version"), F.when(k == 5, "failed").otherwise("normalizing").alias("state"))
    return T.resume_finalized(_manifests(c), ops)


register("S6_resume_finalized", lambda c: _resumed(c).select("artifact_id", "operation_id", "outcome"),
         compose(f"""SELECT 'art-' || doc_id AS artifact_id, CASE WHEN k NOT IN (1, 2, 3, 4, 5) THEN 'op-' || doc_id END AS operation_id, CASE WHEN k NOT IN (1, 2, 3, 4, 5) THEN 'adopt' ELSE 'discard' END AS outcome
FROM (SELECT DISTINCT doc_id, {sql_digit("'art-' || doc_id")} AS k FROM chapters_all)"""))


def _stored(c: Corpus):
    root = f"{checkpoint_dir(c.spark)}/docloom-tables-{c.spark.sparkContext.applicationId}"
    T.write_table(c.library.withColumn("file_state", F.when(F.col("created_at") % 10 == 1, "odd").otherwise(F.col("file_state"))), root, "documents")
    return T.read_table(c.spark, root, "documents")


register("S7_table_io", lambda c: _stored(c)[0].select("id", "sha256", "page_count", "file_state", "last_opened_at"),
         compose("SELECT id, sha256, page_count, file_state, last_opened_at FROM library WHERE created_at % 10 <> 1"))


def _events(c: Corpus):
    """Answers cut into stream events of 40 characters, an end mark and something after it."""
    b = c.bodies.join(c.responses, "request_id")
    # cut in one pass, as a body is not looked at again for each of its pieces
    pieces = F.regexp_extract_all("body", F.lit("(?s)(.{1,40})"), 1)
    end = F.to_json(F.struct(F.array(F.struct(F.col("finish_reason"))).alias("choices")))
    data = F.concat(
        F.transform(pieces, lambda piece: F.to_json(F.struct(F.array(F.struct(F.struct(piece.alias("content")).alias("delta"))).alias("choices")))),
        F.array(end, F.lit("[DONE]"), F.lit('{"choices":[{"delta":{"content":"late"}}]}')))
    return b.select("request_id", F.posexplode(data).alias("seq", "data")).withColumn("seq", F.col("seq").cast("long"))


cte("bodies", f"""
SELECT request_id, CASE WHEN {sql_digit('request_id')} < 5 THEN '```json' || chr(10) || '[' || string_agg(js, ',' ORDER BY ord) || ']' || chr(10) || '```'
  WHEN {sql_digit('request_id')} < 10 THEN string_agg(js, chr(10) ORDER BY ord) ELSE 'Here: ' || string_agg(js, ' \\ ' ORDER BY ord) || ' {{"id": "torn' END AS body
FROM (SELECT *, '{{"id":"' || block_id || '","target":' || to_json(target)::VARCHAR || '}}' AS js FROM records) GROUP BY request_id""")
register("S8_read_response_fragments", lambda c: T.join_fragments(T.read_response_fragments(c.spark, stage_path(_events(c), "events"))).select(
    "request_id", F.sha2("body", 256).alias("body_digest"), "finish_reason", "ended"),
    compose("SELECT b.request_id, sha256(body) AS body_digest, finish_reason, true AS ended FROM bodies b JOIN responses r ON r.request_id = b.request_id"))


def _removed(c: Corpus):
    docs = c.imports.select("id")
    n = c.normalized
    tables = {
        "documents": docs, "parse_artifacts": c.sources.select(F.col("artifact_id").alias("id"), F.concat(F.lit("doc-"), "doc_id").alias("document_id")),
        "jobs": c.job_columns("id", "document_id"), "chapters": n.chapters.select(F.col("chapter_id").alias("id"), "artifact_id"),
        "blocks": n.blocks.select(F.col("block_id").alias("id"), "chapter_id"), "translations": c.translations.select("id", "block_id"),
        "parse_operations": c.operations.select("id", "document_id"),
        "reading_positions": c.position_updates.select("document_id", "updated_at"),
        "reading_conversations": c.chats.select("id", "document_id"), "reading_messages": c.messages.select("id", "conversation_id"),
        "reading_citations": c.stored_citations}
    # tables without an id of their own
    keys = {"reading_positions": ("document_id", "updated_at"), "reading_citations": ("message_id", "block_id")}
    kept = L.remove_documents(tables, docs.filter(digit("id") < 5))
    out = None
    for name, rows in kept.items():
        part = rows.select(F.lit(name).alias("table"), F.concat_ws("@", *keys[name]).alias("id") if name in keys else "id")
        out = part if out is None else out.unionByName(part)
    return out


STAYS = f"NOT coalesce({sql_digit('document_id')} < 5 AND document_id IN (SELECT id FROM imports), false)"
KEPT = f"(SELECT id FROM imports WHERE {sql_digit('id')} >= 5)"
register("L6_remove_documents", _removed, compose(f"""
SELECT 'documents' AS "table", id FROM {KEPT} UNION ALL SELECT 'parse_artifacts', 'art-' || substr(id, 5) FROM {KEPT}
UNION ALL SELECT 'jobs', id FROM jobs WHERE NOT coalesce({sql_digit('document_id')} < 5 AND document_id IN (SELECT id FROM imports), false)
UNION ALL SELECT 'chapters', chapter_id FROM chapters_all WHERE 'doc-' || doc_id IN {KEPT} UNION ALL SELECT 'blocks', block_id FROM blocks_all WHERE 'doc-' || doc_id IN {KEPT}
UNION ALL SELECT 'translations', t.id FROM translations t JOIN blocks_all b ON b.block_id = t.block_id WHERE 'doc-' || b.doc_id IN {KEPT}
UNION ALL SELECT 'reading_conversations', id FROM chats WHERE {sql_digit('document_id')} >= 5
UNION ALL SELECT 'parse_operations', id FROM operations WHERE {STAYS}
UNION ALL SELECT 'reading_positions', document_id || '@' || updated_at FROM position_updates WHERE {STAYS}
UNION ALL SELECT 'reading_messages', m.id FROM messages m JOIN chats c ON c.id = m.conversation_id WHERE {sql_digit('c.document_id')} >= 5
UNION ALL SELECT 'reading_citations', s.message_id || '@' || s.block_id FROM stored_citations s LEFT JOIN messages m ON m.id = s.message_id LEFT JOIN chats c ON c.id = m.conversation_id
  WHERE c.id IS NULL OR {sql_digit('c.document_id')} >= 5"""))


# ---- streams ---------------------------------------------------------------------------
def _stream(c: Corpus) -> StreamCorpus:
    return StreamCorpus(c.spark, c.sf_dir)


register("X1_stream_commands", lambda c: sinks.drain(X.stream_commands(_stream(c).by_turns(c.commands, "session_id", "seq"))),
         "SELECT session_id, seq, command_id, status, revision FROM (" + ORACLES["K1_replay_with_expiry"] + ") q")
register("X2_stream_leases", lambda c: sinks.drain(X.stream_leases(_stream(c).touches)).select(
    "client_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("expires_at").alias("expires_us"), "touches"),
    """SELECT * FROM (SELECT client_id, epoch_us(min(CASE WHEN NOT heartbeat THEN ts END)) AS started_us, epoch_us(max(ts)) + 120000000 AS expires_us, count(*) AS touches FROM (
  SELECT *, sum(CASE WHEN gap > 120000000 THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM (
    SELECT event_id, ts, 'c-' || user_id AS client_id, event_type IN ('view', 'click') AS heartbeat,
      epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY client_id, no HAVING min(CASE WHEN NOT heartbeat THEN ts END) IS NOT NULL)
WHERE expires_us <= 1000 * ((SELECT epoch_us(max(ts)) FROM events) // 1000 - 600000)""")


def _answer_fragments(c: Corpus):
    pieces = F.concat(F.regexp_extract_all("text", F.lit("(?s)(.{1,9})"), 1), F.array(F.lit("")))
    parts = c.answers.select("request_id", "sequence", (F.size(pieces) - 1).alias("n"), F.posexplode(pieces).alias("i", "fragment"))
    i = F.col("i")
    # every fifth fragment comes a turn late
    turn = F.least(F.floor(i * 3 / (F.col("n") + 1)) + (i % 5 == 3).cast("int"), F.lit(2))
    rows = parts.select(
        "request_id", i.cast("long").alias("seq"), "fragment", (i == F.col("n")).alias("done"),
        F.array(F.concat(F.lit("ctx-"), F.col("sequence").cast("string"))).alias("allowed"), turn.alias("turn"))
    return in_turns(rows, "request_id", F.col("turn"))


def _answer_events(c: Corpus):
    """Citations and warnings as they came, and the text put together from its checkpoints."""
    events = sinks.drain(X.stream_responses(_answer_fragments(c)), timers=True)
    parts = events.filter("event IN ('checkpoint', 'final')").groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "event_no", "event", "value"))).alias("p"))
    # each part begins where the ones before end, and the last one is final
    text = F.array_join(F.transform("p", lambda x: x["value"]), "")
    gaps = F.aggregate("p", F.struct(F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok")), lambda acc, x: F.struct(
        (acc["at"] + F.length(x["value"])).alias("at"), (acc["ok"] & (x["start"] == acc["at"])).alias("ok")))
    whole = parts.filter(gaps["ok"] & (F.element_at("p", -1)["event"] == "final") & (F.size("p") > 1)).select(
        "request_id", F.lit("text").alias("event"), text.alias("value"))
    return events.filter("event NOT IN ('checkpoint', 'final')").select("request_id", "event", "value").unionByName(whole)


register("X3_stream_responses", _answer_events,
         compose("""SELECT request_id, 'text' AS event, original AS value FROM answers UNION ALL SELECT request_id, 'citation', 'ctx-' || sequence FROM answers
UNION ALL SELECT request_id, 'warning', 'citation_duplicate' FROM answers WHERE k % 3 = 0 UNION ALL SELECT request_id, 'warning', 'citation_out_of_context' FROM answers WHERE k % 4 = 1
UNION ALL SELECT request_id, 'warning', 'citation_marker_invalid' FROM answers WHERE k IN (2, 3, 4)"""))


def _record_stream(c: Corpus):
    """The answers' events over three micro-batches, and for each one a second answer without a record."""
    events = materialize(_events(c), "events")
    last = events.groupBy("request_id").agg(F.max("seq").alias("last"))
    none = events.join(last, "request_id").filter(F.col("seq") >= F.col("last") - 1).select(
        F.concat(F.lit("none-"), "request_id").alias("request_id"), (F.col("seq") - F.col("last") + 2).alias("seq"), "data", F.lit(3).alias("last"))
    words = last.select(F.concat(F.lit("none-"), "request_id").alias("request_id"), F.lit(0).cast("long").alias("seq"),
                        F.lit('{"choices":[{"delta":{"content":"I am {sorry}"}}]}').alias("data"), F.lit(3).alias("last"))
    rows = events.join(last, "request_id").unionByName(none).unionByName(words).withColumn(
        "turn", F.floor(F.col("seq") * 3 / (F.col("last") + 1)))
    return T.parse_fragments(in_turns(rows, "request_id", F.col("turn")))


register("X4_stream_translation_records", lambda c: sinks.drain(X.stream_translation_records(_record_stream(c)), timers=True, idle=1),
         "SELECT request_id, ord, block_id, target, NULL AS error_code FROM (" + ORACLES["T10_parse_outputs"] + ") q UNION ALL SELECT 'none-' || request_id, -1, NULL, NULL, 'invalid_json' FROM ("
         + compose("SELECT request_id FROM bodies") + ") b")
register("X5_stream_job_events", lambda c: sinks.drain(X.stream_job_events(_stream(c).by_turns(c.job_history.select(F.col("id").alias("job_id"), "seq", "state"), "job_id", "seq")), timers=True, idle=1),
         ORACLES["J2_state_change_events"])
register("X6_stream_upsert_library", lambda c: sinks.stream_upsert_library(_stream(c).imports, c.library.limit(0)).select("id", "sha256", "title", "created_at", "updated_at"),
         compose("""SELECT arg_min(id, imported_at) AS id, sha256, arg_max(title, imported_at) AS title, min(imported_at) AS created_at, max(imported_at) AS updated_at FROM imports GROUP BY sha256"""))
register("X6_stream_upsert_positions", lambda c: sinks.stream_upsert_positions(_stream(c).position_updates, c.position_updates.limit(0), c.library).select("document_id", "page", "scale_value", "updated_at"),
         compose(f"""SELECT document_id, page, scale_value, updated_at FROM (SELECT u.document_id, u.page, u.scale_value, u.updated_at, row_number() OVER (PARTITION BY document_id ORDER BY u.updated_at DESC) AS rn
FROM position_updates u JOIN library d ON d.id = u.document_id WHERE {VALID_POSITION}) WHERE rn = 1"""))
