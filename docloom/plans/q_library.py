"""Registered queries of the library operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import library as L
from docloom.plans.bridge import Corpus, digit
from docloom.plans.oracle_base import WS_RE2, clean, compose, digit as sql_digit, lower
from docloom.plans.registry import register


def _moves(c: Corpus):
    k = digit("id")
    return c.library.filter(k < 8).select(
        "id", F.concat(F.lit("/new"), "file_path").alias("new_path"),
        F.when(k % 2 == 0, F.col("sha256")).otherwise(F.sha2("sha256", 256)).alias("sha256"),
    )


def _existing(c: Corpus):
    return c.library.filter(digit("sha256") < 6)


def _incoming(c: Corpus):
    return c.imports.select(
        *[F.when(F.lit(True), F.col(x)).alias(x) for x in c.imports.columns if x != "imported_at"],
        (F.col("imported_at") + 500_000).alias("imported_at"),
    )


INCOMING = "(SELECT * REPLACE (imported_at + 500000 AS imported_at) FROM imports)"
EXISTING = f"(SELECT * FROM library WHERE {sql_digit('sha256')} < 6)"

register(
    "L1_upsert_documents",
    lambda c: L.upsert_documents(_existing(c), _incoming(c)).drop("authors"),
    compose(f"""
WITH u AS (
  SELECT sha256, id, title, page_count, file_path, file_size_bytes, file_mtime_ms, file_state, last_opened_at,
    created_at, 0 AS g, updated_at AS ts FROM {EXISTING}
  UNION ALL SELECT sha256, id, title, page_count, file_path, file_size_bytes, file_mtime_ms, 'available',
    imported_at, imported_at, 1, imported_at FROM {INCOMING}),
r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY g, ts, id) AS a,
  row_number() OVER (PARTITION BY sha256 ORDER BY g DESC, ts DESC, id DESC) AS z FROM u)
SELECT f.id, f.sha256, l.title, l.page_count, l.file_path, l.file_size_bytes, l.file_mtime_ms, l.file_state,
  l.last_opened_at, f.created_at, l.ts AS updated_at
FROM r f JOIN r l ON f.sha256 = l.sha256 AND f.a = 1 AND l.z = 1"""),
)
register(
    "L1_import_outcomes",
    lambda c: L.import_outcomes(_existing(c).dropDuplicates(["sha256"]), _incoming(c)).drop("document_id"),
    compose(f"""
SELECT id AS import_id, sha256,
  row_number() OVER (PARTITION BY sha256 ORDER BY imported_at, id) > 1
    OR sha256 IN (SELECT sha256 FROM {EXISTING}) AS duplicate
FROM {INCOMING}"""),
)
register(
    "L2_query_library",
    lambda c: L.query_library(
        L.upsert_documents(c.library.limit(0), c.imports), text=" THE ", sort="title", cursor="5"
    ).select("position", "id", "title", "next_cursor"),
    compose(f"""
WITH d AS (SELECT sha256, arg_min(id, imported_at) AS id, arg_max(title, imported_at) AS title,
    arg_max(authors, imported_at) AS authors, max(imported_at) AS opened FROM imports GROUP BY sha256),
m AS (SELECT * FROM d WHERE {lower('title')} LIKE '%the%' OR {lower('authors::VARCHAR')} LIKE '%the%'),
r AS (SELECT *, row_number() OVER (ORDER BY {lower('title')}, opened DESC NULLS LAST, id) - 1 AS rn, count(*) OVER () AS n FROM m)
SELECT (rn - 5)::INT AS position, id, title, CASE WHEN n > 35 THEN '35' END AS next_cursor
FROM r WHERE rn BETWEEN 5 AND 34"""),
)
register(
    "L2_recent_page",
    lambda c: L.query_library(c.library, limit=100).select("position", "id", "next_cursor"),
    compose(f"""
SELECT (rn - 1)::INT AS position, id, CASE WHEN n > 100 THEN '100' END AS next_cursor
FROM (SELECT id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY last_opened_at DESC NULLS LAST, {lower('title')}, id) AS rn FROM library) WHERE rn <= 100"""),
)
register(
    "L3_summarize_documents",
    lambda c: L.summarize_documents(c.library).withColumn("authors", F.to_json("authors")),
    compose("""SELECT id, title, to_json(authors)::VARCHAR AS authors, page_count, split_part(file_path, '/', -1) AS file_name,
  file_size_bytes, file_state, last_opened_at FROM library"""),
)
register(
    "L4_refresh_sources",
    lambda c: L.refresh_sources(c.library, c.inventory),
    compose("""
SELECT * FROM (SELECT l.id, l.file_state AS old_state,
  CASE WHEN i.path IS NULL THEN 'missing' WHEN NOT i.readable THEN 'unreadable'
    WHEN i.length = l.file_size_bytes AND i.mtime_ms = l.file_mtime_ms AND l.file_state = 'available' THEN 'available'
    WHEN i.sha256 = l.sha256 AND i.has_header THEN 'available' ELSE 'changed' END AS file_state,
  CASE WHEN i.readable THEN i.length ELSE l.file_size_bytes END AS file_size_bytes,
  CASE WHEN i.readable THEN i.mtime_ms ELSE l.file_mtime_ms END AS file_mtime_ms
FROM library l LEFT JOIN inventory i ON i.path = l.file_path) q
WHERE (id, file_state, file_size_bytes, file_mtime_ms) NOT IN (SELECT id, file_state, file_size_bytes, file_mtime_ms FROM library)"""),
)
register(
    "L4_sources_to_hash",
    lambda c: L.sources_to_hash(c.library, c.inventory).select("path", "length", "mtime_ms"),
    compose("""SELECT i.path, i.length, i.mtime_ms FROM inventory i JOIN library l ON l.file_path = i.path
WHERE NOT (l.file_state = 'available' AND l.file_size_bytes = i.length AND l.file_mtime_ms = i.mtime_ms)"""),
)
MOVES = f"""(SELECT id, '/new' || file_path AS new_path, CASE WHEN k % 2 = 0 THEN sha256 ELSE sha256(sha256) END AS sha256
  FROM (SELECT *, {sql_digit('id')} AS k FROM library) WHERE k < 8)"""
register(
    "L5_relocate",
    lambda c: L.relocate(c.library, _moves(c)),
    compose(f"""SELECT l.id, CASE WHEN m.sha256 = l.sha256 THEN m.new_path ELSE l.file_path END AS file_path,
  CASE WHEN m.sha256 = l.sha256 THEN 'available' ELSE l.file_state END AS file_state,
  CASE WHEN m.sha256 <> l.sha256 THEN 'document_changed' END AS error_code
FROM library l JOIN {MOVES} m ON m.id = l.id"""),
)
register(
    "L7_orphan_files",
    lambda c: L.orphan_files(c.inventory, c.library.filter(digit("sha256") < 12)),
    compose(f"""SELECT path, length FROM inventory
WHERE path NOT IN (SELECT file_path FROM library WHERE {sql_digit('sha256')} < 12)"""),
)
register(
    "L8_reconcile_quarantine",
    lambda c: L.reconcile_quarantine(
        c.imports.select(F.concat(F.lit("trash/"), "id").alias("entry"), F.col("id").alias("document_id")),
        c.library.filter(digit("id") < 9),
    ),
    compose(f"""SELECT 'trash/' || id AS entry, id AS document_id,
  CASE WHEN {sql_digit('id')} < 9 THEN 'restore' ELSE 'purge' END AS outcome FROM imports"""),
)
register(
    "L9_dedupe_selection",
    lambda c: L.dedupe_selection(c.table("documents").select(
        F.col("doc_id").alias("ord"), F.col("source").alias("name"),
        F.floor(F.col("n_chars") / 500).alias("size"), (F.col("doc_id") % 3).alias("last_modified"))),
    """SELECT min(doc_id) AS ord, source AS name, n_chars // 500 AS size, doc_id % 3 AS last_modified
FROM documents GROUP BY source, n_chars // 500, doc_id % 3""",
)
register(
    "L10_import_summary",
    lambda c: L.import_summary(
        L.validate_imports(c.inventory.withColumn("page_count", F.col("page_count") - 1))
        .withColumnRenamed("error_code", "error").join(
            L.import_outcomes(c.library.limit(0), c.imports).join(
                c.imports.select(F.col("id").alias("import_id"), "file_path", F.col("imported_at").alias("ord")),
                "import_id").withColumnRenamed("file_path", "path"), "path")
        .select((F.col("ord") % 20).alias("batch_id"), "ord", "duplicate", "error")),
    compose("""
WITH v AS (SELECT path, CASE WHEN length > 209715200 THEN 'pdf_too_large' WHEN NOT has_header THEN 'invalid_pdf'
    WHEN page_count - 1 = 0 THEN 'invalid_pdf' WHEN page_count - 1 > 500 THEN 'pdf_too_many_pages'
    WHEN length <> final_length OR mtime_ms <> final_mtime_ms THEN 'source_unreadable' END AS error FROM inventory),
o AS (SELECT file_path, imported_at AS ord, row_number() OVER (PARTITION BY sha256 ORDER BY imported_at, id) > 1 AS duplicate FROM imports),
b AS (SELECT ord % 20 AS batch_id, ord, duplicate, error FROM v JOIN o ON o.file_path = v.path)
SELECT batch_id, count(*) FILTER (error IS NULL AND NOT duplicate) AS imported,
  count(*) FILTER (error IS NULL AND duplicate) AS duplicates, count(error) AS failures,
  arg_min(error, CASE WHEN error IS NOT NULL THEN ord END) AS first_failure,
  CASE WHEN count(error) = 0 THEN 'success' WHEN count(*) > count(error) THEN 'warning' ELSE 'error' END AS kind
FROM b GROUP BY batch_id"""),
)
register(
    "L11_validate_imports",
    lambda c: L.validate_imports(c.inventory, max_bytes=6000, max_pages=2),
    compose("""SELECT path, CASE WHEN length > 6000 THEN 'pdf_too_large' WHEN NOT has_header THEN 'invalid_pdf'
  WHEN page_count > 2 THEN 'pdf_too_many_pages'
  WHEN length <> final_length OR mtime_ms <> final_mtime_ms THEN 'source_unreadable' END AS error_code FROM inventory"""),
)
NAME = "'/in/' || replace(text, '/', ' ') || '.PDF'"
register(
    "L12_clean_names",
    lambda c: L.clean_names(c.table("documents").select(
        "doc_id", F.concat(F.lit("/in/"), F.replace(F.col("text"), F.lit("/"), F.lit(" ")), F.lit(".PDF")).alias("file_path"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).when(F.col("doc_id") % 3 == 1, F.col("text")).alias("metadata_title"),
    )).select("doc_id", "clean_title", "safe_name"),
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 1 AND {clean('text')} <> '' THEN left({clean('text')}, 1000)
    WHEN {clean("replace(text,'/',' ')")} <> '' THEN left({clean("replace(text,'/',' ')")}, 1000) ELSE 'Untitled paper' END AS clean_title,
  coalesce(nullif(regexp_replace(regexp_replace(left(replace(text,'/',' '), 120), '[^\\p{{L}}\\p{{N}} ._\\-()\\[\\]]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'paper') || '.pdf' AS safe_name
FROM documents""",
)
register(
    "L13_touch_opened",
    lambda c: L.touch_opened(c.library, c.opens).select("id", "last_opened_at", "updated_at"),
    compose("""SELECT l.id, coalesce(o.t, last_opened_at) AS last_opened_at, coalesce(o.t, updated_at) AS updated_at
FROM library l LEFT JOIN (SELECT document_id, max(opened_at) AS t FROM opens GROUP BY 1) o ON o.document_id = l.id"""),
)
VALID_POSITION = """page >= 1 AND page <= page_count AND page_offset_ratio BETWEEN 0 AND 1
  AND (scale_value IN ('auto','page-actual','page-fit','page-width') OR try_cast(scale_value AS DOUBLE) BETWEEN 0.25 AND 5.0)"""


def _positions(c: Corpus):
    empty = c.position_updates.limit(0)
    return L.upsert_positions(empty, c.position_updates, c.library)


register(
    "L14_upsert_positions",
    lambda c: L.load_positions(c.library, _positions(c)),
    compose(f"""
SELECT l.id AS document_id, coalesce(p.page, 1) AS page, coalesce(p.page_offset_ratio, 0.0) AS page_offset_ratio,
  coalesce(p.scale_value, 'page-width') AS scale_value
FROM library l LEFT JOIN (
  SELECT u.*, row_number() OVER (PARTITION BY document_id ORDER BY u.updated_at DESC) AS rn
  FROM position_updates u JOIN library d ON d.id = u.document_id WHERE {VALID_POSITION}) p ON p.document_id = l.id AND p.rn = 1"""),
)
