"""The derived tables of ``bridge`` once more, as SQL for another engine."""

from __future__ import annotations

import re

WS_RE2 = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS_RE2 = WS_RE2.replace("[", "[^", 1)
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(expr: str) -> str:
    return f"translate({expr}, '{UP}', '{LOW}')"


def clean(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS_RE2}+', ' ', 'g'))"


def nbytes(expr: str) -> str:
    return f"octet_length(encode({expr}))"


def digit(expr: str) -> str:
    return f"(strpos('0123456789abcdef', substr(sha256({expr}), 1, 1)) - 1)"


def stable_id(ns: str, *parts: str) -> str:
    body = " || ".join([f"'{ns}'::BLOB", *[f"'\\x00'::BLOB || encode({p}::VARCHAR)" for p in parts]])
    return f"('{ns}-' || sha256({body}))"


CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def compose(body: str) -> str:
    """Put every derived table the query reads, and those they read, in front of it."""
    order: list[str] = []
    entered: set[str] = set()

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_][a-z0-9_]*)\b", sql)):
            if word in CTES and word not in entered:
                entered.add(word)
                visit(CTES[word])
                order.append(word)

    visit(body)
    body = body.strip()
    own = ""
    if body.startswith("WITH "):
        own, body = body[5:], ""
    heads = [f"{n} AS ({CTES[n]})" for n in order]
    if own:
        heads.append(own)
    if not heads:
        return body
    return "WITH RECURSIVE " + ",\n".join(heads) + "\n" + body


cte("imports", """
SELECT 'doc-' || doc_id AS id, sha256(text) AS sha256,
  split_part(text, chr(10), 1) AS title, [source] AS authors,
  (1 + n_chars // 2000)::INT AS page_count, '/library/' || lang || '/' || doc_id || '.pdf' AS file_path,
  n_chars AS file_size_bytes, doc_id * 1000 AS file_mtime_ms,
  CASE WHEN doc_id % 9 = 0 THEN 'changed' ELSE 'available' END AS file_state,
  CASE WHEN doc_id % 4 = 0 THEN doc_id * 7 % 1000 END AS last_opened_at, doc_id AS imported_at
FROM documents""")
cte("library", "SELECT * EXCLUDE (imported_at), imported_at AS created_at, imported_at AS updated_at FROM imports")
cte("inventory", f"""
SELECT file_path AS path, file_size_bytes + CASE WHEN k = 1 THEN 5 ELSE 0 END AS length,
  file_mtime_ms + CASE WHEN k = 2 THEN 1 ELSE 0 END AS mtime_ms,
  CASE WHEN k IN (1, 3) THEN sha256(sha256) ELSE sha256 END AS sha256,
  k <> 4 AS has_header, k <> 5 AS readable, page_count,
  file_size_bytes + CASE WHEN k IN (1, 6) THEN 5 ELSE 0 END AS final_length,
  file_mtime_ms + CASE WHEN k = 2 THEN 1 ELSE 0 END AS final_mtime_ms
FROM (SELECT *, {digit('id')} AS k FROM imports) WHERE k <> 0""")
cte("opens", "SELECT 'doc-' || user_id AS document_id, event_id + 1000000 AS opened_at FROM events WHERE event_type = 'view'")
cte("position_updates", """
SELECT 'doc-' || user_id AS document_id, (event_id % 4)::INT AS page, (event_id % 23) / 20.0::DOUBLE AS page_offset_ratio,
  CASE event_id % 11 WHEN 0 THEN 'page-fit' WHEN 1 THEN 'wide' WHEN 2 THEN '7.5' WHEN 3 THEN '1.25' ELSE 'auto' END AS scale_value,
  event_id AS updated_at FROM events WHERE event_type IN ('click', 'error')""")

# ---- parser output ----------------------------------------------------------------------
cte("doc_keys", f"""
SELECT doc_id, sha256(text) AS sha, sha256('asset-' || doc_id) AS key, {digit("doc_id::VARCHAR")} AS k,
  text, n_chars, len(string_split(text, chr(10))) AS n_lines FROM documents""")
cte("text_lines", """
SELECT doc_id, sha, key, k, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS pos,
  unnest(string_split(text, chr(10))) AS line FROM doc_keys""")
cte("typed_lines", f"""
SELECT *, CASE WHEN pos = 0 THEN 'text' WHEN pos % 11 = 5 THEN 'footer' WHEN pos % 7 = 6 THEN 'ref_text'
    WHEN pos % 13 = 7 THEN 'equation' WHEN pos % 17 = 9 THEN 'image' WHEN pos % 19 = 11 THEN 'table'
    WHEN pos % 23 = 13 THEN 'page_footnote' WHEN pos % 29 = 17 THEN 'chart' ELSE 'text' END AS type FROM text_lines""")
cte("levels", f"SELECT *, CASE WHEN pos = 0 THEN 1 WHEN type = 'text' AND {nbytes('line')} <= 60 THEN 2 END AS text_level FROM typed_lines")
cte("raw", r"""
SELECT doc_id, k, pos, type, text_level, line,
  CASE WHEN type = 'equation' THEN '$$' || line || '$$'
    WHEN text_level = 2 THEN CASE pos % 5 WHEN 0 THEN '3.' || (pos % 9) || ' ' || line WHEN 1 THEN 'A.1 ' || line
      WHEN 2 THEN regexp_replace(line, '[.]+$', '') WHEN 3 THEN 'References' ELSE line END
    WHEN type = 'text' AND pos > 0 THEN CASE pos % 10 WHEN 3 THEN '- ' || line WHEN 4 THEN '1) ' || line
      WHEN 5 THEN line || ' [' || pos || '] $x_{' || pos || '}$ end' WHEN 7 THEN line || ' [1, 2]' ELSE line END
    ELSE line END AS text,
  (pos % 5 * 100)::DOUBLE AS x0, (pos % 8 * 100)::DOUBLE AS y0,
  CASE WHEN k = 14 AND pos = 2 THEN (pos % 5 * 100)::DOUBLE - 1 ELSE (pos % 5 * 100)::DOUBLE + 300 END AS x1,
  (pos % 8 * 100)::DOUBLE + 50 AS y1,
  CASE WHEN k = 15 AND pos = 3 THEN 9999 ELSE pos // 10 END AS page_idx,
  CASE WHEN type IN ('image', 'chart', 'table') AND pos % 3 <> 0 THEN CASE WHEN k = 13 THEN 'images/none.jpg'
    ELSE 'images/' || CASE WHEN pos % 2 = 0 THEN sha ELSE key END || '.jpg' END END AS img_path,
  CASE WHEN type IN ('image', 'chart', 'table') AND pos % 2 = 1 THEN line END AS cap_line,
  CASE WHEN type IN ('image', 'chart', 'table') AND pos % 3 = 1 THEN line END AS foot_line, sha
FROM levels""")
cte("page_rows", """
SELECT doc_id, unnest(range(0, (n_lines - 1) // 10 + 1))::INT + 1 AS page FROM doc_keys""")
cte("pages_sized", """
SELECT doc_id, page, CASE WHEN page % 2 = 1 THEN 612.0::DOUBLE ELSE 720.0 END AS width,
  CASE WHEN page % 2 = 1 THEN 792.0::DOUBLE ELSE 1000.0 END AS height FROM page_rows""")
cte("violations", """
SELECT r.doc_id, r.pos::BIGINT AS pos, CASE WHEN p.page IS NULL THEN 'page_out_of_range' ELSE 'invalid_bbox' END AS code
FROM raw r LEFT JOIN pages_sized p ON p.doc_id = r.doc_id AND p.page = r.page_idx + 1 WHERE p.page IS NULL OR r.x1 < r.x0
UNION ALL SELECT doc_id, pos, 'missing_asset' FROM raw WHERE img_path = 'images/none.jpg'
UNION ALL SELECT doc_id, 0, 'asset_metadata_conflict' FROM doc_keys WHERE k = 12""")
CLEAN = clean("text")
cte("classified", f"""
SELECT *, CASE WHEN type = 'equation' THEN trim(regexp_replace(trim(regexp_replace(text, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')), '^\\$\\$((?s:.)*)\\$\\$$', '\\1'))
  WHEN type IN ('text', 'ref_text', 'page_footnote') THEN {CLEAN} END AS clean FROM raw
WHERE type <> 'footer'""")
cte("depths", r"""
SELECT *, CASE WHEN type = 'text' AND text_level IS NOT NULL AND clean <> '' THEN
  CASE WHEN regexp_extract(clean, '^([0-9]+(\.[0-9]+)*)\.*\s', 1) <> '' THEN len(string_split(regexp_extract(clean, '^([0-9]+(\.[0-9]+)*)\.*\s', 1), '.'))
    WHEN regexp_matches(clean, '^[A-Z] +\S') THEN 1
    WHEN regexp_extract(clean, '^[A-Z]\.([0-9]+(\.[0-9]+)*)\s', 1) <> '' THEN len(string_split(regexp_extract(clean, '^[A-Z]\.([0-9]+(\.[0-9]+)*)\s', 1), '.')) + 1
    WHEN octet_length(encode(clean)) <= 160 AND NOT regexp_matches(clean, '[.!?;,]$') AND NOT starts_with(lower(clean), 'example ') THEN 1 END END AS depth,
  lower(regexp_replace(clean, '^[^\pL\pN]+|[^\pL\pN]+$', '', 'g')) AS word
FROM classified""")
cte("title_rows", "SELECT doc_id, arg_min(clean, pos) AS title, min(pos) AS pos FROM classified WHERE type = 'text' AND text_level = 1 AND clean <> '' GROUP BY doc_id")
cte("headed", """
SELECT d.*, d.depth IS NOT NULL AS is_heading,
  CASE WHEN word IN ('references', 'bibliography', 'reference') THEN 'references'
    WHEN regexp_matches(clean, '^[0-9]+(\\.[0-9]+)*\\.*\\s') THEN 'body'
    WHEN word IN ('abstract', 'summary', 'acknowledgements', 'acknowledgments') THEN 'front_matter' ELSE 'body' END AS word_role
FROM depths d LEFT JOIN title_rows t ON t.doc_id = d.doc_id AND t.pos = d.pos WHERE t.pos IS NULL""")
cte("heading_runs", """
SELECT *, count(*) FILTER (is_heading) OVER w AS hseg,
  last_value(CASE WHEN is_heading THEN word_role END IGNORE NULLS) OVER w AS last_role,
  FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
cte("starts_marked", """
SELECT *, is_heading OR (type = 'ref_text' AND coalesce(last_role, '') <> 'references'
  AND count(*) FILTER (type = 'ref_text') OVER (PARTITION BY doc_id, hseg ORDER BY pos ROWS UNBOUNDED PRECEDING) = 1) AS is_start
FROM heading_runs""")
cte("segmented", """
SELECT *, count(*) FILTER (is_start) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM starts_marked""")
CELL = "regexp_replace(line, '[^A-Za-z ]', '', 'g')"
cte("block_parts", f"""
SELECT doc_id, pos, page_idx + 1 AS page, segment, 0 AS sub, sha, img_path,
  CASE WHEN type = 'text' AND text_level IS NOT NULL THEN 'heading' WHEN type = 'text' AND regexp_matches(clean, '^(- |• |\\* |[0-9]+[.)])') THEN 'list'
    WHEN type IN ('text', 'ref_text') THEN 'paragraph' WHEN type = 'equation' THEN 'equation' ELSE 'caption' END AS kind, clean AS text, NULL::VARCHAR AS alt, NULL::VARCHAR AS cell
FROM segmented WHERE clean <> ''
UNION ALL
SELECT doc_id, pos, page_idx + 1, segment, 0, sha, img_path, 'figure', coalesce('Figure' || nullif(chr(10) || {clean('cap_line')}, chr(10)), CASE WHEN cap_line IS NOT NULL THEN 'Figure' ELSE '' END), NULL, NULL
FROM segmented WHERE type IN ('image', 'chart') AND img_path IS NOT NULL
UNION ALL
SELECT doc_id, pos, page_idx + 1, segment, 1, sha, NULL, 'caption', trim('Figure ' || {clean('cap_line')}), NULL, NULL
FROM segmented WHERE type IN ('image', 'chart', 'table') AND cap_line IS NOT NULL
UNION ALL
SELECT doc_id, pos, page_idx + 1, segment, 2, sha, NULL, 'caption', {clean('foot_line')}, NULL, NULL
FROM segmented WHERE type IN ('image', 'chart') AND img_path IS NOT NULL AND {clean('foot_line')} <> ''
UNION ALL
SELECT doc_id, pos, page_idx + 1, segment, 0, sha, img_path, 'table',
  CASE WHEN cap_line IS NULL THEN '' ELSE 'Figure' || coalesce(nullif(chr(10) || {clean('cap_line')}, chr(10)), '') || chr(10) END || 'a' || chr(9) || {clean(CELL)} || chr(10) || pos || ' [1]'
  || coalesce(nullif(chr(10) || {clean('foot_line')}, chr(10)), ''),
  CASE WHEN cap_line IS NOT NULL THEN 'Figure' END, {clean(CELL)}
FROM segmented WHERE type = 'table'""")
cte("drafts", """
SELECT coalesce(s.doc_id, b.doc_id) AS doc_id, coalesce(s.segment, b.segment) AS segment,
  coalesce(s.page, b.first_page) AS page_start, greatest(coalesce(s.page, b.first_page), b.last_page) AS page_end,
  coalesce(s.title, 'Front Matter') AS source_title, coalesce(s.depth, 1)::INT AS depth, coalesce(s.role, 'front_matter') AS role,
  coalesce(b.n, 0) AS block_count
FROM (SELECT doc_id, segment, page_idx + 1 AS page, CASE WHEN is_heading THEN clean ELSE 'References' END AS title,
    CASE WHEN is_heading THEN depth ELSE 1 END AS depth, CASE WHEN is_heading THEN word_role ELSE 'references' END AS role
  FROM segmented WHERE is_start) s
FULL JOIN (SELECT doc_id, segment, count(*) AS n, max(page) AS last_page, arg_min(page, pos * 4 + sub) AS first_page
  FROM block_parts GROUP BY 1, 2) b ON b.doc_id = s.doc_id AND b.segment = s.segment""")
cte("rejected", """
SELECT doc_id, min(struct_pack(pos := pos, code := code)) AS v FROM violations GROUP BY 1""")
cte("chapters_all", f"""
SELECT *, {stable_id('chapter', "'art-' || doc_id", 'chapter_index', 'sha256(source_title)')} AS chapter_id FROM (
SELECT d.*, (row_number() OVER (PARTITION BY doc_id, block_count > 0 ORDER BY segment) - 1)::INT AS order_index FROM (
  SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY segment) - 1)::INT AS chapter_index FROM drafts) d)
WHERE block_count > 0 AND doc_id NOT IN (SELECT doc_id FROM rejected)""")
cte("tokens", r"""
SELECT doc_id, pos, sub, ord, tok, kind_special FROM (
  SELECT doc_id, pos, sub, generate_subscripts(toks, 1) AS ord, unnest(toks) AS tok,
    regexp_full_match(unnest(toks), '\$[^$]+\$|\[[0-9 ,;–-]+\]') AS kind_special
  FROM (SELECT *, regexp_extract_all(text, '\$\$|\$[^$]+\$|\[[0-9 ,;–-]+\]|[^$\[]+|[$\[]') AS toks FROM block_parts
    WHERE kind NOT IN ('equation', 'figure', 'table')))""")
cte("atom_keys", """
SELECT *, 2 * count(*) FILTER (kind_special) OVER (PARTITION BY doc_id, pos, sub ORDER BY ord ROWS UNBOUNDED PRECEDING) - kind_special::INT AS akey FROM tokens""")
cte("inline_pieces", """
SELECT doc_id, pos, sub, akey, string_agg(tok, '' ORDER BY ord) AS value, bool_or(kind_special) AS special FROM atom_keys GROUP BY 1, 2, 3, 4""")
cte("inline_json", """
SELECT *, CASE WHEN special AND value LIKE '$%' THEN
    '{"type":"formula","id":"formula-' || left(sha256(value[2:-2]), 16) || '","latex":' || to_json(value[2:-2])::VARCHAR || ',"display":false}'
  WHEN special THEN '{"type":"citation","id":"citation-' || left(sha256(value), 16) || '","label":' || to_json(value)::VARCHAR || '}'
  ELSE '{"type":"text","value":' || to_json(value)::VARCHAR || '}' END AS js FROM inline_pieces""")
cte("inline_arrays", """
SELECT doc_id, pos, sub, '[' || string_agg(js, ',' ORDER BY akey) || ']' AS js FROM inline_json GROUP BY 1, 2, 3""")
cte("contents", """
SELECT b.*, '{"plainText":' || to_json(b.text)::VARCHAR || ',"atoms":' || CASE
  WHEN b.kind = 'equation' THEN '[{"type":"formula","id":"formula-' || left(sha256(b.text), 16) || '","latex":' || to_json(b.text)::VARCHAR || ',"display":true}]'
  WHEN b.kind = 'figure' THEN '[{"type":"asset","assetId":"' || sha || '"' || CASE WHEN b.text <> '' THEN ',"alt":' || to_json(b.text)::VARCHAR ELSE '' END || '}]'
  WHEN b.kind = 'table' THEN '[{"type":"table","rows":[[{"row":0,"column":0,"rowSpan":1,"columnSpan":1,"content":[{"type":"text","value":"a"}]},{"row":0,"column":1,"rowSpan":1,"columnSpan":2,"content":['
    || CASE WHEN cell <> '' THEN '{"type":"text","value":"' || cell || '"}' ELSE '' END || ']}],[{"row":2,"column":0,"rowSpan":1,"columnSpan":1,"content":[{"type":"text","value":"' || b.pos
    || ' "},{"type":"citation","id":"citation-' || left(sha256('[1]'), 16) || '","label":"[1]"}]}]]}'
    || CASE WHEN img_path IS NOT NULL THEN ',{"type":"asset","assetId":"' || sha || '"' || CASE WHEN alt IS NOT NULL THEN ',"alt":"' || alt || '"' ELSE '' END || '}' ELSE '' END || ']'
  ELSE a.js END || '}' AS content
FROM block_parts b LEFT JOIN inline_arrays a ON a.doc_id = b.doc_id AND a.pos = b.pos AND a.sub = b.sub""")
cte("blocks_all", f"""
SELECT *, {stable_id('block', 'chapter_id', 'order_index', 'kind', 'source_digest')} AS block_id FROM (
SELECT c.doc_id, c.chapter_id, c.role AS chapter_role, c.order_index AS chapter_order, b.pos, b.sub, b.page, b.kind, b.text AS plain_text, b.content,
  sha256(b.content) AS source_digest,
  (row_number() OVER (PARTITION BY b.doc_id, b.segment ORDER BY b.pos, b.sub) - 1)::INT AS order_index
FROM contents b JOIN chapters_all c ON c.doc_id = b.doc_id AND c.segment = b.segment)""")
cte("text_atoms", "SELECT i.*, b.block_id FROM inline_pieces i JOIN blocks_all b ON b.doc_id = i.doc_id AND b.pos = i.pos AND b.sub = i.sub")
cte("translatable", f"""
SELECT *, kind = 'table' OR (kind IN ('heading', 'paragraph', 'list', 'caption') AND EXISTS (
  SELECT 1 FROM text_atoms a WHERE a.block_id = b.block_id AND NOT a.special AND regexp_matches(a.value, '{NOT_WS_RE2}'))) AS translatable
FROM blocks_all b""")

# ---- translation ------------------------------------------------------------------------
from docloom.operators import translate as _t  # noqa: E402
from docloom.plans.bridge import CONFIG  # noqa: E402


def length_prefixed(*parts: str) -> str:
    return "sha256(" + " || ".join(
        f"unhex(lpad(printf('%x', octet_length(encode({p}))), 16, '0')) || encode({p})" for p in parts) + ")"


DIGEST = length_prefixed("source_digest", "'zh-CN'", f"'{CONFIG.endpoint_fingerprint}'", f"'{CONFIG.model_id}'",
                         "'academic-blocks-v1'", "'academic'", "''")
cte("digested", f"SELECT *, {DIGEST} AS request_digest FROM translatable WHERE translatable")
cte("stems", "SELECT *, '⟦WEAVE:' || upper(left(sha256(block_id || request_digest), 8)) || ':' AS stem FROM digested")
cte("woven", """
SELECT s.block_id, string_agg(CASE WHEN NOT special THEN value ELSE stem || CASE WHEN value LIKE '$%' THEN 'F' ELSE 'C' END || ':' || lpad((n)::VARCHAR, 4, '0') || '⟧' END, '' ORDER BY akey) AS source
FROM (SELECT *, count(*) FILTER (special) OVER (PARTITION BY block_id ORDER BY akey ROWS UNBOUNDED PRECEDING) AS n FROM text_atoms) a
JOIN stems s ON s.block_id = a.block_id GROUP BY s.block_id""")
_seq = ["TS", "RS", "CS", "'a'", "CE", "CS", "cell", "CE", "RE", "RS", "CS", "num", "C", "CE", "RE", "TE"]
_parts, _n = [], 0
for _x in _seq:
    if _x == "'a'":
        _parts.append("'a'")
    elif _x == "cell":
        _parts.append("cell")
    elif _x == "num":
        _parts.append("pos || ' '")
    else:
        _n += 1
        _parts.append(f"stem || '{_x}:{_n:04d}⟧'")
TABLE_SOURCE = " || ".join(_parts) + f" || CASE WHEN img_path IS NOT NULL THEN stem || 'A:{_n + 1:04d}⟧' ELSE '' END"
cte("woven_tables", f"""
SELECT s.block_id, {TABLE_SOURCE.replace("pos ||", "s.pos ||")} AS source FROM stems s
JOIN block_parts b ON b.doc_id = s.doc_id AND b.pos = s.pos AND b.sub = s.sub WHERE s.kind = 'table'""")
cte("prepared", """
SELECT s.doc_id, s.chapter_id, s.block_id, s.order_index, s.kind, s.source_digest, s.request_digest, coalesce(w.source, t.source) AS source
FROM stems s LEFT JOIN woven w ON w.block_id = s.block_id LEFT JOIN woven_tables t ON t.block_id = s.block_id""")
ROOM = CONFIG.byte_capacity - len(_t.REQUEST_HEAD) - len(_t.REQUEST_TAIL) + 1
cte("items", """
SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY order_index) AS rn,
  octet_length(encode('{"id":"' || block_id || '","kind":"' || kind || '","source":' || to_json(source)::VARCHAR || '}')) + 1 AS w FROM prepared""")


def packing(name: str, source: str, key: str) -> None:
    cte(name, f"""
SELECT {key}, rn, block_id, CASE WHEN w > {ROOM} THEN 0 ELSE w END AS used, CASE WHEN w > {ROOM} THEN -1 ELSE 0 END AS seen,
  CASE WHEN w <= {ROOM} THEN 0 END AS batch FROM {source} WHERE rn = 1
UNION ALL
SELECT i.{key}, i.rn, i.block_id, CASE WHEN i.w > {ROOM} THEN 0 WHEN p.used > 0 AND p.used + i.w <= {ROOM} THEN p.used + i.w ELSE i.w END,
  CASE WHEN i.w > {ROOM} OR (p.used > 0 AND p.used + i.w <= {ROOM}) THEN p.seen ELSE p.seen + 1 END,
  CASE WHEN i.w > {ROOM} THEN NULL WHEN p.used > 0 AND p.used + i.w <= {ROOM} THEN p.seen ELSE p.seen + 1 END
FROM {name} p JOIN {source} i ON i.{key} = p.{key} AND i.rn = p.rn + 1""")


packing("packed", "items", "chapter_id")
cte("batched", """
SELECT i.*, p.batch::BIGINT AS batch, i.chapter_id || '#' || p.batch AS request_id FROM items i JOIN packed p ON p.block_id = i.block_id""")
cte("plan_digests", """
SELECT chapter_id, sha256(unhex(string_agg('0000000000000040' || hex(encode(request_digest)), '' ORDER BY order_index))) AS plan_digest FROM prepared GROUP BY 1""")
STATE_LIST = "['queued', 'running', 'succeeded', 'failed', 'cancelled', 'interrupted']"
cte("chapter_jobs", f"""
SELECT 'job-' || c.chapter_id AS id, c.chapter_id, doc_id, CASE WHEN k = 15 THEN 'stale' ELSE plan_digest END AS plan_digest,
  CASE WHEN k % 2 = 0 THEN 'translate' ELSE 'prefetch' END AS kind, {STATE_LIST}[k % 6 + 1] AS state,
  CASE WHEN k % 6 = 3 THEN 'The request timed out' END AS safe_message, order_index::BIGINT AS created_at
FROM (SELECT *, {digit('chapter_id')} AS k FROM chapters_all) c LEFT JOIN plan_digests p ON p.chapter_id = c.chapter_id WHERE k > 3""")
cte("translations", f"""
SELECT 'tr-' || block_id AS id, 'job-' || chapter_id AS job_id, block_id, CASE WHEN k = 8 THEN sha256(request_digest) ELSE request_digest END AS request_digest,
  source_digest, CASE WHEN k BETWEEN 3 AND 6 OR k IN (8, 9) THEN 'ready' WHEN k = 7 THEN 'failed' WHEN k = 10 THEN 'queued' ELSE 'translating' END AS state,
  k <> 9 AS is_active, CASE WHEN k BETWEEN 3 AND 6 OR k IN (8, 9) THEN source END AS target_plain_text,
  CASE WHEN k = 7 THEN 'timeout' END AS error_code, CASE WHEN k = 7 THEN 'late' END AS error_message,
  order_index::BIGINT AS created_at, order_index::BIGINT AS updated_at, chapter_id, order_index
FROM (SELECT *, {digit('block_id')} AS k FROM prepared) WHERE k > 2""")
cte("records", f"""
SELECT request_id, (order_index * 10 + CASE WHEN k = 2 THEN 15 ELSE 0 END) * 2 + copy AS ord, block_id,
  CASE WHEN k = 3 THEN ' ' || chr(8195) || ' ' WHEN k = 4 THEN repeat(source, 9) WHEN k = 5 THEN source || ' ⟦WEAVE:X'
    WHEN k = 6 THEN replace(source, '⟧', '>') ELSE '译' || source END AS target
FROM (SELECT *, unnest(CASE WHEN k = 1 THEN [0, 1] ELSE [0] END) AS copy FROM (SELECT *, {digit('block_id')} AS k FROM batched WHERE batch IS NOT NULL) WHERE k > 0)""")
cte("responses", f"SELECT DISTINCT request_id, CASE WHEN {digit('request_id')} < 8 THEN 'stop' ELSE 'length' END AS finish_reason FROM batched WHERE batch IS NOT NULL")
cte("judged", f"""
SELECT b.request_id, b.chapter_id, b.block_id, b.source, b.order_index, r.target, CASE WHEN copies > 1 THEN 'duplicate_block'
    WHEN copies IS NULL THEN CASE WHEN finish_reason = 'stop' THEN 'missing_block' ELSE 'truncated' END
    WHEN moved THEN 'block_order_changed' WHEN NOT regexp_matches(r.target, '{NOT_WS_RE2}') THEN 'empty_target'
    WHEN {nbytes('r.target')} > least(8 * {nbytes('b.source')}, 131072) THEN 'target_too_large'
    WHEN regexp_extract_all(r.target, '⟦WEAVE:[^⟧]*⟧') <> regexp_extract_all(b.source, '⟦WEAVE:[^⟧]*⟧')
      OR contains(regexp_replace(r.target, '⟦WEAVE:[^⟧]*⟧', '|', 'g'), '⟦WEAVE:') THEN 'protected_marker_changed'
    WHEN b.kind = 'table' AND left(b.source, 2) = '⟦W' AND contains(r.target, '⟧译⟦WEAVE') THEN 'protected_marker_changed' END AS code
FROM batched b JOIN responses p ON p.request_id = b.request_id
LEFT JOIN (SELECT request_id, block_id, count(*) AS copies, bool_or(coalesce(hi > place OR lo < place, false)) AS moved, arg_max(target, ord) AS target FROM (
  SELECT r.*, b.order_index AS place,
    max(b.order_index) OVER (PARTITION BY r.request_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi,
    min(b.order_index) OVER (PARTITION BY r.request_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS lo
  FROM records r JOIN batched b ON b.request_id = r.request_id AND b.block_id = r.block_id) GROUP BY 1, 2) r
ON r.request_id = b.request_id AND r.block_id = b.block_id""")

# ---- logs -------------------------------------------------------------------------------
cte("event_keys", "SELECT *, (props::JSON->>'k')::INT AS k FROM events")
cte("job_history", """
SELECT 'job-' || user_id || '-' || (k % 8) AS id, event_id AS seq, 'doc-' || (user_id % 50) AS document_id,
  CASE WHEN k % 8 <> 7 THEN 'ch-' || (user_id % 50) || '-' || (k % 3) END AS chapter_id,
  CASE WHEN k % 8 > 3 THEN 'prefetch' ELSE 'translate' END AS kind, CASE WHEN k % 8 > 3 THEN 10 ELSE 100 END AS priority, state,
  CASE WHEN k % 8 <> 6 THEN 'plan-' || (k % 2) END AS plan_digest, CASE WHEN event_type = 'error' THEN 'timeout' END AS error_code,
  CASE WHEN event_type = 'error' THEN 'late' END AS safe_message, event_id AS created_at, event_id AS updated_at,
  CASE WHEN state <> 'queued' THEN event_id END AS started_at, CASE WHEN state IN ('succeeded', 'failed', 'cancelled') THEN event_id END AS completed_at
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed'
  ELSE CASE WHEN event_id % 5 = 0 THEN 'cancelled' ELSE 'interrupted' END END AS state FROM event_keys)""")
cte("job_ranked", """
SELECT *, min(CASE WHEN state = 'cancelled' THEN seq END) OVER (PARTITION BY id) AS dead, max(seq) OVER (PARTITION BY id) AS last_seq,
  min(seq) OVER (PARTITION BY id) AS first_seq, min(started_at) OVER (PARTITION BY id) AS first_start FROM job_history""")
cte("jobs", """
SELECT l.id, f.document_id, f.chapter_id, l.kind, l.priority, l.state, l.plan_digest, l.error_code, l.safe_message, f.created_at, l.updated_at,
  l.first_start AS started_at, l.completed_at, f.created_at AS rowid
FROM job_ranked l JOIN job_ranked f ON f.id = l.id AND f.seq = f.first_seq WHERE l.seq = coalesce(l.dead, l.last_seq)""")
cte("job_events", """
SELECT id AS job_id, row_number() OVER (PARTITION BY id ORDER BY seq) AS sequence, state, seq AS created_at FROM (
  SELECT *, lag(state) OVER (PARTITION BY id ORDER BY seq) AS prev FROM job_ranked WHERE dead IS NULL OR seq <= dead)
WHERE prev IS DISTINCT FROM state""")
cte("job_translations", f"""
SELECT job_id || '/' || n AS id, job_id, CASE WHEN k < 5 THEN 'queued' WHEN k < 9 THEN 'translating' WHEN k < 13 THEN 'ready' ELSE 'failed' END AS state,
  k % 3 <> 0 AS is_active, created_at AS updated_at
FROM (SELECT *, {digit("job_id || n")} AS k FROM (SELECT id AS job_id, created_at, unnest([0, 1]) AS n FROM jobs))""")
OPS = "['queued', 'uploading', 'processing', 'downloading', 'normalizing', 'succeeded', 'failed', 'cancelled', 'status_unknown']"
cte("operations", f"""
SELECT 'op-' || event_id AS id, 'doc-' || user_id AS document_id, 'job-' || user_id || '-' || (k % 8) AS job_id,
  CASE WHEN event_id % 6 = 0 THEN 'local' ELSE 'cloud_mineru' END AS backend, {OPS}[event_id % 9 + 1] AS state,
  CASE WHEN event_id % 7 = 0 THEN 'old' ELSE 'mineru-v4-vlm' END AS parser_version, CASE WHEN event_id % 5 = 0 THEN 'old' ELSE 'mineru-v2' END AS normalizer_version,
  CASE WHEN event_id % 4 = 0 THEN 'other' ELSE 'endpoint-1' END AS endpoint_fingerprint, CASE WHEN event_id % 3 = 0 THEN 'batch-' || event_id END AS batch_id,
  CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE END AS progress, CASE WHEN event_id % 8 = 0 THEN 'parser_version_changed' END AS error_code,
  event_id AS created_at, event_id AS updated_at, NULL::BIGINT AS completed_at FROM event_keys""")
OPEN_OPS = "('queued', 'uploading', 'processing', 'downloading', 'normalizing', 'status_unknown')"

# ---- conversations ----------------------------------------------------------------------
from docloom.plans.bridge import CONTEXT_BUDGET  # noqa: E402

cte("messages", f"""
SELECT id, conversation_id, role, CASE WHEN role = 'reader' THEN 'ready' WHEN k = 0 THEN 'failed' WHEN k = 1 THEN 'cancelled' WHEN k = 2 THEN 'streaming' ELSE 'ready' END AS state,
  text, sequence, CASE WHEN role = 'assistant' THEN q END AS responding_to, CASE WHEN role = 'reader' AND k < 9 THEN 'sel-' || id END AS selection, k
FROM (SELECT *, {digit('id')} AS k, last_value(CASE WHEN role = 'reader' THEN id END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q
  FROM (SELECT 'm-' || conv_id || '-' || turn AS id, 'c-' || conv_id AS conversation_id, CASE WHEN role = 'user' THEN 'reader' ELSE 'assistant' END AS role, text, turn + 1 AS sequence
    FROM conversations WHERE role IN ('user', 'assistant'))) WHERE role = 'reader' OR q IS NOT NULL""")
cte("chats", "SELECT 'c-' || conv_id AS id, 'doc-' || conv_id AS document_id, max(turn) AS created_at, max(turn) * 7 % 5 AS updated_at FROM conversations GROUP BY conv_id")
cte("turns", f"""
SELECT 't-' || id AS turn_id, conversation_id, CASE WHEN kt < 3 THEN id ELSE 'new-' || id END AS reader_id, 'a-' || id AS assistant_id,
  CASE WHEN kt = 7 THEN ' ' ELSE text END AS text, CASE WHEN kt = 4 THEN 'sel-new' END AS selection, kt IN (0, 1) AS is_retry, sequence AS created_at
FROM (SELECT *, {digit("'turn' || id")} AS kt FROM messages WHERE role = 'reader') WHERE kt < 8""")
cte("selections", f"""
SELECT 's-' || block_id AS selection_id, CASE WHEN k = 1 THEN 'none' ELSE block_id END AS block_id, CASE WHEN k = 2 THEN 'other' WHEN k = 0 THEN ' ' ELSE source_digest END AS source_digest,
  CASE WHEN k = 3 THEN 12 ELSE 2 END AS start_utf16, CASE WHEN k = 4 THEN e + 400 ELSE e END AS end_utf16,
  CASE WHEN k = 5 THEN 'else' ELSE substr(target_plain_text, 3, e - 2) END AS selected_text, 'c-' || (kb * 3 + k) AS conversation_id, source_digest AS real_digest, target_plain_text, k, block_id AS real_block
FROM (SELECT *, {digit("'sel' || block_id")} AS k, {digit("block_id")} AS kb, least(12, length(target_plain_text)) AS e FROM translations WHERE state = 'ready' AND is_active)""")
cte("view_rows", "SELECT t.* FROM translations t JOIN prepared p ON p.block_id = t.block_id AND p.request_digest = t.request_digest WHERE t.is_active")
cte("selections_judged", f"""
SELECT s.*, b.chapter_id, b.order_index, b.page, b.plain_text AS aligned_source,
  CASE WHEN s.k = 0 OR s.start_utf16 >= s.end_utf16 OR NOT regexp_matches(s.selected_text, '{NOT_WS_RE2}') OR length(s.selected_text) > 4096 THEN 'invalid_input'
    WHEN b.block_id IS NULL OR v.block_id IS NULL OR s.k = 2 OR s.end_utf16 > length(v.target_plain_text)
      OR substr(v.target_plain_text, s.start_utf16 + 1, s.end_utf16 - s.start_utf16) <> s.selected_text THEN 'stale_selection' END AS error_code
FROM selections s LEFT JOIN blocks_all b ON b.block_id = s.block_id LEFT JOIN view_rows v ON v.block_id = s.block_id AND v.state = 'ready'""")
cte("context_facts", """
SELECT b.chapter_id, b.order_index, b.block_id, b.page, b.plain_text, v.target_plain_text AS translated FROM blocks_all b LEFT JOIN view_rows v ON v.block_id = b.block_id AND v.state = 'ready'""")
SEL_JSON = """'{"blockId":"' || s.block_id || '","chapterId":"' || s.chapter_id || '","pageStart":' || s.page || ',"pageEnd":' || s.page || ',"sourceDigest":"' || s.source_digest
  || '","startUtf16":' || s.start_utf16 || ',"endUtf16":' || s.end_utf16 || ',"selectedText":' || to_json(s.selected_text)::VARCHAR || ',"alignedSource":' || to_json(s.aligned_source)::VARCHAR || '}'"""
cte("candidates", f"""
SELECT s.selection_id, f.order_index - s.order_index AS off, f.block_id, f.page, f.plain_text, f.translated, {SEL_JSON} AS sel_json, s.selected_text, s.conversation_id, s.chapter_id,
  octet_length(encode('{{"blockId":"' || f.block_id || '","pageStart":' || f.page || ',"pageEnd":' || f.page || ',"sourceText":' || to_json(f.plain_text)::VARCHAR
    || CASE WHEN f.translated IS NOT NULL THEN ',"translatedText":' || to_json(f.translated)::VARCHAR ELSE '' END || ',"selected":' || CASE WHEN f.order_index = s.order_index THEN 'true' ELSE 'false' END || '}}')) AS size
FROM selections_judged s JOIN context_facts f ON f.chapter_id = s.chapter_id AND f.order_index BETWEEN s.order_index - 2 AND s.order_index + 2 WHERE s.error_code IS NULL""")
cte("admission0", """
SELECT selection_id, any_value(sel_json) AS sel_json, octet_length(encode(any_value(sel_json))) + 26 + max(size) FILTER (off = 0) AS base, max(size) FILTER (off = -1) AS b1, max(size) FILTER (off = 1) AS a1,
  max(size) FILTER (off = -2) AS b2, max(size) FILTER (off = 2) AS a2 FROM candidates GROUP BY 1""")
_prev, _used = "admission0", "base"
for _i, _b in enumerate(("b1", "a1", "b2", "a2"), 1):
    cte(f"admission{_i}", f"""SELECT *, {_used} + CASE WHEN {_used} + {_b} + 1 <= {CONTEXT_BUDGET} THEN {_b} + 1 ELSE 0 END AS u{_i}, coalesce({_used} + {_b} + 1 <= {CONTEXT_BUDGET}, false) AS k_{_b} FROM (
  SELECT * REPLACE (coalesce({_b}, 9999999) AS {_b}) FROM {_prev})""")
    _prev, _used = f"admission{_i}", f"u{_i}"
cte("admitted", f"""
SELECT c.*, a.u4 AS used, a.base FROM candidates c JOIN admission4 a ON a.selection_id = c.selection_id
WHERE a.base <= {CONTEXT_BUDGET} AND (off = 0 OR (off = -1 AND k_b1) OR (off = 1 AND k_a1) OR (off = -2 AND k_b2) OR (off = 2 AND k_a2))""")
cte("history", """
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence) AS turn, sequence, responding_to, question, answer FROM (
  SELECT a.conversation_id, a.sequence, a.responding_to, q.text AS question, a.text AS answer, row_number() OVER (PARTITION BY a.conversation_id ORDER BY a.sequence DESC) AS r
  FROM messages a JOIN messages q ON q.conversation_id = a.conversation_id AND q.id = a.responding_to AND q.role = 'reader' WHERE a.role = 'assistant' AND a.state = 'ready') WHERE r <= 4""")
cte("answers", f"""
SELECT id AS request_id, left(text, 40) || mark || substr(text, 41, 40) || CASE WHEN k % 3 = 0 THEN mark ELSE '' END || CASE WHEN k % 4 = 1 THEN '⟦WEAVE-CITE:ctx-x⟧' ELSE '' END || substr(text, 81)
  || CASE WHEN k = 2 THEN '⟦WEAVE-CITE:' || repeat('y', 130) || '⟧' ELSE '' END || CASE WHEN k = 3 THEN '⟦WEAVE-CITE:ct' WHEN k = 4 THEN '⟦WEA' ELSE '' END AS text, text AS original, k, sequence
FROM (SELECT *, '⟦WEAVE-CITE:ctx-' || sequence || '⟧' AS mark FROM messages WHERE role = 'assistant')""")
cte("stored_citations", f"""
SELECT 'm-' || doc_id || '-' || (order_index % 4) AS message_id, k % 2 AS order_index, CASE WHEN k = 2 THEN 'gone-' || block_id ELSE block_id END AS block_id,
  CASE WHEN k = 1 THEN 0 ELSE page END AS page FROM (SELECT *, {digit('block_id')} AS k FROM blocks_all) WHERE k < 3""")
# visible leaves of all kinds of blocks; gap: what separates a leaf from the one before it
cte("table_parts", """
SELECT b.block_id, p.pos, p.cell, p.img_path, p.alt FROM blocks_all b JOIN block_parts p ON p.doc_id = b.doc_id AND p.pos = b.pos AND p.sub = b.sub AND p.kind = 'table' WHERE b.kind = 'table'""")
cte("inline_atoms", "SELECT a.* FROM text_atoms a JOIN blocks_all b ON b.block_id = a.block_id WHERE b.kind NOT IN ('equation', 'figure', 'table')")
cte("leaves", """
SELECT block_id, akey AS ord, CASE WHEN special AND value LIKE '$%' THEN value[2:-2] ELSE value END AS t, 0 AS gap FROM inline_atoms
UNION ALL SELECT block_id, 0, plain_text, 0 FROM blocks_all WHERE kind IN ('equation', 'figure')
UNION ALL SELECT block_id, 0, 'a', 0 FROM table_parts UNION ALL SELECT block_id, 1, cell, 3 FROM table_parts WHERE cell <> ''
UNION ALL SELECT block_id, 2, pos || ' ', CASE WHEN cell = '' THEN 4 ELSE 1 END FROM table_parts UNION ALL SELECT block_id, 3, '[1]', 0 FROM table_parts
UNION ALL SELECT block_id, 4, coalesce(alt, ''), 0 FROM table_parts WHERE img_path IS NOT NULL""")
