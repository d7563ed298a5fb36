"""Registered queries of the normalization operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions.atoms import leaf_text
from docloom.operators import documents as D
from docloom.operators import normalize as N
from docloom.plans.bridge import Corpus
from docloom.plans.oracle_base import compose
from docloom.plans.registry import register
from docloom.session import checkpoint_dir


def _boxed(c: Corpus):
    return N.scale_bboxes(c.raw, N.page_sizes(c.layout)[0])


def _classified(c: Corpus):
    boxed, _ = _boxed(c)
    aliases = N.canonical_assets(c.asset_files)[1]
    return N.classify_text(N.resolve_assets(N.drop_layout_noise(boxed), aliases)[0])


def _light(c: Corpus):
    """Rows with a page but without boxes and assets, for queries that need neither."""
    raw = N.drop_layout_noise(c.raw).withColumn("page", F.col("page_idx") + 1)
    return N.classify_text(raw)


register(
    "N1_page_sizes", lambda c: N.page_sizes(c.layout)[0],
    compose("SELECT doc_id, page, width, height FROM pages_sized"),
)
register(
    "N2_canonical_assets", lambda c: N.canonical_assets(c.asset_files)[0],
    """SELECT doc_id, sha256(text) AS id, 'image/jpeg' AS mime_type, 'images/' || sha256(text) || '.jpg' AS relative_path,
  sha256(text) AS sha256, n_chars AS size_bytes, 0 AS pos FROM documents""",
)
register(
    "N2_asset_aliases", lambda c: N.canonical_assets(c.asset_files)[1],
    compose("""SELECT doc_id, 'images/' || sha || '.jpg' AS relative_path, sha AS asset_id FROM doc_keys
UNION ALL SELECT doc_id, 'images/' || key || '.jpg', sha FROM doc_keys"""),
)
register(
    "N3_drop_layout_noise", lambda c: N.drop_layout_noise(c.raw).select("doc_id", "pos", "type", "text"),
    compose("SELECT doc_id, pos, type, text FROM raw WHERE type <> 'footer'"),
)
register(
    "N4_pick_title", lambda c: N.pick_title(_light(c)),
    compose("SELECT doc_id, title, pos FROM title_rows"),
)
register(
    "N5_heading_depth",
    lambda c: c.raw.select("doc_id", "pos", N.heading_depth(N.clean_text("text")).alias("depth")).filter("depth IS NOT NULL"),
    compose(r"""SELECT doc_id, pos, (CASE
    WHEN regexp_extract(c, '^([0-9]+(\.[0-9]+)*)\.*\s', 1) <> '' THEN len(string_split(regexp_extract(c, '^([0-9]+(\.[0-9]+)*)\.*\s', 1), '.'))
    WHEN regexp_matches(c, '^[A-Z] +\S') THEN 1
    WHEN regexp_extract(c, '^[A-Z]\.([0-9]+(\.[0-9]+)*)\s', 1) <> '' THEN len(string_split(regexp_extract(c, '^[A-Z]\.([0-9]+(\.[0-9]+)*)\s', 1), '.')) + 1
    WHEN c <> '' AND octet_length(encode(c)) <= 160 AND NOT regexp_matches(c, '[.!?;,]$') AND NOT starts_with(lower(c), 'example ') THEN 1 END)::INT AS depth
FROM (SELECT doc_id, pos, """ + "trim(regexp_replace(text, '\\s+', ' ', 'g'))" + """ AS c FROM raw) WHERE depth IS NOT NULL"""),
)
register(
    "N6_segment_chapters",
    lambda c: N.segment_chapters(_light(c)).select("doc_id", "pos", "is_start", "is_heading", "segment"),
    compose("SELECT doc_id, pos, is_start, is_heading, segment FROM segmented"),
)
register(
    "N7_chapter_role",
    lambda c: N.segment_chapters(_light(c)).filter("is_heading").select(
        "doc_id", "pos", N.chapter_role(F.col("clean")).alias("role")),
    compose("SELECT doc_id, pos, word_role AS role FROM headed WHERE is_heading"),
)
register(
    "N8_scale_bboxes",
    lambda c: _boxed(c)[0].filter("box IS NOT NULL").select(
        "doc_id", "pos", "page", *[F.round(f"box.{k}", 6).alias(k) for k in ("x", "y", "width", "height")]),
    compose("""SELECT r.doc_id, r.pos, r.page_idx + 1 AS page, round(x0 / 1000 * width, 6) AS x, round(y0 / 1000 * height, 6) AS y,
  round((x1 - x0) / 1000 * width, 6) AS width, round((y1 - y0) / 1000 * height, 6) AS height
FROM raw r LEFT JOIN pages_sized p ON p.doc_id = r.doc_id AND p.page = r.page_idx + 1 WHERE x1 >= x0"""),
)
register(
    "N9_classify_text",
    lambda c: _light(c).filter("clean <> ''").select("doc_id", "pos", "kind", "clean"),
    compose("""SELECT doc_id, pos, CASE WHEN type = 'text' AND text_level IS NOT NULL THEN 'heading'
    WHEN type = 'text' AND regexp_matches(clean, '^(- |• |\\* |[0-9]+[.)])') THEN 'list' WHEN type IN ('text', 'ref_text') THEN 'paragraph'
    WHEN type = 'equation' THEN 'equation' ELSE 'caption' END AS kind, clean FROM classified WHERE clean <> ''"""),
)
register(
    "N10_inline_atoms",
    lambda c: c.normalized.blocks.select(
        "block_id", F.posexplode("content.atoms").alias("atom_index", "a")).select(
        "block_id", "atom_index", "a.type", "a.id", leaf_text(F.col("a")).alias("text")),
    compose("""SELECT block_id, (row_number() OVER (PARTITION BY block_id ORDER BY akey) - 1)::INT AS atom_index,
  CASE WHEN NOT special THEN 'text' WHEN value LIKE '$%' THEN 'formula' ELSE 'citation' END AS type,
  CASE WHEN NOT special THEN NULL WHEN value LIKE '$%' THEN 'formula-' || left(sha256(value[2:-2]), 16) ELSE 'citation-' || left(sha256(value), 16) END AS id,
  CASE WHEN special AND value LIKE '$%' THEN value[2:-2] ELSE value END AS text FROM inline_atoms
UNION ALL SELECT block_id, 0, 'formula', 'formula-' || left(sha256(plain_text), 16), plain_text FROM blocks_all WHERE kind = 'equation'
UNION ALL SELECT block_id, 0, 'asset', NULL, '' FROM blocks_all WHERE kind = 'figure' UNION ALL SELECT block_id, 0, 'table', NULL, '' FROM table_parts
UNION ALL SELECT block_id, 1, 'asset', NULL, '' FROM table_parts WHERE img_path IS NOT NULL"""),
)
register(
    "N11_table_cells",
    lambda c: c.raw.filter("type = 'table'").select(
        "doc_id", "pos", F.explode(F.flatten(N.html_table(F.col("table_body"))["rows"])).alias("x")).select(
        "doc_id", "pos", "x.row", "x.column", "x.rowSpan", "x.columnSpan",
        F.to_json("x.content").alias("content")),
    compose("""SELECT doc_id, pos, 0 AS "row", 0 AS "column", 1 AS "rowSpan", 1 AS "columnSpan", '[{"type":"text","value":"a"}]' AS content FROM raw WHERE type = 'table'
UNION ALL SELECT doc_id, pos, 0, 1, 1, 2, CASE WHEN cell = '' THEN '[]' ELSE '[{"type":"text","value":"' || cell || '"}]' END
FROM (SELECT *, trim(regexp_replace(regexp_replace(line, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) AS cell FROM raw WHERE type = 'table')
UNION ALL SELECT doc_id, pos, 2, 0, 1, 1, '[{"type":"text","value":"' || pos || ' "},{"type":"citation","id":"citation-' || left(sha256('[1]'), 16) || '","label":"[1]"}]'
FROM raw WHERE type = 'table'"""),
)

def _expanded(c: Corpus):
    return N.expand_blocks(N.segment_chapters(_classified(c)))[0].select("doc_id", "pos", "sub", "kind", "text", "type")


register(
    "N12_expand_tables",
    lambda c: _expanded(c).filter("type = 'table'").drop("type"),
    compose("SELECT b.doc_id, b.pos, b.sub, b.kind, b.text FROM block_parts b JOIN segmented s ON s.doc_id = b.doc_id AND s.pos = b.pos WHERE s.type = 'table'"),
)
register(
    "N13_expand_figures",
    lambda c: _expanded(c).filter("type IN ('image', 'chart')").drop("type").join(
        c.sources.select("doc_id"), "doc_id"),
    compose("""SELECT b.doc_id, b.pos, b.sub, b.kind, b.text FROM block_parts b JOIN segmented s ON s.doc_id = b.doc_id AND s.pos = b.pos
WHERE s.type IN ('image', 'chart') AND NOT (s.k = 13 AND s.img_path IS NOT NULL AND b.sub <> 1)"""),
)
register(
    "N14_resolve_assets",
    lambda c: N.resolve_assets(c.raw, N.canonical_assets(c.asset_files)[1])[0].filter("asset_id IS NOT NULL").select(
        "doc_id", "pos", "asset_id"),
    compose("SELECT doc_id, pos, sha AS asset_id FROM raw WHERE img_path IS NOT NULL AND k <> 13"),
)
register(
    "N15_assign_ids",
    lambda c: c.normalized.blocks.select("doc_id", "chapter_id", "block_id", "order_index", "kind", "page", "source_digest"),
    compose("SELECT doc_id, chapter_id, block_id, order_index, kind, page, source_digest FROM blocks_all"),
)
register(
    "N15_chapters",
    lambda c: c.normalized.chapters.select(
        "doc_id", "chapter_id", "chapter_index", "order_index", "depth", "role", "source_title", "page_start", "page_end", "block_count"),
    compose("SELECT doc_id, chapter_id, chapter_index, order_index, depth, role, source_title, page_start, page_end, block_count FROM chapters_all"),
)
register(
    "N16_reject_documents", lambda c: c.normalized.rejected,
    compose("""SELECT doc_id, v.pos AS pos, v.code AS code FROM rejected
UNION ALL SELECT doc_id, -1, 'no_content' FROM doc_keys
WHERE doc_id NOT IN (SELECT doc_id FROM rejected) AND doc_id NOT IN (SELECT doc_id FROM chapters_all)"""),
)
register(
    "N17_assemble_documents",
    lambda c: D.assemble_documents(D.document_pieces(c.normalized, c.sources)).select(
        "doc_id", "block_count", "title", "page_count", "chapter_count", "order_digest", "first_asset"),
    compose("""SELECT b.doc_id, count(*) AS block_count, any_value(t.title) AS title, any_value((k.n_lines - 1) // 10 + 1)::INT AS page_count,
  count(DISTINCT chapter_id)::INT AS chapter_count, sha256(string_agg(block_id, ',' ORDER BY chapter_order, order_index)) AS order_digest,
  'images/' || any_value(k.sha) || '.jpg' AS first_asset
FROM blocks_all b JOIN doc_keys k ON k.doc_id = b.doc_id LEFT JOIN title_rows t ON t.doc_id = b.doc_id GROUP BY b.doc_id"""),
)
register(
    "N17_find_blocks",
    lambda c: D.find_blocks(D.document_pieces(c.normalized, c.sources)).select("doc_id", "chapter_id", F.col("id").alias("block_id"), "kind"),
    compose("SELECT doc_id, chapter_id, block_id, kind FROM blocks_all"),
)
register(
    "N18_chapter_digests",
    lambda c: D.chapter_digests(c.normalized.chapters, c.normalized.blocks),
    compose("""SELECT b.doc_id, b.chapter_id, sha256(encode(any_value(c.source_title)) || unhex(string_agg('00' || hex(encode(source_digest)), '' ORDER BY b.order_index))) AS chapter_digest
FROM blocks_all b JOIN chapters_all c ON c.chapter_id = b.chapter_id GROUP BY 1, 2"""),
)
register(
    "N19_flag_translatable",
    lambda c: D.flag_translatable(c.normalized.blocks).select("block_id", "translatable"),
    compose("SELECT block_id, translatable FROM translatable"),
)
register(
    "N20_plain_text",
    lambda c: D.block_plain_text(c.normalized.blocks).select("block_id", "plain_text"),
    compose("""SELECT block_id, CASE WHEN kind IN ('equation', 'figure') THEN plain_text ELSE
  (SELECT string_agg(CASE WHEN special AND value LIKE '$%' THEN value[2:-2] ELSE value END, '' ORDER BY akey) FROM inline_atoms a WHERE a.block_id = b.block_id) END AS plain_text
FROM blocks_all b WHERE kind <> 'table'
UNION ALL SELECT block_id, 'a | ' || cell || chr(10) || pos || ' [1]' || CASE WHEN img_path IS NOT NULL THEN coalesce(alt, '') ELSE '' END FROM table_parts"""),
)
register(
    "N21_atom_offsets",
    lambda c: D.atom_offsets(c.normalized.blocks).select("block_id", "leaf_index", "start_utf16", "end_utf16"),
    compose("""WITH u AS (SELECT *, length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS n FROM leaves)
SELECT block_id, (row_number() OVER w - 1)::INT AS leaf_index, (sum(n + gap) OVER w - n)::INT AS start_utf16, (sum(n + gap) OVER w)::INT AS end_utf16
FROM u WINDOW w AS (PARTITION BY block_id ORDER BY ord ROWS UNBOUNDED PRECEDING)"""),
)
register(
    "N22_term_statistics",
    lambda c: D.term_statistics(c.normalized.blocks, "content.plainText"),
    compose(r"""SELECT term, count(*) AS block_count FROM (SELECT DISTINCT block_id,
  unnest(regexp_extract_all(lower(strip_accents(plain_text)), '[\pL\pN]+')) AS term FROM blocks_all) GROUP BY term"""),
)
TERMS = r"(SELECT DISTINCT block_id, unnest(regexp_extract_all(lower(strip_accents(plain_text)), '[\pL\pN]+')) AS term FROM blocks_all)"


def _index(c: Corpus):
    path = f"{checkpoint_dir(c.spark)}/docloom-{uuid.uuid4().hex}/terms"
    return D.read_term_index(c.spark, D.write_term_index(c.normalized.blocks, path, "content.plainText"))


register("N22_match_term", lambda c: D.match_term(_index(c), "The"), compose(f"SELECT block_id FROM {TERMS} WHERE term = 'the'"))
register("N22_match_terms", lambda c: D.match_terms(_index(c), ["The", "of", "ánd"]),
         compose(f"SELECT block_id FROM {TERMS} WHERE term IN ('the', 'of', 'and') GROUP BY block_id HAVING count(*) = 3"))


def _entries(c: Corpus):
    """Archive listings: one per document, its lines as entries."""
    lines = c.table("documents").select(
        F.col("doc_id").alias("archive_id"), F.col("n_chars").alias("source_size_bytes"),
        F.posexplode(F.split("text", "\n", -1)).alias("entry_index", "line"))
    i, a = F.col("entry_index"), F.col("archive_id")
    path = (
        F.when(i == 0, "layout.json").when((i == 1) & (a % 7 != 0), "x_content_list.json")
        .when((i == 2) & (a % 5 == 0), "../evil").when((i == 3) & (a % 11 == 0), "images/short.png")
        .when(i % 4 == 1, F.concat(F.lit("images/"), F.sha2("line", 256), F.when(a % 3 == 0, ".gif").otherwise(".PNG")))
        .otherwise(F.concat(F.lit("extra/"), i, F.lit(".txt")))
    )
    return lines.select(
        "archive_id", "entry_index", path.alias("path"), (F.length("line") * 20000).cast("long").alias("size_bytes"),
        F.when((i == 4) & (a % 13 == 0), 0o120777).otherwise(0o100644).alias("unix_mode"), F.lit(False).alias("is_dir"), "source_size_bytes")


register(
    "N23_audit_archive_entries", lambda c: D.audit_archive_entries(_entries(c)),
    """
WITH l AS (SELECT doc_id AS a, n_chars, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
e AS (SELECT *, CASE WHEN i = 0 THEN 'layout.json' WHEN i = 1 AND a % 7 <> 0 THEN 'x_content_list.json' WHEN i = 2 AND a % 5 = 0 THEN '../evil'
    WHEN i = 3 AND a % 11 = 0 THEN 'images/short.png' WHEN i % 4 = 1 THEN 'images/' || sha256(line) || CASE WHEN a % 3 = 0 THEN '.gif' ELSE '.PNG' END
    ELSE 'extra/' || i || '.txt' END AS path, length(line) * 20000 AS size, least(greatest(n_chars * 10, 16777216), 1000000000) AS tot, least(greatest(n_chars * 10, 16777216), 268435456) AS one FROM l),
r AS (SELECT *, sum(size) OVER (PARTITION BY a ORDER BY i ROWS UNBOUNDED PRECEDING) AS run,
  row_number() OVER (PARTITION BY a, path ORDER BY i) AS nth FROM e),
v AS (SELECT *, CASE WHEN path = '../evil' THEN 'unsafe_path' WHEN i = 4 AND a % 13 = 0 THEN 'link_or_special' WHEN size > one THEN 'file_too_large'
    WHEN run > tot THEN 'archive_too_large' WHEN path = 'images/short.png' THEN 'invalid_asset_name' WHEN path LIKE '%.gif' THEN 'unsupported_image_type'
    WHEN path LIKE 'images/%' AND nth > 1 THEN 'duplicate_path' END AS rule FROM r)
SELECT a AS archive_id, count(*) AS entry_count, sum(size)::BIGINT AS expanded_bytes,
  coalesce(arg_min(rule, CASE WHEN rule IS NOT NULL THEN i END), CASE WHEN count(*) FILTER (path = 'x_content_list.json') <> 1 THEN 'content_list_count' END) AS error_code
FROM v GROUP BY a""",
)
