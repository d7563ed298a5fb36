"""Flat parser output -> chapters, typed blocks and inline atoms with stable ids.

Rows belong to one document each and are ordered by ``pos``. Everything that depends on the
order goes through ``ordered_scan`` on one layout, so a document of any size spreads over many tasks.
Problems are rows ``(doc_id, pos, code)``, not exceptions: one bad document never stops a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.atoms import html_table, inline_atoms, make_atom, table_text, widen
from docloom.functions.scan import RANGE, lay_out, ordered_row_number, ordered_scan
from docloom.functions.stage import materialize
from docloom.functions.text import WS, ascii_lower, clean_text, nbytes, stable_id, utrim
from docloom.schemas import ATOMS, KNOWN_TYPES, TABLE_ROWS

HEX64 = "^[0-9a-fA-F]{64}$"
FIGURE_TYPES = ["image", "chart"]
#: What a raw row's blocks are made of.
_TEXTS = ["type", "text", "text_level", "image_caption", "image_footnote", "chart_caption", "chart_footnote", "table_caption",
          "table_footnote", "table_body"]


def violation(df: DataFrame, code: Column, pos: Column | None = None) -> DataFrame:
    return df.select(
        "doc_id", (F.lit(-1) if pos is None else pos).cast("long").alias("pos"), code.alias("code")
    ).filter("code IS NOT NULL")


# ---- pages and assets ------------------------------------------------------------------
def page_sizes(layout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page, width, height) and violations, from (doc_id, pdf_info)."""
    rows = layout.select("doc_id", F.posexplode_outer("pdf_info").alias("i", "p")).select(
        "doc_id", "i", "p.page_idx", F.col("p.page_size")[0].alias("width"),
        F.col("p.page_size")[1].alias("height"),
    )
    bad_size = F.lit(False)
    for side in ("width", "height"):
        c = F.col(side)
        bad_size = bad_size | c.isNull() | F.isnan(c) | (c <= 0) | (c == float("inf"))
    code = (
        F.when(F.col("i").isNull(), "no_pages")
        .when(F.col("page_idx") != F.col("i"), "pages_out_of_order")
        .when(bad_size, "invalid_page_size")
    )
    pages = rows.filter("i IS NOT NULL").select(
        "doc_id", (F.col("i") + 1).alias("page"), "width", "height"
    )
    return pages, violation(rows, code)


def canonical_assets(assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, aliases, violations) from (doc_id, pos, relative_path, sha256, mime_type, size_bytes)."""
    direct = F.col("relative_path").rlike(r"^(\./)*images/(\./)*(?!\.{1,2}/?$)[^/]+/?$")
    row_code = (
        F.when(~F.col("sha256").rlike(HEX64), "invalid_asset_hash")
        .when(~direct, "invalid_asset_path")
        .when(F.col("size_bytes") == 0, "empty_asset")
    )
    one = assets.groupBy("doc_id", "sha256").agg(
        F.min_by(F.struct("relative_path", "mime_type", "size_bytes"), "pos").alias("a"),
        F.min("pos").alias("pos"),
        # two distinct values exist iff the extremes differ; no distinct set is kept
        ((F.min("mime_type") != F.max("mime_type")) | (F.min("size_bytes") != F.max("size_bytes"))).alias("mixed"),
    )
    twice = assets.groupBy("doc_id", "relative_path").agg(
        F.count(F.lit(1)).alias("n"), F.max("pos").alias("pos")
    )
    bad = (
        violation(assets, row_code, F.col("pos"))
        .unionByName(violation(one, F.when(F.col("mixed"), "asset_metadata_conflict"), F.col("pos")))
        .unionByName(violation(twice, F.when(F.col("n") > 1, "duplicate_asset_path"), F.col("pos")))
    )
    unique = one.select(
        "doc_id", F.col("sha256").alias("id"), F.col("a.mime_type").alias("mime_type"),
        F.col("a.relative_path").alias("relative_path"), "sha256",
        F.col("a.size_bytes").alias("size_bytes"), "pos",
    )
    aliases = assets.groupBy("doc_id", "relative_path").agg(
        F.min_by("sha256", "pos").alias("asset_id")
    )
    return unique, aliases, bad


def with_assets(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``asset_id``, and ``asset_code`` where a table or figure names an unknown path.

    The many rows without a path match nothing; they are spread over keys of their own, so that
    those of one document do not pile up on its null path.
    """
    uses = F.coalesce(F.col("type").isin(["table", *FIGURE_TYPES]) & F.col("img_path").isNotNull(), F.lit(False))
    keyed = raw.withColumn("__spread", F.when(uses, 0).otherwise(1 + F.pmod(F.xxhash64("pos"), F.lit(256))))
    named = aliases.withColumnRenamed("relative_path", "img_path").withColumn("__spread", F.lit(0).cast("long"))
    return keyed.join(named, ["doc_id", "img_path", "__spread"], "left").withColumn(
        "asset_code", F.when(uses & F.col("asset_id").isNull(), "missing_asset")).select(*raw.columns, "asset_id", "asset_code")


def resolve_assets(raw: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``asset_id``; a table or figure naming an unknown path is a violation."""
    rows = with_assets(raw, aliases)
    return rows.drop("asset_code"), violation(rows, F.col("asset_code"), F.col("pos"))


def with_boxes(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``page``, ``box`` (PDF points), and ``box_code`` where the page or the box is bad."""
    keyed = raw.withColumn("page", F.col("page_idx") + 1)
    joined = keyed.join(pages, ["doc_id", "page"], "left")
    b = F.col("bbox")
    inside = F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1000.0))
    ok = (F.size(b) == 4) & inside & (b[2] >= b[0]) & (b[3] >= b[1])
    code = F.when(F.col("width").isNull(), "page_out_of_range").when(
        b.isNotNull() & ~ok, "invalid_bbox"
    )
    box = F.when(
        b.isNotNull() & ok,
        F.struct(
            F.col("page").alias("page"),
            (b[0] / 1000.0 * F.col("width")).alias("x"),
            (b[1] / 1000.0 * F.col("height")).alias("y"),
            ((b[2] - b[0]) / 1000.0 * F.col("width")).alias("width"),
            ((b[3] - b[1]) / 1000.0 * F.col("height")).alias("height"),
            F.lit("pdf_points").alias("coordinateSpace"),
        ),
    )
    return joined.withColumn("box_code", code).withColumn("box", box).drop("width", "height")


def scale_bboxes(raw: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``page`` and ``box``; bad pages and boxes are violations.

    The check covers noise rows too, so it runs before they are dropped.
    """
    rows = with_boxes(raw, pages)
    return rows.drop("box_code"), violation(rows, F.col("box_code"), F.col("pos"))


def drop_layout_noise(raw: DataFrame) -> DataFrame:
    """Page furniture and unknown row types go."""
    return raw.filter(F.col("type").isin(KNOWN_TYPES))


# ---- headings --------------------------------------------------------------------------
def numeric_heading_depth(title: Column) -> Column:
    number = F.regexp_extract(title, rf"^{WS}*([0-9]+(?:\.[0-9]+)*)\.*(?={WS})", 1)
    return F.when(number != "", F.size(F.split(number, r"\.")))


def appendix_heading_depth(title: Column) -> Column:
    number = F.regexp_extract(title, rf"^{WS}*[A-Z]\.([0-9]+(?:\.[0-9]+)*)(?={WS})", 1)
    plain = title.rlike(rf"^{WS}*[A-Z]{WS}+[^\p{{IsWhite_Space}}]")
    return F.when(plain, F.lit(1)).when(number != "", F.size(F.split(number, r"\.")) + 1)


def looks_unnumbered(title: Column) -> Column:
    t = utrim(title)
    return (
        (t != "") & (nbytes(t) <= 160) & ~t.rlike(r"[.!?;,]\z")
        & ~ascii_lower(t).startswith("example ")
    )


def heading_depth(title: Column) -> Column:
    """Depth of a structural heading, null for one that opens no chapter."""
    return F.coalesce(
        numeric_heading_depth(title), appendix_heading_depth(title),
        F.when(looks_unnumbered(title), F.lit(1)),
    ).cast("int")


def chapter_role(title: Column) -> Column:
    word = ascii_lower(
        F.regexp_replace(title, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")
    )
    return (
        F.when(word.isin("references", "bibliography", "reference"), "references")
        .when(numeric_heading_depth(title).isNotNull(), "body")
        .when(word.isin("abstract", "summary", "acknowledgements", "acknowledgments"), "front_matter")
        .otherwise("body")
    )


def strip_display_math(text: Column) -> Column:
    """Trimmed LaTeX without one pair of ``$$``."""
    return utrim(F.regexp_replace(utrim(text), r"(?s)^\$\$(.*)\$\$\z", "$1"))


def looks_like_list_item(text: Column) -> Column:
    return text.rlike(r"^(- |• |\* |[0-9]+[.)])")


def joined_lines(values: Column) -> Column:
    cleaned = F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_text)
    return F.array_join(F.filter(cleaned, lambda v: v != ""), "\n")


def classify_text(raw: DataFrame) -> DataFrame:
    """Adds ``clean`` (null for tables/figures), heading ``depth`` and ``role``, and ``kind``."""
    text = F.coalesce("text", F.lit(""))
    is_text = F.col("type").isin("text", "ref_text", "page_footnote")
    out = raw.withColumn(
        "clean",
        F.when(F.col("type") == "equation", strip_display_math(text)).when(is_text, clean_text(text)),
    )
    heading = (F.col("type") == "text") & F.col("text_level").isNotNull() & (F.col("clean") != "")
    out = out.withColumn("depth", F.when(heading, heading_depth(F.col("clean"))))
    kind = (
        F.when(F.coalesce(heading, F.lit(False)), "heading")
        .when((F.col("type") == "text") & looks_like_list_item(F.col("clean")), "list")
        .when(F.col("type").isin("text", "ref_text"), "paragraph")
        .when(F.col("type") == "equation", "equation")
        .when(F.col("type") == "page_footnote", "caption")
    )
    return out.withColumn("kind", kind)


def _title_candidate() -> Column:
    return (F.col("type") == "text") & F.coalesce(F.col("text_level") == 1, F.lit(False)) & (
        F.col("clean") != ""
    )


def pick_title(classified: DataFrame) -> DataFrame:
    """(doc_id, title, pos): the first non-empty level-1 text; it makes no block."""
    return classified.filter(_title_candidate()).groupBy("doc_id").agg(
        F.min_by("clean", "pos").alias("title"), F.min("pos").alias("pos")
    )


def segment_chapters(classified: DataFrame) -> DataFrame:
    """Drops the title row and adds ``segment``, ``is_start``, ``is_heading`` (bool).

    A chapter starts at each structural heading and at the first ``ref_text`` since the last
    heading unless that heading is itself a references heading. Segment 0 is what comes
    before the first start. Both scans share a layout.
    """
    cand = _title_candidate()
    opens = F.col("depth").isNotNull()
    refs = chapter_role(F.col("clean")) == "references"
    mark = F.struct(F.col("pos").alias("p"), refs.alias("refs"))
    low = F.coalesce(F.col("text_level") == 1, F.lit(False))
    laid = classified if RANGE in classified.columns else lay_out(classified, ["doc_id"], "pos")
    seen = ordered_scan(
        laid, ["doc_id"], "pos",
        {
            "__title": ("min", F.when(cand, F.col("pos"))),
            "__h1": ("max", F.when(opens & low, mark)),
            "__h2": ("max", F.when(opens & ~low, mark)),
            "__ref": ("max", F.when(F.col("type") == "ref_text", F.col("pos"))),
        },
        inclusive=False,
    )
    is_title = cand & F.col("__title").isNull()
    # the title is the earliest level-1 candidate, so it is no heading wherever it comes last
    h1 = F.when(F.col("__h1.p") != F.col("__title"), F.col("__h1"))
    last = F.greatest(h1, F.col("__h2"))
    flagged = seen.withColumn("is_heading", opens & ~is_title).withColumn("__last", last)
    first_ref = (
        (F.col("type") == "ref_text")
        & ~F.coalesce(F.col("__last.refs"), F.lit(False))
        & (F.col("__ref").isNull() | (F.col("__ref") < F.coalesce(F.col("__last.p"), F.lit(-1))))
    )
    kept = (
        flagged.filter(~is_title)
        .withColumn("is_start", F.col("is_heading") | first_ref)
        .drop("__title", "__h1", "__h2", "__ref", "__last")
    )
    return ordered_scan(kept, ["doc_id"], "pos", {"segment": ("sum", F.col("is_start").cast("long"))})


# ---- blocks ----------------------------------------------------------------------------
def _first(values: Column) -> Column:
    return F.get(values, 0)


def parse_tables(raw: DataFrame) -> DataFrame:
    """Adds ``table`` (rows, error): the HTML of table rows, read once; null elsewhere."""
    return raw.withColumn("table", F.when(F.col("type") == "table", html_table(
        F.when(F.col("type") == "table", F.coalesce("table_body", F.lit(""))))))


def _captions() -> tuple[Column, Column]:
    """Caption and footnote text of a table, figure or chart row."""
    chart, fig = F.col("type") == "chart", F.col("type").isin(FIGURE_TYPES)
    cap = F.when(F.col("type") == "table", F.col("table_caption")).when(chart, F.col("chart_caption")).when(fig, F.col("image_caption"))
    foot = F.when(F.col("type") == "table", F.col("table_footnote")).when(chart, F.col("chart_footnote")).when(fig, F.col("image_footnote"))
    return joined_lines(cap), joined_lines(foot)


def row_shapes(raw: DataFrame) -> DataFrame:
    """Rows without their texts: what decides on their chapters and on how many blocks they make.

    Only what may be a title or a heading keeps its ``clean`` text.
    """
    cap, foot = _captions()
    headline = (F.col("type") == "text") & F.col("text_level").isNotNull()
    return parse_tables(classify_text(raw)).select(
        "doc_id", "pos", "type", "text_level", "page_idx", "bbox",
        F.when(F.col("type").isin(["table", *FIGURE_TYPES]), F.col("img_path")).alias("img_path"),
        F.when(headline, F.col("clean")).alias("clean"), "depth",
        F.coalesce(F.col("kind").isNotNull() & (F.col("clean") != ""), F.lit(False)).alias("has_text"),
        F.coalesce(F.size("table.rows") > 0, F.lit(False)).alias("has_rows"), F.col("table.error").alias("table_error"),
        (cap != "").alias("has_cap"), (foot != "").alias("has_foot"))


def shape_size() -> Column:
    """Number of blocks that :func:`expand_blocks` makes of a row, from its shape and ``asset_id``."""
    fig, grid, asset = F.col("type").isin(FIGURE_TYPES), F.col("type") == "table", F.col("asset_id").isNotNull()
    made = [F.col("has_text"), fig & asset, grid & (F.col("has_rows") | asset), (fig | grid) & F.col("has_cap"), fig & asset & F.col("has_foot")]
    return sum((x.cast("long") for x in made), F.lit(0).cast("long"))


def expand_blocks(segmented: DataFrame, asset_col: str = "asset_id", carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One row per block (tables make up to two, figures up to three) and table violations.

    Output: the raw row's keys plus sub, kind, clean text or table/figure parts, ``nth`` (the block's
    place among its row's) and the columns in ``carry``. Rows that make no block are gone. Tables are
    those of :func:`parse_tables`, which runs if it has not yet.
    """
    if "table" not in segmented.columns:
        segmented = parse_tables(segmented)
    fig = F.col("type").isin(FIGURE_TYPES)
    cap, foot = _captions()
    has_asset = F.col(asset_col).isNotNull()
    text_like = F.col("kind").isNotNull()

    def piece(sub: int, kind: Column, text: Column) -> Column:
        return F.struct(F.lit(sub).alias("sub"), kind.alias("kind"), text.alias("text"))

    keep = ["doc_id", "pos", "page", "box", "segment", "type", *carry]
    t = F.col("table.rows")
    has_rows = F.coalesce(F.size(t) > 0, F.lit(False))
    body = F.array_join(F.array_compact(F.array(
        F.when(F.col("__cap") != "", F.col("__cap")),
        F.when(has_rows, table_text(t, "\t")),
        F.when(F.col("__foot") != "", F.col("__foot")),
    )), "\n")
    grid = F.col("type") == "table"
    pieces = F.array_compact(F.array(
        F.when(text_like & (F.col("clean") != ""), piece(0, F.col("kind"), F.col("clean"))),
        F.when(fig & has_asset, piece(0, F.lit("figure"), F.col("__cap"))),
        F.when(grid & (has_rows | has_asset), piece(0, F.lit("table"), body)),
        F.when((fig | grid) & (F.col("__cap") != ""), piece(1, F.lit("caption"), clean_text(F.col("__cap")))),
        F.when(fig & has_asset & (F.col("__foot") != ""), piece(2, F.lit("caption"), clean_text(F.col("__foot")))),
    ))
    flat = segmented.withColumn("__cap", cap).withColumn("__foot", foot).select(
        *keep, F.posexplode(pieces).alias("nth", "__b"), F.col(asset_col).alias("asset_id"), t.cast(TABLE_ROWS).alias("rows"),
        F.when(grid, _first(F.col("table_caption"))).alias("alt"))
    return flat.select(*keep, "nth", "__b.*", "asset_id", "rows", "alt"), violation(segmented, F.col("table.error"), F.col("pos"))


def attach_content(blocks: DataFrame) -> DataFrame:
    """Adds ``content`` (plainText, atoms) and its ``source_digest``; drops the parts."""
    text, kind = F.col("text"), F.col("kind")
    formula_id = F.concat(F.lit("formula-"), F.substring(F.sha2(text, 256), 1, 16))
    leaf = F.array(make_atom("formula", id=formula_id, latex=text, display=F.lit(True)))
    figure = F.array(make_atom("asset", assetId=F.col("asset_id"), alt=F.nullif(text, F.lit(""))))
    table = F.array_compact(F.array(
        F.when(F.size("rows") > 0, make_atom("table", rows=F.col("rows"))),
        F.when(F.col("asset_id").isNotNull(), make_atom("asset", assetId=F.col("asset_id"), alt=F.col("alt"))),
    ))
    inline = widen(inline_atoms(F.when(kind.isin("equation", "figure", "table"), F.lit("")).otherwise(text)))
    atoms = (
        F.when(kind == "equation", leaf.cast(ATOMS)).when(kind == "figure", figure.cast(ATOMS))
        .when(kind == "table", table.cast(ATOMS)).otherwise(inline)
    )
    out = blocks.withColumn("content", F.struct(text.alias("plainText"), atoms.alias("atoms")))
    return out.withColumn("source_digest", F.sha2(F.to_json("content"), 256)).drop(
        "text", "asset_id", "rows", "alt"
    )


def chapters_and_numbers(segmented: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapter rows with indexes, and the rows that make blocks with ``before``: the number of blocks
    before theirs in the chapter. Rows are shapes (:func:`row_shapes`) and carry no text."""
    starts = segmented.filter("is_start").select(
        "doc_id", "segment", F.col("page").alias("page_start"),
        F.when(F.col("is_heading"), F.col("clean")).otherwise("References").alias("source_title"),
        F.when(F.col("is_heading"), F.col("depth")).otherwise(1).cast("int").alias("depth"),
        F.when(F.col("is_heading"), chapter_role(F.col("clean"))).otherwise("references").alias("role"),
    )
    making = segmented.withColumn("__size", shape_size()).filter("__size > 0").select(
        "doc_id", "pos", "page", "box", "segment", "asset_id", "__size", RANGE)
    sizes = making.groupBy("doc_id", "segment").agg(
        F.sum("__size").alias("block_count"), F.max("page").alias("last_page"), F.min_by("page", "pos").alias("first_page"),
    )
    drafts = lay_out(starts.join(sizes, ["doc_id", "segment"], "full_outer").select(
        "doc_id", "segment",
        F.coalesce("page_start", "first_page").alias("page_start"),
        F.greatest(F.coalesce("page_start", "first_page"), "last_page").alias("page_end"),
        F.coalesce("source_title", F.lit("Front Matter")).alias("source_title"),
        F.coalesce("depth", F.lit(1)).alias("depth"),
        F.coalesce("role", F.lit("front_matter")).alias("role"),
        F.coalesce("block_count", F.lit(0)).alias("block_count"),
    ), ["doc_id"], "segment")
    # drafts are counted from 0, with the front matter as the first one where it exists
    numbered = ordered_row_number(drafts, ["doc_id"], "segment", "__draft")
    kept = ordered_row_number(numbered.filter("block_count > 0"), ["doc_id"], "segment", "__kept")
    chapters = kept.select(
        "doc_id", "segment", (F.col("__draft") - 1).cast("int").alias("chapter_index"),
        (F.col("__kept") - 1).cast("int").alias("order_index"),
        "depth", "role", "source_title", "page_start", "page_end", "block_count",
    )
    # a chapter's rows lie together, so the rows' layout serves here too
    ranked = ordered_scan(making, ["doc_id", "segment"], "pos", {"before": ("sum", F.col("__size"))}, inclusive=False)
    return chapters, ranked.drop("__size", RANGE)


def reject_documents(violations: DataFrame) -> DataFrame:
    """(doc_id, pos, code) of the first violation of every rejected document."""
    first = F.struct("pos", "code")
    return violations.groupBy("doc_id").agg(F.min(first).alias("v")).select(
        "doc_id", "v.pos", "v.code"
    )


@dataclass
class Normalized:
    titles: DataFrame
    chapters: DataFrame
    blocks: DataFrame
    assets: DataFrame
    pages: DataFrame
    rejected: DataFrame


def normalize(
    raw: DataFrame, layout: DataFrame, assets: DataFrame, sources: DataFrame, ranges: int | None = None,
) -> Normalized:
    """The whole pipeline. ``sources``: doc_id, artifact_id, source_sha256.

    Rejected documents are reported and left out of every other output. Joins, layouts and scans run
    over the rows' shapes, which carry no text; the raw rows are read a second time at the end, where
    they meet their places in one shuffle and become blocks. Titles, chapters, blocks and rejections
    are written, so their consumers start from tables.
    """
    pages, bad_pages = page_sizes(layout)
    unique, aliases, bad_assets = canonical_assets(assets)
    # written before it is laid out, as finding the ranges reads its input twice
    seen = materialize(with_assets(with_boxes(row_shapes(raw), pages), aliases).drop("bbox", "page_idx", "img_path"), "shapes")
    laid = lay_out(seen, ["doc_id"], "pos", ranges)
    shapes = drop_layout_noise(laid)
    segmented = materialize(segment_chapters(shapes), "segmented")
    chapters, ranked = chapters_and_numbers(segmented)
    bad_sources = violation(
        sources,
        F.when(~F.col("source_sha256").rlike(HEX64), "invalid_source_hash")
        .when(utrim("artifact_id") == "", "empty_artifact_id"),
    )
    no_layout = sources.join(layout.select("doc_id"), "doc_id", "left_anti")
    problems = bad_sources.unionByName(violation(no_layout, F.lit("no_pages")))
    for code in ("box_code", "asset_code", "table_error"):
        problems = problems.unionByName(violation(laid, F.col(code), F.col("pos")))
    for more in (bad_pages, bad_assets):
        problems = problems.unionByName(more)
    # a few rows that every output is checked against
    first = materialize(reject_documents(problems), "violations")
    good = sources.join(first.select("doc_id"), "doc_id", "left_anti").select("doc_id", "artifact_id")
    named = name_chapters(chapters.join(good, "doc_id"))
    chapters = materialize(named, "chapters")
    blocks = materialize(make_blocks(raw, ranked, chapters), "blocks")
    # every chapter that is kept has a block
    empty = good.join(chapters.select("doc_id").distinct(), "doc_id", "left_anti")
    rejected = materialize(first.unionByName(violation(empty, F.lit("no_content"))), "rejected")
    gone = rejected.select("doc_id")
    return Normalized(
        titles=materialize(pick_title(shapes).join(gone, "doc_id", "left_anti"), "titles"),
        chapters=chapters, blocks=blocks,
        assets=unique.join(gone, "doc_id", "left_anti"),
        pages=pages.join(gone, "doc_id", "left_anti"),
        rejected=rejected,
    )


def name_chapters(chapters: DataFrame) -> DataFrame:
    """Ids that depend on place and title only; ``chapters`` carries artifact_id."""
    return chapters.withColumn(
        "chapter_id",
        stable_id("chapter", "artifact_id", "chapter_index", F.sha2("source_title", 256)),
    )


def make_blocks(raw: DataFrame, ranked: DataFrame, chapters: DataFrame) -> DataFrame:
    """Blocks with content and ids; ``ranked`` has the raw rows' places and ``chapters`` the chapters kept.

    Texts are shuffled once, by row, so a document of any size is spread evenly. The places are the
    small side, so rows need not be sorted to meet them.
    """
    ids = chapters.select(
        "doc_id", "segment", "artifact_id", "chapter_id", F.col("role").alias("chapter_role"),
        F.col("order_index").alias("chapter_order"),
    )
    placed = ranked.join(ids, ["doc_id", "segment"])
    texts = drop_layout_noise(raw).select("doc_id", "pos", *_TEXTS)
    rows = classify_text(texts.join(placed.hint("shuffle_hash"), ["doc_id", "pos"]))
    blocks, _ = expand_blocks(rows, carry=["before", "artifact_id", "chapter_id", "chapter_role", "chapter_order"])
    numbered = blocks.withColumn("order_index", (F.col("before") + F.col("nth")).cast("int")).drop("before", "nth")
    return attach_content(numbered).withColumn(
        "block_id", stable_id("block", "chapter_id", "order_index", "kind", "source_digest"))
