"""Over normalized blocks: document values, digests, offsets, term index, archive audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.atoms import atom_text, leaf_text, plain_text, strip_marks, without_marks
from docloom.functions.digest import ordered_digest
from docloom.functions.scan import ordered_scan
from docloom.functions.text import ascii_lower, is_blank, utf16_len
from docloom.schemas import (
    BLOCK_VALUE, CANONICAL_SCHEMA_VERSION, DOCUMENT_VALUE, NORMALIZER_VERSION, PARSER_BACKEND, PARSER_NAME, PARSER_VERSION,
    TRANSLATABLE_KINDS,
)

# fixed values
ARCHIVE_MAX_ENTRIES = 4096
ARCHIVE_MIN_EXPANDED = 16 * 1024 * 1024
ARCHIVE_MAX_EXPANDED = 1_000_000_000
ARCHIVE_MAX_FILE = 256 * 1024 * 1024
CONTENT_LIST_SUFFIX = "_content_list.json"
OTHER_LIST_SUFFIX = "_content_list_v2.json"
LAYOUT_NAME = "layout.json"
ASSET_EXTENSIONS = ["png", "jpg", "jpeg", "webp"]


#: Folders of a stored term index.
TERM_BUCKETS = 64
#: The folder of the blocks' ids.
IDS = -1
# a document's JSON is kept in pieces; those after all chapters have this chapter number
AFTER_CHAPTERS = 2**31 - 1
LAST = 2**62


def _pieces(df: DataFrame, kind: str, chapter: Column, at: Column, value: Column) -> DataFrame:
    return df.select("doc_id", "artifact_id", F.struct(
        chapter.cast("long").alias("chapter"), at.cast("long").alias("at")).alias("place"), F.lit(kind).alias("kind"), value.alias("value"))


def _open_json(value: Column, name: str) -> Column:
    """A JSON object with one more field, an array that is still open."""
    return F.concat(F.regexp_replace(F.to_json(value), r"\}$", ""), F.lit(f',"{name}":['))


def document_pieces(n, sources: DataFrame) -> DataFrame:
    """(doc_id, artifact_id, place, kind, value): every document's canonical JSON, cut up.

    The values of a document, joined in order of place, are its JSON (``n`` is a ``Normalized``).
    There is a piece for the head, one to open and one to close each chapter, one for each block and
    asset and one for the tail, so no row is larger than a block, whatever the document's size.
    """
    here = n.chapters.select("doc_id", "artifact_id").distinct()
    pages = n.pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    heads = sources.join(here.select("artifact_id"), "artifact_id", "left_semi").join(pages, "doc_id").join(
        n.titles.select("doc_id", "title"), "doc_id", "left")
    head = _open_json(F.struct(
        F.lit(CANONICAL_SCHEMA_VERSION).alias("schemaVersion"), F.col("artifact_id").alias("artifactId"),
        F.col("doc_id").cast("string").alias("documentId"), F.col("source_sha256").alias("sourceSha256"),
        F.struct(F.lit(PARSER_NAME).alias("name"), F.lit(PARSER_VERSION).alias("version"),
                 F.lit(PARSER_BACKEND).alias("backend")).alias("parser"),
        F.lit(NORMALIZER_VERSION).alias("normalizerVersion"), F.col("page_count").alias("pageCount"), "title"), "chapters")
    comma = lambda first: F.when(first, F.lit("")).otherwise(F.lit(","))
    chapter = _open_json(F.struct(
        F.col("chapter_id").alias("id"), F.col("order_index").alias("orderIndex"), "depth", "role",
        F.col("source_title").alias("sourceTitle"), F.col("page_start").alias("pageStart"), F.col("page_end").alias("pageEnd")), "blocks")
    block = F.to_json(F.struct(
        F.col("block_id").alias("id"), F.col("order_index").alias("orderIndex"), "kind",
        F.col("page").alias("pageStart"), F.col("page").alias("pageEnd"),
        F.array_compact(F.array("box")).alias("boundingBoxes"), "content", F.col("source_digest").alias("sourceDigest")))
    asset = F.to_json(F.struct(
        "id", F.col("mime_type").alias("mimeType"), F.col("relative_path").alias("relativePath"), "sha256", F.col("size_bytes").alias("sizeBytes")))
    order, start = F.col("order_index"), F.lit(-1)
    assets = n.assets.join(n.assets.groupBy("doc_id").agg(F.min("pos").alias("__first")), "doc_id").join(here, "doc_id")
    after = F.lit(AFTER_CHAPTERS)
    return (
        _pieces(heads, "head", start, start, head)
        .unionByName(_pieces(n.chapters, "chapter", order, start, F.concat(comma(order == 0), chapter)))
        .unionByName(_pieces(n.blocks, "block", F.col("chapter_order"), order, F.concat(comma(order == 0), block)))
        .unionByName(_pieces(n.chapters, "end", order, F.lit(LAST), F.lit("]}")))
        .unionByName(_pieces(here, "assets", after, start, F.lit('],"assets":[')))
        .unionByName(_pieces(assets, "asset", after, F.col("pos"), F.concat(comma(F.col("pos") == F.col("__first")), asset)))
        .unionByName(_pieces(here, "tail", after, F.lit(LAST), F.lit("]}"))))


def _value(kind: Column | str) -> Column:
    """The JSON of a block, chapter or asset piece by itself."""
    return F.regexp_replace(kind, "^,", "")


def assemble_documents(pieces: DataFrame) -> DataFrame:
    """One row per document: title, page, chapter and block counts, first asset, digest of the block
    ids in order and digest of the JSON. The JSON itself stays in pieces."""
    head = F.from_json(F.concat("value", F.lit("]}")), DOCUMENT_VALUE)
    heads = pieces.filter("kind = 'head'").select("doc_id", "artifact_id", head.alias("h")).select(
        "doc_id", "artifact_id", F.col("h.title").alias("title"), F.col("h.pageCount").alias("page_count"))
    counts = pieces.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "block").alias("block_count"), F.count_if(F.col("kind") == "chapter").cast("int").alias("chapter_count"),
        F.min_by(F.when(F.col("kind") == "asset", F.get_json_object(_value("value"), "$.relativePath")),
                 F.when(F.col("kind") == "asset", F.col("place"))).alias("first_asset"))
    ids = pieces.filter("kind = 'block'").withColumn("id", F.get_json_object(_value("value"), "$.id"))
    # ids follow one another with commas; the document's first block is that of its first chapter
    first = (F.col("place.chapter") == 0) & (F.col("place.at") == 0)
    order = ordered_digest(ids, ["doc_id"], "place", F.encode(F.concat(F.when(first, "").otherwise(","), "id"), "UTF-8"), None, "order_digest")
    whole = ordered_digest(pieces, ["doc_id"], "place", F.encode("value", "UTF-8"), None, "content_digest")
    return heads.join(counts, "doc_id").join(order, "doc_id").join(whole, "doc_id")


def find_blocks(pieces: DataFrame) -> DataFrame:
    """Documents in pieces back to one row per block."""
    at = F.col("place.chapter").alias("__chapter")
    chapters = pieces.filter("kind = 'chapter'").select(
        "doc_id", "artifact_id", at, F.get_json_object(F.concat(_value("value"), F.lit("]}")), "$.id").alias("chapter_id"))
    return pieces.filter("kind = 'block'").select(
        "doc_id", "artifact_id", at, F.from_json(_value("value"), BLOCK_VALUE).alias("b")).join(
        chapters, ["doc_id", "artifact_id", "__chapter"]).select("doc_id", "chapter_id", "b.*")


def chapter_digests(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """sha256 of the title, then a zero byte and the source digest of each block in order."""
    part = F.concat(F.unhex(F.lit("00")), F.encode("source_digest", "UTF-8"))
    titled = blocks.join(chapters.select("doc_id", "chapter_id", "source_title"), ["doc_id", "chapter_id"])
    return ordered_digest(
        titled, ["doc_id", "chapter_id"], "order_index", part, F.encode("source_title", "UTF-8"),
        "chapter_digest",
    )


def translatable(kind: Column, content: Column) -> Column:
    """Whether a translator should see the block: right kind and some non-blank text."""
    def has_text(atom: Column) -> Column:
        return (atom["type"] == "text") & ~is_blank(atom["value"])

    atoms = content["atoms"]
    any_text = F.exists(atoms, lambda a: F.coalesce(has_text(a), F.lit(False)) | F.coalesce(
        F.exists(a["rows"], lambda r: F.exists(r, lambda c: F.exists(
            c["content"], lambda x: F.coalesce(has_text(x), F.lit(False))))), F.lit(False)))
    bare = (F.size(atoms) == 0) & ~is_blank(content["plainText"])
    return kind.isin(TRANSLATABLE_KINDS) & (bare | any_text)


def flag_translatable(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("translatable", translatable(F.col("kind"), F.col("content")))


def block_plain_text(blocks: DataFrame) -> DataFrame:
    """Reading text rebuilt from the atoms (table cells are separated by `` | ``)."""
    return blocks.withColumn("plain_text", plain_text(F.col("content.atoms")))


def atom_offsets(blocks: DataFrame) -> DataFrame:
    """One row per visible leaf atom with its UTF-16 [start_utf16, end_utf16) in the plain text.

    Each block is one row, so its running offset is folded over its own atoms. What separates cells
    and rows is a piece of its own, without a type: empty cells are counted, but give no row.
    """
    def pieces(atom: Column) -> Column:
        def cell(c: Column, ci: Column, ri: Column) -> Column:
            gap = F.when(ci > 0, 3).when(ri > 0, 1).otherwise(0)
            return F.concat(
                F.array(F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("type"), gap.alias("gap"))),
                F.transform(c["content"], lambda x: F.struct(leaf_text(x).alias("text"), x["type"].alias("type"), F.lit(0).alias("gap"))))

        cells = F.flatten(F.transform(atom["rows"], lambda r, ri: F.flatten(F.transform(r, lambda c, ci: cell(c, ci, ri)))))
        one = F.array(F.struct(atom_text(atom).alias("text"), atom["type"].alias("type"), F.lit(0).alias("gap")))
        return F.when(atom["type"] == "table", cells).otherwise(one)

    flat = F.flatten(F.transform("content.atoms", lambda a, i: F.transform(pieces(a), lambda p: F.struct(
        i.alias("atom_index"), p["text"].alias("text"), p["type"].alias("type"), p["gap"].alias("gap")))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(
        "array<struct<atom_index:int,type:string,text:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = (start + utf16_len(p["text"])).cast("int")
        row = F.struct(p["atom_index"].alias("atom_index"), p["type"].alias("type"), p["text"].alias("text"),
                       start.cast("int").alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["type"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    spans = F.aggregate(flat, zero, step, lambda acc: acc["out"])
    return blocks.select("doc_id", "block_id", F.posexplode(spans).alias("leaf_index", "a")).select(
        "doc_id", "block_id", "leaf_index", "a.atom_index", "a.type", "a.text",
        F.col("a.start").alias("start_utf16"), F.col("a.end").alias("end_utf16"),
    )


def _tokens(text: str) -> Column:
    """Distinct letter/digit runs, lower-cased, without diacritics."""
    ascii_only = ~F.col(text).rlike(r"[^\x00-\x7F]")
    folded = F.when(ascii_only, F.col(text)).otherwise(
        strip_marks(F.when(~ascii_only, F.col(text)))
    )
    return F.array_distinct(F.regexp_extract_all(F.lower(folded), F.lit(r"([\p{L}\p{N}]+)"), 1))


def block_terms(blocks: DataFrame, text: str = "plain_text") -> DataFrame:
    """(block_id, term): distinct letter/digit runs, lower-cased, without diacritics."""
    return blocks.select("block_id", F.explode(_tokens(text)).alias("term"))


def write_term_index(blocks: DataFrame, path: str, text: str = "plain_text", buckets: int = TERM_BUCKETS) -> str:
    """Store the postings (term, block) in ``path``, in folders by the term's hash.

    A posting holds its block's number; ids stand beside the numbers in a folder of their own. Every task
    numbers the blocks it reads, sorts their postings by term and writes ids and postings as its own files,
    so postings are not shuffled and a number never parts from its id. Files carry a Bloom filter of their
    terms: a reader opens one folder and reads the few pages with its term. Postings stay rows: a term in a
    third of all blocks would not fit an array.
    """
    numbered = blocks.select(F.monotonically_increasing_id().alias("block"), "block_id", F.col(text).alias("__text"))
    none = F.lit(None).cast("string")
    rows = F.concat(
        F.array(F.struct(none.alias("term"), F.col("block_id").alias("block_id"))),
        F.transform(F.coalesce(_tokens("__text"), F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), none.alias("block_id"))))
    bucket = F.when(F.col("term").isNull(), IDS).otherwise(term_bucket(F.col("term"), buckets))
    numbered.select("block", F.inline(rows)).withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "block").write.partitionBy(
        "bucket").option("compression", "zstd").option("parquet.bloom.filter.enabled#term", "true").option("parquet.block.size", 16 << 20).parquet(path)
    return path


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def read_term_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, block long, block_id string, bucket int").parquet(path)


def term_statistics(blocks: DataFrame, text: str = "plain_text") -> DataFrame:
    return block_terms(blocks, text).groupBy("term").agg(F.count(F.lit(1)).alias("block_count"))


def match_terms(index: DataFrame, terms: list[str], buckets: int = TERM_BUCKETS) -> DataFrame:
    """(block_id) of the blocks with all terms, from a stored index.

    Terms are folded as the index's are, and looked up by their folders and by a filter that the file
    reader gets; no text is read. No term, or one that is no term, matches nothing.
    """
    folded = sorted({without_marks(t.lower()) for t in terms})
    keys = index.sparkSession.createDataFrame([(t,) for t in folded], "term string").select(term_bucket(F.col("term"), buckets))
    found = sorted({r[0] for r in keys.collect()})
    hits = index.filter(F.col("bucket").isin(found) & F.col("term").isin(folded)).select("block")
    whole = hits.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") == len(folded)).select("block")
    return index.filter(F.col("bucket") == IDS).select("block", "block_id").join(whole, "block").select("block_id")


def match_term(index: DataFrame, term: str, buckets: int = TERM_BUCKETS) -> DataFrame:
    return match_terms(index, [term], buckets)


def audit_archive_entries(entries: DataFrame) -> DataFrame:
    """First violated rule per archive (null = fine), with entry count and expanded size.

    Entries: archive_id, entry_index, path, size_bytes, unix_mode, is_dir, source_size_bytes.
    The first entry that breaks a rule decides, as if entries were read in order; totals and
    the two mandatory files are judged after that.
    """
    p = F.col("path")
    parts = F.filter(F.split(p, r"[/\\]", -1), lambda x: (x != "") & (x != "."))
    depth, name = F.size(parts), F.element_at(parts, -1)
    safe = (
        (F.size(parts) > 0) & ~p.startswith("/") & ~p.startswith("\\") & ~F.array_contains(parts, "..")
        & ~p.contains("\u0000") & ~p.rlike("^[A-Za-z]:")
    )
    mode = F.coalesce(F.col("unix_mode"), F.lit(0)).bitwiseAND(0o170000)
    limit = F.greatest(F.col("source_size_bytes") * 10, F.lit(ARCHIVE_MIN_EXPANDED))
    total_limit = F.least(limit, F.lit(ARCHIVE_MAX_EXPANDED))
    file_limit = F.least(limit, F.lit(ARCHIVE_MAX_FILE))
    image = (depth == 2) & (parts[0] == "images")
    ext = ascii_lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", "")
    kind = (
        F.when((depth == 1) & (name == LAYOUT_NAME), "layout")
        .when((depth == 1) & name.endswith(CONTENT_LIST_SUFFIX) & ~name.endswith(OTHER_LIST_SUFFIX), "content_list")
        .when(image, "asset")
    )
    e = entries.select(
        "archive_id", "entry_index", "size_bytes", "is_dir", total_limit.alias("total_limit"),
        file_limit.alias("file_limit"), kind.alias("kind"), ascii_lower(F.array_join(parts, "/")).alias("key"),
        (~safe).alias("unsafe"), (~mode.isin(0, 0o100000, 0o040000)).alias("special"),
        (image & ~stem.rlike("^[0-9a-fA-F]{64}$")).alias("bad_stem"),
        (image & ~ext.isin(ASSET_EXTENSIONS)).alias("bad_ext"),
    )
    # repeats: every later entry with the key of an earlier kept file
    first = e.filter("NOT is_dir AND kind IS NOT NULL").groupBy("archive_id", "key").agg(
        F.min("entry_index").alias("first_index"))
    again = e.filter("NOT is_dir AND kind IS NOT NULL").join(first, ["archive_id", "key"]).filter(
        "entry_index > first_index").groupBy("archive_id").agg(F.min("entry_index").alias("dup_index"))
    # an archive above the entry limit is refused whatever its sizes are
    grown = ordered_scan(
        e.withColumn("entry_index", F.col("entry_index").cast("long")), ["archive_id"], "entry_index",
        {"running": ("sum", F.when(~F.col("is_dir"), F.col("size_bytes")).otherwise(0))},
    )
    rule = (
        F.when(F.col("unsafe"), "unsafe_path").when(F.col("special"), "link_or_special")
        .when(F.col("is_dir"), None).when(F.col("size_bytes") > F.col("file_limit"), "file_too_large")
        .when(F.col("running") > F.col("total_limit"), "archive_too_large")
        .when(F.col("bad_stem"), "invalid_asset_name").when(F.col("bad_ext"), "unsupported_image_type")
    )
    flagged = grown.withColumn("rule", rule)
    per = flagged.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.sum(F.when(~F.col("is_dir"), F.col("size_bytes")).otherwise(0)).alias("expanded_bytes"),
        F.min(F.when(F.col("rule").isNotNull(), F.struct("entry_index", "rule"))).alias("bad"),
        F.count_if((F.col("kind") == "content_list") & ~F.col("is_dir")).alias("lists"),
        F.count_if((F.col("kind") == "layout") & ~F.col("is_dir")).alias("layouts"),
    ).join(again, "archive_id", "left")
    dup_first = F.col("dup_index").isNotNull() & (
        F.col("bad.entry_index").isNull() | (F.col("dup_index") < F.col("bad.entry_index")))
    return per.select(
        "archive_id", "entry_count", "expanded_bytes",
        F.when(F.col("entry_count") > ARCHIVE_MAX_ENTRIES, "too_many_entries")
        .when(dup_first, "duplicate_path").when(F.col("bad").isNotNull(), F.col("bad.rule"))
        .when(F.col("lists") != 1, "content_list_count").when(F.col("layouts") != 1, "layout_count")
        .alias("error_code"),
    )
