"""The document library: upsert, search, source drift, imports, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import ascii_lower, clean_text

# fixed values
DEFAULT_PAGE_SIZE = 30
MAX_PAGE_SIZE = 100
MAX_SOURCE_BYTES = 200 * 1024 * 1024
MAX_PAGES = 500
UNTITLED = "Untitled paper"
SCALE_KEYWORDS = ["auto", "page-actual", "page-fit", "page-width"]

_FIRST = ["id", "created_at"]


def upsert_documents(library: DataFrame, incoming: DataFrame, by_time: bool = False) -> DataFrame:
    """One row per content hash: the first id and created_at stay, the rest is the newest.

    ``incoming`` has the library's columns without created_at/updated_at, plus ``imported_at``. An
    import, the first or a repeated one, makes the file available and counts as opening it, whatever
    state and time ``incoming`` has. The aggregate combines on the map side, so a group of a billion copies
    costs one row per task. What the library holds counts as earlier than what comes in; with ``by_time``
    times alone decide, so that imports may come in batches in any order.
    """
    fields = [c for c in library.columns if c not in (*_FIRST, "sha256", "updated_at")]
    old = library.select(
        "sha256", "id", *fields, "created_at",
        F.lit(0).alias("__gen"), F.col("created_at").alias("__first"), F.col("updated_at").alias("__at"),
    )
    imported = {"file_state": F.lit("available"), "last_opened_at": F.col("imported_at")}
    new = incoming.select(
        "sha256", "id", *[imported.get(c, F.col(c)).alias(c) for c in fields], F.col("imported_at").alias("created_at"),
        F.lit(0 if by_time else 1).alias("__gen"), F.col("imported_at").alias("__first"), F.col("imported_at").alias("__at"),
    )
    picked = old.unionByName(new).groupBy("sha256").agg(
        F.min_by(F.struct("id", "created_at"), F.struct("__gen", "__first", "id")).alias("f"),
        F.max_by(F.struct(*fields, F.col("__at").alias("updated_at")), F.struct("__gen", "__at", "id")).alias("l"),
    )
    return picked.select("f.id", "sha256", *[f"l.{c}" for c in fields], "f.created_at",
                         "l.updated_at")


def import_outcomes(library: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each import with the surviving document id and whether it was a duplicate."""
    key = F.struct("imported_at", "id")
    first = incoming.groupBy("sha256").agg(
        F.min(key).alias("first_import")
    )
    known = library.select("sha256", F.col("id").alias("known_id"))
    firsts = first.join(known, "sha256", "left")
    return incoming.join(firsts, "sha256").select(
        F.col("id").alias("import_id"),
        "sha256",
        F.coalesce("known_id", "first_import.id").alias("document_id"),
        (F.col("known_id").isNotNull() | (key != F.col("first_import"))).alias("duplicate"),
    )


def like_pattern(text: str) -> str:
    """``%text%`` where % and _ keep their meaning and a backslash is only a backslash."""
    return "%" + text.replace("\\", "\\\\") + "%"


def query_library(
    library: DataFrame, text: str | None = None, sort: str = "recent",
    cursor: str | None = None, limit: int = DEFAULT_PAGE_SIZE,
) -> DataFrame:
    """One page of the library with ``position`` and the ``next_cursor`` of the page."""
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError("limit must be between 1 and 100")
    offset = int(cursor or 0)
    if offset < 0:
        raise ValueError("cursor must not be negative")
    found = library
    needle = (text or "").strip()
    if needle:
        pattern = ascii_lower(F.lit(like_pattern(needle)))
        authors = F.to_json("authors")
        found = found.filter(
            F.like(ascii_lower("title"), pattern) | F.like(ascii_lower(authors), pattern)
        )
    recency, title = F.col("last_opened_at").desc_nulls_last(), ascii_lower("title").asc()
    by_title, by_recency = [title, recency], [recency, title]
    # the id settles ties, so that paging never repeats or skips a row
    order = [*(by_title if sort == "title" else by_recency), F.col("id").asc()]
    page = found.orderBy(*order).offset(offset).limit(limit + 1)
    # at most limit+1 rows are numbered and gathered; the number keeps their order
    numbered = page.withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    rows = numbered.agg(F.array_sort(F.collect_list(F.struct("__n", F.struct(*library.columns).alias("r")))).alias("rs")).select(
        F.transform("rs", lambda x: x["r"]).alias("rows"))
    more = F.when(F.size("rows") > limit, F.lit(str(offset + limit)))
    return rows.select(
        F.posexplode(F.slice("rows", 1, limit)).alias("position", "row"), more.alias("next_cursor")
    ).select("position", "row.*", "next_cursor")


def summarize_documents(library: DataFrame) -> DataFrame:
    """Public columns, with the file's name instead of its path."""
    return library.select(
        "id", "title", "authors", "page_count",
        F.element_at(F.split("file_path", "/", -1), -1).alias("file_name"),
        "file_size_bytes", "file_state", "last_opened_at",
    )


def refresh_sources(library: DataFrame, inventory: DataFrame) -> DataFrame:
    """Documents whose source moved between states, with old and new state.

    Only rows that fail the cheap size/mtime test look at the inventory's hash.
    """
    inv = inventory.select(
        F.col("path").alias("file_path"), F.col("length").alias("__len"),
        F.col("mtime_ms").alias("__mtime"), F.col("sha256").alias("__sha"),
        F.col("has_header").alias("__header"), F.col("readable").alias("__readable"),
        F.lit(True).alias("__found"),
    )
    joined = library.join(inv, "file_path", "left")
    cheap = (
        (F.col("__len") == F.col("file_size_bytes"))
        & (F.col("__mtime") == F.col("file_mtime_ms"))
        & (F.col("file_state") == "available")
    )
    same = (F.col("__sha") == F.col("sha256")) & F.col("__header")
    gone = F.col("__found").isNull() | ~F.col("__readable")
    state = (
        F.when(F.col("__found").isNull(), "missing")
        .when(~F.col("__readable"), "unreadable")
        .when(cheap, "available")
        .when(same, "available")
        .otherwise("changed")
    )
    out = joined.select(
        "id", F.col("file_state").alias("old_state"), state.alias("file_state"),
        F.when(gone, F.col("file_size_bytes")).otherwise(F.col("__len")).alias("file_size_bytes"),
        F.when(gone, F.col("file_mtime_ms")).otherwise(F.col("__mtime")).alias("file_mtime_ms"),
        F.col("file_size_bytes").alias("__old_size"), F.col("file_mtime_ms").alias("__old_mtime"),
    )
    changed = ~(
        F.col("old_state").eqNullSafe(F.col("file_state"))
        & F.col("__old_size").eqNullSafe(F.col("file_size_bytes"))
        & F.col("__old_mtime").eqNullSafe(F.col("file_mtime_ms"))
    )
    return out.filter(changed).drop("__old_size", "__old_mtime")


def sources_to_hash(library: DataFrame, listing: DataFrame) -> DataFrame:
    """First pass of the drift check: paths whose content must be hashed at all."""
    known = library.filter("file_state = 'available'").select(
        F.col("file_path").alias("path"), F.col("file_size_bytes").alias("length"),
        F.col("file_mtime_ms").alias("mtime_ms"),
    )
    wanted = library.select(F.col("file_path").alias("path"))
    return listing.join(wanted, "path", "left_semi").join(
        known, ["path", "length", "mtime_ms"], "left_anti"
    )


def relocate(library: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (id, new_path, sha256): taken only if the content is the same."""
    ok = F.col("m.sha256") == F.col("l.sha256")
    return library.alias("l").join(moves.alias("m"), "id").select(
        "id",
        F.when(ok, F.col("m.new_path")).otherwise(F.col("l.file_path")).alias("file_path"),
        F.when(ok, F.lit("available")).otherwise(F.col("l.file_state")).alias("file_state"),
        F.when(~ok, F.lit("document_changed")).alias("error_code"),
    )


# child table -> (key column, parent table): fixed cascade order
CASCADES = {
    "jobs": ("document_id", "documents"),
    "parse_operations": ("document_id", "documents"),
    "parse_artifacts": ("document_id", "documents"),
    "chapters": ("artifact_id", "parse_artifacts"),
    "blocks": ("chapter_id", "chapters"),
    "translations": ("block_id", "blocks"),
    "reading_positions": ("document_id", "documents"),
    "reading_conversations": ("document_id", "documents"),
    "reading_messages": ("conversation_id", "reading_conversations"),
    "reading_citations": ("message_id", "reading_messages"),
}


def remove_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the removed documents and all that hangs below them.

    A child row goes when its parent row was removed; the removed keys travel down the
    hierarchy, not the surviving ones, which keeps the join sides small. A table with
    children of its own is told apart in one join, whose shuffle serves its rows and theirs.
    """
    gone = {"documents": ids.select(F.col("id")).distinct()}
    out = {"documents": tables["documents"].join(gone["documents"], "id", "left_anti")}
    parents = {parent for child, (_, parent) in CASCADES.items() if child in tables}
    for child, (key, parent) in CASCADES.items():
        if child not in tables or parent not in gone:
            continue
        dead = gone[parent].withColumnRenamed("id", key)
        if child in parents and "id" in tables[child].columns:
            marked = _marked(tables[child], dead, key)
            out[child] = marked.filter("NOT __gone").drop("__gone")
            gone[child] = marked.filter("__gone").select("id").distinct()
        else:
            out[child] = tables[child].join(dead, key, "left_anti")
    return out


def _marked(rows: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """Rows with ``__gone``: their key is one of ``dead``, whose keys are distinct.

    Rows leave the join by ``inline``, below which no reader's filters are moved: what reads the rows
    that stay and what reads those that go then need the same shuffle, which Spark makes once.
    """
    joined = rows.join(dead.withColumn("__dead", F.lit(True)), key, "left")
    row = F.struct(key, *[c for c in rows.columns if c != key], F.coalesce("__dead", F.lit(False)).alias("__gone"))
    return joined.select(F.inline(F.array(row)))


def orphan_files(inventory: DataFrame, library: DataFrame) -> DataFrame:
    """Managed files no document points at."""
    known = library.select(F.col("file_path").alias("path"))
    return inventory.join(known, "path", "left_anti").select("path", "length")


def reconcile_quarantine(manifests: DataFrame, library: DataFrame) -> DataFrame:
    """Quarantined deletions: restore if the document is still there, else purge."""
    present = library.select(F.col("id").alias("document_id"), F.lit(True).alias("__here"))
    return manifests.join(present, "document_id", "left").select(
        *manifests.columns,
        F.when(F.col("__here"), "restore").otherwise("purge").alias("outcome"),
    )


def dedupe_selection(files: DataFrame, order: str = "ord") -> DataFrame:
    """First of each (name, size, last_modified) in selection order."""
    keys = ["name", "size", "last_modified"]
    rest = [c for c in files.columns if c not in keys]
    return files.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("r")
    ).select(*keys, "r.*").select(*files.columns)


def import_summary(results: DataFrame) -> DataFrame:
    """Per batch: counts, first failure text and the kind of notice to show."""
    failed = F.col("error").isNotNull()
    agg = results.groupBy("batch_id").agg(
        F.count_if(~failed & ~F.col("duplicate")).alias("imported"),
        F.count_if(~failed & F.col("duplicate")).alias("duplicates"),
        F.count_if(failed).alias("failures"),
        F.min_by("error", F.when(failed, F.col("ord"))).alias("first_failure"),
    )
    done = F.col("imported") + F.col("duplicates")
    kind = (
        F.when(F.col("failures") == 0, "success")
        .when(done > 0, "warning")
        .otherwise("error")
    )
    return agg.withColumn("kind", kind)


def validate_imports(
    inventory: DataFrame, max_bytes: int = MAX_SOURCE_BYTES, max_pages: int = MAX_PAGES
) -> DataFrame:
    """First rejection code per file, null when it may be imported."""
    ext = ascii_lower(F.regexp_extract("path", r"[^/]\.([^./]+)\z", 1))
    code = (
        F.when(ext != "pdf", "unsupported_file_type")
        .when(F.col("length") > max_bytes, "pdf_too_large")
        .when(~F.col("has_header"), "invalid_pdf")
        .when(F.coalesce("page_count", F.lit(0)) == 0, "invalid_pdf")
        .when(F.col("page_count") > max_pages, "pdf_too_many_pages")
        .when(
            (F.col("length") != F.col("final_length"))
            | (F.col("mtime_ms") != F.col("final_mtime_ms")),
            "source_unreadable",
        )
    )
    return inventory.select("path", code.alias("error_code"))


def metadata_text(value: Column) -> Column:
    return F.substring(clean_text(value), 1, 1000)


def safe_file_stem(name: Column) -> Column:
    """At most 120 characters, only letters, digits and `` ._-()[]``; never empty."""
    base = F.element_at(F.split(name, "/", -1), -1)
    stem = F.regexp_replace(F.substring(F.regexp_replace(base, r"(?s)(?<=.)\.[^.]*\z", ""), 1, 120),
                            r"[^\p{IsAlphabetic}\p{N} ._\-()\[\]]", "_")
    trimmed = F.regexp_replace(stem, r"^[ .]+|[ .]+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("paper"))


def clean_names(df: DataFrame) -> DataFrame:
    """Adds ``clean_title`` and ``safe_name`` from metadata_title and file_path."""
    base = F.element_at(F.split("file_path", "/", -1), -1)
    stem = F.regexp_replace(base, r"(?s)(?<=.)\.[^.]*\z", "")
    title = F.coalesce(
        F.nullif(metadata_text(F.col("metadata_title")), F.lit("")),
        F.nullif(metadata_text(stem), F.lit("")),
        F.lit(UNTITLED),
    )
    return df.withColumn("clean_title", title).withColumn(
        "safe_name", F.concat(safe_file_stem(F.col("file_path")), F.lit(".pdf"))
    )


def touch_opened(library: DataFrame, opens: DataFrame) -> DataFrame:
    """last_opened_at and updated_at become the latest open time (document_id, opened_at)."""
    last = opens.groupBy(F.col("document_id").alias("id")).agg(
        F.max("opened_at").alias("__opened")
    )
    return library.join(last, "id", "left").select(
        *[
            F.coalesce("__opened", c).alias(c) if c in ("last_opened_at", "updated_at") else F.col(c)
            for c in library.columns
        ]
    )


def position_errors(positions: DataFrame) -> Column:
    """Error code of a reading position, null if valid (needs page_count)."""
    scale = F.expr("try_cast(scale_value AS double)")
    ratio = F.col("page_offset_ratio")
    scale_ok = F.col("scale_value").isin(SCALE_KEYWORDS) | F.coalesce(
        scale.between(0.25, 5.0) & ~F.isnan(scale), F.lit(False)
    )
    return (
        F.when((F.col("page") < 1) | (F.col("page") > F.col("page_count")), "page_out_of_range")
        .when(F.isnan(ratio) | ~ratio.between(0.0, 1.0), "offset_out_of_range")
        .when(~scale_ok, "scale_invalid")
    )


def split_positions(updates: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid updates, rejected updates with error_code). Unknown documents are rejected."""
    pages = library.select(F.col("id").alias("document_id"), "page_count", F.lit(1).alias("__k"))
    checked = updates.join(pages, "document_id", "left").withColumn(
        "error_code",
        F.when(F.col("__k").isNull(), "document_not_found").otherwise(position_errors(updates)),
    ).drop("__k", "page_count")
    return (
        checked.filter("error_code IS NULL").drop("error_code"),
        checked.filter("error_code IS NOT NULL"),
    )


def upsert_positions(positions: DataFrame, updates: DataFrame, library: DataFrame) -> DataFrame:
    """Last valid write per document wins."""
    valid, _ = split_positions(updates, library)
    fields = [c for c in positions.columns if c != "document_id"]
    both = positions.withColumn("__new", F.lit(0)).unionByName(
        valid.select(*positions.columns, F.lit(1).alias("__new"))
    )
    order = F.struct("updated_at", "__new", *[c for c in fields if c != "updated_at"])
    return both.groupBy("document_id").agg(
        F.max_by(F.struct(*fields), order).alias("p")
    ).select("document_id", "p.*")


def load_positions(library: DataFrame, positions: DataFrame) -> DataFrame:
    """A position for every document; page 1, ratio 0, ``page-width`` where none is stored."""
    return library.select(F.col("id").alias("document_id")).join(
        positions, "document_id", "left"
    ).select(
        "document_id",
        F.coalesce("page", F.lit(1)).alias("page"),
        F.coalesce("page_offset_ratio", F.lit(0.0)).alias("page_offset_ratio"),
        F.coalesce("scale_value", F.lit("page-width")).alias("scale_value"),
    )
