"""Readers of files: PDF inventories, parser output, image assets."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.functions.stage import materialize
from docloom.functions.text import ascii_lower
from docloom.schemas import LAYOUT, RAW_BLOCK

# fixed values
PDF_MARK = "%PDF-"
HEADER_BYTES = 1024
HEAD_BYTES = 12
CONTENT_LIST = "content_list.json"
LAYOUT_FILE = "layout.json"
# extension -> MIME type
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


#: Bytes of a file that a task holds at a time.
PIECE_BYTES = 4 * 1024 * 1024
#: Bytes of files for one task, and the least number of tasks for each core.
TASK_BYTES = 64 * 1024 * 1024
TASKS_A_CORE = 4


# ---- listing, opening, writing ---------------------------------------------------------
@lru_cache(16)
def _file_system(root: str):
    """File system of ``scheme://authority/`` and where its paths begin."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def locate(path: str):
    """Arrow's file system and path for a path as Spark writes it (``file:/a b``, ``hdfs://host/a``, ``/a``)."""
    scheme, rest = re.fullmatch(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(.*)", path).groups()
    authority, place = re.fullmatch(r"(?s)(?://([^/]*))?(.*)", rest).groups()
    system, base = _file_system(f"{scheme or 'file'}://{authority or ''}/")
    return system, base + place


def open_file(path: str) -> BinaryIO:
    """The file as a stream; what a task opens where no other ``opener`` is given."""
    system, place = locate(path)
    return system.open_input_stream(place)


def list_files(spark: SparkSession, glob: str, hidden_folders: bool = False) -> DataFrame:
    """path, length, mtime_ms of files below ``glob``; none of them is opened, and empty ones are left out.

    Folders are listed by tasks, level by level, and the listing is written: neither the driver nor the
    plan of a later read holds the names. Names that Spark's readers pass over are passed over here; with
    ``hidden_folders`` only those of files. A store that Arrow does not know is listed by Spark.
    """
    path = _qualified(spark, glob)
    fixed = re.match(r"[^*?\[{]*/(?=[^/]*[*?\[{])", path)
    root = fixed.group().rstrip("/") if fixed else path
    try:
        locate(root)
    except (pa.ArrowInvalid, OSError, ValueError):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
        return files.select("path", "length", F.unix_millis("modificationTime").alias("mtime_ms"))

    through = hidden_folders or fixed is not None

    def hidden(name: str, folder: bool) -> bool:
        return not (folder and through) and (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("path").to_pylist():
                system, place = locate(folder)
                itself = system.get_file_info(place)
                if itself.type == fs.FileType.File:
                    found = [(folder, itself)]
                else:
                    # a folder that is gone by now has no files
                    found = [(f"{folder}/{i.base_name}", i) for i in system.get_file_info(fs.FileSelector(place, allow_not_found=True))]
                rows = [(p, i.size or 0, (i.mtime_ns or 0) // 1_000_000, i.type == fs.FileType.Directory) for p, i in found
                        if not hidden(i.base_name, i.type == fs.FileType.Directory)]
                for at in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[at:at + 10_000]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()))],
                        names=["path", "length", "mtime_ms", "folder"])

    level, listing = spark.createDataFrame([(root,)], "path string").coalesce(1), None
    while True:
        found = materialize(level.mapInArrow(children, "path string, length long, mtime_ms long, folder boolean"), "listing")
        listing = found if listing is None else listing.unionByName(found)
        deeper = found.filter("folder").select("path")
        if deeper.isEmpty():
            break
        level = deeper.repartition(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    files = listing.filter("NOT folder AND length > 0")
    if fixed:
        files = files.filter(F.col("path").rlike(_glob_pattern(path)))
    return files.select("path", "length", "mtime_ms")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark writes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _glob_pattern(glob: str) -> str:
    """A pattern of the paths that a glob finds, or that lie below them."""
    signs = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}
    out, depth = "", 0
    for part in re.findall(r"\[[^\]]*\]|.", glob, re.DOTALL):
        if part.startswith("[") and len(part) > 1:
            out += part
        elif part in "*?{" or (depth and part in "},"):
            out, depth = out + signs[part], depth + (part == "{") - (part == "}")
        else:
            out += re.sub(r"([^A-Za-z0-9_/])", r"\\\1", part)
    # below what the glob finds, hidden folders are passed over
    return f"(?s)^{out}(/(?![.]|_[^=/]*(/|$))[^/]+)*$"


def dealt(files: DataFrame) -> DataFrame:
    """A listing dealt over tasks that open its files: some for each core, more for more bytes."""
    total = files.agg(F.sum("length")).first()[0] or 0
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(TASKS_A_CORE * cores, total // TASK_BYTES))


def read_files(files: DataFrame, head_bytes: int, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """Adds sha256, the first ``head_bytes`` bytes as ``head``, ``read_bytes`` and ``readable``.

    Files stream through their task in pieces, so that none has to fit into a row or has a limit of
    size. One that cannot be read, or is gone since it was listed, has ``readable`` false and nulls.
    """
    schema = StructType([*files.schema.fields, *StructType.fromDDL("sha256 string, head binary, read_bytes long, readable boolean").fields])

    def one(path: str) -> tuple[str | None, bytes | None, int | None, bool]:
        digest, head, total = hashlib.sha256(), b"", 0
        try:
            with opener(path) as stream:
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
                    head += piece[:head_bytes - len(head)]
                    total += len(piece)
        except OSError:
            return None, None, None, False
        return digest.hexdigest(), head, total, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(p) for p in batch.column("path").to_pylist()]
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.bool_())
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "sha256", "head", "read_bytes", "readable"])

    return files.mapInArrow(run, schema)


def read_texts(files: DataFrame, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """(path, text) of whole files; one that is gone since it was listed has no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        texts: list[bytes] = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with opener(path) as stream:
                        texts.append(stream.read())
                except FileNotFoundError:
                    continue
                names.append(path)
                if sum(map(len, texts)) > PIECE_BYTES or len(texts) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["path", "text"])
                    names, texts = [], []
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["path", "text"])

    return files.select("path").mapInArrow(run, "path string, text binary").select("path", F.col("text").cast("string").alias("text"))


def write_files(rows: DataFrame, root: str) -> int:
    """Write each row's ``content`` (binary) as the file ``root``/``path``; returns how many.

    Paths must be distinct. A file appears whole under its name, so a task that runs twice, or two
    that run at once, leave the same files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                system, place = locate(f"{root}/{path}")
                folder = place.rsplit("/", 1)[0]
                system.create_dir(folder)
                # a name that readers pass over
                draft = f"{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as stream:
                    stream.write(content or b"")
                system.move(draft, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    done = rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    return done or 0


def scan_pdf_inventory(
    spark: SparkSession, glob: str, only: DataFrame | None = None, opener: Callable[[str], BinaryIO] = open_file,
) -> DataFrame:
    """path, length, mtime_ms, sha256, has_header, readable of PDFs.

    ``only`` (path) narrows the files to open, as ``library.sources_to_hash`` finds them in a listing:
    a library of unchanged files is listed, and only what changed is read.
    """
    files = list_files(spark, glob)
    if only is not None:
        files = files.join(only.select("path").distinct(), "path", "left_semi")
    head = F.decode("head", "ISO-8859-1")
    return read_files(dealt(files), HEADER_BYTES, opener).select(
        "path", "length", "mtime_ms", "sha256", head.contains(PDF_MARK).alias("has_header"), "readable")


# ---- parser output ---------------------------------------------------------------------
def parse_content_lists(texts: DataFrame) -> DataFrame:
    """One row per raw block with its position, from (doc_id, content_list).

    A list may come in parts, each with the position of its first row in ``first_pos``.
    """
    blocks = F.from_json("content_list", f"array<{RAW_BLOCK}>")
    first = F.col("first_pos") if "first_pos" in texts.columns else F.lit(0)
    return texts.select("doc_id", first.alias("__first"), F.posexplode(blocks).alias("pos", "b")).select(
        "doc_id", (F.col("pos") + F.col("__first")).cast("int").alias("pos"), "b.*").select(
        "doc_id", "pos", "type", F.coalesce("text", F.lit("")).alias("text"), "text_level", "bbox", "page_idx", "img_path",
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in (
            "image_caption", "image_footnote", "chart_caption", "chart_footnote", "table_caption", "table_footnote")],
        F.coalesce("table_body", F.lit("")).alias("table_body"))


def parse_layouts(texts: DataFrame) -> DataFrame:
    """(doc_id, pdf_info) from (doc_id, layout)."""
    return texts.select("doc_id", F.from_json("layout", LAYOUT)["pdf_info"].alias("pdf_info"))


def scan_parser_output(spark: SparkSession, root: str, opener: Callable[[str], BinaryIO] = open_file) -> tuple[DataFrame, DataFrame]:
    """(raw blocks, layouts) of ``root/<doc_id>/{*_content_list.json,layout.json}``, from one listing."""
    inside = F.substring_index("path", "/", -2)
    at_depth = F.concat(F.lit(_qualified(spark, root) + "/"), inside) == F.col("path")
    files = list_files(spark, root, hidden_folders=True).filter(at_depth)
    name = F.substring_index("path", "/", -1)

    def whole(chosen: Column, column: str) -> DataFrame:
        return read_texts(dealt(files.filter(chosen)), opener).select(
            F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("doc_id"), F.col("text").alias(column))

    return parse_content_lists(whole(name.endswith(CONTENT_LIST), "content_list")), parse_layouts(whole(name == LAYOUT_FILE, "layout"))


# ---- assets ----------------------------------------------------------------------------
def check_assets(files: DataFrame) -> DataFrame:
    """MIME type by first bytes and by extension, and ``ok``, from (path, sha256, size_bytes, head)."""
    head = F.hex(F.substring("head", 1, 12))
    sniffed = (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp"))
    ext = ascii_lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = F.lit(None).cast("string")
    for suffix, mime in IMAGE_TYPES.items():
        named = F.when(ext == suffix, mime).otherwise(named)
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]+$", 1)
    out = files.select("path", "sha256", "size_bytes", sniffed.alias("mime_type"), named.alias("named_type"), stem.alias("__stem"))
    return out.withColumn("ok", F.coalesce(F.col("mime_type") == F.col("named_type"), F.lit(False))).withColumn(
        "name_matches_hash", ascii_lower("__stem") == F.col("sha256")).drop("__stem")


def verify_assets(files: DataFrame) -> DataFrame:
    """The same for rows that hold their bytes: (path, content)."""
    return check_assets(files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"),
        F.substring("content", 1, HEAD_BYTES).alias("head")))


def scan_assets(
    spark: SparkSession, glob: str, only: DataFrame | None = None, opener: Callable[[str], BinaryIO] = open_file,
) -> DataFrame:
    """Image files checked by content; ``only`` (path) narrows those that are opened."""
    files = list_files(spark, glob)
    if only is not None:
        files = files.join(only.select("path").distinct(), "path", "left_semi")
    return check_assets(read_files(dealt(files), HEAD_BYTES, opener).withColumnRenamed("read_bytes", "size_bytes"))
