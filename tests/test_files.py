"""Files are listed first and only those wanted are opened."""

import hashlib
import os

from pyspark.sql import functions as F

from docloom.operators import library as L
from docloom.sources import files as S

PNG = bytes.fromhex("89504E470D0A1A0A")


def _only_changed(path):
    """Opens changed files; what has not changed is unreadable."""
    if not os.path.basename(path).startswith("changed"):
        raise PermissionError(path)
    return S.open_file(path)


def test_only_changed_files_are_opened(spark, tmp_path):
    names = [f"same {i}" for i in range(20)] + ["changed é 1", "changed 2"]
    for name in names:
        (tmp_path / f"{name}.pdf").write_bytes(b"junk %PDF-1.4 " + name.encode() + b"x" * 3000)
    listing = S.list_files(spark, str(tmp_path))
    assert listing.count() == len(names) and "content" not in listing._jdf.queryExecution().executedPlan().toString()
    known = listing.select(F.col("path").alias("file_path"), (F.col("length") + F.col("path").contains("/changed ").cast("int")).alias("file_size_bytes"),
                           F.col("mtime_ms").alias("file_mtime_ms"), F.lit("available").alias("file_state"))
    wanted = L.sources_to_hash(known, listing)
    got = S.scan_pdf_inventory(spark, str(tmp_path), wanted, _only_changed).collect()
    assert sorted(os.path.basename(r["path"]) for r in got) == ["changed 2.pdf", "changed é 1.pdf"]
    for r in got:
        data = (tmp_path / os.path.basename(r["path"])).read_bytes()
        assert (r["sha256"], r["length"], r["has_header"], r["readable"]) == (hashlib.sha256(data).hexdigest(), len(data), True, True)
    # without the choice every file is opened, and those that cannot be are told
    rows = S.scan_pdf_inventory(spark, str(tmp_path), opener=_only_changed).collect()
    assert sum(r["readable"] for r in rows) == 2 and all(r["sha256"] is None and r["has_header"] is None for r in rows if not r["readable"])


def test_pieces_and_edges(spark, tmp_path):
    big = os.urandom(S.PIECE_BYTES + 12345)
    (tmp_path / "big.pdf").write_bytes(big)
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "late.pdf").write_bytes(b"x" * (S.HEADER_BYTES - 4) + b"%PDF-")
    got = {os.path.basename(r["path"]): r for r in S.scan_pdf_inventory(spark, str(tmp_path)).collect()}
    assert got["big.pdf"]["sha256"] == hashlib.sha256(big).hexdigest()
    # Spark's listing passes over empty files; one that is named is read
    assert "empty.pdf" not in got
    named = S.read_files(spark.createDataFrame([(f"{tmp_path}/empty.pdf",)], "path string"), 4).first()
    assert (named["sha256"], named["read_bytes"], named["readable"]) == (hashlib.sha256(b"").hexdigest(), 0, True)
    assert got["late.pdf"]["has_header"] is False
    none = spark.createDataFrame([], "path string")
    assert S.scan_pdf_inventory(spark, str(tmp_path), none).count() == 0


def test_file_that_goes_after_the_listing(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    listing = spark.createDataFrame([(f"file:{tmp_path}/a.pdf", 6), (f"file:{tmp_path}/b.pdf", 6)], "path string, length long")
    got = {r["path"][-5:]: (r["readable"], r["head"]) for r in S.read_files(listing, 4).collect()}
    assert got == {"a.pdf": (True, bytearray(b"%PDF")), "b.pdf": (False, None)}


def test_written_assets_are_scanned(spark, tmp_path):
    sha = hashlib.sha256(PNG).hexdigest()
    rows = [(f"1/images/{sha}.png", PNG), (f"2/images/{sha}.webp", PNG), ("3/images/x.PNG", PNG), ("4/images/none.png", None), ("5/plain", b"text")]
    files = spark.createDataFrame(rows, "path string, content binary")
    assert S.write_files(files, str(tmp_path)) == 5 == S.write_files(files, str(tmp_path))
    left = [f for _, _, names in os.walk(tmp_path) for f in names if not f.endswith(".crc")]
    assert len(left) == 5 and not any(f.startswith("_") for f in left)
    got = {r["path"].split(f"{tmp_path}/")[1]: (r["size_bytes"], r["mime_type"], r["ok"], r["name_matches_hash"]) for r in S.scan_assets(spark, str(tmp_path)).collect()}
    assert got == {rows[0][0]: (8, "image/png", True, True), rows[1][0]: (8, "image/png", False, True), rows[2][0]: (8, "image/png", True, False),
                   rows[4][0]: (4, None, False, False)}
    only = spark.createDataFrame([(f"file:{tmp_path}/5/plain",)], "path string")
    assert S.scan_assets(spark, str(tmp_path), only).count() == 1


def test_listing_by_tasks(spark, tmp_path):
    """Levels, globs and hidden names as Spark's reader has them, without the names in a plan."""
    for name in ("a/x.pdf", "a/b/c/y.pdf", "b/z.txt", "_h/n.pdf", "a/.s.pdf", "a/_t.pdf", "a/b/é {1}.pdf", "b[1]/q.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-")
    for glob in (str(tmp_path), f"{tmp_path}/*/*.pdf", f"{tmp_path}/[ab]/*", f"{tmp_path}/{{a,b}}/?.*", f"file:{tmp_path}/a", f"{tmp_path}/b/z.txt"):
        files = S.list_files(spark, glob)
        spark_own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
        want = spark_own.select("path", "length", F.unix_millis("modificationTime").alias("mtime_ms"))
        assert sorted(map(tuple, files.collect())) == sorted(map(tuple, want.collect())), glob
        assert not any(f.endswith((".pdf", ".txt")) for f in files.inputFiles())


def test_parser_output(spark, tmp_path):
    files = {"d1/x_content_list.json": '[{"type":"text","text":"é"},{"type":"text"}]', "d1/layout.json": '{"pdf_info":[{"page_idx":0,"page_size":[1.0,2.0]}]}',
             "_d2/content_list.json": '[{"type":"table"}]', "d3/deep/x_content_list.json": '[{"type":"text"}]', "d4/layout.json": '{"pdf_info":[]}', "d4/_x_content_list.json": "[]"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    raw, layouts = S.scan_parser_output(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["pos"], r["type"], r["text"]) for r in raw.collect()) == [
        ("_d2", 0, "table", ""), ("d1", 0, "text", "é"), ("d1", 1, "text", "")]
    assert {r["doc_id"]: len(r["pdf_info"]) for r in layouts.collect()} == {"d1": 1, "d4": 0}
    assert not any(f.endswith(".json") for f in [*raw.inputFiles(), *layouts.inputFiles()])
