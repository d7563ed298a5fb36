"""Golden cases of the normalizer on hand-made parser output."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import documents as D
from docloom.operators.normalize import heading_depth, normalize, chapter_role, looks_like_list_item, strip_display_math
from docloom.schemas import RAW_BLOCK
from docloom.sources import tables

SHA = "a" * 64
FIELDS = [f.split(":")[0] for f in (
    "type text text_level bbox page_idx img_path image_caption image_footnote chart_caption chart_footnote table_caption table_footnote table_body").split()]


def raw_rows(spark, docs):
    rows = []
    for doc, blocks in docs.items():
        for pos, b in enumerate(blocks):
            base = dict.fromkeys(FIELDS)
            base.update({k: [] for k in FIELDS if k.endswith(("caption", "footnote"))})
            base.update(text="", table_body="", page_idx=0)
            base.update(b)
            rows.append((doc, pos, *[base[f] for f in FIELDS]))
    parts = RAW_BLOCK[len("struct<"):-1]
    schema = "doc_id string, pos int, type string, text string, text_level int, bbox array<double>, page_idx int, img_path string, " + ", ".join(
        f"{f} array<string>" for f in FIELDS[6:12]) + ", table_body string"
    assert all(f in parts for f in FIELDS)
    return spark.createDataFrame(rows, schema)


def run(spark, docs, assets=(), ranges=None):
    raw = raw_rows(spark, docs)
    layout = spark.createDataFrame([(d, [(0, [612.0, 792.0]), (1, [720.0, 1000.0])]) for d in docs],
                                   "doc_id string, pdf_info array<struct<page_idx:int,page_size:array<double>>>")
    asset_rows = spark.createDataFrame(list(assets), "doc_id string, pos int, relative_path string, sha256 string, mime_type string, size_bytes long")
    sources = spark.createDataFrame([(d, f"art-{d}", SHA) for d in docs], "doc_id string, artifact_id string, source_sha256 string")
    return normalize(raw, layout, asset_rows, sources, ranges), sources


def text(t, level=None, **more):
    return {"type": "text", "text": t, "text_level": level, **more}


PAPER = [
    text("Paper Title", 1), {"type": "page_number", "text": "1"}, text("Authors"), text("1 Intro", 1), text("See $x+y$ in [3, 4].", bbox=[100.0, 300.0, 600.0, 400.0]),
    text("Some note.", 2), {"type": "ref_text", "text": "[1] First"}, {"type": "ref_text", "text": "[2] Second"}, text("References", 2),
    {"type": "ref_text", "text": "[3] Third"}, text("A Related Work", 2), {"type": "equation", "text": "$$ E=mc^2 $$"}, text("A.1 Safety Analysis", 2),
    text("- item"), {"type": "ref_text", "text": "[4] Fourth"}, text("B More Results", 2), text("Example one", 2)]


@pytest.mark.parametrize("ranges", [1, 5])
def test_outline(spark, ranges):
    n, _ = run(spark, {"d": PAPER}, ranges=ranges)
    assert n.rejected.count() == 0
    assert n.titles.first()["title"] == "Paper Title"
    chapters = [tuple(r) for r in n.chapters.orderBy("order_index").select("source_title", "depth", "role", "block_count").collect()]
    assert chapters == [
        ("Front Matter", 1, "front_matter", 1), ("1 Intro", 1, "body", 3), ("References", 1, "references", 2), ("References", 1, "references", 2),
        ("A Related Work", 1, "body", 2), ("A.1 Safety Analysis", 2, "body", 2), ("References", 1, "references", 1), ("B More Results", 1, "body", 2)]
    box = n.blocks.filter("box IS NOT NULL").select("box.*").first()
    assert [round(box[k], 6) for k in ("x", "y", "width", "height")] == [61.2, 237.6, 306.0, 79.2]
    atoms = n.blocks.filter("content.plainText LIKE 'See%'").select(F.transform("content.atoms", lambda a: a["type"]).alias("t")).first()["t"]
    assert atoms == ["text", "formula", "text", "citation", "text"]


def test_results_do_not_depend_on_partitions(spark):
    seen = set()
    for ranges, parts in ((1, 1), (2, 4), (5, 32)):
        n, _ = run(spark, {"d": PAPER, "e": PAPER[2:]}, ranges=ranges)
        seen.add(tuple(sorted(tuple(r) for r in n.blocks.repartition(parts).select("block_id", "order_index", "source_digest").collect())))
    assert len(seen) == 1


def test_table_and_figures(spark):
    assets = [("d", 0, "images/a.png", SHA, "image/png", 5), ("d", 1, "images/b.png", SHA, "image/png", 5)]
    blocks = [text("T", 1), {"type": "table", "img_path": "images/b.png", "table_caption": ["Table 1", " rows "], "table_footnote": ["note"],
                            "table_body": "<table><tr><td rowspan='2'>A</td><td>B</td></tr><tr><td>C [1]</td></tr></table>"},
              {"type": "image", "img_path": "images/a.png", "image_caption": ["Fig"], "image_footnote": ["foot"]},
              {"type": "chart", "chart_caption": ["no asset"], "chart_footnote": ["lost"]}, {"type": "table", "table_caption": ["only"]}]
    n, sources = run(spark, {"d": blocks}, assets)
    rows = [tuple(r) for r in n.blocks.orderBy("pos", "sub").select("kind", "content.plainText").collect()]
    assert rows == [("table", "Table 1\nrows\nA\tB\nC [1]\nnote"), ("caption", "Table 1 rows"), ("figure", "Fig"), ("caption", "Fig"),
                    ("caption", "foot"), ("caption", "no asset"), ("caption", "only")]
    assert n.assets.count() == 1
    pieces = D.document_pieces(n, sources)
    doc = json.loads("".join(r["value"] for r in pieces.orderBy("place").collect()))
    assert doc["pageCount"] == 2 and len(doc["chapters"]) == 1 and doc["chapters"][0]["blocks"][0]["content"]["atoms"][1]["assetId"] == SHA
    flags = {r["kind"]: r["translatable"] for r in D.flag_translatable(n.blocks).collect()}
    assert flags == {"table": True, "caption": True, "figure": False}
    back = {r["id"]: r["content"]["plainText"] for r in D.find_blocks(pieces).collect()}
    assert back == {r["block_id"]: r["content"]["plainText"] for r in n.blocks.collect()} and len(back) == 7
    whole = "".join(r["value"] for r in pieces.orderBy("place").collect())
    assert D.assemble_documents(pieces).first()["content_digest"] == hashlib.sha256(whole.encode()).hexdigest()


def test_large_document_is_published_and_read(spark):
    """One rule for all sizes: more blocks than a scan's chunk has rows."""
    count = 300
    blocks = [text("Title", 1)] + [text(f"Line {i}") for i in range(count)]
    n, sources = run(spark, {"d": blocks, "e": PAPER}, ranges=6)
    stored = tables.manifests_of(n, sources)
    assert stored.filter("kind = 'block' AND doc_id = 'd'").count() == count
    old = spark.createDataFrame([], tables.TABLES["parse_artifacts"]).select(
        "id", "document_id", "is_active", "backend", "parser_version", "normalizer_version", "source_sha256", "manifest_path", "content_digest", "created_at")
    out = tables.publish_artifacts(n, sources, old, 1)
    read = {r["document_id"]: (r["status"], r["chapters"]) for r in tables.read_active_documents(out["parse_artifacts"], out["manifests"]).collect()}
    assert set(read) == {"d", "e"} and all(s == "ok" and c >= 1 for s, c in read.values())
    assert out["blocks"].filter("doc_id = 'd'").count() == count
    digest = hashlib.sha256("".join(r["value"] for r in stored.filter("doc_id = 'd'").orderBy("place").collect()).encode()).hexdigest()
    assert out["parse_artifacts"].filter("document_id = 'd'").first()["content_digest"] == digest


def test_rejections(spark):
    n, _ = run(spark, {
        "box": [text("x", bbox=[500.0, 0.0, 100.0, 10.0]), text("fine")], "page": [{"type": "footer", "page_idx": 7}],
        "asset": [{"type": "image", "img_path": "images/none.png"}], "empty": [text("Only title", 1)], "span": [{"type": "table", "table_body": "<table><tr><td colspan='9999'>x</td></tr></table>"}],
        "good": [text("fine")]})
    assert {r["doc_id"]: r["code"] for r in n.rejected.collect()} == {
        "box": "invalid_bbox", "page": "page_out_of_range", "asset": "missing_asset", "empty": "no_content", "span": "colspan_out_of_range"}
    assert [r["doc_id"] for r in n.chapters.collect()] == ["good"]


def test_headings(spark):
    cases = {"3.2.1 Scaled Attention": 3, "3. Method": 1, "3..1 x": 1, "A x": 1, "A.1 x": 2, "Plain heading": 1, "Ends with stop.": None,
             "Example of use": None, "é" * 80: 1, "é" * 81: None, "3": 1}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", heading_depth(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == cases
    roles = spark.createDataFrame([("References:",), ("7 References",), ("ABSTRACT",), ("Method",)], "t string").select(chapter_role(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in roles] == ["references", "body", "front_matter", "body"]
    row = spark.createDataFrame([("12) x", "$$$", "$$ a\nb $$")], "a string, b string, c string").select(
        looks_like_list_item(F.col("a")).alias("a"), strip_display_math(F.col("b")).alias("b"), strip_display_math(F.col("c")).alias("c")).first()
    assert tuple(row) == (True, "$$$", "a\nb")


def test_scans_carry_no_text(spark):
    """Layouts and scans run over shapes without texts, which tell how many blocks a row makes."""
    from docloom.operators import normalize as N

    long = "A sentence that is no heading. " * 20
    raw = raw_rows(spark, {"d": [
        text("T", 1), text(long), text(" "), text("1 Intro", 2), {"type": "footer", "text": long}, {"type": "equation", "text": "$$x$$"},
        {"type": "table", "table_body": "<table><tr><td>" + long + "</td></tr></table>", "table_caption": [long]}, {"type": "table", "table_caption": [" "]},
        {"type": "image", "img_path": "images/a.png", "image_caption": [long], "image_footnote": [long]}, {"type": "chart", "chart_footnote": [long]}]})
    rows = N.row_shapes(raw)
    assert long.strip() not in str(rows.collect())
    aliases = spark.createDataFrame([("d", "images/a.png", SHA)], "doc_id string, relative_path string, asset_id string")
    sizes = {r["pos"]: r["n"] for r in N.with_assets(rows, aliases).withColumn("n", N.shape_size()).filter("n > 0").collect()}
    whole = N.with_assets(N.classify_text(raw), aliases).withColumn("page", F.lit(1)).withColumn("box", F.lit(None)).withColumn("segment", F.lit(0))
    made = {r["pos"]: r["count"] for r in N.expand_blocks(N.drop_layout_noise(whole))[0].groupBy("pos").count().collect()}
    sizes.pop(4, None)
    assert sizes == made and made[8] == 3 and 9 not in made


def test_pointers_need_no_texts(spark):
    """Who is published is known from the manifests' heads, so operations finish without the digests."""
    n, sources = run(spark, {"d": PAPER, "bad": [{"type": "footer", "page_idx": 7}]})
    schema = ("id string, document_id string, is_active boolean, backend string, parser_version string, normalizer_version string, "
              "source_sha256 string, manifest_path string, content_digest string, created_at long")
    old = spark.createDataFrame([(f"old-{d}", d, True, *["x"] * 6, 0) for d in ("d", "bad")], schema)
    out = tables.publish_artifacts(n, sources, old, 1)
    pointers = {tuple(r) for r in out["pointers"].collect()}
    assert pointers == {tuple(r) for r in out["parse_artifacts"].select("id", "document_id", "is_active").collect()}
    assert {(d, a) for i, d, a in pointers if i.startswith("old-")} == {("d", False), ("bad", True)} and len(pointers) == 3
    ops = spark.createDataFrame([(d, "normalizing", 0.5, None) for d in ("d", "bad", "none")], "document_id string, state string, progress double, completed_at long")
    done = tables.finish_operations(ops, out["pointers"], 9)
    assert {(r["document_id"], r["state"]) for r in done.collect()} == {("d", "succeeded"), ("bad", "succeeded"), ("none", "normalizing")}
    assert "source_digest" not in done._jdf.queryExecution().optimizedPlan().toString()
