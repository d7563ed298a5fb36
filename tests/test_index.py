"""The stored term index, selections over atoms, and the audit of archives."""

import random

from pyspark.sql import functions as F

from docloom.operators import conversation as C
from docloom.operators import documents as D


def test_stored_index_is_pruned(spark, tmp_path):
    rows = [(f"b{i}", f"Common word{i % 40} Élan{i % 3}" + (" rare" if i == 77 else "")) for i in range(400)]
    blocks = spark.createDataFrame(rows, "block_id string, plain_text string")
    index = D.read_term_index(spark, D.write_term_index(blocks, str(tmp_path / "terms")))
    ids = lambda df: {r["block_id"] for r in df.collect()}
    assert ids(D.match_term(index, "RARE")) == {"b77"} and len(ids(D.match_term(index, "common"))) == 400
    assert ids(D.match_terms(index, ["word3", "elan0", "common"])) == {f"b{i}" for i in range(400) if i % 40 == 3 and i % 3 == 0}
    assert ids(D.match_terms(index, ["word3", "nowhere"])) == ids(D.match_terms(index, [])) == set()
    plan = D.match_term(index, "rare")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("(bucket", "(bucket") and "EqualTo(term,rare)" in plan
    assert "regexp_extract_all" not in plan and "Python" not in plan


def test_postings_hold_numbers_and_are_not_shuffled(spark, tmp_path):
    blocks = spark.createDataFrame([(f"b{i}", f"common w{i}") for i in range(100)] + [("none", None), ("blank", " ")], "block_id string, plain_text string")
    index = D.read_term_index(spark, D.write_term_index(blocks.repartition(5), str(tmp_path / "terms")))
    postings, ids = index.filter("term IS NOT NULL"), index.filter("term IS NULL")
    assert postings.count() == 200 and postings.filter("block_id IS NOT NULL").count() == 0
    assert ids.select("block").distinct().count() == ids.select("block_id").distinct().count() == 102
    # a task's files hold numbers of its own
    files = postings.select("block", F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).alias("task")).distinct()
    assert files.groupBy("block").count().filter("count > 1").count() == 0


def test_highlights_are_no_product(spark):
    """One block with many atoms and many short selections: pairs in proportion to overlaps."""
    rng = random.Random(1)
    atoms, at = [], 0
    for i in range(3000):
        size = rng.choice((0, 1, 5, 40, 700))
        atoms.append(("b", i, "x" * size, at, at + size))
        at += size
    picks = [(f"s{i}", "b", s := rng.randrange(at), s + rng.choice((0, 1, 30, 900))) for i in range(1000)] + [("all", "b", 0, at)]
    a = spark.createDataFrame(atoms, "block_id string, leaf_index int, text string, start_utf16 int, end_utf16 int")
    s = spark.createDataFrame(picks, "selection_id string, block_id string, start_utf16 int, end_utf16 int")
    got = C.highlight_spans(a, s)
    found = sorted((r["selection_id"], r["leaf_index"], r["from_utf16"], r["to_utf16"], len(r["text"])) for r in got.collect())
    want = sorted((k, i, max(p, lo) - lo, min(q, hi) - lo, min(q, hi) - max(p, lo)) for k, _, p, q in picks for _, i, _, lo, hi in atoms if q > lo and p < hi)
    assert found == want
    pairs = C._binned(a).select("block_id", "__bin", "leaf_index").join(
        C._binned(s).select("block_id", "__bin", "selection_id"), ["block_id", "__bin"]).count()
    assert pairs < 12 * len(want) < 3000 * 1000 / 10


def test_archive_audit(spark):
    sha = "a" * 64
    good = [("x_content_list.json", 10), ("layout.json", 10), (f"images/{sha}.png", 5)]
    archives = {
        "good": good, "twice": [*good, ("./layout.json", 1)], "unsafe": [*good, ("../up", 1)], "none": good[1:],
        "stem": [*good, ("images/short.png", 1)], "large": [*good, ("big.bin", 17 * 1024 * 1024)],
        "sum": [*good, *[(f"f{i}", 4 * 1024 * 1024) for i in range(5)]], "many": [*good, *[(f"g{i}", 0) for i in range(4100)]]}
    rows = [(k, i, p, n, None, False, 1000) for k, entries in archives.items() for i, (p, n) in enumerate(entries)]
    entries = spark.createDataFrame(rows, "archive_id string, entry_index int, path string, size_bytes long, unix_mode int, is_dir boolean, source_size_bytes long")
    got = {r["archive_id"]: (r["entry_count"], r["error_code"]) for r in D.audit_archive_entries(entries.orderBy(F.rand(1))).collect()}
    assert got == {"good": (3, None), "twice": (4, "duplicate_path"), "unsafe": (4, "unsafe_path"), "none": (2, "content_list_count"),
                   "stem": (4, "invalid_asset_name"), "large": (4, "file_too_large"), "sum": (8, "archive_too_large"), "many": (4103, "too_many_entries")}
