"""Context of selections: neighbours across stretches, texts read in one place."""

from pyspark.sql import functions as F

from docloom.operators import conversation as C


def test_neighbours_cross_stretches_and_read_texts_once(spark):
    n = C.STRETCH + 8
    blocks = spark.createDataFrame(
        [(f"b{i}", "c", i, 1, "d", f"text {i}") for i in range(n)],
        "block_id string, chapter_id string, order_index int, page int, source_digest string, plain_text string")
    view = blocks.select("block_id", "source_digest", F.lit("ready").alias("state"), F.concat(F.lit("译文"), "block_id").alias("target_plain_text"))
    picked = [0, 1, C.STRETCH - 2, C.STRETCH - 1, C.STRETCH, C.STRETCH + 1, n - 1]
    chosen = spark.createDataFrame(
        [(f"s{i}", f"b{i}", "d", 0, 2, "译文") for i in picked],
        "selection_id string, block_id string, source_digest string, start_utf16 int, end_utf16 int, selected_text string")
    valid = C.validate_selections(chosen, blocks.drop("plain_text"), view).filter("error_code IS NULL").drop("error_code")
    assert "aligned_source" not in valid.columns
    found = C.neighbour_context(valid, blocks, view, 100_000)
    got = {r["selection_id"]: r for r in found.collect()}
    assert set(got) == {f"s{i}" for i in picked}
    for i in picked:
        r = got[f"s{i}"]
        assert [b["blockId"] for b in r["blocks"]] == [f"b{k}" for k in range(max(i - 2, 0), min(i + 3, n))]
        assert r["aligned_source"] == f"text {i}"
    # the same where the selections bring the text
    brought = C.validate_selections(chosen, blocks, view).filter("error_code IS NULL").drop("error_code")
    same = {r["selection_id"]: r for r in C.neighbour_context(brought, blocks, view, 100_000).collect()}
    assert all(same[k]["used_bytes"] == r["used_bytes"] and same[k]["blocks"] == r["blocks"] for k, r in got.items())
