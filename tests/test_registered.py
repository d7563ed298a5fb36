"""Registered queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from compare import TABLES, rows_of
from docloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "L1_upsert_documents", "L2_query_library", "L4_refresh_sources", "L14_upsert_positions", "N6_segment_chapters", "N15_assign_ids", "N16_reject_documents",
    "N18_chapter_digests", "T1_protect_blocks", "T7_plan_batches", "T11_validate_outputs", "T17_chapter_progress", "J1_upsert_jobs",
    "J2_state_change_events", "J5_mark_interrupted", "C5_neighbour_context", "C7_fit_requests", "K1_replay_commands", "Q2_check_uniques",
    "S8_read_response_fragments", "X1_stream_commands"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_callable():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 112


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not there")
@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_documents_without_text_are_rejected_as_in_sql(spark, tmp_path):
    """Empty texts and null ones have no content, unless their files disagree."""
    texts = [None, "", "one line", "a\nb\nc\nd\ne", " \n"]
    rows = [(i, texts[i % 5], "en", "s", None if texts[i % 5] is None else len(texts[i % 5])) for i in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("N16_reject_documents", "N1_page_sizes", "N2_canonical_assets"):
        df = QUERIES[name](spark, str(tmp_path))
        cursor = con.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall()), name
