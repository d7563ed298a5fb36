"""Percentile sketches, quality rates and throttled progress."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import TABLES, rows_of
from docloom.operators import metrics as M
from docloom.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_percentiles_within_the_stated_error_and_mergeable(spark):
    rng = random.Random(3)
    values = {"one": [5], "hot": [int(rng.lognormvariate(8, 3)) for _ in range(20_000)], "ties": [700_000] * 50 + [0] * 50,
              "wide": [rng.randrange(2 ** rng.randrange(1, 62)) for _ in range(3000)]}
    rows = [(k, i % 7, v) for k, vs in values.items() for i, v in enumerate(vs)] + [("hot", 0, None), ("hot", 0, -5), ("none", 0, None)]
    samples = spark.createDataFrame(rows, "metric string, day int, value_ms long")
    once = M.read_percentiles(M.sketch_samples(samples, ["metric"]), ["metric"])
    days = M.sketch_samples(samples, ["metric", "day"])
    got = {r["metric"]: r for r in once.collect()}
    assert {r["metric"]: r for r in M.read_percentiles(days, ["metric"]).collect()} == got
    # two halves put together are the whole
    parts = M.merge_sketches(days.filter("day < 3"), ["metric"]).unionByName(M.merge_sketches(days.filter("day >= 3"), ["metric"]))
    assert {r["metric"]: r for r in M.read_percentiles(parts, ["metric"]).collect()} == got
    assert set(got) == set(values)
    for name, vs in values.items():
        vs, r = sorted(vs), got[name]
        assert r["samples"] == len(vs) and r["slow"] == sum(v > M.SLOW_MS for v in vs)
        for p in M.PERCENTILES:
            exact = vs[math.ceil(len(vs) * p / 100) - 1]
            assert exact - exact / 2 ** M.SKETCH_BITS <= r[f"p{p}"] <= exact
    most = M.sketch_samples(samples, ["metric"]).groupBy("metric").count().agg(F.max("count")).first()[0]
    assert most <= 2 ** M.SKETCH_BITS * (64 - M.SKETCH_BITS)


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], "metric string, value_ms long")
    assert M.read_percentiles(M.sketch_samples(empty, ["metric"]), ["metric"]).count() == 0
    events = spark.createDataFrame([(None, datetime(2024, 1, 1), 1), ("j", None, 2)], "job_id string, at timestamp, seq long")
    assert M.throttle_progress(events).count() == 0


def test_translation_rates(spark):
    mark = [("⟦WEAVE:A:C:0001⟧", "C"), ("⟦WEAVE:A:F:0002⟧", "F")]
    both = "x" + mark[0][0] + mark[1][0]
    rows = [("c", "kept", both, mark, None), ("c", "moved", both, mark, "block_order_changed"), ("c", "blank", "  ", [], "empty_target"),
            ("c", "lost", mark[0][0], mark, "protected_marker_changed"), ("c", "gone", None, mark, "missing_block"),
            ("c", "twice", both, mark, "duplicate_block"), ("d", "torn", None, mark, "truncated")]
    judged = spark.createDataFrame(rows, "chapter_id string, block_id string, target string, markers array<struct<token:string,kind:string>>, code string")
    got = {(r["chapter_id"], r["measure"]): (r["good"], r["total"], r["passed"]) for r in M.translation_rates(judged, ["chapter_id"]).collect()}
    assert got == {
        ("c", "blocks_kept"): (4, 6, False), ("c", "markers_kept"): (3, 4, False), ("c", "citations_kept"): (3, 3, True),
        ("c", "equations_kept"): (2, 3, False), ("c", "targets_not_empty"): (3, 4, False), ("d", "blocks_kept"): (0, 1, False),
        ("d", "markers_kept"): (0, 0, True), ("d", "citations_kept"): (0, 0, True), ("d", "equations_kept"): (0, 0, True), ("d", "targets_not_empty"): (0, 0, True)}


def test_answer_rates(spark):
    answers = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "request_id string, part int")
    cites = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "request_id string, order_index int, context_id string")
    warnings = spark.createDataFrame([("a", 2, "citation_out_of_context"), ("b", 0, "citation_duplicate")], "request_id string, ord int, code string")
    got = {(r["part"], r["measure"]): (r["good"], r["total"], r["rate"], r["passed"]) for r in M.answer_rates(answers, cites, warnings, ["part"]).collect()}
    assert got == {(1, "answers_cited"): (1, 2, 0.5, False), (1, "citations_in_context"): (2, 3, 2 / 3, False),
                   (2, "answers_cited"): (0, 1, 0.0, False), (2, "citations_in_context"): (0, 0, None, True)}


def test_progress_is_never_faster_and_never_stale(spark):
    rng = random.Random(5)
    begin = datetime(2024, 5, 1)
    rows = [(f"j{rng.randrange(3)}", begin + timedelta(microseconds=rng.randrange(20_000_000)), i, i % 100) for i in range(4000)]
    # two events at one time: the later one by seq counts
    rows += [("tie", begin, 2, 20), ("tie", begin, 1, 10), ("tie", begin, 1, 10)]
    events = spark.createDataFrame(rows, "job_id string, at timestamp, seq long, percent int")
    shown = M.throttle_progress(events)
    busiest = shown.groupBy("job_id", F.window("at", "1 second")).count().agg(F.max("count")).first()[0]
    assert busiest == M.PROGRESS_PER_SECOND
    last = {r["job_id"]: r["seq"] for r in shown.groupBy("job_id").agg(F.max_by("seq", F.struct("at", "seq")).alias("seq")).collect()}
    want = {}
    for job, at, seq, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        want[job] = seq
    assert last == want and shown.filter("job_id = 'tie'").count() == 1
    one = M.throttle_progress(events, per_second=1).groupBy("job_id", F.window("at", "1 second")).count()
    assert one.agg(F.max("count")).first()[0] == 1


@pytest.mark.parametrize("name", ["M1_weekly_percentiles", "M2_answer_rates", "M3_throttled_progress", "M3_stream_progress"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
