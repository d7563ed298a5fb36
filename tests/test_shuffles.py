"""What is read once, what meets without its texts, and that the results stay the same."""

from pyspark.sql import functions as F

from docloom.operators import translate as T

CONFIG = T.TranslationConfig("m", "fp", 4096)


def plan_of(df, optimized=True):
    query = df._jdf.queryExecution()
    return (query.optimizedPlan() if optimized else query.executedPlan()).toString()


def answered(spark):
    token = "⟦WEAVE:A:C:0001⟧"
    marker = [(token, "C", None, None)]
    blocks = [("q", f"b{i}", i, "paragraph", f"see {token}", marker, "ch") for i in range(6)] + [("open", "b9", 0, "paragraph", "x", [], "ch")]
    prepared = spark.createDataFrame(
        blocks, f"request_id string, block_id string, order_index int, kind string, source string, markers array<{T.MARKER}>, chapter_id string")
    texts = [(0, "b0", f"看 {token}"), (1, "b1", "看"), (2, "b2", f"看 {token}"), (3, "b2", f"看 {token}"), (4, "b4", f"看 {token}"), (5, "b3", f"看 {token}"),
             (6, "odd", "x")]
    records = spark.createDataFrame([("q", *t) for t in texts], "request_id string, ord int, block_id string, target string")
    responses = spark.createDataFrame([("q", "length")], "request_id string, finish_reason string")
    return prepared, records, responses


CODES = {"b0": None, "b1": "protected_marker_changed", "b2": "duplicate_block", "b3": "block_order_changed", "b4": "block_order_changed", "b5": "truncated"}


def test_verdicts_need_no_text(spark):
    prepared, records, responses = answered(spark)
    judged = T.judge_outputs(prepared, records, responses, carry=["chapter_id"])
    assert {r["block_id"]: r["code"] for r in judged.collect()} == CODES and {r["chapter_id"] for r in judged.collect()} == {"ch"}
    whole = T.validate_outputs(prepared, records, responses)
    assert {r["block_id"]: r["code"] for r in whole.collect()} == CODES
    assert [r["restored"]["plainText"] for r in whole.filter("code IS NULL").collect()] == ["看 "]
    # one shuffle by request, which carries neither sources nor targets
    plan = plan_of(judged.select("block_id", "code"), optimized=False)
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan


def test_repair_judges_once(spark):
    prepared, records, responses = answered(spark)
    again = T.repair_set(prepared, T.judge_outputs(prepared, records, responses), CONFIG)
    assert {r["block_id"] for r in again.collect()} == {b for b, code in CODES.items() if code}
    # failed blocks are written, so that packing does not judge the answers a second time
    assert "ArrowEvalPython" not in plan_of(again)


def test_commit_errors_judge_once(spark):
    judged = spark.createDataFrame(
        [("j", "a", None), ("j", "b", None), ("j", "c", "late"), ("stop", "d", None), ("none", "e", None)], "job_id string, block_id string, code string").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("safe_message", "target_json", "target_plain_text")], F.lit(1).cast("long").alias("at"))
    columns = ["state", "target_json", "target_plain_text", "validation_json", "error_code", "error_message"]
    rows = spark.createDataFrame([("j", "a", True), ("j", "b", False)], "job_id string, block_id string, is_active boolean").select(
        "*", *[F.lit("queued" if c == "state" else None).cast("string").alias(c) for c in columns], F.lit(0).cast("long").alias("updated_at"))
    jobs = spark.createDataFrame([("j", "running"), ("stop", "cancelled")], "id string, state string")
    after, errors = T.commit_results(rows, judged, jobs)
    assert {tuple(r) for r in errors.collect()} == {("j", "b", "cache_changed"), ("stop", "d", "job_cancelled")}
    # one lost row undoes the job's others
    assert {r["state"] for r in after.collect()} == {"queued"}
    # answers and stored rows are read once each
    assert plan_of(errors).count("LogicalRDD [job_id") == 2


def test_job_events_lay_out_states_only(spark, tmp_path):
    """What numbers the events is laid out without the jobs' other columns, and the events stay the same."""
    from docloom.operators.oplog import state_change_events
    from docloom.plans.bridge import Corpus

    rows = [(i, i % 3, ("signup", "view", "error", "purchase", "click")[i % 5], f'{{"k": {i % 4}}}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    c = Corpus(spark, str(tmp_path))
    whole = state_change_events(c.job_history.withColumnRenamed("id", "job_id")).select("job_id", "sequence", "state", "seq")
    assert {tuple(r) for r in c.job_events.collect()} == {tuple(r) for r in whole.collect()} and whole.count() > 12
    plan = plan_of(c.job_events)
    assert "seq#" in plan and not any(name in plan for name in ("plan_digest", "chapter_id", "safe_message"))


def test_removal_shuffles_a_table_once(spark):
    """Rows that stay and rows that go come of one shuffle, whatever their readers filter; null keys and copies stay as they are."""
    from docloom.operators.library import remove_documents

    def table(rows, names):
        return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))

    tables = {
        "documents": table([("d1",), ("d2",)], "id"), "parse_artifacts": table([("a1", "d1"), ("a1", "d1"), ("a2", "d2"), ("a3", None)], "id document_id"),
        "chapters": table([("c1", "a1"), ("c2", "a2"), ("c3", None)], "id artifact_id"),
        "blocks": table([("b1", "c1"), ("b2", "c2"), ("b3", None), ("b4", "c1")], "id chapter_id"),
        "translations": table([("t1", "b1"), ("t2", "b2"), ("t3", "b9"), ("t4", "b4")], "id block_id").filter("block_id > 'b1'")}
    kept = remove_documents(tables, spark.createDataFrame([("d1",), ("d1",)], "id string"))
    assert {name: sorted(r["id"] for r in rows.collect()) for name, rows in kept.items()} == {
        "documents": ["d2"], "parse_artifacts": ["a2", "a3"], "chapters": ["c2", "c3"], "blocks": ["b2", "b3"], "translations": ["t2", "t3"]}
    assert all(set(kept[name].columns) == set(rows.columns) for name, rows in tables.items())
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both = kept["blocks"].select("id").unionByName(kept["translations"].select("id"))
        made = [line for line in plan_of(both, optimized=False).splitlines() if "Exchange hashpartitioning(chapter_id" in line and "ReusedExchange" not in line]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # the blocks meet the removed chapters, which are distributed by their own ids
    assert len(made) == 1


def test_checked_jobs_carry_checked_columns_only(spark, tmp_path):
    """The checks shuffle jobs without plan digests, messages and times, and see the same kinds and states."""
    from unittest.mock import MagicMock

    from docloom.plans.bridge import Corpus
    from docloom.plans.q_sessions import _checked

    rows = [(i, i % 3, ("signup", "view", "error", "purchase", "click")[i % 5], f'{{"k": {i % 4}}}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    real = Corpus(spark, str(tmp_path))
    whole = {tuple(r) for r in real.jobs.select("id", "kind", "state", "document_id").collect()}
    assert {tuple(r) for r in real.job_columns("id", "kind", "state", "document_id").collect()} == whole and len(whole) == 12
    plan = plan_of(_checked(MagicMock(jobs=real.jobs, job_columns=real.job_columns))["jobs"][0])
    assert "seq#" in plan and not any(name in plan for name in ("plan_digest", "chapter_id", "safe_message", "completed_at"))
