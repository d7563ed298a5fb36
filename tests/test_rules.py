"""Rules that one table of the fixtures does not show: empty cells, whole commits, cancelled jobs, imports."""

import random

from pyspark.sql import functions as F

from docloom.functions.atoms import html_table, inline_atoms, make_atom, widen
from docloom.functions.text import utf16_slice
from docloom.operators import documents as D
from docloom.operators import library as L
from docloom.operators import translate as T


def _blocks(spark, tables, texts):
    rows = [(f"b{i}", h, t) for i, (h, t) in enumerate(zip(tables, texts))]
    df = spark.createDataFrame(rows, "block_id string, html string, text string")
    table = make_atom("table", id=F.lit("t"), rows=html_table(F.col("html"))["rows"])
    atoms = F.concat(widen(inline_atoms(F.col("text"))), F.array(table), widen(inline_atoms(F.col("text"))))
    return df.select(F.lit(1).alias("doc_id"), "block_id", F.struct(F.lit("").alias("plainText"), atoms.alias("atoms")).alias("content"))


def test_offsets_lie_where_the_text_has_them(spark):
    rng = random.Random(3)
    cells = ["", "A", "x 🙂 y", "$a$ [1]", "long cell"]

    def table():
        rows = [[rng.choice(cells) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"

    fixed = ["<table><tr><td>A</td><td></td><td>C</td></tr></table>", "<table><tr><td></td><td>B</td></tr><tr><td>C</td></tr></table>",
             "<table><tr><td>A</td><td></td></tr><tr><td></td></tr><tr><td>D</td></tr></table>"]
    tables = fixed + [table() for _ in range(40)]
    blocks = _blocks(spark, tables, [rng.choice(["", "see $x$ [2] 🙂"]) for _ in tables])
    texts = D.block_plain_text(blocks).select("block_id", "plain_text")
    rows = D.atom_offsets(blocks).join(texts, "block_id").withColumn(
        "there", utf16_slice("plain_text", F.col("start_utf16"), F.col("end_utf16"))).collect()
    assert rows and all(r.there == r.text for r in rows)
    first = {(r.block_id, r.text): (r.start_utf16, r.end_utf16) for r in rows if r.block_id == "b0" and r.text in "AC"}
    start = min(a for a, _ in first.values())
    assert first["b0", "C"] == (start + 7, start + 8)


def test_commit_is_whole_or_not_at_all(spark):
    old = spark.createDataFrame(
        [(f"{j}{b}", j, b, "queued", None, None, None, None, None, b != "gone", 1) for j in ("j1", "j2", "j3") for b in ("a", "b", "gone")],
        "id string, job_id string, block_id string, state string, target_json string, target_plain_text string, validation_json string, "
        "error_code string, error_message string, is_active boolean, updated_at long")
    judged = spark.createDataFrame(
        [("j1", "a", None), ("j1", "gone", None), ("j1", "b", "invalid"), ("j2", "a", None), ("j2", "b", None), ("j3", "a", None)],
        "job_id string, block_id string, code string").select("*", *[F.lit(None).cast("string").alias(c) for c in (
            "safe_message", "target_json", "target_plain_text")], F.lit(9).cast("long").alias("at"))
    jobs = spark.createDataFrame([("j1", "running"), ("j2", "running"), ("j3", "cancelled")], "id string, state string")
    rows, errors = T.commit_results(old, judged, jobs)
    states = {(r.job_id, r.block_id): r.state for r in rows.collect()}
    assert (states["j1", "a"], states["j1", "b"], states["j1", "gone"]) == ("queued", "failed", "queued")
    assert (states["j2", "a"], states["j2", "b"], states["j3", "a"]) == ("ready", "ready", "queued")
    assert {tuple(r) for r in errors.collect()} == {("j1", "gone", "cache_changed"), ("j3", "a", "job_cancelled")}


def test_cancelled_job_prepares_nothing(spark):
    schema = ("id string, job_id string, block_id string, request_digest string, source_digest string, state string, error_code string, "
              "error_message string, is_active boolean, created_at long, updated_at long")
    old = spark.createDataFrame([("t1", "j0", "a", "d1", "s", "failed", "x", "y", True, 1, 1), ("t2", "j0", "b", "d1", "s", "ready", None, None, True, 1, 1)], schema)
    wanted = spark.createDataFrame([("n1", "j1", "a", "d2", "s", 5), ("n2", "off", "b", "d2", "s", 5)],
                                   "id string, job_id string, block_id string, request_digest string, source_digest string, at long")
    rows, missing = T.activate_records(old, wanted, spark.createDataFrame([("off", "cancelled"), ("j1", "running")], "id string, state string"))
    assert {(r.id, r.is_active) for r in rows.collect()} == {("t1", False), ("n1", True), ("t2", True)}
    assert [r.block_id for r in missing.collect()] == ["a"]


def test_import_opens_and_makes_available(spark):
    schema = "sha256 string, id string, file_state string, last_opened_at long, created_at long, updated_at long"
    library = spark.createDataFrame([("h1", "d1", "missing", 3, 1, 1)], schema)
    incoming = spark.createDataFrame([("h1", "x", "changed", None, 50), ("h2", "d2", "changed", 7, 60)],
                                     "sha256 string, id string, file_state string, last_opened_at long, imported_at long")
    got = {r.id: (r.file_state, r.last_opened_at, r.created_at, r.updated_at) for r in L.upsert_documents(library, incoming).collect()}
    assert got == {"d1": ("available", 50, 1, 50), "d2": ("available", 60, 60, 60)}
