"""Ordered scans, packing, digests, inline atoms: small inputs against plain definitions."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.atoms import html_table, inline_atoms, read_table
from docloom.functions.digest import ordered_digest
from docloom.functions.packing import apply_steps, chunk_steps, next_fit, pack_run
from docloom.functions.scan import RANGE, Fold, lay_out, ordered_fold, ordered_row_number, ordered_scan, spanning
from docloom.functions.text import clean_text, length_prefixed_sha, splits_surrogate, utf16_len, utf16_slice


def _rows(spark, groups=5, size=40, seed=1):
    rnd = random.Random(seed)
    rows = []
    for g in range(groups):
        for pos in sorted(rnd.sample(range(size * 3), size if g else size * 2)):
            rows.append((f"g{g}", pos, rnd.randint(-5, 5), rnd.random() < 0.3))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "k string, pos long, v long, flag boolean")


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_scan_equals_window(spark, inclusive, reverse):
    df = _rows(spark)
    order = F.col("pos").desc() if reverse else F.col("pos")
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.select("k", "pos", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max(F.when(F.col("flag"), F.col("v"))).over(w).alias("m"))
    aggs = {"s": ("sum", F.col("v")), "m": ("max", F.when(F.col("flag"), F.col("v")))}
    for laid in (df, lay_out(df, ["k"], "pos", 1), lay_out(df, ["k"], "pos", 13)):
        got = ordered_scan(laid, ["k"], "pos", aggs, inclusive=inclusive, reverse=reverse)
        assert sorted(got.select("k", "pos", "s", "m").collect()) == sorted(want.collect()) or _same(got, want)


def _same(got, want):
    key = lambda r: (r["k"], r["pos"])
    a = [tuple(r) for r in sorted(got.select("k", "pos", "s", "m").collect(), key=key)]
    return a == [tuple(r) for r in sorted(want.collect(), key=key)]


def test_row_number(spark):
    df = _rows(spark)
    w = Window.partitionBy("k").orderBy("pos")
    want = {(r["k"], r["pos"]): r["n"] for r in df.select("k", "pos", F.row_number().over(w).alias("n")).collect()}
    numbered = {(r["k"], r["pos"]): r["n"] for r in ordered_row_number(lay_out(df, ["k"], "pos", 9), ["k"], "pos", "n").collect()}
    assert numbered == want


def test_ranges_follow_rows_and_not_positions(spark):
    """Sparse positions, a third of all rows in one key, a null key: a summary for each range and key at most."""
    rnd = random.Random(6)
    rows = [("hot", rnd.randrange(1 << 50)) for _ in range(1000)] + [(None, rnd.randrange(1 << 50)) for _ in range(400)]
    rows += [(f"k{rnd.randrange(300)}", rnd.randrange(1 << 50)) for _ in range(1600)]
    rows = sorted(set(rows), key=str)
    rnd.shuffle(rows)
    laid = lay_out(spark.createDataFrame(rows, "k string, pos long"), ["k"], "pos", 12)
    sizes = [r["count"] for r in laid.groupBy(RANGE).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 3 * len(rows) / 12
    assert laid.select("k", RANGE).distinct().count() <= laid.select("k").distinct().count() + 11
    assert {r["k"] for r in spanning(laid, ["k"]).collect()} >= {"hot", None} and spanning(laid, ["k"]).count() <= 11
    want, count = {}, {}
    for k, pos in sorted(rows, key=lambda r: r[1]):
        count[k] = count.get(k, 0) + 1
        want[k, pos] = count[k]
    assert {(r["k"], r["pos"]): r["n"] for r in ordered_row_number(laid, ["k"], "pos", "n").collect()} == want
    plan = ordered_scan(ordered_scan(laid, ["k"], "pos", {"a": ("sum", F.lit(1))}), ["k"], "pos", {"b": ("max", F.col("a"))})
    text = plan._jdf.queryExecution().executedPlan().toString()
    # rows are shuffled for the first scan only; what else moves are summaries
    assert text.count("SortMergeJoin") == 0


def test_fold_carries_its_state(spark):
    """A machine that forgets everything at a negative value, over spanning and small groups and a null key."""
    rnd = random.Random(8)
    rows = [(k, i * 7, rnd.randint(-2, 9)) for k, n in (("a", 90), ("b", 3), (None, 50), ("c", 1)) for i in range(n)]

    def replay(pdf, state):
        out, at = [], state[0]
        for v in pdf["v"]:
            at = 0 if v < 0 else at + v
            out.append(at)
        return {"level": np.array(out)}, (at,)

    def summarize(pdf):
        values = pdf["v"].tolist()
        last = max((i for i, v in enumerate(values) if v < 0), default=-1)
        return {"reset": last >= 0, "add": sum(values[last + 1:])}

    fold = Fold((5,), "at long", "reset boolean, add long", "level long", summarize,
                lambda row, state: ((0 if row.reset else state[0]) + row.add,), replay)
    want, level = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        level[k] = 0 if v < 0 else level.get(k, 5) + v
        want[k, i] = level[k]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    for ranges in (1, 8):
        got = ordered_fold(lay_out(df, ["k"], "i", ranges), ["k"], "i", fold, ["v"])
        assert {(r["k"], r["i"]): r["level"] for r in got.collect()} == want


def naive_pack(weights, cap):
    out, used, number = [], 0, -1
    for w in weights:
        if used and used + w <= cap:
            used += w
            out.append(number)
        elif w > cap:
            used = 0
            out.append(-1)
        else:
            number, used = number + 1, w
            out.append(number)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 14), min_size=1, max_size=60), st.integers(1, 9))
def test_packing_in_chunks_equals_one_pass(weights, size):
    cap = 10
    want = naive_pack(weights, cap)
    assert pack_run(np.array(weights), cap, 0, -1)[0].tolist() == want
    used, number, got = 0, -1, []
    for at in range(0, len(weights), size):
        part = np.array(weights[at:at + size])
        steps = type("Row", (), chunk_steps(part, cap))
        got.extend(pack_run(part, cap, used, number)[0].tolist())
        used, number = apply_steps(steps, cap, used, number)
    assert got == want


def test_next_fit_of_a_hot_group(spark):
    rnd = random.Random(3)
    rows = [(g, i, rnd.randint(1, 12)) for g, n in (("hot", 200), ("a", 4), ("b", 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, w int")
    want = {}
    for g in ("hot", "a", "b"):
        want.update({(g, i): b for i, b in enumerate(naive_pack([w for k, _, w in rows if k == g], 10))})
    for ranges in (11, 1, None):
        got = {(r["g"], r["o"]): -1 if r["batch"] is None else r["batch"] for r in next_fit(df, ["g"], "o", "w", 10, ranges).collect()}
        assert got == want


def test_ordered_digest(spark):
    df = spark.createDataFrame([("a", i, f"d{i}") for i in range(5)], "k string, o int, d string").repartition(3)
    part = F.concat(F.unhex(F.lit("00")), F.encode("d", "UTF-8"))
    got = ordered_digest(df, ["k"], "o", part, F.encode(F.lit("T"), "UTF-8"), "h").first()["h"]
    assert got == hashlib.sha256(b"T" + b"".join(b"\0d%d" % i for i in range(5))).hexdigest()
    # one digest for every size, however the rows lie
    big = spark.range(70_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("d"))
    for rows in (big, big.repartition(7)):
        found = {r["k"]: r["h"] for r in ordered_digest(rows, ["k"], "o", part, None, "h").collect()}
        assert found == {k: hashlib.sha256(b"".join(b"\0%d" % i for i in range(k, 70_000, 2))).hexdigest() for k in (0, 1)}


def test_text_helpers(spark):
    row = spark.createDataFrame([("模型🙂采用该假设。", " a　\n b ")], "t string, s string").select(
        utf16_len("t").alias("n"), utf16_slice("t", F.lit(4), F.lit(9)).alias("slice"), splits_surrogate("t", F.lit(3)).alias("torn"),
        splits_surrogate("t", F.lit(4)).alias("whole"), clean_text("s").alias("clean"), length_prefixed_sha("s", F.lit("")).alias("h")).first()
    assert (row["n"], row["slice"], row["torn"], row["whole"], row["clean"]) == (10, "采用该假设", True, False, "a b")
    raw = " a　\n b ".encode()
    assert row["h"] == hashlib.sha256(len(raw).to_bytes(8, "big") + raw + (0).to_bytes(8, "big")).hexdigest()


def test_inline_atoms(spark):
    def kinds(text):
        row = spark.createDataFrame([(text,)], "t string").select(inline_atoms(F.col("t")).alias("a")).first()
        return [(a["type"], a["value"] or a["latex"] or a["label"]) for a in row["a"]]

    assert kinds("See $x+y$ in [3, 4].") == [
        ("text", "See "), ("formula", "x+y"), ("text", " in "), ("citation", "[3, 4]"), ("text", ".")]
    assert kinds(r"cost \$5 and $$ x") == [("text", r"cost \$5 and $$ x")]
    assert kinds("[a [1] [2–3]") == [("text", "[a [1] "), ("citation", "[2–3]")]
    # after a formula the search for brackets starts anew
    assert kinds("[a $x$ [1]") == [("text", "[a "), ("formula", "x"), ("text", " "), ("citation", "[1]")]
    assert kinds("$$a$") == [("text", "$$a$")]
    assert kinds("") == [] and kinds(r"$a\$ [1]") == [("text", r"$a\$ "), ("citation", "[1]")]


def test_tables(spark):
    rows, error = read_table("<table><tr><th rowspan='2'>A</th><td colspan=3>b <i>c</i></td><td>d</td></tr><tr></tr><tr><td>$x$</td></tr></table>")
    assert error is None
    assert [(c["row"], c["column"], c["rowSpan"], c["columnSpan"]) for r in rows for c in r] == [
        (0, 0, 2, 1), (0, 1, 1, 3), (0, 4, 1, 1), (2, 0, 1, 1)]
    assert rows[0][1]["text"] == "b c"
    assert read_table("<table><tr><td rowspan='0'>x</td></tr></table>")[1] == "rowspan_out_of_range"
    # tags outside a table count for nothing; cells make rows; a nested table is part of its cell
    texts = lambda html: [[c["text"] for c in r] for r in read_table(html)[0]]
    assert texts("<tr><td>x</td></tr>") == []
    assert texts("<table><tr><td>a<td>b</tr><td>c</table>") == [["a", "b"], ["c"]]
    assert texts("<table><tr><td>o<table><tr><td>i</td></tr></table>rest</td><td>n</td></tr></table>") == [["o i rest", "i", "n"], ["i"]]
    got = spark.createDataFrame([("<table><td>$x$ [1]</table>",), (None,)], "h string").select(html_table(F.col("h")).alias("t")).collect()
    assert [a["type"] for a in got[0]["t"]["rows"][0][0]["content"]] == ["formula", "text", "citation"] and got[1]["t"]["rows"] == []
