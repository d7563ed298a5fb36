"""Translation, conversation, session and stream rules against direct definitions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import conversation as C
from docloom.operators import sessions as K
from docloom.operators import translate as T
from docloom.streaming.processors import CitationReader
from tests.test_normalize import SHA, run, text

CONFIG = T.TranslationConfig("m", "fp", 4096)


def test_protect_and_restore_is_identity(spark):
    body = "<table><tr><td>A $y$</td><td>B</td></tr><tr><td></td><td>[1]</td></tr></table>"
    n, _ = run(spark, {"d": [text("T", 1), text("See $x$ in [1]."), {"type": "table", "table_body": body, "img_path": "images/a.png"}, text("$z$ first")]},
               [("d", 0, "images/a.png", SHA, "image/png", 5)])
    prepared = T.prepare_blocks(n.blocks, CONFIG)
    back = T.restore_targets(prepared.withColumn("target", F.col("source"))).join(
        n.blocks.select("block_id", "content"), "block_id").select(
        (F.to_json("restored.atoms") == F.to_json("content.atoms")).alias("same"), "source").collect()
    assert len(back) == 3 and all(r["same"] for r in back)
    moved = prepared.filter("kind = 'table'").withColumn("target", F.concat(F.lit("x"), "source"))
    assert T.restore_targets(moved).first()["restored"] is not None
    between = prepared.filter("kind = 'table'").withColumn("target", F.regexp_replace("source", r"(:CE:\d+⟧)", "$1 oops "))
    assert T.restore_targets(between).first()["restored"] is None


def test_read_records():
    one = '{"id":"a","target":"x"}'
    assert T.read_records(f"[{one}]") == [{"id": "a", "target": "x"}]
    assert T.read_records(one + "\n" + one + '\n{"id":"b"') == [{"id": "a", "target": "x"}] * 2
    assert T.read_records('{"id":"a","target":"x","note":1}') is None
    assert T.read_records('{"block_id":"a","target":"x"}') is None
    assert T.read_records('noise {"id":"a","target":"{\\"}"} tail') == [{"id": "a", "target": '{"}'}]
    assert T.read_records("") == []


def test_parse_outputs(spark):
    rows = [("fence", "```json\n[{\"id\":\"a\",\"target\":\"x\"}]\n```"), ("bad", "sorry"), ("empty", "```\n```")]
    records, errors = T.parse_outputs(spark.createDataFrame(rows, "request_id string, body string"))
    assert [(r["request_id"], r["block_id"]) for r in records.collect()] == [("fence", "a")]
    assert [tuple(r) for r in errors.collect()] == [("bad", "invalid_json")]


def test_order_rule_equals_pairs(spark):
    rnd = random.Random(5)
    prepared, records, want = [], [], {}
    for q in range(12):
        size = rnd.randint(1, 7)
        order = list(range(size))
        if q % 3:
            rnd.shuffle(order)
        for i in range(size):
            prepared.append((f"q{q}", f"b{q}-{i}", i, "paragraph", "text", []))
        records.extend((f"q{q}", n, f"b{q}-{i}", "ok") for n, i in enumerate(order))
        bad = {x for a in range(size) for b in range(a + 1, size) if order[a] > order[b] for x in (order[a], order[b])}
        want.update({f"b{q}-{i}": "block_order_changed" if i in bad else None for i in range(size)})
    p = spark.createDataFrame(prepared, f"request_id string, block_id string, order_index int, kind string, source string, markers array<{T.MARKER}>")
    r = spark.createDataFrame(records, "request_id string, ord int, block_id string, target string")
    responses = p.select("request_id", F.lit("stop").alias("finish_reason")).distinct()
    assert {x["block_id"]: x["code"] for x in T.validate_outputs(p, r, responses).collect()} == want


def test_small_window_counts_the_prompt():
    small = T.TranslationConfig("m", "fp", 1024)
    assert small.input_budget < 1024 * 55 // 100 and small.byte_capacity == 3 * small.input_budget


CITED = "Intro ⟦WEAVE-CITE:a⟧ mid ⟦WEAVE-CITE:a⟧⟦WEAVE-CITE:no⟧ ⟦WEAVE not ⟦WEAVE-CITE:" + "y" * 140 + "⟧ end ⟦WEAVE-CITE:b⟧"
TAILS = ["", " ⟦WEAVE-CI", " ⟦WEAVE-CITE:a", " ⟦"]


def read_all(pieces):
    reader, out, body = CitationReader(["a", "b"]), [], ""
    for i, piece in enumerate(pieces):
        for kind, value in reader.feed(piece, i == len(pieces) - 1):
            if kind == "text":
                body += value
            else:
                out.append((kind, value))
    return body, out


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(TAILS), st.lists(st.integers(0, 300), max_size=12))
def test_citations_do_not_depend_on_fragments(tail, cuts):
    whole = CITED + tail
    edges = sorted({0, len(whole), *[c for c in cuts if c < len(whole)]})
    assert read_all([whole[a:b] for a, b in zip(edges, edges[1:])]) == read_all([whole])


@pytest.mark.parametrize("tail", TAILS)
def test_batch_citations_equal_the_reader(spark, tail):
    body, events = read_all([CITED + tail])
    answers = spark.createDataFrame([("r", CITED + tail)], "request_id string, text string")
    allowed = spark.createDataFrame([("r", "a"), ("r", "b")], "request_id string, context_id string")
    texts, cites, warnings = C.extract_citations(answers, allowed)
    assert texts.first()["text"] == body
    assert [r["context_id"] for r in cites.orderBy("order_index").collect()] == [v for k, v in events if k == "citation"]
    assert [r["code"] for r in warnings.orderBy("ord").collect()] == [v for k, v in events if k == "warning"]


def test_selection_cases(spark):
    target = "模型🙂采用该假设。"
    rows = [("ok", "b", "d", 4, 9, "采用该假设"), ("torn", "b", "d", 3, 5, "x"), ("blank", "b", " ", 0, 1, "模"), ("other", "b", "e", 0, 1, "模"),
            ("past", "b", "d", 0, 40, target), ("none", "x", "d", 0, 1, "模")]
    sel = spark.createDataFrame(rows, "selection_id string, block_id string, source_digest string, start_utf16 int, end_utf16 int, selected_text string")
    blocks = spark.createDataFrame([("b", "c", 0, 1, "d", "src")], "block_id string, chapter_id string, order_index int, page int, source_digest string, plain_text string")
    tr = spark.createDataFrame([("b", "d", "ready", target)], "block_id string, source_digest string, state string, target_plain_text string")
    got = {r["selection_id"]: r["error_code"] for r in C.validate_selections(sel, blocks, tr).collect()}
    assert got == {"ok": None, "torn": "stale_selection", "blank": "invalid_input", "other": "stale_selection", "past": "stale_selection", "none": "stale_selection"}


def command_log(spark, n=300, seed=2):
    rnd, rows, level = random.Random(seed), [], {"s": 0, "t": 0}
    for seq in range(n):
        s = "s" if rnd.random() < 0.8 else "t"
        expected = None if rnd.random() < 0.2 else max(level[s] + rnd.choice([0, 0, 0, 1, -1]), 0)
        level[s] += rnd.random() < 0.6
        rows.append((s, seq, f"c{rnd.randint(0, n)}", expected, rnd.choice(["focus_chapter", "reading_assistant"]), rnd.random() < 0.1))
    return rows, spark.createDataFrame(rows, "session_id string, seq long, command_id string, expected_revision long, type string, failed boolean")


@pytest.mark.parametrize("ranges", [1, 16])
def test_replay_equals_a_loop(spark, ranges):
    rows, df = command_log(spark)
    state, want = {}, {}
    for s, seq, cid, expected, kind, failed in rows:
        rev, seen = state.setdefault(s, [0, {}])
        if cid in seen:
            want[seq] = ("duplicate", seen[cid])
            continue
        ok = not failed and (expected is None or kind == "focus_chapter" or expected == rev)
        state[s][0] = rev + ok
        seen[cid] = rev + ok
        want[seq] = ("accepted" if ok else "rejected", rev + ok)
    assert {r["seq"]: (r["status"], r["revision"]) for r in K.replay_commands(df, ranges).collect()} == want


def test_endpoint_variants(spark):
    same = ["https://api.Example.com/v1", " api.example.com/v1/ ", "https://api.example.com:443/v1?x=1", "HTTPS://API.example.com/v1#f"]
    odd = ["http://api.example.com", "https://u@api.example.com", "ftp://x", "", "http://localhost:1234/"]
    df = spark.createDataFrame([("translation", e) for e in same + odd], "kind string, endpoint string")
    rows = {r["endpoint"]: r for r in K.normalize_endpoints(df).collect()}
    assert len({rows[e]["fingerprint"] for e in same}) == 1 and rows[same[0]]["fingerprint"]
    assert [rows[e]["error_code"] for e in odd] == ["insecure_remote_url", "invalid_url", "invalid_url", "invalid_url", None]
