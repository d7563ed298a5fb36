"""Base spans against plain patterns; identifiers found by contexts on planted texts."""

import hashlib
import random
import re

import pytest

from docloom.llm import personal

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()
PLAIN = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def holds(kind, found):
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        double = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in double) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    out = [(k, *m.span()) for k, p in PLAIN for m in p.finditer(text) if holds(k, m.group())]
    return sorted(out, key=lambda s: (s[1], [k for k, _ in PLAIN].index(s[0])))


def test_base_spans_on_noise():
    rng = random.Random(2)
    for _ in range(6000):
        text = "".join(rng.choice("ab@@.-+_%12345 ()é.") for _ in range(rng.randrange(40)))
        assert personal.base_spans(text) == plain_spans(text), text
    for _ in range(3000):
        text = "".join(rng.choice("0123456789 -.+") for _ in range(rng.randrange(60)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("x" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "a.b@c" * 60_000):
        personal.candidates(text, personal.base_spans(text))


def test_report_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = personal.report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k, _ in PLAIN]
        assert set(written.split(",")) <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def planted(spark):
    """Cues before seeds and before identifiers that no base pattern matches."""
    rng = random.Random(7)
    filler = [f"word{c}" for c in "abcdefghijkl"]

    def text(*middle):
        return " ".join([*rng.choices(filler, k=6), *middle, *rng.choices(filler, k=6)])

    rows, hidden, clean = [], {}, set()
    for i in range(300):
        number = f"{rng.randrange(200, 999)} {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        if i % 6 == 0:
            rows.append((i, text("call me at", f"+1 {number}", "tonight")))
        elif i % 6 == 1:
            rows.append((i, text("my mail is", f"user{i}@mail{i % 9}.example.com")))
        elif i % 6 == 2:
            string = number.replace(" ", "-")
            rows.append((i, text("call me at", string, "tonight")))
            hidden[i] = ("context_phone", string)
        elif i % 6 == 3:
            string = f"user{i}@localhost"
            rows.append((i, text("my mail is", string)))
            hidden[i] = ("context_email", string)
        elif i % 6 == 4:
            rows.append((i, text("order number", str(rng.randrange(10 ** 6, 10 ** 7)), "shipped")))
            clean.add(i)
        else:
            rows.append((i, text("plain prose")))
            clean.add(i)
    # a chain: strings found by one context teach another
    for i in range(300, 306):
        string = f"{rng.randrange(200, 999)}-555-{i}"
        rows += [(2 * i, text("call me at", string, "tonight")), (2 * i + 1, text("or text", string, "now"))]
    return spark.createDataFrame(rows, "doc_id long, text string"), hidden, clean


def test_contexts_find_unseen_identifiers(planted):
    docs, hidden, clean = planted
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start:s.end]) for s in r.spans] for r in personal.find(docs).collect()}
    assert all(hidden[i] in got[i] for i in hidden)
    assert all(not got[i] for i in clean)
    # what one context gave away has taught another
    assert all(len(got[i]) == 1 and got[i][0][0] == "context_phone" for i in range(600, 612))


def test_graph_of_patterns_and_strings(planted):
    docs, _, _ = planted
    kinds, names = personal.learn(personal.survey(docs))
    patterns = {r.pattern: r.kind for r in kinds.collect()}
    assert patterns["me at _"] == 3 and patterns["mail is _"] == 0 and not any("number" in p for p in patterns)
    assert names.count() == len({personal._named(s) for _, s in planted[1].values()}) + 6


def test_edges(edge, nothing):
    got = {}
    for r in personal.report(edge).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == edge.count() and len(got[9]) == len(got[13]) == 2
    assert all(got[i][0].spans == "" and got[i][0].base_sha256 == EMPTY for i in (1, 2, 3, 12))
    assert personal.report(nothing).count() == 0


def test_repeated_rows_and_null_ids_keep_their_spans(spark):
    rows = [(1, "call me at +1 555 123 4567"), (1, "call me at +1 555 123 4567"), (1, "a@b.cd"), (None, "a@b.cd"), (None, None)]
    got = sorted((str(r.doc_id), r.spans) for r in personal.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "email:0:6"), ("1", "phone:11:26"), ("1", "phone:11:26"), ("None", ""), ("None", "email:0:6")]
