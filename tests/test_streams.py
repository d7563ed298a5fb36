"""Streams over several micro-batches: order, expiry, timers, late rows, and what they keep."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from docloom.operators import sessions as K
from docloom.operators.translate import read_records
from docloom.plans.bridge import in_turns
from docloom.streaming import processors as X
from docloom.streaming import sinks

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
COMMANDS = "session_id string, seq long, command_id string, expected_revision long, type string, failed boolean, at timestamp"


def commands(spark, rows):
    return spark.createDataFrame([(s, i, c, e, t, f, START + timedelta(hours=h)) for s, i, c, e, t, f, h in rows], COMMANDS)


def loop(rows, keep):
    """Receipts by a plain loop; keep in hours."""
    state, out = {}, {}
    for s, i, c, e, t, f, h in sorted(rows, key=lambda r: (r[0], r[1])):
        revision, receipts = state.setdefault(s, [0, {}])
        if c in receipts and h - receipts[c][1] <= keep:
            out[s, i] = ("duplicate", receipts[c][0])
            continue
        ok = not f and (e is None or t == K.FREE_COMMAND or e == revision)
        state[s][0] = revision = revision + ok
        receipts[c] = (revision, h)
        out[s, i] = ("accepted" if ok else "rejected", revision)
    return out


def some_commands(seed, n=240):
    rng = random.Random(seed)
    rows, hour = [], 0
    for i in range(n):
        hour += rng.choice((0, 0, 1, 5))
        rows.append((rng.choice(["a", "a", "b", "c"]), i, f"cmd{rng.randrange(12) if rng.random() < .5 else i + 100}",
                     rng.choice([None, rng.randrange(30)]), rng.choice(["x", K.FREE_COMMAND]), rng.random() < .1, hour))
    return rows


@pytest.mark.parametrize("ranges", [1, 9])
def test_receipts_expire_in_batch(spark, ranges):
    rows = some_commands(1)
    want = loop(rows, 24)
    assert sum(v[0] == "duplicate" for v in want.values()) != sum(v[0] == "duplicate" for v in loop(rows, 10 ** 6).values())
    got = K.replay_commands(commands(spark, rows), ranges, K.KEEP_RECEIPTS).collect()
    assert {(r["session_id"], r["seq"]): (r["status"], r["revision"]) for r in got} == want


def test_receipts_expire_in_the_stream(spark, tmp_path):
    """The same rows in six micro-batches; what is remembered falls when the watermark moves on."""
    rows = some_commands(2)
    df = commands(spark, rows).withColumn("turn", F.floor(F.col("seq") / 40))
    stream = X.stream_commands(in_turns(df, "session_id", F.col("turn"), 6, 2))
    got = sinks.drain(stream, str(tmp_path)).collect()
    assert {(r["session_id"], r["seq"]): (r["status"], r["revision"]) for r in got} == loop(rows, 24)


def test_state_of_commands_shrinks(spark, tmp_path):
    """A session with many receipts, then one that is days later: only the last day's are left.

    The receipts are read from the stored state after every batch.
    """
    early = [("a", i, f"c{i}", None, "x", False, 0) for i in range(50)]
    late = [("a", 50 + i, f"d{i}", None, "x", False, 24 * (i + 3)) for i in range(4)]
    df = commands(spark, early + late).withColumn("turn", F.greatest(F.lit(0), F.col("seq") - 49))
    stream = X.stream_commands(in_turns(df, "session_id", F.col("turn"), 5, 1))
    spark.conf.set(*sinks.STORE)
    query = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()

    def kept(batch):
        state = spark.read.format("statestore").option("batchId", batch).option("stateVarName", "receipts").load(str(tmp_path))
        return state.count()

    sizes = [kept(p["batchId"]) for p in query.recentProgress]
    assert max(sizes) >= 50 and sizes[-1] < 20


def test_late_touches_are_dropped(spark, tmp_path):
    def touch(client, minute, beat=False):
        return (client, "doc", START + timedelta(minutes=minute), beat)

    turns = [[touch("a", 0), touch("a", 1, True), touch("b", 0, True)], [touch("a", 30)], [touch("a", 31)], [touch("a", 3), touch("c", 90)]]
    rows = [(*t, n) for n, part in enumerate(turns) for t in part]
    df = spark.createDataFrame(rows, "client_id string, resource_id string, ts timestamp, heartbeat boolean, turn int")
    got = sinks.drain(X.stream_leases(in_turns(df, "resource_id", F.col("turn"), 4, 1)), str(tmp_path)).collect()
    # b never touched; minute 3 came after the watermark; the lease of minute 90 is still open
    found = sorted((r["client_id"], (r["started_at"].minute, r["expires_at"].minute), r["touches"]) for r in got)
    assert found == [("a", (0, 3), 2), ("a", (30, 33), 2)]


def answers(rng, n):
    out = {}
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(1, 9)):
            text += rng.choice(["word ", "模型 🙂 ", "x" * 3000, "⟦WEAVE-CITE:ok⟧", "⟦WEAVE-CITE:no⟧", "⟦"])
        out[f"r{i}"] = text
    return out


def test_answers_by_checkpoints(spark, tmp_path):
    """Fragments out of order over four micro-batches: parts follow one another and make up the text."""
    rng = random.Random(4)
    texts = answers(rng, 12)
    rows = []
    for key, text in texts.items():
        cut = sorted(rng.sample(range(len(text) + 1), min(len(text), 7)))
        parts = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)])]
        rows += [(key, i, p, False, ["ok"], rng.randrange(4)) for i, p in enumerate(parts)] + [(key, len(parts), "", True, ["ok"], 3)]
    df = spark.createDataFrame(rows, "request_id string, seq long, fragment string, done boolean, allowed array<string>, turn int")
    events = {}
    for r in sinks.drain(X.stream_responses(in_turns(df, "request_id", F.col("turn"), 4, 1)), str(tmp_path), timers=True).collect():
        events.setdefault(r["request_id"], []).append(r)
    for key, text in texts.items():
        reader = X.CitationReader(["ok"])
        want = reader.feed(text, True)
        got = sorted(events[key], key=lambda r: r["event_no"])
        assert [r["event_no"] for r in got] == list(range(len(got))) and got[-1]["event"] == "final"
        parts = [r for r in got if r["event"] in ("checkpoint", "final")]
        assert "".join(p["value"] for p in parts) == "".join(v for k, v in want if k == "text")
        assert [p["start"] for p in parts] == [sum(len(q["value"]) for q in parts[:i]) for i in range(len(parts))]
        assert [(r["event"], r["value"]) for r in got if r["event"] in ("citation", "warning")] == [e for e in want if e[0] != "text"]


def test_answer_that_stops_is_saved_by_the_timer(spark, tmp_path):
    rows = [("r", 0, "first", False, ["ok"], 0), ("r", 1, " second", False, ["ok"], 1), ("r", 3, "waits", False, ["ok"], 1)]
    df = spark.createDataFrame(rows, "request_id string, seq long, fragment string, done boolean, allowed array<string>, turn int")
    got = sinks.drain(X.stream_responses(in_turns(df, "request_id", F.col("turn"), 2, 1)), str(tmp_path), timers=True).collect()
    assert sorted((r["event_no"], r["event"], r["start"], r["value"]) for r in got) == [(0, "checkpoint", 0, "first"), (1, "checkpoint", 5, " second")]


class _List:
    """A list state in memory."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []


def test_waiting_fragments_are_limited(monkeypatch):
    monkeypatch.setattr(X, "MAX_RESPONSE_BYTES", 10)
    row = lambda seq, text: type("R", (), dict(seq=seq, fragment=text, done=False))
    line = X.Fragments(_List())
    assert line.take([row(2, "abc"), row(0, "x")], 0) == ([("x", False)], 1, False)
    assert line.take([row(1, "y"), row(2, "again"), row(0, "old")], 1) == ([("y", False), ("abc", False)], 3, False)
    assert line.state.rows == [] and line.take([row(9, "0123456789a")], 3)[2] and line.state.rows == []


def bodies():
    one, two = '{"id":"a","target":"x \\"{}\\" \\\\"}', '{"id":"b","target":"模🙂"}'
    return [
        f"[{one},{two}]", one, f"{one}\n{two}", f"```json\n[{one},\n{two}]\n```", f"Here: {one} \\ {two} {{\"id\": \"torn", "", "[]", " [ ] ", "none {at} all",
        f"  ```\n{one}\n ``` x\n{two}", f"``\n{one}", '{"id":"a","target":"x","note":1}' + two, '{"id":"a",\n"target":"x"}', f"}} {one} {{ {two}",
        f'\\"{one}', f"[{one}, 5]", '{"id":"a","id":"b","target":"x"}']


def test_scanner_equals_the_whole_text():
    """Any cut gives the records of the whole body, each before the end of what follows it."""
    rng = random.Random(5)
    for body in bodies():
        lines = [x for x in body.split("\n") if not x.lstrip().startswith("```")]
        want = read_records("\n".join(lines).strip())
        for _ in range(30):
            cuts = sorted(rng.randrange(len(body) + 1) for _ in range(rng.randrange(6)))
            scanner, found = X.RecordScanner(*X.RecordScanner.NEW), []
            pieces = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)])]
            for i, piece in enumerate(pieces):
                found += scanner.feed(piece, i + 1 == len(pieces))
                scanner = X.RecordScanner(*scanner.state())
            records = [r for r in map(X.load_record, found) if r]
            assert records == (want or []), body
            assert (want is None) == (not records and not scanner.empty()), body


def test_records_leave_before_the_end(spark, tmp_path):
    """Records of an unfinished response, one that ends by an error, one without any, one too large."""
    js = [json.dumps({"id": f"b{i}", "target": "t" * i}) for i in range(6)]
    rows = []
    for key, parts, end in (("open", js, False), ("error", js[:3] + ['{"id":"b9"'], True), ("none", ["sorry"], True)):
        rows += [(key, 2 * i + h, half, False, i % 3) for i, p in enumerate(parts) for h, half in enumerate((p[:7], p[7:]))]
        rows += [(key, 2 * len(parts), "", True, 2)] if end else []
    df = spark.createDataFrame(rows, "request_id string, seq long, fragment string, done boolean, turn int")
    got = sinks.drain(X.stream_translation_records(in_turns(df, "request_id", F.col("turn"), 3, 1)), str(tmp_path), timers=True).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["ord"]):
        found.setdefault(r["request_id"], []).append((r["ord"], r["block_id"], r["error_code"]))
    assert found == {"open": [(i, f"b{i}", None) for i in range(6)], "error": [(i, f"b{i}", None) for i in range(3)], "none": [(-1, None, "invalid_json")]}


def test_job_events_over_batches(spark, tmp_path):
    states = ["queued", "running", "running", "failed", "queued", "cancelled", "running"]
    df = spark.createDataFrame([("j", i, s) for i, s in enumerate(states)], "job_id string, seq long, state string")
    got = sinks.drain(X.stream_job_events(in_turns(df, "job_id", F.floor(F.col("seq") / 3), 3, 1)), str(tmp_path), timers=True).collect()
    assert sorted((r["sequence"], r["state"], r["created_at"]) for r in got) == [(1, "queued", 0), (2, "running", 1), (3, "failed", 3), (4, "queued", 4), (5, "cancelled", 5)]


def _groups(spark, path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(path)).select("key").distinct().count()


def test_responses_share_groups(spark, tmp_path, monkeypatch):
    """Forty responses over three micro-batches in three groups: state is read by group, records stay each response's own."""
    monkeypatch.setattr(X, "GROUPS", 3)
    js = [json.dumps({"id": f"b{i}", "target": "{" * i}) for i in range(3)]
    rows = [(f"r{k:02}", 2 * i + h, half, False, i) for k in range(40) for i, p in enumerate(js[: 1 + k % 3]) for h, half in enumerate((p[:9], p[9:]))]
    rows += [(f"r{k:02}", 2 + 2 * (k % 3), "", True, 2) for k in range(0, 40, 2)] + [(f"r{k:02}", 90, "{", False, 0) for k in range(1, 40, 2)]
    df = spark.createDataFrame(rows, "request_id string, seq long, fragment string, done boolean, turn int")
    got = sinks.drain(X.stream_translation_records(in_turns(df, "request_id", F.col("turn"), 3, 1)), str(tmp_path), timers=True, idle=1).collect()
    assert sorted((r["request_id"], r["ord"], r["block_id"]) for r in got) == [(f"r{k:02}", i, f"b{i}") for k in range(40) for i in range(1 + k % 3)]
    assert _groups(spark, tmp_path / "checkpoint", "open") <= 3 and _groups(spark, tmp_path / "checkpoint", "closed") <= 3


def test_jobs_share_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "GROUPS", 3)
    df = spark.createDataFrame([(f"j{i % 40}", i, str(i // 80)) for i in range(240)], "job_id string, seq long, state string")
    got = sinks.drain(X.stream_job_events(in_turns(df, "job_id", F.floor(F.col("seq") / 100), 3, 1)), str(tmp_path), timers=True, idle=1).collect()
    want = [(f"j{k}", n + 1, str(n), 80 * n + k) for k in range(40) for n in range(3)]
    assert sorted((r["job_id"], r["sequence"], r["state"], r["created_at"]) for r in got) == sorted(want)
    assert _groups(spark, tmp_path / "checkpoint", "jobs") <= 3


class _Value:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    """State variables in memory and a clock."""

    def __init__(self):
        self.now = 10 ** 9

    def getListState(self, *_, **__):
        return _List()

    def getValueState(self, *_, **__):
        return _Value()

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_idle_keys_of_a_busy_group_are_forgotten():
    """A key without news goes after its time to live, though others of its group have news."""
    import pandas as pd

    clock = _Handle()
    jobs, records = X.JobEvents(), X.Records()
    jobs.init(clock)
    records.init(clock)

    def take(processor, columns, *rows):
        return [tuple(r) for frame in processor.handleInputRows((0,), iter([pd.DataFrame(rows, columns=columns)]), clock) for r in frame.itertuples(index=False)]

    job, response = ["job_id", "seq", "state"], ["request_id", "seq", "fragment", "done"]
    assert len(take(jobs, job, ("a", 0, "queued"), ("b", 1, "queued"))) == 2
    assert take(records, response, ("a", 0, '{"id":', False), ("b", 0, '{"id":', False), ("c", 0, "", True)) == []
    clock.now += X.IDLE_MS - 1
    assert take(records, response, ("b", 1, '"x",', False), ("c", 1, "late", True)) == []
    clock.now += 2
    assert take(records, response, ("b", 2, '"target":"y"}', False))[0][:3] == ("b", 0, "x")
    assert [r[0] for r in records.open.rows] == ["b"]
    # c is forgotten too, so it is read anew
    assert take(records, response, ("c", 0, "sorry", True))[0][-1] == "invalid_json"
    clock.now += X.JOB_IDLE_MS - X.IDLE_MS - 2
    assert take(jobs, job, ("b", 2, "queued")) == []
    clock.now += 2
    assert take(jobs, job, ("b", 3, "running")) == [("b", 2, "running", 3)] and jobs.jobs.value[0] == ["b"]


def test_upserts_rewrite_touched_parts_only(spark, tmp_path):
    """Three turns, the last of one key: the other parts' files stay, and a batch that comes again changes nothing."""
    rows = [(f"k{i % 9}", i, i // 20) for i in range(40)] + [("k1", 99, 2)]
    df = spark.createDataFrame(rows, "document_id string, updated_at long, turn int")

    def last(table, batch):
        return table.unionByName(batch.drop("turn")).groupBy("document_id").agg(F.max("updated_at").alias("updated_at"))

    root, parts = str(tmp_path / "fold"), lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "fold" / "table").glob("part=*/*.parquet")}
    empty = df.drop("turn").limit(0)
    sinks.fold_stream(in_turns(df.filter("turn < 2"), "document_id", F.col("turn"), 2, 1), empty, last, "document_id", root)
    before = parts()
    again = in_turns(df.filter("turn = 2"), "document_id", F.col("turn") - 2, 1, 1)
    (tmp_path / "fold" / "checkpoint").rename(tmp_path / "old")
    out = sinks.fold_stream(again, empty, last, "document_id", root)
    assert {r["document_id"]: r["updated_at"] for r in out.collect()} == {f"k{k}": max(u for d, u, _ in rows if d == f"k{k}") for k in range(9)}
    kept = set(before) & set(parts())
    assert len(kept) >= len(before) - 1 and len(kept) > 3


def test_imports_in_any_order(spark, tmp_path):
    """The first id is the earliest import's, not the first one to arrive; a table may be a folder of files."""
    from docloom.plans.bridge import StreamCorpus

    docs = [(i, f"text {i % 3}\nx", "en", "s", 10) for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (df.filter("doc_id >= 6"), df.filter("doc_id < 3"), df.filter("doc_id BETWEEN 3 AND 5")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    c = StreamCorpus(spark, str(tmp_path))
    empty = StreamCorpus.__mro__[1](spark, str(tmp_path)).library.limit(0)
    many = c.imports
    assert many.isStreaming
    turns = in_turns(StreamCorpus.__mro__[1](spark, str(tmp_path)).imports, "id", 2 - F.floor(F.col("imported_at") / 3), 3, 1)
    for stream in (many, turns):
        got = {r["id"]: (r["created_at"], r["updated_at"]) for r in sinks.stream_upsert_library(stream, empty).collect()}
        assert got == {f"doc-{i}": (i, i + 6) for i in range(3)}
