"""Stateful stream operators: commands, leases, answers, translation records, job events.

What a key keeps is bounded and ends: receipts last for a day of event time, fragments that wait for
an earlier one are limited in bytes, answers keep only the text that no checkpoint has carried yet,
translation responses only their unfinished record, and everything idle is dropped after a time to
live. Rows of a key are taken in order of ``seq`` within a micro-batch; a source's limit per trigger
bounds how many those are. Translation responses and jobs are many and keep little each, so a group
of them shares its state.
"""

from __future__ import annotations

import re
from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from docloom.operators.conversation import CITE_TAG, MAX_MARKER_BYTES
from docloom.operators.sessions import FREE_COMMAND, KEEP_RECEIPTS
from docloom.operators.translate import load_record
from docloom.schemas import MAX_RESPONSE_BYTES

# fixed values
CHECKPOINT_BYTES = 8 * 1024
CHECKPOINT_MS = 250
#: Requests and jobs without news are forgotten after so long.
IDLE_MS = 24 * 3600 * 1000
JOB_IDLE_MS = 30 * IDLE_MS


def _none(value):
    return None if value is None or value is pd.NA or (isinstance(value, float) and value != value) else value


def _in_order(rows: Iterator[pd.DataFrame]) -> list:
    # a frame for each key is small, so its columns are read as lists
    out: list = []
    for frame in rows:
        out.extend(map(_row(tuple(frame.columns)), *[frame[c].tolist() for c in frame.columns]))
    return sorted(out, key=lambda r: r.seq)


@lru_cache(16)
def _row(names: tuple[str, ...]):
    return namedtuple("Row", names)


def _run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(processor, StructType.fromDDL(schema), "Append", time_mode)


#: Keys with little state each share so many groups. A call to the state store costs as much as thousands
#: of rows, so it is made for a group; a group is one task's at a time, so it holds few of the keys.
GROUPS = 8192


def _run_together(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    """As :func:`_run`, for a processor that takes the rows of all keys of a group."""
    return _run(rows.withColumn("group", F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")), "group", processor, schema, time_mode)


# ---- commands --------------------------------------------------------------------------
class CommandLog(StatefulProcessor):
    """Revision of a session, and receipts of its commands until they are ``keep_ms`` old.

    Whether a receipt still counts is decided by the commands' own times; timers of event time then
    free the memory, once the watermark says that no command can ask for it any more.
    """

    SCHEMA = "session_id string, seq long, command_id string, status string, revision long"

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.revision = handle.getValueState("revision", "revision long")
        # a list, as a micro-batch adds all its receipts in one call to the store; the last one of a command counts
        self.receipts = handle.getListState("receipts", "command_id string, revision long, at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        revision = (self.revision.get() or (0,))[0]
        receipts = {command: tuple(receipt) for command, *receipt in self.receipts.get()}
        fresh, out, had = {}, [], bool(receipts)
        for row in _in_order(rows):
            at_us = row.at.value // 1000
            known = receipts.get(row.command_id)
            if known and at_us - known[1] <= self.keep_ms * 1000:
                out.append((key[0], row.seq, row.command_id, "duplicate", known[0]))
                continue
            expected = _none(row.expected_revision)
            stale = expected is not None and row.type != FREE_COMMAND and int(expected) != revision
            accepted = not stale and not row.failed
            revision += int(accepted)
            receipts[row.command_id] = fresh[row.command_id] = (revision, at_us)
            out.append((key[0], row.seq, row.command_id, "accepted" if accepted else "rejected", revision))
        self.revision.update((revision,))
        if fresh:
            self.receipts.appendList([(command, *receipt) for command, receipt in fresh.items()])
        if fresh and not had:
            self._wait(min(at for _, at in fresh.values()))
        yield pd.DataFrame(out, columns=[p.split()[0] for p in self.SCHEMA.split(", ")])

    def _wait(self, oldest_us: int) -> None:
        self.handle.registerTimer(oldest_us // 1000 + self.keep_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # later commands have at least the watermark's time
        end_us = (timerValues.getCurrentWatermarkInMs() - self.keep_ms) * 1000
        left = {command: (command, revision, at_us) for command, revision, at_us in self.receipts.get() if at_us >= end_us}
        if left:
            self.receipts.put(list(left.values()))
            self._wait(min(at_us for _, _, at_us in left.values()))
        else:
            self.receipts.clear()
        return iter([])


def stream_commands(commands: DataFrame, keep: int = KEEP_RECEIPTS, lateness: str = "10 minutes") -> DataFrame:
    """Receipts of commands (as K1's, with ``at``) as they come; a receipt lasts ``keep`` seconds."""
    return _run(commands.withWatermark("at", lateness), "session_id", CommandLog(keep * 1000), CommandLog.SCHEMA, "EventTime")


# ---- leases ----------------------------------------------------------------------------
def stream_leases(touches: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Lease of each (client_id, resource_id): it lasts until 120 s without a touch.

    Heartbeats only extend a lease; a run of them without a touch is none. A lease comes out once,
    when the watermark has passed its end; touches later than that are dropped, and so is its state.
    """
    lease = F.session_window("ts", "120 seconds")
    return touches.withWatermark("ts", lateness).groupBy("client_id", "resource_id", lease).agg(
        F.count(F.lit(1)).alias("touches"), F.min(F.when(~F.col("heartbeat"), F.col("ts"))).alias("first_touch")
    ).filter("first_touch IS NOT NULL").select(
        "client_id", "resource_id", F.col("first_touch").alias("started_at"), F.col("session_window.end").alias("expires_at"), "touches")


# ---- fragments -------------------------------------------------------------------------
class Fragments:
    """Fragments of one request, handed out by consecutive ``seq``; later ones wait in a list state.

    More than ``MAX_RESPONSE_BYTES`` of waiting text ends the request.
    """

    DDL = "seq long, fragment string, done boolean"

    def __init__(self, state):
        self.state = state

    def take(self, rows: list, expected: int) -> tuple[list[tuple[str, bool]], int, bool]:
        """(fragment, done) in turn, the next number, and whether too much waits."""
        waiting = {int(r[0]): (r[1], bool(r[2])) for r in self.state.get()} if self.state.exists() else {}
        had = bool(waiting)
        for r in rows:
            if r.seq >= expected:
                waiting.setdefault(int(r.seq), (r.fragment or "", bool(r.done)))
        ready = []
        while expected in waiting:
            ready.append(waiting.pop(expected))
            expected += 1
        over = sum(len(f.encode()) for f, _ in waiting.values()) > MAX_RESPONSE_BYTES
        if waiting and not over:
            self.state.put([(n, *v) for n, v in sorted(waiting.items())])
        elif had:
            self.state.clear()
        return ready, expected, over


class Held:
    """What :class:`Fragments` keeps of one response, where a group's list state holds many."""

    def __init__(self, rows):
        self.rows = list(rows)

    def exists(self) -> bool:
        return bool(self.rows)

    def get(self) -> Iterator[tuple]:
        return iter(self.rows)

    def put(self, rows: list) -> None:
        self.rows = rows

    def clear(self) -> None:
        self.rows = []


class CitationReader:
    """Text, citations and warnings of one answer, whatever the fragment borders are."""

    def __init__(self, allowed, seen=(), pending="", discarding=False, tag: str = CITE_TAG):
        self.prefix = f"⟦{tag}:"
        self.allowed, self.seen = set(allowed), list(seen)
        self.pending, self.discarding = pending, discarding

    def _held(self, text: str) -> int:
        """Length of the longest end of the text that may begin a marker."""
        for size in range(min(len(text), len(self.prefix) - 1), 0, -1):
            if text.endswith(self.prefix[:size]):
                return size
        return 0

    def feed(self, fragment: str, last: bool = False) -> list[tuple[str, str]]:
        text, self.pending, events = self.pending + fragment, "", []
        while text:
            if self.discarding:
                _, found, text = text.partition("⟧")
                self.discarding = not found
                continue
            head, found, tail = text.partition(self.prefix)
            if not found:
                size = self._held(text)
                if len(text) > size:
                    events.append(("text", text[: len(text) - size]))
                self.pending = text[len(text) - size:]
                break
            if head:
                events.append(("text", head))
            name, closed, rest = tail.partition("⟧")
            if len((self.prefix + name).encode()) > MAX_MARKER_BYTES:
                events.append(("warning", "citation_marker_invalid"))
                self.discarding, text = not closed, rest
            elif not closed:
                self.pending = self.prefix + name
                break
            else:
                text = rest
                if name not in self.allowed:
                    events.append(("warning", "citation_out_of_context"))
                elif name in self.seen:
                    events.append(("warning", "citation_duplicate"))
                else:
                    self.seen.append(name)
                    events.append(("citation", name))
        if last and self.pending:
            self.pending = ""
            events.append(("warning", "citation_marker_invalid"))
        return events


class Response(StatefulProcessor):
    """An answer as it is written: citations and warnings at once, text in checkpoints.

    A checkpoint carries the text since the last one and where it begins. It is due with the first
    text, after 8 KiB, after 250 ms without one (a timer of processing time), and at the end.
    """

    SCHEMA = "request_id string, event_no long, event string, start long, value string"
    HEAD = ("pending string, discarding boolean, allowed array<string>, seen array<string>, expected long, closed boolean, "
            "events long, fresh string, start long, size long, saved long")
    NEW = ("", False, None, [], 0, False, 0, "", 0, 0, 0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", self.HEAD, ttlDurationMs=IDLE_MS)
        self.fragments = Fragments(handle.getListState("waiting", Fragments.DDL, ttlDurationMs=IDLE_MS))

    def _emit(self, kind: str, value: str, start: int | None = None) -> None:
        self.out.append((self.key, self.events, kind, start, value))
        self.events += 1

    def _save(self, kind: str) -> None:
        self._emit(kind, self.fresh, self.start)
        self.start, self.saved, self.fresh = self.start + len(self.fresh), self.size, ""

    def _open(self, key) -> None:
        known = tuple(self.head.get() or self.NEW)
        (self.pending, self.discarding, self.allowed, self.seen, self.expected, self.closed,
         self.events, self.fresh, self.start, self.size, self.saved) = known
        self.key, self.out = key[0], []

    def _close(self) -> pd.DataFrame:
        self.head.update((self.pending, self.discarding, self.allowed, list(self.seen), self.expected, self.closed,
                          self.events, self.fresh, self.start, self.size, self.saved))
        return pd.DataFrame(self.out, columns=[p.split()[0] for p in self.SCHEMA.split(", ")]).astype({"start": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._open(key)
        if self.closed:
            return
        ordered = _in_order(rows)
        self.allowed = [str(x) for x in (ordered[0].allowed if self.allowed is None else self.allowed)]
        waited = bool(self.fresh)
        reader = CitationReader(self.allowed, self.seen, self.pending, self.discarding)
        ready, self.expected, over = self.fragments.take(ordered, self.expected)
        for fragment, done in ready:
            for kind, value in reader.feed(fragment, done):
                if kind == "text":
                    self.fresh, self.size = self.fresh + value, self.size + len(value.encode())
                else:
                    self._emit(kind, value)
            over = over or self.size > MAX_RESPONSE_BYTES
            if over:
                break
            if done:
                self._save("final")
                self.closed = True
                break
            if self.fresh and (self.saved == 0 or self.size - self.saved >= CHECKPOINT_BYTES):
                self._save("checkpoint")
        if over:
            self._emit("error", "response_too_large")
            self.closed = True
        if self.closed:
            self.fragments.state.clear()
            reader, self.fresh, self.allowed = CitationReader([]), "", []
        elif self.fresh and not waited:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + CHECKPOINT_MS)
        self.seen, self.pending, self.discarding = reader.seen, reader.pending, reader.discarding
        yield self._close()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open(key)
        if self.fresh and not self.closed:
            self._save("checkpoint")
            yield self._close()


def stream_responses(fragments: DataFrame) -> DataFrame:
    """Events of answer streams (request_id, seq from 0, fragment, done, allowed), fragments in any order."""
    return _run(fragments, "request_id", Response(), Response.SCHEMA, "ProcessingTime")


# ---- translation records ---------------------------------------------------------------
class RecordScanner:
    """Top-level ``{...}`` stretches of a text that comes in pieces, without its fence lines.

    What is kept is the unfinished stretch, and the head of a line that may still become a fence.
    """

    STATE = "depth int, quoted boolean, escaped boolean, text string, head string, fenced boolean, first string"
    NEW = (0, False, False, "", "", False, "")
    _SIGN = re.compile(r'["{}\\]')

    def __init__(self, depth, quoted, escaped, text, head, fenced, first):
        # ``head`` is None behind a line's first characters; ``first`` are the first three visible ones
        self.depth, self.quoted, self.escaped, self.text = depth, quoted, escaped, text
        self.head, self.fenced, self.first = head, fenced, first

    def state(self) -> tuple:
        return self.depth, self.quoted, self.escaped, self.text, self.head, self.fenced, self.first

    def _lines(self, piece: str, last: bool) -> str:
        out, lines = [], piece.split("\n")
        for i, line in enumerate(lines):
            ends = i + 1 < len(lines)
            if self.head is None:
                out.append("" if self.fenced else line)
            else:
                self.head += line
                begin = self.head.lstrip()
                if begin.startswith("```"):
                    self.fenced, self.head = True, None
                elif ends or last or not "```".startswith(begin):
                    out.append(self.head)
                    self.head = None
            if ends:
                out.append("" if self.fenced else "\n")
                self.fenced, self.head = False, ""
        return "".join(out)

    def feed(self, piece: str, last: bool = False) -> list[str]:
        text, found = self._lines(piece, last), []
        if len(self.first) < 3:
            self.first = (self.first + "".join(text.split())[:3])[:3]
        begin, skip = 0, int(self.escaped)
        if text:
            self.escaped = False
        for mark in self._SIGN.finditer(text):
            at, sign = mark.start(), mark.group()
            if at < skip:
                continue
            if self.quoted:
                if sign == "\\":
                    skip, self.escaped = at + 2, at + 1 == len(text)
                elif sign == '"':
                    self.quoted = False
            elif sign == '"':
                self.quoted = self.depth > 0
            elif sign == "{":
                begin = at if self.depth == 0 else begin
                self.depth += 1
            elif sign == "}" and self.depth:
                self.depth -= 1
                if self.depth == 0:
                    found.append(self.text + text[begin:at + 1])
                    self.text = ""
        if self.depth:
            self.text += text[begin:]
        return found

    def empty(self) -> bool:
        """Whether there was nothing, or an empty list."""
        return self.first in ("", "[]")


class Records(StatefulProcessor):
    """Records of a group's translation responses, each as soon as it is whole.

    The group's unfinished responses lie in one list, read and written in one call a micro-batch; of an
    ended one the id is left, until it is forgotten.
    """

    SCHEMA = "request_id string, ord int, block_id string, target string, error_code string"
    OPEN = (f"request_id string, at long, expected long, size long, found int, {RecordScanner.STATE}, "
            "waiting array<long>, texts array<string>, ends array<boolean>")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", self.OPEN, ttlDurationMs=IDLE_MS)
        self.closed = handle.getValueState("closed", "request_id array<string>, at array<long>", ttlDurationMs=IDLE_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        heads = {request: (at, *head) for request, at, *head in self.open.get() if at > now - IDLE_MS}
        closed = {request: at for request, at in zip(*(self.closed.get() or ((), ()))) if at > now - IDLE_MS}
        fresh: dict[str, list] = {}
        for row in _in_order(rows):
            fresh.setdefault(row.request_id, []).append(row)
        out, ended = [], False
        for request, ordered in fresh.items():
            if request in closed:
                continue
            head = self._read(request, ordered, heads.pop(request, None), out)
            if head:
                heads[request] = (now, *head)
            else:
                closed[request], ended = now, True
        if ended:
            self.closed.update((list(closed), list(closed.values())))
        if heads:
            self.open.put([(request, *head) for request, head in heads.items()])
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=[p.split()[0] for p in self.SCHEMA.split(", ")])

    def _read(self, request: str, rows: list, head: tuple | None, out: list) -> tuple | None:
        """Append what the rows complete to ``out``; the response's head after them, none if it has ended."""
        _, expected, size, count, *known = head or (0, 0, 0, 0, *RecordScanner.NEW, (), (), ())
        scanner, line = RecordScanner(*known[:-3]), Fragments(Held(zip(*known[-3:])))
        ready, expected, over = line.take(rows, expected)
        texts, done = [], False
        for fragment, done in ready:
            size += len(fragment.encode())
            over = over or size > MAX_RESPONSE_BYTES
            if over:
                break
            texts.append(fragment)
            if done:
                break
        # the records are the same however a text is cut, so it is read once
        for text in scanner.feed("".join(texts), done and not over) if texts else ():
            record = load_record(text)
            if record:
                out.append((request, count, record["id"], record["target"], None))
                count += 1
        if over:
            out.append((request, -1, None, None, "response_too_large"))
        elif done and not count and not scanner.empty():
            out.append((request, -1, None, None, "invalid_json"))
        if over or done:
            return None
        waiting = line.state.rows
        return (expected, size, count, *scanner.state(), *([w[i] for w in waiting] for i in range(3)))


def stream_translation_records(fragments: DataFrame) -> DataFrame:
    """Records of responses as they come in, and how a response without any ends.

    A response may end by an error: what came in whole is kept.
    """
    return _run_together(fragments.select("request_id", "seq", "fragment", "done"), "request_id", Records(), Records.SCHEMA, "ProcessingTime")


# ---- jobs ------------------------------------------------------------------------------
class JobEvents(StatefulProcessor):
    """The last states of a group's jobs and the numbers of their changes, until nothing has come for 30 days.

    The group's jobs lie in one value, read and written in one call a micro-batch.
    """

    SCHEMA = "job_id string, sequence long, state string, created_at long"
    JOBS = "job_id array<string>, state array<string>, sequence array<long>, at array<long>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getValueState("jobs", self.JOBS, ttlDurationMs=JOB_IDLE_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.jobs.get() or ((), (), (), ())
        jobs = {job: (state, sequence, at) for job, state, sequence, at in zip(*known) if at > now - JOB_IDLE_MS}
        out = []
        for row in _in_order(rows):
            current, sequence, _ = jobs.get(row.job_id, (None, 0, now))
            if current != "cancelled" and row.state != current:
                current, sequence = row.state, sequence + 1
                out.append((row.job_id, sequence, current, row.seq))
            jobs[row.job_id] = (current, sequence, now)
        self.jobs.update((list(jobs), *([job[i] for job in jobs.values()] for i in range(3))))
        yield pd.DataFrame(out, columns=[p.split()[0] for p in self.SCHEMA.split(", ")])


def stream_job_events(changes: DataFrame) -> DataFrame:
    """Events of job writes (job_id, seq, state) as they come; nothing follows a cancelled state."""
    return _run_together(changes.select("job_id", "seq", "state"), "job_id", JobEvents(), JobEvents.SCHEMA, "ProcessingTime")
