"""Reading sessions, commands, source tokens, endpoints and provider profiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.scan import Fold, lay_out, ordered_fold, ordered_scan
from docloom.functions.text import ascii_lower, utrim

# fixed values
LIVE_TOKENS = 32
MIN_CONTEXT_WINDOW, MAX_CONTEXT_WINDOW = 1024, 8_000_000
FREE_COMMAND = "focus_chapter"
KEEP_RECEIPTS = 24 * 3600
ADAPTER_PROTOCOL_VERSION = "1"
PARSER_KIND, MODEL_KIND = "mineru", "translation"


# ---- commands --------------------------------------------------------------------------
def ladder(wanted: np.ndarray, level: int) -> tuple[np.ndarray, int]:
    """Which of the values, read in order, equal a level that rises by one at each match."""
    hit = np.zeros(len(wanted), dtype=bool)
    for i, value in enumerate(wanted.tolist()):
        if value == level:
            hit[i] = True
            level += 1
    return hit, level


def ladder_steps(wanted: np.ndarray) -> dict[int, int]:
    """Level after the values for every level that changes, found in one backward pass."""
    after: dict[int, int] = {}
    for value in wanted[::-1].tolist():
        after[value] = after.get(value + 1, value + 1)
    return after


def _replay(pdf: pd.DataFrame, revision: int) -> tuple[np.ndarray, np.ndarray]:
    """Revision before each command, and which ones were accepted, from the one before the first.

    Commands without a condition shift the revision by a plain running count; against that count
    each conditional one waits for a fixed number of accepted conditional commands before it.
    """
    free = pdf["free"].to_numpy() & ~pdf["failed"].to_numpy()
    shift = np.cumsum(free) - free
    waits = np.flatnonzero(~pdf["free"].to_numpy() & ~pdf["failed"].to_numpy())
    hit = np.zeros(len(pdf), dtype=bool)
    hit[waits], _ = ladder(pdf["wanted"].to_numpy()[waits] - shift[waits], revision)
    return revision + shift + np.cumsum(hit) - hit, free | hit


def _summary(pdf: pd.DataFrame) -> dict:
    """What commands do to any revision before them: the level they lift it to, and the shift of free ones."""
    free = pdf["free"].to_numpy() & ~pdf["failed"].to_numpy()
    shift = np.cumsum(free) - free
    waits = np.flatnonzero(~pdf["free"].to_numpy() & ~pdf["failed"].to_numpy())
    table = ladder_steps(pdf["wanted"].to_numpy()[waits] - shift[waits])
    return {"enter": list(table), "leave": list(table.values()), "shift": int(free.sum())}


def _after(row, state: tuple) -> tuple:
    at = np.flatnonzero(np.asarray(row.enter) == state[0])
    return ((int(row.leave[at[0]]) if len(at) else state[0]) + row.shift,)


def _played(pdf: pd.DataFrame, state: tuple) -> tuple[dict[str, np.ndarray], tuple]:
    before, ok = _replay(pdf, state[0])
    stale = ~pdf["free"].to_numpy() & (pdf["wanted"].to_numpy() != before)
    return {"before": before, "ok": ok, "stale": stale}, (int(before[-1]) + int(ok[-1]),)


REPLAY = Fold(start=(0,), state="revision long", steps="enter array<long>, leave array<long>, shift long", out="before long, ok boolean, stale boolean",
              summarize=_summary, follow=_after, replay=_played)


def _expiring(keep_us: int) -> Fold:
    """Which command's receipt a repeated one meets: the first one's, until that is too old."""
    def replay(pdf: pd.DataFrame, state: tuple) -> tuple[dict[str, np.ndarray], tuple]:
        first, since = state
        out = np.empty(len(pdf), dtype=np.int64)
        for i, (seq, at) in enumerate(zip(pdf["seq"].tolist(), pdf["at_us"].tolist())):
            if first < 0 or at - since > keep_us:
                first, since = seq, at
            out[i] = first
        return {"__first": out}, (first, since)

    def summarize(pdf: pd.DataFrame) -> dict:
        # the receipt at the end, for each command that may be the first to find the old one expired
        seq, at = pdf["seq"].to_numpy(), pdf["at_us"].to_numpy()
        later, last = np.searchsorted(at, at + keep_us, "right"), np.arange(len(at))
        for i in range(len(at) - 1, -1, -1):
            last[i] = last[later[i]] if later[i] < len(at) else i
        return {"at": at.tolist(), "first": seq[last].tolist(), "since": at[last].tolist()}

    def follow(row, state: tuple) -> tuple:
        at = 0 if state[0] < 0 else int(np.searchsorted(np.asarray(row.at), state[1] + keep_us, "right"))
        return state if at == len(row.at) else (int(row.first[at]), int(row.since[at]))

    return Fold(start=(-1, 0), state="__receipt long, __since long", steps="at array<long>, first array<long>, since array<long>",
                out="__first long", summarize=summarize, follow=follow, replay=replay)


def replay_commands(commands: DataFrame, ranges: int | None = None, keep: int | None = None) -> DataFrame:
    """Receipt of every command: status (duplicate/rejected/accepted) and revision.

    ``commands``: session_id, seq (unique per session), command_id, expected_revision, type,
    failed (whether its action failed). A repeated id returns the first receipt's revision. With
    ``keep`` a receipt lasts so many seconds by the commands' ``at``, which does not fall within a
    session; a command that comes again after that is a new one.
    """
    if keep is None:
        first = commands.groupBy("session_id", "command_id").agg(F.min("seq").alias("__first"))
        commands = commands.join(first, ["session_id", "command_id"])
    else:
        names = ["session_id", "command_id"]
        timed = lay_out(commands.select(*names, "seq", F.unix_micros("at").alias("at_us")), names, "seq", ranges)
        commands = commands.join(ordered_fold(timed, names, "seq", _expiring(keep * 1_000_000), ["at_us"]), [*names, "seq"])
    free = F.col("expected_revision").isNull() | (F.col("type") == FREE_COMMAND)
    marked = lay_out(commands.select(
        "session_id", "seq", "command_id", "__first", free.alias("free"), "failed",
        F.coalesce("expected_revision", F.lit(-1)).cast("long").alias("wanted")), ["session_id"], "seq", ranges)
    played = ordered_fold(marked.filter(F.col("seq") == F.col("__first")), ["session_id"], "seq", REPLAY, ["free", "failed", "wanted"])
    # a repeated command has its first one's receipt
    own = F.col("seq") == F.col("__first")
    return marked.join(played.withColumnRenamed("seq", "__first"), ["session_id", "__first"]).select(
        "session_id", "seq", "command_id", F.when(~own, "duplicate").when(F.col("ok"), "accepted").otherwise("rejected").alias("status"),
        (F.col("before") + F.col("ok").cast("long")).alias("revision"),
        F.when(F.col("ok"), None).when(F.col("stale"), "stale_revision").otherwise("action_failed").alias("reason"))


def active_sessions(log: DataFrame, ranges: int | None = None) -> DataFrame:
    """Sessions from an open/close log (document_id, seq, action).

    One session per document is shared while somebody has it open; it closes at zero. A close
    with nobody there changes nothing, so the count is the running sum above its lowest point.
    """
    step = F.when(F.col("action") == "open", 1).otherwise(-1).cast("long")
    laid = lay_out(log.select("document_id", "seq", "action", step.alias("__step")), ["document_id"], "seq", ranges)
    summed = ordered_scan(laid, ["document_id"], "seq", {"__sum": ("sum", F.col("__step"))})
    low = ordered_scan(summed, ["document_id"], "seq", {"__low": ("min", F.least(F.col("__sum"), F.lit(0)))})
    count = F.col("__sum") - F.col("__low")
    leveled = low.withColumn("subscribers", count).withColumn("__start", (F.col("action") == "open") & (count == 1))
    numbered = ordered_scan(leveled, ["document_id"], "seq", {"session_no": ("sum", F.col("__start").cast("long"))})
    return numbered.filter("session_no > 0").groupBy("document_id", "session_no").agg(
        F.min("seq").alias("opened_at"), F.max("subscribers").alias("peak_subscribers"),
        F.min(F.when((F.col("action") == "close") & (F.col("subscribers") == 0), F.col("seq"))).alias("closed_at"))


def remap_active_chapter(sessions: DataFrame, chapters: DataFrame) -> DataFrame:
    """Sessions keep their chapter if the document still has it, else go to its first one."""
    first = chapters.groupBy(F.col("doc_id").alias("document_id")).agg(F.min_by("chapter_id", "order_index").alias("__first"))
    here = chapters.select(F.col("doc_id").alias("document_id"), F.col("chapter_id").alias("active_chapter_id"), F.lit(True).alias("__here"))
    rows = sessions.join(here, ["document_id", "active_chapter_id"], "left").join(first, "document_id", "left")
    return rows.withColumn(
        "active_chapter_id", F.when(F.col("__here"), F.col("active_chapter_id")).otherwise(F.col("__first"))).select(*sessions.columns)


def live_tokens(issues: DataFrame, revoked: DataFrame, keep: int = LIVE_TOKENS) -> DataFrame:
    """The newest tokens still valid; a revoked one is forgotten and frees its place."""
    return issues.join(revoked, "token", "left_anti").orderBy(F.col("issued_at").desc(), F.col("token").desc()).limit(keep)


# ---- endpoints and profiles ------------------------------------------------------------
URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\\]*)([^?#]*)"
HOST_PORT = r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]\s]*)(?::([0-9]*))?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once.

    Spark puts a column's definition in place of its name when it moves a filter below a
    projection; a chain of definitions that each use the one before twice would explode there.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _judge_endpoint(text: Column, parts: Column, host: Column, port: Column, user: Column) -> Column:
    scheme = parts["scheme"]
    loopback = (host == "localhost") | host.endswith(".localhost") | host.rlike(r"^127(\.[0-9]{1,3}){3}$") | (host == "[::1]")
    code = (
        F.when((text == "") | (scheme == "") | ~scheme.isin("http", "https"), "invalid_url")
        .when(user.rlike("[^:]") | (host == "") | (port > 65535), "invalid_url")
        .when((scheme == "http") & ~loopback, "insecure_remote_url"))
    default = ((scheme == "https") & (port == 443)) | ((scheme == "http") & (port == 80)) | port.isNull()
    origin = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port.cast("string"))))
    return let(code, lambda c: F.struct(
        F.when(c.isNull(), origin).alias("origin"), F.when(c.isNull(), F.regexp_replace(parts["path"], "/+$", "")).alias("base_path"),
        c.alias("error_code")))


def normalize_endpoints(raw: DataFrame) -> DataFrame:
    """Adds origin, base_path, fingerprint and error_code to (kind, endpoint).

    Host names are lowered, the default port, query, fragment and trailing slashes go; plain
    HTTP is for loopback only.
    """
    def split(text: Column, url: Column) -> Column:
        parts = F.struct(
            ascii_lower(F.regexp_extract(url, URL_PARTS, 1)).alias("scheme"), F.regexp_extract(url, URL_PARTS, 2).alias("authority"),
            F.regexp_extract(url, URL_PARTS, 3).alias("path"))
        # userinfo ends at the last @; an empty one is the same as none
        return let(parts, lambda p: let(F.regexp_replace(p["authority"], r"^.*@", ""), lambda place: _judge_endpoint(
            text, p, ascii_lower(F.regexp_extract(place, HOST_PORT, 1)), F.regexp_extract(place, HOST_PORT, 2).try_cast("int"),
            F.regexp_extract(p["authority"], r"^(.*)@", 1))))

    parsed = let(utrim("endpoint"), lambda text: let(
        F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text)), lambda url: split(text, url)))
    out = raw.withColumn("__e", parsed).select("*", "__e.origin", "__e.base_path", "__e.error_code").drop("__e")
    return out.withColumn("fingerprint", F.sha2(F.concat(
        "kind", F.lit("\n"), "origin", "base_path", F.lit("\n" + ADAPTER_PROTOCOL_VERSION)), 256))


def profile_errors(updates: DataFrame) -> Column:
    window = F.col("context_window")
    return (
        F.when(F.col("endpoint_error").isNotNull(), F.col("endpoint_error"))
        .when((F.col("kind") == MODEL_KIND) & (utrim(F.coalesce("model_id", F.lit(""))) == ""), "model_required")
        .when(window.isNotNull() & ~window.between(MIN_CONTEXT_WINDOW, MAX_CONTEXT_WINDOW), "window_out_of_range"))


def upsert_profiles(profiles: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, rejected): one row per owner and kind; the last valid update wins, created_at stays.

    Updates: owner_id, kind, endpoint, model_id, context_window, updated_at.
    """
    checked = normalize_endpoints(updates).withColumnRenamed("error_code", "endpoint_error")
    checked = checked.withColumn("error_code", profile_errors(checked)).drop("endpoint_error")
    good = checked.filter("error_code IS NULL").withColumn("created_at", F.col("updated_at")).select(*profiles.columns)
    rest = [c for c in profiles.columns if c not in ("owner_id", "kind", "created_at")]
    merged = profiles.unionByName(good).groupBy("owner_id", "kind").agg(
        F.max_by(F.struct(*rest), F.struct("updated_at", "fingerprint")).alias("p"), F.min("created_at").alias("created_at"))
    return merged.select("owner_id", "kind", "p.*", "created_at").select(*profiles.columns), checked.filter("error_code IS NOT NULL")


def classify_probes(responses: DataFrame) -> DataFrame:
    """Adds ``code`` to probe answers (kind, status, body): passed, unauthorized, rate_limited,
    server_error or protocol_incompatible."""
    s, body = F.col("status"), F.col("body")
    value = F.try_parse_json(body)
    fields = F.when(body.rlike(r"^\s*\{"), F.json_object_keys(body))

    def has(name: str) -> Column:
        return F.coalesce(F.array_contains(fields, name), F.lit(False))

    def text_of(name: str) -> Column:
        return F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) == "STRING",
                                 F.get_json_object(body, f"$.{name}")), F.lit(""))

    message = ascii_lower(text_of("msg"))
    denied = text_of("code").startswith("A02") | text_of("msgCode").startswith("A02")
    for word in ("token", "unauthorized", "authenticate"):
        denied = denied | message.contains(word)
    envelope = (has("code") | has("msgCode")) & (has("msg") | has("trace_id") | has("traceId") | has("data"))
    code = (
        F.when(s.isin(401, 403), "unauthorized").when(s == 429, "rate_limited").when(s.between(500, 599), "server_error")
        .when(value.isNull(), "protocol_incompatible")
        .when(F.col("kind") == PARSER_KIND, F.when(denied, "unauthorized").when(envelope, "passed").otherwise("protocol_incompatible"))
        .when(s.between(200, 299) & has("data"), "passed").otherwise("protocol_incompatible"))
    return responses.withColumn("code", code)
