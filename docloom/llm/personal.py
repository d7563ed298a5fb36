"""Personal data: four base patterns, and identifiers found by the contexts that these stand in.

Bootstrapped extraction: what the base patterns find are the seeds. The words around a seed are
lexical patterns; each pattern also stands around other strings that look like identifiers, and the
graph of patterns and strings is scored in rounds: a pattern is trusted for a kind when nearly all
of the different strings it stands around of which a kind is known are of that one, and a string
that trusted patterns agree on counts for its kind from then on. Strings found that way are spans too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans in the order in which equal starts are written.
ALL_KINDS = (*KINDS, *(f"context_{k}" for k in KINDS))
#: A string outside base spans may be an identifier from so many digits on, or with an @ inside.
DIGITS = 5
#: A pattern or string counts for a kind from this confidence on.
TRUST = .8
#: A trusted pattern stands around so many different strings known to be of its kind at least, and
#: they are such a share of all its different strings.
SUPPORT, SHARE = 3, 1 / 3
#: Rounds of scoring; each looks one step further from the seeds.
ROUNDS = 3
#: Longer words stand in a pattern by their hash.
LONG_WORD = 32

# The base patterns. An email is found from its @, as a local part can be as long as a text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MOST_PART, CARD_DIGITS, PHONE_DIGITS = 255, (12, 19), (9, 15)

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")
_MARKED = re.compile(r"[0-9@]")
#: The part of a word that may be an identifier.
_CORE = re.compile(r"[+(]?[0-9A-Za-z].*[0-9A-Za-z]", re.S)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterable[Span]:
    end = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and _LOCAL_END.match(text[start - 1]):
            start -= 1
        if start < m.start():
            end = m.end()
            yield "email", start, end


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns that hold, as (kind, start, end) in code points."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= MOST_PART for p in parts):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if PHONE_DIGITS[0] <= len(_digits(m.group())) <= PHONE_DIGITS[1]:
                    out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def may_identify(core: str) -> bool:
    """Whether a string outside base spans is looked at: digits enough, or an @ inside."""
    return sum("0" <= c <= "9" for c in core) >= DIGITS or 0 < core.find("@") < len(core) - 1


def _named(string: str) -> str:
    return xxhash.xxh3_128_hexdigest(string.lower().encode("utf-8", "replace"))


def _context(word: str | None) -> str:
    """A word in a pattern: lower-cased, digits alike, a long one by its hash; the text's edge as ^."""
    if word is None:
        return "^"
    word = _DIGIT.sub("0", word.lower())
    return word if len(word) <= LONG_WORD else f"#{_named(word)}"


def patterns(before: list[str | None], after: str | None) -> list[str]:
    """The four patterns of a string with these words around it: two to the left, one to the right."""
    far, near, right = _context(before[0]), _context(before[1]), _context(after)
    return [f"{far} {near} _", f"{near} _", f"_ {right}", f"{near} _ {right}"]


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind or -1, name, patterns) of base spans and of other strings that may be identifiers."""
    if not base and not _MARKED.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    # first, last word and bounds of every string
    found, at, end = [], 0, 0
    for kind, a, b in base:
        if a < end:
            continue
        while words[at][1] <= a:
            at += 1
        last = at
        while words[last][1] < b:
            last += 1
        found.append((at, last, a, b, KINDS.index(kind)))
        end = b
    taken = {i for first, last, *_ in found for i in range(first, last + 1)}
    for i, (a, b) in enumerate(words):
        if i not in taken and _MARKED.search(text, a, b):
            core = _CORE.search(text, a, b)
            if core and may_identify(core.group()):
                found.append((i, i, *core.span(), -1))
    out = []
    for first, last, a, b, kind in sorted(found):
        around = [text[slice(*words[i])] if 0 <= i < len(words) else None for i in (first - 2, first - 1, last + 1)]
        out.append((a, b, kind, _named(text[a:b]), patterns(around[:2], around[2])))
    return out


def survey(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, base, strings) of every row: base spans, and what may be an identifier, with its patterns."""
    def work(keys, texts):
        out = {"key": keys, "base": [], "strings": []}
        for text in texts:
            base = base_spans(text or "")
            out["base"].append([dict(zip(("kind", "start", "end"), s)) for s in base])
            out["strings"].append([dict(zip(("start", "end", "kind", "name", "patterns"), s)) for s in candidates(text or "", base)])
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "kind:string,start:int,end:int"
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"), "text")
    return map_texts(
        keyed, f"key struct<doc_id:{kind},text_hash:long>, base array<struct<{span}>>, "
        "strings array<struct<start:int,end:int,kind:int,name:string,patterns:array<string>>>", work, "key").select(
        "key.doc_id", "key.text_hash", "base", "strings")


def _of(kind: int, columns: str) -> Column:
    return F.col(f"{columns}{kind}")


def _each(columns: str) -> list[str]:
    return [f"{columns}{i}" for i in range(len(KINDS))]


def learn(surveyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind) and trusted strings (name, kind) from the graph of the whole table.

    A pattern's confidence in a kind is the sum of its different strings' confidences over the sum
    for all kinds and one: strings of which nothing is known yet do not count against it, as long as
    those that are known make up their share. A string's is what its trusted patterns leave no doubt
    about; seeds are sure.
    """
    edges = surveyed.select(F.explode("strings").alias("s")).select("s.name", "s.kind", F.explode("s.patterns").alias("pattern"))
    # one row for a pattern and a string, however often they meet
    edges = materialize(edges.groupBy("pattern", "name").agg(F.max("kind").alias("seed")), "edges")
    strings: DataFrame | None = None
    for _ in range(ROUNDS):
        known = edges.withColumns({c: F.lit(0.0) for c in _each("s")}) if strings is None else edges.join(strings, "name", "left")
        sure = [F.when(F.col("seed") == i, 1.0).when(F.col("seed") < 0, F.coalesce(_of(i, "s"), F.lit(0.0))).otherwise(0.0)
                for i in range(len(KINDS))]
        scored = known.groupBy("pattern").agg(
            F.count("*").alias("n"), *(F.sum(c).alias(f"c{i}") for i, c in enumerate(sure)),
            *(F.sum((c >= TRUST).cast("int")).alias(f"n{i}") for i, c in enumerate(sure)))
        decided = sum((_of(i, "c") for i in range(len(KINDS))), F.lit(1.0))
        trusted = scored.select("pattern", *(F.when(
            (_of(i, "c") >= TRUST * decided) & (_of(i, "n") >= SUPPORT) & (_of(i, "n") >= SHARE * F.col("n")), _of(i, "c") / decided).otherwise(0.0).alias(f"c{i}")
            for i in range(len(KINDS)))).where(F.greatest(*_each("c")) > 0)
        trusted = materialize(trusted, "patterns")
        # what the trusted patterns stand around, seeds apart
        reached = edges.where("seed < 0").join(trusted, "pattern").groupBy("name").agg(
            *((1 - F.exp(F.sum(F.log1p(-_of(i, "c"))))).alias(f"s{i}") for i in range(len(KINDS))))
        strings = materialize(reached.where(F.greatest(*_each("s")) >= TRUST), "strings")
    best = F.greatest(*_each("c"))
    kinds = trusted.select("pattern", F.coalesce(*(F.when(_of(i, "c") == best, F.lit(i)) for i in range(len(KINDS)))).alias("kind"))
    best = F.greatest(*_each("s"))
    names = strings.select("name", F.coalesce(*(F.when(_of(i, "s") == best, F.lit(i)) for i in range(len(KINDS)))).alias("kind"))
    return kinds, names


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row, spans as (kind, start, end) by start, then kind as in ALL_KINDS.

    Base spans all stay. A string outside them becomes a span of ``context_<kind>`` where a trusted
    pattern of that kind stands around it and the string is trusted for it. Null and empty texts have
    no spans; repeated rows are judged alike; a null id is an id; a long text is searched whole; an
    empty table gives no rows. Other columns are not looked at.
    """
    surveyed = materialize(survey(docs), "surveyed")
    kinds, names = learn(surveyed)
    loose = surveyed.select("doc_id", "text_hash", F.explode("strings").alias("s")).where("s.kind < 0")
    placed = loose.select("doc_id", "text_hash", "s.start", "s.end", "s.name", "s.patterns").join(names, "name")
    placed = placed.select("doc_id", "text_hash", "start", "end", "kind", F.explode("patterns").alias("pattern"))
    found = placed.join(kinds, ["pattern", "kind"]).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(
        F.element_at(F.array(*(F.lit(f"context_{k}") for k in KINDS)), F.col("kind") + 1).alias("kind"), "start", "end")).alias("more"))
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "more")
    spans = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    place = F.array(*map(F.lit, ALL_KINDS))
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(place, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return surveyed.select("doc_id", "text_hash", "base").join(
        found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", ordered.alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) from :func:`find`."""
    found = find(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    counts = [_number(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
