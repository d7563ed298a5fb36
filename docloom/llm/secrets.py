"""Secrets: three base patterns, and formats learned from what they find by grammar inference.

Strings that the base patterns label as credentials, read as character classes, make a prefix tree;
states whose continuations are statistically compatible (a Hoeffding test on end and next-symbol
shares) are merged, red by blue, into a probabilistic automaton. Each kind gets one, ordinary words
get one more. A candidate is a secret when some kind's automaton finds it so much likelier, per
character, than ordinary text that hardly an ordinary word of the sample comes near.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.llm.common import give_back, map_texts, steps

#: Bounds of the training sample: strings of each kind, chosen by their hash from all distinct ones
#: of the table, and the symbols of one that are learned from.
SAMPLE_STRINGS, SAMPLE_SYMBOLS = 1500, 200
#: Candidates of the learned formats: runs of a credential's characters, as long as the shortest
#: string that a base pattern counts.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: Ordinary text is learned in stretches of at most so many characters.
WORD_CHARS = 40
#: The share of ordinary words that must stay below the cut: all of them would let one unlabelled
#: secret among the words settle it.
ORDINARY = .998
#: Judged strings that a worker remembers, and the longest of them.
MEMORY, MEMORY_CHARS = 50_000, 64
#: Confidence of the Hoeffding test.
ALPHA = 0.05
MARK = "[SECRET]"
KINDS = ("assign", "access", "hex", "learned")

# The base patterns, with the number of the group and the least length that counts.
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: A candidate counts against a kind from the kind's least length on, and from 16 characters in any case.
LEAST = {kind: min(16, least) for kind, _, _, least in BASE}
#: Runs too short to count need not be matched at all: a run of hex digits is always matched whole.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns that are long enough, as (kind, start, end) in code points."""
    out = []
    for kind, pattern, group, least in BASE:
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def symbols(string: str) -> str:
    """Characters as classes: digits, hex letters and other letters of either case; signs stay."""
    return string.translate(_CLASSES)


_CLASSES = {ord(c): "d" for c in "0123456789"} | {ord(c): "h" for c in "abcdef"} | {
    ord(c): "l" for c in "ghijklmnopqrstuvwxyz"} | {ord(c): "H" for c in "ABCDEF"} | {
    ord(c): "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}
END = "$"


@dataclass
class Automaton:
    """States with counts of strings that end there and of each way on."""

    ends: list[int] = field(default_factory=lambda: [0])
    ways: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    logs: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    rest: list[tuple[float, float]] = field(default_factory=list)

    def total(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.ways[state].values())

    def add(self, string: str, times: int = 1) -> None:
        state = 0
        for s in string:
            way = self.ways[state].get(s)
            if way is None:
                self.ends.append(0)
                self.ways.append({})
                way = self.ways[state][s] = [len(self.ends) - 1, 0]
            way[1] += times
            state = way[0]
        self.ends[state] += times

    def compatible(self, a: int, b: int) -> bool:
        """Whether two states, and those that both lead to, may be the same as far as counts tell."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            m, n = self.total(a), self.total(b)
            if not m or not n:
                continue
            bound = (1 / math.sqrt(m) + 1 / math.sqrt(n)) * math.sqrt(math.log(2 / ALPHA) / 2)
            if abs(self.ends[a] / m - self.ends[b] / n) > bound:
                return False
            for s in self.ways[a].keys() | self.ways[b].keys():
                x, y = self.ways[a].get(s), self.ways[b].get(s)
                if abs((x[1] if x else 0) / m - (y[1] if y else 0) / n) > bound:
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree that hangs on b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for s, (to, n) in self.ways[b].items():
                if s in self.ways[a]:
                    self.ways[a][s][1] += n
                    todo.append((self.ways[a][s][0], to))
                else:
                    self.ways[a][s] = [to, n]

    def merge(self) -> "Automaton":
        """Red states are final, blue ones hang on them: each blue one joins a red one or turns red."""
        red = [0]
        while True:
            blue = [(r, s, w[0]) for r in red for s, w in sorted(self.ways[r].items()) if w[0] not in red]
            if not blue:
                break
            r, s, b = max(blue, key=lambda x: (self.total(x[2]), -x[2]))
            for q in red:
                if self.compatible(q, b):
                    self.ways[r][s][0] = q
                    self.fold(q, b)
                    break
            else:
                red.append(b)
        at = {q: i for i, q in enumerate(red)}
        self.ends, self.ways = [self.ends[q] for q in red], [
            {s: [at[to], n] for s, (to, n) in self.ways[q].items()} for q in red]
        return self

    def weigh(self) -> None:
        """Note the log2 likelihoods of each state: of its ways on, of one unseen and of the end."""
        for state, ways in enumerate(self.ways):
            n = self.total(state) + 1.5
            self.logs.append({s: (to, math.log2((m + .1) / n)) for s, (to, m) in ways.items()})
            self.rest.append((math.log2(.1 / n), math.log2((self.ends[state] + .1) / n)))

    def score(self, string: str) -> float:
        """Mean log2 likelihood of a symbol, the end being one; unseen ways are smoothed."""
        if not self.logs:
            self.weigh()
        state, out = 0, 0.0
        for s in string:
            way = self.logs[state].get(s)
            if way:
                state, out = way[0], out + way[1]
            else:
                out += self.rest[state][0]
        return (out + self.rest[state][1]) / (len(string) + 1)


@dataclass
class Model:
    kinds: dict[str, Automaton]
    plain: Automaton | None
    cut: float
    seen: dict[str, bool] = field(default_factory=dict)

    def excess(self, string: str, length: int) -> float:
        """How much likelier, in bits a character, the best kind for that length finds it than
        ordinary text does."""
        form = symbols(string)
        best = max((a.score(form) for k, a in self.kinds.items() if LEAST[k] <= length), default=-math.inf)
        return best - self.plain.score(form)

    def like_secret(self, string: str) -> bool:
        out = self.seen.get(string)
        if out is None:
            out = self.excess(string, len(string)) >= self.cut
            if len(string) <= MEMORY_CHARS:
                if len(self.seen) >= MEMORY:
                    self.seen.clear()
                self.seen[string] = out
        return out

    def spans(self, text: str) -> list[Span]:
        """Base spans, and candidates in the text outside them that look like one."""
        found = base_spans(text)
        if self.kinds:
            for start, end in outside(found, len(text)):
                # every different string is judged once; most texts have none of the learned formats
                hits = {c for c in set(CANDIDATE.findall(text, start, end)) if self.like_secret(c)}
                if hits:
                    found += [("learned", m.start(), m.end()) for m in CANDIDATE.finditer(text, start, end) if m.group() in hits]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def outside(spans: list[Span], n: int) -> list[tuple[int, int]]:
    """The stretches of n characters that no span covers; spans in the order of their starts."""
    out, at = [], 0
    for _, a, b in spans:
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, n)] if at < n else out


def train(strings: dict[str, list[str]], words: list[str]) -> Model:
    """Automata of the labelled strings of each kind and of ordinary words.

    Fewer than eight strings of a kind in the whole table teach nothing; without any kind, only base
    spans are found.
    """
    def automaton(found: list[str]) -> Automaton:
        out = Automaton()
        for form, n in sorted(Counter(symbols(s[:SAMPLE_SYMBOLS]) for s in found).items()):
            out.add(form, n)
        return out.merge()

    kinds = {k: automaton(v) for k, v in sorted(strings.items()) if len(v) >= 8}
    if not kinds or not words:
        return Model({}, None, 0)
    # one word in five is kept to see how close ordinary text comes
    model = Model(kinds, automaton([w for i, w in enumerate(words) if i % 5]), 0)
    # against all kinds, as if they were long
    held = sorted(model.excess(w, 16) for i, w in enumerate(words) if not i % 5)
    plain = held[min(len(held) - 1, int(len(held) * ORDINARY))]
    own = sorted(model.excess(s, 16) for k in kinds for s in strings[k])
    low = own[len(own) // 20]
    # halfway between nearly the likeliest ordinary word and nearly the unlikeliest credential
    model.cut = max(plain + .1, (plain + low) / 2)
    return model


def ordinary(text: str, spans: list[Span]) -> set[str]:
    """The different candidates in words that no span touches, long ones in pieces."""
    parts, at = [], 0
    for _, a, b in spans:
        if b <= at:
            continue
        # the span grows to the blanks around it
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        parts.append(text[at:max(at, a)])
        at = b
    words = set(" ".join([*parts, text[at:]]).split())
    return {c[i:i + WORD_CHARS] for w in words for c in CANDIDATE.findall(w) for i in range(0, len(c), WORD_CHARS) if len(c) - i >= 6}


def labelled(docs: DataFrame) -> DataFrame:
    """(kind, string): the distinct strings that the base patterns find in all documents, and, of no
    kind, a share of the ordinary words."""
    def work(_, texts):
        found, words = set(), set()
        for text in texts:
            spans = base_spans(text or "")
            for k, a, _ in spans:
                m = BASE[KINDS.index(k)]
                found.add((k, m[1].match(text, a).group(m[2])[:SAMPLE_SYMBOLS]))
            words |= ordinary(text or "", spans)
        # the share goes by the word's own hash
        found |= {("", w) for w in words if hashlib.md5(w.encode()).digest()[0] < 8}
        return {"kind": [k for k, _ in found], "string": [s for _, s in found]}

    return map_texts(docs, "kind string, string string", work).distinct()


def fit(docs: DataFrame) -> Model:
    """Learn from a bounded sample of each kind's strings in the whole table, chosen by their hash."""
    found = materialize(labelled(docs), "labelled")
    strings: dict[str, list[str]] = {}
    for kind in ("", *KINDS[:3]):
        limit = 4 * SAMPLE_STRINGS if not kind else SAMPLE_STRINGS
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("string"), "string").limit(limit).collect()
        strings[kind] = [r.string for r in rows]
    words = strings.pop("")
    return train(strings, words)


def _write(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Null and empty texts have no spans and the digest of the empty string; repeated rows and null
    ids come back as they came in; an empty table gives no rows. Other columns are not looked at.
    """
    def work(ids, texts):
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in texts:
            spans = model.spans(text or "")
            base = [s for s in spans if s[0] != "learned"]
            counts = Counter(k for k, _, _ in base)
            for k in KINDS[:3]:
                out[f"n_{k}"].append(counts[k])
            out["base_sha256"].append(hashlib.sha256(_write(base).encode()).hexdigest())
            out["spans"].append(_write(spans))
        return {"doc_id": ids, **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work)


def hide(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by MARK."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns, secrets in ``text`` hidden and ``n_chars`` (if there) counted anew."""
    names = docs.schema.fieldNames()
    place, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in steps(batch.column(place)):
                part = batch.slice(a, b - a)
                texts = part.column(place).to_pylist()
                spans = [model.spans(t) if t else [] for t in texts]
                new = [hide(t, s) if s else t for t, s in zip(texts, spans)]
                columns = list(part.columns)
                columns[place] = pa.array(new, columns[place].type)
                if counted is not None:
                    columns[counted] = pa.array([len(n) if s else c for n, s, c in zip(
                        new, spans, columns[counted].to_pylist())], columns[counted].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
        give_back()

    return docs.mapInArrow(run, docs.schema)
