"""Periodic runs in texts: multi-scale minimizers seed them, direct lag scans cover short periods.

A run is a stretch of words with smallest period q that is at least LEAST words and TIMES * q long
and that no neighbouring word extends. Periods up to SHORT are found by comparing the words with
those q further on. Longer ones go by scales: for periods in (P, 2P], words are hashed 2P at a time
and the least hash of every P in a row is kept. Inside a run the window minima come again at the
distance of the period, and no hash of 2P >= q words comes twice within a period, so two
neighbouring equal minima at a distance in (P, 2P] seed every run; each seed is extended word by
word. All documents of a step are searched together, with marks between them that equal nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_texts

LEAST, TIMES = 6, 4
#: Periods up to here are found by lag scans; the first scale is for those up to twice as long.
SHORT = 16

Words = list[bytes]
Run = tuple[int, int, int]


def plain_words(doc_id, text: str | None) -> Words:
    """Runs of anything but the six ASCII blanks; null has none."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2k words from those of k; what would reach beyond the end is hashed with a unique number."""
    after = np.empty_like(h)
    kept = max(0, len(h) - k)
    after[:kept] = h[k:]
    after[kept:] = _mixed(np.arange(len(h) - kept, dtype=np.uint64) + np.uint64((k << 40) + 1))
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + after)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w in a row: minima from the left and from the right of blocks of w."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of some w in a row."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = _sliding_min(h, w)
    # the greatest of the minima around a place is its own hash if it is one of them
    around = np.full(len(h) + w - 1, np.iinfo(np.uint64).max, np.uint64)
    around[w - 1:len(h)] = ~least
    return np.flatnonzero(~_sliding_min(around, w) == h)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first elements are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        to = min(n, at + step)
        other = a[at:to] != b[at:to]
        bad = int(other.argmax())
        if other[bad]:
            return at + bad
        at, step = to, step * 2
    return n


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _smallest(codes: np.ndarray, start: int, q: int) -> bool:
    """Whether no part of q is a period too: of a stretch of 4q words it would divide q."""
    return not any(np.array_equal(codes[start:start + q], codes[start + q // p:start + q // p + q]) for p in _primes(q))


def _by_lag(codes: np.ndarray, q: int) -> list[Run]:
    """Stretches with period q that are long enough."""
    same = np.flatnonzero(codes[q:] == codes[:-q])
    if not len(same):
        return []
    cut = np.flatnonzero(np.diff(same) != 1)
    first, last = same[np.concatenate(([0], cut + 1))], same[np.concatenate((cut, [len(same) - 1]))]
    length = last - first + 1 + q
    long = length >= max(LEAST, TIMES * q)
    return [(a, n, q) for a, n in zip(first[long].tolist(), length[long].tolist())]


def _seeds(h: np.ndarray, places: np.ndarray, p: int) -> list[tuple[int, int]]:
    """(distance, place) of neighbouring equal minimizers at a distance in (p, 2p]."""
    at = minimizers(h, p)
    order = at[np.argsort(h[at], kind="stable")]
    away = places[order[1:]] - places[order[:-1]]
    near = np.flatnonzero((h[order[1:]] == h[order[:-1]]) & (away > p) & (away <= 2 * p))
    return sorted(zip(away[near].tolist(), places[order[near]].tolist()))


def find_runs(codes: np.ndarray, begins: np.ndarray) -> list[Run]:
    """All (start, length, period) over documents' codes, each document followed by a mark of its own.

    ``begins`` are the documents' first places, and the number of codes as the last one.
    """
    found = {r for q in range(1, min(SHORT, (len(codes) - 1) // TIMES) + 1) for r in _by_lag(codes, q)}
    sizes = np.diff(begins)
    h, places = _mixed(codes.astype(np.uint64)), np.arange(len(codes))
    k, p = 1, SHORT
    # a document takes part as long as it is long enough for the scale's least period
    while (sizes > TIMES * (p + 1)).any():
        stay = sizes > TIMES * (p + 1)
        keep = np.repeat(stay, sizes)
        h, places, sizes = h[keep], places[keep], sizes[stay]
        while k < 2 * p:
            h, k = _doubled(h, k), 2 * k
        lag, end = 0, 0
        for q, x in _seeds(h, places, p):
            if q == lag and x < end:
                continue
            back = _agree(codes[:x][::-1], codes[:x + q][::-1])
            end, lag = x + _agree(codes[x:], codes[x + q:]), q
            if end - x + back + q >= TIMES * q:
                found.add((x - back, end - x + back + q, q))
        p *= 2
    return sorted((r for r in found if _smallest(codes, r[0], r[2])), key=lambda r: (r[0], r[2]))


def _searched(documents: list[Words]) -> list[list[Run]]:
    """The runs of each document, with starts counted from its first word."""
    number: dict[bytes, int] = {}
    marks = count(1)
    begins = np.cumsum([0] + [len(w) + 1 for w in documents])
    codes = np.empty(int(begins[-1]), np.int64)
    for a, words in zip(begins.tolist(), documents):
        codes[a:a + len(words)] = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        codes[a + len(words)] = -next(marks)
    out: list[list[Run]] = [[] for _ in documents]
    for start, length, period in find_runs(codes, begins):
        i = int(np.searchsorted(begins, start, "right")) - 1
        out[i].append((start - int(begins[i]), length, period))
    return out


def collapse_runs(docs: DataFrame, words: Callable[[object, str | None], Words] = plain_words) -> DataFrame:
    """(doc_id, runs, collapsed) of every row, in one pass without a shuffle.

    ``runs`` has (start, length, period) of every run, by start, then period; ``collapsed`` is the
    text without the words that some run holds after its first period, words joined by one blank.
    ``words(doc_id, text)`` gives a row's words. Null and empty texts have no run and collapse to an
    empty text; repeated rows and null ids come back as they came in; an empty table gives no rows;
    a long text is searched whole, in memory that is a multiple of its own size. Other columns are
    not looked at.
    """
    def work(ids, texts):
        split = [words(i, t) for i, t in zip(ids, texts)]
        found = _searched(split)
        collapsed = []
        for each, runs in zip(split, found):
            if runs:
                gone = np.zeros(len(each) + 1, np.int64)
                for start, length, period in runs:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                each = [each[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
            collapsed.append(b" ".join(each).decode("utf-8"))
        return {"doc_id": ids, "runs": [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found],
                "collapsed": collapsed}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string", work)


def with_planted(doc_id, text: str | None) -> Words:
    """A text's words, where one id in ten has its tail repeated with a period that follows from the id."""
    words = plain_words(doc_id, text)
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    root = words[a:a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (root * -(-(n - a) // len(root)))[:n - a]


def report(docs: DataFrame) -> DataFrame:
    """Digest columns of :func:`collapse_runs` over the texts of :func:`with_planted`.

    A null id plants nothing.
    """
    found = collapse_runs(docs, with_planted)
    # runs come by start and period, so the first of equals stays
    strongest = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), strongest.alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
