"""Repeated passages: phrase automata over first occurrences, and all documents streamed past them.

A window of WINDOW words always holds one of its text's winnowed phrases (the least hash of its
PHRASE-word sequences), so passages are found by phrases:

1. Every document's winnowed phrases are hashed; phrases of two or more documents recur, and the
   smallest document that has one owns it. No window with a phrase occurs before its owner.
2. Stretches around recurring phrases go to their owner's shard. A shard compiles the phrases in its
   owners' stretches into an Aho-Corasick automaton, streams all stretches through it and extends
   every occurrence word by word along the owner's text: runs of WINDOW words or more go.
3. Windows stay open whose least phrase recurs but that do not occur in its owner, as around small
   changes in copies. Every document that has such a window finds it open, and in the same shard, as
   they all have the same owner: the smallest of these is the first, and the others' windows go too.
   A shard settles that by 128-bit hashes for itself; only where it is streamed in several copies do
   the windows that one copy saw in a single document go on, as rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.llm.common import arrow_schema, map_texts, steps, words_of

WINDOW, PHRASE = 50, 25
MARGIN = WINDOW - PHRASE
#: Words of owners' stretches in a shard, and of stretches streamed past one copy of it.
SHARD_WORDS, STREAM_WORDS = 100_000, 300_000

_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2^64."""
    if factor not in _POWERS or len(_POWERS[factor][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        _POWERS[factor] = tuple(np.cumprod(np.full(size, f, np.uint64)) for f in (factor, pow(factor, -1, 1 << 64)))
    return _POWERS[factor]


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 1) for w in words), np.uint64, len(words))


def rolling(hashes: np.ndarray, k: int, factor: int = _FACTORS[0]) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(factor, n)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[:n])))
    return (sums[k:] - sums[:-k]) * down[:n - k + 1]


def winnowed(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the phrases that are the least in some window, leftmost of equals; and the first of
    the windows in a row that each is the least of, with their number."""
    room = WINDOW - PHRASE + 1
    if len(phrases) < room:
        return (np.zeros(0, np.int64),) * 3
    least = np.lib.stride_tricks.sliding_window_view(phrases, room).argmin(1)
    return np.unique(least + np.arange(len(least)), return_index=True, return_counts=True)


def _survey(docs: DataFrame) -> DataFrame:
    """Per document its words, their digest, and its winnowed phrases."""
    def work(rows, texts):
        out = {k: [] for k in ("n_words", "whole", "places", "phrases")}
        for text in texts:
            words = words_of(text)
            hashes = rolling(word_hashes(words), PHRASE)
            places = winnowed(hashes)[0]
            for k, v in zip(out, (len(words), hashlib.sha256(b" ".join(words)).hexdigest(), places.astype(np.int32),
                                  hashes[places].view(np.int64))):
                out[k].append(v)
        return {"key": rows, **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(_key(), "text")
    return map_texts(keyed, f"key struct<doc_id:{kind},text_hash:long>, n_words long, whole string, places array<int>, phrases array<long>",
                     work, "key").select("key.*", "n_words", "whole", "places", "phrases")


def _key():
    """Repeated ids with different texts are different documents."""
    return F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key")


def _stretches(suspects: DataFrame) -> DataFrame:
    """Rows (owner, doc_id, text_hash, start, text, hits, firsts, counts): text around phrases of one owner."""
    names = suspects.columns
    kind = suspects.schema["doc_id"].dataType.simpleString()
    schema = (f"owner {kind}, doc_id {kind}, text_hash long, start int, words int, text string, hits array<int>, firsts array<int>, counts array<int>")

    wanted = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for a, b in steps(batch.column(names.index("text")), 500_000):
                out = {f.name: [] for f in wanted}
                for row in batch.slice(a, b - a).to_pylist():
                    words = words_of(row["text"])
                    windows = {p: (a, n) for p, a, n in zip(*map(np.ndarray.tolist, winnowed(rolling(word_hashes(words), PHRASE))))}
                    owners = {h["place"]: h["owner"] for h in row["hits"]}
                    runs: dict = {}
                    for p in sorted(owners):
                        lo, hi = max(0, p - MARGIN), min(len(words), p + WINDOW)
                        found = runs.setdefault(owners[p], [])
                        if found and lo <= found[-1][1]:
                            found[-1][1] = hi
                            found[-1][2].append(p)
                        else:
                            found.append([lo, hi, [p]])
                    for owner, found in runs.items():
                        for lo, hi, hits in found:
                            for k, v in (("owner", owner), ("doc_id", row["doc_id"]), ("text_hash", row["text_hash"]), ("start", lo),
                                         ("words", hi - lo), ("text", b" ".join(words[lo:hi]).decode("utf-8")),
                                         ("hits", [h - lo for h in hits]), ("firsts", [windows[h][0] - lo for h in hits]),
                                         ("counts", [windows[h][1] for h in hits])):
                                out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in wanted], schema=wanted)

    return suspects.mapInArrow(run, schema)


def _automaton(own: list[list[str]], hits: list[list[int]], owners: list):
    """Phrases at the given places of the owners' stretches; each knows where it stands.

    Of an owner's places with the same words around them, as in text that repeats itself, one is kept.
    """
    import ahocorasick

    places: dict[str, dict] = {}
    for i, (words, at, owner) in enumerate(zip(own, hits, owners)):
        for p in at:
            around = hash((owner, min(p, MARGIN), tuple(words[max(0, p - MARGIN):p + WINDOW])))
            places.setdefault(f" {' '.join(words[p:p + PHRASE])} ", {}).setdefault(around, (i, p))
    machine = ahocorasick.Automaton()
    for phrase, found in places.items():
        machine.add_word(phrase, list(found.values()))
    machine.make_automaton()
    return machine


def locate(words: list[str], machine, own: list[list[str]], mine: set[int]) -> list[tuple[int, int]]:
    """Runs (from, to) of WINDOW words or more that stand in the stretches numbered ``mine`` as well.

    An occurrence is extended as far as windows that hold it reach; longer passages are runs that
    overlap, one for each phrase in them.
    """
    text = f" {' '.join(words)} "
    begins = np.cumsum([1] + [len(w) + 1 for w in words[:-1]])
    out = []
    for end, found in machine.iter(text):
        # the phrase ends before the blank at ``end``
        p = int(np.searchsorted(begins, end)) - PHRASE
        left, right = min(p, MARGIN), min(len(words) - p, WINDOW)
        for i, q in found:
            if i not in mine:
                continue
            there = own[i]
            lo, hi = 0, PHRASE
            most_lo, most_hi = min(left, q), min(right, len(there) - q)
            while lo < most_lo and words[p - lo - 1] == there[q - lo - 1]:
                lo += 1
            while hi < most_hi and words[p + hi] == there[q + hi]:
                hi += 1
            if lo + hi >= WINDOW:
                out.append((p - lo, p + hi))
                if lo == left and hi == right:
                    break
    return out


def _open_windows(size: int, firsts: np.ndarray, counts: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
    """Windows whose least phrase is a hit and that lie in no run."""
    n = max(0, size - WINDOW + 1)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, firsts, 1)
    np.add.at(change, firsts + counts, -1)
    still = np.cumsum(change)[:n] > 0
    for a, b in runs:
        still[a:b - WINDOW + 1] = False
    return np.flatnonzero(still)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words in stretches without overlaps; runs in order."""
    out: list[list[int]] = []
    for a, b in runs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class _Open:
    """Open windows of the documents that a shard's copy has streamed, as arrays."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, doc_id, text_hash: int, start: int, words: list[str], still: np.ndarray) -> None:
        if len(still):
            hashes = word_hashes([w.encode() for w in words])
            h1, h2 = (rolling(hashes, WINDOW, f)[still] for f in _FACTORS)
            self.parts.append((np.full(len(still), len(self.rows)), start + still, h1, h2))
            self.rows.append((doc_id, text_hash))

    def settle(self, alone: bool) -> tuple[list[tuple], list[tuple[np.ndarray, ...]]]:
        """Runs of documents that are not the first here to have their windows, and, unless the copy
        is ``alone``, one of each different window as (row, start, h1, h2)."""
        if not self.parts:
            return [], []
        row, start, h1, h2 = (np.concatenate(c) for c in zip(*self.parts))
        ids = [r[0] for r in self.rows]
        rank = {d: i for i, d in enumerate(sorted(set(ids)))}
        doc = np.array([rank[d] for d in ids])[row]
        order = np.lexsort((doc, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        first = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        late = np.sort(order[doc[order] > first])
        runs = []
        if len(late):
            # starts of a document in a row make one run
            cut = np.flatnonzero((np.diff(row[late]) != 0) | (np.diff(start[late]) != 1)) + 1
            for part in np.split(late, cut):
                runs.append((*self.rows[row[part[0]]], int(start[part[0]]), int(start[part[-1]] - start[part[0]]) + WINDOW))
        if alone:
            return runs, []
        # all windows of the first document with each, so that another copy may still find it late
        stay = np.sort(order[doc[order] == first])
        return runs, [(row[stay], start[stay], h1[stay], h2[stay])]


def _search(stretches: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, length, h1, h2): runs to remove, and windows still open with their hashes."""
    owned = stretches.where("owner = doc_id").agg(F.sum("words")).first()[0] or 0
    shard = F.pmod(F.xxhash64("owner"), F.lit(max(1, -(-owned // SHARD_WORDS)))).alias("shard")
    own = stretches.where("owner = doc_id").select(shard, "owner", "text", "hits")
    others = stretches.where("owner <> doc_id").select(shard, "owner", "doc_id", "text_hash", "start", "words", "text", "hits", "firsts", "counts")
    copies = others.groupBy("shard").agg(F.ceil(F.sum("words") / STREAM_WORDS).cast("int").alias("copies"))
    own = own.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    others = others.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.col("copies")).cast("int"))
    # both sides come from one table: new names keep their columns apart
    own = own.select("shard", "copy", *(F.col(c).alias(f"own_{c}") for c in ("owner", "text", "hits"))).toDF(
        "own_shard", "own_copy", "own_owner", "own_text", "own_hits")
    kind = stretches.schema["doc_id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts = [t.split(" ") for t in left["own_text"]]
        machine = _automaton(texts, [list(h) for h in left["own_hits"]], list(left["own_owner"]))
        of: dict = {}
        for i, owner in enumerate(left["own_owner"]):
            of.setdefault(owner, set()).add(i)
        rows, windows = [], _Open()
        for r in right.itertuples():
            words = r.text.split(" ")
            runs = sorted(set(locate(words, machine, texts, of.get(r.owner, set()))))
            rows += [(r.doc_id, r.text_hash, r.start + a, b - a) for a, b in merged(runs)]
            windows.add(r.doc_id, r.text_hash, r.start, words, _open_windows(len(words), np.asarray(r.firsts), np.asarray(r.counts), runs))
        late, still = windows.settle(not len(right) or right["copies"].iloc[0] == 1)
        rows += late
        names = ("doc_id", "text_hash", "start", "length", "h1", "h2")
        done = dict(zip(names, (list(c) for c in zip(*rows)) if rows else ([],) * 4))
        out = pd.DataFrame({n: done[n] if n == "doc_id" else pd.array(done[n], "Int64") for n in names[:4]}).assign(
            **{n: pd.array([None] * len(rows), "Int64") for n in names[4:]})
        if not still:
            return out
        row, start, h1, h2 = still[0]
        ids = pd.Series([r[0] for r in windows.rows]).iloc[row].reset_index(drop=True)
        # nullable integers from the start: a detour by floats would round the hashes
        more = pd.DataFrame({"doc_id": ids, "text_hash": pd.array(np.array([r[1] for r in windows.rows], np.int64)[row], "Int64"),
                             "start": pd.array(start, "Int64"), "length": pd.array(np.full(len(row), WINDOW), "Int64"),
                             "h1": pd.array(h1.view(np.int64), "Int64"), "h2": pd.array(h2.view(np.int64), "Int64")})
        return more if out.empty else pd.concat([out, more], ignore_index=True)

    return own.groupBy("own_shard", "own_copy").cogroup(others.groupBy("shard", "copy")).applyInPandas(
        run, f"doc_id {kind}, text_hash long, start int, length int, h1 long, h2 long")


def removed_runs(docs: DataFrame, surveyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, runs) of documents that lose words, and the texts of all that have a recurring phrase."""
    found = surveyed.where("doc_id IS NOT NULL").select("doc_id", "text_hash", F.explode(F.arrays_zip("places", "phrases")).alias("p")).select(
        "doc_id", "text_hash", F.col("p.places").alias("place"), F.col("p.phrases").alias("phrase"))
    # written, so that both sides of the join are plain shuffles and a frequent phrase can be split
    recurring = materialize(found.groupBy("phrase").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where(
        "owner < last").select("phrase", "owner"), "recurring")
    hits = found.join(recurring, "phrase").groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("place", "owner")).alias("hits"))
    # a repeated row is searched once
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(hits, ["doc_id", "text_hash"])
    suspects = materialize(texts.dropDuplicates(["doc_id", "text_hash"]), "suspects")
    stretches = materialize(_stretches(suspects), "stretches")
    gone = materialize(_search(stretches), "runs")
    still = gone.where("h1 IS NOT NULL")
    first = still.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    late = still.join(first, ["h1", "h2"]).where("doc_id > first")
    columns = ["doc_id", "text_hash", "start", "length"]
    runs = gone.where("h1 IS NULL").select(*columns).unionByName(late.select(*columns)).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "length")).alias("runs"))
    return runs, suspects.select("doc_id", "text_hash", "text")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row.

    ``kept`` is the text that stays, its words joined by blanks, where words went; else null. Null
    and empty texts have no words; repeated rows are judged alike; a row without an id keeps all its
    words and removes none elsewhere; rows of one id do not remove each other's words. An empty
    table gives no rows; other columns are not looked at.
    """
    surveyed = materialize(_survey(docs), "survey")
    runs, texts = removed_runs(docs, surveyed)
    damaged = texts.join(runs, ["doc_id", "text_hash"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_id {kind}, _hash long, n_removed long, kept_sha256 string, kept string"

    wanted = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for a, b in steps(batch.column("text"), 500_000):
                out = {f.name: [] for f in wanted}
                for row in batch.slice(a, b - a).to_pylist():
                    words = words_of(row["text"])
                    change = np.zeros(len(words) + 1, np.int32)
                    for r in row["runs"]:
                        change[r["start"]] += 1
                        change[r["start"] + r["length"]] -= 1
                    stay = np.cumsum(change[:-1]) == 0
                    kept = b" ".join([words[i] for i in np.flatnonzero(stay)])
                    for k, v in zip(out, (row["doc_id"], row["text_hash"], int((~stay).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8"))):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in wanted], schema=wanted)

    done = damaged.mapInArrow(run, schema)
    rows = surveyed.select("doc_id", "text_hash", "n_words", "whole")
    return rows.join(done, (F.col("doc_id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), "kept")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of :func:`drop_repeats`."""
    return drop_repeats(docs).drop("kept")
