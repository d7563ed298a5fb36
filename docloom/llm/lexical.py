"""Ranked lexical search, term at a time on short lists and document at a time on long ones.

Documents stay where they are: a task turns those it reads into shards, each with the posting lists
of the queries' terms, and no list leaves its shard. Within a shard a query's short lists are summed
term by term into accumulators. These count from then on as one list among the long ones, with a
bound for each block of documents like the others; blocks are visited from the highest sum of
bounds on, until no sum reaches the k-th best score, and in a block long lists are added in the order
of their bounds for as long as any document can still reach it. The shards' best are merged in two
steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.llm.common import arrow_schema, give_back, map_texts, steps

TOP = 10
#: A shard is closed when it has so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 500_000, 50_000
#: Documents in a block, and the share of a shard's documents that makes a list long.
BLOCK, LONG = 128, 1 / 16
#: Queries are answered in blocks of about so many (query, term) pairs; the terms of one block are
#: sent to all tasks. A single query has as many as its text has different terms.
BLOCK_TERMS = 200_000
#: Groups that shards' results are merged in before all are.
MERGES = 64

# ASCII characters that are parts of terms; all others beyond ASCII are, too.
_TERM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c in _TERM or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms as UTF-8, A-Z lower-cased; null has none."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_TO_TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) pairs; rows of one id are one query."""
    def work(ids, texts):
        pairs = [(i, t.decode()) for i, text in zip(ids, texts) for t in dict.fromkeys(terms_of(text))]
        return {"item_id": [i for i, _ in pairs], "term": [t for _, t in pairs]}

    kind = items.schema["item_id"].dataType.simpleString()
    return map_texts(items, f"item_id {kind}, term string", work, "item_id").distinct()


class _Gathered:
    """Postings of the documents of a shard to come."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, ids: list, texts: list, numbers: dict[bytes, int]) -> None:
        split = [terms_of(t) for t in texts]
        sizes = [len(s) for s in split]
        code = np.fromiter((c for s in split for c in map(numbers.get, s, repeat(-1))), np.int64, sum(sizes))
        doc = np.repeat(np.arange(len(split)) + len(self.ids), sizes)
        known = code >= 0
        keys, counts = np.unique(doc[known] * len(numbers) + code[known], return_counts=True)
        self.parts.append((keys // max(1, len(numbers)), keys % max(1, len(numbers)), counts))
        self.postings += len(keys)
        self.ids += ids
        self.lengths += sizes

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        docs, terms, counts = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((docs, terms))
        names, sizes = np.unique(terms, return_counts=True)
        lengths = np.array(self.lengths, np.int64)
        values = (self.ids, lengths, int((lengths > 0).sum()), int(lengths.sum()), names, sizes,
                  docs[order].astype("<i4").tobytes(), counts[order].astype("<i4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """One row for each shard: documents' ids and lengths, and the lists of the numbered terms.

    ``docs`` and ``counts`` are little-endian 32-bit integers, by term, then document.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"ids array<{kind}>, lengths array<long>, n_docs long, n_terms long, terms array<int>, sizes array<int>, docs binary, counts binary"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Gathered()
        for batch in batches:
            for a, b in steps(batch.column(1)):
                part = batch.slice(a, b - a)
                shard.add(part.column(0).to_pylist(), part.column(1).to_pylist(), numbers)
                if shard.postings >= SHARD_POSTINGS or len(shard.ids) >= SHARD_DOCS:
                    yield shard.row(wanted)
                    shard = _Gathered()
        if shard.ids:
            yield shard.row(wanted)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def length_factors(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's length in per cent of the mean, damped."""
    if len(lengths) and 90 * int(lengths.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 100 - 90 + 90 * lengths * n_docs // max(1, n_terms)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Lists of one shard with the worth of every posting, ready to be searched."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, sizes: np.ndarray, docs: np.ndarray, counts: np.ndarray,
                 order: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.size, self.order = len(lengths), order
        self.ends = np.cumsum(sizes)
        self.slot = {int(t): i for i, t in enumerate(terms)}
        self.docs = docs
        tf = counts.astype(np.int64)
        m = length_factors(lengths, n_docs, n_terms)
        self.worth = np.repeat(weights[terms], sizes) * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
        self.blocks = -(-self.size // BLOCK)
        self.long = {i: self._cut(i) for i in np.flatnonzero(sizes > LONG * self.size).tolist()}

    def _list(self, slot: int) -> slice:
        return slice(int(self.ends[slot - 1]) if slot else 0, int(self.ends[slot]))

    def _cut(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """A long list's first posting in each block, and the most that a posting there is worth."""
        part = self._list(slot)
        block = self.docs[part] // BLOCK
        most = np.zeros(self.blocks, np.int64)
        np.maximum.at(most, block, self.worth[part])
        return part.start + np.searchsorted(block, np.arange(self.blocks + 1)), most

    def accumulate(self, slots: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents on short lists, in order, with the sums of their worth."""
        if not slots:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = [self._list(s) for s in slots]
        docs, at = np.unique(np.concatenate([self.docs[p] for p in parts]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, at, np.concatenate([self.worth[p] for p in parts]))
        return docs, sums

    def best(self, terms: list[int], k: int = TOP) -> tuple[list[int], list[int], int]:
        """The k best documents and their scores, ties in the order of ids, and how many blocks were looked into."""
        slots = [self.slot[t] for t in terms if t in self.slot]
        have, sums = self.accumulate([s for s in slots if s not in self.long])
        long = [s for s in slots if s in self.long]
        bounds = np.zeros(self.blocks, np.int64)
        np.maximum.at(bounds, have // BLOCK, sums)
        for s in long:
            bounds += self.long[s][1]
        # the k-th best sum is a score that k documents reach already
        least = max(1, int(np.partition(sums, -k)[-k])) if len(sums) >= k else 1
        first = np.searchsorted(have, np.arange(self.blocks + 1) * BLOCK)
        docs, scores, looked = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] < least:
                break
            looked += 1
            score = np.zeros(BLOCK, np.int64)
            part = slice(first[b], first[b + 1])
            score[have[part] - b * BLOCK] = sums[part]
            lists = sorted(((int(self.long[s][1][b]), s) for s in long), reverse=True)
            rest = sum(m for m, _ in lists)
            for most, s in lists:
                if int(score.max()) + rest < least:
                    break
                at = self.long[s][0]
                part = slice(at[b], at[b + 1])
                score[self.docs[part] - b * BLOCK] += self.worth[part]
                rest -= most
            else:
                won = np.flatnonzero(score >= least)
                docs, scores = np.concatenate([docs, won + b * BLOCK]), np.concatenate([scores, score[won]])
                if len(scores) >= k:
                    least = max(least, int(np.partition(scores, -k)[-k]))
                    docs, scores = docs[scores >= least], scores[scores >= least]
        order = np.lexsort((self.order[docs], -scores))[:k]
        return docs[order].tolist(), scores[order].tolist(), looked


def _search(found: DataFrame, queries: list[tuple[object, list[int]]], weights: np.ndarray, n_docs: int, n_terms: int,
            item_kind: str, k: int) -> DataFrame:
    """(item_id, doc_id, score, blocks, looked) of each shard's best for each query."""
    names = ("ids", "lengths", "terms", "sizes", "docs", "counts")
    kind = found.schema["ids"].dataType.elementType.simpleString()
    schema = f"item_id {item_kind}, doc_id {kind}, score long, blocks long, looked long"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, lengths, terms, sizes, docs, counts = (batch.column(c)[i] for c in range(len(names)))
                ids = ids.values
                order = np.empty(len(ids), np.int64)
                order[pc.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                shard = Shard(lengths.values.to_numpy(), terms.values.to_numpy(), sizes.values.to_numpy(),
                              np.frombuffer(docs.as_buffer(), "<i4"), np.frombuffer(counts.as_buffer(), "<i4"), order, weights, n_docs, n_terms)
                rows: list[list] = [[], [], [], [], []]
                for item, wants in queries:
                    best, scores, looked = shard.best(wants, k)
                    for column, values in zip(rows, ([item] * len(best), best, scores, [shard.blocks] * len(best), [looked] * len(best))):
                        column += values
                rows[1] = ids.take(pa.array(rows[1], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(rows, wanted)], schema=wanted)
        give_back()

    return found.select(*names).mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents, ties by doc_id, null ids last.

    Every row of ``docs`` is a document of its own, also where rows repeat; null and empty texts are
    no documents. Rows of ``items`` with one id, null included, are one query with the terms of all
    of them; an item without a term of any document has no rows. Texts of any length are read
    whole. Empty tables give no rows. Other columns are not looked at.
    """
    wanted = materialize(item_terms(items), "item_terms")
    blocks = max(1, -(-wanted.count() // BLOCK_TERMS))
    out = []
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        numbers = {t.encode(): i for i, t in enumerate(sorted({r.term for r in rows}))}
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r.item_id, []).append(numbers[r.term.encode()])
        found = materialize(index(docs, numbers), "shards")
        total = found.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n_docs, n_terms = total[0] or 0, total[1] or 0
        weights = np.zeros(len(numbers), np.int64)
        for r in found.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes").alias("df")).collect():
            weights[r.terms] = term_weight(n_docs, r.df)
        item_kind = items.schema["item_id"].dataType.simpleString()
        out.append(_search(found, sorted(by_item.items(), key=lambda x: str(x[0])), weights, n_docs, n_terms, item_kind, k))
    best = out[0]
    for other in out[1:]:
        best = best.unionByName(other)
    best = best.withColumn("merge", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for keys in (("item_id", "merge"), ("item_id",)):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
size AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
t AS (SELECT rid, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
postings AS (
  SELECT rid, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM t
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, size GROUP BY term),
scored AS (
  SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM q JOIN postings USING (term) JOIN weights USING (term), size
  GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
