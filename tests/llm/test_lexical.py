"""Ranked search against scores of every document, on fixtures with ties, repeats and crowded lists."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    counted = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for (doc, c), n in zip(counted, sizes):
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1000000000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms))) for t in terms if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, parts=3):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    found = lexical.search(table, spark.createDataFrame(items, "item_id int, text string"))
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


def crowd(n, seed):
    """Words by falling frequency, copies, and a few rare ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[0][1]) for i in range(n // 3)]
    return docs + [(2 * n + i, f"rare{i % 7} {docs[i][1]}") for i in range(20)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_scores_of_all(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical, "BLOCK", 8)
    docs = crowd(300, seed)
    rng = random.Random(seed)
    items = [(i, " ".join(rng.sample([f"w{j}" for j in range(60)], 8) + [f"Rare{i % 9}"])) for i in range(25)]
    items += [(100, "w0"), (101, "w0 w1 w2"), (102, "unknown"), (103, None), (104, ""), (105, docs[0][1])]
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_many_shards_and_blocks_of_queries(spark, monkeypatch):
    """More shards than merges and more blocks of queries than one give the same rows."""
    docs = crowd(150, 9)
    items = [(i, f"w{i} w{i + 1} w5 rare{i}") for i in range(20)]
    want = plain_search(docs, items)
    for name, value in (("BLOCK_TERMS", 16), ("MERGES", 2)):
        monkeypatch.setattr(lexical, name, value)
    assert searched(spark, docs, items, 6) == want


def test_long_lists_are_skipped():
    """A query with a rare term looks into few blocks, whatever stands on its long lists."""
    rng = np.random.default_rng(4)
    n, terms = 20_000, 6
    lists = [np.sort(rng.choice(n, n // 2, replace=False)) for _ in range(terms - 1)] + [np.sort(rng.choice(n, 15, replace=False))]
    sizes = np.array([len(x) for x in lists])
    docs = np.concatenate(lists).astype(np.int32)
    weights = np.array([lexical.term_weight(n, s) for s in sizes], np.int64)
    shard = lexical.Shard(np.full(n, 100, np.int64), np.arange(terms), sizes, docs, np.ones(len(docs), np.int32), np.arange(n), weights, n, 100 * n)
    best, scores, looked = shard.best(list(range(terms)))
    worth = np.zeros(n, np.int64)
    np.add.at(worth, docs, shard.worth)
    order = np.lexsort((np.arange(n), -worth))[:10]
    assert best == order.tolist() and scores == worth[order].tolist()
    assert len(shard.long) == 5 and looked <= 15 < shard.blocks


def test_large_counts_do_not_overflow():
    n = np.array([10 ** 7, 5], np.int64)
    assert lexical.length_factors(n, 10 ** 12, 10 ** 15).tolist() == [10 + 90 * 10 ** 7 // 1000, 10]


def test_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, "ONE four w5x5", 5.0), (1, "one", 6.0), (None, "id two ünï", 7.0), (2, None, 8.0)], "item_id int, text string, score double")
    rows = lexical.search(edge, items).collect()
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    want = plain_search(docs, [(r.item_id, r.text) for r in items.collect()])
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str) == want and want
    assert [r.doc_id for r in rows if r.item_id is None].count(9) == 2
    assert lexical.search(nothing, items).count() == 0
    assert lexical.search(edge, items.limit(0)).count() == 0
