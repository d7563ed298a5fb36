"""Periodic runs against a plain search of all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docloom.llm import runs

SF = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_runs(words):
    """Every lag: stretches of equal words, kept if no smaller period holds."""
    out = set()
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - a
            part = words[a:a + length]
            if length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.add((a, length, q))
    if n >= 6 and n // 4 < 1:
        raise AssertionError
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words):
    return runs._searched([[w.encode() for w in words]])[0]


def periodic(rng, letters, longest):
    out = []
    while len(out) < 60:
        root = [rng.choice(letters) for _ in range(rng.randrange(1, longest))]
        out += root * rng.randrange(1, 9) + root[:rng.randrange(len(root))]
        out += [rng.choice(letters) for _ in range(rng.randrange(4))]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    words = periodic(rng, "ab" if seed % 2 else "abcdefgh", (4, 12, 40, 90)[seed % 4])
    assert found(words) == plain_runs(words)


def test_runs_inside_runs():
    """Periods that are made of runs of shorter periods, at scales far apart."""
    inner = ["x", "y"] * 9 + ["z"]
    outer = (inner * 5 + ["w"]) * 5
    assert found(outer) == plain_runs(outer)
    assert {q for _, _, q in found(outer)} == {2, 19, 96}
    # one letter only, one letter with a break, and too short for any
    assert found(["a"] * 700) == [(0, 700, 1)]
    assert found(["a"] * 300 + ["b"] + ["a"] * 300) == plain_runs(["a"] * 300 + ["b"] + ["a"] * 300)
    assert found(["a"] * 5) == [] and found([]) == []


@pytest.mark.parametrize("q", [15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 128, 129, 300])
def test_periods_at_the_bounds_of_scales(q):
    rng = random.Random(q)
    root = [rng.choice("abc") for _ in range(q - 1)] + ["q"]
    for extra in (-1, 0, 1):
        words = ["l", "m"] + (root * 5)[:4 * q + extra] + ["r"]
        assert found(words) == plain_runs(words)


def test_documents_of_a_step_do_not_mix():
    rng = random.Random(3)
    docs = [[w.encode() for w in periodic(rng, "abc", 30)] for _ in range(12)] + [[], [b"a"] * 6] * 2
    assert runs._searched(docs) == [plain_runs(d) for d in docs]


def test_minimizers_are_window_minima():
    h = np.random.default_rng(1).integers(0, 50, 300, dtype=np.uint64)
    for w in (1, 2, 7, 16, 300):
        want = sorted({i + j for i in range(len(h) - w + 1) for j in range(w) if h[i + j] == h[i:i + w].min()})
        assert runs.minimizers(h, w).tolist() == want
    assert len(runs.minimizers(h[:3], 4)) == 0


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    spans = plain_runs(words)
    gone = {i for s, m, q in spans for i in range(s + q, s + m)}
    best = min(spans, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in spans)
    return (len(spans), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_report_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.where("length(text) < 9000")
    rows = runs.report(short).collect()
    texts = {r.doc_id: r.text for r in short.collect()}
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    for r in rows:
        assert tuple(r)[1:] == plain_report(r.doc_id, texts[r.doc_id])


def test_edges(edge, nothing):
    got = {}
    for r in runs.report(edge).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == edge.count() and len(got[9]) == 2
    for i in (1, 2, 3, 12):
        assert got[i][0].n_runs == 0 and got[i][0].start is None and got[i][0].runs_sha256 == got[i][0].collapsed_sha256 == EMPTY
    whole = {r.doc_id: r for r in runs.collapse_runs(edge).collect()}
    assert whole[1].collapsed == "" and len(whole[8].collapsed) == 200_000 and not whole[6].runs
    assert runs.report(nothing).count() == runs.collapse_runs(nothing).count() == 0
