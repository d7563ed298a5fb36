"""Toxic documents by a subsequence string kernel, Nyström landmarks and a linear SVM.

A unit is a word (or a run of spaced-out letters) in folded letters with a start mark; long words
are read in overlapping windows. Two units are compared by the gap-weighted subsequence kernel of
order three, normalised: a common subsequence counts DECAY per position it spans, so inserted
characters lower the value but do not lose the match. A sentence is worth its best unit, a document
its best sentence, which is how labels of whole texts reach units (multiple-instance learning).

The landmarks' kernel expansion is folded into one table over letter triples, so that a unit costs
a few table look-ups and no comparison with landmarks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fold_of, give_back, map_texts, steps

FOLDS = 5
#: Bounds of the training sample: labelled documents of each class, chosen by a hash of their id,
#: and the characters one of them may have.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 800, 2500, 20_000
DECAY = 0.5
WINDOW = 12
CLASSES = 64
START = 27
#: Landmarks: discriminative strings of toxic sentences, and common units of clean ones.
LANDMARKS = 64
COVER = 2
#: Sentences of each class that landmarks are chosen from.
SENTENCES = 12_000
#: Decisions below the SVM's negative margin are all the same to a document.
FLOOR = -1.0
#: Words a worker remembers as judged.
REMEMBER = 100_000

# Digits and signs that are written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ß": "s"}

_SPACED = re.compile(r"(?<!\S)\w(?:\s\w){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+\s*")


class _Fold(dict):
    """Characters to plain lower-case letters; what is no letter goes."""

    def __missing__(self, point: int) -> str:
        char = chr(point).lower()
        char = LOOKALIKES.get(char, char)
        base = unicodedata.normalize("NFKD", char)[:1]
        self[point] = out = base if base.isalpha() else ""
        return out


_FOLD = _Fold()


#: Letter classes: a-z, the start mark, and other letters by code point; 0 is no letter.
_TABLE = np.zeros(0x3000, np.uint8)
_SIGNS = "@$"


def _class(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else START if char == "^" else 28 + ord(char) % (CLASSES - 28)


def _fill() -> None:
    for point in range(len(_TABLE)):
        letter = _FOLD[point]
        _TABLE[point] = _class(letter) if letter and point != 10 else 0


_fill()


@lru_cache(1 << 16)
def windows(word: str) -> tuple[str, ...]:
    """The units of one word: none below three letters, several above WINDOW letters.

    A sign stands for a letter only between letters.
    """
    letters = "".join(_FOLD[ord(c)] for i, c in enumerate(word) if c not in _SIGNS or (
        0 < i < len(word) - 1 and word[i - 1].isalnum() and word[i + 1].isalnum()))
    if len(letters) < 3:
        return ()
    return ("^" + letters[:WINDOW], *(letters[at:at + WINDOW] for at in range(
        WINDOW // 2, len(letters) - WINDOW // 2, WINDOW // 2)))


def unit_matrices(words: list[str]):
    """(places of words, letter classes of one unit each) by unit length: ``windows``, vectorised."""
    points = np.frombuffer("\n".join(words).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    classes = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    for point in np.unique(points[points >= len(_TABLE)]):
        letter = _FOLD[int(point)]
        classes[points == point] = _class(letter) if letter else 0
    for i in np.flatnonzero((points == ord("@")) | (points == ord("$"))):
        if not (0 < i < len(points) - 1 and chr(points[i - 1]).isalnum() and chr(points[i + 1]).isalnum()):
            classes[i] = 0
    word = np.cumsum(points == 10)[classes > 0]
    letters = classes[classes > 0].astype(np.int32)
    sizes = np.bincount(word, minlength=len(words))
    begins = np.cumsum(sizes) - sizes
    head = np.minimum(sizes, WINDOW)
    for n in range(3, WINDOW + 1):
        places = np.flatnonzero(head == n)
        if len(places):
            body = letters[begins[places][:, None] + np.arange(n)]
            yield places, np.hstack([np.full((len(places), 1), START, np.int32), body])
    step = WINDOW // 2
    more = np.where(sizes > WINDOW, -(-(sizes - step) // step) - 1, 0)
    places = np.repeat(np.arange(len(words)), more)
    at = (np.arange(len(places)) - np.repeat(np.cumsum(more) - more, more) + 1) * step
    length = np.minimum(WINDOW, sizes[places] - at)
    for n in range(3, WINDOW + 1):
        chosen = np.flatnonzero(length == n)
        if len(chosen):
            yield places[chosen], letters[(begins[places[chosen]] + at[chosen])[:, None] + np.arange(n)]


def word_set(text: str) -> set[str]:
    """Distinct words of a text, runs of single letters joined to words as well."""
    words = set(text.split())
    if sum(len(w) == 1 for w in words) > 2:
        words.update("".join(run.split()) for run in _SPACED.findall(text))
    return words


def _by_length(units: list[str]):
    """(places, matrix of letter codes) for each length that occurs."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        if n >= 3:
            yield places, np.array([[_class(c) for c in units[i]] for i in places], np.int32)


def _triples(matrix: np.ndarray):
    """(codes of a triple of positions, its weight) for each such triple."""
    for i, j, k in combinations(range(matrix.shape[1]), 3):
        yield (matrix[:, i] * CLASSES + matrix[:, j]) * CLASSES + matrix[:, k], np.float32(DECAY ** (k - i + 1))


def _least_norm(length: int) -> float:
    """A unit of this length has at least this norm: as if no triple occurred twice."""
    return float(np.sqrt(sum(DECAY ** (2 * (k - i + 1)) for i, _, k in combinations(range(length), 3))))


def _norms(matrix: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each row's unit with itself."""
    out = np.empty(len(matrix))
    for start in range(0, len(matrix), 10_000):
        pairs = list(_triples(matrix[start:start + 10_000]))
        codes = np.stack([c for c, _ in pairs], 1)
        order = np.argsort(codes, 1)
        codes = np.take_along_axis(codes, order, 1)
        weights = np.array([w for _, w in pairs])[order]
        first = np.hstack([np.ones((len(codes), 1), bool), codes[:, 1:] != codes[:, :-1]]).ravel()
        sums = np.add.reduceat(weights.ravel(), np.flatnonzero(first))
        owner = np.flatnonzero(first) // codes.shape[1]
        out[start:start + 10_000] = np.sqrt(np.bincount(owner, sums ** 2, len(codes)))
    return out


def norms(units: list[str]) -> np.ndarray:
    """Norms of units given as strings; 1 for those without a triple."""
    out = np.ones(len(units))
    for places, matrix in _by_length(units):
        out[places] = _norms(matrix)
    return out


class Landmarks:
    """Kernel values of units with a fixed list of strings."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        found = [Counter() for _ in strings]
        for place, matrix in _by_length(strings):
            for code, weight in _triples(matrix):
                for p, c in zip(place, code):
                    found[p][int(c)] += float(weight)
        self.used = np.array(sorted(set().union(*found)) or [0])
        at = {c: i for i, c in enumerate(self.used)}
        self.place = np.full(CLASSES ** 3, len(self.used), np.int32)
        self.place[self.used] = np.arange(len(self.used))
        self.values = np.zeros((len(self.used) + 1, len(strings)), np.float32)
        for j, (counts, norm) in enumerate(zip(found, norms(strings))):
            for c, v in counts.items():
                self.values[at[c], j] = v / norm

    def kernel(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), len(self.strings)), np.float32)
        for places, matrix in _by_length(units):
            for start in range(0, len(places), 20_000):
                part = places[start:start + 20_000]
                for code, weight in _triples(matrix[start:start + 20_000]):
                    out[part] += weight * self.values[self.place[code]]
        return out / norms(units)[:, None].astype(np.float32)

    def nearest(self, units: list[str], first: int, least: float) -> np.ndarray:
        """Largest kernel value with the first landmarks; 0 where their sum shows it below ``least``."""
        total = self.table((np.arange(len(self.strings)) < first).astype(np.float32))
        bound = np.zeros(len(units))
        for places, matrix in _by_length(units):
            bound[places] = sum(weight * total[code] for code, weight in _triples(matrix)) / _least_norm(matrix.shape[1])
        out, alive = np.zeros(len(units)), np.flatnonzero(bound >= least)
        if len(alive):
            out[alive] = self.kernel([units[i] for i in alive])[:, :first].max(1)
        return out

    def table(self, alpha: np.ndarray) -> np.ndarray:
        """Weights of all triples for the expansion sum of alpha times landmark."""
        out = np.zeros(CLASSES ** 3, np.float32)
        out[self.used] = self.values[:-1] @ alpha
        return out


@dataclass
class Model:
    """The decision of a unit is bias + table . triples / norm; slope and shift make it a score."""

    table: np.ndarray | None
    bias: float
    slope: float
    shift: float
    constant: float = 0.0

    def decide(self, matrix: np.ndarray) -> np.ndarray:
        """SVM decisions of units of one length; what a bound shows to lie below FLOOR gets FLOOR."""
        total = np.zeros(len(matrix), np.float32)
        for code, weight in _triples(matrix):
            total += weight * self.table[code]
        out = np.full(len(matrix), FLOOR)
        alive = np.flatnonzero(np.maximum(total, 0) / _least_norm(matrix.shape[1]) + self.bias > FLOOR)
        if len(alive):
            out[alive] = np.maximum(total[alive] / _norms(matrix[alive]) + self.bias, FLOOR)
        return out

    def decide_units(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), FLOOR)
        for places, matrix in _by_length(units):
            out[places] = self.decide(matrix)
        return out

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -30, 30)))


def _grams(units: frozenset[str]) -> set[str]:
    return {u[i:i + n] for u in units for n in (4, 5, 6) for i in range(len(u) - n + 1)} | {u for u in units if len(u) > 3}


def _gains(toxic: list[frozenset[str]], clean: list[frozenset[str]]) -> dict[str, float]:
    """Worth of strings that many toxic and hardly any clean sentences have."""
    often = Counter()
    for s in toxic:
        often.update(_grams(s))
    often = {g: n for g, n in often.items() if n > 1}
    outside = Counter()
    for s in clean:
        outside.update(often.keys() & _grams(s))
    share = len(toxic) / max(1, len(clean))
    return {g: n * (1 + float(np.log2((n + .5) / (n + outside[g] * share + 1)))) for g, n in often.items()
            if outside[g] * share < .15 * n}


def _choose(toxic: list[frozenset[str]], clean: list[frozenset[str]]) -> list[str]:
    """Landmarks that cover toxic sentences and spare clean ones, chosen greedily.

    A string must be worth more than any is to tell clean sentences from other clean ones (every
    so manieth of them play the toxic ones): such a worth comes about by chance.
    """
    gain = _gains(toxic, clean)
    every = max(2, len(clean) // max(1, len(toxic)))
    chance = max(_gains(clean[::every], [s for i, s in enumerate(clean) if i % every]).values(), default=0)
    names = sorted(gain, key=lambda g: (-gain[g], -len(g), g))
    names = ([g for g in names if gain[g] > chance] or names[:8])[:4000]
    at, chosen = {g: i for i, g in enumerate(names)}, []
    holders = [[] for _ in names]
    for j, s in enumerate(toxic):
        for g in at.keys() & _grams(s):
            holders[at[g]].append(j)
    wanted = np.full(len(toxic), COVER)
    # of strings with about the same worth, the longer one is more specific
    value = np.array([gain[g] * (1 + .05 * len(g)) for g in names])
    while len(chosen) < LANDMARKS and len(names):
        worth = [value[i] * wanted[h].mean() if h else 0 for i, h in enumerate(holders)]
        best = int(np.argmax(worth))
        if worth[best] <= (chance if chosen else 0):
            break
        chosen.append(names[best])
        wanted[holders[best]] = np.maximum(wanted[holders[best]] - 1, 0)
        # strings that lie within it or around it tell nothing new
        for i, g in enumerate(names):
            if g in names[best] or names[best] in g:
                holders[i] = []
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 5e-3) -> np.ndarray:
    """Squared-hinge SVM in the primal by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge * weight.sum() / len(x) * 10)
    penalty[-1] = 1e-6
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(30):
        a, c = x[active], weight[active][:, None]
        w = np.linalg.solve((a * c).T @ a + np.diag(penalty), (a * c).T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that is one half at the best cut between the classes.

    The cut makes the fewest errors on the training documents, a clean one held toxic counting
    twice; of cuts as good as one another it is the lowest. Within the SVM's margin the curve runs
    from about 0.02 to 0.98.
    """
    values = np.unique(np.append(f, FLOOR))
    pos, neg = np.sort(f[y == 1]), np.sort(f[y == 0])
    errors = np.searchsorted(pos, values, "right") + 2 * (len(neg) - np.searchsorted(neg, values, "right"))
    errors[-1] = len(y) * 3  # someone has to be toxic
    best = int(np.argmin(errors))
    cut = (3 * values[best] + values[min(best + 1, len(values) - 1)]) / 4
    return 8.0, float(-8.0 * cut)


def _variants(units: list[str], rng: np.random.Generator) -> list[str]:
    """Each unit with one letter put in or doubled: what evasion looks like."""
    out = []
    for u in units:
        if len(u) > 3:
            at = int(rng.integers(2, len(u)))
            out.append(u[:at] + "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] + u[at:])
            out.append(u[:at] + u[at - 1] + u[at:])
    return out


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit on whole labelled texts; without both classes the model is a constant."""
    def bag(text: str) -> list[set[str]]:
        whole = word_set(text)
        spaced = {u for w in whole - set(text.split()) for u in windows(w)}
        return [s for s in [{u for w in set(p.split()) for u in windows(w)} for p in _SENTENCE.split(text)] + [spaced] if s]

    bags = [bag(t) for t in texts]
    y = np.array(labels)
    units = [set().union(*b) if b else set() for b in bags]
    # every fourth clean document is kept for setting the cut
    aside = (y == 0) & (np.cumsum(y == 0) % 4 == 0)
    toxic = [u for u, l in zip(units, y) if l == 1]
    clean = [u for u, l, a in zip(units, y, aside) if l == 0 and not a]
    base = Model(None, 0, 1, 0, float(y.mean()) if len(y) else 0.0)
    if not toxic or not clean:
        return base
    # a sentence that copies share counts once
    sides = (sorted({frozenset(s) for b, l, a in zip(bags, y, aside) if l == side and not a for s in b}, key=sorted) for side in (1, 0))
    strings = _choose(*(s[::-(-len(s) // SENTENCES) or 1] for s in sides))
    if not strings:
        return base
    counts = Counter(u for d in clean for u in d)
    often = Counter(u for d in toxic for u in d)
    common = [u for u, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if len(u) > 3][:3 * LANDMARKS:3]
    positives = len(strings)
    marks = Landmarks(strings + common)
    gram = marks.kernel(marks.strings).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-3
    nystrom = vectors[:, keep] / np.sqrt(values[keep])

    # units that come near a landmark of toxic sentences decide; of the others a share will do
    vocabulary = sorted(set().union(*toxic, *clean))
    near = marks.nearest(vocabulary, positives, .3)
    at = {u: i for i, u in enumerate(vocabulary)}
    level = near
    rng = np.random.default_rng(7)
    ignored = [u for u in counts if near[at[u]] < .3]
    ignored = sorted(ignored)[::max(1, len(ignored) // 5000)]
    model = base
    for _ in range(4):
        # the witness of a toxic document is its best sentence's best unit
        witness = Counter(max((max(((level[at[u]], u) for u in s)) for s in b))[1] for b, l in zip(bags, y) if l == 1 and b)
        witness = [u for u in witness if counts[u] <= 1 or witness[u] > 3 * counts[u]]
        # units that several toxic documents and no clean one have, near a landmark, are as good
        proven = sorted(u for u in often if often[u] > 1 and not counts[u] and near[at[u]] >= .6)
        witness = sorted({*witness, *proven})
        hard = sorted((u for u in counts if near[at[u]] >= .3 or model.table is not None and level[at[u]] > -.9), key=lambda u: (-level[at[u]], u))[:20_000]
        grown = _variants(witness, rng) + [v for _ in range(3) for v in _variants(proven, rng)]
        rows = witness + grown + hard + ignored
        side = np.array([1.] * (len(witness) + len(grown)) + [-1.] * (len(hard) + len(ignored)))
        # frequent units weigh more; both sides weigh the same
        share = np.concatenate([np.minimum([often[u] + 1 for u in witness], 200), np.full(len(grown), 8.),
                                np.minimum([counts[u] for u in hard], 200), np.full(len(ignored), .2)])
        for s in (1, -1):
            share[side == s] *= len(side) / 2 / max(1e-9, share[side == s].sum())
        w = _svm(marks.kernel(rows) @ nystrom, side, share)
        model = Model(marks.table(nystrom @ w[:-1]), float(w[-1]), 1, 0)
        level = model.decide_units(vocabulary)
        # ties at FLOOR are settled by nearness
        level = level + 1e-6 * near
    # the cut is set on clean documents that the SVM has not seen, and as many toxic ones as there are
    unseen = sorted(set().union(set(), *(u for u, a in zip(units, aside) if a)) - at.keys())
    known = dict(zip(vocabulary, level)) | dict(zip(unseen, model.decide_units(unseen)))
    best = np.array([max((known[u] for u in d), default=FLOOR) for d in units])
    chosen = aside | (y == 1)
    model.slope, model.shift = _calibrate(best[chosen], y[chosen])
    return model


class Scorer:
    """Scores texts; judged words are remembered within bounds, hits for good within a step."""

    def __init__(self, model: Model):
        self.model, self.seen, self.hot = model, set(), {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.model.table is None:
            return np.full(len(texts), self.model.constant)
        sets = [word_set(t or "") for t in texts]
        if len(self.seen) > REMEMBER:
            self.seen, self.hot = set(), {}
        fresh = list(set().union(*sets) - self.seen)
        for places, matrix in unit_matrices(fresh) if fresh else ():
            decisions = self.model.decide(matrix)
            for k in np.flatnonzero(decisions > FLOOR):
                word = fresh[places[k]]
                self.hot[word] = max(self.hot.get(word, FLOOR), float(decisions[k]))
        self.seen.update(fresh)
        hot = self.hot.keys()
        return self.model.probability(np.array([max((self.hot[w] for w in hot & s), default=FLOOR) for s in sets]))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The bounded training sample: labelled rows of the learning folds, chosen by hashed id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold_of(F.col("doc_id"), FOLDS) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).select(F.col("doc_id").alias("_id"), "_toxic")
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = known.where("_toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionAll(
        known.where("_toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids are broadcast
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(
        F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("_id", "text", "_toxic").orderBy("_id", "text").collect()
    return [r.text for r in rows], [int(r._toxic) for r in rows]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample(docs, labels))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts are scored like texts without insults; repeated rows come back repeated; a
    null id counts as held out. Columns other than doc_id and text are not looked at. An empty table
    gives no rows; without both classes among the labels every score is their share of toxic ones.
    """
    scorer = Scorer(model)

    def work(ids, texts):
        return {"doc_id": ids, "score": scorer(texts)}

    scored = map_texts(docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", work)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is below one half, all columns as they came."""
    scorer = Scorer(model)
    schema = docs.schema
    place = schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            for a, b in steps(batch.column(place)):
                part = batch.slice(a, b - a)
                yield part.filter(_mask(scorer(part.column(place).to_pylist()) < 0.5))
        give_back()

    return docs.mapInArrow(run, schema)


def _mask(keep: np.ndarray):
    import pyarrow as pa

    return pa.array(keep)
