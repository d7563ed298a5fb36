"""Language by error-correcting output codes over character n-grams.

Every language has a codeword; for each bit a linear classifier on hashed n-gram shares tells the
languages with a one from those with a zero. A text's decisions are compared with all codewords:
each bit's loss counts by how well its classifier separated the training texts, and the codeword
with the least total wins. Where the next one is close, the answer is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fold_of, map_texts

FOLDS, HELD_OUT = 4, 2
#: The training sample: about so many texts of a language, chosen by a hash of their id, and the
#: characters one may have; no more than so many texts in all.
SAMPLE_TEXTS, SAMPLE_CHARS, SAMPLE_ALL = 400, 20_000, 3000
#: The languages that can be learned: those with most texts.
LANGUAGES = 256
BUCKETS = 4096
ORDERS = (1, 2, 3)
#: Below this probability an answer is ambiguous.
AMBIGUOUS = 0.7
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code points to themselves if letters, else 0; letters go by str.isalpha."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def shares(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the shares of hashed n-grams of each text, and whether it has a letter.

    Texts are lower-cased, runs of anything but letters are one blank; grams do not reach over it.
    """
    out, has = np.zeros((len(texts), BUCKETS), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        points = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")].astype(np.uint64)
        has[i] = bool(points.any())
        if not has[i]:
            continue
        points = np.concatenate(([np.uint64(0)], points, [np.uint64(0)]))
        # a blank after a blank goes
        points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
        counts = np.zeros(BUCKETS)
        for n in ORDERS:
            code, inner = np.zeros(max(0, len(points) - n + 1), np.uint64), np.ones(max(0, len(points) - n + 1), bool)
            for k in range(n):
                part = points[k:len(points) - n + 1 + k]
                code = code * np.uint64(0x10FFFF) + part
                if 0 < k < n - 1 or n == 1:
                    inner &= part != 0
            code = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
            counts += np.bincount(code[inner].astype(np.int64), minlength=BUCKETS)
        out[i] = np.sqrt(counts / max(1, counts.sum()))
    return out, has


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1 with large distances: all splits up to five, else the best of seeded draws."""
    if n <= 5:
        rows = [[1 if c >> (n - 1 - i) & 1 else -1 for c in range(2 ** (n - 1), 2 ** n - 1)] for i in range(n)]
        return np.array(rows, float).reshape(n, -1)
    rng, best = np.random.default_rng(11), (-1, None)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = ((code[:, None, :] != code[None, :, :]).sum(2) + np.eye(n) * 10 ** 6).min()
        if apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets + 1 by bits
    trust: np.ndarray  # of each bit
    sharpness: float

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest codeword and its probability."""
        if len(self.languages) == 1:
            return np.zeros(len(features), np.int64), np.ones(len(features))
        margin = features @ self.weights[:-1] + self.weights[-1]
        loss = (np.maximum(0, 1 - margin[:, None, :] * self.code[None]) * self.trust).sum(2)
        chance = np.exp(-self.sharpness * (loss - loss.min(1)[:, None]))
        chance /= chance.sum(1)[:, None]
        best = loss.argmin(1)
        return best, chance[np.arange(len(best)), best]


def train(texts: list[str], labels: list[str]) -> Model | None:
    """Least-squares classifiers of all bits at once; None without a label."""
    languages = sorted(set(labels))
    if not languages:
        return None
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((0, 0)), np.zeros(0), 1.0)
    y = np.array([languages.index(l) for l in labels])
    x = shares(texts)[0].astype(float)
    x = np.hstack([x, np.ones((len(x), 1))])
    # languages weigh the same however many texts they have
    scale = np.sqrt(len(y) / len(languages) / np.bincount(y)[y])[:, None]
    xs = x * scale
    kernel = xs @ xs.T
    weights = xs.T @ np.linalg.solve(kernel + 0.02 * np.eye(len(x)), code[y] * scale)
    right = ((x @ weights) * code[y] > 0).mean(0)
    trust = np.maximum(1e-3, 2 * right - 1)
    return Model(languages, code, weights.astype(np.float32), trust / trust.mean(), 4.0)


def fit(docs: DataFrame) -> Model | None:
    """Learn from texts and non-null languages outside the held-out fold, a bounded sample of each."""
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(
        fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).where(F.length("text").between(1, SAMPLE_CHARS))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    most = min(SAMPLE_TEXTS, 2 * SAMPLE_ALL / len(counts))
    # a language keeps the share of its texts that the sample needs; shares are a literal, so texts stay where they are
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, most / r["count"]))])[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = known.select("doc_id", F.struct("text", "lang").alias("r"), (place / share).alias("rank")).where("rank < 1")
    # one row of an id, however often it is repeated
    rows = chosen.groupBy("doc_id").agg(F.min("r").alias("r"), F.min("rank").alias("rank")).orderBy("rank", "doc_id").limit(SAMPLE_ALL).select("r.*").collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything where
    nothing could be learned; repeated rows and null ids (in fold 0) come back as they came in; an
    empty table gives no rows. Only doc_id and text are looked at.
    """
    def work(ids, texts):
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if model is not None:
            for at in range(0, len(texts), 256):
                features, has = shares(texts[at:at + 256])
                best, chance = model.decode(features)
                names[at:at + 256] = np.where(has, np.array(model.languages, object)[best], UNKNOWN)
                score[at:at + 256] = np.where(has, chance, 0)
        return {"doc_id": ids, "lang_pred": names.tolist(), "score": score, "ambiguous": score < AMBIGUOUS}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean", work).select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")
