"""Packing tokenized documents into sequences: best fit decreasing, certified by lower bounds."""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.llm.common import map_texts

CAPACITY = 4096
END = 1
#: Pieces that one packing task gets, on average.
PART = 4096
#: Times that groups exchange what lies in unfilled sequences, unless nothing is gained before.
ROUNDS = 3
#: Words a worker remembers the ids of; the half that was used most stays when there are more.
REMEMBER = 250_000
#: Words handed to the tokenizer as one text, and what stands between them.
JOINED, MARK = 500, "~"


class WordIds:
    """Ids of words by the tokenizer, remembered within bounds.

    The tokenizer's normal form drops white space and cuts at it, so a text's ids are those of its
    words one after the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark, = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        # place 0 is the mark of a document's end, place 1 the empty word
        self.words, self.place = ["", ""], {"": 1}
        self.flat, self.start, self.length = np.array([END], np.uint32), np.array([0, 1]), np.array([1, 0])
        self.uses = np.zeros(2, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words and how many each has; words that have MARK inside come last.

        Words go to the tokenizer many at a time, with MARK between them, which is a token of its
        own between blanks; words that have MARK inside go alone.
        """
        plain = sum(MARK not in w for w in words)
        lengths, parts, found = np.zeros(len(words), np.int64), [], []
        texts = [f" {MARK} ".join(words[at:min(at + JOINED, plain)]) for at in range(0, plain, JOINED)]
        for code in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(code.ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            found.append(np.diff(cut, prepend=-1, append=len(ids)) - 1)
            parts.append(ids[ids != self.mark])
        lengths[:plain] = np.concatenate(found) if found else 0
        for i, code in enumerate(self.tokenizer.encode_batch_fast(words[plain:], add_special_tokens=False), plain):
            lengths[i] = len(code.ids)
            parts.append(np.array(code.ids, np.uint32))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), lengths

    def _forget(self) -> None:
        """Keep the half that was used most, with half their uses, so that old ones fade."""
        stay = np.sort(np.concatenate(([0, 1], 2 + np.argsort(-self.uses[2:], kind="stable")[:REMEMBER // 2])))
        start, length = self.start[stay], self.length[stay]
        begins = np.cumsum(length) - length
        self.flat = self.flat[np.arange(int(length.sum())) + np.repeat(start - begins, length)]
        self.start, self.length, self.uses = begins, length, self.uses[stay] >> 1
        self.words = [self.words[i] for i in stay.tolist()]
        self.place = {w: i for i, w in enumerate(self.words) if i}

    def _learn(self, fresh: list[str]) -> None:
        fresh = [w for w in fresh if MARK not in w] + [w for w in fresh if MARK in w]
        ids, lengths = self._encoded(fresh)
        self.place.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh))))
        self.words += fresh
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])
        self.flat = np.concatenate([self.flat, ids])

    def _find(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def places(self, words: list[str]) -> np.ndarray:
        """Where different words are remembered, learned if they are not."""
        at = self._find(words)
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.words) + len(new) > REMEMBER:
            self._forget()
            at = self._find(words)
            new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            self._learn(fresh)
            at[new] = self._find(fresh)
        self.uses[at] += 1
        return at

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each followed by END, and where each text's ids end."""
        words, counts = _words(texts)
        at = np.append(self.places(words.dictionary.to_numpy(zero_copy_only=False).tolist()), 0)
        start, length = self.start[at], self.length[at]
        begins = np.cumsum(length) - length
        flat = self.flat[np.arange(int(length.sum())) + np.repeat(start - begins, length)]
        # the step's different words as lists of ids, the last one being the mark of the end
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(flat)), pa.int32()), pa.array(flat))
        ends = np.cumsum(counts + 1)
        codes = np.full(int(ends[-1]) if len(ends) else 0, len(at) - 1, np.int32)
        inside = np.ones(len(codes), bool)
        inside[ends - 1] = False
        codes[inside] = words.indices.to_numpy()
        taken = lists.take(pa.array(codes))
        return taken.flatten().to_numpy(), taken.offsets.to_numpy()[ends].astype(np.int64)


#: A full stop or comma after a letter or digit and before a blank is a token of its own anyway.
_FINAL = r"([a-z0-9])([.,])([ \n]|$)"


def _words(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of all texts and how many each has; the edges of a text may give empty ones.

    A-Z are lower-cased, as the tokenizer does itself, but where its special tokens may stand; final
    stops and commas stand apart, so that there are fewer different words.
    """
    raw = pa.array(texts, pa.string()).fill_null("")
    low = pc.if_else(pc.match_substring(raw, "<|"), raw, pc.ascii_lower(raw))
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _FINAL, r"\1 \2\3"))
    return split.flatten().dictionary_encode(), np.diff(split.offsets.to_numpy())


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as ids, cut only above ``capacity``."""

    def work(ids, texts):
        flat, ends = word_ids(path)(texts)
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        begin = 0
        for doc, end in zip(ids, ends.tolist()):
            for n, at in enumerate(range(begin, end, capacity)):
                part = flat[at:min(end, at + capacity)]
                for k, v in zip(out, (doc, n, at - begin, len(part), zlib.crc32(part.astype("<u4").tobytes()))):
                    out[k].append(v)
            begin = end
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", work)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length by best fit decreasing, and each bin's fill.

    Open bins lie on stacks by free room; an integer's bits say which rooms occur, so the tightest
    one that is wide enough is its lowest set bit from there on.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: dict[int, list[int]] = {}
    rooms, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        wide = rooms >> n
        if wide:
            room = (wide & -wide).bit_length() - 1 + n
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            stacks.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the best of the dual feasible functions' bounds.

    For a threshold e, lengths above capacity - e count 1, those below e count 0, the others their
    share; for a number k, lengths count in steps of 1/k, rounded down (multiples of 1/(k + 1)
    stay), which favours lengths just above a fraction of the capacity.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """The bound from the number of pieces of each length."""
    if not counts.any():
        return 0
    number, mass = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = mass[capacity - e] - np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    best = int((large + -(-middle // capacity)).max())
    sizes = np.flatnonzero(counts)
    for k in range(1, 41):
        whole, rest = np.divmod((k + 1) * sizes, capacity)
        # in units of 1 / (k * capacity), to stay with whole numbers
        value = np.where(rest == 0, k * sizes, capacity * whole)
        best = max(best, -(-int((value * counts[sizes]).sum()) // (k * capacity)))
    return best


def _packed(rows: DataFrame, tag: int) -> DataFrame:
    """Pack every group of ``part`` on its own and mark what it may exchange with others."""
    columns = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema += ", sequence_id long, offset long, loose boolean"

    def run(group: pa.Table) -> pa.Table:
        group = group.select(columns).sort_by([(c, "ascending") for c in ("length", "ids_crc32", "doc_id", "piece")])
        lengths = group["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths)
        first = (tag << 56) + (group["part"][0].as_py() << 24)
        gap = len(fill) - lower_bound(lengths)
        # what may be exchanged: all unfilled sequences of a group with a gap, else the emptiest one
        loose = (fill < CAPACITY) & ((gap > 0) | (np.arange(len(fill)) == fill.argmin()))
        for name, values in (("sequence_id", first + bins), ("offset", offsets), ("loose", loose[bins])):
            group = group.append_column(name, pa.array(values))
        return group

    return rows.groupBy("part").applyInArrow(run, schema)


def _parts(n: int) -> int:
    return max(1, -(-n // PART))


def pack(found: DataFrame) -> DataFrame:
    """Pieces with sequence_id and offset.

    Pieces are dealt into groups of bounded size by a hash of what they are and of their row, so that
    repeated rows spread; each is packed by best fit decreasing and compared with a bound that no
    packing can beat. Groups with a gap give up their unfilled sequences, the others their emptiest
    one; those pieces are dealt anew and packed again, and the result counts if it takes fewer
    sequences. Only numbers of rows and sequences reach the driver.
    """
    found = materialize(found, "pieces")
    dealt = found.withColumn("part", F.pmod(F.xxhash64(
        "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(_parts(found.count()))).cast("long"))
    done = materialize(_packed(dealt, 0), "packed")
    for turn in range(1, ROUNDS + 1):
        loose = done.where("loose")
        row = loose.agg(F.count("*"), F.count_distinct("sequence_id"), F.count_distinct("part")).first()
        if row[2] < 2:
            break
        again = loose.select(*found.columns).withColumn("part", F.pmod(
            F.xxhash64(F.lit(turn), "ids_crc32", "doc_id", "piece", F.monotonically_increasing_id()), F.lit(_parts(row[0]))).cast("long"))
        again = materialize(_packed(again, turn), "repacked")
        if again.select("sequence_id").distinct().count() >= row[1]:
            break
        done = materialize(done.where("NOT loose").unionByName(again), "packed")
    return done


def least_sequences(pieces: DataFrame) -> int:
    """The bound of the whole table, from its numbers of pieces by length."""
    rows = pieces.groupBy("length").count().collect()
    counts = np.zeros(CAPACITY + 1, np.int64)
    for r in rows:
        counts[r["length"]] += r["count"]
    return bound_of(counts, CAPACITY)


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A null or empty text is the end mark alone; repeated rows are packed as often as they come, a
    null id like any other; an empty table gives no rows. ``path`` is the tokenizer's file, which
    every executor must be able to open. Other columns of ``docs`` are not looked at.
    """
    return pack(pieces(docs, path)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
