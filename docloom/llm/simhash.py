"""Near-duplicate documents by SimHash fingerprints, pigeonhole blocks and Hamming checks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.llm.common import free_name, map_texts, words_of
from docloom.llm.components import components

SEED = 42
SHINGLE = 3
#: Fingerprints linked at so many differing bits or fewer.
DISTANCE = 3
#: Blocks that the free bits are cut into; at distance 3 at least BLOCKS - 3 of them agree.
BLOCKS = 6
#: A bucket with more members is cut again by its free bits. After the last level a bucket has
#: eight free bits, hence never more than 256 members.
BUCKET = 256
LEVELS = 3
#: Shingles turned into bits at a time.
SLICE = 1 << 15


def fingerprint(text: str | None) -> int:
    """64 bits, each set where over half of the 3-word shingles' XXH64 values have it set."""
    words = [w.lower() for w in words_of(text)]  # bytes.lower() changes A-Z only
    if not words:
        return 0
    flat, k, digest = b" ".join(words), min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        to = min(n, at + SLICE)
        values = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(
            starts[at:to].tolist(), ends[at + k - 1:to + k - 1].tolist())), "<u8", to - at)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int32)
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fingerprints of whole texts as signed longs; a text without words has 0."""

    def work(ids, texts):
        values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return {key: ids, "fp": values}

    return map_texts(docs, f"{key} {docs.schema[key].dataType.simpleString()}, fp bigint", work, key, text)


def _blocks(mask: int) -> list[int]:
    """The set bits of a mask, cut into BLOCKS runs of nearly equal length."""
    bits = [i for i in range(64) if mask >> i & 1]
    cuts = [round(len(bits) * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _masks(spark: SparkSession) -> Iterator[DataFrame]:
    """For each level (parent, id, mask): which bits must agree. 20, 400 and 8,000 rows, fixed."""
    full, parents = (1 << 64) - 1, [(-1, 0)]
    for _ in range(LEVELS):
        rows = []
        for parent, agreed in parents:
            for chosen in combinations(_blocks(full & ~agreed), BLOCKS - DISTANCE):
                rows.append((parent, len(rows), agreed | sum(chosen)))
        signed = [(p, i, int(np.uint64(m).astype(np.int64))) for p, i, m in rows]
        yield spark.createDataFrame(signed, "parent int, id int, mask bigint")
        parents = [(i, m) for _, i, m in rows]


def close_pairs(fps: DataFrame) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints that differ in 1 to DISTANCE bits, a < b.

    Pairs share a bucket of agreeing blocks; a bucket with too many members is cut again by the
    same rule over its free bits, so no pair is lost and no bucket is unbounded. The join verifies
    the distance itself: only links come out of it.
    """
    spark = fps.sparkSession
    rows = fps.select(F.col("fp").cast("long").alias("fp"), F.lit(-1).alias("parent")).distinct()
    found = None
    for level, masks in enumerate(_masks(spark)):
        placed = rows.join(F.broadcast(masks), "parent").select(
            "id", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp").distinct()
        sizes = placed.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = materialize(placed.join(sizes, ["id", "key"]), f"blocks{level}")
        last = level == LEVELS - 1
        small = shared if last else shared.where(F.col("n") <= BUCKET)
        left, right = small.select("id", "key", F.col("fp").alias("a")), small.select("id", "key", F.col("fp").alias("b"))
        near = left.join(right, ["id", "key"]).where(
            (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
        found = near if found is None else found.unionByName(near)
        if last:
            break
        crowded = shared.where(F.col("n") > BUCKET).select("fp", F.col("id").alias("parent"))
        if crowded.isEmpty():
            break
        rows = crowded.distinct()
    return found.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    component_id is the smallest key reachable over links, its own included. Repeated rows come
    back as often as they came in; null and empty texts share fingerprint zero and are one group;
    a null key takes part, but is never a component_id unless its whole group has no key. An empty
    table gives no rows. Other columns of ``docs`` are ignored.
    """
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min(key).alias("first"))
    firsts = materialize(firsts, "firsts")
    roots = components(close_pairs(firsts.select("fp")))
    roots = materialize(firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "roots")
    groups = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each group the one with the smallest key.

    A document is a key with a text: other texts of a key are documents of their own, and of several
    in one group the one with the smallest digest stays. Repeated rows of the kept document stay one
    row each. Rows without a key are kept where their group has keys; of a group without any, one
    row stays.
    """
    name = free_name(docs, "ident")
    missing, mark = F.col(f"{name}.missing"), F.col(f"{name}.mark")
    # in this order a row with a key comes before those without
    named = docs.withColumn(name, F.struct(
        F.col(key).isNull().alias("missing"), F.col(key).alias("id"), F.coalesce(F.md5(F.col(text)), F.lit("")).alias("mark")))
    found = materialize(near_duplicates(named, name, text).select(
        name, F.col(name).eqNullSafe(F.col("component_id")).alias("first"), F.col("component_id.missing").alias("keyless")).distinct(), "found")
    gone = found.where(~F.col("first") & (~missing | F.col("keyless"))).select(
        F.col(f"{name}.id").alias("gone_id"), mark.alias("gone_mark"))
    gone = gone.select(F.struct("*").alias(f"_{name}"))
    kept = named.join(gone, F.col(f"{name}.id").eqNullSafe(F.col(f"_{name}.gone_id")) & (mark == F.col(f"_{name}.gone_mark")), "left_anti")
    alone = found.where(F.col("first") & F.col("keyless")).select(F.struct(mark.alias("mark")).alias(f"_{name}"))
    if not alone.isEmpty():
        same = missing & (mark == F.col(f"_{name}.mark"))
        # copies of one text without a key
        one = kept.join(alone, same, "left_semi").dropDuplicates([name])
        kept = kept.join(alone, same, "left_anti").unionByName(one)
    return kept.select(*docs.columns)
