"""Exact top-k inner products: a Voronoi join with bounds from group summaries.

Data vectors go to the nearest pivot. A group's summary (size, radius, largest norm) bounds the
scores any of its members can have with a query: by Cauchy-Schwarz a member's score lies within
norm(query) * radius of the pivot's. The scores of the pivots themselves, which are data, and the
groups' lower bounds give each query a score that k others reach for certain; only groups whose
upper bound comes up to it get the query. Neighbouring groups are solved together, in blocks of
bounded size, so that a query that needs many groups is sent once for each block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.stage import materialize

SCALE = 256
K = 5
#: Pivots: the square root of the number of vectors, within these limits.
LEAST_PIVOTS, MOST_PIVOTS = 16, 1024
#: Vectors of a block, and queries, that one task multiplies.
BLOCK, QUERY_BLOCK = 8192, 8192
#: Vectors that are compared with all pivots, or with a block, at a time; rows of a batch that leaves.
STEP, BATCH = 256, 4096


def whole_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of each component; vectors with null or non-finite ones are left out."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(x.isNotNull() & sound).select(
        "vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows as int64, short ones filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _dense(column, width: int) -> np.ndarray:
    """The same of an Arrow column of lists without nulls."""
    ends = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]], np.diff(ends)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 2 ** 53 else a @ b.T


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors with the number of the nearest pivot, their distance to it and their norm."""
    width = pivots.shape[1]

    def run(batches):
        import pyarrow as pa

        p = pivots.astype(float)
        for batch in (whole.slice(start, STEP) for whole in batches for start in range(0, whole.num_rows, STEP)):
            m = _dense(batch.column(1), width).astype(float)
            cell = ((m * m).sum(1)[:, None] - 2 * m @ p.T + (p * p).sum(1)).argmin(1)
            # the distance itself is taken without cancellation
            far = np.sqrt(((m - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((m * m).sum(1)))],
                                             names=["vec_id", "v", "copies", "cell", "far", "norm"])

    return vectors.select("vec_id", "v", "copies").mapInArrow(run, "vec_id long, v array<long>, copies int, cell int, far double, norm double")


def blocks_of(pivots: np.ndarray, cells: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of each group's block: neighbours, by halves of the widest direction, of up to ``BLOCK`` vectors or one group."""
    blocks, todo, made = np.zeros(len(cells), np.int32), [np.arange(len(cells))], 0
    while todo:
        part = todo.pop()
        if len(part) == 1 or sizes[part].sum() <= BLOCK:
            blocks[part], made = made, made + 1
            continue
        places = pivots[cells[part]].astype(float)
        part = part[np.argsort(places[:, np.ptp(places, 0).argmax()], kind="stable")]
        upto = np.cumsum(sizes[part])
        half = min(max(1, int(np.searchsorted(upto, upto[-1] / 2))), len(part) - 1)
        todo += [part[:half], part[half:]]
    return blocks


def needed(queries: DataFrame, pivots: np.ndarray, pivot_ids: list[int], summary: pd.DataFrame, k: int) -> DataFrame:
    """(query_id, v, copies, block): each query with every block of a group that may hold one of its k best.

    Queries come with ``own``, how many rows of the data have their id: those are no candidates.
    A batch that leaves is bounded, whatever number of blocks its queries need.
    """
    width = pivots.shape[1]
    cells, sizes = summary["cell"].to_numpy(), summary["n"].to_numpy()
    radius, norm = summary["radius"].to_numpy(), summary["norm"].to_numpy()
    ids = np.array(pivot_ids)
    numbers, by_block = np.unique(summary["block"].to_numpy()), np.argsort(summary["block"].to_numpy(), kind="stable")
    firsts = np.searchsorted(summary["block"].to_numpy()[by_block], numbers)

    def run(batches):
        import pyarrow as pa

        for batch in (whole.slice(start, STEP) for whole in batches for start in range(0, whole.num_rows, STEP)):
            m = _dense(batch.column(1), width)
            own = batch.column(0).to_numpy()
            scores = products(m, pivots).astype(float)
            length = np.sqrt((m.astype(float) ** 2).sum(1))[:, None]
            low = scores[:, cells] - length * radius
            # a little more room than rounding takes
            high = np.minimum(scores[:, cells] + length * radius, length * norm) * (1 + 1e-9 * np.sign(scores[:, cells])) + 1e-3
            low -= 1e-3 + 1e-9 * np.abs(low)
            # pivots are vectors with scores of their own
            certain = np.where(ids[None, :] == own[:, None], -np.inf, scores)
            certain = np.sort(certain, 1)[:, ::-1]
            sure = certain[:, k - 1] if certain.shape[1] >= k else np.full(len(m), -np.inf)
            order = np.argsort(-low, 1)
            mine = batch.column(3).to_numpy()
            reached = np.cumsum(sizes[order], 1) >= k + mine[:, None]  # these may be the query's own
            at = np.where(reached.any(1), reached.argmax(1), -1)
            bound = np.where(at >= 0, np.take_along_axis(low, np.take_along_axis(order, np.maximum(at, 0)[:, None], 1), 1)[:, 0], -np.inf)
            take = high >= np.maximum(sure, bound)[:, None]
            rows, chosen = np.nonzero(np.logical_or.reduceat(take[:, by_block], firsts, axis=1))
            for start in range(0, len(rows), BATCH):
                piece = slice(start, start + BATCH)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).take(pa.array(rows[piece])) for i in range(3)), pa.array(numbers[chosen[piece]].astype(np.int32))],
                    names=["query_id", "v", "copies", "block"])

    return queries.select("query_id", "v", "copies", "own").mapInArrow(run, "query_id long, v array<long>, copies int, block int")


def _solve(k: int, width: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids = right["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], _matrix(right["v"].to_numpy()[order], width)
            copies = right["copies"].to_numpy()[order]
            for start in range(0, len(left), STEP):
                part = left.iloc[start:start + STEP]
                scores = products(_matrix(part["v"].to_numpy(), width), m)
                for q, times, row in zip(part["query_id"].to_numpy(), part["copies"].to_numpy(), scores):
                    row = np.where(ids == q, np.iinfo(np.int64).min, row)
                    # ids are sorted, so a stable sort settles ties
                    if len(row) > 4 * k:
                        cut = np.partition(row, len(row) - k)[len(row) - k]
                        best = np.flatnonzero(row >= cut)
                    else:
                        best = np.arange(len(row))
                    best = best[np.argsort(-row[best], kind="stable")][:k]
                    # every copy of the query meets every copy of the candidate
                    out += [(q, ids[i], row[i]) for i in best if ids[i] != q for _ in range(min(k, times * copies[i]))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(table: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best others of each vector whose id ``every`` divides.

    Ties go to the smaller id. Null vectors, null or non-finite components and null ids take no
    part; vectors of unequal length count as filled up with zeros; rows of one id are one another's
    own and never candidates of each other, but to others repeated rows are candidates of their own,
    and a query's rows share its k places; an empty table gives no rows. Other columns are not
    looked at.
    """
    vectors = whole_vectors(table).where("vec_id IS NOT NULL").withColumn("vec_id", F.col("vec_id").cast("long"))
    # equal rows go as one from here on, with their number as far as it can matter
    vectors = materialize(vectors.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies")), "vectors")
    row = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = row[1] or 1
    number = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(row[0] ** 0.5)))
    # at most MOST_PIVOTS rows reach the driver, distinct vectors in the order of a hash
    chosen = vectors.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("v"), "v").limit(number).collect()
    if not chosen:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots, pivot_ids = _matrix([r.v for r in chosen], width), [r.vec_id for r in chosen]
    placed = materialize(assign(vectors, pivots), "placed")
    # a row for each pivot
    summary = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")).toPandas()
    summary["block"] = blocks_of(pivots, summary["cell"].to_numpy(), summary["n"].to_numpy())
    queries = vectors.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    queries = queries.join(queries.groupBy("query_id").agg(F.count("*").alias("own")), "query_id")
    asked = materialize(needed(queries, pivots, pivot_ids, summary, k), "asked")
    # a block goes in as many parts as its vectors, and the queries that want it, take
    wanted = dict(asked.groupBy("block").count().toPandas().itertuples(index=False))
    sizes = summary.groupby("block")["n"].sum()
    shape = vectors.sparkSession.createDataFrame(
        [(int(c), int(b), -(-int(sizes[b]) // BLOCK), -(-int(wanted[b]) // QUERY_BLOCK)) for c, b in zip(summary["cell"], summary["block"]) if b in wanted],
        "cell int, block int, parts int, query_parts int")
    part, query_part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("query_id", "v"), F.col("query_parts")).cast("int")
    data = placed.join(F.broadcast(shape), "cell").select(
        "vec_id", "v", "copies", "block", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"))
    asked = asked.join(F.broadcast(shape.drop("cell").distinct()), "block").select(
        "query_id", "v", "copies", "block", query_part.alias("query_part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    keys = ["block", "part", "query_part"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(_solve(k, width), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
