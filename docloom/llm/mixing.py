"""Mixing sources to target weights by capped water-filling and seeded repetition; all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.stage import materialize
from docloom.llm.common import native_words

#: Sources in the order of their names' code points, null last, weigh this much, over and over.
WEIGHTS = (1, 2, 3)
#: No source and no document is repeated more often.
EPOCHS = 3.0
SEED = "mix-1"
#: Sums are taken by so many slices of the hash before single documents are looked at, so that a
#: source of any size is spread over as many keys.
SLICES = 4096


def word_count(text: Column) -> Column:
    return F.size(native_words(text)).cast("long")


def _ranked(totals: DataFrame) -> DataFrame:
    """Sources with their rank by name, null last: ranges first, so that no task sees them all."""
    ranges = materialize(totals.repartitionByRange(F.col("source").asc_nulls_last())
                         .withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    offsets = ranges.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ranges.join(offsets, "part").select(
        "source", "source_size", (F.col("offset") + F.row_number().over(within) - 1).alias("rank"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target): all sizes shared by weight, none above its cap.

    Sources over their cap get the cap, the rest is shared again, until none is over: the level
    only rises, so a capped source stays capped. The driver sees two numbers a round.
    """
    ranked = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = materialize(ranked.withColumn("weight", F.element_at(
        F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "ranked")
    cap = F.lit(float(epochs)) * F.col("source_size")
    row = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, rest, weight = row[0] or 0, float(row[0] or 0), row[1] or 0
    while weight:
        share = F.col("weight") * F.lit(rest) / F.lit(float(weight))
        row = ranked.agg(F.coalesce(F.sum(F.when(share > cap, cap)), F.lit(0.0)),
                         F.coalesce(F.sum(F.when(share <= cap, F.col("weight"))), F.lit(0))).first()
        if row[1] == weight:
            return ranked.select("source", "source_size", F.least(share, cap).alias("target"))
        rest, weight = total - row[0], row[1]
    return ranked.select("source", "source_size", cap.alias("target"))


def _placed(rows: DataFrame, key: str) -> DataFrame:
    """Rows (with _id, _source, _size) and their place: a seeded hash of the id and its slice."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8)
    return rows.withColumn("_place", F.conv(digest, 16, 10).cast("long")).withColumn(
        "_slice", F.shiftright("_place", 32 - 12).cast("int"))


def _same_source() -> Column:
    return F.col("_source").eqNullSafe(F.col("source"))


def _cut(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with _whole (copies everyone gets), _extra (words for the fraction) and _more.

    _more goes to documents in the order of their hash for as long as the next one still fits in;
    repeated rows go together.
    """
    joined = _placed(rows, "_id").join(parts, _same_source() & (F.col("_slice") == F.col("slice")))
    joined = joined.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    joined = joined.withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size"))
    through = Window.partitionBy("_source", "_slice").orderBy("_place", "_id", "_size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn("_more", (F.col("_extra") > 0) & (F.col("before") + F.sum("_size").over(through) <= F.col("_extra")))


def plan(sized: DataFrame) -> DataFrame:
    """One row for each source: size, target, the copies everyone gets, the last document in the order
    of hashes that gets one more, and the one document beyond it whose size comes nearest to what is
    then left open. Only ids, sources and sizes are shuffled for it."""
    rows = sized.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"))
    slices = _placed(rows, "_id").groupBy("_source", "_slice").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    parts = materialize(slices.join(targets(sized), _same_source()).select(
        F.col("_source").alias("source"), F.col("_slice").alias("slice"), F.col("_before").alias("before"),
        "source_size", "target"), "shares")
    # a source comes down to its distinct sizes before the open words are looked at
    by_size = materialize(_cut(rows, parts).groupBy("_source", "_size").agg(
        *(F.first(c).alias(c) for c in ("source_size", "target", "_whole", "_extra")),
        F.coalesce(F.sum(F.when(F.col("_more"), F.col("_size"))), F.lit(0)).alias("_taken"),
        F.max(F.when(F.col("_more"), _order())).alias("_last"),
        F.min(F.when(~F.col("_more"), _order())).alias("_first")), "open")
    left = by_size.groupBy("_source").agg(
        *(F.first(c).alias(c) for c in ("source_size", "target", "_whole")),
        (F.first("_extra") - F.sum("_taken")).alias("_open"), F.max("_last").alias("last"))
    left = left.select(F.col("_source").alias("source"), "source_size", "target", F.col("_whole").alias("whole"), "last", "_open")
    off = F.abs(F.col("_open") - F.col("_size"))
    picks = by_size.where("_first IS NOT NULL").select("_source", "_size", "_first").join(
        left.select("source", "_open"), _same_source()).where(off < F.col("_open")).groupBy("_source").agg(
        F.min(F.struct(off.alias("off"), F.col("_first"))).alias("p")).select("_source", F.col("p._first").alias("pick"))
    return materialize(left.join(picks, _same_source(), "left").drop("_source", "_open"), "plan")


def _order() -> Column:
    return F.struct("_place", "_id", "_size")


def decide(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (with _id, _source, _size) with _copies, source_size and target.

    A source's rate is target / size: everyone gets its whole part; for the fraction's words,
    documents get one more in the order of their hash, and one beyond them closes the gap. Rows,
    which may carry texts, meet the one row of their source and are not ordered.
    """
    joined = _placed(rows, "_id").join(sources, _same_source())
    more = F.coalesce(_order() <= F.col("last"), F.lit(False)) | F.coalesce(_order() == F.col("pick"), F.lit(False))
    return joined.withColumn("_copies", (F.col("whole") + more.cast("int")).cast("long"))


def _sized(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    Null and empty texts have size 0 and take 0; the null source is a source of its own; repeated
    rows are separate documents that share a hash, null ids share the hash of the empty id. No rows
    in, no rows out; where all sizes are 0 all targets are. Other columns are not looked at.
    """
    sized = _sized(docs)
    rows = sized.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"))
    return decide(rows, plan(sized)).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, all columns as they came."""
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"),
                       word_count(F.col("text")).alias("_size"))
    taken = decide(rows, plan(_sized(docs))).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM totals),
ordered AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         row_number() OVER w AS n,
         coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
         coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM ranked WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
level AS (
  -- the first source, by size for weight, that its share does not take over its cap sets the level
  SELECT (total - 3 * size_before)::DOUBLE AS rest, (all_weight - weight_before)::DOUBLE AS weight_left
  FROM ordered
  WHERE weight * (total - 3 * size_before)::DOUBLE / (all_weight - weight_before)::DOUBLE <= 3.0 * source_size
  ORDER BY n LIMIT 1),
targets AS (
  SELECT source, source_size,
         coalesce(least(weight * rest / weight_left, 3.0 * source_size), 3.0 * source_size)::DOUBLE AS target
  FROM ranked LEFT JOIN level ON true),
run AS (
  SELECT s.*, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, target - whole * source_size AS extra,
         target - whole * source_size > 0 AND through <= target - whole * source_size AS more
  FROM run),
left_open AS (
  SELECT *, extra - coalesce(sum(size) FILTER (WHERE more) OVER (PARTITION BY source), 0) AS open FROM cut),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY source, more ORDER BY abs(open - size), place, doc_id) = 1
            AND NOT more AND abs(open - size) < open AS pick
  FROM left_open)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN more OR pick THEN 1 ELSE 0 END))::BIGINT AS taken
FROM picked
"""
