"""Figures about the work done: latency percentiles, quality rates, progress events at a bounded pace.

Percentiles come from sketches that are plain rows (group, bucket, n): a bucket holds the values
that agree in their leading bits, so adding the counts of two sketches gives the sketch of both
inputs. A day's sketch is written once and rolled up to weeks or models without the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import is_blank
from docloom.operators.translate import markers_kept

# fixed values
PERCENTILES = (50, 75, 95)
#: A sample of more than ten minutes is counted apart, but stays in.
SLOW_MS = 600_000
#: measure -> least share that passes, in thousandths
TRANSLATION_GATES = {"blocks_kept": 1000, "markers_kept": 999, "citations_kept": 1000, "equations_kept": 1000, "targets_not_empty": 990}
ANSWER_GATES = {"answers_cited": 950, "citations_in_context": 1000}
PROGRESS_PER_SECOND = 4

#: Leading bits that a bucket's values share after their first one: a quantile is read at most
#: one part in 2**SKETCH_BITS too low.
SKETCH_BITS = 7


# ---- percentiles -----------------------------------------------------------------------
def bucket_of(value: Column | str, bits: int = SKETCH_BITS) -> Column:
    """Least value of the bucket of a non-negative whole number; below 2**(bits + 1) the number itself."""
    value = F.col(value) if isinstance(value, str) else value
    spare = F.greatest(F.lit(0), F.length(F.bin(value)) - (bits + 1))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketch_samples(samples: DataFrame, by: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """Sketches (by, bucket, n, slow) of samples (by, value_ms).

    Null and negative values are no samples. A group has at most 2**bits * (64 - bits) buckets, whatever
    its number of samples; counts combine before the shuffle, so one hot group is no hot task.
    """
    good = samples.filter("value_ms >= 0")
    return good.groupBy(*by, bucket_of(F.col("value_ms").cast("long"), bits).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value_ms") > SLOW_MS).alias("slow"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups, or of several sketches of the same groups put together by union."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.sum("slow").alias("slow"))


def read_percentiles(sketches: DataFrame, by: list[str], at: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """samples, slow and p<at> per group: the bucket that holds the value of rank ceil(at / 100 * samples)."""
    merged = merge_sketches(sketches, by)
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = merged.withColumn("__upto", upto).withColumn("__all", F.sum("n").over(group))
    return ranked.groupBy(*by).agg(
        F.sum("n").alias("samples"), F.sum("slow").alias("slow"),
        *[F.min(F.when(F.col("__upto") * 100 >= F.col("__all") * p, F.col("bucket"))).alias(f"p{p}") for p in at])


# ---- quality rates ---------------------------------------------------------------------
def _rates(counts: DataFrame, by: list[str], gates: dict[str, int]) -> DataFrame:
    """One row per group and measure from sums good_<measure> and of_<measure>; a measure of nothing passes."""
    entries = F.array(*[F.struct(
        F.lit(m).alias("measure"), F.col(f"good_{m}").alias("good"), F.col(f"of_{m}").alias("total"),
        F.lit(least).cast("long").alias("least")) for m, least in gates.items()])
    flat = counts.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")
    return flat.select(
        *by, "measure", "good", "total", F.when(F.col("total") > 0, F.col("good") / F.col("total")).alias("rate"),
        (F.col("good") * 1000 >= F.col("total") * F.col("least")).alias("passed"))


def _sums(rows: DataFrame, by: list[str], parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """good_<measure> and of_<measure> per group from a pair of numbers per row; null counts as 0."""
    sums = []
    for measure, (good, total) in parts.items():
        sums += [F.coalesce(F.sum(good.cast("long")), F.lit(0).cast("long")).alias(f"good_{measure}"),
                 F.coalesce(F.sum(total.cast("long")), F.lit(0).cast("long")).alias(f"of_{measure}")]
    return rows.groupBy(*by).agg(*sums)


def _markers(kinds: list[str]) -> tuple[Column, Column]:
    """Markers of these kinds whose token stands in the target, and all of them."""
    of_kind = F.filter("markers", lambda m: m["kind"].isin(kinds))
    return F.size(F.filter(of_kind, lambda m: F.col("target").contains(m["token"]))), F.size(of_kind)


def translation_rates(judged: DataFrame, by: list[str]) -> DataFrame:
    """Share of good blocks and markers per group and measure, from ``translate.validate_outputs``.

    ``blocks_kept``: wanted blocks that came back exactly once. The other measures look at those
    that came back: all their markers whole and in order, their citations and their formulas still
    there, a target that is not blank. A group without such a block has rate null and passes.
    """
    code = F.coalesce("code", F.lit(""))
    back = ~code.isin("missing_block", "truncated", "duplicate_block")
    here = back & F.col("target").isNotNull()
    cited, all_cited = _markers(["C"])
    shown, all_shown = _markers(["F"])
    return _rates(_sums(judged, by, {
        "blocks_kept": (back, F.lit(1)),
        "markers_kept": (here & markers_kept(F.col("target"), F.col("markers")), here),
        "citations_kept": (F.when(here, cited), F.when(here, all_cited)),
        "equations_kept": (F.when(here, shown), F.when(here, all_shown)),
        "targets_not_empty": (here & ~is_blank("target"), here)}), by, TRANSLATION_GATES)


def answer_rates(answers: DataFrame, citations: DataFrame, warnings: DataFrame, by: list[str]) -> DataFrame:
    """Share of cited answers and of citations that stay in their context, per group and measure.

    ``answers`` (request_id, by), ``citations`` and ``warnings`` as of
    ``conversation.extract_citations``; repeats and torn markers count for neither side.
    """
    cited = citations.groupBy("request_id").agg(F.count(F.lit(1)).alias("__cited"))
    strayed = warnings.filter("code = 'citation_out_of_context'").groupBy("request_id").agg(F.count(F.lit(1)).alias("__strayed"))
    rows = answers.join(cited, "request_id", "left").join(strayed, "request_id", "left")
    good, bad = F.coalesce("__cited", F.lit(0)), F.coalesce("__strayed", F.lit(0))
    return _rates(_sums(rows, by, {
        "answers_cited": (good > 0, F.lit(1)), "citations_in_context": (good, good + bad)}), by, ANSWER_GATES)


# ---- progress --------------------------------------------------------------------------
def throttle_progress(events: DataFrame, key: str = "job_id", per_second: int = PROGRESS_PER_SECOND, lateness: str = "10 seconds") -> DataFrame:
    """At most ``per_second`` events of a key in any second of event time, as batch and as stream.

    A second has as many slots and the last event of a slot, by (at, seq), is the one that is shown,
    so the newest state is never held back. ``events``: key, at, seq and whatever else they carry;
    rows without a time or key are no events. In a stream a slot comes out once the watermark has
    passed it and its state goes with it. ``per_second`` divides a million.
    """
    slot = F.window("at", f"{1_000_000 // per_second} microseconds")
    rest = [c for c in events.columns if c != key]
    known = events.filter(F.col(key).isNotNull())
    if known.isStreaming:
        known = known.withWatermark("at", lateness)
    last = known.groupBy(key, slot).agg(F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("e"))
    return last.select(key, F.col("window.end").alias("slot_end"), "e.*")
