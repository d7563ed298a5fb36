"""Running aggregates and state machines over ordered groups of any size.

A plain ``Window.partitionBy(key).orderBy(pos)`` puts a whole group into one task. Here the rows are
laid out once in ranges of (key, position) of about equal size (:func:`lay_out`): small groups lie
inside one range, a large one spans as many as it needs, whatever its position values are. Each
range is then scanned on its own, and what a group's earlier ranges add up to is carried into it.
A group can only be unfinished at the end of its range, so there are fewer carries than ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.stage import materialize

#: The number of a row's range; a table that has it is laid out.
RANGE = "__range"

_MERGE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    # the later of two values that carry their position first, so max is "last non-null"
    "last": (F.max, lambda a, b: F.coalesce(b, a)),
    "next": (F.min, lambda a, b: F.coalesce(b, a)),
}


def lay_out(df: DataFrame, keys: Sequence[str], order: str, ranges: int | None = None) -> DataFrame:
    """The rows in ranges of (keys, order), numbered upwards in ``RANGE`` and written once.

    Scans by these keys, or by finer ones whose groups also lie together in this order, share the
    layout. ``ranges`` asks for so many; else they follow the shuffle settings and the data's size.
    """
    by = [*keys, order]
    ranged = df.repartitionByRange(*by) if ranges is None else df.repartitionByRange(ranges, *by)
    return materialize(ranged.withColumn(RANGE, F.spark_partition_id().cast("long")), "layout")


def _laid(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return df if RANGE in df.columns else lay_out(df, keys, order)


def _carried(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the carry of their group and range; null keys are groups too.

    The carry has fewer rows than there are ranges, so it is sent to all tasks and the rows keep
    their partitioning.
    """
    renamed = carry.select(*[F.col(c).alias(f"__k_{c}") if c in (*keys, RANGE) else F.col(c) for c in carry.columns])
    same = _all([F.col(RANGE) == F.col(f"__k_{RANGE}"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]])
    return rows.join(F.broadcast(renamed), same, "left").drop(*[f"__k_{c}" for c in (*keys, RANGE)])


def ordered_scan(
    df: DataFrame, keys: Sequence[str], order: str, aggs: Mapping[str, tuple[str, Column]], *,
    inclusive: bool = True, reverse: bool = False,
) -> DataFrame:
    """Add one running aggregate per entry of ``aggs`` (name -> (kind, expression)).

    ``order`` is unique within ``keys``. Kinds: sum, max, min, and last/next for values of which a
    later (earlier) one in scan order replaces the former; those need a struct with the position
    first. ``inclusive`` says whether a row sees itself; ``reverse`` runs from the highest position
    down. A table that is not laid out is laid out first.
    """
    laid = _laid(df, keys, order)
    by, by_range = (F.col(c).desc() if reverse else F.col(c).asc() for c in (order, RANGE))
    local = Window.partitionBy(*keys, RANGE).orderBy(by).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*keys).orderBy(by_range).rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy(*keys, RANGE).agg(*[_MERGE[kind][0](value).alias(f"__t_{n}") for n, (kind, value) in aggs.items()])
    carry = totals.select(*keys, RANGE, *[_MERGE[kind][0](f"__t_{n}").over(earlier).alias(f"__c_{n}") for n, (kind, _) in aggs.items()])
    carry = carry.filter(~_all([F.col(f"__c_{n}").isNull() for n in aggs]))
    scanned = laid.select("*", *[_MERGE[kind][0](value).over(local).alias(f"__l_{n}") for n, (kind, value) in aggs.items()])
    merged = [_MERGE[kind][1](F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n) for n, (kind, _) in aggs.items()]
    return _carried(scanned, carry, keys).select(*[F.col(c) for c in df.columns if c not in aggs], *merged)


def ordered_row_number(df: DataFrame, keys: Sequence[str], order: str, name: str, *, reverse: bool = False) -> DataFrame:
    """1-based position of each row within its group, in order of ``order``."""
    return ordered_scan(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, reverse=reverse)


@dataclass(frozen=True)
class Fold:
    """A state machine over the rows of a group, to be run in ranges.

    ``summarize`` says what a range's rows do to any state, as a row of ``steps`` (DDL); ``follow``
    applies such a row to a state; ``replay`` runs rows from a known state and returns the columns of
    ``out`` (DDL) with the state after them. ``state`` is the DDL of a state, ``start`` the first one.
    """

    start: tuple
    state: str
    steps: str
    out: str
    summarize: Callable[[pd.DataFrame], dict]
    follow: Callable[[object, tuple], tuple]
    replay: Callable[[pd.DataFrame, tuple], tuple[dict[str, np.ndarray], tuple]]


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def spanning(laid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The groups that lie in more than one range, found by the ranges' first and last groups."""
    group = F.struct(*keys)
    ends = laid.groupBy(RANGE).agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    each = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("g"))
    return each.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g.*")


def ordered_fold(df: DataFrame, keys: Sequence[str], order: str, fold: Fold, columns: Sequence[str]) -> DataFrame:
    """(keys, order, columns of ``fold.out``): the fold's rows, groups of any size.

    The functions get ``columns`` of the rows in order. Groups that span ranges are summarized range
    by range; the summaries of a group pass through one task, which holds one at a time.
    """
    laid = _laid(df, keys, order).select(*keys, order, RANGE, *columns)
    ddl = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema}
    key_ddl, names, states = ", ".join(ddl[k] for k in keys), [*keys, RANGE], _names(fold.state)
    wide = laid.join(F.broadcast(spanning(laid, keys).select(*[F.col(k).alias(f"__k_{k}") for k in keys])), _all(
        [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]), "left_semi")

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[names].iloc[:1].reset_index(drop=True)
        return head.assign(**{k: [v] for k, v in fold.summarize(pdf.sort_values(order)).items()})

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = fold.start
        for pdf in batches:
            before = []
            for row in pdf.itertuples(index=False):
                if row.starts:
                    state = fold.start
                before.append(state)
                state = fold.follow(row, state)
            yield pdf[names].assign(**{s: [b[i] for b in before] for i, s in enumerate(states)})

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = fold.start
        for pdf in batches:
            if pdf.empty:
                continue
            edges = np.flatnonzero(pdf["starts"].to_numpy())
            edges = [*([0] if not len(edges) or edges[0] else []), *edges.tolist(), len(pdf)]
            entry = pdf[states].to_numpy()
            found: list[dict] = []
            for a, b in zip(edges[:-1], edges[1:]):
                if pdf["starts"].iat[a]:
                    state = tuple(entry[a].tolist())
                out, state = fold.replay(pdf.iloc[a:b], state)
                found.append(out)
            yield pdf[[*keys, order]].assign(**{n: np.concatenate([f[n] for f in found]) for n in _names(fold.out)})

    def marked(rows: DataFrame, group: list[str], by: str) -> DataFrame:
        # groups are told apart by their first rows, as null keys are groups too
        window = Window.partitionBy(*group).orderBy(by)
        return rows.repartition(*group).withColumn("starts", F.row_number().over(window) == 1).sortWithinPartitions(*group, by)

    steps = wide.groupBy(*names).applyInPandas(summarize, f"{key_ddl}, {RANGE} long, {fold.steps}")
    entries = marked(steps, list(keys), RANGE).mapInPandas(compose, f"{key_ddl}, {RANGE} long, {fold.state}")
    known = _carried(laid, entries, keys).select(*laid.columns, *[F.coalesce(s, F.lit(v)).alias(s) for s, v in zip(states, fold.start)])
    return marked(known, names, order).mapInPandas(replay, f"{key_ddl}, {ddl[order]}, {fold.out}")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
