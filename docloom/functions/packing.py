"""Next-fit packing of ordered items per group, exact for groups of any size.

Rows are laid out in ranges of group and order. Groups inside a range are packed in one streaming
pass; for one that spans ranges, three steps hold no more than a range in a task:

1. Per range: how a batch left open by the range before ends here. The first item that no
   longer fits is one of the first few, at most as many as a batch has; from that item on
   everything is fixed.
2. Per group: these tables are applied one after the other (one row per range).
3. Per range: packing with the now known open size and batch number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.scan import Fold, lay_out, ordered_fold


def pack_run(weights: np.ndarray, cap: int, used: int, batch: int) -> tuple[np.ndarray, int, int]:
    """Batch number per item (-1 = does not fit alone), units open at the end, last number.

    ``batch`` is the number of the open batch, or of the last one closed when ``used`` is 0.
    """
    out = np.empty(len(weights), dtype=np.int64)
    at, size = 0, len(weights)
    ends = np.cumsum(weights)
    while at < size:
        base = int(ends[at - 1]) if at else 0
        # items that still join the open batch
        stop = int(np.searchsorted(ends, base + cap - used, side="right"))
        stop = max(stop, at)
        if stop > at:
            if used == 0:
                batch += 1
            out[at:stop] = batch
            used += int(ends[stop - 1]) - base
            at = stop
            if at == size:
                break
        if weights[at] > cap:
            out[at] = -1
            at += 1
        used = 0
    return out, used, batch


def chunk_steps(weights: np.ndarray, cap: int) -> dict:
    """What a range does to the batch left open before it.

    With ``u`` units open, the first item that no longer fits is ``b = first(ends > cap - u)``;
    from there on the range is packed afresh. ``ends`` stops at the first value above ``cap``,
    so it has at most one entry more than a batch has items.
    """
    ends = np.cumsum(weights)
    reach = min(int(np.searchsorted(ends, cap, side="right")) + 1, len(weights))
    tails = [pack_run(weights[b:], cap, 0, 0)[1:] for b in range(reach)]
    return {"total": int(ends[-1]), "whole": bool(ends[-1] <= cap), "ends": ends[:reach].tolist(),
            "exits": [t[0] for t in tails], "counts": [t[1] for t in tails]}


def apply_steps(step, cap: int, used: int, number: int) -> tuple[int, int]:
    """Open size and batch number after a range, given those before it."""
    if used == 0:
        return int(step.exits[0]), number + int(step.counts[0])
    b = int(np.searchsorted(np.asarray(step.ends), cap - used, side="right"))
    if step.whole and used + step.total <= cap:
        return used + int(step.total), number
    return int(step.exits[b]), number + int(step.counts[b])


def next_fit(df: DataFrame, keys: Sequence[str], order: str, weight: str, cap: int, ranges: int | None = None) -> DataFrame:
    """Adds ``batch`` (0-based per group; null for an item above ``cap`` on its own).

    An item that does not fit closes the open batch and starts the next; an item too large by
    itself closes it too and starts none.
    """
    slim = df.select(*keys, order, F.col(weight).cast("long").alias("__w"))

    def replay(pdf: pd.DataFrame, state: tuple) -> tuple[dict[str, np.ndarray], tuple]:
        out, used, number = pack_run(pdf["__w"].to_numpy(), cap, *state)
        return {"__b": out}, (used, number)

    fold = Fold(
        start=(0, -1), state="__used long, __number long", steps="total long, whole boolean, ends array<long>, exits array<long>, counts array<long>",
        out="__b long", summarize=lambda pdf: chunk_steps(pdf["__w"].to_numpy(), cap), follow=lambda row, state: apply_steps(row, cap, *state), replay=replay)
    numbered = ordered_fold(lay_out(slim, keys, order, ranges), keys, order, fold, ["__w"]).select(
        *keys, order, F.when(F.col("__b") >= 0, F.col("__b")).alias("batch"))
    # the numbers are the small side, so the rows need not be sorted to meet them
    return df.join(numbered.hint("shuffle_hash"), [*keys, order])
