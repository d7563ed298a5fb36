"""Digests over ordered rows of a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_digest(
    df: DataFrame, keys: Sequence[str], order: str, part: Column, lead: Column | None, name: str,
) -> DataFrame:
    """sha256 over ``lead`` and then the binary ``part`` of every row in order.

    A digest is one running value, so a group's rows pass through one task; they pass sorted and a
    batch at a time, and nothing but the running digest is held, whatever the group's size.
    """
    rows = df.select(
        *keys, F.col(order).alias("__o"), part.alias("__p"),
        (F.lit(None).cast("binary") if lead is None else lead).alias("__lead"),
    ).repartition(*keys).sortWithinPartitions(*keys, "__o").select(*keys, "__lead", "__p")
    width = len(keys)
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running = None, None
        for batch in batches:
            done: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns]
            for *key, head, piece in zip(*columns):
                if running is None or key != last:
                    if running is not None:
                        done.append((*last, running.hexdigest()))
                    last, running = key, hashlib.sha256(head or b"")
                running.update(piece or b"")
            yield table(done, batch.schema)
        if running is not None:
            yield table([(*last, running.hexdigest())], batch.schema)

    def table(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        fields = [schema.field(i) for i in range(width)] + [pa.field(name, pa.string())]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in done], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))

    return rows.mapInArrow(run, f"{kinds}, {name} string")
