"""Running streams to files and folding them into stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from docloom.functions.stage import materialize
from docloom.operators.library import upsert_documents, upsert_positions
from docloom.session import checkpoint_dir


#: Keyed state with timers and time to live needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, root: str | None = None, timers: bool = False, idle: int = 3) -> DataFrame:
    """Run a stream over what is there now and return what it has appended.

    A stream with ``timers`` of processing time, or a time to live, always has another batch to run;
    it is stopped once ``idle`` batches in a row took nothing from the source, so that short timers have
    gone off. One will do where nothing but a time to live is waited for.
    """
    spark = stream.sparkSession
    root = root or f"{checkpoint_dir(spark)}/docloom-{uuid.uuid4().hex}"
    out = f"{root}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode("append").format("parquet").option("path", out)
    writer = writer.trigger(processingTime="300 milliseconds") if timers else writer.trigger(availableNow=True)
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    try:
        query = writer.start()
    finally:
        spark.conf.set(STORE[0], before)
    if timers:
        _stop_when_idle(query, idle)
    else:
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stop_when_idle(query: StreamingQuery, batches: int = 3) -> None:
    """Stop after so many batches in a row that took nothing; only progress reports reach the driver.

    A batch of empty files has no rows either, but the source goes on.
    """
    last, idle = -1, 0
    while query.isActive and idle < batches:
        query.awaitTermination(0.2)
        for progress in query.recentProgress:
            if progress["batchId"] > last:
                last = progress["batchId"]
                idle = idle + 1 if all(x["startOffset"] == x["endOffset"] for x in progress["sources"]) else 0
    query.stop()
    if query.exception():
        raise query.exception()


#: Parts of a table that streams are folded into; a micro-batch rewrites those it touches.
PARTS = 16


def fold_stream(
    stream: DataFrame, empty: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], key: str, root: str | None = None,
) -> DataFrame:
    """Apply ``step(rows, batch)`` per micro-batch to the parts of a stored table that the batch touches.

    Rows lie in parts by the hash of ``key``, which the step must not change; a part is overwritten from
    its own rows and the batch's. Steps keep first and last values, so a batch that comes again, after a
    failure in its middle too, changes nothing more.
    """
    spark = stream.sparkSession
    root = root or f"{checkpoint_dir(spark)}/docloom-{uuid.uuid4().hex}"
    table, part = f"{root}/table", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    stored = empty.withColumn("part", part)
    stored.limit(0).write.mode("append").partitionBy("part").parquet(table)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # a few part numbers
        touched = [r[0] for r in batch.select(part.alias("part")).distinct().collect()]
        old = batch.sparkSession.read.schema(stored.schema).parquet(table).filter(F.col("part").isin(touched)).select(*empty.columns)
        new = materialize(step(old, batch).select(*empty.columns).withColumn("part", part), "upserted")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)

    query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(upsert).start()
    query.awaitTermination()
    return spark.read.schema(stored.schema).parquet(table).select(*empty.columns)


def stream_upsert_library(stream: DataFrame, empty: DataFrame, root: str | None = None) -> DataFrame:
    """Imports folded into the library as they come; their times decide, not the order of arrival."""
    return fold_stream(stream, empty, lambda table, batch: upsert_documents(table, batch, by_time=True), "sha256", root)


def stream_upsert_positions(stream: DataFrame, empty: DataFrame, library: DataFrame, root: str | None = None) -> DataFrame:
    """Reading positions folded in as they come; the last valid write wins."""
    return fold_stream(stream, empty, lambda table, batch: upsert_positions(table, batch, library), "document_id", root)
