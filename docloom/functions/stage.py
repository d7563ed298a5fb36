"""Tables written between two steps of a job, in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from docloom.session import checkpoint_dir


def stage_path(df: DataFrame, name: str) -> str:
    """Write the rows to a new folder of the checkpoint area and return its path."""
    path = f"{checkpoint_dir(df.sparkSession)}/docloom-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet and read them back.

    Used where several consumers would each repeat a costly plan; lost executors only cost
    a re-read, and every consumer prunes its own columns.
    """
    return df.sparkSession.read.schema(df.schema).parquet(stage_path(df, name))

