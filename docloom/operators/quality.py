"""Invariants a database would enforce, as queries that list violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.schemas import (
    BLOCK_KINDS, CHAPTER_ROLES, FILE_STATES, JOB_STATES, TRANSLATION_STATES,
)

OPERATION_STATES = [
    "queued", "uploading", "processing", "downloading", "normalizing", "succeeded", "failed", "cancelled", "status_unknown"]


def one_of(column: str, values: list[str]) -> Column:
    return F.col(column).isin(values)


def table_rules() -> dict[str, dict[str, Column]]:
    """table -> rule -> condition that must hold (null counts as holding, as in SQL CHECK)."""
    role = F.col("role")
    reader = (role == "reader") & (F.col("state") == "ready") & F.col("responding_to").isNull()
    assistant = (role == "assistant") & F.col("responding_to").isNotNull() & F.col("selection").isNull() & F.col("state").isin(
        "queued", "streaming", "ready", "failed", "cancelled")
    return {
        "documents": {"file_state": one_of("file_state", FILE_STATES)},
        "jobs": {"state": one_of("state", [*JOB_STATES, "waiting_remote", "status_unknown"]),
                 "kind": one_of("kind", ["parse", "translate", "prefetch"])},
        "parse_operations": {"state": one_of("state", OPERATION_STATES), "progress": F.col("progress").between(0.0, 1.0)},
        "chapters": {"role": one_of("role", CHAPTER_ROLES), "depth": F.col("depth") >= 1,
                     "pages": (F.col("page_start") >= 1) & (F.col("page_end") >= F.col("page_start"))},
        "blocks": {"kind": one_of("kind", BLOCK_KINDS), "pages": F.col("page") >= 1},
        "translations": {"state": one_of("state", TRANSLATION_STATES)},
        "reading_messages": {"role": one_of("role", ["reader", "assistant"]), "shape": reader | assistant},
        "reading_citations": {"page": F.col("page") >= 1},
    }


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_constraints(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, rule, row_key) of every row breaking a rule; tables: name -> (rows, key column)."""
    out = []
    for name, rules in table_rules().items():
        if name not in tables:
            continue
        rows, key = tables[name]
        broken = F.array_compact(F.array(*[F.when(~cond, F.lit(rule)) for rule, cond in rules.items()]))
        out.append(rows.select(F.lit(name).alias("table"), F.explode(broken).alias("rule"), F.col(key).cast("string").alias("row_key")))
    return _union(out)


# table -> list of (key columns, condition of a partial key or None)
UNIQUE_KEYS: dict[str, list[tuple[list[str], str | None]]] = {
    "documents": [(["sha256"], None)],
    "parse_operations": [(["job_id"], None), (["batch_id"], "batch_id IS NOT NULL")],
    "parse_artifacts": [(["document_id"], "is_active")],
    "chapters": [(["doc_id", "order_index"], None)],
    "blocks": [(["chapter_id", "order_index"], None)],
    "job_events": [(["job_id", "sequence"], None)],
    "translations": [(["block_id", "request_digest"], None), (["block_id"], "is_active")],
    "reading_conversations": [(["document_id"], None)],
    "reading_messages": [(["conversation_id", "sequence"], None),
                         (["conversation_id"], "role = 'assistant' AND state IN ('queued', 'streaming')")],
    "reading_citations": [(["message_id", "order_index"], None)],
}


def check_uniques(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, key, value, copies) of keys held by more than one row."""
    out = []
    for name, keys in UNIQUE_KEYS.items():
        if name not in tables:
            continue
        for columns, condition in keys:
            rows = tables[name] if condition is None else tables[name].filter(condition)
            out.append(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(
                F.lit(name).alias("table"), F.lit(",".join(columns)).alias("key"),
                F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("value"), "copies"))
    return _union(out)


# (child table, column) -> (parent table, column)
REFERENCES = {
    ("jobs", "document_id"): ("documents", "id"),
    ("parse_operations", "document_id"): ("documents", "id"),
    ("parse_operations", "job_id"): ("jobs", "id"),
    ("parse_artifacts", "document_id"): ("documents", "id"),
    ("chapters", "artifact_id"): ("parse_artifacts", "id"),
    ("blocks", "chapter_id"): ("chapters", "chapter_id"),
    ("job_events", "job_id"): ("jobs", "id"),
    ("translations", "block_id"): ("blocks", "block_id"),
    ("translations", "job_id"): ("jobs", "id"),
    ("reading_conversations", "document_id"): ("documents", "id"),
    ("reading_messages", "conversation_id"): ("reading_conversations", "id"),
    ("reading_messages", "responding_to"): ("reading_messages", "id"),
    ("reading_citations", "message_id"): ("reading_messages", "id"),
    ("reading_citations", "block_id"): ("blocks", "block_id"),
}


def check_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, value, rows) of values without a parent. Values are counted first, so a
    missing parent with a billion children is one row in the join."""
    out = []
    for (child, column), (parent, key) in REFERENCES.items():
        if child not in tables or parent not in tables or column not in tables[child].columns:
            continue
        used = tables[child].filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(
            F.count(F.lit(1)).alias("rows"))
        known = tables[parent].select(F.col(key).cast("string").alias("value"))
        out.append(used.join(known, "value", "left_anti").select(
            F.lit(child).alias("table"), F.lit(column).alias("column"), "value", "rows"))
    return _union(out)
