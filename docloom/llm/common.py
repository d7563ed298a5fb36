"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, the same everywhere: runs of anything but these six ASCII characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Texts handed to one vectorised step are gathered up to this many characters; a longer text is
#: a step of its own, so that memory follows the longest document and not the Arrow batch.
STEP_CHARS = 1_000_000


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; ``bytes.split`` cuts at exactly the six characters of :data:`SPACES`."""
    return [] if text is None else text.encode("utf-8", "replace").split()


def native_words(text: Column) -> Column:
    """Words as a native array expression: null and blank texts have none."""
    clean = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " +"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo: the split of labelled rows. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to be none of the table's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def steps(texts: pa.ChunkedArray | pa.Array, most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each."""
    start = total = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a schema; to be called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def give_back() -> None:
    """Return freed Arrow memory to the system: Python workers outlive the stage that filled them."""
    pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, schema: str, work: Callable[[list, list], dict], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply ``work(ids, texts) -> columns`` to whole texts, in steps of bounded size.

    ``work`` gets Python lists and returns a dict of columns that Arrow can take; the number of
    rows it returns is free.
    """
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch.column(1)):
                out = work(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in wanted], schema=wanted)
        give_back()

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def spans_to_mask(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in [start, start + length) of any start."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, n), -1)
    return np.cumsum(delta[:n]) > 0
