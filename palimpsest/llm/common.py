"""What several operators share: text columns, stage tables on shared storage, checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace as Workspace

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A broadcast table may hold this many rows and bytes at most; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 * 1024 * 1024

#: Short rows that a task stores.
PART_ROWS = 500_000

#: What a Python worker gets at a time, in bytes; Spark's own bound lets a few long rows fill its memory.
BATCH_BYTES = 4 * 1024 * 1024


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does the same to pure ASCII text, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, text, *keep): operators see these columns only, so that other columns can't clash with theirs.

    From here on the session gives Python workers ``batch_bytes`` at a time.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c] for c in keep])


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a stored table for broadcast if it has at most ``rows`` rows of ``size`` bytes together, else leaves the join to a shuffle."""
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    # strings and arrays count as they are, all other columns as a word
    each = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c)) if kind.startswith(("array", "map", "struct")) else F.col(c)), F.lit(0)) for c, kind in df.dtypes if c in wide), F.lit(16 * len(df.columns)))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(each), F.lit(0)).alias("bytes")).head()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= size else df


def few_parts(df: DataFrame, rows: int) -> DataFrame:
    """The table in no more partitions than ``rows`` rows need, which it has at most: else a small table costs a task and a file for each partition of a shuffle."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function, after which a Python worker gives the memory it freed back to the machine: it lives on for other tasks."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
                trim(0)

    return out
