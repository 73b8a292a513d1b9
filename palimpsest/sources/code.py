"""Symbols, calls and imports of source files of all languages that have a reader, as table functions over (file_path, language, content)."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .braces import read_go, read_script
from .python import read_python
from .symbols import CALLS, IMPORTS, SYMBOLS, Symbol

READERS = {"python": read_python, "javascript": read_script, "typescript": read_script, "go": read_go}
_STRUCT = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in SYMBOLS.replace("\n", " ").split(",") if c.split()[0] not in ("file_path", "error"))
PARSED = f"file_path string, language string, symbols array<struct<{_STRUCT}>>, calls array<struct<caller_name: string, callee_name: string>>, imports array<string>, error string"


def parsed(files: DataFrame) -> DataFrame:
    """One row a file, read once: (file_path, language, symbols, calls, imports, error).

    Without a language column all files are Python. Files of languages without a reader, and empty and null ones, have none of all; a file that
    can't be read has none but the error. Files are dealt out by their paths before they are read: parsing takes so much longer than reading
    that the few partitions of a small input would leave most cores idle.
    """
    language = "language" if "language" in files.columns else F.lit("python").alias("language")

    def one(path: str | None, language: str | None, text: str | None) -> tuple:
        try:
            return (*(READERS[language](path or "", text) if language in READERS and text else ([], [], [])), None)
        except (SyntaxError, ValueError, RecursionError) as e:
            return [], [], [], str(e) or type(e).__name__

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(PARSED))

    def listed(found: list[list], kind: pa.ListType, value) -> pa.Array:
        """A list column, made of the columns of its values."""
        rows, inner = [value(x) for xs in found for x in xs], kind.value_type
        if pa.types.is_struct(inner):
            columns = zip(*rows, strict=True) if rows else [()] * inner.num_fields
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, inner, strict=True)], fields=list(inner))
        else:
            values = pa.array(rows, inner)
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), values, type=kind)

    def run(batches):
        values = (lambda s: s[1:-1], lambda c: c[1:], lambda m: m[1])
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                *found, errors = zip(*(one(*r) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)), strict=True)
                lists = [listed(x, schema.field(2 + j).type, values[j]) for j, x in enumerate(found)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema.field(0).type), part.column(1).cast(schema.field(1).type), *lists, pa.array(errors, schema.field(5).type)], schema=schema)

    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return files.select("file_path", language, "content").repartition(n, "file_path").mapInArrow(run, PARSED)


def symbols_of(rows: DataFrame) -> DataFrame:
    """SYMBOLS of rows of ``parsed``; a file that can't be read is one row with the error."""
    inner = rows.select("file_path", F.explode("symbols").alias("s"), F.lit(None).cast("string").alias("error"))
    names = [n for n in Symbol._fields if n not in ("file_path", "error")]
    good = inner.select("file_path", *[F.col(f"s.{n}").alias(n) for n in names], "error")
    kinds = dict(good.dtypes)
    bad = rows.where("error IS NOT NULL").select("file_path", *[F.lit(None).cast(kinds[n]).alias(n) for n in names], "error")
    return good.union(bad)


def calls_of(rows: DataFrame) -> DataFrame:
    """CALLS of rows of ``parsed``."""
    return rows.select(F.col("file_path").alias("caller_file"), F.explode("calls").alias("c")).select("caller_file", "c.caller_name", "c.callee_name")


def imports_of(rows: DataFrame) -> DataFrame:
    """IMPORTS of rows of ``parsed``."""
    return rows.select(F.col("file_path").alias("importer_file"), F.explode("imports").alias("module"))


def parse(files: DataFrame, what: str = "symbols") -> DataFrame:
    """``symbols``, ``calls`` or ``imports`` of (file_path, content) rows, which may have a language. Who needs several of them stores ``parsed``."""
    return {"symbols": symbols_of, "calls": calls_of, "imports": imports_of}[what](parsed(files))


__all__ = ["CALLS", "IMPORTS", "PARSED", "SYMBOLS", "calls_of", "imports_of", "parse", "parsed", "symbols_of"]
