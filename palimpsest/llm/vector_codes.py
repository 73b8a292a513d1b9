"""Compression of vectors to one byte a part: codebooks by rounds of nearest entries and means, in integers, found within annuli of norms.

Components are whole numbers from the start, so that every machine and every order of sums gives the same codebooks and codes. The
nearest entry of a part is searched in the order of norms: as |‖x‖ - ‖c‖| is never more than the distance of x and c, the
best distance found so far allows only the entries whose norm lies in an interval around the norm of x, its ends included. A
binary search finds that interval, its entries are evaluated exactly from the middle outwards, and it shrinks as the best
distance does. A round leaves one sum and count of each entry a task; the codebooks are all that comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Workspace, checked_broadcast, lean
from .vector_rows import sizes_of

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries on either side of the middle that are evaluated before the interval is searched again.
STEP = 4


def kept(vector: Column) -> Column:
    """Whether a vector is neither null nor holds a null, infinite or undefined component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(column: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """(rows, parts, width of a part) whole components; shorter vectors go on with zeros, components end where squares would overflow."""
    values, start, size = sizes_of(column)
    x = np.zeros((len(size), parts * width))
    row = np.repeat(np.arange(len(size)), size)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(row))]
    most = math.isqrt(2**56 // max(1, width)) // 2
    return np.clip(np.floor(scale * x), -most, most).astype(np.int64).reshape(len(size), parts, width)


class Annuli:
    """The entries of one part in the order of their norms."""

    def __init__(self, entries: np.ndarray):
        norm = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.entries, self.norms = entries[self.order], norm[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of the nearest entry of each row, of the lower index if tied, and how many distances were evaluated."""
        norm, n, evaluated = np.sqrt((x.astype(np.float64) ** 2).sum(1)), len(self.norms), 0
        middle = np.searchsorted(self.norms, norm)
        best = np.full(len(x), np.iinfo(np.int64).max)  # the squared distance times the entries, and the index
        rows, around = np.arange(len(x)), 0
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), n)
        while len(rows):
            reach = np.concatenate([np.arange(around, around + STEP), -1 - np.arange(around, around + STEP)])
            at = middle[rows, None] + reach
            inside = (at >= lo[:, None]) & (at < hi[:, None])
            i, j = np.nonzero(inside)
            entry = at[i, j]
            distance = ((x[rows[i]] - self.entries[entry]) ** 2).sum(1)
            evaluated += len(i)
            found = np.full(at.shape, np.iinfo(np.int64).max)
            found[i, j] = distance * n + self.order[entry]
            best[rows] = np.minimum(best[rows], found.min(1))
            around += STEP
            # nothing found yet: the interval is open
            radius = np.where(best[rows] < np.iinfo(np.int64).max, np.sqrt((best[rows] // n).astype(np.float64)), np.inf)
            radius += 1e-9 * (1 + norm[rows])  # of rounding; more is evaluated, never less
            lo, hi = np.searchsorted(self.norms, norm[rows] - radius), np.searchsorted(self.norms, norm[rows] + radius, side="right")
            more = (middle[rows] - around > lo) | (middle[rows] + around < hi)
            rows, lo, hi = rows[more], lo[more], hi[more]
        return best % n, best // n, evaluated


@dataclass(frozen=True)
class Codebooks:
    """(parts, entries, width) whole components; ``scale`` of them are 1."""

    entries: np.ndarray
    scale: int = SCALE

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def encode(self, vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
        """The columns given, with ``code`` (a byte a part) and ``error`` (squared distances, summed over parts) in place of the vector. Rows as ``kept`` says."""
        parts, _, width = self.entries.shape
        names = [c for c in vectors.columns if c != vector_col]

        def run(batches):
            annuli = [Annuli(e) for e in self.entries]
            for batch in batches:
                x = whole(batch.column(len(names)), width, parts, self.scale)
                found = [a.nearest(x[:, p]) for p, a in enumerate(annuli)]
                codes = np.stack([i for i, _, _ in found], 1).astype(np.uint8)
                columns = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(sum(d for _, d, _ in found), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], [*names, "code", "error"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*names).schema)
        return vectors.where(kept(F.col(vector_col))).select(*names, vector_col).mapInArrow(lean(run), f"{schema}, code binary, error long")

    def decode(self, code: Column) -> Column:
        """The vectors that codes stand for."""
        books = F.lit((self.entries / self.scale).tolist())
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(self.entries) - 1)), lambda p: books[p][F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")]))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks | None:
    """Codebooks of all kept vectors; None without any.

    Vectors are as long as the longest, rounded up to a multiple of ``parts``; shorter ones go on with zeros. The first entries
    are the parts of the vectors with the smallest ids, of equal ids the lesser vectors; rows with a null id are none
    of them. With fewer vectors there are fewer entries (at most 256).
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("vec")).where(kept(F.col("vec")))
    longest = rows.agg(F.max(F.size("vec"))).head()[0]
    width = max(1, math.ceil((longest or 0) / parts))
    named = rows.where("id IS NOT NULL")
    last = named.select("id").orderBy("id").limit(entries).agg(F.max("id")).head()[0]  # ids alone first: vectors come from a few partitions only
    first = named.where(F.col("id") <= F.lit(last)).orderBy("id", "vec").limit(entries).select("vec").toArrow() if last is not None else None
    if first is None or not first.num_rows:
        return None
    books = whole(first.column(0).combine_chunks(), width, parts, scale).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _means(rows.select("vec"), books, scale)
    return Codebooks(books, scale)


def _means(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Each entry becomes the mean, rounded down, of the parts nearest to it."""
    parts, n, width = books.shape

    def run(batches):
        annuli = [Annuli(e) for e in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, n), np.int64)
        for batch in batches:
            x = whole(batch.column(0), width, parts, scale)
            for p, a in enumerate(annuli):
                own = a.nearest(x[:, p])[0]
                np.add.at(total[p], own, x[:, p])
                count[p] += np.bincount(own, minlength=n)
        used = np.flatnonzero(count.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count.reshape(-1)[used]), pa.array(total.reshape(-1, width)[used].tolist(), pa.list_(pa.int64()))], ["entry", "n", "total"])

    sums = rows.mapInArrow(lean(run), "entry long, n long, total array<long>")
    sums = sums.select("entry", "n", F.posexplode("total").alias("position", "x")).groupBy("entry", "position").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    new = books.reshape(-1, width).copy()
    for r in sums.collect():  # parts x entries x width at most
        new[r["entry"], r["position"]] = r["x"] // r["n"]
    return new.reshape(books.shape)


def compressed(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", work: Workspace | None = None) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error, label_error), codebooks) of the kept rows: label_error is the error summed over equal labels, nulls together.

    Rows whose vector is null or holds a null or non-finite component are dropped; repeated rows stay. An empty table gives no rows, a table
    without any id codes of one entry, zero.
    """
    spark, work = vectors.sparkSession, work or Workspace(vectors.sparkSession, "vector-codes")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("embedding"))
    books = fit(rows)
    if books is None:
        longest = rows.where(kept(F.col("embedding"))).agg(F.max(F.size("embedding"))).head()[0]
        books = Codebooks(np.zeros((PARTS, 1, max(1, math.ceil((longest or 0) / PARTS))), np.int64))
    codes = work.save(books.encode(rows), "codes")
    totals = work.save(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    return codes.join(checked_broadcast(totals), F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: (vec_id, code, error, label_error, codebooks_sha256)."""
    codes, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    parts = """WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS (
  SELECT vec_id, part, i AS pos, x[(part * (len(x) // 16) + i + 1)::BIGINT] AS c FROM v, range(16) p(part), range(len(x) // 16) q(i)
), book0 AS (
  SELECT part, rank() OVER (PARTITION BY part, pos ORDER BY vec_id) - 1 AS entry, pos, c FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)
)"""
    for r in range(3):
        parts += f""", near{r} AS (
  SELECT vec_id, part, min(d * 64 + entry) AS best FROM (
    SELECT x.vec_id, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS d FROM x JOIN book{r} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL
  ) GROUP BY ALL
)"""
        if r < 2:
            parts += f""", sums{r} AS (
  SELECT x.part, (best % 64)::BIGINT AS entry, x.pos, sum(x.c)::BIGINT AS s, count(*) AS n FROM x JOIN near{r} m ON x.vec_id = m.vec_id AND x.part = m.part GROUP BY ALL
), book{r + 1} AS (
  SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN c ELSE (s - (s % n + n) % n) // n END AS c FROM book{r} b LEFT JOIN sums{r} s ON b.part = s.part AND b.entry = s.entry AND b.pos = s.pos
)"""
    return (
        parts
        + """, coded AS (
  SELECT vec_id, string_agg(format('{:02x}', (best % 64)::INT), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM near2 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM coded JOIN v USING (vec_id)
"""
    )


SQL = _sql()
