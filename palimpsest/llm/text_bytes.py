"""Texts of an Arrow batch as one array of bytes, and the bounded samples that models are fitted on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once.
SEGMENT = 2_000_000


def _ascii_letters() -> np.ndarray:
    """Letters in lower case, bytes of other scripts as they are, all else a space."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for c in range(ord("a"), ord("z") + 1):
        table[[c, c - 32]] = c
    return table


LETTERS = _ascii_letters()


def text_bytes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins and ends: text i is bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def segments(offsets: np.ndarray, ahead: int = 0) -> Iterator[tuple[int, int, slice, np.ndarray, np.ndarray]]:
    """Cuts the bytes every SEGMENT bytes: (begin, end, texts in it, where each begins, where its windows of ``ahead`` + 1 bytes
    no longer begin), the latter two from ``begin`` on. A text may be in several segments; its windows are in one each."""
    total = int(offsets[-1])
    for a in range(0, total, SEGMENT):
        b = min(total, a + SEGMENT)
        first, last = int(np.searchsorted(offsets, a, side="right")) - 1, int(np.searchsorted(offsets, b, side="left"))
        begin = np.clip(offsets[first:last], a, b)
        end = np.clip(offsets[first + 1 : last + 1] - ahead, begin, b)
        yield a, b, slice(first, last), begin - a, end - a


def sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values over each range."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[begin]


def runs(offsets: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of whole texts of about so many bytes together; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def range_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As ``sums`` of ascending, separate ranges, but each is added up on its own: what stands before it doesn't change its rounding."""
    out, own = np.zeros(len(begin)), np.flatnonzero(end > begin)
    if len(own):
        out[own] = np.add.reduceat(np.append(values, 0.0), np.stack([begin[own], end[own]], 1).ravel())[::2]
    return out


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def _by_hash(key: str, rate: float) -> Column:
    """True for about that share of the keys: the same ones in whatever order and parts they come."""
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1_000_000)) < max(1, int(1_000_000 * rate))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, total: int) -> DataFrame:
    """(text, label): a sample of about ``rows`` labelled documents at most, those of rest 2 left out, and of fewer if their whole
    texts have more than ``total`` bytes together. Texts of any size up to that are as likely to be in it; ids that many rows have don't make it larger.

    The labels are sampled first, so the sample is a broadcast of at most ``rows`` keys and the documents aren't shuffled.
    """
    known = labels.select(labels["doc_id"].alias("k"), labels[label].cast("int").alias("label")).where(F.col("label").isin(0, 1) & (crc_mod(F.col("k"), 4) != 2))
    n = known.count()
    known = known if n <= rows else known.where(_by_hash("k", rows / n))
    known = F.broadcast(known.limit(2 * rows))
    texts = docs.select("doc_id", "text")
    sample = texts.join(known, texts["doc_id"] == known["k"]).where(F.col("text").isNotNull())
    counted = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size")).head()
    found = counted(sample)
    if found["n"] > 2 * rows:  # ids that many rows have: of equal rows one, and of the rest a share by id and text
        sample = sample.withColumn("h", F.xxhash64("k", "text")).dropDuplicates(["h"])
        left = sample.agg(F.count(F.lit(1))).head()[0]
        sample = sample.where(_by_hash("h", min(1.0, rows / max(left, 1)))).drop("h")
        found = counted(sample)
    sample = sample.where(F.octet_length("text") <= total)
    size = found["size"] or 0
    sample = sample if size <= total else sample.where(_by_hash("k", min(1.0, rows / max(n, 1)) * total / size))
    return sample.select("text", "label")
