"""Language ID by n-gram filters: one Bloom filter for all languages, each of whose cells holds a bit for every language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents_of, lean
from .pieces import slices
from .text_bytes import LETTERS, crc_mod, segments, sums, text_bytes

#: Bytes of an n-gram; n-grams of a language that are kept; bits of the cell number.
N, KEPT, CELL_BITS = 4, 20_000, 18
LEAST = 0.1
#: About so many documents of each language are learned from, whole.
SAMPLE_DOCS = 2_000

#: Odd multipliers of the two hashes.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B)
_LETTER = regex.compile(r"\p{L}").search


def _grams(raw: np.ndarray) -> np.ndarray:
    """The n-gram that begins at each byte but the last N - 1."""
    x = LETTERS[raw].astype(np.uint32)
    grams = np.zeros(max(0, len(x) - N + 1), np.uint32)
    for i in range(N):
        grams = (grams << np.uint32(8)) | x[i : i + len(grams)]
    return grams


def _cells(grams: np.ndarray) -> list[np.ndarray]:
    return [(grams * np.uint32(m)) >> np.uint32(32 - CELL_BITS) for m in _MULTIPLIERS]


class Filters:
    """Cells hold the languages' bits in words of 64; a language's rate of false positives follows from its share of set cells."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        self.words = np.zeros((-(-len(languages) // 64), 1 << CELL_BITS), np.uint64)
        self.false = np.zeros(len(languages))
        for i, own in enumerate(grams):
            bit, word = np.uint64(1 << (i % 64)), self.words[i // 64]
            for cells in _cells(own.astype(np.uint32)):
                word[cells] |= bit
            self.false[i] = ((word & bit) > 0).mean() ** len(_MULTIPLIERS)

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text and language, the n-grams that the language has, less those to be expected by chance."""
        found, n = np.zeros((len(offsets) - 1, len(self.languages))), np.maximum(0, np.diff(offsets) - N + 1)
        for a, b, texts, begin, end in segments(offsets, N - 1):
            one, two = _cells(_grams(raw[a : b + N - 1]))
            m = len(one)
            begin, end = np.minimum(begin, m), np.minimum(end, m)
            for w, word in enumerate(self.words):
                held = word[one] & word[two]
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    found[texts, i] += sums((held >> np.uint64(i % 64)) & np.uint64(1), begin, end)
        return np.maximum(0, found - n[:, None] * self.false) / (1 - self.false)


def learn(docs: DataFrame, languages: DataFrame | None = None) -> Filters:
    """From (doc_id, text, lang): each language's most frequent n-grams in a bounded sample of its documents, without those
    that are LEAST times as frequent there as in another language or rarer, as they come from foreign words and wrong labels.

    A language's sample is taken by hash at a rate that follows from its count; ties among n-grams go by their bytes.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    names = sorted(sizes, key=lambda k: (-sizes[k], k))
    if not names:
        return Filters([], [])
    rate = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / sizes[k])))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000)

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            raw, at = text_bytes(batch.column(0))
            for a, b, texts, begin, end in segments(at, N - 1):
                grams = _grams(raw[a : b + N - 1])
                begin, end, own = np.minimum(begin, len(grams)), np.minimum(end, len(grams)), langs[texts]
                for name in sorted(set(own)):
                    parts = [grams[x:y] for x, y in zip(begin[own == name], end[own == name], strict=True)]
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("lang"))
    counted = counted.withColumn("share", share).withColumn("most", F.max("share").over(W.partitionBy("gram"))).where(F.col("share") >= LEAST * F.col("most"))
    best = counted.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= KEPT)
    grams: dict[str, list[int]] = {k: [] for k in names}
    for r in best.select("lang", "gram").collect():  # KEPT rows a language at most
        grams[r["lang"]].append(r["gram"])
    return Filters(names, [np.array(grams[k], np.int64) for k in names])


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, matches), and with ``keep`` also the text and these columns: the language with most n-grams of the text after correction, its share of all languages'
    corrected counts, and each language's count.

    Whole texts, in one pass without a shuffle. Null texts and texts without a letter are ``und`` with score 0. Texts
    of which no language has an n-gram go to the language with most documents to learn from, with score 0; ties go to the
    language with more of them.
    Each row gives a row, also if its id is null or repeated.
    """
    base = documents_of(docs, id_col, text_col, keep)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kept = [i for i in range(len(base.columns)) if keep and i]
    names = ["doc_id", *[base.columns[i] for i in kept], "lang_pred", "score", "matches"]
    added = T.StructType().add("lang_pred", "string").add("score", "double").add("matches", T.ArrayType(T.DoubleType()))
    schema = T.StructType([base.schema[0], *[base.schema[i] for i in kept], *added])

    def run(batches):
        filters = shared.value
        for batch in batches:
            for part in slices(batch, 1):  # what goes out holds the texts too
                column = part.column(1)
                lettered = np.array([bool(_LETTER(t.as_py() or "")) for t in column], bool)
                found = filters.counts(*text_bytes(column)) if filters.languages else np.zeros((len(column), 1))
                best, total = found.argmax(1), found.sum(1)
                pred = [filters.languages[i] if ok and filters.languages else "und" for i, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered & (total > 0), found.max(1) / np.maximum(total, 1e-9), 0.0)
                columns = [*[part.column(i) for i in [0, *kept]], pa.array(pred, pa.string()), pa.array(score), pa.array(found.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return base.mapInArrow(lean(run), schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those whose rest is not 1: (doc_id, held_out, lang_pred, score).

    A null text or one without a letter is ``und`` with score 0; a null doc_id isn't held out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = learn(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(docs, filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
