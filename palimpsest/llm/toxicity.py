"""Toxicity by multiple-instance learning: a document is toxic unless none of its sentences is.

A sentence's score is logistic in its hashed words; sentences combine by noisy-or, with a leak for what no sentence explains
(wrong labels), and only the documents' labels are learned from. What the model has learned then finds the sentences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, lean
from .text_bytes import LETTERS, SEGMENT, crc_mod, labelled, range_sums, runs, text_bytes

#: Words are hashed to so many buckets.
BUCKET_BITS = 20
#: About so many labelled documents, of so many bytes together, are learned from at most, whole.
SAMPLE_DOCS, SAMPLE_BYTES = 6_000, 24_000_000
STEPS, RATE = 200, 0.1

#: Fixed value: an odd base of the words' polynomial hash, which has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def _words(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, where they begin, and where sentences begin. Words and sentences end at ``begins`` too."""
    x = LETTERS[raw]
    inside = np.concatenate([[False], x != 32, [False]])
    first = np.zeros(len(raw) + 1, bool)
    first[begins] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    power, inverse = _power(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)])])
    code = (total[stop] - total[start]) * inverse[start]
    code ^= code >> np.uint64(29)
    buckets = (code * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)
    first[1:] |= _ENDS[raw]
    return buckets.astype(np.int32), start, np.flatnonzero(first[:-1])


def _parts(raw: np.ndarray, a: int, b: int):
    """A text's parts of SEGMENT bytes and what is left of the sentence there."""
    while b - a > SEGMENT:
        stop, ahead = b, a + SEGMENT
        while ahead < b:
            if len(ends := np.flatnonzero(_ENDS[raw[ahead : ahead + SEGMENT]])):
                stop = min(b, ahead + int(ends[0]) + 1)
                break
            ahead += SEGMENT
        yield a, stop
        a = stop
    if a < b:
        yield a, b


class Model:
    def __init__(self):
        self.weights, self.bias, self.leak = np.zeros(1 << BUCKET_BITS, np.float32), -6.0, 0.01

    def sentences(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sentences with words begin, and their scores."""
        buckets, word, sentence = _words(raw, begins)
        at = np.searchsorted(word, np.append(sentence, len(raw)))
        own = np.flatnonzero(np.diff(at))
        z = range_sums(self.weights[buckets].astype(float), at[own], at[own + 1]) + self.bias
        return sentence[own], 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, raw: np.ndarray, offsets: np.ndarray, above: float) -> tuple[np.ndarray, list[list[dict]]]:
        """Each text's score, and its sentences of at least ``above``: where they begin, in bytes, their text and score.

        Texts are worked on whole, some at a time; a very long one in parts that end with a sentence. A text's score is the same
        to the last bit whatever texts come with it.
        """
        clean, found = np.full(len(offsets) - 1, np.log1p(-self.leak)), [[] for _ in range(len(offsets) - 1)]
        for first, last in runs(offsets, SEGMENT):
            for a, b in _parts(raw, int(offsets[first]), int(offsets[last])) if last == first + 1 else [(int(offsets[first]), int(offsets[last]))]:
                piece, begin, end = raw[a:b], np.maximum(offsets[first:last] - a, 0), np.minimum(offsets[first + 1 : last + 1], b) - a
                at, p = self.sentences(piece, begin[begin < b - a])
                lo, hi = np.searchsorted(at, begin), np.searchsorted(at, end)
                clean[first:last] += range_sums(np.log1p(-p), lo, hi)
                stops = np.append(at[1:], b - a)
                for i in np.flatnonzero(p >= above):
                    d = int(np.searchsorted(offsets, a + at[i], side="right")) - 1
                    stop = min(int(stops[i]), int(offsets[d + 1]) - a)
                    found[d].append({"begin": int(a + at[i] - offsets[d]), "sentence": piece[at[i] : stop].tobytes().decode("utf-8", "replace").strip(), "score": float(p[i])})
        return -np.expm1(clean), found

    def fit(self, texts: list[bytes], y: np.ndarray) -> None:
        """All documents at each step (Adam). Only words count that toxic documents have so often that, of all words together, about
        one would by chance (Chernoff's bound on the binomial tail); else rare words are learned by heart."""
        words, docs, sentences, n = [], [], [], 0
        for d, text in enumerate(texts):
            raw = np.frombuffer(text, np.uint8)
            if len(raw):
                b, word, sentence = _words(raw, np.zeros(1, int))
                own = np.searchsorted(sentence, word, side="right") - 1
                words.append(b)
                sentences.append(n + own)
                docs.append(np.full(len(sentence), d))
                n += len(sentence)
        if not words or not 0 < y.sum() < len(y):
            return
        word, sentence, doc = np.concatenate(words), np.concatenate(sentences), np.concatenate(docs)
        pair = np.unique(doc[sentence] * np.int64(1 << BUCKET_BITS) + word)
        bucket, toxic = pair & ((1 << BUCKET_BITS) - 1), y[pair >> BUCKET_BITS]
        n_docs, n_toxic = (np.bincount(bucket, x, 1 << BUCKET_BITS) for x in (np.ones(len(bucket)), toxic))
        share, usual = n_toxic / np.maximum(n_docs, 1), y.mean()
        bits = n_toxic * np.log(np.maximum(share, 1e-12) / usual) + (n_docs - n_toxic) * np.log(np.maximum(1 - share, 1e-12) / (1 - usual))
        used = np.flatnonzero((share > usual) & (bits >= np.log((n_docs > 0).sum())))
        place = np.full(1 << BUCKET_BITS, -1)
        place[used] = np.arange(len(used))
        sentence, word = sentence[place[word] >= 0], place[word[place[word] >= 0]]
        w, b, leak = np.zeros(len(used)), self.bias, -4.0
        m, v = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
        for step in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(sentence, w[word], n), -30, 30)))
            spill = 1 / (1 + np.exp(-leak))
            q = np.bincount(doc, np.log1p(-p), len(y)) + np.log1p(-spill)  # log of the chance that all is clean
            dirty = np.maximum(-np.expm1(q), 1e-9)
            dq = np.where(y > 0, np.exp(q) / dirty, -1.0) / len(y)
            dz = -p * dq[doc]
            g = np.concatenate([np.bincount(word, dz[sentence], len(used)), [dz.sum(), -spill * dq.sum()]])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            w -= move[:-2]
            b, leak = min(b - move[-2], -4.0), leak - move[-1]
        self.weights[used], self.bias, self.leak = w, b, float(1 / (1 + np.exp(-leak)))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """On the driver, from a sample of about SAMPLE_DOCS whole texts and SAMPLE_BYTES bytes at most, whatever the tables' sizes."""
    rows = labelled(docs, labels, "toxic", SAMPLE_DOCS, SAMPLE_BYTES).collect()
    rows = sorted((r["text"].encode(), r["label"]) for r in rows)
    model = Model()
    model.fit([t for t, _ in rows], np.array([y for _, y in rows], float))
    return model


def score(docs: DataFrame, model: Model, above: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, sentences): of each whole text, and its offending sentences as (begin in bytes, sentence, score).

    One pass without a shuffle. Null, empty and wordless texts have the leak as their score and no sentences. Each row gives a
    row, also if its id is null or repeated.
    """
    base = documents_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            p, found = shared.value.score(*text_bytes(batch.column(1)), above)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(found, kind)], ["doc_id", "score", "sentences"])

    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, sentences array<struct<begin: long, sentence: string, score: double>>")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels.toxic of those whose rest is not 2: (doc_id, held_out, score, predicted).

    A null, empty or wordless text has the leak as its score; a null doc_id isn't held out. Equal texts have equal scores.
    """
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, learn(docs, labels))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
