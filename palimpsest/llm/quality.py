"""Quality classifier: a byte-level convolutional network.

Every window of ``WIDTH`` bytes of a document goes through learned filters. Windows are dealt into chunks, which overlap by
WIDTH - 1 bytes so that none is lost; each filter's largest value in a chunk is kept, these are averaged over all chunks of the
document, and a small dense layer makes one probability of them. A filter is a sum of one table row for each byte of
the window (the product of byte embedding and filter weights), so no window is ever laid out in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, lean
from .text_bytes import crc_mod, labelled, text_bytes

WIDTH, FILTERS, CHUNK, EMBEDDING, HIDDEN = 5, 16, 256, 8, 8
#: About so many labelled documents, of so many bytes together, are learned from at most, whole.
SAMPLE_DOCS, SAMPLE_BYTES = 3_000, 8_000_000
EPOCHS, RATE = 12, 0.01


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBEDDING)),
            "filters": r.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)),
            "bias": np.zeros(FILTERS),
            "hidden": r.normal(0, 0.3, (FILTERS, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "out": r.normal(0, 0.3, HIDDEN),
            "out_bias": np.zeros(1),
        }

    def tables(self) -> np.ndarray:
        """Row b of table t is what byte b at place t of a window adds to the filters."""
        return np.einsum("be,tef->tbf", self.p["embed"], self.p["filters"]).astype(np.float32)

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(0, pooled @ self.p["hidden"] + self.p["hidden_bias"])
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ self.p["out"] + self.p["out_bias"], -30, 30)))

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each text; texts of fewer than WIDTH bytes are padded with zero bytes."""
        tables, sums = self.tables(), np.zeros((len(offsets) - 1, FILTERS))
        pairs = [(tables[t][:, None] + tables[t + 1][None]).reshape(-1, FILTERS) for t in range(0, WIDTH - 1, 2)]
        rest = tables[WIDTH - 1] if WIDTH % 2 else None
        chunks = np.zeros(len(offsets) - 1)
        for doc, begin, stop in _chunk_runs(offsets):
            piece = raw[begin : stop + WIDTH - 1]
            values = self._filtered(np.pad(piece, (0, stop - begin + WIDTH - 1 - len(piece))), pairs, rest, stop - begin)
            ends = offsets[doc + 1]
            firsts = offsets[doc]
            starts, owner = [], []
            for d, a, e in zip(doc.tolist(), firsts.tolist(), ends.tolist(), strict=True):
                lo, hi = max(a, begin), min(max(e - WIDTH + 1, a + 1), stop)
                # chunks are counted from the text's own begin, whatever batch it came in
                own = np.arange(lo - begin, hi - begin, CHUNK)
                starts.append(own)
                owner.append(np.full(len(own), d))
            starts, owner = np.concatenate(starts), np.concatenate(owner)
            last = np.minimum(starts + CHUNK, np.maximum(offsets[owner + 1] - WIDTH + 1, offsets[owner] + 1) - begin)
            edges = np.stack([starts, np.minimum(last, stop - begin)], 1).ravel()
            top = np.maximum.reduceat(np.concatenate([values, np.full((1, FILTERS), -1e9, np.float32)]), edges)[::2]
            np.add.at(sums, owner, np.maximum(0, top + self.p["bias"]))
            chunks += np.bincount(owner, minlength=len(chunks))
        if len(short := np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < WIDTH))):
            x = np.stack([np.pad(raw[offsets[d] : offsets[d + 1]], (0, WIDTH - offsets[d + 1] + offsets[d])) for d in short])
            sums[short] = np.maximum(0, sum(tables[t][x[:, t]] for t in range(WIDTH)) + self.p["bias"])
            chunks[short] = 1
        return self.head(sums / np.maximum(chunks, 1)[:, None])[1]

    @staticmethod
    def _filtered(piece: np.ndarray, pairs: list[np.ndarray], rest: np.ndarray | None, n: int) -> np.ndarray:
        two = (piece[:-1].astype(np.int32) << 8) | piece[1:]
        values = np.take(pairs[0], two[:n], axis=0)
        for i, pair in enumerate(pairs[1:], 1):
            values += np.take(pair, two[2 * i : 2 * i + n], axis=0)
        if rest is not None:
            values += np.take(rest, piece[WIDTH - 1 : WIDTH - 1 + n], axis=0)
        return values

    def fit(self, chunks: np.ndarray, doc: np.ndarray, labels: np.ndarray, seed: int = 7) -> None:
        """chunks: uint8 (n, CHUNK + WIDTH - 1), zero-padded; doc: whose chunk it is, ascending; labels of the documents."""
        r = np.random.default_rng(seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        edges, step = np.searchsorted(doc, np.arange(len(labels) + 1)), 0
        for _ in range(EPOCHS):
            order = r.permutation(len(labels))
            for i in range(0, len(order), 64):
                own = order[i : i + 64]
                rows = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in own])
                g = self._gradients(chunks[rows], np.repeat(np.arange(len(own)), edges[own + 1] - edges[own]), labels[own])
                step += 1
                for k, v in g.items():
                    a, b = m[k]
                    a += 0.1 * (v - a)
                    b += 0.001 * (v * v - b)
                    self.p[k] -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; through a maximum only the window that has it counts."""
        tables, p = self.tables(), self.p
        at, top = [], []
        for i in range(0, len(x), 512):
            values = sum(tables[t][x[i : i + 512, t : t + CHUNK]] for t in range(WIDTH))
            at.append(values.argmax(1))
            top.append(np.take_along_axis(values, at[-1][:, None], 1)[:, 0])
        at, top = np.concatenate(at), np.maximum(0, np.concatenate(top) + p["bias"])
        n = np.bincount(owner, minlength=len(y))[:, None]
        pooled = np.zeros((len(y), FILTERS))
        np.add.at(pooled, owner, top)
        pooled /= np.maximum(n, 1)
        hidden, score = self.head(pooled)
        d = (score - y) / len(y)
        g = {"out": hidden.T @ d, "out_bias": d.sum(keepdims=True)}
        dh = np.outer(d, p["out"]) * (hidden > 0)
        g |= {"hidden": pooled.T @ dh, "hidden_bias": dh.sum(0)}
        dt = ((dh @ p["hidden"].T) / np.maximum(n, 1))[owner] * (top > 0)
        g |= {"bias": dt.sum(0), "embed": np.zeros_like(p["embed"]), "filters": np.zeros_like(p["filters"])}
        row, f = np.arange(len(x))[:, None], np.broadcast_to(np.arange(FILTERS), at.shape)
        for t in range(WIDTH):
            b = x[row, at + t]
            dtable = np.zeros((256, FILTERS))
            np.add.at(dtable, (b, f), dt)
            g["embed"] += dtable @ p["filters"][t].T
            g["filters"][t] = p["embed"].T @ dtable
        return g


def _chunk_runs(offsets: np.ndarray, size: int = 64 * 1024):
    """Runs of bytes, about ``size`` long and a whole number of chunks of a long text, with the texts in them, that have bytes."""
    n, d = len(offsets) - 1, 0
    at = 0
    while d < n:
        if offsets[d + 1] <= at:
            d += 1
            continue
        begin = max(at, int(offsets[d]))
        if offsets[d + 1] - begin > size:
            stop = begin + size // CHUNK * CHUNK
            # the windows that begin in the text's last WIDTH - 1 bytes don't count
            yield np.array([d]), begin, stop
            at = stop
            if offsets[d + 1] - at < WIDTH:
                at, d = int(offsets[d + 1]), d + 1
            continue
        e = max(d + 1, int(np.searchsorted(offsets, begin + size, side="right")) - 1)
        own = np.arange(d, e)
        own = own[offsets[own + 1] > np.maximum(offsets[own], begin)]
        yield own, begin, int(offsets[e])
        at, d = int(offsets[e]), e


def chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts, as scoring deals them, zero-padded; and whose they are."""
    width, chunks, doc = CHUNK + WIDTH - 1, [np.zeros((0, CHUNK + WIDTH - 1), np.uint8)], []
    for d, text in enumerate(texts):
        n = max(1, -(-(len(text) - WIDTH + 1) // CHUNK))
        padded = np.zeros(CHUNK * n + WIDTH - 1, np.uint8)
        own = np.frombuffer(text, np.uint8)[: len(padded)]
        padded[: len(own)] = own
        chunks.append(np.lib.stride_tricks.sliding_window_view(padded, width)[::CHUNK])
        doc.append(np.full(n, d))
    return np.concatenate(chunks), np.concatenate([np.zeros(0, int), *doc])


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """On the driver, from a sample of about SAMPLE_DOCS whole texts and SAMPLE_BYTES bytes at most, whatever the tables' sizes."""
    network = Network()
    rows = labelled(docs, labels, "quality", SAMPLE_DOCS, SAMPLE_BYTES).collect()
    rows = sorted((r["text"].encode(), r["label"]) for r in rows)
    if rows:
        network.fit(*chunked([t for t, _ in rows]), np.array([y for _, y in rows], float))
    return network


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each whole text, in one pass without a shuffle; a null or empty text gets the score of no chunks.

    Each row gives a row, also if its id is null or repeated.
    """
    base = documents_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(*text_bytes(batch.column(1))))], ["doc_id", "score"])

    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels.quality of those whose rest is not 2: (doc_id, held_out, score, predicted).

    A null or empty text has the score of no chunks; a null doc_id isn't held out.
    """
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, learn(docs, labels))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
