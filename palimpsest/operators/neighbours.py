"""Nearest vectors of many queries: bounds by matrix products, whole scores of what can be among the best, in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs of query and vector that are scored at a time, at most.
PAIRS = 2_000_000
#: Components of the vectors that are read at a time, at most, but for a single longer one.
COMPONENTS = 1_000_000
#: A product's error, relative to the lengths, is below this for each component and a few more.
ERROR = 8 * 2.0**-53
#: Outside of these lengths products may lose their precision; such vectors are scored whole.
LEAST, MOST = 1e-100, 1e100


def _hashable(x):
    """Keys as Spark's joins compare them: NaN equals itself."""
    if isinstance(x, list | tuple | dict):
        return tuple(map(_hashable, x.values() if isinstance(x, dict) else x))
    if isinstance(x, bytearray):
        return bytes(x)
    return "NaN" if x != x else x


def keys_of(columns: list[list], n: int) -> list[tuple | None]:
    """A key for each of n rows, None where a column is null."""
    return [None if any(x is None for x in r) else tuple(map(_hashable, r)) for r in zip(*columns, strict=True)] if columns else [()] * n


def _sum(columns: Iterator[np.ndarray], n: int) -> np.ndarray:
    """Added one after the other, as Spark does: equal vectors have equal sums, to the last bit."""
    out = np.zeros(n)
    for c in columns:
        out += c
    return out


class Side:
    """Vectors of one size, with their lengths."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.columns = rows, np.ascontiguousarray(rows.T)
        self.norm = np.sqrt(_sum((c * c for c in self.columns), len(rows)))
        self.odd = ~((self.norm >= LEAST) & (self.norm <= MOST))


def _scaled(score: np.ndarray, mode: str) -> np.ndarray:
    if mode == "raw":
        return score
    score = (score + 1) / 2 if mode == "unit" else score
    return np.where(np.isnan(score), 1.0, np.maximum(0.0, np.minimum(1.0, score)))  # NaN is the largest of all


def _exact(a: Side, i: np.ndarray, b: Side, j: np.ndarray, metric: str, mode: str) -> np.ndarray:
    """Scores of pairs."""
    pairs = zip(a.columns, b.columns, strict=True)
    if metric == "euclidean":
        return _scaled(0.0 - np.sqrt(_sum(((x[i] - y[j]) * (x[i] - y[j]) for x, y in pairs), len(i))), mode)
    score = _sum((x[i] * y[j] for x, y in pairs), len(i))
    if metric == "cosine":
        n = a.norm[i] * b.norm[j]
        score = np.where(n == 0, 0.0, score / np.where(n == 0, 1.0, n))
    return _scaled(score, mode)


def _bounds(a: Side, b: Side, metric: str, mode: str) -> np.ndarray:
    """What each pair's score is at most."""
    error, x, y = ERROR * (a.rows.shape[1] + 8), a.norm[:, None], b.norm[None, :]
    out = a.rows @ b.rows.T
    if metric == "cosine":
        out /= np.where(a.odd, 1.0, a.norm)[:, None]
        out /= np.where(b.odd, 1.0, b.norm)[None, :]
        out += error
    elif metric == "dot":
        out += error * x * np.where(b.odd, 0.0, b.norm).max(initial=0.0)
    else:
        out = x * x + y * y - 2 * out - error * (x + y) ** 2
        out = -np.sqrt(np.maximum(out, 0.0)) * (1 - error)
    out = _scaled(out, mode) + (error if mode != "raw" else 0.0)
    out[a.odd] = np.inf
    out[:, b.odd] = np.inf
    return out


class Best:
    """The k best vectors so far of each query of one key and size, by score and then by the order in which they came."""

    def __init__(self, places: np.ndarray, side: Side, k: int):
        self.places, self.side, self.k, n = places, side, k, len(places)
        self.score, self.id, self.n = np.full((n, k), -np.inf), np.empty((n, k), object), np.zeros(n, int)

    def _merge(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Adds scored vectors (query, score, id), each query's in the order in which they came, after those it has."""
        some = np.unique(at)
        old = np.arange(self.k)[None, :] < self.n[some][:, None]
        every = np.concatenate([np.repeat(some, self.n[some]), at])
        scores, ids = np.concatenate([self.score[some][old], score]), np.concatenate([self.id[some][old], ids])
        nan = np.isnan(scores)
        by = np.lexsort((np.arange(len(every)), -np.where(nan, np.inf, scores), ~nan, every))
        every = every[by]
        rank = np.arange(len(every)) - np.searchsorted(every, every)
        by, every, rank = by[rank < self.k], every[rank < self.k], rank[rank < self.k]
        self.score[every, rank], self.id[every, rank] = scores[by], ids[by]
        self.n[some] = np.bincount(every, minlength=len(self.n))[some]

    def add(self, vectors: Side, ids: np.ndarray, metric: str, mode: str, least: float | None) -> None:
        step = max(1, PAIRS // max(1, len(ids)))
        for lo in range(0, len(self.places), step):
            some = slice(lo, lo + step)
            queries = Side.__new__(Side)
            queries.rows, queries.columns, queries.norm, queries.odd = self.side.rows[some], self.side.columns[:, some], self.side.norm[some], self.side.odd[some]
            bound = _bounds(queries, vectors, metric, mode)
            have = self.n[some] == self.k
            last = self.score[some, -1]
            reach = np.where(have, np.where(np.isnan(last), np.inf, last), -np.inf)
            if not have.all() and len(ids) > self.k:
                # those with the highest bounds give a first threshold
                new = np.flatnonzero(~have)
                j = np.argpartition(-bound[new], self.k - 1, axis=1)[:, : self.k]
                i = np.repeat(new, self.k)
                first = _exact(queries, i, vectors, j.ravel(), metric, mode).reshape(j.shape)
                reach[new] = np.where(np.isnan(first).any(1), -np.inf, first.min(1))
            if least is not None:
                reach = np.maximum(reach, least)
            i, j = np.nonzero(~(bound < reach[:, None]))
            for at in range(0, len(i), PAIRS):
                self._score(i[at : at + PAIRS], j[at : at + PAIRS], lo, queries, vectors, ids, metric, mode, least)

    def _score(self, i, j, lo, queries, vectors, ids, metric, mode, least) -> None:
        score = _exact(queries, i, vectors, j, metric, mode)
        good = np.ones(len(i), bool) if least is None else (score >= least) | np.isnan(score)
        if good.any():
            self._merge(lo + i[good], score[good], ids[j[good]])


def split(keys: list, column: pa.ListArray) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((key, size), places, vectors as rows) of a column of lists of doubles; without null vectors, null components and null keys."""
    sizes = np.where(column.is_null(), -1, column.value_lengths().fill_null(-1)).astype(int)
    start = np.asarray(column.offsets)[:-1]
    values = np.asarray(column.values.fill_null(0.0), float)
    gaps = np.concatenate([[0], np.cumsum(np.asarray(column.values.is_null()))])
    groups: dict = {}
    for place, (key, size) in enumerate(zip(keys, sizes.tolist(), strict=True)):
        if key is not None and size >= 0 and gaps[start[place] + size] == gaps[start[place]]:
            groups.setdefault((key, size), []).append(place)
    for (key, size), places in groups.items():
        at = np.array(places)
        yield (key, size), at, values[start[at][:, None] + np.arange(size)]


def _rows(batch: pa.RecordBatch) -> int:
    return max(1, COMPONENTS * batch.num_rows // max(1, len(batch.column(1).flatten())))


def search(asked, keys: int, k: int, metric: str, mode: str, least: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (id, embedding, *keys) in the order of their ids to (place, id, score), at most k for each query.

    ``asked`` is a broadcast list of ((key, size), places, vectors).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            best, kind = {group: Best(places, Side(rows), k) for group, places, rows in asked.value}, None
            for batch in (b.slice(i, n) for b in batches for n in [_rows(b)] for i in range(0, b.num_rows, n)):
                kind = batch.schema.field(0).type
                ids = np.empty(batch.num_rows, object)
                ids[:] = batch.column(0).to_pylist()
                for group, at, rows in split(keys_of([batch.column(2 + i).to_pylist() for i in range(keys)], batch.num_rows), batch.column(1)):
                    if group in best:
                        best[group].add(Side(rows), ids[at], metric, mode, least)
        for b in best.values():
            there = np.arange(k)[None, :] < b.n[:, None]
            if there.any():
                columns = [pa.array(np.repeat(b.places, b.n), pa.int64()), pa.array(b.id[there].tolist(), kind), pa.array(b.score[there], pa.float64(), from_pandas=False)]
                yield pa.RecordBatch.from_arrays(columns, ["place", "id", "score"])

    return run
