"""Cutting text into the pieces of byte-level pre-tokenizers, and remembering the ids of each distinct piece, in NumPy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

#: Bytes of text that are worked on at once; code points of a piece that is remembered.
SLICE_BYTES, LONGEST = 500_000, 512

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
#: Fixed value: an odd base of the pieces' polynomial hash, which has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_state: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """The kind of each code point."""
    if "kinds" not in _state:
        table = np.full(0x110000, _OTHER, np.uint8)
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            text = "".join(map(chr, range(low, high)))
            for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
                for m in regex.finditer(pattern, text):
                    table[low + m.start() : low + m.end()] = kind
        _state["kinds"] = table
    return _state["kinds"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, modulo 2^64."""
    if "powers" not in _state or len(_state["powers"]) < n:
        for name, b in (("powers", _BASE), ("inverses", pow(_BASE, -1, 2**64))):
            _state[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SLICE_BYTES), b, np.uint64)]))
    return _state["powers"], _state["inverses"]


def cut(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the code points of some texts, which begin at ``texts``.

    As the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ cuts: runs of one kind are
    pieces; of white space before something else the last character stands alone or, if it is a space, goes to what
    follows; and an apostrophe that begins a piece takes an ending that comes after it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds()[points]
    first = np.zeros(n + 1, bool)
    first[texts[texts < n]] = first[n] = True
    begin = first.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begin)
    length, own = np.diff(run), kind[run[:-1]]
    run, end = run[:-1], run[1:]
    followed = ~first[end]
    space = (own == _SPACE) & followed
    last = end[space] - 1
    begin[last] = True
    begin[end[space][points[last] == 32]] = False
    quote = np.flatnonzero((own == _OTHER) & (length == 1) & (points[run] == 39) & followed & begin[run])
    quote = quote[own[np.minimum(quote + 1, len(own) - 1)] == _LETTER]
    if len(quote):
        at, stop = run[quote] + 1, end[quote + 1]
        one, two = points[at], np.where(at + 1 < stop, points[np.minimum(at + 1, n - 1)], 0)
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(pair, 2, 0))
        at, stop, size = at[size > 0], stop[size > 0], size[size > 0]
        begin[at] = False
        begin[(at + size)[at + size < stop]] = True
    return np.flatnonzero(begin[:n])


class PieceCoder:
    """Ids of texts. ``encode_new`` gives those of pieces not met before, as (all ids, ids of each piece)."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], added: dict[str, int], bits: int = 21):
        """``bits``: of the table that remembers pieces; it is emptied when 60 % full. 12 bytes a place, and those of the ids."""
        self.encode_new, self.added, self.bits = encode_new, added, bits
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")").split
        self._forget()

    def _forget(self) -> None:
        self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.ids, self.n_ids, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.runs = np.zeros(1 << 14, np.int64)  # of each piece where its ids begin and, in the low 28 bits, how many it has

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for new ones; linear probing, for all keys together."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        same = held == keys
        out = np.where(same, self.places[slot], np.int32(-1))
        todo = np.flatnonzero(~same & (held != 0))
        slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        while len(todo):
            held = self.keys[slot[todo]]
            same = held == keys[todo]
            out[todo[same]] = self.places[slot[todo[same]]]
            todo = todo[~same & (held != 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _add(self, keys: np.ndarray | None, pieces: list[str]) -> np.ndarray:
        """Remembers new pieces, by distinct keys if any; their places."""
        ids, sizes = self.encode_new(pieces)
        places = np.arange(self.n, self.n + len(pieces), dtype=np.int32)
        while len(self.ids) < self.n_ids + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.runs) < self.n + len(pieces):
            self.runs = np.concatenate([self.runs, np.zeros_like(self.runs)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.runs[self.n : self.n + len(pieces)] = (self.n_ids + np.cumsum(sizes) - sizes) << 28 | sizes
        self.n, self.n_ids = self.n + len(pieces), self.n_ids + len(ids)
        if keys is not None:
            todo, slot = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
            while len(todo):
                free = self.keys[slot[todo]] == 0
                self.keys[slot[todo[free]]] = keys[todo[free]]  # of several for one slot the last stays
                done = self.keys[slot[todo]] == keys[todo]
                self.places[slot[todo[done]]] = places[todo[done]]
                todo = todo[~done]
                slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return places

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of added tokens give their ids."""
        special = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not special:
            return self._encode(texts)
        parts = [[t] for t in texts]
        for i in special:
            parts[i] = self.split(texts[i])
        flat = [x for p in parts for x in p]
        ids = iter(self._encode(["" if x in self.added else x for x in flat]))
        own = [[np.array([self.added[x]], np.uint32) if x in self.added and next(ids) is not None else next(ids) for x in p] for p in parts]
        return [np.concatenate(x) for x in own]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        text = "".join(texts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(np.array([len(t) for t in texts], np.int64))
        begin = cut(points, np.concatenate([[0], stops[:-1]]).astype(np.int64) if len(texts) else stops)
        end = np.append(begin[1:], len(points))
        if self.n + len(begin) > 0.6 * (1 << self.bits) and self.n:
            self._forget()
        power, inverse = _powers(len(points))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint32(1)) * power[: len(points)])])
        keys = (total[end] - total[begin]) * inverse[begin]
        keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        keys[keys == 0] = 1
        place = self._find(keys)
        long = end - begin > LONGEST  # not by hash
        place[long] = -2
        new = np.flatnonzero(place == -1)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            at = new[first]
            fits = self.n + len(distinct) <= 0.8 * (1 << self.bits)  # else one text fills the table: not remembered
            places = self._add(distinct if fits else None, [text[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            place[new] = places[np.searchsorted(distinct, keys[new])]
        if long.any():
            place[long] = self._add(None, [text[a:b] for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
        run = self.runs[place]
        size = run & 0xFFFFFFF
        to = np.cumsum(size)
        ids = self.ids[np.repeat((run >> 28) - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)]
        return np.split(ids, np.append(0, to)[np.searchsorted(begin, stops)][:-1]) if len(texts) else []


def slices(batch: pa.RecordBatch, of: int, size: int = SLICE_BYTES):
    """Runs of rows of a batch of about so many bytes together in column ``of``: what a worker holds at a time besides the batch."""
    offsets = np.frombuffer(batch.column(of).buffers()[1], np.int32)[batch.column(of).offset :] if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(offsets[: batch.num_rows + 1], offsets[at] + size, side="right")) - 1
        stop = min(batch.num_rows, max(at + 1, stop))
        yield batch.slice(at, stop - at)
        at = stop


def binaries(arrays: list[np.ndarray], width: str) -> pa.Array:
    """Ids as binary values, little-endian."""
    return pa.array([x.astype(width).tobytes() for x in arrays], pa.binary())
