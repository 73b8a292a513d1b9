"""BPE encoding and decoding by dynamic programming over prefixes.

A prefix of a piece of text has exactly one last token in its encoding. The tokens that end there come from an automaton
over the vocabulary; the right one is the longest whose neighbour on the left (the last token of the prefix before it)
stays its neighbour, which a test on the two tokens' own merges tells. Back-pointers from the end give the ids.
Pieces are what the pre-tokenizer's pattern cuts; a worker encodes each distinct piece once for long, all new ones of a slice
together in NumPy.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, lean
from .pieces import PieceCoder, binaries, slices

_BIG = np.int64(1) << 40


def _byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 characters stand for their own byte, the rest for code points from 256 on, in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_vocabulary(path: str) -> dict:
    """From a tokenizers JSON file of a byte-level BPE: ids of bytes and merges, in merge order, and added tokens."""
    with open(path, "rb") as f:
        file = f.read()
    raw = json.loads(file)
    vocab, alphabet = raw["model"]["vocab"], _byte_alphabet()
    ids = [0] * 256
    for c, b in alphabet.items():
        ids[b] = vocab[c]
    number = {vocab[c]: b for c, b in alphabet.items()}  # ours: 0-255 are bytes, then merges by rank
    left, right = [], []
    for rank, pair in enumerate(raw["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        left.append(number[vocab[a]])
        right.append(number[vocab[b]])
        number.setdefault(vocab[a + b], 256 + rank)
        ids.append(vocab[a + b])
    return {"name": hashlib.sha256(file).hexdigest(), "ids": np.array(ids, np.uint32), "left": np.array(left, np.int64), "right": np.array(right, np.int64), "added": {x["content"]: x["id"] for x in raw["added_tokens"]}}


class Bpe:
    """Automaton, pair tests and remembered pieces of one vocabulary."""

    def __init__(self, vocabulary: dict):
        self.ids, self.added = vocabulary["ids"], vocabulary["added"]
        left, right = vocabulary["left"], vocabulary["right"]
        n = 256 + len(left)
        self.first, self.second = np.arange(n), np.arange(n)  # a byte is its own half
        self.first[256:], self.second[256:] = left, right
        tokens = [bytes([b]) for b in range(256)]
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            tokens.append(tokens[a] + tokens[b])
        self.size = np.array([len(t) for t in tokens], np.int32)
        self.tokens, self.edges = tokens, None  # what only encoding needs is made when it begins
        by_id = {int(i): t for i, t in zip(self.ids, tokens, strict=True)} | {i: s.encode() for s, i in self.added.items()}
        self.width = np.zeros(max(by_id) + 1, np.int64)
        for i, t in by_id.items():
            self.width[i] = len(t)
        self.begins = np.cumsum(self.width) - self.width
        self.letters = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(max(by_id) + 1)), np.uint8)

    def _automaton(self, tokens: list[bytes]) -> None:
        """Tokens as a tree with suffix links: ``edges`` (state and byte, sorted) lead to ``child``, ``fail[state]`` is the longest proper suffix of
        it in the tree; longest[state] the longest token that ends there; shorter[token] the next. A few megabytes: a table of all
        states and bytes would be many times as large, and only pieces that are new to a worker pass through here."""
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for t, word in enumerate(tokens):
            at = 0
            for b in word:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][b]
            if ends[at] < 0:
                ends[at] = t
        self.longest, self.shorter = np.full(len(children), -1, np.int32), np.full(len(tokens), -1, np.int32)
        fail, queue = [0] * len(children), [0]
        for s in queue:  # breadth first: shorter suffixes are done
            if s:
                suffix = self.longest[fail[s]]
                self.longest[s] = suffix if ends[s] < 0 else ends[s]
                if ends[s] >= 0:
                    self.shorter[ends[s]] = suffix
            for b, child in children[s].items():
                f = fail[s]
                while f and b not in children[f]:
                    f = fail[f]
                fail[child] = children[f].get(b, 0) if s else 0
                queue.append(child)
        edges = np.array([s << 8 | b for s, c in enumerate(children) for b in c], np.int64)
        order = np.argsort(edges)
        self.edges, self.fail = edges[order], np.array(fail, np.int32)
        self.child = np.array([x for c in children for x in c.values()], np.int32)[order]

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after these bytes: along an edge, or that of the longest suffix that has one, or the root."""
        out, todo, at = np.zeros(len(state), np.int32), np.arange(len(state)), state.astype(np.int64)
        while len(todo):
            key = at << 8 | byte[todo]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[place] == key
            out[todo[hit]] = self.child[place[hit]]
            go = ~hit & (at > 0)
            todo, at = todo[go], self.fail[at[go]].astype(np.int64)
        return out

    def _pairs(self) -> None:
        """rank(a, b) by a table with four places for each hash; its multiplier is the first under which all pairs fit."""
        a, b = self.first[256:].astype(np.uint64), self.second[256:].astype(np.uint64)
        keys, bits = (a << np.uint64(20)) | b, max(10, int(len(a)).bit_length() + 2)
        for k in itertools.count(1):
            self.mult, self.shift = np.uint64((0x9E3779B97F4A7C15 * k | 1) % 2**64), np.uint64(64 - bits)
            at = (keys * self.mult) >> self.shift
            order = np.argsort(at, kind="stable")
            ranked = np.arange(len(at)) - np.searchsorted(at[order], at[order])
            if not len(at) or ranked.max() < 4:
                break
        self.pair_keys = np.full((1 << bits, 4), np.uint64(2**64 - 1))
        self.pair_ranks = np.full((1 << bits, 4), _BIG)
        seen = order[np.unique(keys[order], return_index=True)[1]] if len(at) else order
        place = np.zeros(len(at), np.int64)
        place[order] = ranked
        self.pair_keys[at[seen], place[seen]] = keys[seen]
        self.pair_ranks[at[seen], place[seen]] = 256 + seen

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        at = (keys * self.mult) >> self.shift
        return np.where(self.pair_keys[at] == keys[:, None], self.pair_ranks[at], _BIG).min(1)

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the texts of tokens a and b, one after the other, are encoded as just these two.

        The tokens at the border are followed back in time: whichever of the two was made by the later merge is undone.
        If two that met there have a merge of their own that comes before the next merge of either, they would have
        merged; among equal merges the left one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), _BIG)  # the pair's merge must not come before this
        while len(open_):
            x, y, limit = a[open_], b[open_], until[open_]
            merged = self._rank(x, y) < limit
            good[open_[merged]] = False
            go = ~merged & ((x >= 256) | (y >= 256))
            open_, x, y = open_[go], x[go], y[go]
            undo_left = (x > y) & (x >= 256) | (y < 256)
            a[open_] = np.where(undo_left, self.second[x], x)
            b[open_] = np.where(undo_left, y, self.first[y])
            until[open_] = np.where(undo_left, x, y + 1)
        return good

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.array([len(p) for p in raw], np.int64)
        by_length = np.argsort(-length, kind="stable")  # longest first: at each step those still open are in front
        raw, length = [raw[i] for i in by_length], length[by_length]
        begin = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(raw), np.uint8)
        cells = np.cumsum(length + 1) - (length + 1)  # of prefixes 0..n
        last = np.full(int((length + 1).sum()), -1, np.int32)
        state = np.zeros(len(raw), np.int32)
        active = len(raw)
        for j in range(1, int(length[0]) + 1 if len(raw) else 0):
            active = int(np.searchsorted(-length[:active], -j, side="right"))
            state = self._next(state[:active], flat[begin[:active] + j - 1])
            token, todo = self.longest[state], np.arange(active)
            while len(todo):
                t = token[todo]
                before = j - self.size[t]
                left = last[cells[todo] + before]
                good = before == 0
                test = np.flatnonzero(~good)
                good[test] = self.stay_apart(left[test], t[test])
                last[cells[todo[good]] + j] = t[good]
                todo = todo[~good]
                token[todo] = self.shorter[token[todo]]
        # back-pointers: token and where it ends, from the last to the first
        at, todo, found = length.copy(), np.flatnonzero(length), []
        while len(todo):
            t = last[cells[todo] + at[todo]]
            found.append((todo, at[todo], t))
            at[todo] -= self.size[t]
            todo = todo[at[todo] > 0]
        which, end, token = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        which = by_length[which]
        order = np.lexsort((end, which))
        return self.ids[token[order]], np.bincount(which, minlength=len(raw))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if self.edges is None:  # only decoding needs no automaton
            self._automaton(self.tokens)
            self._pairs()
            self.coder = PieceCoder(self._encode_pieces, self.added)
        return self.coder.encode(texts)

    def decode(self, ids: bytes) -> str:
        """The text of ids; ids that the vocabulary lacks give nothing, bytes that are not UTF-8 give U+FFFD."""
        i = np.frombuffer(ids, "<u4")
        i = i[i < len(self.width)]
        n = self.width[i]
        to = np.cumsum(n)
        at = np.repeat(self.begins[i] - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0)
        return self.letters[at].tobytes().decode("utf-8", "replace")


_known: dict[str, Bpe] = {}


def _bpe(shared) -> Bpe:
    """One for each worker process and vocabulary."""
    name = shared.value["name"]
    if name not in _known:
        _known.clear()
        _known[name] = Bpe(shared.value)
    return _known[name]


def share_vocabulary(spark: SparkSession, path: str):
    """Broadcasts the vocabulary: as large as its file, whatever the documents are."""
    return spark.sparkContext.broadcast(load_vocabulary(path))


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text, as little-endian unsigned 32-bit integers in one binary value.

    Null and empty texts have no ids. Strings of added tokens in a text become their ids. Each row gives a row, also
    when ids repeat or are null. A text of any length is encoded whole; only pieces without a break need memory together.
    """
    base = documents_of(docs, id_col, text_col)
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        bpe = _bpe(shared)
        for batch in batches:
            for part in slices(batch, 1):
                out = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), binaries(out, "<u4")], ["doc_id", "ids"])

    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text) of encode()'s rows."""
    shared = share_vocabulary(encoded.sparkSession, vocabulary)

    def run(batches):
        bpe = _bpe(shared)
        for batch in batches:
            for part in slices(batch, 1):
                text = pa.array([bpe.decode(x) if x else "" for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], ["doc_id", "ids", "text"])

    base = encoded.select("doc_id", "ids")
    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text): decode(encode(docs)) by one worker for each task instead of two."""
    base = documents_of(docs, id_col, text_col)
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        bpe = _bpe(shared)
        for batch in batches:
            for part in slices(batch, 1):
                ids = binaries(bpe.encode([t or "" for t in part.column(1).to_pylist()]), "<u4")
                text = pa.array([bpe.decode(x) if x else "" for x in ids.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, text], ["doc_id", "ids", "text"])

    return base.mapInArrow(lean(run), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts."""
    both = round_trip(docs, vocabulary)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts they decode to: (doc_id, n_tokens, ids_sha256, decoded_sha256); a null text is empty."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
