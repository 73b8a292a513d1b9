"""Token ids in files: canonical, length-limited Huffman codes from the counts of all ids, in blocks that decode on their own.

A file is a Parquet file whose rows are blocks, in the order of the documents. A block holds whole documents, about
``BLOCK_IDS`` ids together: their ids and sizes, the bits of all codes, and for each run of ``RUN`` ids how many bits it
takes, so that decoding starts at every run: a table gives the id and the length of the code that the next bits begin with,
for all runs of many blocks at once. The code lengths are in a table beside the blocks.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import vocabulary_path
from .common import Workspace, checked_broadcast, documents_of, lean
from .pieces import PieceCoder, binaries, slices

BLOCK_IDS, RUN, MAX_BITS = 65_536, 64, 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code, 0 without occurrences: the shortest total under the limit, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need codes of more than {max_bits} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    own = counts[order].astype(np.float64)
    level, singles = own, [np.ones(len(own), bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([own, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        singles.append(at < len(own))
    take, bits = 2 * len(own) - 2, np.zeros(len(own), np.uint8)
    for single in reversed(singles):
        n = int(single[:take].sum())
        bits[:n] += 1
        take = 2 * (take - n)
    out[order] = bits
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes ascend by length, then by symbol."""
    codes, code, last = np.zeros(len(bits), np.uint64), 0, 0
    for s in np.lexsort((np.arange(len(bits)), bits)).tolist():
        if b := int(bits[s]):
            code <<= b - last
            codes[s], last = code, b
            code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> tuple[bytes, bytes]:
    """The ids' bits, and the bits of each run of RUN ids as unsigned 16-bit integers."""
    n = bits[ids].astype(np.int64)
    stop = np.cumsum(n)
    at = stop - n
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    words = np.zeros(int(stop[-1] >> 5) + 2 if len(n) else 0, np.uint64)
    if len(n):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    runs = np.add.reduceat(n, np.arange(0, len(n), RUN)) if len(n) else n
    return words.astype(">u4").tobytes(), runs.astype("<u2").tobytes()


class Table:
    """The symbol and the length of the code that any MAX_BITS bits begin with."""

    def __init__(self, bits: np.ndarray, max_bits: int = MAX_BITS):
        codes, self.max_bits = canonical_codes(bits), max_bits
        self.symbol, self.length = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
        order = np.lexsort((np.arange(len(bits)), bits))
        order = order[bits[order] > 0]
        n = bits[order].astype(np.int64)
        begin, width = codes[order].astype(np.int64) << (max_bits - n), np.int64(1) << (max_bits - n)
        end = int((begin + width).max()) if len(n) else 0
        self.symbol[:end] = np.repeat(order, width)
        self.length[:end] = np.repeat(bits[order], width)

    def unpack(self, payloads: list[bytes], runs: list[bytes], sizes: list[int]) -> np.ndarray:
        """The ids of some blocks, one after the other."""
        total = sum(sizes)
        out = np.zeros((-(-total // RUN) + len(sizes), RUN), np.uint32)
        raw = np.frombuffer(b"".join([*payloads, b"\0\0\0\0"]), np.uint8).astype(np.uint32)
        ahead = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        starts, lengths, base = [], [], 0
        for payload, run, size in zip(payloads, runs, sizes, strict=True):
            n = np.frombuffer(run, "<u2").astype(np.int64)
            starts.append(base + np.cumsum(n) - n)
            lengths.append(np.minimum(RUN, size - RUN * np.arange(len(n))))
            base += 8 * len(payload)
        at = np.concatenate([np.zeros(0, np.int64), *starts])
        length = np.concatenate([np.zeros(0, np.int64), *lengths])
        out = out[: len(at)]
        limit, drop = 8 * (len(ahead) - 1), 24 - self.max_bits
        for j in range(RUN if len(at) else 0):
            w = (ahead[np.minimum(at, limit) >> 3] >> (drop - (at & 7)).astype(np.uint32)) & np.uint32((1 << self.max_bits) - 1)
            out[:, j] = self.symbol[w]
            at += self.length[w]
        return out[np.arange(RUN) < length[:, None]]


class _Library:
    """Ids of texts by the tokenizers library's model, which sees each distinct piece once for long."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.model._resize_cache(0)  # pieces are new each time
        every = "".join(map(chr, [*range(0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x10000)]))
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(every)
        self.letters = np.zeros(256, "<u2")  # of each byte that UTF-8 has
        self.letters[list(every.encode())] = [ord(c) for c in level[0][0]]
        added = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.coder = PieceCoder(self._ids, added, bits=22)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces that are cut already: straight from the library's model, as its pipeline makes several objects for each."""
        if self.normalizer:
            pieces = [self.normalizer.normalize_str(p) for p in pieces]
        raw = np.frombuffer(b"\xff".join([p.encode() for p in pieces]), np.uint8)
        tokenize = self.model.tokenize
        ids = [[t.id for t in tokenize(p)] for p in self.letters[raw].tobytes().decode("utf-16-le").split("\0")]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


_library: dict[str, _Library] = {}


def tokenize(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """(doc_id, ids): the library's ids of each whole text and then ``end_id``, little-endian, two bytes each if all ids fit.

    The vocabulary file must be at ``vocabulary`` on every executor, as the library reads it from there.
    """

    def run(batches):
        if vocabulary not in _library:
            _library[vocabulary] = _Library(vocabulary)
        library = _library[vocabulary]
        width = _width(library.tokenizer.get_vocab_size())
        end = np.uint32(end_id)
        for batch in batches:
            for part in slices(batch, 1):
                ids = library.coder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), binaries([np.append(x, end) for x in ids], width)], ["doc_id", "ids"])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _vocabulary_size(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary).get_vocab_size()


def count_ids(tokens: DataFrame, width: str, size: int) -> np.ndarray:
    """How often each id occurs in all documents; one row for each id and task is shuffled, one for each id comes back."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                total += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for id_, n in tokens.select("ids").mapInArrow(lean(run), "id int, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[id_] = n
    return counts


def write_ids(docs: DataFrame, vocabulary: str, work: Workspace, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the blocks and the code lengths of all documents, by ascending doc_id (nulls first; ties by a hash of their ids).

    Null texts count as empty: they have the end id only. No documents: no blocks.
    """
    spark = docs.sparkSession
    base = documents_of(docs, id_col, text_col)
    size = max(_vocabulary_size(vocabulary), end_id + 1)
    width = _width(size)
    tokens = work.save(tokenize(base, vocabulary, end_id), "tokens", compression="zstd")
    bits = code_lengths(count_ids(tokens, width, size))
    work.save(spark.createDataFrame([(bits.tobytes(),)], "bits binary"), "code_lengths")
    shared = spark.sparkContext.broadcast(bits)
    id_type = T.ArrayType(base.schema["doc_id"].dataType)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("doc_ids", id_type), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("n", T.IntegerType()), T.StructField("runs", T.BinaryType()), T.StructField("payload", T.BinaryType())])

    def run(batches):
        bits, part, begin = shared.value, TaskContext.get().partitionId(), 0
        codes = canonical_codes(bits)
        ids, raw, n = [], [], 0

        def block():
            tokens = np.frombuffer(b"".join(raw), width)
            payload, runs = pack(tokens, codes, bits)
            sizes = [len(x) // int(width[2]) for x in raw]
            columns = [pa.array([part], pa.int32()), pa.array([begin], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int32())), pa.array([len(tokens)], pa.int32()), pa.array([runs], pa.binary()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                raw.append(x)
                n += len(x) // int(width[2])
                if n >= BLOCK_IDS:
                    yield block()
                    ids, raw, begin, n = [], [], begin + n, 0
        if ids:
            yield block()

    tie = F.xxhash64("ids")  # what the ranges are sampled by comes to the driver: a hash, not the ids
    ordered = tokens.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "ids")
    work.save(ordered.mapInArrow(lean(run), schema), "blocks", compression="none")


def read_ids(work: Workspace) -> DataFrame:
    """(doc_id, start, ids) from the files: ids of all documents before it, and its own as little-endian unsigned 32-bit integers."""
    blocks, lengths = work.load("blocks"), work.load("code_lengths")
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(np.frombuffer(lengths.head()["bits"], np.uint8))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))  # one row a file
    parts = work.save(parts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("before")), "parts")
    placed = blocks.join(checked_broadcast(parts), "part").select((F.coalesce("before", F.lit(0)) + F.col("begin")).alias("begin"), "doc_ids", "sizes", "n", "runs", "payload")
    kind = blocks.schema["doc_ids"].dataType.elementType

    def run(batches):
        table = Table(shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 8)
                at += 8
                begin, _, sizes, n, runs, payload = (c.to_pylist() for c in part.columns)
                ids = table.unpack(payload, runs, n).astype("<u4").tobytes()
                size = np.concatenate([np.array(s, np.int64) for s in sizes])
                stop = np.cumsum(size)
                first = np.cumsum([0, *n[:-1]])
                starts = stop - size + np.repeat(np.array(begin) - first, [len(s) for s in sizes])
                own = [ids[4 * (e - k) : 4 * e] for e, k in zip(stop.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(1).flatten(), pa.array(starts), pa.array(own, pa.binary())], ["doc_id", "start", "ids"])

    return placed.mapInArrow(lean(run), T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())]))


def op6_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ids and read back: (doc_id, start, n_tokens, ids_crc32); a null text has the end id only.

    The files lie in ``spark.checkpoint.dir`` for as long as the result is to be read.
    """
    work = Workspace(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), work)
    return read_ids(work).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
