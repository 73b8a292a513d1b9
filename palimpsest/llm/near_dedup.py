"""Near-duplicates: a chosen-path similarity join on minwise tokens, links confirmed on the full shingle sets, and components.

1. Each document gives its set of 5-word shingles, its size, a digest, and minwise tokens: for each of many hashes of
   shingles, the least. Documents of one set are one vertex from here on.
2. Each of ``TREES`` trees deals the vertices into nodes by one of their minwise tokens. Two vertices of similarity s meet in
   a node with chance s, so that 0.25^10, or one in a million, of the pairs at the threshold meet in none.
3. A node's most central vertex, the one whose nodes are largest, stands for it: a vertex that meets the same one in several
   trees is compared with it, which joins groups of copies without all their pairs.
4. Nodes that still hold several components are compared exhaustively if small, but for pairs within a component. A large
   node whose vertices but a few are of one component has these few compared with each other and with all of that
   component; any other large node branches into two children by further tokens, which its path selects, and so on.
5. Comparisons count whole sets, in blocks of bounded bytes: the vertices of a block are counted against those of another at
   once, and of the links found only those go on that the components need: one of a vertex to a component, or a forest.
   No pair is ever a row. Of a node's vertices only those are compared that an estimate finds alike another, from 128
   bytes of each; what is five standard deviations below the threshold passes too, so that 1.1e-6 of the pairs at the
   threshold are dropped by it, in all trees alike.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, checked_broadcast, documents_of, few_parts, lean
from .text_bytes import text_bytes

SHINGLE, TREES, TOKENS, SKETCH = 5, 10, 64, 128
#: Bytes of text that are worked on at once; of the sets of a block, and of those that are compared with a block in one group.
SEGMENT, BLOCK_BYTES, GROUP_BYTES = 250_000, 1_000_000, 4_000_000
#: Vertices that a small node has at most, and what a large one has at most besides its main component to be compared at once; children of a large one; the depth from which every main component goes.
SMALL, FEW, CHILDREN, LAST = 48, 1024, 2, 12
#: Standard deviations of a sketch's estimate below the threshold that pass; trees in which a vertex meets the one that stands for its nodes, at least, to be compared with it.
ROOM, VOTES = 5, 3
#: Labels that are broadcast within a round of the components at most, three times at once; more are joined by shuffles.
LABELS = 200_000

#: Fixed value: an odd base of the words' polynomial hash, which has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
_state: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "powers" not in _state or len(_state["powers"]) < n:
        for name, b in (("powers", _BASE), ("inverses", pow(_BASE, -1, 2**64))):
            _state[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SEGMENT), b, np.uint64)]))
    return _state["powers"], _state["inverses"]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; of fewer words, the one of the whole sequence."""
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    inside = np.concatenate([[False], ~_WHITE[raw], [False]])
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    power, inverse = _powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw] + np.uint64(1)) * power[: len(raw)])])
    words = _mixed((total[stop] - total[start]) * inverse[start])
    chain = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        chain = _mixed(chain * _MIX + words[k : k + len(chain)] + np.uint64(k + 1))
    at, out = np.searchsorted(start, offsets), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.sort(chain[a : b - SHINGLE + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                one = _mixed(one * _MIX + w)
            out.append(one)
        else:
            out.append(chain[:0])
    return out


def _minwise(own: np.ndarray) -> np.ndarray:
    """SKETCH minwise tokens of a set."""
    if "seeds" not in _state:
        r = np.random.default_rng(11)
        _state["seeds"] = r.integers(0, 2**32, (2, SKETCH, 1), dtype=np.uint32)
        _state["seeds"][1] |= np.uint32(1)
    add, times = _state["seeds"]
    low = np.full(SKETCH, 2**32 - 1, np.uint32)
    x = (own >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        h = (x[None, i : i + 1024] ^ add) * times
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        low = np.minimum(low, h.min(1))
    return low


def _texts(batch: pa.RecordBatch):
    """(row, set) of each text of a batch, about SEGMENT bytes at a time."""
    raw, at = text_bytes(batch.column(1))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT, side="right")) - 1)
        yield i, shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).digest()


def _sketch(batches):
    for batch in batches:
        for i, sets in _texts(batch):
            low = [_minwise(s) for s in sets]
            columns = [
                batch.column(0).slice(i, len(sets)),
                batch.column(2).slice(i, len(sets)),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([x[:TOKENS].astype("<u4").tobytes() for x in low], pa.binary()),
                pa.array([x.astype(np.uint8).tobytes() for x in low], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "tokens", "sketch"])


def _sets(batches):
    """(digest, shingles), each set once a batch."""
    for batch in batches:
        seen = set()
        for _, sets in _texts(batch):
            own = {d: s for s in sets if (d := _digest(s)) not in seen}
            seen |= own.keys()
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([s.astype("<u8").tobytes() for s in own.values()], pa.binary())], ["digest", "shingles"])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = np.any([c[1:] != c[:-1] for c in columns], 0)
    return np.flatnonzero(new) if n else np.zeros(1, int)


def _alike(least: float):
    """Of rows (node, label, digest, sketch, roots) in order of their nodes: those whose sketch is alike one of another label in the node.

    ``roots`` are the nodes of depth 0 in which a vertex is compared; a pair with several in common counts in the least of them only.
    """
    least = SKETCH * (least + (1 - least) / 256)

    def some(table: pa.Table):
        node, label = (table.column(i).to_numpy() for i in (0, 1))
        x = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
        roots = [set(r) for r in table.column(4).to_pylist()]
        found, edges = np.zeros(len(x), bool), _runs(node)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = int(node[lo])
            for i in range(lo + 1, hi):
                alike = (label[lo:i] != label[i]) & ((x[lo:i] == x[i]).sum(1) >= least)
                if found[i]:
                    alike &= ~found[lo:i]
                for k in (lo + np.flatnonzero(alike)).tolist():
                    if not (found[i] and found[k]) and at == min(roots[i] & roots[k], default=at):
                        found[i] = found[k] = True
        at = pa.array(np.flatnonzero(found))
        return pa.RecordBatch.from_arrays([table.column(i).combine_chunks().take(at) for i in (0, 2)], ["node", "digest"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # the rows of a node that may go on
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([*held, batch])
                last = int(_runs(table.column(0).to_numpy())[-2])
                if last:
                    yield some(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield some(pa.Table.from_batches(held))

    return run


class _Block:
    """Sets of one side of a comparison; the whole counts of what each shares with other sets."""

    def __init__(self, digests: list[bytes], sets: list[np.ndarray]):
        self.digests, self.sizes = digests, np.array([len(s) for s in sets])
        self.values, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)

    def shared(self, sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
        """One row for each of ``sets``, one column for each of the block's; only shingles of both are laid out, some at a time."""
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        hit = self.values[place] == values
        place, owner = place[hit], owner[hit]
        common = np.unique(place)
        number = np.full(len(self.values), -1)
        number[common] = np.arange(len(common))
        mine, theirs = number[self.at], number[place]
        counts = np.zeros((len(sets), len(self.sizes)), np.float32)
        for c in range(0, len(common), columns):
            width = min(columns, len(common) - c)
            x, y = np.zeros((len(sets), width), np.float32), np.zeros((len(self.sizes), width), np.float32)
            own, other = (mine >= c) & (mine < c + width), (theirs >= c) & (theirs < c + width)
            y[self.owner[own], mine[own] - c] = 1
            x[owner[other], theirs[other] - c] = 1
            counts += x @ y.T
        return counts


def _forest(like: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a square matrix that join the same rows as all of them, and no circle."""
    seen, edges = np.zeros(len(like), bool), []
    for s in range(len(like)):
        if not seen[s]:
            seen[s], front = True, np.array([s])
            while len(front):
                rows = like[front]
                new = np.flatnonzero(rows.any(0) & ~seen)
                edges += zip(front[rows[:, new].argmax(0)].tolist() if len(new) else (), new.tolist(), strict=True)
                seen[new], front = True, new
    return edges


def _compared(percent: int, rows: int = 512):
    """Of rows (key, side, digest, shingles) in order of key and side: for each of side 1 one of side 0 of its key that it is like, if
    any; and of those of side 2 links that join all that are alike."""

    def like(block: _Block, sets: list[np.ndarray]) -> np.ndarray:
        common, sizes = block.shared(sets).astype(np.int64), np.array([len(s) for s in sets])
        return 100 * common >= percent * (sizes[:, None] + block.sizes - common)

    def links(a: list[bytes], b: list[bytes]):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def joined(digests: list[bytes], sets: list[np.ndarray]):
        pairs = _forest(like(_Block(digests, sets), sets))
        return links([digests[i] for i, _ in pairs], [digests[j] for _, j in pairs])

    def run(batches):
        key, digests, sets, block, every = None, [], [], None, False  # of side 0, or with ``every`` of side 2
        for batch in batches:
            keys, sides = (batch.column(i).to_numpy() for i in (0, 1))
            edges = _runs(keys, sides)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if keys[lo] != key or every != (sides[lo] == 2):
                    if every and sets:
                        yield joined(digests, sets)
                    key, digests, sets, block, every = keys[lo], [], [], None, sides[lo] == 2
                if sides[lo] != 1:
                    digests, sets, block = digests + batch.column(2)[lo:hi].to_pylist(), sets + _arrays(batch.column(3), lo, hi), None
                elif sets:
                    block = block or _Block(digests, sets)
                    for i in range(lo, hi, rows):
                        j = min(hi, i + rows)
                        own, found = batch.column(2)[i:j].to_pylist(), like(block, _arrays(batch.column(3), i, j))
                        at = np.flatnonzero(found.any(1))
                        yield links([digests[x] for x in found[at].argmax(1)], [own[x] for x in at])
        if every and sets:
            yield joined(digests, sets)

    return run


def _arrays(column: pa.BinaryArray, lo: int, hi: int) -> list[np.ndarray]:
    """Copies, so that a batch isn't held for a few sets of it."""
    return [np.frombuffer(x.as_buffer(), "<u8").copy() for x in column[lo:hi]]


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(digest, label): the least vertex that each vertex of an edge reaches.

    Each round takes the least label of the neighbours and then that label's own, which halves long paths; aggregates
    and joins only, so no component is ever in one task as a whole. ``edges`` is a stored table.
    """
    rows = 2 * edges.count()
    both = work.save(few_parts(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), rows), f"{name}-edges")
    labels = work.save(few_parts(both.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("digest"), F.least("u", "label").alias("label")), rows), f"{name}-0")
    for i in range(1, 64):
        known = checked_broadcast(labels, LABELS, 64 * LABELS)
        near = both.join(known.select(F.col("digest").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        new = near.join(known.withColumnRenamed("digest", "u"), "u").select(F.col("u").alias("digest"), F.least("label", "near").alias("new"), F.col("label").alias("old"))
        jump = known.select(F.col("digest").alias("new"), F.col("label").alias("further"))
        new = work.save(few_parts(new.join(jump, "new").select("digest", F.least("new", "further").alias("label"), "old"), rows), f"{name}-{i}")
        labels = new.select("digest", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return labels
    raise RuntimeError("components did not settle in 64 rounds")


class _Join:
    def __init__(self, base: DataFrame, percent: int, trees: int, work: Workspace):
        self.base = base.withColumn("text_hash", F.xxhash64("text"))
        self.percent, self.trees, self.work = percent, trees, work
        s = percent / 100
        self.least = s - ROOM * (s * (1 - s) / SKETCH) ** 0.5
        kind = base.schema["doc_id"].dataType.simpleString()
        sketches = self.base.mapInArrow(lean(_sketch), f"doc_id {kind}, text_hash long, n_shingles long, digest binary, tokens binary, sketch binary")
        self.sketches = work.save(sketches, "sketches")
        self.rows = trees * self.sketches.count()  # of a table with a row for each vertex and tree, at most
        linked = self.sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        first = F.min(F.struct("doc_id", "text_hash")).alias("first")
        tokens = F.first("tokens").alias("tokens")
        vertices = linked.groupBy("digest").agg(first, F.count(F.lit(1)).alias("docs"), F.first("n_shingles").alias("n_shingles"), tokens, F.first("sketch").alias("sketch"))
        self.vertices = self.save(vertices, "vertices")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Stores a table of short rows, in as few files as its rows need."""
        return self.work.save(few_parts(df, self.rows), name)

    def likely(self, at: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows (node, digest) of (node, digest, label) whose sketches are alike one of another label in their node; a node has some FEW rows at most.

        roots: (node, digest) of what is compared at depth 0, with others of the node or with its main component.
        """
        roots = roots.groupBy("digest").agg(F.collect_set("node").alias("roots"))
        own = self.vertices.select("digest", "sketch").join(roots, "digest", "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<long>")))
        rows = at.join(own, "digest").select("node", "label", "digest", "sketch", "roots")
        return rows.repartition("node").sortWithinPartitions("node").mapInArrow(lean(_alike(self.least)), "node long, digest binary")

    def groups(self, alike: DataFrame) -> DataFrame:
        """Rows (key, side, digest) that compare all digests of a node of (node, digest), two blocks at a time if it has several."""
        sized = self.vertices.select("digest", (8 * F.col("n_shingles")).alias("bytes")).join(checked_broadcast(alike), "digest")
        sized = self.save(sized, "sized")
        blocks = checked_broadcast(self.save(sized.groupBy("node").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks")), "node-blocks"))
        block = F.pmod(F.xxhash64("digest"), F.col("blocks"))
        other = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda i: (i != F.col("block")) | (F.col("blocks") == 1))).alias("other")
        rows = sized.join(blocks, "node").withColumn("block", block).select("node", "digest", "block", other)
        return rows.select(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")).alias("key"), F.lit(2).alias("side"), "digest")

    def pairs(self, likely: DataFrame) -> DataFrame:
        """Rows (key, side, digest) that compare each b of (a, b) with its a; a vertex of many pairs is in several groups."""
        size = 8 * F.col("n_shingles")
        likely = self.vertices.select(F.col("digest").alias("b"), size.alias("bytes")).join(checked_broadcast(likely), "b")
        groups = checked_broadcast(self.save(likely.groupBy("a").agg(F.ceil(F.sum("bytes") / GROUP_BYTES).cast("int").alias("groups")), "groups"))
        key = lambda group: F.xxhash64("a", group).alias("key")
        right = likely.join(groups, "a").select(key(F.pmod(F.xxhash64("b"), F.col("groups"))), F.lit(1).alias("side"), F.col("b").alias("digest"))
        left = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")).select(key(F.col("group").cast("bigint")), F.lit(0).alias("side"), F.col("a").alias("digest"))
        return left.union(right)

    def blocks(self, outer: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows (key, side, digest) that compare each digest of (digest, main) with all vertices of the component ``main``, block by block."""
        size = F.sum(8 * F.col("n_shingles"))
        vertices = self.vertices.select("digest", "n_shingles")
        outer = self.save(outer.distinct().join(vertices, "digest"), "outer")
        theirs = outer.groupBy("main").agg(F.ceil(size / GROUP_BYTES).cast("int").alias("groups"))
        own = vertices.join(checked_broadcast(labels), "digest", "left").select("digest", "n_shingles", F.coalesce("label", "digest").alias("main"))
        own = self.save(own.join(checked_broadcast(self.save(theirs, "theirs")), "main"), "own")
        both = own.groupBy("main").agg(F.ceil(size / BLOCK_BYTES).cast("int").alias("blocks"))
        both = checked_broadcast(self.save(both, "block-counts"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        key = F.xxhash64("main", F.col("block").cast("bigint"), F.col("group").cast("bigint")).alias("key")
        left = own.join(both, "main").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks"))).withColumn("group", every("groups"))
        right = outer.join(both, "main").join(checked_broadcast(self.work.load("theirs")), "main")
        right = right.withColumn("group", F.pmod(F.xxhash64("digest"), F.col("groups"))).withColumn("block", every("blocks"))
        return left.select(key, F.lit(0).alias("side"), "digest").union(right.select(key, F.lit(1).alias("side"), "digest"))

    def compare(self, rows: DataFrame, name: str) -> DataFrame:
        """The links (a, b) among rows (key, side, digest), by whole sets."""
        rows = self.work.save(rows, f"{name}-rows")
        needed = checked_broadcast(self.save(rows.select("digest").distinct(), f"{name}-needed"))
        ids = self.vertices.join(needed, "digest", "left_semi").select(F.col("first.doc_id").alias("doc_id")).distinct()
        ids = checked_broadcast(self.save(ids, f"{name}-ids"))
        sets = self.base.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lean(_sets), "digest binary, shingles binary")
        both = sets.join(checked_broadcast(rows), "digest").select("key", "side", "digest", "shingles")
        links = both.repartition("key").sortWithinPartitions("key", "side").mapInArrow(lean(_compared(self.percent)), "a binary, b binary")
        return self.work.save(links, f"{name}-links")

    @staticmethod
    def token(i):
        return F.substring("tokens", 4 * i + 1, 4) if isinstance(i, int) else F.col("tokens").substr(4 * i + 1, F.lit(4))

    def labels(self) -> DataFrame:
        """(digest, label): the least vertex that each vertex of a link reaches."""
        roots = F.array(*[F.xxhash64(F.lit(t), self.token(t)) for t in range(self.trees)])
        dealt = self.vertices.select("digest", F.explode(roots).alias("node"))
        nodes = self.save(dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nodes")
        members = self.save(dealt.join(checked_broadcast(nodes), "node"), "members")
        weights = checked_broadcast(self.save(members.groupBy("digest").agg(F.sum("n").alias("weight")), "weights"))
        central = members.join(weights, "digest").groupBy("node").agg(F.max(F.struct("weight", "digest"))["digest"].alias("pivot"))
        central = checked_broadcast(self.save(central, "central"))
        # what meets one vertex in several trees is likely like it; the rest is left to the second round
        often = members.join(central, "node").where(F.col("digest") != F.col("pivot")).groupBy(F.col("pivot").alias("a"), F.col("digest").alias("b")).count()
        likely = self.save(often.where(F.col("count") >= VOTES).select("a", "b"), "often")
        links = self.compare(self.pairs(likely), "first")
        labels = components(links, self.work, "first")
        at = members.select("node", "digest").join(checked_broadcast(labels), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
        small, ripe = [], []  # of all depths: (node, digest, label), and (digest, main)
        for depth in itertools.count():
            own = at.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
            mixed = own.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("main")).where("labels > 1")
            mixed = self.save(mixed.select("node", "n", F.col("main.n").alias("n_main"), F.col("main.label").alias("main")), f"mixed-{depth}")
            at = self.save(at.join(checked_broadcast(mixed), "node"), f"at-{depth}")
            large = F.col("n") > SMALL
            nearly = large & (F.col("n") - F.col("n_main") <= FEW)
            rest, late = F.col("label") != F.col("main"), F.lit(depth >= LAST)
            small.append(at.where(~large | nearly & rest).select("node", "digest", "label"))
            ripe.append(at.where((nearly | large & late) & rest).select("digest", "main"))
            if not depth:
                roots = at.where(~large | nearly).select("node", "digest")
            down = at.where(large & ~nearly & (rest | ~late)).select("digest", "label", "node")
            if down.isEmpty():
                break
            chosen = F.explode(F.array_distinct(F.array(*[F.pmod(F.xxhash64("node", F.lit(j)), F.lit(TOKENS)).cast("int") for j in range(CHILDREN)]))).alias("chosen")
            down = self.vertices.select("digest", "tokens").join(checked_broadcast(down), "digest").select("digest", "label", "tokens", "node", chosen)
            at = self.save(down.select(F.xxhash64("node", "chosen", self.token(F.col("chosen"))).alias("node"), "digest", "label"), f"down-{depth}")
        alike = self.work.save(self.likely(reduce(DataFrame.union, small), roots), "alike")
        found = self.compare(self.groups(alike).union(self.blocks(reduce(DataFrame.union, ripe), labels)), "second")
        for name in ("nodes", "members", "weights", "central", "groups", "node-blocks", "often", "alike", "sized", "outer", "own", "first-needed", "second-needed", *[f"{x}-{d}" for x in ("at", "down", "mixed") for d in range(depth + 1)], "first-rows", "second-rows"):
            self.work.drop(name)
        return self.merged(labels, found)

    def merged(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """(digest, label) after more links: a component of ``labels`` is one vertex of them, and what several of its blocks found alike is one link."""
        known = checked_broadcast(labels)
        of = lambda end: known.select(F.col("digest").alias(end), F.col("label").alias(f"of_{end}"))
        ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        short = self.save(ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "joined")
        further = components(short, self.work, "all")
        own = labels.join(checked_broadcast(further.select(F.col("digest").alias("label"), F.col("label").alias("least"))), "label", "left").select("digest", F.coalesce("least", "label").alias("label"))
        return self.save(own.union(further.join(known.select("digest"), "digest", "left_anti")), "labels")


def near_duplicates(docs: DataFrame, percent: int = 75, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, representative): the smallest doc_id that links of ``percent`` similarity reach.

    Words are what ASCII white space parts, with A-Z lower-cased. A document of fewer than five words, but not none, has its whole
    sequence as its one shingle. Documents without words (null texts too) and those with a null id are linked with nothing:
    component_id is the doc_id, and ``kept`` is true. Each row is a document; rows of one text are in one component, repeated
    rows of one doc_id give a row each. ``representative`` is true for those whose doc_id and then text hash are the least of
    their component, so that one text of each group has it even where doc_ids repeat. Links are never wrong; of the pairs
    at the threshold some two in a million are missed, if large nodes branch up to 1.7e-5, and fewer as the similarity rises.
    """
    join = _Join(documents_of(docs, id_col, text_col), percent, trees, work or Workspace(docs.sparkSession, "near-dedup"))
    labels = checked_broadcast(join.labels())
    classed = join.save(join.vertices.select("digest", "first").join(labels, "digest"), "labelled")
    least = classed.groupBy("label").agg(F.min("first").alias("least"))
    copies = join.vertices.where("docs > 1").join(labels, "digest", "left_anti").select(F.col("digest").alias("d"), F.col("first").alias("least"))
    found = checked_broadcast(join.save(classed.join(least, "label").select(F.col("digest").alias("d"), "least").union(copies), "components"))
    rows = join.sketches.select("doc_id", "n_shingles", "digest", "text_hash")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = rows.join(found, linked & (F.col("digest") == F.col("d")), "left")
    component = F.coalesce("least.doc_id", "doc_id")
    least = F.col("least").isNull() | (F.struct("doc_id", "text_hash") == F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash", least.alias("representative"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: (doc_id, n_shingles, component_id, kept); without words a document is alone.

    The stage tables that the result is made of lie in ``spark.checkpoint.dir`` for as long as it is to be read.
    """
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
