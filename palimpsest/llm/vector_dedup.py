"""Near-duplicate vectors: a pivot-permutation index, links confirmed by exact cosines, and components.

1. Equal vectors are one class from here on. Reference points ("pivots") come from a bounded sample that a hash chooses: no two
   of them are linked, and each is the mean of the sample's vectors linked to it.
2. Each class is described by its nearest pivots in order. It belongs to the ball of its nearest one if it lies within half
   the angle of a link: all vectors of a ball are linked with each other, so that a ball is counted and never compared
   within itself, however large it is.
3. A ball is compared with those outside of it that can reach any of its members: the inverted list of its pivot up to one and
   a half times that angle. Of two balls the one of the lesser pivot does it. This finds all links of balls.
4. What is in no ball is put into the inverted lists of each two of its nearest pivots. Vectors share a list if they share so
   many pivots; a pair counts in the list of the least two pivots that it shares.
5. In a list, codes of a byte a component rule out what can't be linked (their error is known, so that nothing is lost), and
   only vectors that may have a partner there are compared by whole vectors in double precision. Long lists are compared block
   by block. A comparison gives each vector's number of links and a forest of links, never a row for a pair.

Step 4 is the only one that can miss a link: one of two vectors whose nearest pivots have less than two in common.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Workspace, checked_broadcast, lean
from .near_dedup import _forest, _runs, components
from .vector_rows import matrices, unit

#: Reference points at most, those that describe a vector, and the sample they come from: vectors and bytes at most.
PIVOTS, NEAREST, SAMPLE, SAMPLE_BYTES = 512, 8, 4096, 16_000_000
#: Vectors of each side that are compared at once.
BLOCK = 2048
#: Room for rounding, of angles and of cosines of codes in single precision.
ROOM = 1e-6
CODE_ROOM = 1e-4


def _described(keep: bool):
    """(vec_id, digest, size, vec) of (vec_id, embedding); without ``keep`` the first two only. Unlinked rows have no digest."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            digest, vec, size = [None] * n, [None] * n, [0] * n
            for at, x in matrices(batch.column(1)):
                for i, row in zip(at.tolist(), np.ascontiguousarray(x + 0.0), strict=True):  # -0.0 is 0.0
                    if row.any():
                        vec[i], size[i] = row.tobytes(), len(row)
                        digest[i] = hashlib.blake2b(vec[i], digest_size=16).digest()
            columns = [batch.column(0), pa.array(digest, pa.binary())]
            if keep:
                columns += [pa.array(size, pa.int32()), pa.array(vec, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "digest", "size", "vec"][: len(columns)])

    return run


def pivots_of(sample: np.ndarray, least: float, most: int = PIVOTS) -> np.ndarray:
    """Reference points of unit vectors: the first ones that aren't linked to one before, each then the mean of those linked to it."""
    chosen = np.zeros((0, sample.shape[1]))
    for x in sample:
        if len(chosen) < most and not (chosen @ x >= least).any():
            chosen = np.vstack([chosen, x])
    near = sample @ chosen.T
    own, total = near.argmax(1), np.zeros_like(chosen)
    linked = near[np.arange(len(sample)), own] >= least
    np.add.at(total, own[linked], sample[linked])
    return unit(total)


def _indexed(pivots: dict[int, np.ndarray], kind: str, least: float):
    """(digest, size, ball, visits, nearest, code, slack) of (digest, size, vec). ``code`` and what is added to cosines of codes for
    their error are null within a ball; ``nearest`` too."""
    half = math.acos(least) / 2
    inside, outside = math.cos(max(0, half - ROOM)), math.cos(min(math.pi, 3 * half + ROOM))

    def one(digests: pa.Array, size: int, u: np.ndarray) -> pa.RecordBatch:
        p = pivots.get(size, np.zeros((0, size)))
        near = u @ p.T
        k = min(NEAREST, len(p))
        top = np.argpartition(-near, k - 1, 1)[:, :k] if 0 < k < len(p) else np.tile(np.arange(k), (len(u), 1))
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), 1, kind="stable"), 1)
        ball = np.where(near.max(1) >= inside, top[:, 0], -1) if k else np.full(len(u), -1)
        free = ball < 0
        visit = (near >= outside) & (free[:, None] | (np.arange(len(p)) < ball[:, None]))
        step = np.maximum(np.abs(u).max(1, keepdims=True), 1e-300) / 127
        code = np.rint(u / step)
        slack = np.sqrt(((code * step - u) ** 2).sum(1))
        some = lambda rows, kind: pa.array([r if f else None for r, f in zip(rows, free.tolist(), strict=True)], kind)
        packed = np.hstack([np.frombuffer(step.astype("<f4").tobytes(), np.int8).reshape(-1, 4), code.astype(np.int8)])
        columns = [
            digests, pa.array(np.full(len(u), size), pa.int32()), pa.array(ball, pa.int32()), pa.array([np.flatnonzero(v).tolist() for v in visit], pa.list_(pa.int32())),
            some(top.tolist(), pa.list_(pa.int32())), some([x.tobytes() for x in packed], pa.binary()), some(slack.tolist(), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["digest", "size", "ball", "visits", "nearest", "code", "slack"])

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                for i in range(0, len(at), BLOCK):
                    some = batch.take(pa.array(at[i : i + BLOCK]))
                    x = np.frombuffer(b"".join(some.column(2).to_pylist()), kind).reshape(-1, size)
                    yield one(some.column(0), size, unit(x))

    return run


def _by_key(rule: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives the rule whole runs of equal values of the first column, of rows in its order, and where they begin and end."""

    def run(batches):
        held: list[pa.RecordBatch] = []  # the last run, which may go on
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([*held, batch])
                edges = _runs(table.column(0).to_numpy())
                last = int(edges[-2])
                if last:
                    yield rule(table.slice(0, last), edges[:-1])
                held = table.slice(last).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield rule(table, np.array([0, table.num_rows]))

    return run


def _likely(least: float):
    """Of the rows (key, side, list, digest, code, slack) of each key: (list, digest) of those whose code may be linked to another's of the other side."""

    def rule(t: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        sides, slack, codes = t.column(1).to_numpy(), t.column(5).to_numpy(), t.column(4).to_pylist()
        found = np.zeros(t.num_rows, bool)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            left, right = _sides(sides[lo:hi])
            if hi - lo < 2 or not len(left) or not len(right):
                continue
            raw = np.frombuffer(b"".join(codes[lo:hi]), np.int8).reshape(hi - lo, -1)
            x = raw[:, 4:].astype(np.float32) * np.frombuffer(raw[:, :4].tobytes(), "<f4")[:, None]
            e, hit = slack[lo:hi], found[lo:hi]
            for i in range(0, len(left), 512):
                own = left[i : i + 512]
                like = x[own] @ x[right].T + CODE_ROOM >= least - e[own, None] - e[right] - e[own, None] * e[right]
                like[own[:, None] == right] = False
                hit[own] |= like.any(1)
                hit[right] |= like.any(0)
        at = pa.array(np.flatnonzero(found))
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(at) for c in (2, 3)], ["list", "digest"])

    return _by_key(rule)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of either side; rows of side 2 are on both."""
    both = np.flatnonzero(side == 2)
    return (both, both) if len(both) else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))


def _linked(kind: str, least: float):
    """Of the rows (key, side, first, second, digest, size, copies, nearest, vec) of each key: (digest, links, near), the number of vectors
    of the other side that each one is linked to, and links that join all that are. Pairs count in the list of the least two pivots they share."""

    def one(u: np.ndarray, sides: np.ndarray, second: int, copies: np.ndarray, nearest: list) -> tuple[np.ndarray, list]:
        left, right = _sides(sides)
        links = np.zeros(len(u), np.int64)
        if not len(left) or not len(right):
            return links, []
        like = np.concatenate([u[left[i : i + 512]] @ u[right].T >= least for i in range(0, len(left), 512)])
        like &= left[:, None] != right
        if second >= 0:  # no pivot up to the second is shared but these two
            shared = np.zeros((len(u), second + 1), np.float32)
            for i, near in enumerate(nearest):
                shared[i, [p for p in near if p <= second]] = 1
            like &= shared[left] @ shared[right].T == 2
        links[left] += (like @ copies[right]).astype(np.int64)
        if left is not right:
            links[right] += (copies[left] @ like).astype(np.int64)
        some = np.flatnonzero(links)
        place = np.full(len(u), -1)
        place[some] = np.arange(len(some))
        square = np.zeros((len(some), len(some)), bool)
        i, j = np.nonzero(like)
        square[place[left[i]], place[right[j]]] = True
        return links, [(int(some[a]), int(some[b])) for a, b in _forest(square | square.T)]

    def rule(t: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        sides, second, size, digests = t.column(1).to_numpy(), t.column(3).to_numpy(), t.column(5).to_numpy(), t.column(4).to_pylist()
        copies, out = t.column(6).to_numpy().astype(np.float64), []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            u = unit(np.frombuffer(b"".join(t.column(8).slice(lo, hi - lo).to_pylist()), kind).reshape(-1, size[lo]))
            links, forest = one(u, sides[lo:hi], int(second[lo]), copies[lo:hi], t.column(7).slice(lo, hi - lo).to_pylist())
            out += [(digests[lo + x], int(links[x]), None) for x in np.flatnonzero(links)]
            out += [(digests[lo + a], 0, digests[lo + b]) for a, b in forest]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["digest", "links", "near"])

    return _by_key(rule)


class _Join:
    def __init__(self, rows: DataFrame, least: float, work: Workspace):
        self.spark, self.least, self.work = rows.sparkSession, least, work
        self.kind = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
        id_kind = rows.schema["vec_id"].dataType.simpleString()
        some = rows.mapInArrow(lean(_described(True)), f"vec_id {id_kind}, digest binary, size int, vec binary")
        some = some.where(F.col("digest").isNotNull() & F.col("vec_id").isNotNull())
        grouped = some.groupBy("digest").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("vec").alias("vec"))
        self.classes = work.save(grouped, "classes")
        # of vectors without an id or a link the identity remains
        self.rows = rows.mapInArrow(lean(_described(False)), f"vec_id {id_kind}, digest binary")

    def pivots(self) -> dict[int, np.ndarray]:
        """Reference points for each size that the sample has. A hash of the vectors chooses it; it has a bounded number of rows and bytes."""
        found = self.classes.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).head()
        if not found["n"]:
            return {}
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * found["size"])))
        rank = F.xxhash64("digest")
        share = min(1.0, 2 * most / found["n"])
        rows = self.classes.where(F.pmod(rank, F.lit(2**31)) < F.lit(int(share * 2**31) + 1)).orderBy(rank, "digest").limit(most).select("size", "vec").collect()
        sizes: dict[int, list[bytes]] = {}
        for r in rows:
            sizes.setdefault(r["size"], []).append(bytes(r["vec"]))
        return {size: pivots_of(unit(np.frombuffer(b"".join(x), self.kind).reshape(-1, size)), self.least) for size, x in sizes.items()}

    def blocked(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Rows (key, side, *columns) that compare side 0 with side 1 of each list of (list, side, *columns), and side 2 with itself, block by block."""
        count = lambda side: F.ceil(F.count(F.when(F.col("side") == side, 1)) / BLOCK).cast("int")
        sizes = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), count(0).alias("left"), count(1).alias("right"), count(2).alias("both"))
        sizes = sizes.where("(left > 0 AND right > 0) OR n > 1 AND both > 0").drop("n")
        own = F.when(F.col("side") == 0, F.col("left")).when(F.col("side") == 1, F.col("right")).otherwise(F.col("both"))
        other = F.when(F.col("side") == 0, F.col("right")).when(F.col("side") == 1, F.col("left")).otherwise(F.col("both"))
        dealt = rows.join(checked_broadcast(self.work.save(sizes, f"sizes-{columns[-1]}")), "list")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("digest"), own).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), other - 1)))
        low, high = F.least("block", "with"), F.greatest("block", "with")
        key = F.when(F.col("side") == 0, F.xxhash64("list", "block", "with")).when(F.col("side") == 1, F.xxhash64("list", "with", "block")).otherwise(F.xxhash64("list", low, high))
        side = F.when((F.col("side") == 2) & (low != high), F.when(F.col("block") == low, 0).otherwise(1)).otherwise(F.col("side"))
        return dealt.select(key.alias("key"), side.alias("side"), *columns)

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(digest, links, near) of comparisons, and (digest, ball, size) of the vectors in balls."""
        work = self.work
        columns = "digest binary, size int, ball int, visits array<int>, nearest array<int>, code binary, slack double"
        index = work.save(self.classes.select("digest", "size", "vec").mapInArrow(lean(_indexed(self.pivots(), self.kind, self.least)), columns), "index")
        # lists of two pivots
        i = F.posexplode("nearest").alias("rank", "a")
        free = index.where("ball < 0").select("digest", "size", "nearest", "code", "slack", i)
        pairs = free.withColumn("b", F.explode(F.slice("nearest", F.col("rank") + 2, NEAREST)))
        pair = F.struct("size", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"))
        # where there are less than two pivots, the one list holds all of the size
        few = index.where("ball < 0 AND size(nearest) < 2").select("digest", "code", "slack", F.struct("size", F.lit(-1).alias("first"), F.lit(-1).alias("second")).alias("list"))
        lists = pairs.select("digest", "code", "slack", pair.alias("list")).union(few).withColumn("side", F.lit(2))
        rows = self.blocked(lists, ["list", "digest", "code", "slack"])
        rows = rows.repartition("key").sortWithinPartitions("key")
        kind = "list struct<size:int,first:int,second:int>, digest binary"
        likely = work.save(rows.mapInArrow(lean(_likely(self.least)), kind).distinct(), "likely")
        # lists of one ball's pivot
        pivot = lambda p: F.struct("size", p.alias("first"), F.lit(-1).alias("second")).alias("list")
        members = index.where("ball >= 0")
        inner = members.select(pivot(F.col("ball")), F.lit(0).alias("side"), "digest")
        outer = index.select("digest", "size", F.explode("visits").alias("p")).select(pivot(F.col("p")), F.lit(1).alias("side"), "digest")
        todo = likely.select("list", F.lit(2).alias("side"), "digest").union(inner).union(outer)
        todo = work.save(self.blocked(todo, ["list", "digest"]), "todo")
        needed = checked_broadcast(work.save(todo.select("digest").distinct(), "needed"))
        whole = self.classes.join(needed, "digest", "left_semi").join(index.select("digest", "nearest"), "digest").select("digest", "size", "copies", "nearest", "vec")
        both = todo.join(whole, "digest").select("key", "side", F.col("list.first").alias("first"), F.col("list.second").alias("second"), "digest", "size", "copies", "nearest", "vec")
        found = both.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_linked(self.kind, self.least)), "digest binary, links long, near binary")
        return work.save(found, "links"), members.select("digest", "size", "ball")


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", work: Workspace | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): how many other rows have a cosine of ``least`` (more than 0, less than 1) or more, and the smallest vec_id that links reach.

    Each row is a vector, repeated rows and ids too. Vectors that are null, empty, zero or hold null or non-finite components, and
    those with a null id, are linked with nothing: component_id is the vec_id, and ``kept`` is true. Vectors of different
    sizes aren't linked. An empty table gives no rows. Cosines are exact; links of dense groups are all found, of pairs
    elsewhere those that share two of their NEAREST pivots (measured on random directions in 64 dimensions: 99.5 % of the pairs
    of cosine 0.9, all of 0.95).
    """
    spark, work = vectors.sparkSession, work or Workspace(vectors.sparkSession, "near-vectors")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    element = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    kind = "array<float>" if element is not None and element.simpleString() == "float" else "array<double>"
    join = _Join(vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast(kind).alias("embedding")), least, work)
    links, members = join.links()
    members = members.join(join.classes.select("digest", "copies"), "digest")
    balls = checked_broadcast(work.save(members.groupBy("size", "ball").agg(F.sum("copies").alias("inside"), F.min("digest").alias("head")), "balls"))
    members = work.save(members.join(balls, ["size", "ball"]).select("digest", "inside", "head"), "members")
    edges = links.where(F.col("near").isNotNull()).select(F.col("digest").alias("a"), F.col("near").alias("b"))
    edges = edges.union(members.where(F.col("digest") != F.col("head")).select(F.col("head").alias("a"), F.col("digest").alias("b")))
    labels = components(edges, work, "all")
    counted = links.groupBy("digest").agg(F.sum("links").alias("links"))
    known = join.classes.select("digest", "first", "copies").join(labels, "digest", "left").join(counted, "digest", "left").join(members.select("digest", "inside"), "digest", "left")
    total = F.coalesce("links", F.lit(0)) + F.coalesce("inside", "copies") - 1
    classed = work.save(known.select(F.col("digest").alias("d"), F.coalesce("label", "digest").alias("label"), "first", total.alias("n_links")), "classed")
    least_id = checked_broadcast(work.save(classed.where("n_links > 0").groupBy("label").agg(F.min("first").alias("component_id")), "least"))
    found = checked_broadcast(work.save(classed.where("n_links > 0").join(least_id, "label").select("d", "n_links", "component_id"), "found"))
    out = join.rows.join(found, F.col("vec_id").isNotNull() & (F.col("digest") == F.col("d")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9: (vec_id, n_links, component_id, kept)."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), u AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS n FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) >= 0.9 * a.n * b.n
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id))::BIGINT AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.a LEFT JOIN least l ON e.vec_id = l.a
"""
