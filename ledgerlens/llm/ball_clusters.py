"""Operator 11: centroid clustering with ball-tree filtering, in whole numbers.

Vectors are floored to whole numbers and written once, in blocks of ``BLOCK`` of a partition, each with its own metric
tree. A node of a tree has a centre (whole numbers), a radius around it, and the count, the sum and the sum of squares
of its vectors. In a round a ball goes from the root of its tree down: if even its farthest vector is nearer to
one centroid than its nearest to any other, by the triangle inequality, the whole ball is that centroid's, and its
count and sums are added without a look at its vectors; if not, its halves are asked; vectors in leaves
are measured exactly. Balls are told apart with a margin above the rounding of their distances, and what is near a
tie goes down to the leaves, where distances are whole numbers, so results are those of the plain method.

A round is one map over the blocks, which sends on one row a centroid and block batch; the driver gets sums for
``centroids`` centroids. Blocks lie in the shared folder, so a lost task reads its own again.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no part; zero
vectors do; each row is a vector, so a repeated id counts each time, and may be two first centroids; a null id never is
one, but is clustered and returned; equal centroids: the smaller number gets the vectors, the other stays empty as it
is; fewer vectors than centroids: as many centroids as vectors; an empty table gives no rows; further columns are ignored.
Components are held within ``MOST`` on either side (64 x within 2**22), where squared distances are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import give_back, map_batches, ship
from .scratch import Scratch

BLOCK, LEAF = 4096, 24
MOST = 1 << 22
OUTPUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_TREES = "ids array<long>, vectors binary, nodes binary"


def whole_vectors(table: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): the rows that take part, with v as whole numbers."""
    e = F.col("embedding")
    good = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x.cast("double") * scale))))).cast("int")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).withColumnRenamed("e", "embedding").where(F.coalesce(good, F.lit(False)))
    return rows.select("vec_id", F.transform("embedding", whole).alias("v"))


def grow_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes): a node is (first, end, left, right, square sum, radius squared, sum..., centre...), in
    whole numbers, over rows first to end of the ordered ones; leaves have left = -1. The root is the first node."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while todo:
        a, z, above, side = todo.pop()
        part = x[order[a:z]]
        total = part.sum(0)
        centre = total // (z - a)
        far = ((part - centre) ** 2).sum(1)
        me = len(nodes)
        nodes.append(np.concatenate(([a, z, -1, -1, (part * part).sum(), far.max()], total, centre)))
        if above >= 0:
            nodes[above][2 + side] = me
        if z - a > LEAF and far.max() > 0:
            one = part[far.argmax()]
            other = part[((part - one) ** 2).sum(1).argmax()]
            along = part @ (other - one)
            half = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(along, half)]
            todo += [(a + half, z, me, 1), (a, a + half, me, 0)]
    return order, np.stack(nodes)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances int64[len(x), len(c)]. Products are taken in doubles where their sums stay below 2**53."""
    if not len(x):
        return np.zeros((0, len(c)), np.int64)
    most = max(np.abs(x).max(), np.abs(c).max())
    if x.shape[1] * int(most) ** 2 < 1 << 51:
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return np.stack([((x - k) ** 2).sum(1) for k in c], axis=1)


def filter_tree(x: np.ndarray, nodes: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid of each ordered row, node that was taken whole for it or -1) for a tree over the ordered rows x."""
    dim = x.shape[1]
    centre, radius = nodes[:, 6 + dim :], np.sqrt(nodes[:, 5].astype(np.float64))
    mine, whole = np.empty(len(x), np.int64), np.full(len(x), -1)
    seen = np.unique(c, axis=0, return_index=True)[1]
    seen.sort()  # of equal centroids only the first can get a vector
    level = np.zeros(1, np.int64)
    leaves = []
    while len(level):
        d = np.sqrt(_squares(centre[level], c[seen]).astype(np.float64))
        best = d.argmin(1)
        at = np.arange(len(level))
        near = d[at, best]
        d[at, best] = np.inf
        sure = d.min(1) - near > 2 * radius[level] + 1e-6 * (1 + near)
        for k, j in zip(level[sure].tolist(), seen[best[sure]].tolist()):
            a, z = nodes[k, 0], nodes[k, 1]
            mine[a:z], whole[a:z] = j, k
        rest = level[~sure]
        leaf = nodes[rest, 2] < 0
        leaves += rest[leaf].tolist()
        level = nodes[rest[~leaf], 2:4].ravel()
    if leaves:
        at = np.concatenate([np.arange(nodes[k, 0], nodes[k, 1]) for k in leaves])
        mine[at] = _squares(x[at], c).argmin(1)  # the first of equal ones
    return mine, whole


def _trees(vectors: DataFrame, dim: int) -> DataFrame:
    """A row for each block: ids and vectors in the tree's order, and its nodes."""

    def run(batches):
        ids, rows, n = [], [], 0

        def block():
            x = np.concatenate(rows)
            order, nodes = grow_tree(x)
            i = pa.chunked_array(ids).take(pa.array(order)).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), i), pa.array([x[order].astype(np.int32).tobytes()], pa.binary()), pa.array([nodes.tobytes()], pa.binary())], names=["ids", "vectors", "nodes"]
            )

        try:
            for b in batches:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
                for a in range(0, len(v), BLOCK):
                    piece = v[a : a + BLOCK]
                    if n and n + len(piece) > BLOCK:
                        yield block()
                        ids, rows, n = [], [], 0
                    ids.append(b.column(0).slice(a, len(piece)))
                    rows.append(piece)
                    n += len(piece)
            if n:
                yield block()
        finally:
            give_back()

    return vectors.mapInArrow(run, _TREES)


def _read(b: pa.RecordBatch, dim: int):
    """(ids, vectors, nodes) of each block of a batch."""
    for i, x, nodes in zip(b.column(0), b.column(1), b.column(2)):
        yield i.values, np.frombuffer(x.as_buffer(), np.int32).reshape(-1, dim).astype(np.int64), np.frombuffer(nodes.as_buffer(), np.int64).reshape(-1, 6 + 2 * dim)


def _assigned(trees: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(count, sum, inertia) of each centroid's vectors: one map, then sums of a row for each centroid and task."""
    k, dim = c.shape

    def make():
        def f(b):
            count, total, square = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
            for _, x, nodes in _read(b, dim):
                mine, whole = filter_tree(x, nodes, c)
                taken = np.unique(whole[whole >= 0])
                j = mine[nodes[taken, 0]]
                np.add.at(count, j, nodes[taken, 1] - nodes[taken, 0])
                np.add.at(total, j, nodes[taken, 6 : 6 + dim])
                np.add.at(square, j, nodes[taken, 4])
                single = np.flatnonzero(whole < 0)
                np.add.at(count, mine[single], 1)
                np.add.at(total, mine[single], x[single])
                np.add.at(square, mine[single], (x[single] ** 2).sum(1))
            some = np.flatnonzero(count)
            return [some, count[some], square[some], total[some].tolist()] if len(some) else None

        return f

    part = map_batches(trees, "k int, n long, square long, total array<long>", make)
    sums = part.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("square").cast("decimal(38,0)")).alias("square"), F.array(*[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")) for i in range(dim)]).alias("total"))
    count, total, inertia = np.zeros(k, object), np.zeros((k, dim), object), [0] * k
    for r in sums.collect():  # a row for each centroid
        count[r.k], total[r.k] = int(r.n), [int(v) for v in r.total]
        own = [int(v) for v in c[r.k]]
        inertia[r.k] = int(r.square) - 2 * sum(a * b for a, b in zip(own, total[r.k])) + int(r.n) * sum(v * v for v in own)
    return count, total, inertia


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest hash of their ids; of equal ids the smaller vector first."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(table: DataFrame, centroids: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """OUTPUT, a row for each vector that takes part."""
    spark = table.sparkSession
    ship(spark)
    vectors = whole_vectors(table, dim, scale)
    c = first_centroids(vectors, centroids)
    if not len(c):
        return spark.createDataFrame([], OUTPUT)
    trees = Scratch(spark).keep(_trees(vectors, dim))
    for _ in range(rounds):
        count, total, _ = _assigned(trees, c)
        c = np.array([[v // int(n) for v in t] if n else list(old) for n, t, old in zip(count, total, c)], np.int64)
    inertia = _assigned(trees, c)[2]
    names = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]

    def make():
        def f(b):
            out: list[list] = [[], [], []]
            for ids, x, nodes in _read(b, dim):
                mine, _ = filter_tree(x, nodes, c)
                out[0] += ids.to_pylist()
                out[1] += mine.tolist()
                out[2] += ((x - c[mine]) ** 2).sum(1).tolist()
            return [*out, [inertia[j] for j in out[1]], [sum(inertia)] * len(out[0]), [names[j] for j in out[1]]]

        return f

    return map_batches(trees, OUTPUT, make)
