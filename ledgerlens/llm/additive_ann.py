"""Operator 9: approximate nearest neighbours by additive quantisation.

Codebooks of full-dimensional codewords are fitted to a bounded sample (k-means of the residuals, then
one least-squares refinement of all codebooks together). Every vector is encoded by a beam search over
the codebooks and stored as its codes and its norm over that of its reconstruction. Queries, in blocks,
meet the codes, in blocks: inner products with the reconstruction come from lookup tables and are set right
by the stored norms (a reconstruction is shorter than its vector, the more so the worse it is coded), and
the best ``rerank`` of each block of codes are scored exactly in double precision on the original vectors.

Vectors that are null, empty, zero or hold a null or non-finite component take no part; neither do
null ids or vectors whose length is not the commonest one. Ties go to the smaller id. A repeated
vec_id is one vector (its smallest by value). A table of fewer than k + 1 vectors gives what there is. An
empty table gives no rows; further columns are ignored.

Scale: queries are a fixed share of the rows, so the pairs of blocks grow with the square of the
input by definition; each pair of blocks is one bounded piece of work that sends on k rows a query.
A vector is sent once for each block of queries, with its codes: fetching the reranked ones afterwards would
send ``rerank`` vectors for each query and block of codes, a hundred times as much. Vectors travel in the type
that the table has; products are taken in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import ship


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v keeps floats as floats, all else is double."""
    v = F.col("embedding") if dict(table.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(good, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _kmeans(x: np.ndarray, k: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    c = x[r.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[r.choice(len(x), len(empty))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """uint8[len(x), M]: codes by beam search; `books` is [M, K, dim]."""
    m, k, _ = books.shape
    n = len(x)
    codes = np.zeros((n, 1, 0), np.uint8)
    rest = x[:, None, :]
    for j in range(m):
        c = books[j]
        cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ c.T + (c * c).sum(1)
        flat = cost.reshape(n, -1)
        width = min(beam if j < m - 1 else 1, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        of, code = best // k, best % k
        at = np.arange(n)[:, None]
        codes = np.concatenate([codes[at, of], code[:, :, None].astype(np.uint8)], axis=2)
        rest = rest[at, of] - c[code]
    return codes[:, 0, :]


def rebuild(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def fit(x: np.ndarray, codebooks: int, words: int, beam: int, seed: int = 3) -> np.ndarray:
    """[codebooks, words, dim]"""
    r = np.random.default_rng(seed)
    rest, books = x.copy(), []
    for _ in range(codebooks):
        c = _kmeans(rest, words, 8, r)
        books.append(c)
        rest = rest - c[((c * c).sum(1)[None, :] - 2 * rest @ c.T).argmin(1)]
    books = np.stack(books)
    codes = encode(x, books, beam)
    hot = np.zeros((len(x), codebooks * words))
    for j in range(codebooks):
        hot[np.arange(len(x)), j * words + codes[:, j].astype(int)] = 1
    gram = hot.T @ hot + 0.5 * np.eye(hot.shape[1])
    better = np.linalg.solve(gram, hot.T @ x + 0.5 * books.reshape(-1, x.shape[1])).reshape(books.shape)
    return better.astype(np.float32)


def search(table: DataFrame, k: int = 20, every: int = 20, codebooks: int = 32, words: int = 64, beam: int = 4, rerank: int = 400, sample_rows: int = 8_000, block: int = 16_384, query_block: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, its k nearest others."""
    spark = table.sparkSession
    ship(spark)
    vectors = usable(table)
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    out_type = "query_id long, rank int, vec_id long, score double"
    if not len(drawn):
        return spark.createDataFrame([], out_type)
    size = drawn.v.map(len)
    dim = int(size.mode().iloc[0])
    x = np.stack([np.asarray(v, np.float64) for v in drawn.v[size == dim]])
    books = fit(x, codebooks, words, beam)
    vectors = vectors.where(F.size("v") == dim)

    def coded(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
            codes = np.concatenate([encode(v[i : i + 1024], books, beam) for i in range(0, len(v), 1024)])
            norm = np.linalg.norm(v, axis=1) / np.maximum(np.linalg.norm(rebuild(codes, books), axis=1), 1e-30)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float32())], names=["vec_id", "v", "codes", "norm"])

    n = table.count()
    code_blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n // (every * query_block)))
    pick = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    codes = vectors.mapInArrow(coded, f"vec_id long, v {dict(vectors.dtypes)['v']}, codes binary, norm float").withColumn("cb", pick("vec_id", code_blocks))
    queries = vectors.where(F.col("vec_id") % every == 0).withColumn("qb", pick("vec_id", query_blocks))
    blocks_of = lambda df, name, parts: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        of = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            qid, q, vid, v = left.column("vec_id").to_numpy(), of(left), right.column("vec_id").to_numpy(), of(right)
            code = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(vid), -1)
            norm = right.column("norm").to_numpy()
            columns = [np.ascontiguousarray(code[:, j]) for j in range(codebooks)]
            take = min(rerank + 1, len(vid))
            for i in range(len(qid)):
                table = books @ q[i].astype(np.float32)
                total = table[0][columns[0]]
                for j in range(1, codebooks):
                    total += table[j].take(columns[j])
                total *= norm
                # all that equal the last one kept stay too, so that ties are told by the exact score and the id
                top = np.flatnonzero(total >= np.partition(total, len(vid) - take)[len(vid) - take])
                top = top[vid[top] != qid[i]]
                score = (v[top] * q[i]).sum(axis=1)  # each row is added up alike: equal vectors have equal bits
                best = np.lexsort((vid[top], -score))[:k]
                a.append(np.full(len(best), qid[i]))
                b.append(vid[top[best]])
                s.append(score[best])
        return pa.table({"query_id": np.concatenate(a), "vec_id": np.concatenate(b), "score": np.concatenate(s)})

    left = blocks_of(queries, "cb", code_blocks)
    right = blocks_of(codes.select("vec_id", "v", "codes", "norm", "cb"), "qb", query_blocks)
    scored = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
