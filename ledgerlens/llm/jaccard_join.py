"""Operator 8: n-gram Jaccard join by T-occurrence search, and its components.

Two documents link when 100 * |x & y| >= 85 * |x | y| over their sets of distinct 4-word shingles.

1. Documents with equal sets are one class (grouped by size and 128-bit fingerprint). From here on only
   classes count, so copies cost one row each. A class is told by its smallest id and a fingerprint; the
   classes that one repeated id falls into are joined by edges, as that id is one document.
2. A linked pair shares ceil(0.85 n) shingles at least, so it shares one of the first
   n - ceil(0.85 n) + 1 under any common order. The order puts shingles that many documents hold last
   (by the logarithm of a hashed count of what tasks have met more than once; the table of counts has a
   fixed size). These first shingles are the keys of lists of classes; the order only decides the work,
   never the result. A pair is only looked at where the place of the shared shingle in either set leaves
   room for the overlap that their sizes demand.
3. Each class has a bitmap of about as many bits as its set has shingles. A bit that x has and y has not
   proves a shingle of x that y lacks, so a pair with more such bits than its sizes allow cannot link.
   Pairs are ids and bitmaps up to here; only what passes needs shingles.
4. In each list, all members are first paired with the one that has the shared shingle earliest (it has
   the fewest shingles of its own). The components of the links found make most pairs moot: only pairs
   of one list in different components are left, and these are paired with one another, all of them.
   So a group of many near copies takes a number of pairs in proportion to its size, and no pair
   that could join two components is left out.
5. The search: queries and the records they were paired with meet in blocks of a bounded size (a query
   with many records is dealt over many blocks). A block's records are one inverted index; each of its
   queries is a T-occurrence search of the whole index. DivideSkip heap-merges the short lists, probes
   the long ones by binary search for what reached T - L, and keeps what reaches the overlap needed.

Defined cases: null or blank text: empty set, linked with nothing; a null doc_id links with nothing and
its component is null; repeated rows are equal sets; one id with several texts is one document that has
the links of all of them (and a row, with its own n_shingles, for each); an empty table gives no rows;
very long texts are worked through one by one; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import free_name, give_back, map_batches, marks, ship, slices, with_mark
from .graph import components
from .scratch import Scratch
from .shingles import in_batches, mix, shingle_sets

WIDTH, PERCENT = 4, 85
SLOTS = 20  # bits of the table of counts: 2**20 counters, whatever the input
RECORDS, BLOCK_BYTES = 64, 4_000_000  # records of one query in a block; shingles of a block


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """ceil(percent * n / 100): what a set of n must share with anything it links to."""
    return -(-percent * n // 100)


def linked(shared: int, n: int, m: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (n + m - shared)


class Index:
    """The inverted lists of a block of records."""

    def __init__(self, records: list[np.ndarray]):
        every = np.concatenate(records)
        owner = np.repeat(np.arange(len(records)), [len(r) for r in records])
        order = np.argsort(every, kind="stable")
        self.every, self.owner, self.sizes = every[order], owner[order], [len(r) for r in records]

    def search(self, query: np.ndarray, percent: int = PERCENT, mu: float = 0.0085) -> list[tuple[int, int]]:
        """(record number, overlap) of all records that link with the query, by DivideSkip."""
        a, z = np.searchsorted(self.every, query, "left"), np.searchsorted(self.every, query, "right")
        lists = sorted((self.owner[x:y] for x, y in zip(a.tolist(), z.tolist()) if y > x), key=len)
        need = max(1, least_overlap(len(query), percent))
        if len(lists) < need:
            return []
        long = min(need - 1, int(need / (mu * math.log2(max(2, len(lists[-1]))) + 1)))
        short, far = lists[: len(lists) - long], lists[len(lists) - long :]
        counts = {int(r): sum(1 for _ in g) for r, g in groupby(heapq.merge(*(x.tolist() for x in short)))}
        ids = np.array([r for r, c in counts.items() if c >= need - long], np.int64)
        total = np.array([counts[int(r)] for r in ids], np.int64)
        for x in far:
            if not len(ids):
                break
            at = np.searchsorted(x, ids)
            total += (at < len(x)) & (x[np.minimum(at, len(x) - 1)] == ids)
        return [(int(r), int(c)) for r, c in zip(ids, total) if linked(int(c), len(query), self.sizes[r], percent)]


def bitmap(s: np.ndarray) -> bytes:
    """Which values of their low bits a set's shingles have: from one to two bits for each shingle, 64 at least."""
    bits = max(64, 1 << max(0, len(s) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def could_link(x: bytes, n: int, y: bytes, m: int, percent: int = PERCENT) -> bool:
    """Whether sets of n and m shingles with these bitmaps can link: each must share T = ceil(percent (n + m) / (100 + percent)),
    so x may have n - T shingles that y lacks, and y m - T."""
    t = -(-percent * (n + m) // (100 + percent))
    a, b, i, j = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x), 8 * len(y)
    while i > j:  # the longer bitmap is folded: its bits by fewer low bits of the shingles
        i //= 2
        a = (a >> i) | (a & ((1 << i) - 1))
    while j > i:
        j //= 2
        b = (b >> j) | (b & ((1 << j) - 1))
    return (a & ~b).bit_count() <= n - t and (b & ~a).bit_count() <= m - t


def _levels(docs: DataFrame) -> np.ndarray:
    """uint8[2**SLOTS]: the logarithm of how many documents hold a shingle of the slot, over all documents; a shingle
    counts where a task's slice holds it twice or more, so that what only one document holds does not fill the table."""
    part = 1 << (SLOTS - 4)

    def count(batches):
        total = np.zeros(1 << SLOTS, np.int64)
        for b in (x for whole in batches for x in slices(whole)):
            texts = b.column(0).to_pylist()
            sets = [s for x, y in in_batches(texts) for s in shingle_sets(texts[x:y], WIDTH)]
            every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            twice = np.zeros(len(every), bool)
            same = every[1:] == every[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            total += np.bincount((every[twice] >> np.uint64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(16, dtype=np.int32)), pa.array([total[i * part : (i + 1) * part].astype("<u4").tobytes() for i in range(16)])], names=["part", "n"])
        give_back()

    def add(batches):
        total: dict = {}
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(n, "<u4").astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.floor(np.log2(v + 1)).astype(np.uint8).tobytes() for v in total.values()])], names=["part", "n"])
        give_back()

    kind = "part int, n binary"
    got = docs.select("text").mapInArrow(count, kind).repartition(16, "part").mapInArrow(add, kind).collect()
    return np.frombuffer(b"".join(bytes(r.n) for r in sorted(got, key=lambda r: r.part)), np.uint8)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _prints(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    if not len(s):
        return 0, 0
    return int(_signed(np.array([mix(s + np.uint64(7)).sum(dtype=np.uint64)]))[0]), int(_signed(np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5555)))]))[0])


def _keys(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(doc_id, n, f1, f2, bits, keys): set size, fingerprint, bitmap and first shingles of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2**SLOTS bytes, whatever the input

    def make():
        level = shared.value

        def f(b):
            n, f1, f2, bits, keys = [], [], [], [], []
            texts = b.column(1).to_pylist()
            for x, y in in_batches(texts):
                for s in shingle_sets(texts[x:y], WIDTH):
                    n.append(len(s))
                    for to, v in zip((f1, f2), _prints(s)):
                        to.append(v)
                    bits.append(bitmap(s))
                    first = len(s) - least_overlap(len(s)) + 1 if len(s) else 0
                    keys.append(_signed(s[np.lexsort((s, level[(s >> np.uint64(64 - SLOTS)).astype(np.int64)]))[:first]]))
            off = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            return [b.column(0), n, f1, f2, bits, pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))]

        return f

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n int, f1 long, f2 long, bits binary, keys array<long>", make)


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for a link."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")

    def make():
        def f(b):
            keep = [could_link(x, n, y, m) for n, x, m, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            kept = b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            return [kept.column(0), kept.column(1)] if kept.num_rows else None

        return f

    node = "struct<id: bigint, f: bigint>"
    return map_batches(both, f"a {node}, b {node}", make)


def _sets(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, s): the shingles of each class that a pair names. Only texts that may be wanted leave their place."""
    node = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = node.select(F.col("node.id").alias("doc_id"), F.col("node.f").alias("f"))
    near = with_mark(docs.select("doc_id", "text"), "doc_id", marks(wanted, "doc_id"), "may").where("may").drop("may")
    rows = near.join(wanted, "doc_id").select("doc_id", "f", "text")

    def make():
        def f(b):
            ids, fs, out = [], [], []
            texts = b.column(2).to_pylist()
            for x, y in in_batches(texts):
                for i, s in zip(range(x, y), shingle_sets(texts[x:y], WIDTH)):
                    if len(s) and _prints(s)[0] == b.column(1)[i].as_py():  # an id may have other texts too
                        ids.append(b.column(0)[i].as_py())
                        fs.append(b.column(1)[i].as_py())
                        out.append(s.tobytes())
            return [ids, fs, out] if ids else None

        return f

    got = map_batches(rows, "id long, f long, s binary", make)
    return got.groupBy("id", "f").agg(F.first("s").alias("s")).select(F.struct("id", "f").alias("node"), "s")


def _search(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) found by searching each block's inverted lists for each of its queries: all links among the pairs,
    and any others that meet in a block."""
    deal = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(RECORDS)).alias("parts")))
    dealt = pairs.join(deal, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("salt"))
    queries = dealt.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), "s"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("node"), "s")
    records = dealt.join(sets.select(F.col("node").alias("b"), "s"), "b").select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("node"), "s")
    rows = queries.unionByName(records).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        queries, records, size, now = {}, {}, 0, None

        def flush():
            names = list(records)
            index = Index([records[i] for i in names])
            hits = [(q, names[r]) for q, s in queries.items() for r, _ in index.search(s) if names[r] != q]
            ends = [pa.array([{"id": x[k][0], "f": x[k][1]} for x in hits], pa.struct([("id", pa.int64()), ("f", pa.int64())])) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for whole in batches:
            for b in slices(whole):
                a, salt, role, node, s = (b.column(i).to_pylist() for i in range(5))
                for i in range(len(s)):
                    one, group = np.frombuffer(s[i], np.uint64), (tuple(a[i].values()), salt[i])
                    if size > BLOCK_BYTES and (group != now or role[i] == 1) and records:
                        yield flush()
                        queries = {now[0]: queries[now[0]]} if group == now else {}  # a query goes on with the rest of its records
                        records, size = {}, 0
                    now = group
                    (records if role[i] else queries)[tuple(node[i].values())] = one
                    size += one.nbytes + 200
        if records:
            yield flush()
        give_back()

    node = "struct<id: bigint, f: bigint>"
    return rows.select("a", "salt", "role", "node", "s").mapInArrow(run, f"a {node}, b {node}")


def _may_link(n, i, m, j):
    """Whether sets of n and m whose first common shingle stands at places i and j can link: they must share
    T = ceil(85 (n + m) / 185), so neither can hold more than n - T before it."""
    n, i, m, j = (F.col(c) if isinstance(c, str) else c for c in (n, i, m, j))
    t = F.floor((F.lit(PERCENT) * (n + m) + (99 + PERCENT)) / (100 + PERCENT))
    return (i <= n - t) & (j <= m - t)


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of documents."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    s = Scratch(spark)
    keyed = s.keep(_keys(docs, _levels(docs)))
    same = ["n", "f1", "f2"]
    classes = s.keep(keyed.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("bits").alias("bits"), F.first("keys").alias("keys")).withColumn("node", F.struct("id", F.col("f1").alias("f"))))
    # an id with several texts is one document: its classes are joined
    of_id = keyed.where("n > 0 and doc_id is not null").select("doc_id", *same).distinct()
    several = of_id.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    nodes = of_id.join(several, "doc_id", "left_semi").join(classes.select(*same, "node"), same).select("doc_id", "node")
    bound = nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")

    posted = classes.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    # what a join holds rows against is written down first: two plain shuffles meet, and Spark can split those of a hot key
    often = s.keep(posted.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"))
    lists = s.keep(posted.join(often, "key"))
    heads = s.keep(lists.groupBy("key").agg(F.min(F.struct("pos", "node", "n")).alias("head")))
    star = lists.join(heads, "key").where((F.col("node") != F.col("head.node")) & _may_link(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")))
    first = s.keep(_possible(star.select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct(), classes))
    sets = s.keep(_sets(docs, first))
    links = s.keep(_search(first, sets, s).unionByName(bound))
    s.drop(sets)
    of = components(links, s)

    placed = lists.join(of.withColumn("c", F.col("component")).select("node", "c"), "node", "left").select("key", "node", "n", "pos", F.coalesce("c", "node").alias("c"))
    split = s.keep(placed.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("key"))
    open_ = s.keep(placed.join(split, "key"))
    x, y = (open_.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "pos", "c")]) for side in "xy")
    fit = (x.key == y.key) & (F.col("x_c") < F.col("y_c")) & _may_link("x_n", "x_pos", "y_n", "y_pos")
    cross = x.join(y, fit).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    rest = s.keep(_possible(cross.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), classes))
    sets = s.keep(_sets(docs, rest))
    every = s.keep(links.unionByName(_search(rest, sets, s)))
    of = components(every, s)
    class_of = s.keep(classes.select(*same, "node").join(of, "node", "left").select(*same, F.coalesce(F.col("component.id"), F.col("node.id")).alias("class")))
    s.drop(often, heads, split, lists, first, links, open_, rest, sets, every, classes)
    out = keyed.select("doc_id", *same).join(class_of, same, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc_id"))).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of documents with one document of each component: its smallest doc_id, one row of it (the first by its
    columns in order). Rows without an id stay, as nothing is known to link with them. Only rows of ids that may go,
    or that are repeated, leave their place."""
    s = Scratch(docs.sparkSession)
    found = s.keep(join_components(docs))
    moved = found.where("doc_id <> component_id").select("doc_id")
    touched = s.keep(moved.unionByName(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")).distinct())
    may, row = free_name(docs, "may"), free_name(docs, "row")
    known = with_mark(docs, "doc_id", marks(touched, "doc_id"), may)
    quote = lambda c: F.col("`{}`".format(c.replace("`", "``")))
    order = [quote(c) for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
    going = moved.select(F.col("doc_id")).distinct()
    doubtful = known.where(F.col(may)).join(going, "doc_id", "left_anti")
    one = doubtful.withColumn(row, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col(row) == 1)
    columns = [quote(c) for c in docs.columns]
    return known.where(~F.col(may)).select(*columns).unionByName(one.select(*columns))
