"""Clusters, runs and shards against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import ball_clusters, periodic_runs, sharding

# --- 11


def plain_clusters(rows, k, rounds):
    v = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in e]) for i, e in rows]
    c = [x for _, x in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x: min(range(len(c)), key=lambda j: (square(x, c[j]), j))
    for _ in range(rounds):
        of = [near(x) for _, x in v]
        for j in range(len(c)):
            own = [x for (_, x), o in zip(v, of) if o == j]
            if own:
                c[j] = [sum(t) // len(own) for t in zip(*own)]
    out = [(i, near(x), square(x, c[near(x)])) for i, x in v]
    inertia = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out), key=repr)


def vectors(kind):
    r = random.Random(6)
    middle = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = []
    for i in range(500):
        m, wide = middle[i % 5], {"tight": 0.02, "loose": 1.0, "ties": 0.0}[kind]
        rows.append((i, [x + r.uniform(-wide, wide) for x in m]))
    return rows + [(7, rows[7][1]), (None, rows[3][1]), (900, [0.0] * 64), *((1000 + i, rows[11][1]) for i in range(200))]


@pytest.mark.parametrize("kind", ["tight", "loose", "ties"])
def test_clusters_equal_the_plain_method(spark, kind):
    rows = vectors(kind)
    odd = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [float("nan")] + [0.0] * 63), (2004, [float("inf")] * 64), (2005, [None] + [0.0] * 63)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("ids", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in ball_clusters.cluster(df).collect()), key=repr)
    assert got == plain_clusters(rows, 16, 3)


def test_clusters_of_few_vectors(spark):
    assert ball_clusters.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = [(i, [float(i % 2)] * 64) for i in range(3)]
    got = sorted((tuple(r) for r in ball_clusters.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=repr)
    assert got == plain_clusters(rows, 16, 3)


def test_whole_balls_are_taken_and_agree_with_single_vectors():
    r = np.random.default_rng(2)
    x = (r.integers(0, 5, (600, 1)) * 400 + r.integers(-5, 5, (600, 8))).astype(np.int64)
    order, nodes = ball_clusters.grow_tree(x)
    assert sorted(order.tolist()) == list(range(600)) and nodes[0, 1] == 600 and (nodes[0, 6:14] == x.sum(0)).all()
    c = x[[0, 5, 9, 9, 100]]
    mine, whole = ball_clusters.filter_tree(x[order], nodes, c)
    assert (mine == ((x[order][:, None] - c[None]) ** 2).sum(2).argmin(1)).all() and (whole >= 0).sum() > 300


# --- 12


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def thue_morse(k):
    bits = [0]
    for _ in range(k):
        bits += [1 - b for b in bits]
    return bits


def test_runs_equal_the_plain_search():
    r = random.Random(3)
    texts = [[], [0], [0] * 11, [0] * 12, [0] * 500, [0, 1] * 6, [0, 1] * 5 + [0], thue_morse(10) * 2, thue_morse(11), thue_morse(8) * 5]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a  # a word with as many runs as can be
    texts += [b, *([r.randrange(k) for _ in range(r.randint(1, 300))] for k in (1, 2, 2, 3, 3, 5, 50) for _ in range(12))]
    for _ in range(40):
        base = [r.randrange(4) for _ in range(r.randint(1, 30))]
        texts.append([r.randrange(9) for _ in range(r.randint(0, 40))] + (base * 9)[: r.randint(1, 200)] + [r.randrange(9) for _ in range(r.randint(0, 40))])
    for some in (texts, texts[::-1]):
        got = periodic_runs.runs_of([np.array(t, np.int64) for t in some])
        assert got == [plain_runs(t) for t in some]


def test_runs_do_not_depend_on_the_size_of_pieces(monkeypatch):
    r = random.Random(4)
    texts = [np.array([r.randrange(3) for _ in range(r.randint(0, 200))], np.int64) for _ in range(30)]
    whole = periodic_runs.runs_of(texts)
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    assert periodic_runs.runs_of(texts) == whole


def test_runs_survive_a_hash_that_deceives(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_values", lambda ids: (ids % 2).astype(np.uint64))
    r = random.Random(5)
    texts = [np.array([r.randrange(4) for _ in range(120)] + [0, 1, 2] * 9, np.int64) for _ in range(20)]
    assert periodic_runs.runs_of(texts) == [plain_runs(t.tolist()) for t in texts]


def test_run_digests_equal_plain_ones(spark):
    r = random.Random(7)
    rows = [(i, " \t".join(r.choices(["a", "b", "é\x85x", "漢\xa0"], k=r.randint(0, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n "), (3, rows[3][1]), (None, "x " * 40), (503, "w " * 900), (504, " ".join(map(str, range(20_000)))), (505, "a b c " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("length", F.lit("x"))
    want = []
    for i, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(words) if n < 20_000 else []
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    found = periodic_runs.digests(periodic_runs.find_runs(df, periodic_runs.seeded_repeats))
    assert sorted((tuple(x) for x in found.collect()), key=repr) == sorted(want, key=repr)
    assert found.where("n_runs > 0").count() >= 10 and periodic_runs.find_runs(df.limit(0)).count() == 0


# --- 13


def test_shards_are_near_equal_and_gapless(spark):
    r = random.Random(9)
    rows = [(i, "é" * r.randint(0, 300)) for i in range(4000)] + [(None, None), (None, "x"), (4001, None), (4002, ""), (5, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("slot", F.lit(1))
    got = sharding.by_bytes(df, slots=256).collect()
    assert sorted(((x.doc_id, x.size, x.text_crc32) for x in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert {x.law for x in got} == {"bytes"} and {x.grown_shard for x in got} == {None}
    load = [sum(x.size for x in got if x.shard == k) for k in range(8)]
    assert max(load) - min(load) < 0.01 * sum(load)
    for k in range(8):
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sum(x.shard == k for x in got)))
    where = {}
    assert all(where.setdefault(x.virtual_slot, x.shard) == x.shard for x in got)


def test_one_id_may_hold_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LANE", 16)
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 3 = 0, 'hot', repeat('x', int(id % 50))) AS text", "id AS n")
    got = sharding.by_bytes(df, slots=512).collect()
    load = [sum(x.size for x in got if x.shard == k) for k in range(8)]
    assert len(got) == 3000 and max(load) - min(load) < 0.02 * sum(load)
    whole = sharding.Shards(df, slots=512).rebalance().records(df)
    assert whole.columns == ["doc_id", "text", "n", "shard"] and sorted(x.n for x in whole.collect()) == list(range(3000))


def test_versions_of_the_map(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "repeat('y', int(id % 97)) AS text")
    shards = sharding.Shards(df, slots=300).rebalance().grow()
    maps = [{x.slot: x for x in v.collect()} for v in shards.versions]
    assert [{x.version for x in m.values()} for m in maps] == [{0}, {1}, {2}] and all(len(m) == 300 for m in maps)
    assert all(maps[2][s].shard in (maps[1][s].shard, 8) for s in maps[1])  # rows move into the new shard alone
    for m, parts in ((maps[1], 8), (maps[2], 9)):
        load = [sum(x.bytes for x in m.values() if x.shard == k) for k in range(parts)]
        assert max(load) - min(load) < 0.12 * sum(load) / parts
    assert sum(maps[0][s].shard != maps[1][s].shard for s in maps[0]) < 100  # what is in place stays


def test_shards_of_nothing(spark):
    assert sharding.by_bytes(spark.createDataFrame([], "doc_id long, text string"), slots=16).count() == 0
