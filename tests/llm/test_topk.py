import math
import random

from pyspark.sql import functions as F

from terraweave.llm import queries, topk

SF = "/root/testdata/sf0.001"


def brute(rows, k, asked):
    out = []
    for i, q in rows:
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(set(out))


def test_query(spark):
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in queries.table(spark, SF, "embeddings").collect()]
    got = queries.op8_threshold_topk(spark, SF).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, lambda i: i % 50 == 0)


def test_blocks_ties_and_large_values(spark, monkeypatch):
    monkeypatch.setattr(topk, "VALUES", 160)
    rng = random.Random(2)
    rows = [(i, [rng.choice((-3, -1, 0, 2)) for _ in range(4)]) for i in range(300)] + [(1000 + i, [2**30 + i, 2**28, -(2**29), 1]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, v array<long>").repartition(4)
    got = topk.top_k(df, df.filter("id % 25 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, lambda i: i % 25 == 0)


def test_blocks_are_ruled_out(spark, monkeypatch):
    """Long vectors in some blocks only: queries go where a score can still be reached, with bounds or without."""
    monkeypatch.setattr(topk, "LEAST", 30)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-9, 10) * (40 if i % 97 == 0 else 1) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    want = brute(rows, 3, lambda i: i % 20 == 0)
    sent = []
    plain = topk._sent
    monkeypatch.setattr(topk, "_sent", lambda *a: sent.append(plain(*a).count()) or plain(*a))
    for bounds in (topk.BOUNDS, 0):
        monkeypatch.setattr(topk, "BOUNDS", bounds)
        assert sorted(map(tuple, topk.top_k(df, df.filter("id % 20 = 0"), 3).collect())) == want
    assert sent[0] <= sent[1] == 20 * 3


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, [3, 1]), (1, [3, 1]), (2, [1, 1]), (2, [1, 1]), (3, [0, 5])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, v array<long>, BLOCK string, score int")
    got = topk.top_k(df, df.filter("id = 1"), 3).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 3, 5), (2, 2, 4), (3, 2, 4)]


def test_bad_vectors_short_vectors_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = df.filter(topk.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))
    got = topk.top_k(good, good.filter("id = 0"), 5).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 5, 65536), (2, 6, 0)]
    assert topk.top_k(good.limit(0), good.limit(0)).count() == 0
