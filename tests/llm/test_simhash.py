import random

import numpy as np
import xxhash

from terraweave.llm import queries, simhash
from terraweave.llm.common import Tables

SF = "/root/testdata/sf0.001"


def brute_fp(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark):
    fps = {r.doc_id: brute_fp(r.text) for r in queries.table(spark, SF, "documents").collect()}
    want = brute_components(fps)
    got = queries.op7_simhash(spark, SF).collect()
    assert len(got) == len(fps)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_blocks_cover_every_three_positions():
    assert len(simhash.BLOCKS) == 14
    for gone in simhash.combinations(range(8), 3):
        assert sum(not set(b) & set(gone) for b in simhash.BLOCKS) == 1


def test_long_lists_and_short_lists_agree():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 14, 600).astype(np.uint64) << np.uint64(20))
    pairs = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 3}
    mask = 0xFFFF
    got = {(int(a), int(b)) for x, y in simhash._search_long(fps, mask) for a, b in zip(x, y)}
    assert got == pairs


def test_links_give_the_components_of_all_pairs(spark):
    rng = random.Random(3)
    fps = {}
    for i in range(300):
        base = rng.getrandbits(64) if i % 3 == 0 or i < 3 else fps[rng.randrange(i)]
        for _ in range(rng.randrange(5)):
            base ^= 1 << rng.randrange(64)
        fps[i] = base
    want = brute_components(fps)
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in fps.items()], "id long, fp long")
    tables = Tables(spark)
    edges = tables.save(simhash.links(df.select("fp").distinct()), "e")
    roots = {r.node: r.root for r in simhash.components(tables, edges).collect()}
    signed = {i: int(np.uint64(f).astype(np.int64)) for i, f in fps.items()}
    for i in fps:
        for j in fps:
            assert (want[i] == want[j]) == (roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j]))


def test_nulls_ties_long_texts_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (4, "a b"), (None, "a  B"), (6, "x y z " * 50000), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, shingle=3).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (6, 6), (None, 1)}
    kept = simhash.drop_near_duplicates(df.withColumn("FP", df.text))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 6] and kept.columns == ["doc_id", "text", "FP"]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
