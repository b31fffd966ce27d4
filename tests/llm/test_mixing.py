import re
from collections import defaultdict

import pytest

from terraweave.llm import mixing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in free}
        out |= {s: 2 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        free -= above
    return out


def check(rows, want):
    taken, size, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for source, n, source_size, target, got in rows:
        assert got in (0, n, 2 * n) and target == pytest.approx(want[source])
        taken[source] += got
        size[source] += n
        biggest[source] = max(biggest[source], n)
    for s in taken:
        assert abs(taken[s] - want[s]) <= biggest[s] + 1e-6


def test_query(spark):
    docs = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in queries.table(spark, SF, "documents").collect()}
    sizes = defaultdict(int)
    for s, n in docs.values():
        sizes[s] += n
    got = queries.op1_pivotal_mix(spark, SF).collect()
    assert len(got) == len(docs) and all(r.size == docs[r.doc_id][1] and r.source_size == sizes[docs[r.doc_id][0]] for r in got)
    check([(docs[r.doc_id][0], r.size, r.source_size, r.target, r.taken) for r in got], brute_targets(sizes))
    again = queries.op1_pivotal_mix(spark, SF).collect()
    assert sorted(again) == sorted(got)


def test_hot_source_nulls_ties_and_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    rows = [(i, i % 37, "b") for i in range(2000)] + [(5, 9, None)] * 3 + [(i, 0, "empty") for i in range(5)] + [(None, 4, "a")] * 150
    df = spark.createDataFrame(rows, "doc_id long, size long, source string").repartition(7)
    got = mixing.mix(df, "size", "source").collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    check([(r.source, r.size, r.source_size, r.target, r.taken) for r in got], brute_targets(sizes))
    assert mixing.mix(df.limit(0), "size", "source").count() == 0


def test_fractions_keep_their_expectation(spark):
    """The mean number of copies of each document, over many seeds, is its source's target over its size."""
    df = spark.createDataFrame([(i, 5 + i % 9, "a" if i < 40 else "b") for i in range(60)], "doc_id long, size long, source string")
    runs = 40
    total = defaultdict(int)
    for seed in range(runs):
        for r in mixing.mix(df, "size", "source", seed=seed).collect():
            total[r.source, r.doc_id] += r.copies
            want = r.target / r.source_size
            assert r.copies in (int(want), int(want) + 1)
    for source in "ab":
        want = next(r for r in mixing.mix(df, "size", "source").collect() if r.source == source)
        want = want.target / want.source_size
        seen = [n / runs for (s, _), n in total.items() if s == source]
        spread = (want % 1 * (1 - want % 1) / runs) ** 0.5
        assert all(abs(n - want) <= 4.5 * spread + 1e-9 for n in seen) and abs(sum(seen) / len(seen) - want) < 0.05


def test_mix_is_that_of_the_rows(spark):
    """Neither partitions nor their order tell which rows are taken; copies lie apart."""
    rows = [(i, f"{i} " + "w " * (i % 9), "ab"[i % 3 == 0], "x") for i in range(400)] + [(7, "same same", "a", "x")] * 30 + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Copies string")
    one, other = (sorted(map(str, mixing.mix_rows(d).collect())) for d in (df.coalesce(1), df.repartition(7, "text")))
    assert one == other and set(one) <= set(map(str, df.collect()))


def test_long_and_null_texts(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "w " * 300_000, "s"), (3, "", "s")], "doc_id long, text string, source string")
    sized = df.select("doc_id", mixing.words_in("text").alias("size"), "source")
    got = {r.doc_id: r for r in mixing.mix(sized, "size", "source").collect()}
    assert got[1].taken == got[3].taken == 0 and got[2].size == 300_000 and got[2].taken in (300_000, 600_000)


def test_equal_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    df = spark.createDataFrame([(1, 5, "s")] * 100 + [(2, 3, "t")], "doc_id long, size long, source string")
    got = mixing.mix(df, "size", "source").collect()
    assert len(got) == 101 and abs(sum(r.taken for r in got if r.source == "s") - got[0].target) <= 5 or got[0].source == "t"


def test_rows_of_the_mix(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9), "s", "x") for i in range(90)], "doc_id long, text string, source string, Copies string")
    out = mixing.mix_rows(df)
    assert out.columns == df.columns
    words = sum(len(r.text.split()) for r in out.collect())
    assert abs(words - 1.5 * sum(i % 9 for i in range(90))) <= 8
