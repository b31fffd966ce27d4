import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from terraweave.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(docs, length):
    """docs: (key, text) rows; key None is the largest."""
    order = lambda k: float("inf") if k is None else k
    first = {}
    data = [(k, (t or "").encode()) for k, t in docs]
    for k, b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, order(k)), order(k))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < order(k):
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.op4_suffix_dedup(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, 50)
    assert any(r.n_removed for r in got)


def cases():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab é") for _ in range(rng.randrange(20, 90)))
    shared = [word() for _ in range(12)] + ["a" * 300, "ab" * 90]
    return [(i, "".join(rng.choice(shared) if rng.random() < 0.5 else word() for _ in range(rng.randrange(6)))) for i in range(60)]


@pytest.mark.parametrize("held, long", [(50, 20_000), (400_000, 20_000), (400_000, 3), (400_000, 0)])
def test_random_texts(spark, monkeypatch, held, long):
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "LONG", long)
    docs = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str) == brute(docs, 50)


@pytest.mark.parametrize("sample", [1, 10**9])
def test_a_phrase_of_all_documents(spark, monkeypatch, sample):
    """One phrase in every text, each time between other words; some texts share more."""
    monkeypatch.setattr(suffix_dedup, "LONG", 10)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", sample)
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = [words(5) for _ in range(5)]
    docs = [(i, f"{words(6)} {rng.choice(shared)} and here the phrase that all have {rng.choice(shared)} {words(6)}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str) == brute(docs, 50)


def test_segments_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    docs = [(1, long[1_000_000:1_100_000]), (2, long), (3, None), (4, "")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[2].n_removed, got[2].n_spans, got[1].n_removed, got[3].n_bytes) == (100_000, 1, 0, 0)


def test_nulls_ties_clashes_and_empty(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    docs = [(7, text), (7, text), (7, text + "other"), (None, "x" + text), (9, text[:20] + "é" + text), (None, None)]
    df = spark.createDataFrame([(k, t, "e") for k, t in docs], "doc_id long, text string, N_bytes string")
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str) == brute(docs, 50)
    cut = suffix_dedup.remove_repeats(df, texts=True)
    assert cut.columns[:2] == ["doc_id", "text"] and text + "other" in {r.text for r in cut.collect()}
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_runs_are_ranked_in_little_memory():
    """Ten MB of runs come in tables of whole ranks, and ranking the largest of them takes far less than an executor's worker may."""
    rng = np.random.default_rng(3)
    ranks = np.sort(rng.integers(0, 4000, 160_000))
    texts = rng.integers(97, 103, (4000, 64), dtype=np.uint8)[ranks]
    texts[rng.random(160_000) < 0.7, 30] = 120
    rows = pa.table({"rank": ranks, "content": pa.array([t.tobytes() for t in texts], pa.binary())})
    tables = list(suffix_dedup.whole_ranks(iter(rows.to_batches(2000)), suffix_dedup.SORTED))
    assert pa.concat_tables(tables).equals(rows)
    firsts, lasts = ([t.column(0)[i].as_py() for t in tables] for i in (0, -1))
    assert all(a < b for a, b in zip(lasts, firsts[1:]))
    n = max(len(t) for t in tables)
    tracemalloc.start()
    suffix_dedup.doubled(ranks[:n], np.arange(n), texts[:n].ravel(), np.arange(n) * 64, np.full(n, 15), 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6, peak
