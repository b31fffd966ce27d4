import random
from collections import defaultdict

import numpy as np
import pytest

from terraweave.llm import similar, simhash
from terraweave.llm.common import Tables


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(texts, least):
    """The smallest key that is reachable over pairs of this Jaccard similarity; wordless texts are alike."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root, having = {k: k for k in texts}, defaultdict(list)
    for k in sorted(sets):
        for s in sets[k] or {()}:
            having[s].append(k)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = defaultdict(int)
    for keys in having.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if n >= least * (len(sets[a] | sets[b]) or 1):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in texts}


def corpus(seed=3):
    """Texts, copies with a few words changed, and texts that share a part only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    out = []
    for _ in range(40):
        words = [word() for _ in range(rng.randrange(60, 300))]
        out.append(words)
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(len(words) // 90):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
        out.append(words[: len(words) // 2] + [word() for _ in range(len(words) // 2)])
    rng.shuffle(out)
    return {i: " ".join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize("short, long", [(64, 50_000), (1, 50_000), (64, 2)])
def test_groups(spark, monkeypatch, short, long):
    monkeypatch.setattr(similar, "SHORT", short)
    monkeypatch.setattr(similar, "LONG", long)
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similar.near_copies(df).collect()}
    assert got == brute_components(texts, 0.8)
    assert any(k != c for k, c in got.items())


def test_a_group_of_many_copies(spark):
    """Every copy differs from one text in places of its own, so most pairs of copies are below 0.8."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = {}
    for i in range(400):
        copy = list(words)
        for _ in range(4 if i else 0):
            copy[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.component_id for r in similar.near_copies(df).collect()} == {0}


def test_lists_give_the_components_of_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (6, similar.WORDS), dtype=np.uint64)
    sketches = base[rng.integers(0, 6, 200)]
    sketches = sketches ^ (np.uint64(1) << rng.integers(0, 63, sketches.shape, dtype=np.uint64)) * rng.integers(0, 2, sketches.shape, dtype=np.uint64)
    ids = np.arange(200)
    u, v = similar._forest(ids, sketches)
    assert len(u) == 200 - 6 and similar._close(sketches[u], sketches[v]).all()


def test_nulls_ties_long_texts_and_empty(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (4, "A  b"), (None, "a b"), (6, " ".join(map(str, range(200_000)))), (None, None), (8, "a b c")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Sketch string")
    got = similar.near_copies(df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, 4), (6, 6), (None, 1), (8, 8)}
    kept = simhash.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 6, 8] and kept.columns == df.columns
    assert similar.near_copies(df.limit(0)).count() == 0
    assert similar.links(Tables(spark), spark.createDataFrame([], "id long, sketch binary, keys array<long>")).count() == 0


def near_the_line():
    """Pairs a little below and a little above a similarity of 0.8: 400 words each, some at one end replaced."""
    rng = random.Random(5)
    texts = {}
    for i in range(120):
        words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        changed = 40 + i % 10  # 44 changed words of 396 shingles give exactly 0.8
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join(words[:-changed] + [f"v{rng.randrange(10**9)}" for _ in range(changed)])
    return texts


@pytest.mark.parametrize("many, wide", [(2000, 1_000_000), (2, 1_000_000), (2000, 500)])
def test_links_are_verified(spark, monkeypatch, many, wide):
    monkeypatch.setattr(similar, "MANY", many, raising=False)
    monkeypatch.setattr(similar, "WIDE", wide, raising=False)
    texts = near_the_line()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similar.near_copies(df).collect()}
    assert got == brute_components(texts, 0.8)
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(120)) == sum(40 + i % 10 <= 44 for i in range(120))


def test_rows_stay_in_the_search_until_they_are_verified():
    """A chain: rows that are similar to their neighbours only, with a stranger among them."""
    sets = [np.arange(10 * i, 10 * i + 100, dtype=np.uint64) for i in range(8)] + [np.arange(5000, 5100, dtype=np.uint64), np.zeros(0, np.uint64)]
    order = np.random.default_rng(1).permutation(10)
    u, v = similar._verified(order, [sets[i] for i in order])
    assert {(max(a, b), min(a, b)) for a, b in zip(u.tolist(), v.tolist())} == {(i + 1, i) for i in range(7)}


def test_rows_of_one_key_are_judged_by_their_texts(spark):
    rng = random.Random(9)
    a, b, c = ([f"w{rng.randrange(10**9)}" for _ in range(200)] for _ in range(3))
    near = lambda words, i: " ".join([*words[:-3], f"x{i}"])
    rows = [(1, near(a, 0)), (2, near(a, 1)), (2, near(b, 0)), (3, near(b, 1)), (None, near(c, 0)), (None, near(c, 1)), (None, near(c, 2)), (4, near(b, 0))]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(4)
    got = simhash.drop_near_duplicates(df).collect()
    assert {tuple(r) for r in got if r.doc_id} == {rows[0], rows[2]}
    assert len(got) == 3 and [r.text for r in got if r.doc_id is None][0] in {t for k, t in rows if k is None}


def test_candidates_come_from_sign_bits():
    """The fingerprint is a SimHash: each bit is the majority of one bit of the shingles' hashes."""
    rng = np.random.default_rng(4)
    for n in (1, 4, 15, 240, 241, 700):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        words = similar.hash_words(hashes).view(np.uint8)
        counts = np.unpackbits(words.reshape(n, -1), axis=1).sum(axis=0)
        got = np.unpackbits(np.frombuffer(similar.fingerprint(hashes), np.uint8)).sum()
        assert (2 * counts > n).sum() <= got <= (2 * counts >= n).sum()
        single = [np.unpackbits(np.frombuffer(similar.fingerprint(hashes[i : i + 1]), np.uint8)) for i in range(n)]
        votes = 2 * np.sum(single, axis=0, dtype=np.int64) - n
        print_ = np.unpackbits(np.frombuffer(similar.fingerprint(hashes), np.uint8))
        assert (print_[votes > 0] == 1).all() and (print_[votes < 0] == 0).all()


def posting_keys(hashes):
    """The keys of one set's postings, of all rounds."""
    pairs = np.frombuffer(similar.fingerprint(hashes), np.uint16).astype(np.int64)
    return set(((np.arange(len(pairs)) << 16) + pairs).tolist()) | set(similar.subset_keys(hashes))


@pytest.mark.parametrize("shared, a, b", [(4, 1, 0), (8, 1, 1), (12, 3, 0), (80, 10, 10), (800, 100, 100), (800, 200, 0)])
def test_pairs_at_the_line_meet_and_pass_the_tally(shared, a, b):
    rng = np.random.default_rng(6)
    for _ in range(300):
        hashes = rng.integers(0, 1 << 63, shared + a + b, dtype=np.uint64)
        x, y = np.sort(hashes[: shared + a]), np.sort(np.r_[hashes[:shared], hashes[shared + a :]])
        assert posting_keys(x) & posting_keys(y)
        assert similar._close(*(np.frombuffer(similar.fingerprint(s), np.uint64)[: similar.WORDS] for s in (x, y)))


def test_small_sets_find_each_other(spark):
    """Four shingles of five are a similarity of 0.8, which few sign bits tell."""
    texts = {}
    for i in range(150):
        words = [f"w{i}x{j}" for j in range(9)]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(words[:-1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_copies(df).collect()}
    assert got == {k: k - k % 2 for k in texts}


@pytest.mark.parametrize("together", [200_000, 500])
def test_a_group_in_many_lists_has_few_edges(spark, monkeypatch, together):
    """Near copies meet in most lists; what goes on to the components does not grow with the number of lists or blocks."""
    monkeypatch.setattr(similar, "EDGES", together, raising=False)
    monkeypatch.setattr(similar, "MANY", 20)
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = {}
    for i in range(200):
        copy = list(words)
        for _ in range(3):
            copy[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    edges, plain = [], similar.components
    monkeypatch.setattr(similar, "components", lambda tables, df, *name: edges.append(df.count()) or plain(tables, df, *name))
    got = {r.doc_id: r.component_id for r in similar.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_components(texts, 0.8) and set(got.values()) == {0}
    assert len(edges) == 3 and max(edges) <= (200 if together > 500 else 1000), edges


def test_later_rounds_give_no_edges_again(spark, monkeypatch):
    """A group that the first round of postings connects has no edge from the rounds after it."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join([*words[:-1], f"v{i}"])) for i in range(100)]
    saved, save = {}, Tables.save

    def counted(self, df, name):
        out = save(self, df, name)
        saved[name] = out.count()
        return out

    monkeypatch.setattr(Tables, "save", counted)
    assert {r.component_id for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert saved["candidates-0"] >= 99 and not any(saved[f"candidates-{i}"] for i in range(1, similar.ROUNDS))
