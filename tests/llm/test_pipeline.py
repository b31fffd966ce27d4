import hashlib
from collections import defaultdict

import pytest

import corpus_pipeline
from terraweave.llm.common import Tables
from tests.llm import test_line_quality, test_similar, test_suffix_dedup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables, out = Tables(spark), [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(tables.save(f(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    for s in stages[:-1]:
        assert s.columns == corpus_pipeline.COLUMNS


def test_quality(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[:2])
    assert set(after) < set(before)
    for k, r in before.items():
        if test_line_quality.brute(r.text)[-1]:
            assert k not in after
    assert all(r.n_chars == len(r.text) <= len(before[k].text) for k, r in after.items())


def test_near_duplicates(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[1:3])
    texts = {k: r.text for k, r in before.items()}
    sure, maybe = (test_similar.brute_components(texts, least) for least in (0.86, 0.68))
    assert all(r == before[k] for k, r in after.items())
    assert len({sure[k] for k in after}) == len(after), "one of each group at most"
    assert {maybe[k] for k in before} <= set(after), "the smallest of each stays"


def test_repeats(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[2:4])
    want = {r[0]: r for r in test_suffix_dedup.brute(list(before.items()), 50)}
    for k, t in before.items():
        if want[k][2] == 0:
            assert after[k] == t
        elif k in after and after[k].isascii() and t.isascii():
            assert hashlib.sha256(after[k].encode()).hexdigest() == want[k][4]


def test_mix(stages):
    before, after = stages[3].collect(), stages[4].collect()
    words, taken = defaultdict(int), defaultdict(int)
    for r in before:
        words[r.source] += len(r.text.split())
    for r in after:
        taken[r.source] += len(r.text.split())
    assert set(after) <= set(before)
    assert all(taken[s] <= 2 * words[s] + 5 for s in taken)
    assert abs(sum(taken.values()) / sum(words.values()) - 1.5) < 0.1


def test_pack(stages):
    docs, pieces = stages[4].collect(), stages[5].collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert sorted(r.doc_id for r in docs) == sorted(r.doc_id for r in pieces if r.start == 0)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


GOOD = "Plain words stand in this line of text, one after one, and others follow them. "
ODD = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, GOOD * 3, None, None, None), (4, GOOD * 3, None, None, None), (None, GOOD + "Nobody knows its number, which is null, yet its words count.", "en", "b", 9),
    (None, None, None, None, None), (7, " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000)) + ".", "xx", "b", 1), (8, "Ünïcödé ends in the middle of é and goes on to say a few more words that nobody said before it. " + GOOD, "de", "a", 5),
]


def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, KEPT string, Copies int")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, name, stage):
    """Nulls in any column, empty and long texts, repeated rows, clashing names; then nothing at all."""
    got = stage(spark, odd(spark), SF)
    rows = got.collect()
    assert stage(spark, odd(spark).limit(0), SF).count() == 0
    if name == "packing":
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0) and sum(r.start == 0 for r in rows) == len(ODD)
        return
    assert got.columns == corpus_pipeline.COLUMNS
    keys = sorted((r.doc_id for r in rows), key=str)
    if name == "quality_rules":
        assert {7, 8, None} == set(keys)
    elif name == "near_duplicates":
        assert [k for k in keys if k is not None] == [1, 4, 7, 8] and keys.count(None) == 2
    elif name == "suffix_dedup":
        assert keys.count(4) == 2 and 7 in keys and not {1, 2, 3} & set(keys)
    else:
        assert set(rows) <= {tuple(r) for r in ODD}
