import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from terraweave.llm import queries, token_store, tokens
from terraweave.llm.common import Tables

SF = "/root/testdata/sf0.001"


def want(docs):
    plain = Tokenizer.from_file(queries.TOKENIZER)
    at, out = 0, []
    for k, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect())
    assert sorted(map(tuple, queries.op6_rans_store(spark, SF).collect())) == want(docs)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_001])
def test_round_trip_and_checks(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 50_000).astype(np.int64)
    seen, counts = np.unique(np.r_[ids, 7], return_counts=True)
    table = token_store.Table.of_counts(seen, counts)
    payload = token_store.encode_block(ids, table)
    assert (token_store.decode_range(payload, table) == ids).all()
    if n == 70_001:
        p = counts / counts.sum()
        assert len(payload) < 1.1 * n * -(p * np.log2(p)).sum() / 8 + 8 * token_store.LANES
        broken = bytearray(payload)
        broken[-1] ^= 1
        with pytest.raises(ValueError):
            token_store.decode_range(bytes(broken), table)


def test_segments(monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 500)
    ids = np.arange(1777) % 90
    table = token_store.Table.of_counts(*np.unique(ids, return_counts=True))
    payload = token_store.encode_block(ids, table)
    assert (token_store.decode_range(payload, table) == ids).all()
    for a, b in [(0, 1), (499, 501), (500, 1000), (1700, 1777), (10, 10), (1777, 2000)]:
        assert (token_store.decode_range(payload, table, a, b) == ids[a:b]).all()
    broken = bytearray(payload)
    broken[-1] ^= 1  # in the last of four segments, which ranges before it do not touch
    assert (token_store.decode_range(bytes(broken), table, 700, 1500) == ids[700:1500]).all()
    with pytest.raises(ValueError):
        token_store.decode_range(bytes(broken), table, 700, 1501)


def test_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 3000)
    docs = queries.table(spark, SF, "documents")
    token_store.write(docs, str(tmp_path), queries.TOKENIZER)
    every = [i for r in sorted(token_store.read(spark, str(tmp_path), ids=True).collect(), key=lambda r: r.start) for i in r.ids]
    size = len(every)
    for start, n in [(0, size), (0, 1), (2999, 2), (size // 2, 9000), (size - 1, 50), (size, 3), (5, 0)]:
        rows = sorted(token_store.read_range(spark, str(tmp_path), start, n).collect())
        assert [i for r in rows for i in r.ids] == every[start : start + n]
        at = start
        for r in rows:
            assert r.start == at
            at += len(r.ids)


def test_nulls_ties_and_empty(spark, tmp_path):
    docs = [(None, "x"), (1, None), (2, ""), (3, "same text"), (3, "same text"), (4, "long " * 200_000)]
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, shard int").repartition(3)
    token_store.write(df, str(tmp_path / "a"), queries.TOKENIZER)
    got = token_store.read(spark, str(tmp_path / "a"), ids=True).collect()
    assert sorted((r[1:4] for r in got)) == sorted(w[1:] for w in want(docs))
    assert all(len(r.ids) == r.n_tokens for r in got)
    token_store.write(df.limit(0), str(tmp_path / "b"), queries.TOKENIZER)
    assert token_store.read(spark, str(tmp_path / "b")).count() == 0
    assert token_store.read_range(spark, str(tmp_path / "b"), 0, 10).count() == 0


def test_ids_of_texts_with_and_without_white_space_together():
    enc, rng = tokens.encoder(queries.TOKENIZER), random.Random(4)
    parts = ["a", "bé", "漢", " ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "\u2003", "\u2014", "'s", "'ll", "1", "٣", ".", "!?", "🙂", "the", "\r\n", "'", "½"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(8000)]
    for t in texts:
        assert enc.ids(t).tolist() == enc.plain.encode(t, add_special_tokens=False).ids, t
        assert not (tokens.lone(t) and re.search(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}", t)), t
    assert enc.lone is not None and 1000 < sum(map(tokens.lone, texts)) < 7000


def test_ids_are_counted_as_they_are_written(spark, tmp_path, monkeypatch):
    """Raw ids pass through Python twice, to be made and to be coded; their counts come from the first pass."""
    raw, plain = [], Tables.save
    monkeypatch.setattr(Tables, "save", lambda self, df, name: raw.append(plain(self, df, name).cache()) or raw[-1])
    monkeypatch.setattr(token_store, "BLOCK", 3000)
    token_store.write(queries.table(spark, SF, "documents"), str(tmp_path), queries.TOKENIZER)
    rows = raw[0].collect()
    want = np.zeros(1 << 16, np.int64)
    for r in rows:
        if r.block >= 0:
            want += np.bincount(np.frombuffer(r.ids, "<u2"), minlength=len(want))
    for r in rows:
        if r.block < 0:
            want[r.seen] -= r.counts
    assert not want.any() and sum(r.block < 0 for r in rows) >= 1
    raw[0].unpersist()
