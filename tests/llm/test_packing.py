import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from terraweave.llm import packing, queries
from terraweave.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


def check(rows, docs):
    plain = Tokenizer.from_file(queries.TOKENIZER)
    ids = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for k, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.padded))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for k, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == len(ids[k])
    assert pieces.keys() == ids.keys()
    for own in sequences.values():
        at = 0
        for offset, n, _ in sorted(own):
            assert offset == at
            at += n
        assert at == own[0][2] <= 1024 and (at == 1024 or at & (at - 1) == 0)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    check(queries.op2_cost_packing(spark, SF).collect(), docs)


def test_odd_texts(spark):
    docs = [(1, None), (2, ""), (3, "word <|endoftext|> " * 3000), (4, "\n\n \t x  "), (5, "é漢字🙂  ½ it's"), (None, "none")]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, padded int")
    check(packing.pack_documents(df, queries.TOKENIZER).collect(), docs)
    assert packing.pack_documents(df.limit(0), queries.TOKENIZER).count() == 0
    with_ids = packing.pack_documents(df, queries.TOKENIZER, ids=True).collect()
    assert all(len(r.ids) == r.length for r in with_ids)


def test_costs_are_balanced():
    lengths = np.random.default_rng(1).integers(1, 900, 800)
    pieces, caps = packing.pack(lengths, 1024)
    cost = np.zeros(len(caps))
    for _, _, n, s, _ in pieces:
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = cost[np.array(caps) == 1024]
    assert full.std() / full.mean() < 0.12 and len(pieces) < len(lengths) + len(caps)


def test_both_libraries_agree(spark):
    enc = Encoder(queries.TOKENIZER)
    assert enc.fast is not None
    for r in queries.table(spark, SF, "documents").collect():
        assert enc.ids(r.text).tolist() == enc.plain.encode(r.text or "", add_special_tokens=False).ids
