"""Cost-balanced packing of tokenized documents into sequences.

Attention costs a sequence ``LINEAR * n + QUADRATIC * n * n`` for each of its pieces of ``n`` tokens.
A document is cut into full sequences and a remainder; remainders are taken in descending order
and each goes to the sequence of the lowest cost that has room for it. One that fits nowhere
is cut, and its head fills the lowest-cost sequence with any room.

Every task packs what it reads in chunks of about a million tokens, in one pass: nothing is
shuffled, memory is bounded by a chunk and the longest document, and a chunk's sequences hold
exactly its tokens. What is left of a chunk under one sequence is laid out in sequences of powers
of two, so no position is padded.

Defined results: a null text is empty and has the end id alone; repeated rows are packed one by
one; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.llm.tokens import encoder

LINEAR = 1.0
QUADRATIC = 1.0 / 1024
CHUNK = 1 << 20


def pack(lengths: np.ndarray, size: int) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces ``(document, start, length, sequence, offset)`` and the capacity of each sequence."""
    pieces: list[tuple[int, int, int, int, int]] = []
    full = lengths // size
    caps = [size] * int(full.sum())
    s = 0
    for d in np.flatnonzero(full).tolist():
        for j in range(int(full[d])):
            pieces.append((d, j * size, size, s, 0))
            s += 1
    rest = lengths - full * size
    total = int(rest.sum())
    new = [size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if (total % size) >> b & 1]
    caps += new
    room = np.array(new, np.int64)
    caps_new = room.copy()
    cost = np.zeros(len(new))
    for d in np.argsort(-rest, kind="stable").tolist():
        left, start = int(rest[d]), int(full[d]) * size
        while left:
            fits = np.where(room >= left, cost, np.inf)
            b = int(fits.argmin())
            if room[b] < left:
                b = int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[b]))
            pieces.append((d, start, n, s + b, int(caps_new[b] - room[b])))
            room[b] -= n
            cost[b] += LINEAR * n + QUADRATIC * n * n
            left, start = left - n, start + n
    return pieces, caps


SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long, row_id long"


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 1024, end: int = 0, ids: bool = False) -> DataFrame:
    """One row per piece, in the columns of SCHEMA and, with ``ids``, the piece's ``ids``. ``size`` is a
    power of two. Sequence ids tell the task and its count, and so does ``row_id``, which tells pieces of repeated rows apart. Over
    stored files the pieces are always the same; rows that come from a shuffle should be stored first."""
    schema = SCHEMA.format(kind=df.schema[key].dataType.simpleString()) + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), np.array([end], np.uint32)
        first = first_row = TaskContext.get().partitionId() << 36
        keys: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, first_row
            pieces, caps = pack(np.array([len(h) for h in held], np.int64), size)
            parts = [held[d][s : s + n] for d, s, n, _, _ in pieces]
            columns = [
                pa.array([keys[p[0]] for p in pieces], key_type),
                *(pa.array([p[i] for p in pieces], pa.int64()) for i in (1, 2)),
                pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                pa.array([len(held[p[0]]) for p in pieces], pa.int64()),
                pa.array([first + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([caps[p[3]] for p in pieces], pa.int64()),
                pa.array([first_row + p[0] for p in pieces], pa.int64()),
            ]
            if ids:
                columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
            first, first_row = first + len(caps), first_row + len(held)
            keys.clear(), held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.concatenate([enc.ids(t.as_py()), tail]))
                keys.append(k)
                tokens += len(held[-1])
                if tokens >= CHUNK:
                    yield flush()
                    tokens = 0
        if held:
            yield flush()

    names = [part.split(" ")[0] for part in schema.split(", ")]
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
