"""A file format for token ids: static range asymmetric numeral systems in independent blocks.

Layout of a store, in one folder:

- ``table``: one row ``(id, freq)`` for each id that occurs; the frequencies sum to ``2**SCALE``. All
  blocks share it, and name its checksum.
- ``blocks``: one row per block of whole documents, in ascending key order within and across shards:
  ``shard``, ``block``, ``first`` (ids of the shard before the block), ``n_tokens``, ``doc_ids``, ``lengths`` and
  ``payload``.

A payload is ``TWR1``, the table's CRC-32, the number of segments, a checkpoint for each segment (its
byte offset, ids, lanes, CRC-32 of its ids) and the segments, of SEGMENT ids each. A segment interleaves its ids over
up to LANES coder states of 64 bits that share one stream of 32-bit words; it can be decoded with the
table alone. So all blocks decode in parallel, and ``read_range`` starts at the checkpoint before its first id
and stops at the segment of its last: the rest of a block is neither decoded nor checked.

Defined results: null texts are empty documents with the end id alone; rows of equal keys are
in order of their texts' hash, null keys first; an empty table gives an empty store. A range is cut to the ids there are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraweave.llm.common import Tables, partitions
from terraweave.llm.tokens import encoder

SCALE = 20
LANES = 1024
#: A lane's state takes eight bytes, so a lane serves so many ids at least.
PER_LANE = 128
SEGMENT = 1 << 15
#: So many segments of one block are coded side by side: a step of the coder then fills its vectors.
TOGETHER = 16
BLOCK = 1 << 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MASK = np.uint64((1 << 32) - 1)


class Table:
    """Static frequencies, scaled so that every id that occurs keeps a share."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freqs = ids.astype(np.uint32), freqs.astype(np.uint32)
        size = int(self.ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[self.ids] = self.freqs
        self.start = np.zeros(size, np.uint64)
        self.start[1:] = np.cumsum(self.freq)[:-1]
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.freqs.tobytes(), zlib.crc32(self.ids.tobytes()))

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        by = np.argsort(ids)
        ids, counts = ids[by], counts[by].astype(np.float64)
        if not len(ids):
            return cls(ids, counts)
        freqs = 1 + np.floor(counts / counts.sum() * ((1 << SCALE) - len(ids))).astype(np.int64)
        freqs[counts.argmax()] += (1 << SCALE) - freqs.sum()
        return cls(ids, freqs)


def encode_segments(ids: np.ndarray, table: Table) -> tuple[int, list[bytes]]:
    """The lanes of a segment and the segments' bytes, of segments of equal length: a row of ``ids`` each, coded side by side."""
    rows, n = ids.shape
    lanes = max(1, min(LANES, n // PER_LANE))
    state = np.full((rows, lanes), LOW, np.uint64)
    words: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    shift, most = np.uint64(SCALE), np.uint64(63 - SCALE)
    freq, start = table.freq[ids], table.start[ids]
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        f, c = freq[:, at : at + lanes], start[:, at : at + lanes]
        x = state[:, : f.shape[1]]
        full = x >= (f << most)
        words.append((x[full] & MASK).astype("<u4"))
        counts.append(full.sum(axis=1))
        x = np.where(full, x >> WORD, x)
        q = x // f
        state[:, : f.shape[1]] = (q << shift) + (x - q * f) + c
    stream = np.concatenate(words[::-1])
    owner = np.repeat(np.tile(np.arange(rows, dtype=np.uint8), len(counts)), np.concatenate(counts[::-1]))
    own = np.split(stream[np.argsort(owner, kind="stable")], np.cumsum(sum(counts))[:-1])
    return lanes, [s.tobytes() + w.tobytes() for s, w in zip(state.astype("<u8"), own)]


def decode_segments(data: list[bytes], n: int, lanes: int, table: Table) -> np.ndarray:
    """The ids, a row for each segment, of segments of ``n`` ids each."""
    rows = len(data)
    state = np.stack([np.frombuffer(d, "<u8", lanes) for d in data]).astype(np.uint64)
    streams = [np.frombuffer(d, "<u4", offset=8 * lanes) for d in data]
    words = np.concatenate(streams).astype(np.uint64)
    at = np.cumsum([0, *map(len, streams[:-1])])
    out = np.empty((rows, n), np.uint32)
    shift, mask = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    for i in range(0, n, lanes):
        x = state[:, : min(lanes, n - i)]
        slot = x & mask
        s = table.symbol[slot]
        out[:, i : i + lanes] = s
        x = table.freq[s] * (x >> shift) + slot - table.start[s]
        low = x < LOW
        need = low.sum(axis=1)
        ends = np.cumsum(need)
        place = np.arange(ends[-1]) + np.repeat(at - ends + need, need)
        if len(place) and place[-1] >= len(words):
            raise ValueError("a segment's words end before its ids")
        x[low] = (x[low] << WORD) | words[place]
        at += need
        state[:, : x.shape[1]] = x
    return out


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    whole = len(ids) // SEGMENT
    groups = [ids[i * SEGMENT : min(i + TOGETHER, whole) * SEGMENT].reshape(-1, SEGMENT) for i in range(0, whole, TOGETHER)]
    if len(ids) > whole * SEGMENT:
        groups.append(ids[whole * SEGMENT :].reshape(1, -1))
    parts, points, at = [], [], 0
    for group in groups:
        lanes, data = encode_segments(group, table)
        for part, coded in zip(group, data):
            points.append(struct.pack("<QIII", at, len(part), lanes, zlib.crc32(part.astype("<u4").tobytes())))
            at += len(coded)
        parts += data
    return b"".join([b"TWR1", struct.pack("<II", table.crc, len(points)), *points, *parts])


def decode_range(payload: bytes, table: Table, start: int = 0, end: int | None = None) -> np.ndarray:
    """The ids of a block from ``start`` up to ``end``, from the segments that hold them."""
    crc, n = struct.unpack_from("<II", payload, 4)
    if payload[:4] != b"TWR1" or crc != table.crc:
        raise ValueError("not a block of this table")
    points = [struct.unpack_from("<QIII", payload, 12 + 20 * i) for i in range(n)]
    base = 12 + 20 * n
    stops = [base + p[0] for p in points[1:]] + [len(payload)]
    firsts = np.cumsum([0, *(p[1] for p in points)]).tolist()
    wanted = [i for i in range(n) if firsts[i + 1] > start and (end is None or firsts[i] < end)]
    out, i = [], 0
    while i < len(wanted):
        _, size, lanes, _ = points[wanted[i]]
        group = [j for j in wanted[i : i + TOGETHER] if points[j][1:3] == (size, lanes)]
        got = decode_segments([payload[base + points[j][0] : stops[j]] for j in group], size, lanes, table)
        for j, part in zip(group, got):
            if zlib.crc32(part.astype("<u4").tobytes()) != points[j][3]:
                raise ValueError(f"segment {j} fails its checksum")
        out.append(got.ravel())
        i += len(group)
    if not out:
        return np.zeros(0, np.uint32)
    first = firsts[wanted[0]]
    return np.concatenate(out)[max(0, start - first) : None if end is None else max(0, end - first)]


def write(df: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2) -> None:
    """Writes the ids of every text of ``df``, each followed by ``end``, as a store at ``path``."""
    spark = df.sparkSession
    tables = Tables(spark)
    wide = encoder(tokenizer).size > 1 << 16
    dtype = "<u4" if wide else "<u2"
    kind = df.schema[key].dataType
    raw_schema = f"block long, first long, n_tokens long, doc_ids array<{kind.simpleString()}>, lengths array<long>, ids binary"
    # A task's last row counts its ids, so they are not read once more for the table.
    counted = f"{raw_schema}, seen array<long>, counts array<long>"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), np.array([end], np.uint32)
        held: list[np.ndarray] = []
        keys: list = []
        size = first = block = 0
        total, key_type = np.zeros(max(enc.size, end + 1), np.int64), None

        def row(*values: object) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(key_type), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["block", "first", "n_tokens", "doc_ids", "lengths", "ids", "seen", "counts"])

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            np.add(total, np.bincount(ids, minlength=len(total)), out=total)
            return row(block, first, size, list(keys), [len(h) for h in held], ids.astype(dtype).tobytes(), None, None)

        for batch in batches:
            key_type = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.concatenate([enc.ids(t.as_py()), tail]))
                keys.append(k)
                size += len(held[-1])
                if size >= BLOCK:
                    yield flush()
                    first, block, size, held, keys = first + size, block + 1, 0, [], []
        if held:
            yield flush()
        if key_type is not None:
            seen = np.flatnonzero(total)
            yield row(-1, first, 0, [], [], None, seen, total[seen])

    order = [F.col(key).asc_nulls_first(), F.xxhash64(text)]
    by_range = df.select(F.col(key), F.col(text)).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    raw = tables.save(by_range.mapInArrow(tokenize, counted).withColumn("shard", F.spark_partition_id()), "raw")
    # The vocabulary bounds these rows.
    counts = raw.filter("block < 0").select(F.inline(F.arrays_zip("seen", "counts"))).groupBy(F.col("seen").alias("id")).agg(F.sum("counts").alias("n")).toPandas()
    table = Table.of_counts(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    ids, freqs = table.ids, table.freqs

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Table(ids, freqs)
        for batch in batches:
            payload = [encode_block(np.frombuffer(b.as_py(), dtype).astype(np.int64), shared) for b in batch.column(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(payload, pa.binary())], names=[*batch.schema.names[:6], "payload"])

    rows = spark.createDataFrame([(int(i), int(f)) for i, f in zip(ids, freqs)], "id long, freq long")
    rows.coalesce(1).write.parquet(f"{path}/table")
    blocks = raw.filter("block >= 0").select("shard", "block", "first", "n_tokens", "doc_ids", "lengths", "ids")
    out = raw_schema.replace("ids binary", "payload binary")
    blocks.mapInArrow(encode, f"shard int, {out}").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    tables.drop("raw")


def _opened(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, DataFrame, dict[int, int], int]:
    """The table's ids and frequencies, the blocks, the first id of each shard and the number of ids."""
    rows = spark.read.parquet(f"{path}/table").toPandas()  # bounded by the vocabulary
    ids, freqs = rows["id"].to_numpy(np.int64), rows["freq"].to_numpy(np.int64)
    order = np.argsort(ids)
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row for each shard, of which there are as many as partitions were written.
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())
    firsts, total = {}, 0
    for shard, n in totals:
        firsts[shard], total = total, total + n
    return ids[order], freqs[order], blocks, firsts, total


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of a store and, with ``ids``, its ids."""
    by_id, freqs, blocks, firsts = _opened(spark, path)[:4]
    kind = blocks.schema["doc_ids"].dataType
    assert isinstance(kind, T.ArrayType)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(by_id, freqs)
        for batch in batches:
            shards, first = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                keys, lengths = batch.column(2)[i].values, batch.column(3)[i].values.to_numpy()
                got = decode_range(batch.column(4)[i].as_py(), table)
                ends = np.cumsum(lengths)
                if (ends[-1] if len(ends) else 0) != len(got):
                    raise ValueError("a block's index does not fit its ids")
                docs = np.split(got.astype("<u4"), ends[:-1])
                start = firsts[shards[i]] + first[i] + ends - lengths
                columns = [keys, pa.array(start), pa.array(lengths), pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())]
                if ids:
                    columns.append(pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    schema = f"doc_id {kind.elementType.simpleString()}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return blocks.select("shard", "first", "doc_ids", "lengths", "payload").mapInArrow(decode, schema)


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """``(start, ids)``: the ``n`` ids of the store from ``start`` on, a row for each block that holds some of them."""
    by_id, freqs, blocks, firsts, total = _opened(spark, path)
    end = min(start + n, total)
    held = [shard for shard, first in firsts.items() if first < end]
    last = held[-1] if held else -1
    one = max((shard for shard in held if firsts[shard] <= start), default=-1)
    shard, first = F.col("shard"), F.col("first")
    # Shards between the first and the last are wanted whole.
    wanted = blocks.filter(shard.between(one, last))
    wanted = wanted.filter((shard != one) | (first + F.col("n_tokens") > start - firsts.get(one, 0))).filter((shard != last) | (first < end - firsts.get(last, 0)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(by_id, freqs)
        for batch in batches:
            for shard, first, payload in zip(*(c.to_pylist() for c in batch.columns)):
                at = firsts[shard] + first
                ids = decode_range(payload, table, max(0, start - at), end - at)
                yield pa.RecordBatch.from_arrays([pa.array([max(start, at)]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], names=["start", "ids"])

    return wanted.select("shard", "first", "payload").mapInArrow(decode, "start long, ids array<long>")
