"""Near-duplicate documents by SimHash, linked through an index of fingerprint bytes.

A fingerprint has eight bytes. Two that differ in three bits or fewer share five bytes at equal
positions or more. The index posts every distinct fingerprint under each of fourteen sets of
four byte positions, the blocks of the Steiner system S(3, 4, 8): any three positions that may
differ lie in the complement of exactly one block, so such a pair meets in at least one posting
list. In a list the shared positional bytes of a pair are tallied, pairs reaching five are
verified by their differing bits, and linked pairs are merged into components.

Lists are keyed by 32 bits of the fingerprint and hold distinct fingerprints only, so copies
add nothing to them. A list of more than ``LONG`` fingerprints is searched by flipping up to three
of the free bits and looking the result up, which is linear in the list, with no cap on it.

Defined results: a null or wordless text has fingerprint zero, linked like any other; fewer words
than a shingle give one shingle of them all; repeated rows share fingerprint and component; a
component of rows without an id has a null one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.llm.common import Tables, partitions, without
from terraweave.llm.components import components, star
from terraweave.llm.similar import kept_rows, text_hash

BITS = 3
SHARED = 8 - BITS
LONG = 50_000
BATCH = 200_000


def _blocks() -> list[tuple[int, ...]]:
    """The fourteen planes of the affine space of three bits: sets of four that sum to zero."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


BLOCKS = _blocks()
MASKS = np.array([sum(0xFF << (8 * p) for p in b) for b in BLOCKS], np.uint64)


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return digest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    ends = ends[shingle - 1 :].tolist()
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def with_fingerprints(df: DataFrame, text: str, shingle: int, seed: int) -> DataFrame:
    """``df`` less ``text``, with a long column ``fp``."""
    rest = [f for f in df.schema.fields if f.name not in (text, "fp")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["fp long"])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__tw_text"))
            fps = [0 if t is None else fingerprint(t, shingle, seed) for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(_signed(fps))], names=[*names, "fp"])

    columns = [F.col(f"`{n}`") for n in names]
    return df.select(*columns, F.col(text).cast("binary").alias("__tw_text")).mapInArrow(run, schema)


def posted(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints of all postings: the block's bytes, with its number mixed in."""
    keys = [(fps & m) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i) for i, m in enumerate(MASKS)]
    return np.concatenate(keys), np.tile(fps, len(MASKS))


def _tally(x: np.ndarray) -> np.ndarray:
    """The number of zero bytes of each value."""
    return (x.reshape(-1, 1).view(np.uint8) == 0).sum(axis=1)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(a ^ b)
    ok = _tally(x) >= SHARED
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


def _flips(free: int) -> np.ndarray:
    bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    return np.array([np.bitwise_or.reduce(c) for k in range(1, BITS + 1) for c in combinations(bits, k)], np.uint64)


def _search_long(fps: np.ndarray, mask: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of one long list. ``fps`` is sorted and distinct."""
    for flip in _flips(~mask & (1 << 64) - 1):
        other = fps ^ flip
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        hit = (fps[at] == other) & (fps < other)
        if hit.any():
            yield fps[hit], other[hit]


def _links(keys: np.ndarray, blocks: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within lists; all arrays are sorted by key."""
    cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1]), True])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lengths = np.diff(cuts)
    for g in np.flatnonzero(lengths > LONG):
        part = np.unique(fps[cuts[g] : cuts[g + 1]])
        pairs = list(_search_long(part, int(MASKS[blocks[cuts[g]]])))
        if pairs:
            found.append(star(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])))
    short = np.repeat(lengths <= LONG, lengths) & np.repeat(lengths > 1, lengths)
    keys, fps = keys[short], fps[short]
    end = np.searchsorted(keys, keys, side="right") if len(keys) else np.zeros(0, np.int64)
    gap, at = 1, np.arange(len(keys))
    while True:
        at = at[at + gap < end[at]]
        if not len(at):
            break
        ok = _near(fps[at], fps[at + gap])
        if ok.any():
            found.append((fps[at][ok], fps[at + gap][ok]))
            if sum(len(f[0]) for f in found) > 4 * BATCH:
                found = [star(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))]
        gap += 1
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return star(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def links(distinct: DataFrame) -> DataFrame:
    """``(u, v)``: for each posting list a forest that connects what it links. ``distinct(fp)``."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, values = posted(fps)
            blocks = np.repeat(np.arange(len(MASKS), dtype=np.int8), len(fps))
            for i in range(0, len(keys), BATCH):
                s = slice(i, i + BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(keys[s].view(np.int64)), pa.array(blocks[s]), pa.array(values[s].view(np.int64))], names=["key", "block", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            u, v = _links(rows[0], rows[1], rows[2].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()]))
            size += batch.num_rows
            if size >= BATCH:
                rows = np.concatenate(held, axis=1)
                last = np.searchsorted(rows[0], rows[0][-1])  # the last list may go on
                if last:
                    yield out(rows[:, :last])
                held, size = [rows[:, last:]], rows.shape[1] - last
        if size:
            yield out(np.concatenate(held, axis=1))

    lists = distinct.select("fp").mapInArrow(post, "key long, block byte, fp long")
    n = partitions(distinct.sparkSession)
    return lists.repartition(n, "key").sortWithinPartitions("key", "block").mapInArrow(search, "u long, v long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """``(key, fp, fingerprint, component_id)`` for every row of ``df``: the smallest key that is
    reachable over links of three differing bits or fewer."""
    tables = Tables(df.sparkSession)
    marked = tables.save(with_fingerprints(df.select(F.col(key), F.col(text)), text, shingle, seed), "fingerprints")
    distinct = tables.save(marked.groupBy("fp").agg(F.min(key).alias("__tw_first")), "distinct")
    edges = tables.save(links(distinct), "links")
    grouped = distinct.join(components(tables, edges), F.col("fp") == F.col("node"), "left").withColumn("__tw_root", F.coalesce("root", "fp"))
    grouped = tables.save(grouped.select("fp", "__tw_root", "__tw_first"), "grouped")
    least = grouped.groupBy("__tw_root").agg(F.min("__tw_first").alias("component_id"))
    by_fp = tables.save(grouped.join(least, "__tw_root").select("fp", "component_id"), "by_fp")
    tables.drop("distinct", "links", "grouped")
    tables.keep_until_exit()
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(by_fp, "fp").select(key, "fp", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``df`` with one document of each group of near-duplicates, the one with the smallest key.

    Near-duplicates have a similarity of 0.8 or more, which three bits of a short fingerprint cannot find; ``similar`` indexes a longer one and verifies.
    A row is known by its key and text: other rows of the same key are judged by their own texts, ties of the smallest key go to the
    smaller hash of the text, and of rows with equal key and text one stays. Of a group's rows without a key one stays as well."""
    kept = kept_rows(df, key, text, shingle).select(F.col("k").alias("__tw_key"), F.col("t").alias("__tw_t"))
    hashed = df.withColumn("__tw_hash", text_hash(text))
    once = hashed.join(kept, F.col(key).eqNullSafe(F.col("__tw_key")) & (F.col("__tw_hash") == F.col("__tw_t")))
    return without(once.dropDuplicates([key, "__tw_hash"]), "__tw_key", "__tw_t", "__tw_hash")
