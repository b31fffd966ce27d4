"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt evenly to blocks of at most VALUES components. In a block every dimension has the list of its vectors in order of their
component. A query reads all lists in parallel from the end that favours it, scores what it
sees for the first time in full, and stops when the bound on unseen vectors, the sum of the best
values that the lists still hold, is below its k-th score.

A query first visits one block, and its k-th score there is its threshold everywhere: it is sent on only to blocks whose own
bound (the ends of their lists) reaches the threshold, and in these it stops as soon as the lists' bound falls below it. Every vector is
shuffled twice and a query once for each block that it cannot rule out. Blocks grow to VALUES before their number does: it is that of the shuffle
partitions up to 65,536 vectors of 64 components for each.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; shorter vectors count as padded with zeros; a query's own id is none of its
candidates, in repeated rows either; other repeated rows are candidates each; a query id on several rows asks once, with
the smallest of its vectors; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraweave.llm.common import Tables, partitions

#: Components of a block at most, and its least number of vectors where there are tasks to spare.
VALUES = 1 << 22
LEAST = 1024
#: Components of all blocks' bounds that the driver holds at most; beyond it no block is ruled out.
BOUNDS = 1 << 22
STEP = 16


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _matrix(rows: pa.ListArray, width: int | None = None) -> np.ndarray:
    lengths = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), width or 0)), np.int64)
    at = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - at] = flat
    return out


class Block:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.most = np.abs(vectors).max(axis=0, initial=0).astype(np.float64)
        self.floats = vectors.astype(np.float64)

    def search(self, own: int, query: np.ndarray, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, fewer if there are not as many. Scores below ``least`` may be left out."""
        n = len(self.ids)
        width = self.vectors.shape[1]
        q = np.zeros(width, np.int64)
        q[: min(width, len(query))] = query[:width]
        exact = (self.most * np.abs(q)).sum() < 2.0**53
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.ids == own
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, STEP
        while True:
            end = min(n, at + step)
            new = np.zeros(n, bool)
            new[self.order[n - end : n - at][:, up]] = True
            new[self.order[at:end][:, down]] = True
            if end == n:
                new[:] = True
            fresh = np.flatnonzero(new & ~seen)
            seen[fresh] = True
            if len(fresh):
                got = (self.floats[fresh] @ q.astype(np.float64)).astype(np.int64) if exact else self.vectors[fresh] @ q
                ids, scores = np.concatenate([ids, self.ids[fresh]]), np.concatenate([scores, got])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
            if end == n:
                return ids, scores
            # What is not seen stands at ``end`` or behind in every list.
            bound = int(q[up] @ self.sorted[n - 1 - end, up] + q[down] @ self.sorted[end, down])
            if len(ids) == k and scores.min() > bound or least is not None and bound < least:
                return ids, scores
            at, step = end, 2 * step


def _searched(both: DataFrame, k: int, bounds: bool) -> DataFrame:
    """``(query_id, vec_id, score)`` of ``both(block, kind, id, v, least)``, sorted by block and kind: vectors, then queries. With ``bounds`` also a
    row for each block, with the ends of its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        number, block = -1, None

        def built() -> Block:
            width = max(v.shape[1] for _, v in held)
            return Block(np.concatenate([i for i, _ in held]), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in held]))

        def ends() -> Iterator[pa.RecordBatch]:
            if bounds and (block or held):
                lists = (block or built()).sorted
                low, high = (pa.array([list(map(int, x))], pa.list_(pa.int64())) for x in (lists[0], lists[-1]))
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array([number], pa.int64()), low, high], names=names)

        for batch in batches:
            blocks, kinds, ids = (batch.column(i).to_numpy() for i in range(3))
            values, least = _matrix(batch.column(3)), batch.column(4).to_pylist()
            cuts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), True])
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if blocks[a] != number:
                    yield from ends()
                    number, held, block = int(blocks[a]), [], None
                if kinds[a] == 0:
                    held.append((ids[a:b], values[a:b]))
                    continue
                if block is None and held:
                    block, held = built(), []
                if block is not None:
                    out += [(int(ids[i]), *block.search(int(ids[i]), values[i], k, least[i])) for i in range(a, b)]
            out = [o for o in out if len(o[1])]
            if out:
                counts = [len(o[1]) for o in out]
                n, empty = sum(counts), pa.list_(pa.int64())
                columns = [pa.array(np.repeat([o[0] for o in out], counts)), *(pa.array(np.concatenate([o[i] for o in out])) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, empty), pa.nulls(n, empty)], names=names)
        yield from ends()

    names = ["query_id", "vec_id", "score", "block", "low", "high"]
    return both.mapInArrow(run, "query_id long, vec_id long, score long, block long, low array<long>, high array<long>")


def _sent(asked: DataFrame, n_blocks: int, ends: list) -> DataFrame:
    """``asked(id, v, least, home)`` once for every block but its home that may hold a score of ``least``."""
    width = max((len(r.low) for r in ends), default=0)
    low, high = np.zeros((2, len(ends), width), np.float64)
    known = np.array([r.block for r in ends], np.int64)
    for i, r in enumerate(ends):
        low[i, : len(r.low)], high[i, : len(r.high)] = r.low, r.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = np.zeros((part.num_rows, width))
                values = _matrix(part.column(1))[:, :width]
                q[:, : values.shape[1]] = values
                most = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) + 1
                least = np.array([-np.inf if x is None else x for x in part.column(2).to_pylist()])
                row, to = np.nonzero((most + slack >= least[:, None]) & (known[None, :] != part.column(3).to_numpy()[:, None]))
                for a in range(0, len(row), 10_000):
                    taken = part.take(pa.array(row[a : a + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(known[to[a : a + 10_000]]), *taken.columns[:3]], names=["block", "id", "v", "least"])

    if not ends:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block")
        return asked.select(every, "id", "v", "least", "home").filter("block <> home").drop("home")
    return asked.select("id", "v", "least", "home").mapInArrow(run, "block long, id long, v array<long>, least long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for ``vectors(id, v)`` and ``queries(id, v)``, ``v`` arrays of long."""
    tables = Tables(vectors.sparkSession)
    spark = vectors.sparkSession
    rows = tables.save(vectors.filter("id is not null").select(F.col("id").cast("long").alias("id"), "v"), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    fits = max(1, VALUES // max(width, 1))
    n_blocks = max(1, -(-n // fits), min(partitions(spark), n // LEAST))
    some = F.lit(None).cast("long").alias("least")
    dealt = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).alias("block"), F.lit(0).alias("kind"), "id", "v", some)
    asked = queries.filter("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min("v").alias("v"))
    asked = tables.save(asked.withColumn("home", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), "asked")

    def search(asked: DataFrame, bounds: bool, name: str) -> DataFrame:
        both = dealt.unionByName(asked.select("block", F.lit(1).alias("kind"), "id", "v", "least"))
        both = both.repartition(max(n_blocks, partitions(spark)), "block").sortWithinPartitions("block", "kind")
        return tables.save(_searched(both, k, bounds), name)

    first = search(asked.select(F.col("home").alias("block"), "id", "v", some), n_blocks * width <= BOUNDS, "first")
    found = first.filter("query_id is not null").select("query_id", "vec_id", "score")
    if n_blocks > 1:
        ends = first.filter("block is not null").select("block", "low", "high").collect() if n_blocks * width <= BOUNDS else []  # a row for each block
        kth = found.groupBy(F.col("query_id").alias("__tw_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        asked = asked.join(kth, F.col("id") == F.col("__tw_id"), "left").select("id", "v", "least", "home")
        others = search(_sent(asked, n_blocks, ends), False, "others")
        found = found.unionByName(others.select("query_id", "vec_id", "score"))
    tables.drop("vectors", "asked")
    tables.keep_until_exit()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
