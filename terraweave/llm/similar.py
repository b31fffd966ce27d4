"""Near-duplicate documents at a similarity of 0.8 of their word shingles, by SimHash, for the pipeline's stage.

The method is that of ``simhash``: a fingerprint of sign bits, an index of its bytes by position, a tally of what pairs that meet
there have in common, and a verification. 64 bits and three that differ cannot say a similarity of 0.8, at which pairs differ in
ten of 64 bits (median). So a fingerprint has BITS sign bits here, each the majority of one bit of a set's shingle hashes: sets
of a Jaccard similarity of 0.8 or more differ in a bit with a probability of acos(8/9) / pi = 0.152 at most, small ones of 0.161.

The index posts a document under each of the BITS / 16 pairs of neighbouring bytes. At a similarity of 0.8 two documents share
a pair of bytes with a probability of 0.07, and so meet in one list at least with 1 - 6e-6 (1 - 5e-5 at 0.161, twelve shingles of fifteen). Four
shingles of five are the one case that differs in more (0.188): sets of four or five are posted under their subsets of four as well.
Documents that meet tally the bits they share of TALLIED, and pairs that differ in APART of these or fewer are candidates; APART lies five
deviations above 0.152. A tally decides nothing else: candidates form components, the shingle
hashes of a component's documents are brought together, and documents are linked if their sets have a Jaccard similarity of
SIMILAR or more. Linked documents form the components that are returned.

Documents with equal sets are one row of the index. A list of more than LONG rows is dealt to blocks, and each pair of blocks is
searched on its own, so that no task holds a list; a component of candidates of many rows (see MANY) or more than WIDE hashes likewise.
What the first round of postings connects is posted under its root in the others, and forests of many lists are replaced by fewer edges (see ``thinned``).
Within a block rows leave the search when they are reached (in a list by the tally, in a component by a verified link),
so a group of copies costs about its size times the number of its layers.

Defined results: wordless and null texts are copies of one another; fewer words than a shingle make one shingle of them all;
repeated rows are copies; a component of rows without a key has a null one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.llm.common import Tables, partitions
from terraweave.llm.components import components, star

BITS = 2560
TALLIED = 256
APART = 72
#: The postings are searched in so many rounds, to keep the disk that their shuffles need low.
ROUNDS = 4
#: The least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
LONG = 50_000
#: A component of candidates with more rows (or than a quarter of a task's share) or more hashes is verified in pairs of blocks.
MANY = 400
WIDE = 1_000_000
#: Lists up to this length are compared pair by pair, many lists at once.
SHORT = 256
BATCH = 100_000
#: So many pairs are held before a forest of them takes their place.
PAIRS = 1_000_000
#: So many edges are brought together by one task, for a forest of theirs to take their place.
EDGES = 200_000
#: One of so many rows tells which lists are long.
SAMPLE = 16
WORDS = TALLIED // 64
#: Shingle hashes that are counted at once: a lane of a byte holds their number.
COUNTED = 240

_rng = np.random.default_rng(17)
_FACTORS = _rng.integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIES = _rng.integers(0, 2, BITS).astype(bool)
_SHIFTS = [np.array([0, 1 << i], np.uint64)[None, :, None, None] for i in range(3)]
_LANES = [np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F)]


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[shingle - 1 :].tolist() or [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends)), np.uint64, n)


def hash_words(hashes: np.ndarray) -> np.ndarray:
    """BITS bits of each hash."""
    x = hashes[:, None] * _FACTORS
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def fingerprint(hashes: np.ndarray) -> bytes:
    """The sign bits of a set: which of the BITS bits most hashes have; a constant decides where half of them do.

    Bits are added up in lanes of two, four and eight bits, by threes, fives and the rest. The lanes leave the positions in
    another order than that of the words, the same for all sets.
    """
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), COUNTED):
        x = hash_words(hashes[i : i + COUNTED])
        x = np.concatenate([x, np.zeros((-len(x) % 15, x.shape[1]), np.uint64)])[None]
        for shift, lane, group in zip(_SHIFTS, _LANES, (3, 5, x.shape[1] // 15)):
            x = x[:, None] >> shift
            x &= lane
            x = x.reshape(-1, group, x.shape[2] // group, x.shape[3])
            x = x[:, 0] + x[:, 1] + x[:, 2] if group == 3 else x.sum(axis=1)
        counts += x.reshape(-1).view(np.uint8)
    return np.packbits(np.where(2 * counts == len(hashes), _TIES, 2 * counts > len(hashes))).tobytes()


def subset_keys(hashes: np.ndarray) -> list[int]:
    """Keys of a small set's subsets of four; none of other sets."""
    if not 4 <= len(hashes) <= 5:
        return []
    return [xxhash.xxh64_intdigest(np.array(c).tobytes(), 43) - (1 << 63) for c in combinations(hashes, 4)]


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("binary"))


def fingerprinted(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``(k, t, id, print, small)``: ``t`` is the text's hash, ``id`` that of its set of shingles, ``small`` the keys of its subsets."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, prints, small = [], [], []
                for t in batch.column(2).slice(at, 1000):
                    hashes = np.unique(shingle_hashes(t.as_py() or b"", shingle))
                    ids.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
                    prints.append(fingerprint(hashes))
                    small.append(subset_keys(hashes))
                k, t = (batch.column(i).slice(at, 1000) for i in range(2))
                ids = pa.array(np.array(ids, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([k, t, ids, pa.array(prints, pa.binary()), pa.array(small, pa.list_(pa.int64()))], names=["k", "t", "id", "print", "small"])

    return df.select(F.col(key), text_hash(text), F.col(text).cast("binary")).mapInArrow(run, f"k {kind}, t long, id long, print binary, small array<long>")


def flat(column: pa.Array, words: int) -> np.ndarray:
    """Binary values of so many words each, as rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def posted(distinct: DataFrame, round_no: int) -> DataFrame:
    """``(id, sketch, keys)`` of ``distinct(id, print)``: the bits that are tallied, and the keys of a round's postings: a pair's place and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = flat(batch.column(1), BITS // 64)
            places = np.arange(round_no, BITS // 16, ROUNDS)
            keys = (places << 16) + prints.view(np.uint16)[:, places].astype(np.int64)
            ends = pa.array(np.arange(len(prints) + 1, dtype=np.int32) * len(places))
            sketches = pa.array([x.tobytes() for x in prints[:, :WORDS]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sketches, pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))], names=["id", "sketch", "keys"])

    return distinct.select("id", "print").mapInArrow(run, "id long, sketch binary, keys array<long>")


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of sketches differ in APART bits or fewer."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= APART


def _forest(ids: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the tally finds close in one list, by a search in breadth over the rows not yet reached."""
    left = np.arange(len(ids))
    u, v = [], []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _close(sketches[left], sketches[at])
            if hit.any():
                u.append(ids[left[hit]])
                v.append(np.full(hit.sum(), ids[at]))
                queue += left[hit].tolist()
                left = left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(u), np.concatenate(v)) if u else (none, none)


def _links(keys: np.ndarray, ids: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest that connects what the tally finds close in any list; rows are sorted by key."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(cuts)
    none = np.zeros(0, np.int64)
    u, v, held = [none], [none], 0
    for g in np.flatnonzero(sizes > SHORT):
        part = slice(cuts[g], cuts[g + 1])
        for out, got in zip((u, v), _forest(ids[part], sketches[part])):
            out.append(got)
    end = np.repeat(cuts[1:], sizes)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes))
    gap = 1
    while len(at := at[at + gap < end[at]]):
        hit = at[_close(sketches[at], sketches[at + gap])]
        u.append(ids[hit])
        v.append(ids[hit + gap])
        held += len(hit)
        if held > PAIRS:
            pairs = star(np.concatenate(u), np.concatenate(v))
            u, v, held = [pairs[0]], [pairs[1]], 0
        gap += 1
    return star(np.concatenate(u), np.concatenate(v))


def links(tables: Tables, distinct: DataFrame) -> DataFrame:
    """``(u, v)`` of ``distinct(id, sketch, keys)``: edges that connect candidates; rows that are known to be connected may share an ``id``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            u, v = _links(*rows)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), flat(batch.column(2), WORDS)))
            size += batch.num_rows
            if size >= BATCH:
                rows = tuple(np.concatenate(c) for c in zip(*held))
                last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last list may go on
                if last:
                    yield out(tuple(c[:last] for c in rows))
                held, size = [tuple(c[last:] for c in rows)], len(rows[0]) - last
        if size:
            yield out(tuple(np.concatenate(c) for c in zip(*held)))

    lists = distinct.select(F.explode("keys").alias("key"), "id", "sketch")
    sample = distinct.filter(F.pmod(F.xxhash64("sketch"), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key"))
    long = sample.groupBy("key").agg((SAMPLE * F.count("*")).alias("count")).filter(F.col("count") > LONG)
    long = tables.save(long.coalesce(1), "long")
    if not long.isEmpty():
        # Rows of a long list go to all pairs of blocks that hold their own block.
        blocks = F.ceil(F.col("count") / (LONG // 2)).cast("long")
        dealt = lists.join(long, "key", "left").withColumn("own", F.pmod(F.xxhash64("sketch"), F.coalesce(blocks, F.lit(1).cast("long"))))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(blocks, F.lit(1).cast("long")) - 1)).alias("other")
        dealt = dealt.select("key", "id", "sketch", "count", "own", other)
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        lists = dealt.select(F.when(F.col("count").isNull(), F.col("key")).otherwise(pair).alias("key"), "id", "sketch")
    return lists.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key").mapInArrow(search, "u long, v long")


def shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """``(root, id, n, hashes)`` of ``df(root, id, text)``: the sorted hashes of each text's shingles and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sets = [np.unique(shingle_hashes(t.as_py() or b"", shingle)) for t in batch.column(2).slice(at, 1000)]
                columns = [*(batch.column(i).slice(at, 1000) for i in range(2)), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["root", "id", "n", "hashes"])

    return df.mapInArrow(run, "root long, id long, n long, hashes binary")


def _verified(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the sets of a Jaccard similarity of SIMILAR, by a search in breadth over the rows not yet reached."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(codes, np.cumsum(sizes)[:-1])
    marked = np.zeros(len(values), bool)
    left, flat = np.arange(len(ids)), codes
    u, v = [], []

    def take(keep: np.ndarray) -> None:
        nonlocal left, flat
        flat, left = flat[np.repeat(keep, sizes[left])], left[keep]

    while len(left) > 1:
        queue = [int(left[0])]
        take(np.arange(len(left)) > 0)
        while queue and len(left):
            at = queue.pop()
            marked[own[at]] = True
            sums = np.r_[0, np.cumsum(marked[flat])]
            marked[own[at]] = False
            ends = np.cumsum(sizes[left])
            shared = sums[ends] - sums[ends - sizes[left]]
            hit = SIMILAR[1] * shared >= SIMILAR[0] * (sizes[left] + sizes[at] - shared)
            if hit.any():
                u.append(ids[left[hit]])
                v.append(np.full(hit.sum(), ids[at]))
                queue += left[hit].tolist()
                take(~hit)
    none = np.zeros(0, np.int64)
    return (np.concatenate(u), np.concatenate(v)) if u else (none, none)


def verified(tables: Tables, sets: DataFrame) -> DataFrame:
    """``(u, v)`` of ``sets(root, id, n, hashes)``: for each root a forest that connects what is similar."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def out() -> pa.RecordBatch:
            u, v = _verified(np.array(list(held), np.int64), list(held.values()))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            for key, i, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key != group:
                    if len(held) > 1:
                        yield out()
                    group, held = key, {}
                held[i] = np.frombuffer(hashes.as_py(), np.uint64)
        if len(held) > 1:
            yield out()

    sizes = sets.select("root", "id", "n").distinct().groupBy("root").agg(F.count("*").alias("rows"), F.sum("n").alias("hashes"))
    many = max(MANY, sets.count() // (4 * partitions(sets.sparkSession)))
    blocks = F.greatest(F.ceil(F.col("rows") / (many // 2)), F.ceil(F.col("hashes") / (WIDE // 2))).cast("long")
    large = tables.save(sizes.filter((F.col("rows") > many) | (F.col("hashes") > WIDE)).select("root", blocks.alias("blocks")), "large")
    rows = sets.select(F.col("root").alias("key"), "id", "hashes")
    if not large.isEmpty():
        # Rows of a large component go to all pairs of blocks that hold their own block.
        dealt = sets.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
        dealt = dealt.select("root", "id", "hashes", "blocks", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        pair = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
        rows = dealt.select(F.when(F.col("blocks") == 1, F.col("root")).otherwise(pair).alias("key"), "id", "hashes")
    return rows.repartition(partitions(sets.sparkSession), "key").sortWithinPartitions("key").mapInArrow(search, "u long, v long")


def thinned(tables: Tables, edges: DataFrame, name: str) -> DataFrame:
    """Edges that connect what ``edges(u, v)`` connect, fewer of them.

    Each list and each pair of blocks has a forest of its own, so a group has an edge for each of its rows from every one of them.
    Forests of EDGES edges that are read together replace these, again and again while that halves them: a group that fits
    in one task ends with an edge for each row but one, however many lists it is in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            u, v = star(*(np.concatenate(c) for c in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= 2 * EDGES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    rows, last = edges.count(), None
    for i in count():
        tasks = max(1, -(-rows // EDGES))
        thin = tables.save(edges.coalesce(tasks).mapInArrow(run, "u long, v long"), f"{name}-{i}")
        if last:
            tables.drop(last)
        left, last = thin.count(), f"{name}-{i}"
        if tasks == 1 or 2 * left > rows:
            return thin
        edges, rows = thin, left


def grouped(tables: Tables, df: DataFrame, key: str, text: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """``(k, t, id)`` for every row of ``df``, and ``(id, root, first)``: each set's component and smallest key."""
    marked = tables.save(fingerprinted(df, key, text, shingle), "prints")
    # A set stands in the row of its smallest key; rows without one come last.
    one = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "t")).alias("one")
    distinct = marked.groupBy("id").agg(one, F.any_value("print").alias("print"), F.any_value("small").alias("small"))
    distinct = tables.save(distinct.select("id", F.col("one.k").alias("first"), F.col("one.t").alias("t"), "print", "small"), "distinct")
    # What the first round connects goes on under its root, so that the rounds after it have no edge for it again.
    first = thinned(tables, tables.save(links(tables, posted(distinct, 0)), "candidates-0"), "first")
    known = distinct.join(components(tables, first, "known"), F.col("id") == F.col("node"), "left")
    known = tables.save(known.select(F.coalesce("root", "id").alias("id"), "print", "small"), "rounds")
    small = known.filter(F.size("small") > 0).select("id", F.substring("print", 1, TALLIED // 8).alias("sketch"), F.col("small").alias("keys"))
    rounds = [posted(known, i) for i in range(1, ROUNDS)] + [small]
    names = [f"candidates-{i}" for i in range(len(rounds) + 1)]
    later = [tables.save(links(tables, r), n) for r, n in zip(rounds, names[1:])]
    meeting = thinned(tables, reduce(DataFrame.unionByName, [first, *later]), "thinned")
    candidates = components(tables, meeting, "meeting")
    wanted = distinct.join(candidates, F.col("id") == F.col("node")).select("first", F.col("t").alias("__tw_t"), "id", "root")
    texts = df.select(F.col(key).alias("k"), text_hash(text).alias("t"), F.col(text).cast("binary").alias("text"))
    texts = texts.join(wanted, F.col("k").eqNullSafe(F.col("first")) & (F.col("t") == F.col("__tw_t"))).select("root", "id", "text")
    sets = tables.save(shingle_sets(texts, shingle), "sets")
    edges = thinned(tables, tables.save(verified(tables, sets), "links"), "similar")
    tables.drop(*names, "rounds", "long", "sets", "large")
    rooted = distinct.select("id", "first").join(components(tables, edges), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    rooted = tables.save(rooted.select("id", "root", "first"), "rooted")
    tables.drop("distinct", "links")
    tables.keep_until_exit()
    return marked.select("k", "t", "id"), rooted


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``(key, component_id)`` for every row of ``df``: the smallest key that is reachable over links."""
    tables = Tables(df.sparkSession)
    marked, rooted = grouped(tables, df, key, text, shingle)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_id = tables.save(rooted.join(least, "root").select("id", "component_id"), "by_id")
    tables.drop("rooted")
    return marked.select(F.col("k").alias(key), "id").join(by_id, "id").select(key, "component_id")


def kept_rows(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``(k, t)`` of one row of each component: the smallest key, ties by the text's hash; and one of its rows without a key."""
    tables = Tables(df.sparkSession)
    marked, rooted = grouped(tables, df, key, text, shingle)
    least = marked.groupBy("id", F.col("k").isNull().alias("none")).agg(F.min(F.struct("k", "t")).alias("one"))
    least = least.join(rooted.select("id", "root"), "id").groupBy("root", "none").agg(F.min("one").alias("one"))
    kept = tables.save(least.select("one.k", "one.t"), "kept")
    tables.drop("rooted", "prints")
    return kept
