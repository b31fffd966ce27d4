"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
smaller key. Positions are ranked by growing prefixes, and only those that share their rank with
another document go on to the next length:

1. Prefixes of ``BASE`` bytes. Ranking every position by every length would shuffle many times the
   text, so a string of ``length`` bytes is represented by the least of the ``BASE``-byte ranks
   inside it: equal strings have equal representatives, and neighbouring strings mostly share
   one, so one row stands for a run of about fifteen positions. Spark sorts these (rank, position)
   rows; a rank that one document alone has is unique and its run is dropped.
   Among runs of one rank, those whose bytes have one hash (64 bits, independent of the rank's 63) are one class: all but
   the runs of its smallest document go as a whole.
2. Runs of the smallest documents whose rank has several classes fetch their bytes and are sorted
   again by rank. Within a rank all their positions are ranked by pairs of ranks at offsets of 8, 16 and 18 bytes (prefixes of 16, 32
   and ``length`` bytes), reranked after each sort, unique positions dropped each time. A rank of the last
   sort gives the smallest document with this string.
3. Covered positions are merged to spans and cut from the texts.

A rank of very many such runs (see ``LONG``; a phrase that very many documents have, each in words of its own) is
dealt by position instead: each string has two 64-bit hashes, and every position meets the smallest document of its string, in as many
tasks as its group needs. No task holds such a rank.

Ranks that a sample shows to be common are not shuffled as runs at all: their positions stand for themselves, ranked by
the whole string. The sample decides how rows are dealt and nothing else; results are the same without it.

Equal runs within one task are ranked before the shuffle and stand for one another, so a passage
that very many documents share sends a few rows from each task, not one from each document.

Defined results: null texts are empty; a null key is larger than any other, and rows with equal
keys never remove from one another; empty tables give empty tables. If keys repeat or are null,
rows are followed by a 64-bit hash of key and text instead of the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraweave.llm.common import Tables, partitions, with_least

BASE = 20
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Bytes of runs that are ranked at once; a task takes about 90 times as many.
SORTED = 1 << 19
#: Runs that are held before equal ones among them are merged.
HELD = 400_000
#: A rank with more runs than this, and than a quarter of a task's share, is no task's work; it is resolved position by position.
LONG = 500
#: One document of so many tells which ranks are common: those of so many runs of the sample and of a 20th of a task's share,
#: which are 20 for each task at most.
SAMPLE, COMMON, SHARE = 100, 50, 20
#: Bytes of text for a run, as a rule of thumb.
RUN = 15
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
LAST = np.iinfo(np.int64).max

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64."""
    if n not in _powers:
        out = []
        for m in (MULTIPLIER, INVERSE):
            p = np.ones(n, np.uint64)
            p[1:] = np.uint64(m)
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[n] = (out[0], out[1])
    return _powers[n]


_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Of a second, independent hash.
_OTHER_CODES = _mix(_CODES)


def _least_within(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` neighbours."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rank, start, number of positions and hash of the bytes of each run of ``data``."""
    w = length - BASE + 1
    up, down = _power_table(CHUNK + 2 * length)
    sums, others = np.zeros((2, len(data) + 1), np.uint64)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    np.cumsum(_OTHER_CODES[data] * up[: len(data)], out=others[1:])
    ranks = _mix((sums[BASE:] - sums[:-BASE]) * down[: len(data) - BASE + 1])
    least = _least_within(ranks, w)
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.r_[0, cuts]
    sizes = np.diff(np.r_[starts, len(least)])
    if sizes.max() > w:  # a rank that comes again and again: pieces of w positions
        pieces = -(-sizes // w)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        step = (np.arange(pieces.sum()) - first) * w
        starts, sizes = np.repeat(starts, pieces) + step, np.minimum(np.repeat(sizes, pieces) - step, w)
    ends = starts + sizes + length - 1
    return least[starts], starts, sizes, _mix((others[ends] - others[starts]) * down[starts] + sizes.astype(np.uint64))


def window_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every string of ``length`` bytes."""
    up, down = _power_table(CHUNK + 2 * length)
    out = []
    for codes in (_CODES, _OTHER_CODES):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
        out.append(_mix((sums[length:] - sums[:-length]) * down[: len(data) - length + 1]).view(np.int64))
    return out[0], out[1]


def _segments(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that overlap so that every string of ``length`` bytes starts in one."""
    for at in range(0, max(len(text) - length + 1, 0), CHUNK):
        yield at, np.frombuffer(text, np.uint8, min(CHUNK + length - 1, len(text) - at), at)


def _pack(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 24) | size.astype(np.int64)


class _Held:
    """Runs of a task, of which equal ones are merged: those of the smallest order stay."""

    def __init__(self, length: int, common: np.ndarray):
        self.length, self.common, self.columns, self.size = length, common, [], 0

    def add(self, order: int, key: int, text: bytes) -> None:
        for at, data in _segments(text, self.length):
            rank, start, n, content = runs(data, self.length)
            often = np.isin(rank.view(np.int64) & LAST, self.common)
            if often.any():
                first, second = window_hashes(data, self.length)
                place = np.repeat(start[often] - (np.cumsum(n[often]) - n[often]), n[often]) + np.arange(n[often].sum())
                rank, content = (np.concatenate([a[~often], b[place].view(np.uint64)]) for a, b in ((rank, first), (content, second)))
                start, n = np.concatenate([start[~often], place]), np.concatenate([n[~often], np.ones(len(place), n.dtype)])
            k = len(rank)
            self.columns.append((rank, start + at, n, content, np.full(k, order, np.int64), np.full(k, key, np.int64)))
            self.size += k

    def take(self) -> Iterator[pa.RecordBatch]:
        """Rows ``rank, content, key, order, span``: runs to be sorted, and with rank -1 spans that go."""
        if not self.size:
            return
        rank, start, n, content, order, key = (np.concatenate(c) for c in zip(*self.columns))
        self.columns, self.size = [], 0
        by = np.lexsort((order, content, rank))
        new = np.r_[True, (content[by][1:] != content[by][:-1]) | (rank[by][1:] != rank[by][:-1])]
        lowest = order[by][new][np.cumsum(new) - 1]
        gone = np.zeros(len(by), bool)
        gone[by] = order[by] > lowest
        stay = np.flatnonzero(~gone)
        yield _rows(rank[stay].view(np.int64) & LAST, content[stay].view(np.int64), key[stay], order[stay], _pack(start[stay], n[stay]))
        if gone.any():
            keys, spans = merge_spans(key[gone], start[gone], (start + n + self.length - 1)[gone])
            none = np.full(len(keys), -1, np.int64)
            yield _rows(none, none, keys, none, spans)


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rank", "content", "key", "order", "span"])


def merge_spans(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they touch, cut where they are longer than a span can say."""
    by = np.lexsort((start, key))
    key, start, end = key[by], start[by], end[by]
    new = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(new) - 1
    shift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    first = np.r_[True, (start + shift)[1:] > reach[:-1]]
    lo = start[first]
    hi = (reach - shift)[np.r_[np.flatnonzero(first)[1:] - 1, len(key) - 1]]
    key, most = key[first], (1 << 24) - 1
    n = -(-(hi - lo) // most)
    step = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * most
    lo, hi, key = np.repeat(lo, n) + step, np.repeat(hi, n), np.repeat(key, n)
    return key, _pack(lo, np.minimum(hi - lo, most))


def _rerank(pairs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the rows, and how often each row's rank comes."""
    by = np.lexsort(pairs[::-1])
    new = np.zeros(len(by), bool)
    new[0] = True
    for p in pairs:
        s = p[by]
        new[1:] |= s[1:] != s[:-1]
    ids = np.cumsum(new) - 1
    rank = np.empty(len(by), np.int64)
    rank[by] = ids
    return rank, np.bincount(ids)[rank]


def whole_ranks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by rank, their first column, in tables that split no rank: those of ``most`` bytes of their last column and of the batch and rank these end in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size >= most:
            t = pa.Table.from_batches(held)
            ranks = t.column(0).to_numpy()
            last = int(np.searchsorted(ranks, ranks[-1]))  # the last rank may go on
            if last:
                yield t.slice(0, last)
                t = t.slice(last)
            held, size = t.combine_chunks().to_batches(), t.column(t.num_columns - 1).nbytes
    if held:
        yield pa.Table.from_batches(held)


def doubled(rank: np.ndarray, order: np.ndarray, data: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """For each position of the runs whether its string is one of a smaller order, too.

    Run ``i`` has the bytes from ``begin[i]`` on in ``data`` and ``n[i]`` positions. Runs of different ranks
    hold no common string.
    """
    run = np.repeat(np.arange(len(n)), n)
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    gone = np.zeros(len(run), bool)
    live = np.arange(len(run))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i : i + len(data)]
    have = 8
    # Ranks of the shorter prefixes are needed at all places of a run's bytes, not only at its positions.
    prefix: np.ndarray = word
    while True:
        offset = min(have, length - have)
        if have + offset < length:
            shifted = np.concatenate([prefix[offset:], np.zeros(offset, prefix.dtype)])
            prefix = _rerank((prefix, shifted))[0]
            have += offset
            here = _rerank((rank[run[live]], prefix[at[live]]))[1]
            live = live[here > 1]
            if not len(live):
                return gone
            continue
        new, _ = _rerank((rank[run[live]], prefix[at[live]], prefix[at[live] + offset]))
        least = np.full(new.max() + 1, LAST, np.int64)
        np.minimum.at(least, new, order[run[live]])
        gone[live] = order[run[live]] > least[new]
        return gone


def _spans_gone(key: np.ndarray, start: np.ndarray, n: np.ndarray, gone: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    run = np.repeat(np.arange(len(n)), n)[gone]
    place = (np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()))[gone]
    return merge_spans(key[run], place, place + length)


def common_ranks(docs: DataFrame, length: int) -> np.ndarray:
    """Ranks that many runs of a sample have."""

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                for _, data in _segments(text.as_py(), length):
                    yield pa.RecordBatch.from_arrays([pa.array(runs(data, length)[0].view(np.int64) & LAST)], names=["rank"])

    sample = docs.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(ranks, "rank long")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = max(COMMON, size // (RUN * SAMPLE * SHARE * partitions(docs.sparkSession)))
    counts = sample.groupBy("rank").count().filter(F.col("count") >= least)
    return np.array(sorted(r[0] for r in counts.collect()), np.int64)


def spans(tables: Tables, docs: DataFrame, length: int, plain: bool) -> DataFrame:
    """``(key, spans)``: what goes from the text of each row of ``docs(key, order, text)``."""
    n_parts = partitions(docs.sparkSession)

    common = common_ranks(docs, length)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(length, common)
        for batch in batches:
            for key, order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.add(order, key, text.as_py())
                if held.size >= HELD:
                    yield from held.take()
        yield from held.take()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, orders, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out: list[list] = [[], [], [], [], []]
            size = 0
            for i, (key, order) in enumerate(zip(keys, orders)):
                text = texts[i].as_py()
                ranks, packed = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                start, n = packed >> 24, packed & 0xFFFFFF
                for r, s, k in zip(ranks.tolist(), start.tolist(), n.tolist()):
                    out[3].append(text[s : s + k + length - 1])
                    out[4].append(r)
                out[0].append(np.full(len(start), key, np.int64))
                out[1].append(np.full(len(start), order, np.int64))
                out[2].append(start)
                size += len(start)
                if size > 100_000:
                    yield _fetched(out)
                    out, size = [[], [], [], [], []], 0
            if size:
                yield _fetched(out)

    def _fetched(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(out[4], np.int64)), *(pa.array(np.concatenate(c)) for c in out[:3]), pa.array(out[3], pa.binary())], names=["rank", "key", "order", "start", "content"]
        )

    def double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_ranks(batches, SORTED):
            r, k, o, s = (t.column(i).to_numpy() for i in range(4))
            parts = t.column(4).combine_chunks()
            sizes = np.diff(np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1])
            data = np.frombuffer(b"".join(parts.to_pylist()), np.uint8)
            n = sizes - length + 1
            gone = doubled(r, o, data, np.cumsum(sizes) - sizes, n, length)
            if gone.any():
                keys, found = _spans_gone(k, s, n, gone, length)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(found)], names=["key", "span"])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                _, k, o, s = (batch.column(i).slice(at, 2000).to_numpy() for i in range(4))
                parts = [np.frombuffer(c.as_py(), np.uint8) for c in batch.column(4).slice(at, 2000)]
                hashes = [window_hashes(p, length) for p in parts]
                n = np.array([len(h) for h, _ in hashes])
                place = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
                columns = [np.concatenate([h[i] for h in hashes]) for i in (0, 1)] + [np.repeat(k, n), np.repeat(o, n), _pack(place, np.full(len(place), length))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "key", "order", "span"])

    ranked = docs.mapInArrow(rank, "rank long, content long, key long, order long, span long")
    if plain:  # the key is the order, and one of them is enough
        ranked = ranked.drop("order").withColumn("order", F.col("key"))
    run = F.col("rank") >= 0
    # Equal ranks meet in one sort; a rank that one key alone has is unique.
    ranked = ranked.withColumn("__tw_by", F.when(run, F.col("rank")).otherwise(F.xxhash64("key", "span"))).withColumn("content", F.when(run, F.col("content")))
    of_rank, of_class = Window.partitionBy("__tw_by"), Window.partitionBy("__tw_by", "content")
    shared = ranked.select(
        "*", *[f(c).over(of_rank).alias(f"{a}_{c}") for c in ("key", "content") for f, a in ((F.min, "lo"), (F.max, "hi"))], F.min("order").over(of_class).alias("least")
    )
    whole = run & (F.col("order") > F.col("least"))
    shared = shared.filter(~run | whole | (F.col("lo_key") != F.col("hi_key")) & (F.col("lo_content") != F.col("hi_content")))
    gone = ~run | whole
    shared = shared.select(F.when(gone, F.lit(-1).cast("long")).otherwise(F.col("rank")).alias("rank"), "key", F.when(whole, F.col("span") + (length - 1)).otherwise(F.col("span")).alias("span"))
    shared = tables.save(shared, "shared")
    asked = shared.filter("rank >= 0").select("rank", "key", "span")
    limit = max(LONG, asked.count() // (4 * n_parts))
    hot = tables.save(asked.groupBy("rank").count().filter(F.col("count") > limit).select("rank"), "hot")

    def fetched(asked: DataFrame) -> DataFrame:
        lists = asked.groupBy("key").agg(F.collect_list(F.struct("rank", "span")).alias("a")).select("key", F.col("a.rank").alias("ranks"), F.col("a.span").alias("packed"))
        texts = docs.join(lists, "key").select("key", "order", "text", "ranks", "packed")
        return texts.mapInArrow(fetch, "rank long, key long, order long, start long, content binary")

    some = not hot.isEmpty()
    few = asked.join(hot, "rank", "left_anti") if some else asked
    found = fetched(few).repartition(n_parts, "rank").sortWithinPartitions("rank").mapInArrow(double, "key long, span long")
    if some:
        each = fetched(asked.join(hot, "rank", "left_semi")).mapInArrow(positions, "a long, b long, key long, order long, span long")
        each = tables.save(each, "positions")
        found = found.unionByName(with_least(each, ["a", "b"], "order", "least", ["key", "span"]).filter("order > least").select("key", "span"))
    all_spans = shared.filter("rank < 0").select("key", "span").unionByName(found)
    merged = tables.save(all_spans.groupBy("key").agg(F.sort_array(F.collect_list("span")).alias("spans")), "spans")
    tables.drop("shared", "hot", "positions")
    return merged


def _merged(packed: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of sorted packed spans."""
    out: list[list[int]] = []
    for p in packed:
        s, e = p >> 24, (p >> 24) + (p & 0xFFFFFF)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, texts: bool = False) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``df``, or with ``texts`` all
    its columns, ``text`` cut, and these behind them. Characters that are cut in part go as a whole."""
    tables = Tables(df.sparkSession)
    outputs = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    ids = df.select(F.col(key).alias("k"))
    plain = ids.schema["k"].dataType.typeName() in ("long", "integer") and ids.groupBy("k").count().filter("k is null or count > 1").isEmpty()
    tag = F.col(key).cast("long") if plain else F.xxhash64(F.col(key), F.col(text))
    rest = [c for c in df.columns if c != text and c.lower() not in outputs] if texts else [key]
    order = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    docs = df.select(tag.alias("key"), order.alias("order"), whole.alias("text"))
    found = spans(tables, docs, length, plain)
    fields = [f for f in df.schema.fields if f.name in rest]
    joined = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], whole.alias("text"), F.col(text).isNull().alias("none"), tag.alias("key"))
    joined = joined.join(found, "key", "left").select(*[f"c{i}" for i in range(len(rest))], "text", "none", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            kept: list[str | None] = []
            for t, none, s in zip(batch.column(len(rest)), batch.column(len(rest) + 1).to_pylist(), batch.column(len(rest) + 2).to_pylist()):
                t = t.as_py()
                gone = _merged(s or [])
                edges = [0, *(x for g in gone for x in g), len(t)]
                pieces = [t[a:b] for a, b in zip(edges[::2], edges[1::2])]
                left = b"".join(pieces)
                out.append((len(t), len(t) - len(left), len(gone), hashlib.sha256(left).hexdigest()))
                if texts:
                    kept.append(None if none else b"".join(p.decode("utf-8", "ignore").encode() for p in pieces).decode())
            arrays = list(batch.columns[: len(rest)])
            cols = list(zip(*out)) or [()] * 4
            if texts:
                arrays.append(pa.array(kept, pa.string()))
            arrays += [pa.array(cols[i], pa.int64()) for i in range(3)] + [pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [f"c{i}" for i in range(len(rest))] + ["t"] * texts + list(outputs)
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + ["t string"] * texts + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    done = joined.mapInArrow(cut, schema)
    tables.keep_until_exit()
    named = {c: f"c{i}" for i, c in enumerate(rest)} | ({text: "t"} if texts else {})
    return done.select(*[F.col(named[c]).alias(c) for c in df.columns if c in named], *outputs)
