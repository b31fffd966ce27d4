"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should have:
whole copies, and a fractional probability of one more. Fractions are rounded in pairs. Of two
documents one gives words to the other until one of them has a whole number, in a random
direction that leaves both expectations as they are; the sum of the words never changes. What is
left of a pair meets the next document, and each bucket of about BUCKET documents leaves one
fractional document at most. These meet in a reduction tree of FAN buckets a node, level by level,
till one document of the source is left, which is rounded at random. So the words taken of a source
miss its target by less than one document.

Buckets and random numbers come from hashes of the rows, equal rows told apart by a number, so reruns agree however the rows
are stored. A source with many documents has many buckets; no task holds a source, nor the copies of one row.

Defined results: a null text has no words; documents without words get their whole copies and a
rounded fraction; a source without words has target 0; the null source is the last; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.llm.common import WORD, Tables, number_rows, partitions, without

BUCKET = 64
#: Equal rows that are made anew at once.
BLOCK = 1 << 16
FAN = 64


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(tables: Tables, sources: DataFrame, ratio: float, most: float) -> DataFrame:
    """``sources(.., total, weight)`` with ``target``: shares by weight of ``ratio`` times all words, none
    above ``most`` times its source. The level of a weight of one rises until no share is above."""
    total, weight = (float(v or 0) for v in sources.agg(F.sum("total"), F.sum("weight")).first())
    level, capped = (ratio * total / weight if weight else 0.0), 0
    cap = F.col("total") * most
    while True:
        above = cap < F.col("weight") * level
        n, full, rest = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not rest:
            break
        level, capped = (ratio * total - full) / rest, n
    return sources.withColumn("target", F.least(cap, F.col("weight") * level))


def _pair(size: np.ndarray, frac: np.ndarray, copies: np.ndarray, rng: np.random.Generator) -> int:
    """Rounds ``frac`` into ``copies``; the index of the document that stays fractional, or -1."""
    held = -1
    for j in np.flatnonzero((frac > 0) & (size > 0)).tolist():
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - frac[i]) * size[i], frac[j] * size[j])
        down = min(frac[i] * size[i], (1 - frac[j]) * size[j])
        move = up if rng.random() * (up + down) < down else -down
        ends = (frac[i] + move / size[i], frac[j] - move / size[j])
        done_i = move == (1 - frac[i]) * size[i] or -move == frac[i] * size[i]
        done_j = move == frac[j] * size[j] or -move == (1 - frac[j]) * size[j]
        frac[i], frac[j] = (round(e) if d else min(max(e, 0.0), 1.0) for e, d in zip(ends, (done_i, done_j)))
        held = -1
        for k in (i, j):
            if 0 < frac[k] < 1:
                held = k
            else:
                copies[k] += round(frac[k])
                frac[k] = 0
    return held


def copies_of(tables: Tables, rows: DataFrame, seed: int) -> DataFrame:
    """``rows(__tw_row.., size, rank, buckets, want)`` with the number of ``copies`` instead of ``want``."""
    names = rows.columns
    base = rows.withColumn("copies", F.floor("want").cast("long")).withColumn("frac", F.col("want") - F.floor("want"))
    base = base.withColumn("bucket", F.pmod(F.col("__tw_hash"), "buckets")).withColumn("open", F.lit(True))
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in base.columns)
    most = rows.agg(F.max("buckets")).first()[0] or 1

    def turn(level: int):
        def run(part: pa.Table) -> pa.Table:
            part = part.sort_by([("__tw_hash", "ascending"), ("size", "ascending")])
            get = lambda n: part.column(n).to_numpy().copy()
            size, frac, copies = get("size").astype(float), get("frac"), get("copies")
            bucket, buckets = get("bucket"), get("buckets")
            rng = np.random.default_rng([seed, level, int(part.column("rank")[0].as_py()), int(bucket[0])])
            none = (size == 0) & (frac > 0)
            copies[none] += rng.random(none.sum()) < frac[none]
            frac[none] = 0
            held = _pair(size, frac, copies, rng)
            still = np.zeros(len(size), bool)
            if held >= 0 and buckets[0] > 1:
                still[held] = True
            elif held >= 0:
                copies[held] += rng.random() < frac[held]
            new = {"copies": copies, "frac": frac, "open": still, "bucket": bucket // FAN, "buckets": -(-buckets // FAN)}
            for n, v in new.items():
                at = part.schema.get_field_index(n)
                part = part.set_column(at, n, pa.array(v).cast(part.schema.field(n).type))
            return part

        return run

    done, level, now = [], 0, base
    while True:
        now = tables.save(now.groupBy("rank", "bucket").applyInArrow(turn(level), schema), f"level-{level}")
        done.append(now.filter(~F.col("open")))
        if most == 1:
            break
        now, level, most = now.filter("open"), level + 1, -(-most // FAN)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[n for n in names if n not in ("want", "buckets")], "copies")


def numbered(tables: Tables, df: DataFrame) -> DataFrame:
    """``df`` with ``__tw_nth``, which tells equal rows apart.

    Equal rows are counted, aggregated before the shuffle, and made anew from their count, in blocks that
    are dealt anew, so a row that comes very often is no single task's work.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__tw_n"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("__tw_n") - 1), F.lit(BLOCK).cast("long"))).alias("__tw_at")
    dealt = tables.save(counted.select("*", blocks), "counted")
    if not dealt.filter(F.col("__tw_at") > 0).isEmpty():
        dealt = dealt.repartition(partitions(df.sparkSession), F.xxhash64(*df.columns, "__tw_at"))
    last = F.least(F.col("__tw_at") + BLOCK, "__tw_n") - 1
    return dealt.select(*df.columns, F.explode(F.sequence("__tw_at", last)).alias("__tw_nth"))


def mix(df: DataFrame, size: str, source: str, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, most: float = 2, seed: int = 11) -> DataFrame:
    """``df`` with ``source_size``, ``target``, ``copies`` and ``taken``. Sources in code point order, null last,
    have the given weights, repeating. Bring only the columns that identify a row and these."""
    tables = Tables(df.sparkSession)
    base = without(df, *(n for n in ("source_size", "target", "copies", "taken") if n not in (size, source)))
    keep = base.columns
    renamed = base.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    size_c, source_c = f"c{keep.index(size)}", f"c{keep.index(source)}"
    kept = tables.save(numbered(tables, renamed), "rows")
    sources = kept.groupBy(F.col(source_c).alias("source")).agg(F.sum(size_c).alias("total"), F.count("*").alias("n"))
    ranked, _ = number_rows(tables, sources, [F.col("source").asc_nulls_last()], "sources", "rank")
    of = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    ranked = tables.save(targets(tables, tables.save(ranked.withColumn("weight", of), "ranked"), ratio, most), "targets")
    joined = kept.join(ranked, kept[source_c].eqNullSafe(ranked["source"])).select(
        *kept.columns,
        F.col(size_c).cast("long").alias("size"),
        "rank",
        F.col("total").cast("long").alias("source_size"),
        "target",
        F.xxhash64(F.lit(seed), *[F.col(c) for c in kept.columns]).alias("__tw_hash"),  # the number among equal rows included
        F.ceil(F.col("n") / BUCKET).cast("long").alias("buckets"),
        F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0)).alias("want"),
    )
    done = copies_of(tables, joined, seed)
    tables.drop("sources", "ranked", "counted")
    tables.keep_until_exit()
    out = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    return done.select(*out, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``df`` as the mix has them, each as often as it is taken, in an order that sets copies apart.

    A row is known by its key and the hash of all its columns, so the same rows give the same mix however they are stored; equal
    rows share their copies. ``df`` is read twice and should be stored.
    """
    tables = Tables(df.sparkSession)
    columns = [F.col(f"`{c}`") for c in df.columns]
    row = F.xxhash64(*columns)
    sized = df.select(F.col(key).alias("__tw_key"), row.alias("__tw_row"), words_in(text).alias("__tw_size"), F.col(source).alias("__tw_source"))
    mixed = mix(sized, "__tw_size", "__tw_source", **options).groupBy("__tw_key", "__tw_row")
    copies = tables.save(mixed.agg(F.sum("copies").alias("__tw_copies"), F.count("*").alias("__tw_n")), "copies")
    tables.keep_until_exit()
    rows = df.withColumn("__tw_row", row)
    if not copies.filter(F.col("__tw_n") > 1).isEmpty():
        rows = rows.dropDuplicates([key, "__tw_row"])
    wanted = copies.filter(F.col("__tw_copies") > 0).select("__tw_key", F.col("__tw_row").alias("__tw_other"), "__tw_copies")
    often = rows.join(wanted, (F.col("__tw_row") == F.col("__tw_other")) & F.col(key).eqNullSafe(F.col("__tw_key")))
    often = often.select(*columns, "__tw_row", F.explode(F.sequence(F.lit(1).cast("long"), "__tw_copies")).alias("__tw_copy"))
    order = F.xxhash64("__tw_row", "__tw_copy")
    return often.repartition(partitions(df.sparkSession), order).sortWithinPartitions(order).select(*columns)
