"""Sharding by a Feistel permutation of global row numbers, with DataFrame functions only.

Row ``i`` of ``n`` (in a total order of the rows) goes to place ``p = permute(i)``; its shard is
``p % shards`` and its slot ``p div shards``, so both can be computed for any row number without
a shuffle of the rows, and row counts of shards differ by one at most.

The network works on ``Z_a x Z_b`` with ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``: fewer than
``a`` places lie outside ``[0, n)``, and cycle walking applies the network again until the place is
inside. Every walk ends, as the network is a bijection and its start is inside.

Defined results: null texts count as empty; rows with equal keys are ordered by their text's
hash, and rows equal in both are interchangeable; an empty table gives an empty table; columns
named like the outputs are replaced.
"""

from __future__ import annotations

import random
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraweave.llm.common import Tables, number_rows, without

PRIME = (1 << 31) - 1
ROUNDS = 6
#: A walk takes as many steps as it visits outer places, which are under 1 / sqrt(n) of all; up to
#: WALK * WALK rows they are WALK at most, beyond that a longer walk has a chance under 1e-45.
WALK = 32


def sides(n: int) -> tuple[int, int]:
    a = isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(PRIME) for _ in range(ROUNDS)]


def network(x: Column, n: int, seed: int) -> Column:
    """One pass of the network: a bijection of ``[0, a * b)``."""
    a, b = (F.lit(v).cast("long") for v in sides(n))
    state = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"), a.alias("m"), b.alias("o"))

    def turn(s: Column, k: Column) -> Column:
        t = (s["r"] + k) % F.lit(PRIME)
        mixed = (t * t) % F.lit(PRIME) * t % F.lit(PRIME)
        return F.struct(s["r"].alias("l"), ((s["l"] + mixed) % s["m"]).alias("r"), s["o"].alias("m"), s["m"].alias("o"))

    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])
    return F.aggregate(keys, state, turn, lambda s: s["l"] + s["r"] * a)


def permute(i: Column, n: int, seed: int) -> Column:
    """The place of row number ``i``: the network, walked until it is under ``n``."""
    step = lambda at, _: F.when(at < n, at).otherwise(network(at, n, seed))
    end = lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))
    return F.aggregate(F.array_repeat(F.lit(0), WALK), network(i, n, seed), step, end)


def shard_rows(df: DataFrame, shards: int, order: list[Column], seed: int = 20) -> DataFrame:
    """``df`` with ``row_number`` and ``place`` (long), ``shard`` (int) and ``slot`` (long).

    Bring only the columns that the order and the result need: they are what is shuffled.
    ``order`` must be total up to rows that are equal in every respect.
    """
    tables = Tables(df.sparkSession)
    rows, n = number_rows(tables, without(df, "row_number", "place", "shard", "slot"), order, "numbered", "row_number")
    tables.keep_until_exit()
    rows = rows.withColumn("place", permute(F.col("row_number"), max(n, 1), seed))
    return rows.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long"))


def write_shards(df: DataFrame, path: str, shards: int, key: str, text: str, seed: int = 20) -> None:
    """Writes ``df`` under ``path`` by shard, each file's rows in slot order."""
    placed = shard_rows(df, shards, [F.col(key).asc_nulls_first(), F.xxhash64(text)], seed)
    placed.repartition(F.col("shard"), F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
