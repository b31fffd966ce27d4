"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraweave.llm.common import Tables, partitions, with_least

#: A round is written in files of so many edges at least, by as many tasks.
EDGES = 200_000


def components(tables: Tables, edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``: ``root`` is the smallest node reachable.

    Each round links neighbours to the smallest one they see; the number of rounds grows with
    the logarithm of the longest path. Every round is written to shared storage. A node with
    very many neighbours is no single group: see ``with_least``. No round has more edges than the one
    before, so the number of its files is known beforehand: few edges do not make a file a partition.
    """
    kind = edges.schema["u"].dataType

    def saved(df: DataFrame, most: int, number: int) -> DataFrame:
        files = min(-(-most // EDGES), partitions(tables.spark))
        return tables.save(df.coalesce(max(1, files)), f"{name}-{number}")

    rows, round_no = edges.count(), 0
    now = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows, 0)
    rows = now.count()
    while True:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, ["u"], "v", "__tw_m", ["v"]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "__tw_m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest neighbour.
        small = with_least(large, ["u"], "v", "__tw_m", ["v"])
        small = small.select(F.when(F.col("v") == F.col("__tw_m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("__tw_m").alias("v"))
        small = small.filter("u <> v").distinct()
        # __tw_m is min(N(u)) and below u, so the pairs above are (u, m) once and (v, m) for other v.
        round_no += 1
        new = saved(small, rows, round_no)
        left = new.count()
        same = rows == left and now.join(new, ["u", "v"], "left_anti").isEmpty()
        tables.drop(f"{name}-{round_no - 1}")
        now, rows = new, left
        if same:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return out.unionByName(roots).select(F.col("node").cast(kind), F.col("root").cast(kind))


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs: no more edges than nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]
