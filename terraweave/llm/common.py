"""Tables in shared storage, distributed row numbers and word rules used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: A finished write needs its shuffle files no more; whole texts go to Python in small batches.
WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One of our own only where driver and executors are one process; a cluster has to name its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="terraweave-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Tables:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    ``save`` cuts the lineage: a lost executor costs a reread, never a recomputation of the
    stages before, and the files are replicated by the store. Shuffle files of a finished
    write are deleted at once. ``drop`` removes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/terraweave-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        conf, path = self.spark.conf, f"{self.root}/{name}"
        before = {k: conf.get(k) for k in WHILE_SAVING}
        for k, v in WHILE_SAVING.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", codec).parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(hadoop).delete(path, True)

    def keep_until_exit(self) -> None:
        """The results stay readable for the session and go with it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A group's rows are dealt to at least so many salts.
SALTS = 64


def with_least(df: DataFrame, keys: list[str], value: str, into: str, salt: list[str]) -> DataFrame:
    """``df`` with ``into``, the least ``value`` of the rows with equal ``keys``, for groups of any size.

    Rows meet by keys and salt, a hash of the columns ``salt``, so a group's rows lie in as many tasks as there are salts; only
    its salts' least values, a row a salt, meet by the keys alone.
    """
    dealt = df.withColumn("__tw_s", F.pmod(F.xxhash64(*salt), F.lit(max(SALTS, partitions(df.sparkSession)))))
    parts = dealt.groupBy(*keys, "__tw_s").agg(F.min(value).alias(into))
    least = parts.groupBy(*keys).agg(F.min(into).alias(into))
    return dealt.join(parts.select(*keys, "__tw_s").join(least, keys), [*keys, "__tw_s"]).drop("__tw_s")


def number_rows(tables: Tables, df: DataFrame, order: list[Column], name: str, into: str) -> tuple[DataFrame, int]:
    """``df`` with a gapless 0-based long column ``into`` in ``order``, and the number of rows.

    Rows are range partitioned and sorted once; a row's place in its partition comes from
    ``monotonically_increasing_id`` and the partitions' first numbers from their counts, so no
    task sees more than its own range. Only the counts (one per partition) are broadcast.
    """
    spark = df.sparkSession
    pid, at = "__tw_pid", "__tw_at"
    placed = (
        df.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn(at, F.monotonically_increasing_id())
        .withColumn(pid, F.shiftright(at, 33).cast("int"))
        .withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = tables.save(placed, name)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(pid).count().collect())
    firsts, total = [], 0
    for p, n in counts:
        firsts.append((p, total))
        total += n
    starts = spark.createDataFrame(firsts, f"{pid} int, __tw_first long")
    out = placed.join(F.broadcast(starts), pid).withColumn(into, F.col("__tw_first") + F.col(at))
    return out.drop(pid, at, "__tw_first"), total


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less columns whose names an operator is about to write (Spark ignores case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
