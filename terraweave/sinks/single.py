"""One file of many rows, whatever its size."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def write(lines: DataFrame, path: str, head: str, tail: str, skip: int = 0) -> None:
    """The lines (``value``) between two more as the only file below ``path``. Tasks write them as parts, in order of the rows' partitions; the driver's
    Hadoop file system joins these as a stream, so that neither a task nor the driver holds the whole. ``skip`` bytes of the first line are left out."""
    spark = lines.sparkSession
    jvm = spark._jvm
    at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *names]))
    fs = at().getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(), True)
    lines.write.text(f"{path.rstrip('/')}/_parts")  # readers pass over names that begin so
    parts = [(int(m[1]), s) for s in fs.listStatus(at("_parts")) if (m := re.match(r"part-(\d+)", s.getPath().getName())) and s.getLen()]
    out = fs.create(at("part-00000.txt"), True)
    try:
        out.write(bytearray(f"{head}\n".encode()))
        for _, s in sorted(parts, key=lambda p: p[0]):
            part = fs.open(s.getPath())
            try:
                part.seek(skip)
                skip = 0
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
        out.write(bytearray(f"{tail}\n".encode()))
    finally:
        out.close()
    fs.delete(at("_parts"), True)
