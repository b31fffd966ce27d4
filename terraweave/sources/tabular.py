"""Features from delimited text and databases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraweave.functions import geometry
from terraweave.plans.config import Config
from terraweave.sources.binary import geodatabase_wkt

_BOMS = {b"\xef\xbb\xbf": "UTF-8", b"\xff\xfe": "UTF-16LE", b"\xfe\xff": "UTF-16BE"}


def encoding_of(spark: SparkSession, path: str, default: str) -> str:
    """A byte order mark overrides the setting. Only the first bytes are read, by Hadoop's file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        return default
    stream = fs.open(p)
    try:
        head = bytes(max(b, 0) for b in (stream.read() for _ in range(3)))
    finally:
        stream.close()
    return next((name for bom, name in _BOMS.items() if head.startswith(bom)), default)


def csv(spark: SparkSession, paths: list[str], config: Config) -> DataFrame:
    """All columns are strings; files are united by name."""

    def one(path: str) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", config.delimiter).option("quote", config.quote or "\0").option("escape", config.quote or "\0")
        encoding = encoding_of(spark, path, config.encoding)
        whole = config.multi_line or encoding.upper().startswith("UTF-16")  # Spark splits files at single bytes
        df = reader.option("multiLine", whole).option("encoding", encoding).csv(path)
        return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(one, paths))


def with_wkt(df: DataFrame, config: Config) -> DataFrame:
    """``wkt`` from the geometry column or from coordinates; null where they are missing or no numbers."""
    if config.geometry_attr:
        return df.withColumn("wkt", F.nullif(F.trim(F.col(config.geometry_attr)), F.lit(""))).drop(config.geometry_attr)
    x, y = F.col(config.x_attr or "lon"), F.col(config.y_attr or "lat")
    number = x.try_cast("double").isNotNull() & y.try_cast("double").isNotNull()
    return df.withColumn("wkt", F.when(number, geometry.point(F.trim(x), F.trim(y))))


#: Dialects: JDBC URL, driver class, WKT expression and reprojection of a geometry column.
DIALECTS = {
    "postgis": ("jdbc:postgresql://{host}:{port}/{name}", "org.postgresql.Driver", "ST_AsText({g})", "ST_Transform({g}, {srid})"),
    "mysql": ("jdbc:mysql://{host}:{port}/{name}", "com.mysql.cj.jdbc.Driver", "ST_AsText({g})", None),
    "oracle": ("jdbc:oracle:thin:@{host}:{port}:{name}", "oracle.jdbc.OracleDriver", "SDO_UTIL.TO_WKTGEOMETRY({g})", "SDO_CS.TRANSFORM({g}, {srid})"),
    "db2": ("jdbc:db2://{host}:{port}/{name}", "com.ibm.db2.jcc.DB2Driver", "db2gse.ST_AsText({g})", "db2gse.ST_Transform({g}, {srid})"),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={name}", "com.microsoft.sqlserver.jdbc.SQLServerDriver", "{g}.STAsText()", None),
    "spatialite": ("jdbc:sqlite:{name}", "org.sqlite.JDBC", "ST_AsText({g})", "ST_Transform({g}, {srid})"),
    "msaccess": ("jdbc:ucanaccess://{name}", "net.ucanaccess.jdbc.UcanaccessDriver", "{g}", None),
}


def query_text(config: Config) -> str:
    """The statement that a database runs: the filter and, where it can, reprojection are its work."""
    kind = config.jdbc.get("type", "postgis").lower().replace(" ", "")
    _, _, wkt, reproject = DIALECTS[kind]
    g = f"t.{config.geometry_attr}"
    if config.target_crs and config.source_srid != config.target_srid and reproject:
        g = reproject.format(g=g, srid=config.target_srid)
    where = f" WHERE ({config.condition})" if config.condition else ""
    return f"SELECT t.*, {wkt.format(g=g)} AS wkt FROM {config.table} t{where}"


def count_text(config: Config) -> str:
    """The number of the filtered rows, which the database counts."""
    return f"SELECT count(*) AS n FROM {config.table} t" + (f" WHERE ({config.condition})" if config.condition else "")


def count(spark: SparkSession, config: Config, options: dict[str, str] | None = None) -> DataFrame:
    """``n``, of one row."""
    df = spark.read.format("jdbc").options(**jdbc_options(config) | (options or {})).option("query", count_text(config)).load()
    return df.select(F.col(df.columns[0]).cast("long").alias("n"))


def jdbc_options(config: Config) -> dict[str, str]:
    kind = config.jdbc.get("type", "postgis").lower().replace(" ", "")
    url, driver, _, _ = DIALECTS[kind]
    values = {"host": config.jdbc.get("host", "localhost"), "port": config.jdbc.get("port", ""), "name": config.jdbc.get("name", "")}
    return {"url": url.format(**values), "driver": driver, "user": config.jdbc.get("username", ""), "password": config.jdbc.get("password", "")}


def jdbc(spark: SparkSession, config: Config, options: dict[str, str] | None = None) -> DataFrame:
    """``options`` such as ``partitionColumn`` go with ``dbtable`` instead of one query."""
    reader = spark.read.format("jdbc").options(**jdbc_options(config))
    text = query_text(config)
    df = reader.options(dbtable=f"({text}) q", **options).load() if options else reader.option("query", text).load()
    if config.jdbc.get("type", "").lower().replace(" ", "") == "msaccess":  # shapes come as they are stored
        df = df.withColumn("wkt", geodatabase_wkt("wkt"))
    names = {(config.geometry_attr or "").lower(), "wktgeometry"}
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns if c.lower() not in names])
