"""Stored layout: Parquet by ledger bucket, sorted by position, with Bloom filters on looked-up keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKET = 100


def bucket(seq: Column) -> Column:
    return F.floor(seq / BUCKET).cast("bigint")


def write(df: DataFrame, path: str, seq: str, order: list[str], blooms: tuple[str, ...] = (), mode: str = "append") -> None:
    """Append df, one shuffle by bucket; files are sorted by `order` so that footers prune."""
    out = df.withColumn("ledger_bucket", bucket(F.col(seq)))
    out = out.repartition("ledger_bucket", F.floor(F.col(seq) / 10)).sortWithinPartitions("ledger_bucket", *order)
    w = out.write.mode(mode).partitionBy("ledger_bucket")
    if blooms:  # as large as a row group's values need, not a megabyte each
        w = w.option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in blooms:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)


def read(spark: SparkSession, path: str, seq: str, first: int | None = None, last: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Rows of ledgers first to last: whole buckets are pruned, then row groups.

    With the schema of the rows written, a table without files has no rows.
    """
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("ledger_bucket", T.LongType())]))
    df = reader.parquet(path)
    if first is not None:
        df = df.filter((F.col("ledger_bucket") >= first // BUCKET) & (F.col(seq) >= first))
    if last is not None:
        df = df.filter((F.col("ledger_bucket") <= last // BUCKET) & (F.col(seq) <= last))
    return df.drop("ledger_bucket")


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path, for what is done on the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path that all executors share; it goes when the session's JVM ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tallyline-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


_STORED: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], seq: str, order: Sequence[str], blooms: tuple[str, ...]) -> tuple[str, T.StructType]:
    """(path, schema) of a table derived from `source`, written by the first caller of a session.

    What rows derive from each other (numbers inside a ledger, counts of operations) is
    worked out once; afterwards filters reach the scan, row groups and Bloom filters.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _STORED:
        df, path = build(), scratch(spark, name)
        write(df, path, seq, list(order), blooms)
        _STORED[key] = (path, df.schema)
    return _STORED[key]
