"""Shared-folder tables and small Spark helpers."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character untouched."""
    return F.translate(c, _UPPER, _UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tallyline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*dfs: DataFrame) -> None:
    """Delete the folders of tables that stage() made and that nothing reads any more."""
    for df in dfs:
        spark = df.sparkSession
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of queries that are over: it does when the driver collects its garbage.

    What the first round lets go may hold the last query; its files go in a thread of Spark's.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with a number, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


#: Rows up to which keyed_join broadcasts all keys.
KEYED_ROWS = 100_000
#: Keys that hold more than this part of all rows are hot; no more than as many keys can be.
HOT_SHARE = 1000


def hot_share(spark: SparkSession) -> int:
    """HOT_SHARE, or more where so many tasks share the work that a smaller key already stands out."""
    return max(HOT_SHARE, 4 * shuffle_partitions(spark))


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """left with right's columns, null where right (one row a key) lacks the key.

    Column n of right, 1 at least, says how many of left's `total` rows hold the key. Keys
    of more than 1 / hot_share of all rows, so hot_share at most, are broadcast and their
    rows stay in place; the rows of other keys meet by a shuffle.
    """
    if total <= KEYED_ROWS:
        return left.join(F.broadcast(right), on, "left")
    share = hot_share(left.sparkSession)
    is_hot = F.col(n) * share > total
    hot = F.broadcast(right.filter(is_hot))
    rest = left.join(hot.select(on), on, "left_anti").join(right.filter(~is_hot), on, "left")
    return left.join(hot, on).unionByName(rest)


#: Bits of the largest bitmap that is broadcast to tell rows that may have a key from those that do not: 32 MB.
BITMAP_BITS = 1 << 28


def with_might_hold(df: DataFrame, key: Column, keys: DataFrame, n: int, to: str) -> DataFrame:
    """df with a boolean column: false only where no row of keys (one bigint column, n rows) equals key.

    The keys become a bitmap of 16 bits a key, BITMAP_BITS at most whatever n is, in rows
    of 4 KB; the more keys beyond that, the more rows may hold one. A null key holds none.
    """
    bits = min(BITMAP_BITS, 1 << max(15, (16 * n).bit_length()))
    bucket, bitmap = fresh(df, "bitmap_bucket"), fresh(df, "bitmap_bits")
    slot = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    rows = keys.groupBy(F.floor(slot / 32768).alias(bucket)).agg(F.bitmap_construct_agg(slot % 32768).alias(bitmap))
    at = F.pmod(key, F.lit(bits))
    both = df.join(F.broadcast(rows), F.floor(at / 32768) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(at % 32768 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return both.withColumn(to, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(bucket, bitmap)


#: Rows that one explode makes at most of a row.
RUN = 1 << 16


def numbered_copies(df: DataFrame, n: str, to: str, run: int = RUN) -> DataFrame:
    """Each row of df as often as its column n says, numbered from 1 in the column `to`; no array is longer than run."""
    part = fresh(df, "copies_part")
    out = df.filter(F.col(n) > 0).withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / run).cast("bigint"))))
    last = F.least(F.col(n).cast("bigint"), (F.col(part) + 1) * run)
    return out.withColumn(to, F.explode(F.sequence(F.col(part) * run + 1, last))).drop(part)


def crc_fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)), F.lit(0))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that travel to Python at once; texts can be long, and Spark bounds its batches by rows alone.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, if they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
