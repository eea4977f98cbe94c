"""Ledgers, transactions, events and state entries as views of plain tables.

Ranges of ledgers turn into ranges of the stored timestamp, so they reach the Parquet
scan as pushed filters; the columns asked for are all that is read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.cursor import event_id, pack
from . import lake

EPOCH = dt.datetime(2024, 1, 1)
ORDER_EPOCH = dt.datetime(1995, 1, 1)
FIRST = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _between(df: DataFrame, column: str, lo: dt.datetime | None, hi: dt.datetime | None) -> DataFrame:
    kind = df.schema[column].dataType
    if lo is not None:
        df = df.filter(F.col(column) >= F.lit(str(lo)).cast(kind))
    if hi is not None:
        df = df.filter(F.col(column) < F.lit(str(hi)).cast(kind))
    return df


def events(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Events of ledgers first to last, both included: one ledger an hour from ledger 2 on."""
    raw = table(spark, sf_dir, "events")
    hour = dt.timedelta(hours=1)
    raw = _between(raw, "ts", None if first is None else EPOCH + (first - FIRST) * hour, None if last is None else EPOCH + (last + 1 - FIRST) * hour)
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - int((EPOCH - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    seq = (F.lit(FIRST) + F.floor(micros / 3_600_000_000)).cast("bigint")
    df = raw.withColumn("ledger_seq", seq)
    df = df.withColumn("tx_index", F.row_number().over(Window.partitionBy("ledger_seq").orderBy("event_id")).cast("bigint"))
    topic2 = F.get_json_object("props", "$.k")
    df = df.withColumn("pos", pack(F.col("ledger_seq"), F.col("tx_index"), 0))
    return df.select(
        event_id(F.col("pos"), F.lit(0)).alias("id"),
        "pos", F.lit(0).cast("bigint").alias("event_index"), "ledger_seq", "tx_index", F.lit(0).cast("bigint").alias("op_index"),
        F.col("user_id").alias("contract_id"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).cast("bigint").alias("event_kind"),
        F.array("event_type", topic2).alias("topics"), F.lit(2).alias("n_topics"),
        F.col("event_type").alias("topic1"), topic2.alias("topic2"),
        (F.lit(1704067200) + (F.col("ledger_seq") - 1) * 3600).alias("close_time"),
        F.floor(F.col("value") * 100).cast("bigint").alias("fee"),
        F.col("props").alias("data"), F.col("event_id").alias("raw_id"),
        F.sha2(F.concat(F.lit("tx"), F.col("event_id").cast("string")).cast("binary"), 256).alias("tx_hash"), (F.col("user_id") % 10 != 0).alias("in_successful"),
    )


def stored_events(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """As events, from a table by ledger bucket, sorted by id, with Bloom filters on contract and topics."""
    path, schema = lake.stored(spark, sf_dir, "events", lambda: events(spark, sf_dir), "ledger_seq", ["id"], ("contract_id", "topic1", "topic2"))
    return lake.read(spark, path, "ledger_seq", first, last, schema)


EVENTS_SQL = """
raw_ev AS (SELECT *, (2 + ((epoch_us(ts) - 1704067200000000) // 3600000000))::BIGINT AS ledger_seq FROM events),
num_ev AS (SELECT *, row_number() OVER (PARTITION BY ledger_seq ORDER BY event_id) AS tx_index FROM raw_ev),
ev AS (SELECT *, ledger_seq * 4294967296 + tx_index * 4096 AS pos, lpad((ledger_seq * 4294967296 + tx_index * 4096)::VARCHAR, 19, '0') || '-0000000000' AS id,
  user_id AS contract_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END::BIGINT AS event_kind, event_type AS topic1, json_extract_string(props, '$.k') AS topic2,
  1704067200 + (ledger_seq - 1) * 3600 AS close_time, floor(value * 100)::BIGINT AS fee, props AS data,
  sha256('tx' || event_id) AS tx_hash, user_id % 10 <> 0 AS in_successful FROM num_ev)"""


def _day(first: int | None, last: int | None) -> tuple:
    day = dt.timedelta(days=1)
    return (None if first is None else ORDER_EPOCH + (first - FIRST) * day, None if last is None else ORDER_EPOCH + (last + 1 - FIRST) * day)


def transactions(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Transactions of ledgers first to last: one ledger a day; the operations are counted before the join."""
    orders = _between(table(spark, sf_dir, "orders"), "o_orderdate", *_day(first, last))
    ops = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_ops"))
    seq = (F.lit(FIRST) + F.datediff("o_orderdate", F.lit(ORDER_EPOCH.date()))).cast("bigint")
    df = orders.withColumn("ledger_seq", seq).withColumn("application_order", F.row_number().over(Window.partitionBy("ledger_seq").orderBy("o_orderkey")).cast("bigint"))
    df = df.join(ops, df["o_orderkey"] == ops["l_orderkey"], "left")
    n_ops = F.coalesce("n_ops", F.lit(0)).cast("bigint")
    fee = F.floor(F.col("o_totalprice") * 100).cast("bigint")
    return df.select(
        F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("hash"), "ledger_seq", "application_order",
        pack(F.col("ledger_seq"), F.col("application_order"), 1).alias("pos"),
        (F.col("o_orderstatus") != "F").alias("successful"), n_ops.alias("n_ops"), fee.alias("fee_charged"),
        F.expr("floor(o_totalprice * 100) div 3").cast("bigint").alias("resource_fee"), close_time(F.col("ledger_seq")).alias("close_time"),
        F.when(F.col("o_orderkey") % 5 == 0, F.sha2(F.concat(F.lit("inner"), F.col("o_orderkey").cast("string")).cast("binary"), 256)).alias("inner_hash"),
    )


def stored_transactions(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """As transactions, from a table by ledger bucket, sorted by position, with Bloom filters on the hashes."""
    path, schema = lake.stored(spark, sf_dir, "transactions", lambda: transactions(spark, sf_dir), "ledger_seq", ["pos"], ("hash", "inner_hash"))
    return lake.read(spark, path, "ledger_seq", first, last, schema)


def fee_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fees derive from in full: ledger_seq, n_ops, op_type of the first operation, fee_charged, meta_version, nonrefundable, refundable."""
    flags = F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag", "l_suppkey")).alias("flag")
    ops = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), flags)
    df = table(spark, sf_dir, "orders").join(ops, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, fee = F.col("o_orderkey"), F.floor(F.col("o_totalprice") * 100).cast("bigint")
    return df.select(
        (F.lit(FIRST) + F.datediff("o_orderdate", F.lit(ORDER_EPOCH.date()))).cast("bigint").alias("ledger_seq"), F.coalesce("n", F.lit(0)).alias("n_ops"),
        F.when(F.col("flag") == "R", "invoke").when(F.col("flag") == "A", "restore").otherwise("payment").alias("op_type"), fee.alias("fee_charged"),
        (key % 4 + 1).alias("meta_version"), F.expr("floor(o_totalprice * 100) div 4").alias("nonrefundable"), F.when(key % 9 != 0, F.expr("floor(o_totalprice * 100) div 12")).alias("refundable"),
    )


def close_time(seq: Column) -> Column:
    return F.lit(788918400) + (seq - 1) * 86400


def _nested(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """sequence and `all`, the ledger's (o_orderkey, successful, lines) in order: what nested ledgers derive from, without hashes."""
    orders = _between(table(spark, sf_dir, "orders"), "o_orderdate", *_day(first, last))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    if first is not None or last is not None:
        lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    line = F.struct("l_linenumber", F.col("l_suppkey").alias("contract_id"), F.col("l_returnflag").alias("topic1"), F.col("l_quantity").cast("bigint").alias("data"))
    ops = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    tx = F.struct("o_orderkey", (F.col("o_orderstatus") != "F").alias("successful"), "lines")
    seq = (F.lit(FIRST) + F.datediff("o_orderdate", F.lit(ORDER_EPOCH.date()))).cast("bigint")
    return orders.join(ops, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(seq.alias("sequence")).agg(F.sort_array(F.collect_list(tx)).alias("all"))


def _keyed(nested: DataFrame) -> DataFrame:
    def tx(x: Column) -> Column:
        text = x["o_orderkey"].cast("string")
        inner = F.when(x["o_orderkey"] % 5 == 0, F.sha2(F.concat(F.lit("inner"), text).cast("binary"), 256))
        events_ = F.transform(x["lines"], lambda y: F.struct(y["contract_id"], y["topic1"], y["data"]))
        return F.struct(F.sha2(text.cast("binary"), 256).alias("key"), inner.alias("inner_key"), x["successful"], events_.alias("events"))

    return nested.select("sequence", close_time(F.col("sequence")).alias("close_time"), F.transform("all", tx).alias("txs"))


def nested_ledgers(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Ledgers that hold their transactions, and those their events (an order's lines): see streaming.store.split."""
    return _keyed(_nested(spark, sf_dir, first, last))


def stored_nested(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """As nested_ledgers, from a table by ledger bucket: lines are dealt to their ledgers once, not for each range; hashes are worked out when read."""
    path, schema = lake.stored(spark, sf_dir, "nested", lambda: _nested(spark, sf_dir), "sequence", ["sequence"], ())
    return _keyed(lake.read(spark, path, "sequence", first, last, schema))


TX_SQL = """
raw_tx AS (SELECT *, (2 + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)))::BIGINT AS ledger_seq FROM orders),
ops AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
tx AS (SELECT sha256(o_orderkey::VARCHAR) AS hash, ledger_seq, row_number() OVER (PARTITION BY ledger_seq ORDER BY o_orderkey) AS application_order,
  ledger_seq * 4294967296 + row_number() OVER (PARTITION BY ledger_seq ORDER BY o_orderkey) * 4096 + 1 AS pos, o_orderstatus <> 'F' AS successful,
  coalesce(n, 0)::BIGINT AS n_ops, floor(o_totalprice * 100)::BIGINT AS fee_charged, (floor(o_totalprice * 100)::BIGINT // 3) AS resource_fee,
  788918400 + (ledger_seq - 1) * 86400 AS close_time, CASE WHEN o_orderkey % 5 = 0 THEN sha256('inner' || o_orderkey) END AS inner_hash
  FROM raw_tx LEFT JOIN ops ON o_orderkey = l_orderkey)"""


def ledgers(spark: SparkSession, sf_dir: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """One row a ledger that has events: sequence, close_time, hash, protocol_version, tx_count."""
    raw = table(spark, sf_dir, "events").select("ts")
    hour = dt.timedelta(hours=1)
    raw = _between(raw, "ts", None if first is None else EPOCH + (first - FIRST) * hour, None if last is None else EPOCH + (last + 1 - FIRST) * hour)
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - int((EPOCH - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    seq = (F.lit(FIRST) + F.floor(micros / 3_600_000_000)).cast("bigint")
    one = raw.groupBy(seq.alias("sequence")).agg(F.count(F.lit(1)).alias("tx_count"))
    return one.select(
        "sequence", (F.lit(1704067200) + (F.col("sequence") - 1) * 3600).alias("close_time"), F.sha2(F.concat(F.lit("ledger"), F.col("sequence").cast("string")).cast("binary"), 256).alias("hash"),
        F.when(F.col("sequence") < 400, 22).otherwise(23).cast("bigint").alias("protocol_version"), "tx_count",
    )


LEDGERS_SQL = """
lg AS (SELECT sequence, 1704067200 + (sequence - 1) * 3600 AS close_time, sha256('ledger' || sequence) AS hash, CASE WHEN sequence < 400 THEN 22 ELSE 23 END::BIGINT AS protocol_version, tx_count
  FROM (SELECT (2 + ((epoch_us(ts) - 1704067200000000) // 3600000000))::BIGINT AS sequence, count(*) AS tx_count FROM events GROUP BY 1))"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State entries: key, entry, last_modified, live_until (null for keys divisible by 3)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("key"), F.col("c_name").alias("entry"), (k % 700 + 2).alias("last_modified"), F.when(k % 3 != 0, k + 1000).alias("live_until"))


ENTRIES_SQL = """
st AS (SELECT c_custkey AS key, c_name AS entry, c_custkey % 700 + 2 AS last_modified, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey + 1000 END AS live_until FROM customer)"""
