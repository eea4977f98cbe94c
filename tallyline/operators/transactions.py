"""Transactions: lookup by hash, pages, counts and hash keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.errors import NotFound
from ..plans.requests import check_hash

FIELDS = ("hash", "ledger_seq", "application_order", "close_time", "fee_charged", "n_ops")


def projected(txs: DataFrame, *more: str) -> DataFrame:
    return txs.select(*FIELDS, *more, F.when(F.col("successful"), "SUCCESS").otherwise("FAILED").alias("status"))


def by_hash(txs: DataFrame, ledger_range: DataFrame, tx_hash: str) -> DataFrame:
    """One row: the transaction or NOT_FOUND, with the store's range on it either way.

    The row of the range carries the request and drives an outer join; the hash is also a plain
    filter, so the scan prunes by footer and Bloom filter.
    """
    h = check_hash(tx_hash)
    hit = projected(txs.filter(F.col("hash") == h)).limit(1)
    asked = ledger_range.withColumn("asked", F.lit(h))
    return asked.join(hit, asked["asked"] == hit["hash"], "left").select(
        F.col("asked").alias("tx_hash"), F.coalesce("status", F.lit("NOT_FOUND")).alias("status"), "ledger_seq", "application_order", "close_time", "first_seq", "last_seq"
    )


def page(txs: DataFrame, start_pos: int, limit: int) -> DataFrame:
    """The first `limit` transactions from a position on, in order."""
    return projected(txs.filter(F.col("pos") >= start_pos).orderBy("pos").limit(limit))


def next_cursor(rows: list[int], asked: str | None) -> str | None:
    """The last position of a page; an empty page echoes its cursor."""
    return str(rows[-1]) if rows else asked


def check_ledgers(ledgers: DataFrame, first: int, last: int) -> None:
    """An error for the first ledger between that the store lacks."""
    spark = ledgers.sparkSession
    have = ledgers.select("sequence").filter(F.col("sequence").between(first, last))
    missing = spark.range(first, last + 1).join(have, F.col("id") == F.col("sequence"), "left_anti").agg(F.min("id")).first()[0]
    if missing is not None:
        raise NotFound(f"database does not contain metadata for ledger: {missing}")


def missing(ledger_ids: DataFrame, first: int, last: int) -> DataFrame:
    """Ledgers between that no row of ledger_ids (ledger_seq) names."""
    return ledger_ids.sparkSession.range(first, last + 1).join(ledger_ids, F.col("id") == F.col("ledger_seq"), "left_anti").select(F.col("id").alias("ledger_seq"))


def lookup_keys(txs: DataFrame) -> DataFrame:
    """(key, ledger_seq, application_order): the hash, and the inner hash of a fee bump, each key once."""
    both = txs.select(F.explode(F.array_compact(F.array("hash", "inner_hash"))).alias("key"), "ledger_seq", "application_order")
    return both.groupBy("key").agg(F.min(F.struct("ledger_seq", "application_order")).alias("p")).select("key", "p.ledger_seq", "p.application_order")


def at_position(ledgers_with_txs: DataFrame, order: int) -> DataFrame:
    """The transaction at a 1-based place of each ledger's array txs."""
    return ledgers_with_txs.select("sequence", F.get("txs", F.lit(order - 1)).alias("tx"))


def counts(txs: DataFrame) -> DataFrame:
    return txs.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("tx_count"))
