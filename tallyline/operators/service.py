"""Whole requests: validation, rows, the range they come from and the cursor to go on with.

Each function takes tables and the store's range as one snapshot has them, so a reply
never mixes two states. Rows stay a DataFrame; what comes to the driver is a page's
positions, at most the largest page.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as sc
from ..functions.cursor import op_of, tx_of
from ..plans import requests as rq
from . import events as ev, fees, ledgers as lg, state as st, transactions as tx


@dataclass(frozen=True)
class Reply:
    rows: DataFrame
    store: rq.LedgerRange
    cursor: str | None = None

    def flat(self) -> DataFrame:
        """The rows with the reply's own fields on each."""
        r = self.store
        own = {"latest_ledger": r.last, "latest_close": r.last_close, "oldest_ledger": r.first, "oldest_close": r.first_close}
        out = self.rows.select("*", *[F.lit(n).cast("bigint").alias(c) for c, n in own.items()])
        return out if self.cursor is None else out.withColumn("cursor", F.lit(self.cursor))


def event_info(df: DataFrame, form: str) -> DataFrame:
    """All response fields of events; topics (four at most) and value in base64 or as JSON text."""
    topics = F.slice("topics", 1, 4)
    if form == "json":
        topic, value = F.to_json(topics), F.col("data")
    else:
        topic, value = F.array_join(sc.base64_each(F.transform(topics, lambda t: t.cast("binary"))), ",", ""), F.base64(F.col("data").cast("binary"))
    return df.select(
        F.when(F.col("event_kind") == 0, "system").otherwise("contract").alias("type"),
        "ledger_seq", sc.rfc3339(F.col("close_time")).alias("closed_at"), "contract_id", "id",
        sc.to_int32(op_of(F.col("pos"))).alias("op_index"), sc.to_int32(tx_of(F.col("pos"))).alias("tx_index"),
        F.col("in_successful").alias("in_successful_call"), "tx_hash", topic.alias("topic"), value.alias("value"),
    )


def get_events(events: DataFrame, store: rq.LedgerRange, start: int | None = None, end: int | None = None, cursor: str | None = None, filters: Sequence[ev.EventFilter] = (), limit: int | None = None, form: str = "") -> Reply:
    """A page of events from a start ledger or past a cursor, inside the scan window.

    The next cursor is the last id of a full page, or the end of what was scanned.
    """
    form, n = rq.format_of(form), rq.limit_of(limit, rq.EVENT_LIMITS)
    at, stop = rq.event_window(store, start, end, cursor)
    seen = events.filter((F.col("ledger_seq") >= at.ledger) & (F.col("ledger_seq") < stop) & (F.col("id") >= str(at)))
    ids = [r["id"] for r in ev.page(seen, filters, limit=n).select("id").collect()]
    rows = ev.matching(seen, filters).filter(F.col("id") <= ids[-1]) if ids else seen.limit(0)
    return Reply(event_info(rows, form), store, rq.next_event_cursor(ids, n, stop))


def get_transactions(txs: DataFrame, store: rq.LedgerRange, start: int | None = None, cursor: str | None = None, limit: int | None = None) -> Reply:
    """A page of transactions in order; the cursor is the last one's position, or the request's own on an empty page."""
    n, first = rq.limit_of(limit, rq.TX_LIMITS), rq.tx_start(store, start, cursor)
    seen = txs.filter((F.col("ledger_seq") >= first >> 32) & (F.col("pos") >= first) & (F.col("ledger_seq") <= store.last))
    at = [r["pos"] for r in seen.orderBy("pos").limit(n).select("pos").collect()]
    rows = seen.filter(F.col("pos") <= at[-1]) if at else seen.limit(0)
    fields = tx.projected(rows.withColumn("fee_bump", F.col("inner_hash").isNotNull()), "fee_bump")
    return Reply(fields, store, tx.next_cursor(at, cursor) or "")


def get_ledgers(ledgers: DataFrame, store: rq.LedgerRange, start: int | None = None, cursor: str | None = None, limit: int | None = None) -> Reply:
    """A page of ledgers; the cursor is the last one's number."""
    n, first = rq.limit_of(limit, rq.LEDGER_LIMITS), rq.ledger_start(store, start, cursor)
    page = lg.page(ledgers.filter(F.col("sequence") <= store.last), first, n)
    last = page.agg(F.max("sequence")).first()[0]
    rows = page.withColumn("closed_at", sc.rfc3339(F.col("close_time")))
    return Reply(rows, store, str(last) if last is not None else cursor or "")


def get_entries(spark: SparkSession, entries: DataFrame, keys: Sequence, store: rq.LedgerRange) -> Reply:
    """Entries of the keys that exist, in request order, and the ledger they are as of."""
    return Reply(st.lookup(spark, entries, keys), store)


def get_latest_ledger(ledgers: DataFrame, store: rq.LedgerRange) -> Reply:
    """The last ledger that the store's range holds: hash, protocol version and number."""
    at = lg.point(ledgers, store.last).select("hash", "protocol_version", "sequence")
    return Reply(at, store)


def get_network(spark: SparkSession, ledgers: DataFrame, passphrase: str, faucet: str = "") -> DataFrame:
    """passphrase, faucet and the protocol version of the last ledger."""
    return spark.createDataFrame([(passphrase, faucet, lg.protocol_of(ledgers))], "passphrase string, faucet string, protocol_version bigint")


def get_fee_stats(txs: DataFrame, store: rq.LedgerRange, classic: int = rq.CLASSIC_WINDOW, contract: int = rq.CONTRACT_WINDOW) -> Reply:
    """A distribution row a kind over its own window up to the latest ledger."""
    rq.check_fee_windows(classic, contract, rq.RETENTION)
    parts = []
    for kind, window in (("classic", classic), ("contract", contract)):
        some = txs.filter(F.col("ledger_seq").between(store.last - window + 1, store.last))
        parts.append(fees.distribution(fees.derive(some), some, kind, store.last, window).withColumn("kind", F.lit(kind)))
    return Reply(parts[0].unionByName(parts[1]), store)

