"""Event search: filters, scans and pages."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.cursor import after_all, after_tx, before_all, event_id, pack
from ..plans.errors import InvalidParams

ONE, REST = "*", "**"
KINDS = {"system": 0, "contract": 1, "diagnostic": 2}


@dataclass(frozen=True)
class EventFilter:
    """All parts that are given have to hold; each is a list of alternatives.

    A topic pattern has a value or * (any one topic) for each place; ** at its end
    stands for any number of further topics. Without ** the number of topics is exact.
    """

    kinds: tuple[int, ...] = ()
    contracts: tuple = ()
    topics: tuple[tuple[str, ...], ...] = ()

    def column(self) -> Column:
        parts = []
        if self.kinds:
            parts.append(F.col("event_kind").isin(*self.kinds))
        if self.contracts:
            parts.append(F.col("contract_id").isin(*self.contracts))
        if self.topics:
            parts.append(_any([topic_pattern(t) for t in self.topics]))
        return functools.reduce(operator.and_, parts) if parts else F.lit(True)


def _any(cols: list[Column]) -> Column:
    return functools.reduce(operator.or_, cols)


def topic_pattern(pattern: Sequence[str]) -> Column:
    """The number of topics and the first two are columns of their own, so that scans can test them."""
    if not pattern:
        raise InvalidParams("topic pattern cannot be empty")
    if REST in pattern[:-1]:
        raise InvalidParams("** is allowed only as the last segment")
    fixed = pattern[:-1] if pattern[-1] == REST else pattern
    size = F.col("n_topics")
    out = size >= len(fixed) if pattern[-1] == REST else size == len(fixed)
    for i, want in enumerate(fixed):
        if want != ONE:
            out &= (F.col(f"topic{i + 1}") if i < 2 else F.get("topics", F.lit(i))) == want
    return out


def matching(df: DataFrame, filters: Sequence[EventFilter]) -> DataFrame:
    """Rows that one of the filters accepts; all rows without filters. One exact predicate of plain column comparisons, which scans can test."""
    return df.filter(_any([f.column() for f in filters])) if filters else df


def page(df: DataFrame, filters: Sequence[EventFilter] = (), after: str | None = None, end: int | None = None, limit: int = 100) -> DataFrame:
    """The first `limit` matching events by id, past a cursor and before ledger `end`."""
    if after is not None:
        df = df.filter(F.col("id") > after)
    if end is not None:
        df = df.filter(F.col("ledger_seq") < end)
    return matching(df, filters).orderBy("id").limit(limit)


def page_ends(df: DataFrame, filters: Sequence[EventFilter] = (), limit: int = 100) -> DataFrame:
    """page (from 0), first and last (its ids) and n of all the pages of a walk, each from the cursor that the last gave.

    Events are numbered inside their ledger, and what lies before a ledger is a sum over
    counts, so the window without a key sees a row a ledger and no page is a scan of its own.
    """
    some = matching(df, filters).select("ledger_seq", "id")
    before = F.coalesce(F.sum("in_ledger").over(Window.orderBy("ledger_seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = some.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("in_ledger")).select("ledger_seq", before.alias("before"))
    at = F.row_number().over(Window.partitionBy("ledger_seq").orderBy("id")) - 1
    paged = some.withColumn("at", at).join(starts, "ledger_seq").withColumn("page", F.expr(f"(before + at) div {limit}"))
    return paged.groupBy("page").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))


def info(df: DataFrame, json: bool = False) -> DataFrame:
    """The response fields of events; topics and data in base64, or as JSON text."""
    if json:
        topics, data = F.to_json("topics"), F.col("data")
    else:
        topics = F.array_join(F.transform("topics", lambda t: F.base64(t.cast("binary"))), ",", "")
        data = F.base64(F.col("data").cast("binary"))
    closed = F.date_format(F.timestamp_seconds("close_time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.select("id", F.when(F.col("event_kind") == 0, "system").otherwise("contract").alias("type"), "ledger_seq", closed.alias("closed_at"), "contract_id", topics.alias("topics"), data.alias("data"))


def staged_ids(df: DataFrame, stage: str = "stage") -> DataFrame:
    """Ids of events in four stages: before_all, operation events (null), after_tx, after_all.

    Needs ledger_seq, tx_index, op_index, ord (position inside what emitted them).
    Numbers run per ledger for before_all and after_all, per transaction for after_tx,
    per operation else; all of them partition by ledger at least.
    """
    c, ledger, at = F.col(stage), F.col("ledger_seq"), F.col("tx_index")
    pos = F.when(c == "before_all", before_all(ledger)).when(c == "after_all", after_all(ledger)).when(c == "after_tx", after_tx(ledger, at))
    out = df.withColumn("pos", pos.otherwise(pack(ledger, at, F.col("op_index"))))
    by = Window.partitionBy("ledger_seq", "pos").orderBy("tx_index", "ord")
    out = out.withColumn("event_index", (F.row_number().over(by) - 1).cast("bigint"))
    return out.withColumn("id", event_id(F.col("pos"), F.col("event_index")))
