"""Ledgers: ranges, gaps, points, pages, tiers and trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.errors import InvalidParams, InvalidRequest, NotFound
from ..plans.requests import LedgerRange


def range_row(ledgers: DataFrame) -> DataFrame:
    """first_seq, first_close, last_seq, last_close in one aggregate; nulls for an empty store."""
    return ledgers.agg(F.min("sequence").alias("first_seq"), F.min_by("close_time", "sequence").alias("first_close"), F.max("sequence").alias("last_seq"), F.max_by("close_time", "sequence").alias("last_close"))


def range_of(ledgers: DataFrame) -> LedgerRange:
    r = range_row(ledgers).first()
    if r["first_seq"] is None:
        raise InvalidRequest("DB is empty")
    return LedgerRange(r["first_seq"], r["last_seq"], r["first_close"], r["last_close"])


def count_in_range(ledgers: DataFrame, first: int, last: int) -> DataFrame:
    """n, lo, hi of the ledgers between; zeros when there are none."""
    zero = F.lit(0).cast("bigint")
    return ledgers.filter(F.col("sequence").between(first, last)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("sequence"), zero).alias("lo"), F.coalesce(F.max("sequence"), zero).alias("hi"))


def gap_check(ledgers: DataFrame, first: int, last: int) -> DataFrame:
    c = count_in_range(ledgers, first, last)
    return c.withColumn("gapless", (F.col("n") == 0) | (F.col("n") == F.col("hi") - F.col("lo") + 1))


def gaps(ledgers: DataFrame, width: int = 1024) -> DataFrame:
    """gap_start, gap_end of every run of missing ledgers.

    Neighbours are looked up inside ranges of `width` ledgers, and the ends of ranges
    among themselves, so the window without a key sees two rows a range.
    """
    part = Window.partitionBy("part").orderBy("sequence")
    inner = ledgers.select("sequence", F.floor(F.col("sequence") / width).alias("part")).withColumn("next", F.lead("sequence").over(part))
    found = inner.filter("next > sequence + 1").select("sequence", "next")
    ends = inner.groupBy("part").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("sequence"))
    outer = ends.withColumn("next", F.lead("lo").over(Window.orderBy("part"))).filter("next > sequence + 1").select("sequence", "next")
    return found.unionByName(outer).select((F.col("sequence") + 1).alias("gap_start"), (F.col("next") - 1).alias("gap_end"))


def point(ledgers: DataFrame, seq: int) -> DataFrame:
    return ledgers.filter(F.col("sequence") == seq)


def one(ledgers: DataFrame, seq: int):
    """The row of a ledger; an error when there is none or more than one."""
    rows = point(ledgers, seq).limit(2).collect()
    if not rows:
        raise NotFound(f"ledger {seq} not found")
    if len(rows) > 1:
        raise InvalidRequest(f"multiple ledger entries (2) found for sequence {seq}")
    return rows[0]


def batch(ledgers: DataFrame, first: int, last: int) -> DataFrame:
    if first > last:
        raise InvalidParams(f"start ledger {first} must not be greater than end ledger {last}")
    return ledgers.filter(F.col("sequence").between(first, last)).orderBy("sequence")


def page(ledgers: DataFrame, start: int, limit: int) -> DataFrame:
    return ledgers.filter(F.col("sequence") >= start).orderBy("sequence").limit(limit)


def tiered(cold: DataFrame, hot: DataFrame, hot_first: int, first: int, last: int) -> DataFrame:
    """Ledgers first to last: cold below the hot store's first ledger, hot from there on; a store out of range isn't read."""
    parts = []
    if first < hot_first:
        parts.append(cold.filter(F.col("sequence").between(first, min(last, hot_first - 1))))
    if last >= hot_first:
        parts.append(hot.filter(F.col("sequence").between(max(first, hot_first), last)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("sequence")


def complete(ledgers: DataFrame, first: int, last: int) -> DataFrame:
    """Ledgers first to last of a cold store; an error if one is missing."""
    if count_in_range(ledgers, first, last).first()["n"] != last - first + 1:
        raise NotFound(f"cold store lacks ledgers between {first} and {last}")
    return batch(ledgers, first, last)


def trim(df: DataFrame, latest: int, window: int, seq: str = "sequence") -> DataFrame:
    """What stays of a table when the last `window` ledgers are kept."""
    return df.filter(F.col(seq) >= latest + 1 - window) if latest + 1 > window else df


def protocol_of(ledgers: DataFrame, known: tuple[int, ...] = (1, 2)) -> int:
    """The protocol version in the last ledger's header; an error if its meta (column meta_version) is of none of the known versions."""
    r = ledgers.agg(F.max_by(F.struct("meta_version", "protocol_version"), "sequence").alias("r")).first()["r"]
    if r is None:
        raise InvalidRequest("DB is empty")
    if r["meta_version"] not in known:
        raise InvalidRequest(f"unsupported ledger meta version: {r['meta_version']}")
    return r["protocol_version"]


def newest(ledgers: DataFrame) -> DataFrame:
    """The last ledger's row, by one aggregate and no sort."""
    cols = [c for c in ledgers.columns if c != "sequence"]
    return ledgers.agg(F.max("sequence").alias("sequence"), *[F.max_by(c, "sequence").alias(c) for c in cols])
