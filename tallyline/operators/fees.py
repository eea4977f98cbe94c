"""Fees: derivation and exact distributions, by window and sliding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

PERCENTS = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99)
#: Operations that pay for resources, and the versions of a transaction's meta that say how much.
CONTRACT_OPS, RESOURCE_META = ("invoke", "extend_ttl", "restore"), (3, 4)
#: Report percentiles and the share of ranks by which each may be off.
RECENT = ((50, 0.05), (90, 0.01), (99, 0.001))


def by_op_type() -> tuple[Column, Column]:
    """(is contract, resource fee) for derive, from op_type, meta_version, nonrefundable and refundable.

    A contract transaction's one operation is of CONTRACT_OPS; its resource fee is both
    parts together, unknown if its meta has another version or lacks a part.
    """
    contract = (F.col("n_ops") == 1) & F.coalesce(F.col("op_type").isin(*CONTRACT_OPS), F.lit(False))
    return contract, F.when(F.col("meta_version").isin(*RESOURCE_META), F.col("nonrefundable") + F.col("refundable"))


def derive(txs: DataFrame, parts: tuple[Column, Column] | None = None) -> DataFrame:
    """ledger_seq, kind, fee: contract transactions pay their inclusion fee, others (classic) a share an operation.

    parts are (is contract, resource fee), as of by_op_type; without, one operation makes
    a contract transaction and the column resource_fee is what it paid. Transactions
    without operations are left out, and so are contract ones of unknown resource fee.
    The subtraction is signed: a negative fee shows.
    """
    contract, resource = parts or (F.col("n_ops") == 1, F.col("resource_fee"))
    fee = F.when(contract, F.col("fee_charged") - resource).otherwise(F.expr("fee_charged div n_ops"))
    return txs.filter("n_ops > 0").select("ledger_seq", F.when(contract, "contract").otherwise("classic").alias("kind"), fee.cast("bigint").alias("fee")).filter("fee is not null")


def _stats(hist: DataFrame, by: list[str]) -> DataFrame:
    """Nearest-rank percentiles, mode (smallest of the most frequent), max, min and count from (by, fee, n).

    Works on distinct fees and counts, which combine on the map side and never gather a
    window's raw fees in one row.
    """
    to = Window.partitionBy(*by).orderBy("fee").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    c = hist.withColumn("upto", F.sum("n").over(to)).withColumn("total", F.sum("n").over(all_))
    picks = [F.min(F.when(F.col("upto") >= F.floor((F.col("total") * p + 99) / 100), F.col("fee"))).alias(f"p{p}") for p in PERCENTS]
    mode = F.max_by("fee", F.struct(F.col("n"), -F.col("fee"))).alias("mode")
    return c.groupBy(*by).agg(F.max("fee").alias("max"), F.min("fee").alias("min"), mode, *picks, F.sum("n").cast("bigint").alias("fee_count"))


def distribution(fees: DataFrame, ledgers: DataFrame, kind: str, latest: int, window: int) -> DataFrame:
    """One row over the last `window` ledgers; all zeros, ledger count too, when there is no fee."""
    first = latest - window + 1
    some = fees.filter((F.col("kind") == kind) & F.col("ledger_seq").between(first, latest))
    hist = some.groupBy("fee").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(0))
    n_ledgers = ledgers.filter(F.col("ledger_seq").between(first, latest)).agg(F.countDistinct("ledger_seq").alias("ledger_count")).withColumn("one", F.lit(0))
    both = n_ledgers.join(_stats(hist, ["one"]), "one", "left").drop("one")
    zero = F.lit(0).cast("bigint")
    cols = ["max", "min", "mode", *[f"p{p}" for p in PERCENTS], "fee_count"]
    return both.select(*[F.coalesce(c, zero).alias(c) for c in cols], F.when(F.coalesce("fee_count", zero) > 0, F.col("ledger_count")).otherwise(zero).alias("ledger_count"))


def sliding(fees: DataFrame, kind: str, window: int) -> DataFrame:
    """The distribution over the last `window` ledgers as of every ledger that has fees.

    Fees of a ledger combine to (fee, count) first. Windows that end in one block of
    `window` ledgers are worked out together, from this block and the one before, so a
    distinct fee is copied twice at most, whatever the window. Spark sorts a block by fee;
    it then passes in batches, of which a task holds one.
    """
    some = fees.filter(F.col("kind") == kind)
    hist = some.groupBy("ledger_seq", "fee").agg(F.count(F.lit(1)).alias("n")).select("ledger_seq", F.lit(True).alias("counted"), "fee", "n")
    totals = some.groupBy("ledger_seq").agg(F.count(F.lit(1)).alias("n")).select("ledger_seq", F.lit(False).alias("counted"), F.lit(0).cast("bigint").alias("fee"), "n")
    blocks = F.sequence(F.floor(F.col("ledger_seq") / window), F.floor((F.col("ledger_seq") + window - 1) / window))
    dealt = hist.unionByName(totals).select(F.explode(blocks).alias("block"), "counted", "fee", "ledger_seq", "n")
    rows = dealt.repartition("block").sortWithinPartitions("block", "counted", "fee")
    cols = ["as_of", "max", "min", "mode", *[f"p{p}" for p in PERCENTS], "fee_count"]
    return rows.mapInPandas(_blocks(window, cols), ", ".join(f"{c} bigint" for c in cols))


def _blocks(window: int, cols: list[str]):
    """A mapInPandas function over blocks: first the counts of their ledgers, then (fee, ledger, n) in order of fees."""

    def run(parts):
        block = None
        for part in parts:
            keys = part["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if block is None or block.number != keys[i]:
                    if block is not None:
                        yield block.rows(cols)
                    block = _Block(int(keys[i]), window)
                block.add(*[part[c].to_numpy()[i:j] for c in ("counted", "fee", "ledger_seq", "n")])
        if block is not None:
            yield block.rows(cols)

    return run


class _Block:
    """The windows that end in ledgers number * window and the window - 1 after it; window i holds places i to i + window - 1."""

    def __init__(self, number: int, window: int):
        self.number, self.window, self.base = number, window, number * window - window + 1
        self.counts = np.zeros(2 * window - 1, np.int64)
        self.wait: tuple | None = None  # rows of the last fee, of which more may come
        self.ranks = None

    def add(self, counted, fee, seq, n) -> None:
        heads = int(np.searchsorted(counted, True))
        np.add.at(self.counts, seq[:heads] - self.base, n[:heads])
        fee, at, n = fee[heads:], seq[heads:] - self.base, n[heads:]
        if len(fee):
            if self.wait is not None:
                fee, at, n = (np.concatenate(x) for x in zip(self.wait, (fee, at, n)))
            cut = int(np.searchsorted(fee, fee[-1]))
            self.wait = fee[cut:], at[cut:], n[cut:]
            self.take(fee[:cut], at[:cut], n[:cut])

    def take(self, fee, at, n) -> None:
        """Rows whose fees are whole."""
        w = self.window
        if self.ranks is None:
            total = np.convolve(self.counts, np.ones(w, np.int64), "valid")
            self.ranks = (total[:, None] * np.array(PERCENTS) + 99) // 100
            self.due = [i for i in range(w) if self.counts[i + w - 1]]
            self.upto, self.most, self.mode, self.low, self.high = (np.zeros(w, np.int64) for _ in range(5))
            self.picks = np.zeros((w, len(PERCENTS)), np.int64)
        for i in self.due:
            here = (at >= i) & (at < i + w)
            f = fee[here]
            if not len(f):
                continue
            first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])))
            f, c = f[first], np.add.reduceat(n[here], first)
            upto = self.upto[i] + np.cumsum(c)
            found = (self.ranks[i] > self.upto[i]) & (self.ranks[i] <= upto[-1])
            self.picks[i, found] = f[np.searchsorted(upto, self.ranks[i, found])]
            top = int(np.argmax(c))
            if c[top] > self.most[i]:
                self.most[i], self.mode[i] = c[top], f[top]
            if not self.upto[i]:
                self.low[i] = f[0]
            self.high[i], self.upto[i] = f[-1], upto[-1]

    def rows(self, cols: list[str]) -> pd.DataFrame:
        if self.wait is None:  # a block without fees holds no window
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})
        self.take(*self.wait)
        due = np.array(self.due, np.int64)
        as_of = self.number * self.window + due
        return pd.DataFrame(dict(zip(cols, [as_of, self.high[due], self.low[due], self.mode[due], *self.picks[due].T, self.upto[due]])))


def lower_index_quantiles(df: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Report quantiles: element floor(p * (n - 1) / 100), from 0, of the sorted values; min, max and count."""
    hist = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))  # combined on the map side: a hot key is its distinct values
    c = hist.withColumn("upto", F.sum("n").over(Window.partitionBy(by).orderBy(value))).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    picks = [F.min(F.when(F.col("upto") > F.expr(f"{p} * (total - 1) div 100"), F.col(value))).alias(f"q{p}") for p in percents]
    return c.groupBy(by).agg(*picks, F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("n").cast("bigint").alias("n"))


def recent_quantiles(df: DataFrame, at: str, value: str, by: str, span: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """by, start, n and q50, q90, q99 of every sliding window of time; an element each, off by the ranks of RECENT at most.

    Summaries combine on the map side. Also for a stream with a watermark, as windows
    then close. Null values are left out, and so are windows without any.
    """
    some = df.filter(F.col(value).isNotNull() & F.col(at).isNotNull())
    picks = [F.percentile_approx(value, F.lit(p / 100), F.lit(round(2 / error))).alias(f"q{p}") for p, error in RECENT]
    per = some.groupBy(by, F.window(at, span, slide).alias("span")).agg(F.count(F.lit(1)).alias("n"), *picks)
    return per.select(by, F.col("span.start").alias("start"), "n", *[f"q{p}" for p, _ in RECENT])
