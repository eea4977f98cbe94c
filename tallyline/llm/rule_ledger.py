"""Quality rules as a ledger: measure once, store failure bits, judge by policy later."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._spark import small_batches
from ._text import _C1, SPACE, lines, mix, per_row, raw, repeated, seen_before, slices, span_hash, windows, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ALPHA = np.zeros(256, bool)
ALPHA[65:91] = ALPHA[97:123] = ALPHA[128:] = True
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_alpha", "n_bars", "n_bangs", "n_lines", "n_same_next")

#: (name, SQL condition under which the rule fails). Bit i of `failures` is rule i; append only.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 40 * n_words"),
    ("shouting", "100 * n_upper > 60 * n_alpha"),
    ("listing", "100 * n_bars > 25 * n_words"),
    ("exclamations", "100 * n_bangs > 25 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 15 * n_words"),
    ("stuttering", "100 * n_same_next > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """Rejects a document with any of `fatal`, or with at least `most` of `counted`."""

    version: int
    fatal: tuple[str, ...]
    counted: tuple[str, ...] = ()
    most: int = 2
    mask: int = field(init=False)
    counted_mask: int = field(init=False)

    def __post_init__(self):
        names = [n for n, _ in RULES]
        object.__setattr__(self, "mask", sum(1 << names.index(n) for n in self.fatal))
        object.__setattr__(self, "counted_mask", sum(1 << names.index(n) for n in self.counted))

    def rejects(self, failures: Column) -> Column:
        return (failures.bitwiseAND(F.lit(self.mask)) != 0) | (F.bit_count(failures.bitwiseAND(F.lit(self.counted_mask))) >= self.most)


#: Policies are never changed, only added.
POLICIES = {
    1: Policy(1, ("few_words", "repeated_windows")),
    2: Policy(2, ("few_words", "repeated_windows", "symbols", "shouting", "listing", "exclamations", "stuttering"), ("repeated_lines", "long_words")),
}


def _measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    s, e, who = words(data, off)
    h = span_hash(data, s, e)
    row_mix = mix(np.arange(n, dtype=np.uint64) * _C1 + np.uint64(99))
    inside = ~SPACE[data]
    n_words = np.bincount(who, minlength=n)
    chars = per_row(inside & ((data & 0xC0) != 0x80), off)
    ls, le, lwho = lines(data, off)
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=c[1:])
    filled = np.flatnonzero(c[le] > c[ls])
    dup = seen_before(span_hash(data, ls[filled], le[filled]) ^ row_mix[lwho[filled]])
    n_dup = np.bincount(lwho[filled][dup], minlength=n)
    wh, at = windows(h, who, WINDOW)
    hit = at[repeated(wh ^ row_mix[who[at]])]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.subtract.at(cover, hit + WINDOW, 1)
    n_rep = np.bincount(who[np.cumsum(cover[:-1]) > 0], minlength=n)
    same = np.flatnonzero((h[1:] == h[:-1]) & (who[1:] == who[:-1]))
    return [
        n_words, chars, per_row(SYMBOL[data], off), n_dup, n_rep, per_row(UPPER[data], off), per_row(ALPHA[data] & ((data & 0xC0) != 0x80), off),
        per_row(data == 124, off), per_row(data == 33, off), np.bincount(lwho[filled], minlength=n), np.bincount(who[same], minlength=n),
    ]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: id, every measurement of MEASURES, and `failures` with a bit per failed rule.

    One pass over each whole text, no shuffle. Null texts have no words. Lines are split
    at \\n; n_lines counts those with a word. n_repeat_words counts words inside 8-word
    windows that occur twice or more in the text, n_same_next words equal to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols = [pa.array(np.asarray(m, np.int64)) for m in _measure(*raw(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *cols], ["id", *MEASURES])

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(run, "id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = F.lit(0).cast("bigint")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return out.withColumn("failures", bits).withColumnRenamed("id", id_col)


def apply_policy(ledger: DataFrame, version: int, to: str = "kept") -> DataFrame:
    """The ledger with a boolean column: whether the policy keeps the document."""
    return ledger.withColumn(to, ~POLICIES[version].rejects(F.col("failures")))


def ablations(ledger: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: rule, failed, only_this (documents kept if the rule were dropped).

    Ledgers combine by failure mask first, so at most 2^rules rows are left to look at;
    every count then comes from bitwise tests of those masks.
    """
    p = POLICIES[version]
    masks = ledger.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    rows = []
    for i, (name, _) in enumerate(RULES):
        if (p.mask | p.counted_mask) >> i & 1:
            without = F.col("failures").bitwiseAND(F.lit(~(1 << i)))
            failed = F.col("failures").bitwiseAND(F.lit(1 << i)) != 0
            saved = p.rejects(F.col("failures")) & ~p.rejects(without)
            rows.append(F.struct(F.lit(name).alias("rule"), F.when(failed, F.col("n")).otherwise(0).alias("failed"), F.when(saved, F.col("n")).otherwise(0).alias("only_this")))
    flat = masks.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return flat.groupBy("rule").agg(F.sum("failed").alias("failed"), F.sum("only_this").alias("only_this"))
