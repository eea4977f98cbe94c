"""Mixing sources to target weights by balanced sampling (cube method)."""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import fresh, keyed_join, numbered_copies, stage

#: Documents in one flight; each leaves at most two undecided.
BLOCK = 1024
#: Equal rows that are numbered together.
RUN = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_level(sources: DataFrame, goal: Fraction, most: int) -> Fraction:
    """The share of goal per unit of weight when none gets more than most * s and the excess is shared again.

    sources has columns s and w. A round finds what is full at the present level and
    shares the rest among the others; the level only rises, so it ends. Each round is one
    aggregate with exact numbers, whatever the number of sources.
    """
    wide = "decimal(38,0)"
    total = sources.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    level, full = (goal / total if total else Fraction(0)), -1
    while True:
        num, den = (F.lit(str(x)).cast(wide) for x in (level.numerator, level.denominator))
        over = num * F.col("w").cast(wide) > den * (F.col("s") * most).cast(wide)
        used, free, n = sources.agg(F.coalesce(F.sum(F.when(over, F.col("s"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0)), F.count_if(over)).first()
        if not free or n == full:
            return level
        level, full = (goal - most * used) / Fraction(free), n


def flight(size: np.ndarray, p: np.ndarray, seed: int, land: bool) -> np.ndarray:
    """Move the probabilities p to 0 or 1, keeping sum(p) and sum(size * p).

    Three undecided units at a time step along the null space of (size, 1) until one of
    them is decided; at most two stay undecided. With land, those are rounded to the
    corner that comes nearest in size, then in number.
    """
    p = p.tolist()
    s = size.tolist()
    rng = np.random.default_rng(seed)
    draws: list[float] = []
    open_: list[int] = []
    eps = 1e-9
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        while len(open_) == 3 or len(open_) == 2 and s[open_[0]] == s[open_[1]]:
            at = open_
            if len(at) == 3:
                a, b, c = (s[j] for j in at)
                u = (float(b - c), float(c - a), float(a - b))
                if not any(u):
                    u = (1.0, -1.0, 0.0)
            else:
                u = (1.0, -1.0)
            up = down = float("inf")
            for j, d in zip(at, u):
                if d > 0:
                    up, down = min(up, (1 - p[j]) / d), min(down, p[j] / d)
                elif d < 0:
                    up, down = min(up, -p[j] / d), min(down, (p[j] - 1) / d)
            if not draws:
                draws = rng.random(4096).tolist()
            step = up if draws.pop() * (up + down) < down else -down
            still = []
            for j, d in zip(at, u):
                p[j] += step * d
                if p[j] <= eps or p[j] >= 1 - eps:
                    p[j] = float(round(p[j]))
                else:
                    still.append(j)
            open_ = still
    if land and open_:
        def cost(corner):
            return (abs(sum((c - p[j]) * s[j] for c, j in zip(corner, open_))), abs(sum(c - p[j] for c, j in zip(corner, open_))), corner)

        for j, c in zip(open_, min(itertools.product((0.0, 1.0), repeat=len(open_)), key=cost)):
            p[j] = c
    return np.array(p)


def settle(size: np.ndarray, p: np.ndarray, miss: float, free: np.ndarray) -> np.ndarray:
    """Decided p (0 or 1) with some flipped, so that the words missed (`miss`, negative if too many) come near 0.

    A swap takes one unit in and another out, so the number of documents stays; the best
    one is made as long as it leaves less. Where no swap helps, a single flip has to make
    up for a mean document at least. Units that are not free take no further copy.
    """
    p, size = p.copy(), size.astype(float)
    mean = size.mean() if len(size) else 0.0
    for _ in range(len(p)):
        into, out = np.flatnonzero((p < 0.5) & free), np.flatnonzero(p > 0.5)
        change = np.concatenate([size[into], -size[out]])
        if len(into) and len(out):
            o = out[np.argsort(size[out], kind="stable")]
            at = np.searchsorted(size[o], size[into] - miss)
            near = np.stack([np.clip(at - 1, 0, len(o) - 1), np.clip(at, 0, len(o) - 1)])
            pairs = size[into] - size[o][near]
            k, i = np.unravel_index(np.abs(miss - pairs).argmin(), pairs.shape)
            if abs(miss - pairs[k, i]) < abs(miss):
                p[into[i]], p[o[near[k, i]]], miss = 1.0, 0.0, miss - pairs[k, i]
                continue
        if not len(change):
            break
        i = int(np.abs(miss - change).argmin())
        if abs(miss) - abs(miss - change[i]) < max(mean, 1e-9):
            break
        j = into[i] if i < len(into) else out[i - len(into)]
        p[j], miss = 1 - p[j], miss - change[i]
    return p


def _sources(sized: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """A stored row a source: source, src (its number in code point order, null last), s, n, target, base, p, rest."""
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("c")).alias("s"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("units"))
    ordered = stage(totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    # numbers in order: a task's rows are numbered from the sum of the tasks before it
    task = F.shiftright("at", 33)
    before, offset = 0, []
    for r in sorted(ordered.groupBy(task.alias("task")).count().collect()):
        offset += [F.lit(r["task"]).cast("bigint"), F.lit(before).cast("bigint")]
        before += r["count"]
    number = (F.element_at(F.create_map(*offset), task) if offset else F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("src"), F.lit(len(weights))) + 1).cast("int"))
    out = ordered.withColumn("src", number.cast("bigint")).withColumn("w", weigh.cast("bigint"))
    words = out.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    level = water_level(out, share * words, most)
    wide = "decimal(38,0)"
    num, den = (F.lit(str(x)).cast(wide) for x in (level.numerator, level.denominator))
    due, own = num * F.col("w").cast(wide), den * F.col("s").cast(wide)
    full = due > own * most
    target = F.lit(0.0)
    for w in sorted(set(weights)):
        target = F.when(F.col("w") == w, F.lit(float(level * w))).otherwise(target)
    base = F.when(F.col("s") == 0, F.lit(0)).when(full, F.lit(most)).otherwise(F.floor(due.cast("double") / own.cast("double")))
    base = base.cast("bigint")
    out = out.withColumn("target", F.when(F.col("s") == 0, F.lit(0.0)).when(full, (F.col("s") * most).cast("double")).otherwise(target)).withColumn("base", base)
    # what the base copies leave, in words; a quotient that rounding lifted to a whole number leaves nothing
    rest = F.greatest(F.col("target") - F.col("base") * F.col("s"), F.lit(0.0))
    p = F.when((F.col("s") == 0) | full, F.lit(0.0)).otherwise(F.least(rest / F.greatest("s", F.lit(1)), F.lit(1.0)))
    return stage(out.select("source", "src", "s", "n", "units", "target", "base", p.alias("p"), rest.alias("rest")), "shares")


def draw_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    share: Fraction = Fraction(3, 2),
    most: int = 2,
    seed: int = 7,
) -> DataFrame:
    """A stored row per distinct (id, row_hash, source): these, size, alike, total, source_size, target.

    alike rows of the table are equal in id, text and source, and take `total` copies
    together. See cube_mix.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_hash"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = stage(rows.groupBy("id", "row_hash", "source", "size").agg(F.count(F.lit(1)).alias("c")), "sizes")
    shares = _sources(sized, weights, share, most)
    tag = F.xxhash64("source")
    n_units, n_most = shares.agg(F.coalesce(F.sum("units"), F.lit(0)), F.coalesce(F.max("units"), F.lit(0))).first()
    # a null source joins by its tag and so does any other; src tells sources of one tag apart
    keyed = shares.select(tag.alias("tag"), F.col("source").alias("its"), "src", "units", "target", "base", "p", F.col("s").alias("source_size"))
    per_tag = keyed.groupBy("tag").agg(F.collect_list(F.struct("its", "src", "target", "base", "p", "source_size", "units")).alias("all"), F.sum("units").alias("units"))
    known = keyed_join(sized.withColumn("tag", tag), per_tag, ["tag"], "units", n_units)
    known = known.withColumn("of", F.filter("all", lambda x: x["its"].eqNullSafe(F.col("source")))[0]).drop("all", "units", "tag")
    # of c equal rows floor(c * p) are taken for certain; one unit holds what is left of c * p
    sure = F.floor(F.col("c") * F.col("of.p")).cast("bigint")
    parts = F.col("of.units") / BLOCK
    draw = known.select(
        "id", "row_hash", "source", "size", "c", "of.src", "of.target", "of.source_size",
        (F.col("of.base") * F.col("c") + sure).alias("taken"), (F.col("c") * F.col("of.p") - sure).alias("p"), F.greatest(F.ceil(parts), F.lit(1)).cast("bigint").alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64("id", "row_hash", "source"), F.col("blocks")))
    draw = draw.withColumn("first_block", F.col("block"))
    names, shape = draw.columns, draw.schema

    def run_level(level: int):
        salt = seed * 1000 + level

        def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "id", "row_hash"], ascending=[False, True, True], kind="stable")
            p = flight(pdf["size"].to_numpy(np.int64), pdf["p"].to_numpy(np.float64), abs(hash((salt, int(key[0]), int(key[1])))), int(pdf["blocks"].iloc[0]) == 1)
            return pdf.assign(p=p)[names]

        return one

    done, level, n = None, 0, max(1, -(-n_most // BLOCK))
    while True:
        out = stage(draw.groupBy("src", "block").applyInPandas(run_level(level), shape), f"flight{level}")
        sure = out.filter("p = 0 or p = 1")
        done = sure if done is None else done.unionByName(sure)
        if n == 1:
            break
        n, level = max(1, -(-2 * n // BLOCK)), level + 1
        draw = out.filter("p > 0 and p < 1").withColumn("blocks", F.greatest(F.ceil(2 * F.col("blocks") / BLOCK), F.lit(1)).cast("bigint"))
        draw = draw.withColumn("block", F.pmod(F.xxhash64("id", "row_hash", "source", F.lit(level)), F.col("blocks")))
    done = done.withColumn("total", F.col("taken") + F.col("p").cast("bigint"))

    # what landing leaves is made up for by swaps in each source's first block
    miss = done.groupBy("src").agg((F.max("target") - F.sum(F.col("size") * F.col("total"))).alias("miss"), F.count_if(F.col("first_block") == 0).alias("units"))
    some = keyed_join(done.filter("first_block = 0"), miss, ["src"], "units", n_units)
    final = "id bigint, row_hash bigint, source string, size bigint, c bigint, total bigint, source_size bigint, target double"
    cols = [x.split()[0] for x in final.split(", ")]

    def repair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "row_hash"], kind="stable")
        p = pdf["p"].to_numpy(np.float64)
        free = ((pdf["total"] - p < most * pdf["c"])).to_numpy()
        new = settle(pdf["size"].to_numpy(np.int64), p, float(pdf["miss"].iloc[0]), free)
        return pdf.assign(total=pdf["total"] + (new - p).astype(np.int64))[cols]

    free = some.groupBy("src").applyInPandas(repair, final)
    return stage(done.filter("first_block > 0").select(cols).unionByName(free), "units").withColumnRenamed("c", "alike")


def cube_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, row_hash, size, source_size, target, copies, taken for every row.

    Size: words of the text (null: 0). Sources in code point order, null last, weigh
    `weights` in turn and share `share` of all words, none above `most` times its own;
    the excess is shared again. A source with ratio r = target / size takes every
    document floor(r) times, and once more those that balanced sampling with probability
    r - floor(r) picks, so that words and documents of each source come near r times
    its totals; a document without words is drawn like any other. A source without words
    takes nothing. Rows equal in id, text and source are drawn as one unit and share its
    copies as evenly as they can; row_hash (of the text) tells rows of one id apart.
    Options are those of draw_units.

    Scale: texts are read once; ids and sizes are staged. Nothing that grows with the
    sources or documents comes to the driver. Flights run on hash blocks of about BLOCK
    units of one source, so a hot source is many blocks; each leaves two at most, and
    levels of blocks repeat until one block per source lands. Last, swaps of documents
    in one block of a source make up for the words that landing missed. Blocks
    depend on ids and totals alone and each has its own seed, so reruns agree.
    """
    units = draw_units(docs, id_col, **options)
    each = numbered_copies(units, "alike", "k", RUN)
    copies = F.floor(F.col("total") / F.col("alike")) + (F.col("k") <= F.pmod("total", F.col("alike"))).cast("bigint")
    out = each.withColumn("copies", copies.cast("bigint"))
    return out.select(F.col("id").alias(id_col), "row_hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", broadcast_rows: int = 300_000, **options) -> DataFrame:
    """The rows of docs, each as often as cube_mix takes it; docs has to be a stored table.

    Units are broadcast up to broadcast_rows; beyond that rows meet them by a shuffle.
    The rows of a unit of several are numbered in runs of RUN rows as they are stored.
    Columns may have any names.
    """
    units = draw_units(docs, id_col, source_col, text_col, **options).filter("total > 0")
    names = {c: fresh(docs, f"mix_{c}") for c in ("id", "row_hash", "source", "alike", "total", "own", "at", "run", "before", "times", "copy")}
    u = units.select(*[F.col(c).alias(names[c]) for c in ("id", "row_hash", "source", "alike", "total")])
    own, at, run, before, times, copy = (names[c] for c in ("own", "at", "run", "before", "times", "copy"))
    alike, total = F.col(names["alike"]), F.col(names["total"])
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    key = F.col(id_col).eqNullSafe(F.col(names["id"])) & (F.col(own) == F.col(names["row_hash"])) & F.col(source_col).cast("string").eqNullSafe(F.col(names["source"]))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    out = rows.join(small(u.filter(alike == 1)), key).withColumn(times, total)
    several = u.filter(alike > 1)
    if several.limit(1).count():
        some = rows.withColumn(at, F.monotonically_increasing_id()).join(small(several), key)
        unit = [names[c] for c in ("id", "row_hash", "source")]
        some = some.withColumn(run, F.floor(F.col(at) / RUN))
        inside = F.row_number().over(Window.partitionBy(*unit, run).orderBy(at))
        counts = some.groupBy(*unit, run).agg(F.count(F.lit(1)).alias(before))
        upto = F.sum(before).over(Window.partitionBy(*unit).orderBy(run)) - F.col(before)
        counts = stage(counts.select(*unit, run, upto.alias(before)), "runs")
        other = [fresh(some, f"{c}_of") for c in (*unit, run)]
        counts = counts.toDF(*other, before)
        same = F.col(run) == F.col(other[-1])
        for a, b in zip(unit, other):
            same &= F.col(a).eqNullSafe(F.col(b))
        some = some.withColumn(copy, inside).join(small(counts), same)
        number = F.col(copy) + F.col(before)
        some = some.withColumn(times, F.floor(total / alike) + (number <= F.pmod(total, alike)).cast("bigint"))
        out = out.select(*docs.columns, times).unionByName(some.select(*docs.columns, times))
    out = out.filter(F.col(times) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(docs.columns)
