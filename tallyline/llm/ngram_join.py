"""Jaccard self-join of word n-gram sets with count-vector R-trees.

Shingles are hashed into groups. A set's group counts are a point; the overlap of two
sets is at most the sum of the smaller count of each group, so boxes of points (an
R-tree) prune, and what survives is verified on the sets. Boxes alone do not tell
unrelated texts apart (in many dimensions every box meets every query), so the trees
stand inside candidate clusters, found by the same grouping: sets that differ in at most
e shingles, hashed into more than e groups, hold some group in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._spark import free_shuffles, keyed_join, shuffle_partitions, small_batches, stage, unstage, with_might_hold
from ._text import _C1, _C2, LOWER, mix, raw, slices, span_hash, windows, words
from .components import components

#: Dimensions of a count vector; children of a tree node.
DIMS, FANOUT = 128, 16
#: Sets, and shingles of sets (32 MB), joined at once; leaders that tie the blocks of a larger cluster together.
BLOCK, BLOCK_SHINGLES, LEADERS = 2000, 4 << 20, 32
#: Share of the distinct sets from which on a shingle is left out of signatures (never of sets).
FREQUENT = 0.001
#: Sets of a run of equal signatures up to which all pairs are counted; what a pair of a longer run counts for.
RUN, ENOUGH = 8, 1 << 20
#: What a set asks for at most once the signatures that chance makes equal are left out.
STILL = 4
#: Of the signatures that more than RUN sets hold, how many are left out, the most common first; bits of the bitmap that names them (16 MB).
HOT_MOST, HOT_BITS = 1 << 24, 1 << 27
#: Signatures that a task holds before it sends them, and shingles that it holds to count.
HELD, COUNTED = 500_000, 1_500_000
#: Largest number of rows (ids and hashes) that is broadcast.
BROADCAST_ROWS = 300_000


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within rows, and where each row's begin.

    A-Z are lower-cased. A row with fewer than k words has its whole sequence as its one
    shingle; a row without words has none.
    """
    n = len(off) - 1
    low = LOWER[data]
    s, e, who = words(low, off)
    h = span_hash(low, s, e)
    sh, at = windows(h, who, k)
    row = who[at]
    count = np.bincount(who, minlength=n)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(who, few)
        extra = np.zeros(len(few), np.uint64)
        for i, (f, c) in enumerate(zip(first.tolist(), count[few].tolist())):
            x = np.uint64(c)
            for j in range(f, f + c):
                x = mix(np.array([(x ^ h[j])], np.uint64) * _C1 + np.uint64(j - f + 1))[0]
            extra[i] = x
        sh, row = np.concatenate([sh, extra]), np.concatenate([row, few])
    o = np.lexsort((sh, row))
    sh, row = sh[o], row[o]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    sh, row = sh[new], row[new]
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n), out=begin[1:])
    return sh, begin


def _sums(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=c[1:])
    return c[begin[1:]] - c[begin[:-1]]


def set_keys(sh: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    n = np.diff(begin).astype(np.uint64)
    return mix(_sums(mix(sh + _C1), begin) + n), mix(_sums(mix(sh * _C1 + _C2), begin) ^ (n * _C2))


# ---- signatures -------------------------------------------------------------------


def size_levels(num: int, den: int, most: int) -> np.ndarray:
    """Bounds of size classes: two linked sets are of one class or of neighbouring ones."""
    out = [1, 2]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * den // num + 1))
    return np.array(out, np.int64)


def _level_groups(bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Per level: the most shingles in which a linked pair differs, and the groups used.

    There are enough groups beyond the difference that a set hardly ever fills so few of
    them that it has to sign by its empty groups.
    """
    far = (bounds[1:] - 1) * (den - num) // num
    spare = np.where(far > 0, np.ceil(0.15 * far + 5), 0).astype(np.int64)
    return far, far + 1 + spare


def _contents(sh: np.ndarray, row: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of d[r] groups of each row: a hash of the content, and how many shingles it has."""
    base, total = np.cumsum(d) - d, int(d.sum())
    m = d[row] > 0
    sh, row = sh[m], row[m]
    slot = base[row] + ((sh * _C1 >> np.uint64(32)) * d[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    content = mix(sh ^ _C2)
    lo = np.bincount(slot, (content & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
    hi = np.bincount(slot, (content >> np.uint64(32)).astype(float), total).astype(np.uint64)
    return lo ^ mix(hi + _C1), np.bincount(slot, minlength=total)


def _is_hot(sig: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the bit of each signature."""
    at = sig & np.uint64(8 * len(hot) - 1)
    return (hot[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def signatures(sh: np.ndarray, begin: np.ndarray, num: int, den: int, frequent: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, terms): linked sets that differ share as many as their terms say.

    A set of class c signs at levels c and c - 1; level l holds the pairs whose smaller
    set is of class l. A signature is the content of one group without frequent
    shingles (leaving the same shingles out of both sets adds no difference). Of d
    groups, linked sets agree in d - far at least, so in d - far - (empty groups of
    either) that are not empty: what a set asks of a partner. A set that would ask for
    none consists of frequent shingles for the most part; it asks for nothing there, and
    signs by the whole content of its groups too, which meets other such sets alone.
    Only if even so it asks for none, it signs by its empty groups as well. Terms hold
    what is asked for (63 at most), whole content or not, and the level's last bit.

    hot is a bitmap of signatures that many sets hold; like empty groups they are no sign,
    whole contents aside, and are taken off what is asked for. A set that then asks for t
    leaves out t - r of its signatures and asks for r, t / 4 and STILL at most: all sets
    leave out by one order, few shingles first, which chance makes equal most often, and
    of t signatures that two sets share, r at least are left in both.
    """
    n = np.diff(begin)
    row = np.repeat(np.arange(len(n)), n)
    bounds = size_levels(num, den, int(n.max(initial=1)) + 1)
    far, groups = _level_groups(bounds, num, den)
    rare = np.ones(len(sh), bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, sh), len(frequent) - 1)] != sh
    cls = np.searchsorted(bounds, n, "right") - 1
    sigs, rows, terms = [], [], []
    for down in (0, 1):
        level = cls - down
        lv = np.maximum(level, 0)
        d = np.where((n > 0) & (level >= 0) & (far[lv] > 0), groups[lv], 0)
        for whole in (0, 1):
            own = np.repeat(np.arange(len(n)), d)
            group = np.arange(len(own)) - np.repeat(np.cumsum(d) - d, d)
            content, held = _contents(sh, row, d) if whole else _contents(sh[rare], row[rare], d)
            sig = mix(content ^ mix(lv[own].astype(np.uint64) * _C2 + group.astype(np.uint64) * _C1 + np.uint64(7 + whole)))
            void = held == 0
            if hot is not None and not whole:
                void |= _is_hot(sig, hot)
            asked = d - far[lv] - np.bincount(own[void], minlength=len(n))
            use = ~void | (asked < 1)[own] if whole else ~void
            sig, own, held = sig[use], own[use], held[use]
            if hot is not None:
                less = np.maximum(asked - np.minimum(-(-asked // 4), STILL), 0)
                o = np.lexsort((sig, held, own))
                first = np.searchsorted(own, np.arange(len(n)))
                o = o[np.arange(len(o)) - first[own] >= less[own]]
                sig, own, asked = sig[o], own[o], asked - less
            sigs.append(sig)
            rows.append(own)
            terms.append((np.clip(asked, whole, 63) * 4 + whole * 2 + (lv & 1)).astype(np.uint8)[own])
            d = np.where(asked < 1, d, 0)
    return np.concatenate(sigs), np.concatenate(rows), np.concatenate(terms)


def _pairs_of_runs(sig: np.ndarray, ref: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, kind, shared, asked) of the sets that meet in runs of equal signatures.

    In a run of RUN sets at most each meets each; in a longer one the smallest meets
    every other, and such a pair counts as sharing enough, since it stands for others.
    """
    o = np.lexsort((ref, sig))
    sig, ref, terms = sig[o], ref[o], terms[o]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (ref[1:] != ref[:-1])
    sig, ref, terms = sig[new], ref[new], terms[new]
    start = np.ones(len(sig), bool)
    start[1:] = sig[1:] != sig[:-1]
    run = np.cumsum(start) - 1
    size = np.bincount(run)[run] if len(run) else run
    first = np.flatnonzero(start)[run] if len(run) else run
    long = np.flatnonzero((size > RUN) & ~start)
    left, right = [first[long]], [long]
    for j in range(1, RUN):
        at = np.flatnonzero((size[:-j] <= RUN) & (run[:-j] == run[j:])) if len(run) > j else np.zeros(0, np.int64)
        left.append(at)
        right.append(at + j)
    x, y = np.concatenate(left), np.concatenate(right)
    a, b, kind, asked = ref[x], ref[y], terms[x] & 3, np.maximum(terms[x], terms[y]) >> 2
    enough = np.arange(len(x)) < len(long)
    m = enough | (asked > 0)  # two sets that ask for nothing meet by whole content
    a, b, kind, asked, shared = a[m], b[m], kind[m], asked[m].astype(np.int64), np.where(enough[m], ENOUGH, 1)
    if not len(a):
        return a, b, kind, shared, asked
    o = np.lexsort((kind, b, a))
    a, b, kind, asked, shared = a[o], b[o], kind[o], asked[o], shared[o]
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])))
    return a[cut], b[cut], kind[cut], np.add.reduceat(shared, cut), np.maximum.reduceat(asked, cut)


# ---- the R-tree join of one task ------------------------------------------------------


class Forest:
    """Components of a task's sets; only links that join two of them are kept."""

    def __init__(self, label: np.ndarray):
        self.label, self.links = label.copy(), []

    def union(self, a: int, b: int) -> None:
        self.links.append((a, b))
        x, y = self.label[a], self.label[b]
        self.label[self.label == max(x, y)] = min(x, y)


def _counts(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), DIMS), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s >> np.uint64(5)).astype(np.int64) & (DIMS - 1), minlength=DIMS)
    return out


def _build(points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Order of the points and, from the leaves up, (largest counts, least size, largest size) of the nodes."""
    spread = points.std(0).argsort()[::-1][:2] if len(points) else [0, 1]
    order = np.lexsort((points[:, spread[1]], points[:, spread[0]], size))
    box, lo, hi = points[order], size[order], size[order]
    levels = []
    while len(box) > 1 or not levels:
        cut = np.arange(0, len(box), FANOUT)
        box, lo, hi = np.maximum.reduceat(box, cut, 0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
        levels.append((box, lo, hi))
    return order, levels


def tree_join(sets: list[np.ndarray], label: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join components: all pairs linked directly end up in one component.

    sets are sorted unique hashes; label numbers the components known so far. With side,
    only pairs of different sides are looked at (the others are known). A query leaves
    out what is in its own component already, so a dense group costs one link a set.
    """
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    forest = Forest(label)
    points = _counts(sets)
    order, levels = _build(points, size)
    sorted_points, sorted_size = points[order], size[order]

    for pos in range(n):
        q = int(order[pos])
        p, s = points[q], size[q]
        nodes = np.zeros(1, np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            box, lo, hi = levels[depth]
            nodes = nodes[nodes < len(box)]
            fits = (lo[nodes] * num <= s * den) & (s * num <= hi[nodes] * den)
            nodes = nodes[fits]
            cap = np.minimum(box[nodes], p).sum(1)
            nodes = nodes[cap * (num + den) >= num * (s + lo[nodes])]
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        at = nodes[(nodes < pos)]
        if not len(at):
            continue
        ids = order[at]
        m = (forest.label[ids] != forest.label[q]) & (sorted_size[at] * den >= num * s)
        if side is not None:
            m &= side[ids] != side[q]
        at, ids = at[m], ids[m]
        if not len(at):
            continue
        cap = np.minimum(sorted_points[at], p).sum(1)
        m = cap * (num + den) >= num * (s + sorted_size[at])
        ids, cap = ids[m], cap[m]
        for c in ids[np.argsort(-cap, kind="stable")].tolist():
            if forest.label[c] != forest.label[q] and _linked(sets[q], sets[c], num, den):
                forest.union(q, c)
    return forest.links


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


# ---- over tables ------------------------------------------------------------------------


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_a_shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id, n_shingles, component_id of every row.

    Two rows link when den * |A and B| >= num * |A or B| for their shingle sets.
    component_id is the smallest id reachable by links. Null, empty and blank texts have
    no shingles and link with nothing. Equal sets are one class from the start, found by
    a map-side aggregate. Rows of a null id link others but name no component.

    Scale: each pass reads every whole text once (sets and their keys; signatures, to find
    the common ones; signatures without these; the sets of candidates). Signatures travel
    packed, 7 and then 14 bytes each, about 2.2 * (den - num) / num of the shingles. What
    a pass shuffled goes before the next. Candidate clusters above BLOCK sets or
    BLOCK_SHINGLES shingles become blocks: each block is joined with itself and LEADERS
    common sets, and only blocks that still hold different components meet pairwise. The
    result does not depend on any of these numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    k = words_a_shingle
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())]))
        names = ["id", "th", "n", "c1", "c2", "often"]
        held, size, seen = [], 0, set()

        def often() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            m = c >= max(4, len(seen) * FREQUENT)
            found = [{"h": a, "c": b} for a, b in zip(h[m].view(np.int64).tolist(), c[m].tolist())]
            null = pa.nulls(1, pa.int64())
            return pa.RecordBatch.from_arrays([null, null, null, null, null, pa.array([found], pair)], names)

        for batch in batches:
            for part in slices(batch):
                sh, begin = shingle_sets(*raw(part.column("text")), k)
                c1, c2 = set_keys(sh, begin)
                one = np.array([c not in seen and not seen.add(c) for c in c1.tolist()], bool)
                held.append(sh[np.repeat(one, np.diff(begin))])
                size += len(held[-1])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.array(np.diff(begin)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.nulls(len(c1), pair)], names)
                if size >= COUNTED:
                    yield often()
                    held, size, seen = [], 0, set()
        if size:
            yield often()

    base = stage(src.mapInArrow(name, "id bigint, th bigint, n bigint, c1 bigint, c2 bigint, often array<struct<h: bigint, c: bigint>>"), "sets")
    texts = base.filter("often is null")
    # one row of each class stands for it, of an id if it can; sid numbers the classes for good, as they are stored
    row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("row")
    classes = texts.filter("n > 0").groupBy("c1", "c2", "n").agg(row, F.count(F.lit(1)).alias("rows"))
    classes = stage(classes.select("c1", "c2", "n", F.col("row.id").alias("rep"), F.col("row.th").alias("th"), "rows", F.monotonically_increasing_id().alias("sid")), "classes")
    n_classes = classes.count()
    often = base.filter("often is not null").select(F.explode("often").alias("o")).groupBy("o.h").agg(F.sum("o.c").alias("c"))
    often = often.filter(F.col("c") >= max(4, int(n_classes * FREQUENT))).orderBy(F.col("c").desc(), "h").limit(100_000).select("h").toPandas()["h"]
    frequent = np.sort(often.to_numpy(np.int64).view(np.uint64)) if len(often) else np.zeros(0, np.uint64)
    parts = 4 * shuffle_partitions(spark)

    def sign(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        held_s, held_r, held_t, size = [], [], [], 0

        def flush():
            sig, ref, terms = np.concatenate(held_s), np.concatenate(held_r), np.concatenate(held_t)
            part = (sig >> np.uint64(40)) % np.uint64(parts)
            o = np.argsort(part, kind="stable")
            part, sig, ref, terms = part[o].astype(np.int64), sig[o], ref[o], terms[o]
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(part))
            if hot is None:  # sets are only counted, by two bytes of their names
                ref, terms = ref.astype(np.uint16), terms[:0]
            blobs = [(sig[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), ref[a:b].tobytes(), terms[a:b].tobytes()) for a, b in zip(cut, ends)]
            columns = [pa.array(c, pa.binary()) for c in (zip(*blobs) if blobs else ([], [], []))]
            return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), *columns], ["part", "sig", "ref", "terms"])

        for batch in batches:
            for part in slices(batch):
                sh, begin = shingle_sets(*raw(part.column("text")), k)
                c1, _ = set_keys(sh, begin)
                _, one = np.unique(c1, return_index=True)
                if len(one) < len(c1):
                    keep = np.zeros(len(c1), bool)
                    keep[one] = True
                    n = np.diff(begin)
                    sh, c1 = sh[np.repeat(keep, n)], c1[keep]
                    begin = np.append(0, np.cumsum(n[keep]))
                sig, row, terms = signatures(sh, begin, num, den, frequent, hot)
                held_s.append(sig)
                held_r.append(c1[row])
                held_t.append(terms)
                size += len(sig)
                if size >= HELD:
                    yield flush()
                    held_s, held_r, held_t, size = [], [], [], 0
        if size:
            yield flush()

    def forty_bits(pdf: pd.DataFrame) -> np.ndarray:
        five = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, 5)
        sig = np.zeros((len(five), 8), np.uint8)
        sig[:, :5] = five
        return sig.view(np.uint64).ravel()

    def common(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.unique(forty_bits(pdf) << np.uint64(16) | np.frombuffer(b"".join(pdf["ref"]), np.uint16).astype(np.uint64))
        sig, m = np.unique(both >> np.uint64(16), return_counts=True)
        return pd.DataFrame({"sig": sig[m > RUN].view(np.int64), "m": m[m > RUN]})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ref = np.frombuffer(b"".join(pdf["ref"]), np.int64)
        terms = np.frombuffer(b"".join(pdf["terms"]), np.uint8)
        return pd.DataFrame(dict(zip(("a", "b", "kind", "shared", "asked"), _pairs_of_runs(forty_bits(pdf), ref, terms))))

    packed = "part int, sig binary, ref binary, terms binary"
    free_shuffles(spark)
    often_met = stage(src.mapInArrow(lambda batches: sign(batches, None), packed).groupBy("part").applyInPandas(common, "sig bigint, m bigint"), "hot")
    hot = _bitmap(often_met)
    free_shuffles(spark)
    met = src.mapInArrow(lambda batches: sign(batches, hot), packed).groupBy("part").applyInPandas(meet, "a bigint, b bigint, kind int, shared bigint, asked bigint")
    near = met.groupBy("a", "b", "kind").agg(F.sum("shared").alias("shared"), F.max("asked").alias("asked")).filter("shared >= asked").select("a", "b")
    near = stage(near, "near")
    free_shuffles(spark)
    groups = components(near)
    links, used = _verify(src, classes, groups, k, num, den)
    found = components(links)
    unstage(often_met, near, *used)
    free_shuffles(spark)
    linked = classes.join(found, classes["sid"] == found["node"]).select("sid", "rep", F.col("component").alias("comp"))
    linked = stage(linked, "linked")
    least = stage(linked.groupBy("comp").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("m")), "least")
    linked = keyed_join(linked, least, ["comp"], "m", linked.count()).select(F.col("sid").alias("node"), "component")
    named = classes.join(linked, classes["sid"] == linked["node"], "left").select("c1", "c2", F.col("rep"), F.coalesce("component", "rep").alias("component"), "rows")
    named = stage(named.filter("rows > 1 or not component <=> rep").drop("rep"), "named")
    n_rows = named.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    some = texts.select("id", "n", "c1", "c2")
    out = keyed_join(some.filter("n > 0"), named, ["c1", "c2"], "rows", n_rows).unionByName(some.filter("n = 0"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("id")).alias("component_id"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _bitmap(often: DataFrame) -> np.ndarray:
    """Bitmap, 16 bits a signature and HOT_BITS at most, of the HOT_MOST most common signatures of often (sig, m).

    Signatures of like m, up to a power of two, are in or out together.
    """
    counts = often.groupBy(F.floor(F.log2("m")).alias("l")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("l").desc()).collect()
    n, least = 0, 64
    for r in counts:
        if n + r["c"] > HOT_MOST:
            break
        n, least = n + r["c"], r["l"]
    bits = min(HOT_BITS, 1 << max(15, (16 * n).bit_length()))
    slot = F.pmod(F.col("sig"), F.lit(bits))
    rows = often.filter(F.floor(F.log2("m")) >= least).groupBy(F.floor(slot / 32768).alias("k")).agg(F.bitmap_construct_agg(slot % 32768).alias("b"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows.collect():
        out[r["k"]] = np.frombuffer(r["b"], np.uint8)
    return out.ravel()


def _blocks(sets: str, shingles: str) -> Column:
    """How many blocks of BLOCK sets and BLOCK_SHINGLES shingles hold so many."""
    return F.ceil(F.greatest(F.col(sets) / BLOCK, F.col(shingles) / BLOCK_SHINGLES, F.lit(1.0))).cast("int")


def _verify(src: DataFrame, classes: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between the sids of classes that connect every linked pair of a cluster, and the tables they are read from."""
    member = classes.join(groups, classes["c1"] == groups["node"]).select("sid", "rep", "th", "c1", "c2", "n", F.col("component").alias("cluster"))
    member = stage(member, "candidates")
    sizes = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).select("cluster", "m", "s", _blocks("m", "s").alias("blocks"))
    member = stage(keyed_join(member, sizes, ["cluster"], "m", member.count()).filter("m > 1"), "members")
    n, s = member.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = member.select("sid", F.col("rep"), F.col("th").alias("of"), "c1", "c2", "cluster", "m", "s", "blocks")
    if n <= BROADCAST_ROWS:
        texts = src.join(F.broadcast(wanted), (src["th"] == wanted["of"]) & src["id"].eqNullSafe(wanted["rep"]))
    else:  # only texts that may be wanted travel
        told = with_might_hold(src, F.col("th"), wanted.select("of"), n, "may").filter("may")
        texts = told.join(wanted, (told["th"] == wanted["of"]) & told["id"].eqNullSafe(wanted["rep"]))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sh, begin = shingle_sets(*raw(part.column("text")), k)
                c1, c2 = set_keys(sh, begin)
                same = (c1.view(np.int64) == part.column("c1").to_numpy()) & (c2.view(np.int64) == part.column("c2").to_numpy())
                blobs = pa.array([sh[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())
                named = ["sid", "cluster", "m", "s", "blocks"]
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in named), blobs], [*named, "hashes"])
                yield out.filter(pa.array(same))

    sets = texts.select("sid", "text", "c1", "c2", "cluster", "m", "s", "blocks").mapInArrow(sets_of, "sid bigint, cluster bigint, m bigint, s bigint, blocks int, hashes binary")
    sets = stage(sets.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("cluster", "m", "s", "blocks", "hashes")]), "hashes")
    free_shuffles(src.sparkSession)
    used = [member, sets]

    def unpack(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(b, np.uint64) for b in pdf["hashes"]]

    def edges(sids: np.ndarray, links: list[tuple[int, int]]) -> pd.DataFrame:
        ab = np.array(links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": sids[ab[:, 0]], "b": sids[ab[:, 1]]})

    def join_all(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.drop_duplicates(["cluster", "sid"]).sort_values(["cluster", "sid"], ignore_index=True)
        for _, one in pdf.groupby("cluster", sort=True):
            sids = one["sid"].to_numpy()
            out.append(edges(sids, tree_join(unpack(one), np.arange(len(one)), num, den)))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

    def join_two(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sid", "side"], ignore_index=True)
        sids, side = pdf["sid"].to_numpy(), pdf["side"].to_numpy()
        _, label = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        return edges(sids, tree_join(unpack(pdf), label, num, den, None if (side == side[0]).all() else side))

    ab = "a bigint, b bigint"
    # twice as many buckets as would do, since clusters fall into them by hash
    buckets = max(1, -(-2 * n // BLOCK), -(-2 * s // BLOCK_SHINGLES))
    small = sets.filter("blocks = 1").withColumn("bucket", F.pmod(F.xxhash64("cluster"), F.lit(buckets)))
    links = small.groupBy("bucket").applyInPandas(join_all, ab)
    large = sets.filter("blocks > 1")
    if not large.limit(1).count():
        return links, used

    # blocks of a large cluster, each with the same few leaders
    order = F.xxhash64("sid", F.lit(5))
    blocked = large.withColumn("blk", F.pmod(order, F.col("blocks")).cast("int"))
    heads = _leaders(large, order)
    heads = heads.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["sid", "cluster", "hashes", "blk"]
    first = stage(blocked.select(*cols).unionByName(heads.select(*cols)).groupBy("cluster", "blk").applyInPandas(join_all, ab), "links")
    links = links.unionByName(first)
    known = components(first)
    tagged = large.join(known, large["sid"] == known["node"], "left").select("sid", "cluster", "hashes", F.coalesce("component", "sid").alias("comp"))
    tagged = stage(tagged, "known")
    n_large = tagged.count()
    size = F.sum(F.length("hashes") / 8)
    comp_size = tagged.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("cm"), size.alias("cs")).withColumn("cb", _blocks("cm", "cs"))
    mixed = F.col("cb") == 1
    rest = comp_size.groupBy("cluster").agg(F.sum(F.when(mixed, F.col("cm"))).alias("mm"), F.sum(F.when(mixed, F.col("cs"))).alias("ms"), F.count(F.lit(1)).alias("comps"), F.sum("cm").alias("all"))
    rest = rest.select("cluster", "comps", "all", _blocks("mm", "ms").alias("mb"))
    tagged = keyed_join(keyed_join(tagged, comp_size, ["cluster", "comp"], "cm", n_large), rest, ["cluster"], "all", n_large).filter("comps > 1")
    number = F.when(mixed, F.pmod(F.xxhash64("comp"), F.col("mb"))).otherwise(F.pmod(order, F.col("cb")))
    tagged = stage(tagged.withColumn("own", F.when(~mixed, F.col("comp"))).withColumn("num", number).withColumn("blk", F.xxhash64("own", "num")), "tagged")
    blks = tagged.select("cluster", "own", "blk").distinct()
    other = blks.select("cluster", F.col("own").alias("own2"), F.col("blk").alias("blk2"))
    pairs = blks.join(other, "cluster").filter("blk <= blk2 and (own is null or own2 is null or own <> own2)").select("cluster", "blk", "blk2")
    left = tagged.join(pairs, ["cluster", "blk"]).select("cluster", "blk", "blk2", "sid", "comp", "hashes", F.lit(0).alias("side"))
    right = tagged.withColumnRenamed("blk", "blk2").join(pairs.filter("blk <> blk2"), ["cluster", "blk2"]).select("cluster", "blk", "blk2", "sid", "comp", "hashes", F.lit(1).alias("side"))
    used += [first, tagged]
    return links.unionByName(left.unionByName(right).groupBy("cluster", "blk", "blk2").applyInPandas(join_two, ab)), used


def _leaders(large: DataFrame, order) -> DataFrame:
    """The sets of each cluster with the smallest hash: LEADERS, or as many as a block holds if sets are long.

    A map-side aggregate keeps about 8 * LEADERS of a cluster.
    """
    top = F.sort_array(F.collect_list("o"))
    few = large.select("cluster", "m", "s", F.struct(F.pmod(order, F.lit(1 << 40)).alias("k"), "sid").alias("o"))
    few = few.filter(F.col("o.k") < (F.lit(8 * LEADERS) * float(1 << 40) / F.col("m")))
    many = F.greatest(F.least(F.floor(F.first("m") * BLOCK_SHINGLES / F.first("s")), F.lit(LEADERS)), F.lit(1)).cast("int")
    ids = few.groupBy("cluster").agg(F.slice(top, F.lit(1), many).alias("l"))
    ids = stage(ids.select(F.col("cluster").alias("its_cluster"), F.explode("l.sid").alias("its_sid")), "leaders")
    return large.join(_small(ids), (F.col("sid") == F.col("its_sid")) & (F.col("cluster") == F.col("its_cluster"))).drop("its_cluster", "its_sid")
