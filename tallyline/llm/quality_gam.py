"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees fills a lookup table per feature and per chosen pair;
a score is the sum of one bin of each table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import crc_fold, small_batches
from ._text import _C1, SPACE, lines, mix, per_row, raw, repeated, seen_before, slices, span_hash, windows, words

#: Largest expected number of labelled rows that the model is fitted on, taken by a hash of the id.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 120, 60, 0.15, 12
THRESHOLD = 0.7

FEATURES = (
    "log_words", "word_chars", "upper", "symbols", "digits", "bangs", "bars", "punct", "non_ascii", "short_words", "long_words",
    "line_words", "dup_lines", "repeat8", "repeat3", "distinct", "same_next", "symbol_ends", "stops", "newlines", "max_line", "half_upper", "half_symbols", "half_repeat",
)


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UP, _SYM, _DIG, _PUN = _lut(bytes(range(65, 91))), _lut(b"#*$%&|<>^~=+_{}\\"), _lut(b"0123456789"), _lut(b".,;:?'\"()-")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rates over each whole text, (rows, len(FEATURES)); an empty text is all zeros."""
    n = len(off) - 1
    s, e, who = words(data, off)
    h = span_hash(data, s, e)
    row_mix = mix(np.arange(n, dtype=np.uint64) * _C1 + np.uint64(3))
    nw = np.bincount(who, minlength=n).astype(float)
    size = np.diff(off).astype(float)
    inside = ~SPACE[data]
    lead = inside & ((data & 0xC0) != 0x80)
    chars = per_row(lead, off).astype(float)

    def rate(x, y):
        return np.asarray(x, float) / np.maximum(y, 1)

    wl = e - s
    own = row_mix[who]
    key = h ^ own
    ls, le, lwho = lines(data, off)
    c = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=c[1:])
    filled = np.flatnonzero(c[le] > c[ls])
    nl = np.bincount(lwho[filled], minlength=n).astype(float)
    dup = np.bincount(lwho[filled][seen_before(span_hash(data, ls[filled], le[filled]) ^ row_mix[lwho[filled]])], minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, lwho, (le - ls).astype(float))
    w8, a8 = windows(h, who, 8)
    w3, a3 = windows(h, who, 3)
    r3 = repeated(w3 ^ row_mix[who[a3]])
    rep8 = np.bincount(who[a8][repeated(w8 ^ row_mix[who[a8]])], minlength=n)
    rep3 = np.bincount(who[a3][r3], minlength=n)
    distinct = n_first = np.bincount(who[~seen_before(key)], minlength=n)
    same = np.flatnonzero(key[1:] == key[:-1])
    sym_end = _SYM[data[e - 1]] | (data[e - 1] == 33) if len(e) else np.zeros(0, bool)
    # halves show texts that are bad only in part
    first_word = np.searchsorted(who, np.arange(n))
    half = np.arange(len(who)) - first_word[who] >= (nw[who] / 2)
    up_word, sym_word = _UP[data[s]] & _UP[data[np.maximum(e - 1, s)]] & (wl > 1) if len(s) else half, sym_end

    def by_half(mask, at=None):
        at = np.arange(len(who)) if at is None else at
        a = np.bincount(who[at][mask & half[at]], minlength=n)
        b = np.bincount(who[at][mask & ~half[at]], minlength=n)
        return rate(np.maximum(a, b), nw / 2)

    x = np.stack([
        np.log1p(nw), rate(chars, nw), rate(per_row(_UP[data], off), chars), rate(per_row(_SYM[data], off), nw), rate(per_row(_DIG[data], off), chars),
        rate(per_row(data == 33, off), nw), rate(per_row(data == 124, off), nw), rate(per_row(_PUN[data], off), nw), rate(per_row((data & 0xC0) == 0xC0, off), chars),
        rate(np.bincount(who[wl <= 3], minlength=n), nw), rate(np.bincount(who[wl >= 14], minlength=n), nw), rate(nw, nl), rate(dup, nl), rate(rep8, nw), rate(rep3, nw),
        rate(distinct, nw) * np.minimum(np.log1p(nw), 6), rate(np.bincount(who[same], minlength=n), nw), rate(np.bincount(who[sym_end], minlength=n), nw),
        rate(nw - n_first, np.sqrt(nw + 1)), rate(per_row(data == 10, off), nw), rate(longest, size), by_half(up_word), by_half(sym_word), by_half(r3, a3),
    ], axis=1)
    x[nw == 0] = 0
    return x


# ---- the model ------------------------------------------------------------------


@dataclass
class Gam:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]
    base: float


def _leaf(g: float, h: float) -> float:
    return -g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, int]:
    """Best split of a histogram: (gain, bins to the left)."""
    gl, hl, cl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(c)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain = np.where((cl >= LEAST) & (c.sum() - cl >= LEAST), gain, -1)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, c: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Step of each bin by a tree of few leaves over one feature's histogram."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_cut(g[a:b], h[a:b], c[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if gain <= 1e-6:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """Best step of a depth-2 tree on a pair: one cut of the first feature, one of the second on each side."""
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, len(g)):
        total, step = -_gain(g.sum(), h.sum()), np.zeros_like(g)
        for side in (slice(0, i), slice(i, None)):
            gs, hs, cs = g[side].sum(0), h[side].sum(0), c[side].sum(0)
            gain, at = _cut(gs, hs, cs)
            spans = [(0, at), (at, len(gs))] if gain > 0 else [(0, len(gs))]
            for a, b in spans:
                total += _gain(gs[a:b].sum(), hs[a:b].sum())
                step[side, a:b] = _leaf(gs[a:b].sum(), hs[a:b].sum())
        if total > best:
            best, out = total, step
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit by cyclic boosting; deterministic. One class alone, or no row, gives a constant."""
    n, k = x.shape
    mean = float((y.sum() + 0.5) / (n + 1))
    base = float(np.log(mean / (1 - mean)))
    if n < 2 * LEAST or y.min() == y.max():
        return Gam([np.zeros(0)] * k, [np.zeros(1)] * k, [], [np.zeros(0)] * k, [], base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    bins = [np.searchsorted(edges[j], x[:, j], "right") for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    f = np.full(n, base)

    def slope():
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = slope()
            m = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, m), np.bincount(bins[j], h, m), np.bincount(bins[j], minlength=m))
            tables[j] += step
            f += step[bins[j]]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(k)]
    small = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(k)]

    def grids(i, j, g, h):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = small[i] * shape[1] + small[j]
        return at, shape, [np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, np.ones(n))]

    g, h = slope()
    gains = sorted(((_quadrants(*grids(i, j, g, h)[2])[0], i, j) for i, j in itertools.combinations(range(k), 2)), reverse=True)
    pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in enumerate(pairs):
            g, h = slope()
            at, _, hist = grids(i, j, g, h)
            step = RATE * _quadrants(*hist)[1]
            pair_tables[t] += step
            f += step.ravel()[at]
    return Gam(edges, tables, pairs, coarse, pair_tables, base)


def predict(model: Gam, x: np.ndarray) -> np.ndarray:
    """Probability of quality 1: additions of bins, one lookup a table."""
    f = np.full(len(x), model.base)
    for j, (e, t) in enumerate(zip(model.edges, model.tables)):
        f += t[np.searchsorted(e, x[:, j], "right")]
    for (i, j), t in zip(model.pairs, model.pair_tables):
        f += t[np.searchsorted(model.pair_edges[i], x[:, i], "right"), np.searchsorted(model.pair_edges[j], x[:, j], "right")]
    return 1 / (1 + np.exp(-f))


# ---- over tables ------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Gam:
    """Fit on the labelled rows outside the held-out fold (crc32 of the id, mod 4, is 2).

    About max_train labels at most, by a hash of the id, are broadcast to the documents;
    their features, never texts, come to the driver. Repeated documents or labels of an
    id count as often as they pair; of more than twice max_train rows the first by a hash
    stay, so reruns agree. Null labels and ids teach nothing, a null text counts as empty,
    and without labels the model is a constant.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_fold(id_col) != 2))
    n = known.count()
    if n > max_train:
        known = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * (max_train / n)))
    known = known.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id", "y").limit(2 * max_train)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("text", "y", F.xxhash64("id", "text").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(*raw(part.column("text")))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("y"), part.column("k"), flat], ["y", "k", "x"])

    got = src.mapInArrow(run, "y int, k bigint, x array<double>").orderBy("k", "y").limit(2 * max_train).toArrow()
    x = got.column("x").combine_chunks()
    x = (x.flatten() if isinstance(x, pa.ListArray) else pa.chunked_array(x).combine_chunks().flatten()).to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same whatever order tasks end in
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, score and predicted of every row, from its whole text.

    No shuffle. A null text scores as an empty one, a null id stays null, repeated rows
    have a row each, and equal texts have equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = predict(model, features(*raw(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id bigint, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model accepts, all columns (of any name) unchanged.

    A null text is judged as an empty one; equal texts, repeated rows too, fare alike.
    """
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                p = predict(model, features(*raw(part.column(text_col))))
                yield part.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, schema)
