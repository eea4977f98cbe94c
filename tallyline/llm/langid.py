"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._spark import small_batches, stage
from ._text import _C1, mix, raw, slices

GRAMS = (3, 4)
#: Slots of the filter (a power of two), and hashes an n-gram.
SLOTS, HASHES = 1 << 20, 2
#: Expected largest number of training documents; they are taken by a hash of id and text.
MAX_TRAIN = 20_000
#: An n-gram belongs to a language if it makes up this share of its n-grams and occurs this often.
MIN_SHARE, MIN_COUNT = 1e-5, 3
UNKNOWN = "und"
#: 64-language words of the filter (8 MB each) that one pass over the texts looks at.
WORDS_A_PASS = 4


@dataclass
class Filter:
    """slots[w, i] has bit l set if an n-gram of language 64 w + l fell on slot i; rate[l] is a false positive's probability."""

    langs: list[str]
    slots: np.ndarray
    rate: np.ndarray


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _fold(arr: pa.Array, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of the rows, each between two blanks, other than letters blank; offsets; letters a row."""
    text = [" " + (t or "").lower() + " " for t in arr.to_pylist()]
    off = np.zeros(len(text) + 1, np.int64)
    np.cumsum([len(t) for t in text], out=off[1:])
    cp = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[cp]
    c = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(is_letter, out=c[1:])
    return np.where(is_letter, cp, np.uint32(32)), off, c[off[1:]] - c[off[:-1]]


def _grams(cp: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points from each position on; 21 bits a code point, mixed."""
    m = len(cp) - n + 1
    h = np.zeros(max(m, 0), np.uint64)
    for j in range(n):
        h = (h << np.uint64(16)) ^ (h >> np.uint64(48)) ^ (cp[j : j + m].astype(np.uint64) * _C1)
    return mix(h + np.uint64(n))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, id_col: str = "doc_id") -> Filter:
    """Learn the filter from about max_train whole texts with a language, taken by hash.

    N-grams are counted per task, then summed by a shuffle; those with MIN_SHARE of a
    language's n-grams stay, which bounds them by 1 / MIN_SHARE a language. They come to
    the driver for 64 languages at a time; there may be any number of languages. Rows
    with a null text or language teach nothing; repeated rows count as often as they
    stand, and all equal rows are taken or none.
    """
    small_batches(labelled.sparkSession)
    known = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("k"))
    n = labelled.filter(F.col(lang_col).isNotNull()).count()
    if n > max_train:
        known = known.filter(F.pmod("k", F.lit(1 << 30)) < int((1 << 30) * (max_train / n)))
    sample = known.select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _letters()
        for batch in batches:
            for part in slices(batch):
                names, which = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                cp, off, _ = _fold(part.column("text"), letter)
                rows = np.repeat(which, np.diff(off))
                out = ([], [], [])
                for n in GRAMS:
                    h = _grams(cp, n)
                    for k, name in enumerate(names):
                        g, c = np.unique(h[rows[: len(h)] == k], return_counts=True)
                        out[0].append(np.full(len(g), name, object))
                        out[1].append(g.view(np.int64))
                        out[2].append(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]), pa.string()), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]).astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stage(counts.filter(F.col("n") >= MIN_COUNT), "grams")
    totals = {r["lang"]: r["t"] for r in sample.groupBy("lang").agg(F.sum(F.length("text")).alias("t")).collect()}
    langs = sorted(totals)
    slots = np.zeros(((len(langs) + 63) // 64 or 1, SLOTS), np.uint64)
    for w in range(0, len(langs), 64):
        few = {lang: max(MIN_COUNT, int(totals[lang] * MIN_SHARE)) for lang in langs[w : w + 64]}
        enough = F.element_at(F.create_map(*[F.lit(x) for kv in few.items() for x in kv]), F.col("lang"))
        got = counts.filter(F.col("lang").isin(*few)).filter(F.col("n") >= enough).select("lang", "gram").toPandas()
        for lang, grams in got.groupby("lang")["gram"]:
            for at in _places(grams.to_numpy(np.int64).view(np.uint64)):
                np.bitwise_or.at(slots[w // 64], at, np.uint64(1 << (langs.index(lang) % 64)))
    filled = np.array([float(((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(langs))])
    return Filter(langs, slots, filled**HASHES)


def _places(h: np.ndarray) -> list[np.ndarray]:
    a, b = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) | 1
    return [(a + j * b) & (SLOTS - 1) for j in range(HASHES)]


def identify(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row, from its whole text.

    One filter lookup gives the mask of all languages that may hold an n-gram; popcounts
    per language, less the false positives expected, decide (ties: first in code point
    order). score is the winner's share of its own and the runner-up's count. Null
    texts, texts without a letter and an empty model give `und` and score 0. A null id
    stays null and a repeated row has its own output row. No shuffle; the filter is
    SLOTS words a task whatever the data's size. Of more than 64 * WORDS_A_PASS
    languages each further as many are one more pass over staged texts, so that a task
    never holds more of the filter; the result is the same.
    """
    small_batches(docs.sparkSession)
    state = "id bigint, text string, best string, top double, second double"
    out = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.lit(UNKNOWN).alias("best"), F.lit(-1.0).alias("top"), F.lit(0.0).alias("second"))
    for w in range(0, len(model.slots), WORDS_A_PASS):
        langs = slice(64 * w, 64 * (w + WORDS_A_PASS))
        last = w + WORDS_A_PASS >= len(model.slots)
        one = _pass(docs.sparkSession, model.langs[langs], model.slots[w : w + WORDS_A_PASS], model.rate[langs], last)
        out = out.mapInArrow(one, "id bigint, lang_pred string, score double" if last else state)
        out = out if last else stage(out, "languages")
    return out.withColumnRenamed("id", id_col)


def _pass(spark: SparkSession, langs: list[str], slots: np.ndarray, rate: np.ndarray, last: bool):
    """A function over batches of (id, text, best, top, second) that takes some languages into account."""
    # plain arrays: what a broadcast holds is pickled by reference, and workers may lack this package
    shared = spark.sparkContext.broadcast((langs, slots, rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, (langs, slots, rate) = _letters(), shared.value
        names = np.array([*langs, UNKNOWN], object)
        k = len(langs)
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                cp, off, n_letters = _fold(part.column("text"), letter)
                rows = len(off) - 1
                hits, total = np.zeros((k, rows)), np.zeros(rows)
                for n in GRAMS:
                    h = _grams(cp, n)
                    size = np.maximum(np.diff(off) - n + 1, 0)
                    # an n-gram that runs into the next row is not counted
                    ok = np.arange(len(h)) < np.repeat(off[1:] - n + 1, np.diff(off))[: len(h)]
                    total += size
                    at = _places(h)
                    for w in range(len(slots)):
                        mask = slots[w][at[0]]
                        for a in at[1:]:
                            mask = mask & slots[w][a]
                        mask = np.where(ok, mask, np.uint64(0))
                        for bit in range(min(64, k - 64 * w)):
                            c = np.zeros(len(cp) + 1, np.int64)
                            np.cumsum((mask >> np.uint64(bit)) & np.uint64(1), out=c[1 : len(h) + 1])
                            c[len(h) + 1 :] = c[len(h)]
                            hits[64 * w + bit] += c[off[1:]] - c[off[:-1]]
                best, top, second = (part.column(c).to_numpy(zero_copy_only=False) for c in ("best", "top", "second"))
                if k:
                    true = np.maximum((hits - total * rate[:, None]) / (1 - rate[:, None] + 1e-12), 0)
                    best = np.where(true.max(0) > top, names[true.argmax(0)], best)
                    order = np.sort(np.vstack([top, second, true]), axis=0)
                    top, second = order[-1], order[-2]
                if last:
                    known = (n_letters > 0) & (top >= 0)
                    score = np.where(known & (top > 0), top / np.maximum(top + second, 1e-12), 0.0)
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.where(known, best, UNKNOWN), pa.string()), pa.array(score)], ["id", "lang_pred", "score"])
                else:
                    cols = [pa.array(best, pa.string()), pa.array(top), pa.array(second)]
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), *cols], ["id", "text", "best", "top", "second"])

    return run
