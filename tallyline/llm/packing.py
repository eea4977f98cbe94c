"""Best-fit packing by linear grouping: plan a few configurations, then put in actual documents."""

from __future__ import annotations

import itertools
import json
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ._spark import small_batches, stage
from ._text import LOWER, raw, slices, span_hash, words

CAPACITY = 2048
#: Pieces of at most CAPACITY // SMALL tokens are small; the rest falls into GROUPS groups of equal number.
SMALL, GROUPS = 8, 96
#: Word parts whose ids a worker remembers, about 60 bytes each.
CACHE_WORDS = 500_000
#: Sequences, or small pieces, in one best-fit block; pieces of one length that are ranked together.
BLOCK, RANKED = 20_000, 1000


# ---- tokens -----------------------------------------------------------------

#: ASCII bytes that are neither letters, digits nor white space.
_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(97, 123)]] = True


#: What a tokenizer's file says if its ids are those of its words: the normalizer's steps, and how text is split.
#: Fixed values of the public tokenizer in word_bpe_49k.json.
_STEPS = ["NFC", "Replace \\s+", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_words(path: str) -> bool:
    """Whether a tokenizer encodes a text word by word, so that words can be cut, lower-cased and remembered."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    steps = [f"{x['type']} {x['pattern'].get('Regex')}" if x["type"] == "Replace" else x["type"] for x in (j["normalizer"] or {}).get("normalizers", [])]
    split, *more = (j["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    bytes_ = [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in more if x["type"] == "ByteLevel"]
    plain = split.get("type") == "Split" and split["pattern"].get("Regex") == _SPLIT and split["behavior"] == "Removed" and split["invert"]
    model = j["model"]["type"] == "BPE" and not any(j["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    special = all(a["content"].startswith("<|") and not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in j["added_tokens"])
    return steps == _STEPS and plain and len(more) == 1 and bytes_ == [("ByteLevel", False, False)] and model and special and not j["post_processor"]


class _Cache:
    """Ids of the word parts a worker has seen, by sorted 64-bit hash; entry 0 is the closing id 0."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.tok = path, Tokenizer.from_file(path)
        self.model = self.tok.model
        self.by_words = by_words(path)
        # the byte alphabet of byte-level BPE: printable Latin-1 stands for itself, the rest from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}
        self.clear()

    def clear(self) -> None:
        self.hash, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.zeros(1, np.uint32)

    def _ids_of(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of each part. Letters alone go straight to the merges; others through the whole tokenizer."""
        out, hard = [], []
        for p in parts:
            x = p.decode("utf-8", "replace")
            ids = None
            if x.isalpha() and (x.isascii() or max(x) < "\u0250" and unicodedata.is_normalized("NFC", x)):
                x = x if x.isascii() else x.lower()
                if x.isalpha():
                    if not x.isascii():
                        x = x.encode().decode("latin-1").translate(self.alphabet)
                    ids = [t.id for t in self.model.tokenize(x)] if x.islower() or not x.isascii() else None
            if ids is None:
                hard.append(len(out))
            out.append(ids)
        for a in range(0, len(hard), 4096):
            at = hard[a : a + 4096]
            for i, e in zip(at, self.tok.encode_batch([parts[i].decode("utf-8", "replace") for i in at], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def entries(self, h: np.ndarray, part_of) -> np.ndarray:
        """Entry of each hash (sorted, distinct); part_of(i) gives the bytes of an unseen one."""
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        new = np.flatnonzero(self.hash[at] != h) if len(self.hash) else np.arange(len(h))
        if len(new):
            ids = self._ids_of([part_of(i) for i in new.tolist()])
            size = np.array([len(x) for x in ids], np.int64)
            first = len(self.start)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.length = np.concatenate([self.length, size])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))])
            where = np.searchsorted(self.hash, h[new])
            self.hash = np.insert(self.hash, where, h[new])
            self.entry = np.insert(self.entry, where, np.arange(first, first + len(new)))
            at = np.searchsorted(self.hash, h)
        return self.entry[at] if len(h) else np.zeros(0, np.int64)


def _cache(path: str) -> _Cache:
    """The tokenizer and its cache, kept for the life of a worker."""
    kept = sys.modules.setdefault("_tallyline_tokens", types.ModuleType("_tallyline_tokens"))
    if getattr(kept, "path", None) != path:
        kept.cache, kept.path = _Cache(path), path
    if len(kept.cache.hash) > CACHE_WORDS:
        kept.cache.clear()
    return kept.cache


def _parts(low: np.ndarray, off: np.ndarray, whole: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the parts of words: a word, or its stem and the marks at its end.

    This tokenizer never joins white space, nor a letter or digit and a mark; a word is
    cut where its closing ASCII marks, sixteen at most, follow an ASCII letter or digit
    or a Latin-1 letter. Words with a byte position of `whole` are not cut.
    """
    s, e, who = words(low, off)
    cut = e.copy()
    todo = np.arange(len(s))
    for _ in range(17):
        todo = todo[(cut[todo] > s[todo])]
        todo = todo[_MARKS[low[cut[todo] - 1]]]
        if not len(todo):
            break
        cut[todo] -= 1
    cut[todo] = e[todo]
    last, before = low[np.maximum(cut - 1, 0)], low[np.maximum(cut - 2, 0)]
    latin = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (cut - 2 >= s)
    cut = np.where((cut > s) & (_WORDY[last] | latin), cut, e)
    for i in (np.searchsorted(s, whole, "right") - 1).tolist():
        cut[i] = e[i]
    tail = cut < e
    at = np.cumsum(tail) - tail + np.arange(len(s))
    n = len(s) + int(tail.sum())
    ps, pe, pw = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    ps[at], pe[at], pw[at] = s, cut, who
    ps[at[tail] + 1], pe[at[tail] + 1], pw[at[tail] + 1] = cut[tail], e[tail], who[tail]
    return ps, pe, pw


def _encode(path: str, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows one after another, and where each row's begin; each row ends with id 0.

    A text's ids are those of its word parts in order (A-Z lower-cased first, as the
    tokenizer does, but for words that may hold a special token). Tokenizers of another
    make get whole texts, a few at a time.
    """
    cache = _cache(path)
    if not cache.by_words:
        got = []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            got += [np.array(cache.tok.encode(data[a:b].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32), np.zeros(1, np.uint32)]
        begin = np.zeros(len(off), np.int64)
        np.cumsum([len(x) + 1 for x in got[::2]], out=begin[1:])
        return np.concatenate(got) if got else np.zeros(0, np.uint32), begin
    low = LOWER[data]
    text = data.tobytes()
    special = [m.start() for m in re.finditer(rb"<\|", text)]
    if special:
        s, e, _ = words(data, off)
        for i in (np.searchsorted(s, special, "right") - 1).tolist():
            low[s[i] : e[i]] = data[s[i] : e[i]]
    s, e, who = _parts(low, off, special)
    h = span_hash(low, s, e)
    distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
    text = low.tobytes()
    entry = cache.entries(distinct, lambda i: text[s[first[i]] : e[first[i]]])[back]
    rows = len(off) - 1
    upto = np.searchsorted(who, np.arange(rows), "right")
    entry = np.insert(entry, upto, 0)
    size = cache.length[entry]
    ends = np.cumsum(size)
    begin = np.zeros(rows + 1, np.int64)
    begin[1:] = ends[upto + np.arange(rows)]
    return cache.ids[np.repeat(cache.start[entry] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], begin


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """id, row_hash, piece, start, length, ids_crc32 (and ids) of every piece of every row.

    A text's tokens are its ids and an id 0 at the end; null is empty and gives id 0
    alone. Texts longer than `capacity` are cut into pieces of that many tokens, the
    last of which may be shorter; others are one piece.
    """
    small_batches(docs.sparkSession)
    schema = "id bigint, row_hash bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, begin = _encode(tokenizer_path, *raw(part.column("text")))
                n = np.diff(begin)
                k = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                a = begin[row] + start
                crc = [zlib.crc32(ids[x : x + y]) for x, y in zip(a.tolist(), length.tolist())]
                cols = [part.column("id").take(pa.array(row)), part.column("row_hash").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "row_hash", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(a, a[-1:] + length[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row_hash"), F.coalesce(text_col, F.lit("")).alias("text"))
    return src.mapInArrow(run, schema)


# ---- the plan, on the driver: its input is a histogram of at most `capacity` lengths ----


def _patterns_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Columns and amounts of a near-optimal fractional cover of demand, by column generation."""
    k = len(sizes)
    cols = [np.eye(k, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(k)]
    basis = np.array(cols, float).T
    x = np.linalg.solve(basis, demand.astype(float))
    deep = capacity // int(sizes.min())
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best = np.zeros(capacity + 1)
        took = []
        for _ in range(deep):  # one more item a step
            cand = np.full((k, capacity + 1), -1.0)
            for i, s in enumerate(sizes):
                if price[i] > 0:
                    cand[i, s:] = best[: capacity + 1 - s] + price[i]
            pick = cand.argmax(0)
            value = cand[pick, np.arange(capacity + 1)]
            better = value > best + 1e-12
            if not better.any():
                break
            took.append(np.where(better, pick, -1))
            best = np.where(better, value, best)
        if best[capacity] <= 1 + 1e-6:
            break
        new, c = np.zeros(k, np.int64), capacity
        for step in reversed(took):
            i = step[c]
            if i >= 0:
                new[i] += 1
                c -= sizes[i]
        d = np.linalg.solve(basis, new.astype(float))
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        leave = int(ratio.argmin())
        theta = ratio[leave]
        x = np.maximum(x - theta * d, 0)
        x[leave] = theta
        basis[:, leave] = new
        cols[leave] = new
    return np.array(cols), x


def plan_configurations(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, configs, times) for large lengths.

    Lengths in ascending order are cut into `groups` ranges of equal number, group g
    being ranks bounds[g] to bounds[g + 1], and rounded up to the largest of their group.
    configs[j][g] slots of group g make up configuration j, used times[j] times; all
    slots of a group together are at least its number.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return np.zeros(1, np.int64), np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    upto = np.cumsum([histogram[int(n)] for n in lengths])
    total = int(upto[-1])
    bounds = np.unique(np.round(np.linspace(0, total, min(groups, total) + 1)).astype(np.int64))
    top = lengths[np.searchsorted(upto, bounds[1:], "left")]
    # groups of one rounded length become one
    last = np.append(top[1:] != top[:-1], True)
    bounds, top = np.append(0, bounds[1:][last]), top[last]
    demand = np.diff(bounds)
    cols, x = _patterns_lp(top, demand, capacity)
    times = np.floor(x + 1e-9).astype(np.int64)
    left = np.maximum(demand - cols.T @ times, 0)
    more = []
    while left.any():  # at most a few bins a group
        one, room = np.zeros(len(top), np.int64), capacity
        for g in range(len(top) - 1, -1, -1):
            n = min(int(left[g]), room // int(top[g]))
            one[g], room = n, room - n * int(top[g])
        reps = max(1, int((left[one > 0] // one[one > 0]).min()))
        more.append((one, reps))
        left = np.maximum(left - one * reps, 0)
    configs = np.concatenate([cols, np.array([m[0] for m in more], np.int64).reshape(-1, len(top))])
    times = np.concatenate([times, np.array([m[1] for m in more], np.int64)])
    used = times > 0
    return bounds, configs[used], times[used]


def _slots(bounds, configs, times):
    """Per group: the first rank of each configuration's run, its slots a bin and first bin."""
    base = np.cumsum(times) - times
    out = []
    for g in range(len(bounds) - 1):
        j = np.flatnonzero(configs[:, g])
        n = configs[j, g] * times[j]
        out.append((np.cumsum(n) - n, configs[j, g], base[j]))
    return out


# ---- packing ------------------------------------------------------------------


def _best_fit(room: dict[int, list[int]], lengths: list[int], capacity: int, new_id) -> list[int]:
    """Bin of each length (descending): the fullest bin that still takes it, or a new one."""
    mask = 0
    for r, ids in room.items():
        if ids:
            mask |= 1 << r
    out = []
    for n in lengths:
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, new_id()
        out.append(b)
        if r - n:
            room.setdefault(r - n, []).append(b)
            mask |= 1 << (r - n)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset (columns id, row_hash, piece, start, length, ids_crc32).

    Full pieces are sequences by themselves. Large pieces are ranked by length; a rank
    gives the group, and the group's slots the configuration and the sequence. Small
    ones then go best-fit into what actual lengths leave free, in hash blocks of about
    BLOCK sequences, and into new sequences (negative numbers) after that. Only the
    histogram of lengths reaches the driver. A rank comes from counts of (length, hash
    block), so one common length is many groups. Ties go by id, row_hash and piece;
    reruns agree.
    """
    spark = pieces.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = capacity // SMALL
    bounds, configs, times = plan_configurations({n: c for n, c in hist.items() if small < n < capacity}, capacity)
    tables, n_planned = _slots(bounds, configs, times), int(times.sum())
    n_small = sum(c for n, c in hist.items() if n <= small)
    n_large = int(bounds[-1])
    key = F.xxhash64("id", "row_hash", "piece")

    # ranks: counts of (length, block) before, then a number inside
    spread = max(1, -(-max(hist.values(), default=1) // RANKED))
    parts = pieces.withColumn("blk", F.pmod(key, F.lit(spread)).cast("int"))
    large = parts.filter((F.col("length") > small) & (F.col("length") < capacity))
    before = large.groupBy("length", "blk").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("length").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    below, acc = [], 0
    for n in sorted(hist):
        if small < n < capacity:
            below += [F.lit(n), F.lit(acc)]
            acc += hist[n]
    first = F.element_at(F.create_map(*below), F.col("length").cast("int")) if below else F.lit(0)
    offs = stage(before.select("length", "blk", (F.coalesce(F.sum("n").over(run), F.lit(0)) + first).alias("lower")), "ranks")
    inside = Window.partitionBy("length", "blk").orderBy("id", "row_hash", "piece")
    ranked = large.withColumn("r", F.row_number().over(inside) - 1).join(offs, ["length", "blk"]).withColumn("rank", F.col("r") + F.col("lower"))

    @F.pandas_udf(T.LongType())
    def sequence_of(rank: pd.Series) -> pd.Series:
        r = rank.to_numpy(np.int64)
        g = np.searchsorted(bounds, r, "right") - 1
        out = np.empty(len(r), np.int64)
        for k in np.unique(g):
            m = g == k
            starts, per, base = tables[k]
            x = r[m] - bounds[k]
            j = np.searchsorted(starts, x, "right") - 1
            out[m] = base[j] + (x - starts[j]) // per[j]
        return pd.Series(out)

    cols = ["id", "row_hash", "piece", "start", "length", "ids_crc32"]
    placed = stage(ranked.select(*cols, sequence_of("rank").alias("sequence_id")), "placed")
    blocks = max(1, -(-n_planned // BLOCK), -(-n_small // (4 * BLOCK)))
    rooms = placed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    rooms = rooms.withColumn("b", F.pmod(F.xxhash64("sequence_id"), F.lit(blocks)).cast("int"))
    smalls = parts.filter(F.col("length") <= small).select(*cols, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))

    def fill(k, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["used", "sequence_id"])
        room: dict[int, list[int]] = {}
        for s, u in zip(left["sequence_id"].tolist(), left["used"].tolist()):
            if u < capacity:
                room.setdefault(capacity - u, []).append(s)
        right = right.sort_values(["length", "id", "row_hash", "piece"], ascending=[False, True, True, True])
        made = iter(range(1, len(right) + 1))
        ids = _best_fit(room, right["length"].tolist(), capacity, lambda: -(int(k[0]) * 2**32 + next(made)))
        return right[cols].assign(sequence_id=np.array(ids, np.int64))

    shape = "id bigint, row_hash bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint"
    filled = rooms.groupBy("b").cogroup(smalls.groupBy("b")).applyInPandas(fill, shape)
    whole = parts.filter(F.col("length") == capacity).select(*cols, (F.lit(2**62) + F.monotonically_increasing_id()).alias("sequence_id"))
    by_seq = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "id", "row_hash", "piece").rowsBetween(Window.unboundedPreceding, 0)
    shared = placed.unionByName(filled).withColumn("offset", F.sum("length").over(by_seq) - F.col("length"))
    return shared.unionByName(whole.withColumn("offset", F.lit(0).cast("bigint"))).select(*cols, "sequence_id", "offset")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenize every text once, stage the pieces, and pack them. See token_pieces and pack.

    Null and empty texts are one piece of one token, and repeated rows have pieces each.
    Words are remembered by 64-bit hashes: two of the CACHE_WORDS words of a worker share
    one with a probability of about 1e-8.
    """
    return pack(stage(token_pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces"), capacity).withColumnRenamed("id", id_col)
