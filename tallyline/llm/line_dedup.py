"""Line deduplication with keep bitmaps, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import ascii_lower, fresh, hot_share, stage, with_might_hold

#: White space that a key loses at both ends.
STRIP = " \t\n\x0b\f\r"
#: Keys tracked while looking for hot ones are this many times those that can be hot.
TRACKED = 10
#: A bitmap table of at most this many rows and 64-line words is broadcast.
BROADCAST_ROWS, BROADCAST_WORDS = 200_000, 2_000_000


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: id, row_hash, keep_at, keep_words, n_dropped; a stored table.

    keep_words holds the bitmap's 64-bit words but for full ones, keep_at their numbers in
    order; bit p % 64 of word p / 64 is 0 where line p goes, and lines of words that are
    not there stay. Documents without a row lose nothing. A key
    (line without outer white space, A-Z lower-cased) of min_chars code points that two
    documents hold stays only in the smallest id. Null and empty texts are one empty
    line. row_hash tells apart rows of one id with different texts; equal rows share a
    bitmap. A null id counts as a document of its own, after all others.

    96-bit key hashes are range-partitioned and sorted by document and position, and one
    streaming window marks what comes after a key's first document. Keys that hold more
    than 1 / hot_share of all lines, so hot_share at most, skip the range partitions: a
    map-side aggregate finds their first documents, and those are broadcast.
    """
    top = F.lit(2**63 - 1)
    lines = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), top).alias("id"),
        F.xxhash64(_text(text_col)).alias("row_hash"),
        F.posexplode(split_lines(_text(text_col))).alias("pos", "line"),
    )
    keyed = lines.select("id", "row_hash", "pos", ascii_lower(F.btrim("line", F.lit(STRIP))).alias("key"))
    keyed = keyed.filter(F.length("key") >= min_chars)
    occ = stage(keyed.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "id", "row_hash", "pos"), "lines")

    share = hot_share(docs.sparkSession)
    found = occ.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h1, {share}, {min(TRACKED * share, 1_000_000)})").alias("top")).first()
    hot = [r["item"] for r in found["top"] or [] if r["count"] * share > found["n"] and r["count"] > 1]
    rest = occ.filter(~F.col("h1").isin(hot)) if hot else occ
    ranged = rest.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "id", "pos")
    by_key = Window.partitionBy("h1", "h2").orderBy("id", "pos")
    gone = ranged.withColumn("first", F.first("id").over(by_key)).filter("id <> first").select("id", "row_hash", "pos")
    if hot:
        some = occ.filter(F.col("h1").isin(hot))
        firsts = some.groupBy("h1", "h2").agg(F.min("id").alias("first"))
        more = some.join(F.broadcast(firsts), ["h1", "h2"]).filter("id <> first")
        gone = gone.unionByName(more.select("id", "row_hash", "pos"))

    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("pos", F.lit(64)).cast("int"))
    words = gone.distinct().groupBy("id", "row_hash", (F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))
    docs_words = words.groupBy("id", "row_hash").agg(
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep")))).alias("s"), F.sum("n").alias("n_dropped")
    )
    return stage(docs_words.select(F.when(F.col("id") != top, F.col("id")).alias(id_col), "row_hash", F.col("s.word").alias("keep_at"), F.col("s.keep").alias("keep_words"), "n_dropped"), "bitmaps")


def _dense(at: str, words: str) -> Column:
    """All words up to the last that is not full, so that one is found without a search."""
    return F.expr(f"flatten(transform({at}, (w, i) -> concat(array_repeat(-1L, w - if(i = 0, 0, {at}[i - 1] + 1)), array({words}[i]))))")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", to: str = "line_dedup") -> DataFrame:
    """docs with a struct column (`to`, a name that docs lack): n_lines, n_dropped, kept_text.

    The bitmaps, a stored table, are broadcast while few (rows and words are counted
    first). Beyond that, texts that may have one (told by a bitmap of their hashes) meet
    them by a shuffle, and the others stay in place. Null and empty texts give an empty
    text; docs may have any other columns.
    """
    if to in docs.columns:
        raise ValueError(f"docs have a column {to}")
    bid, brow, keep_at, keep_words, gone = (fresh(docs, c) for c in ("bitmap_id", "bitmap_row", "bitmap_at", "bitmap_words", "bitmap_gone"))
    own = fresh(docs, "own_row")
    docs = docs.withColumn(own, F.xxhash64(_text(text_col)))
    b = bitmaps.select(F.col(id_col).alias(bid), F.col("row_hash").alias(brow), F.col("keep_at").alias(keep_at), F.col("keep_words").alias(keep_words), F.col("n_dropped").alias(gone))
    n, w = bitmaps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keep_words")), F.lit(0))).first()
    match = F.col(id_col).eqNullSafe(F.col(bid)) & (F.col(own) == F.col(brow))
    if n <= BROADCAST_ROWS and w <= BROADCAST_WORDS:
        both = docs.join(F.broadcast(b), match, "left")
    else:
        may = fresh(docs, "may_lose")
        told = with_might_hold(docs, F.col(own), b.select(brow), n, may)
        nothing = [F.lit(None).cast(b.schema[c].dataType).alias(c) for c in b.columns]
        both = told.filter(may).join(b, match, "left").unionByName(told.filter(~F.col(may)).select("*", *nothing)).drop(may)
    all_lines = split_lines(_text(text_col))
    keep = _dense(keep_at, keep_words)

    def stays(_, i):
        word = F.floor(i / 64).cast("int")
        return (word >= F.size(keep_col)) | (F.getbit(F.get(keep_col, word), F.pmod(i, F.lit(64)).cast("int")) == 1)

    dense = fresh(docs, "bitmap_dense")
    keep_col = F.col(dense)
    both = both.withColumn(dense, keep)
    kept = F.when(keep_col.isNull(), _text(text_col)).otherwise(F.array_join(F.filter(all_lines, stays), "\n"))
    info = F.struct(F.size(all_lines).cast("bigint").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept_text"))
    return both.withColumn(to, info).drop(bid, brow, keep_at, keep_words, gone, own, dense)
