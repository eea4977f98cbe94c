"""A training corpus from documents: classify, drop lines, drop near copies, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.llm import cube_mix, line_dedup, ngram_join, packing, quality_gam
from tallyline.llm._spark import fresh, stage

#: Tables of ids up to this many rows are broadcast; above, both sides shuffle.
BROADCAST_ROWS = 300_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality model, learned from labels outside the held-out fold, accepts.

    A null text is judged as an empty one. Repeated rows are judged alike, and ids play no
    part in a verdict. Without labels every row has the same score.
    """
    model = quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gam.keep_good(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that a smaller doc_id holds; a row that loses lines and has no word left goes.

    n_chars, if docs have it, follows the text; texts that lose nothing, null and empty
    ones too, stay as they are. Rows of one id and text lose the same lines; a null id
    counts as one document after all others.
    """
    info = fresh(docs, "line_dedup")
    out = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs), to=info)
    changed = F.col(f"{info}.n_dropped") > 0
    text = F.col(f"{info}.kept_text")
    out = out.filter(~changed | F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(changed, text).otherwise(F.col("text"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word shingle sets with Jaccard 0.8 or more, the smallest doc_id stays.

    Rows of one doc_id stay or go together; a null doc_id stays. Texts without a word
    link with nothing and stay.
    """
    comps = ngram_join.ngram_components(docs)
    gone_id = fresh(docs, "gone_id")
    gone = stage(comps.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    return docs.join(_small(gone), docs["doc_id"] == F.col(gone_id), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of its source takes it, not at all perhaps.

    A null text has no words and is drawn like any document; sources may be null. Rows
    equal in id, text and source share what is taken of them.
    """
    return cube_mix.repeat_rows(docs, broadcast_rows=BROADCAST_ROWS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one token, the closing id 0; each copy of a row has pieces of
    its own, with a null doc_id if it has none.
    """
    out = packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_gam", classify),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", drop_near_copies),
    ("cube_mix", mix),
    ("best_fit_packing", pack),
]

#: No stage but the line deduplication can be put in SQL: a fitted model, a balanced sample and a heuristic packing have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus of sf_dir; each stage is written in full and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
