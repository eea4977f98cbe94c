"""Exact deduplication: group by a 128-bit content hash, then compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._spark import ascii_lower, keyed_join, stage, with_might_hold

#: Largest number of repeated hashes (16 bytes each) that is broadcast.
BROADCAST_ROWS = 500_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after A-Z are lower-cased; null counts as empty, so
    null and empty texts form one group. The smallest id of a group stays (the largest
    with largest=True). A repeated row keeps its own output row; rows that share the
    kept id are all kept. A null id never stays unless its whole group has none.
    Only columns id_col and text_col are read, so other columns may have any name.

    Plan: texts are read and hashed once, and ids and digests (56 bytes a row) are staged.
    Hashes that repeat are counted there, combined on the map side. A second reading
    sends the texts that may be repeated alone (told by the hashes themselves while they
    are few, by a bitmap of them beyond that) through a byte-equal aggregate, which also
    collapses a hot group before the shuffle. The groups join back to ids and digests;
    hot groups are broadcast, see keyed_join.
    """
    pick = F.max if largest else F.min
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    md5 = F.unhex(F.md5(F.col("norm").cast("binary")))
    sha = F.unhex(F.sha2(F.col("norm").cast("binary"), 256))
    base = docs.select(F.col(id_col).alias("id"), text.alias("norm")).select("id", "norm", md5.alias("h"))
    rows = stage(base.select("id", "h", sha.alias("sha")), "digests")
    dups = stage(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "dups")
    n_dups = dups.count()
    if n_dups <= BROADCAST_ROWS:
        texts = base.join(F.broadcast(dups), "h", "left_semi")
    else:
        texts = with_might_hold(base, F.xxhash64("h"), dups.select(F.xxhash64("h").alias("k")), n_dups, "may").filter("may")
    equal = texts.groupBy("h", "norm").agg(pick("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    groups = (
        equal.filter("n > 1")
        .groupBy("h", sha.alias("sha"))
        .agg(pick("keep").alias("keep"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
        .select("h", "sha", F.when(F.col("texts") == 1, F.col("keep")).otherwise(F.raise_error(F.lit("two texts share both digests"))).alias("keep"), "n")
    )
    groups = stage(groups, "groups")
    out = keyed_join(rows, groups, ["h", "sha"], "n", rows.count())
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
