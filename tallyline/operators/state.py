"""State entries: lookup in request order and changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.requests import check_keys


def lookup(spark: SparkSession, entries: DataFrame, keys: Sequence[int]) -> DataFrame:
    """Entries of the keys that exist, in request order; a repeated key is answered at each place."""
    check_keys(list(keys))
    asked = spark.createDataFrame(list(enumerate(keys)), "ordinal bigint, key bigint")
    found = entries.filter(F.col("key").isin(*set(keys)))
    return F.broadcast(asked).join(found, "key").select("ordinal", "key", "entry", "last_modified", "live_until").orderBy("ordinal")


def changes(diffs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """diffs with the column change: created, deleted or updated; rows with neither side go."""
    b, a = F.col(before), F.col(after)
    kind = F.when(b.isNotNull() & a.isNotNull(), "updated").when(b.isNotNull(), "deleted").otherwise("created")
    return diffs.filter(b.isNotNull() | a.isNotNull()).withColumn("change", kind)
