"""Splits by document id and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hashes are counted in 2^RANGE_BITS ranges.
RANGE_BITS = 14


def split_number(doc_id: Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def bounded(rows: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows of each label, those whose keys come first by hash.

    Rows are counted by ranges of the hash first, which combines before the
    shuffle; only rows up to the range in which a label's ``most``-th row lies
    are ranked, so a frequent label does not meet in one task.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(key)).withColumn("_range", F.shiftright("_hash", 64 - RANGE_BITS))
    below = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(label, "_range").agg(F.count("*").alias("_count"))
    first = counts.withColumn("_below", F.coalesce(F.sum("_count").over(below), F.lit(0))).where(F.col("_below") < most)
    ends = first.groupBy(F.col(label).alias("_label")).agg(F.max("_range").alias("_end"))
    near = hashed.join(ends, (F.col(label).eqNullSafe(F.col("_label"))) & (F.col("_range") <= F.col("_end")))
    order = Window.partitionBy(label).orderBy("_hash", key)
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).select(*rows.columns)
