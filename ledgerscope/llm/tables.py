"""Small table helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.session import materialize

# Stands for a null id wherever ids are join keys; sorts last in descending order.
NO_ID = -(1 << 63)
WORD = r"[^\x20\x09-\x0D]+"


def key_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """Row numbers from 1 over the whole table, without sorting it in one task.

    The rows are dealt out by ranges of the order and written; each range is
    numbered by itself and shifted by the sizes of those before it. Rows equal
    in the order share a range; their numbers are arbitrary among themselves.
    """
    dealt = materialize(
        df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = dealt.groupBy("_range").count()  # one row for each range
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        dealt.withColumn("_inside", inside)
        .join(before, "_range")
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_range", "_inside", "_before")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list ``a, b`` (long) as ``node, component`` (its smallest node).

    Each round hangs every node under its smallest neighbour and contracts the
    edges, so that they shrink to nothing; only the nodes' parents are kept.
    Nothing is gathered per node, so a hub with many edges does no harm.
    """
    ends = ("a", "b")
    edges = materialize(edges.select(*ends).where("a <> b"), "edges")
    labels = edges.select(F.explode(F.array(*ends)).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        parents = materialize(
            both.select("col.*").groupBy(F.col("a").alias("child")).agg(F.least(F.min("b"), F.first("a")).alias("parent")),
            "parents",
        )
        moved = edges
        for end in ends:
            step = parents.select(F.col("child").alias(end), F.col("parent").alias(f"{end}_next"))
            moved = moved.join(step, end).drop(end).withColumnRenamed(f"{end}_next", end)
        edges = materialize(moved.where("a <> b").select(*ends).distinct(), "edges")
        labels = labels.join(parents, labels["component"] == parents["child"], "left").select(
            "node", F.coalesce("parent", "component").alias("component")
        )
    return materialize(labels, "labels")


# Up to this many ids (16 bytes each) are handed to all tasks; more are joined by a shuffle.
MOST_IDS = 2_000_000


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``ids`` (one distinct long column of that name, already written)."""
    return df.join(small_to_all(ids), column, "left_semi")


def small_to_all(rows: DataFrame) -> DataFrame:
    """Rows of a few longs, already written, to join with: handed to all tasks unless they are too many."""
    return F.broadcast(rows) if rows.count() <= MOST_IDS else rows
