"""Append-only tables written by micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class BatchStore:
    """One folder per table and one sub-folder per batch.

    A batch that is replayed after a failure overwrites its own sub-folder, and
    reads for a batch see earlier batches only, so replays change nothing.

    What batches read back is merged in tiers beside the table: ``merge_every``
    neighbouring batches make a run of the first tier, as many of those a run of
    the second, and so on. A batch opens fewer than ``merge_every`` runs of each
    tier, and a row is written once a tier, so both grow with the logarithm of the
    stream's age. Which runs there are follows from the number of the batch;
    folders are not searched for. Runs that went into a larger one are deleted
    when the next merge begins, by which time the batch that made it is done.
    """

    root: str
    merge_every: int = 20

    def write(self, df: DataFrame, table: str, batch_id: int, more: bool = False) -> None:
        """Write a batch; ``more`` adds to what this batch wrote before."""
        # Hashes spelled in hexadecimal digits take half the space.
        out = df.write.mode("append" if more else "overwrite").option("compression", "zstd")
        out.parquet(f"{self.root}/{table}/batch={batch_id}")

    def create(self, spark: SparkSession, table: str, schema: T.StructType) -> None:
        """Start a table with an empty batch, so that it can be read."""
        self.write(spark.createDataFrame([], schema), table, -1)

    def read(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        """Everything that batches wrote, with the batch."""
        with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        return spark.read.schema(with_batch).parquet(f"{self.root}/{table}")

    def runs(self, start: int, end: int, below: int | None = None) -> list[tuple[int, int]]:
        """The runs ``(tier, end)`` that hold the batches from ``start`` up to ``end``, oldest first.

        ``start`` is a multiple of the largest run that fits. Tiers from ``below`` on are left out.
        """
        tier = 0
        while self.merge_every ** (tier + 1) <= end - start and (below is None or tier + 1 < below):
            tier += 1
        found = []
        for t in range(tier, -1, -1):
            width = self.merge_every**t
            while end - start >= width:
                start += width
                found.append((t, start))
        return found

    def folder(self, table: str, tier: int, end: int) -> str:
        return f"{self.root}/{table}/batch={end - 1}" if tier == 0 else f"{self.root}/_{table}/tier={tier}/before={end}"

    def merged_tier(self, batch_id: int) -> int:
        """The tier of the run that is written when this batch begins; 0 if none is."""
        tier = 0
        while batch_id > 0 and batch_id % self.merge_every ** (tier + 1) == 0:
            tier += 1
        return tier

    def merged_folders(self, table: str, batch_id: int) -> list[str]:
        """What goes into the run that is written when this batch begins.

        The last batch before it and, from earlier merges, all that lies between.
        """
        tier = self.merged_tier(batch_id)
        if not tier:
            return []
        parts = [*self.runs(batch_id - self.merge_every**tier, batch_id - 1, below=tier), (0, batch_id)]
        return [self.folder(table, t, end) for t, end in parts]

    def before(self, spark: SparkSession, table: str, schema: T.StructType, batch_id: int) -> DataFrame:
        """What earlier batches wrote, as far as ``merge`` kept it."""
        folders = [self.folder(table, t, end) for t, end in self.runs(0, batch_id)]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def upto(self, spark: SparkSession, table: str, schema: T.StructType, batch_id: int) -> DataFrame:
        own = spark.read.schema(schema).parquet(f"{self.root}/{table}/batch={batch_id}")
        return self.before(spark, table, schema, batch_id).unionByName(own)

    def merge(
        self, spark: SparkSession, table: str, schema: T.StructType, batch_id: int, fold: Callable[[DataFrame], DataFrame]
    ) -> None:
        """At every ``merge_every``-th batch, write the run that it and its successors read."""
        tier = self.merged_tier(batch_id)
        if not tier:
            return
        self._delete_merged(spark, table, batch_id - self.merge_every)
        rows = fold(spark.read.schema(schema).parquet(*self.merged_folders(table, batch_id)))
        rows.select(*schema.fieldNames()).write.mode("overwrite").option("compression", "zstd").parquet(self.folder(table, tier, batch_id))

    def _delete_merged(self, spark: SparkSession, table: str, batch_id: int) -> None:
        """Delete the runs that went into the one written at ``batch_id``; the batches themselves stay."""
        for folder in self.merged_folders(table, batch_id):
            if "/tier=" in folder:
                delete(spark, folder)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder where Spark writes; one that is gone already is no error."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


@dataclass(frozen=True)
class VersionedTable:
    """Rows under a key that newer ones replace, in versions.

    An upsert writes its own rows only and is seen from the moment its pointer, an
    empty file named by the version, exists; a crash before leaves the last version
    in force and the next upsert overwrites what was left. A reader stays with the
    version it took: no file that belongs to it is changed, and none is deleted
    before ``merge_every`` further versions. Older versions are merged in tiers,
    as in ``BatchStore``, where a key keeps its newest row.

    One writer at a time.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    merge_every: int = 8

    @property
    def _store(self) -> BatchStore:
        return BatchStore(self.root, self.merge_every)

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("_version", T.LongType())])

    def version(self) -> int:
        """The version in force, from 0; -1 before the first upsert."""
        files, pointers = _file_system(self.spark, f"{self.root}/_versions")
        if not files.exists(pointers):
            return -1
        return max((int(entry.getPath().getName()) for entry in files.listStatus(pointers)), default=-1)

    def upsert(self, rows: DataFrame, newest: str | None = None) -> int:
        """Write ``rows`` as the next version and return its number.

        Of rows with the same key in one upsert the one with the greatest ``newest``
        stays (equal or no ``newest``: one by hash); rows with a null in their key
        are left out. Columns that are not in the schema are ignored.
        """
        version = self.version() + 1
        known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys))
        order = F.struct(*[F.col(c) for c in [newest] if c], F.xxhash64(*self.schema.fieldNames()))
        self._store.merge(self.spark, "rows", self._stored, version, self._newest)
        self._store.write(self._one_a_key(known, order).withColumn("_version", F.lit(version).cast("long")), "rows", version)
        files, pointer = _file_system(self.spark, f"{self.root}/_versions/{version}")
        files.create(pointer, False).close()
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (by default the one in force), one for each key."""
        version = self.version() if version is None else version
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self._newest(self._store.upto(self.spark, "rows", self._stored, version)).drop("_version")

    def _newest(self, rows: DataFrame) -> DataFrame:
        return self._one_a_key(rows, F.col("_version"))

    def _one_a_key(self, rows: DataFrame, order: Column) -> DataFrame:
        names = [n for n in self._stored.fieldNames() if n in rows.columns]
        best = F.max_by(F.struct(*names), order).alias("row")
        return rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in self.keys]).agg(best).select("row.*")
