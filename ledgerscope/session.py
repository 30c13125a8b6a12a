"""Session set-up and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

WORK_DIR_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Folders of local sessions without a configured one, by application; the setting itself is fixed once a session runs.
_local_folders: dict[str, str] = {}


def build_session(app: str = "ledgerscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Sizes (memory, shuffle partitions, shared folder) belong to the cluster and
    are taken from its own configuration unless passed here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own, which goes with
    the process: executors of a cluster could not see it.
    """
    configured = spark.conf.get(WORK_DIR_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {WORK_DIR_CONF} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="ledgerscope-")
        atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
    return _local_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_dir(spark)}/ledgerscope/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder, as files of at most ``rows_a_file`` rows if that is not 0, and read it back.

    Cuts lineage between search levels. Unlike cached blocks the files survive
    the loss of executors, and their sizes let Spark choose later joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("error").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files, which otherwise stay until the driver's memory is cleared."""
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_CONF)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
