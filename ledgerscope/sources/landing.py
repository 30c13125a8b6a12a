"""Readers and writers of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.schemas import RAW_TRANSACTIONS


def read_pending(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw deliveries at rest."""
    return spark.read.format(fmt).schema(RAW_TRANSACTIONS).load(path)


def stream_pending(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Raw deliveries as they arrive in a landing folder."""
    return spark.readStream.format(fmt).schema(RAW_TRANSACTIONS).options(**options).load(path)


def stream_pending_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Raw deliveries from Kafka messages with a JSON body. Needs the Spark Kafka package."""
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .options(**options)
        .load()
    )
    body = F.from_json(F.col("value").cast("string"), RAW_TRANSACTIONS)
    return messages.select(body.alias("tx")).select("tx.*")


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)
