"""Column types of the ledger tables."""

from pyspark.sql import types as T

WEI = T.DecimalType(38, 0)
EMBEDDING_DIMS = 128
EMBEDDING = T.ArrayType(T.FloatType(), False)

TRANSACTIONS = T.StructType(
    [
        T.StructField("hash", T.StringType(), False),
        T.StructField("from_address", T.StringType(), False),
        T.StructField("to_address", T.StringType()),
        T.StructField("value", WEI),
        T.StructField("gas", T.LongType()),
        T.StructField("gas_price", WEI),
        T.StructField("nonce", T.LongType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# A pending transaction as it is delivered: amounts are text, nothing is checked yet.
RAW_TRANSACTIONS = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("gas", T.LongType()),
        T.StructField("gas_price", T.StringType()),
        T.StructField("nonce", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

FLAGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("flag_type", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("detected_at", T.TimestampType()),
    ]
)

ENTITIES = T.StructType(
    [
        T.StructField("address", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("is_hub", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

JOBS = T.StructType(
    [
        T.StructField("tx_hash", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("last_error", T.StringType()),
        T.StructField("available_at", T.TimestampType()),
        T.StructField("locked_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

BYTECODE = T.StructType(
    [
        T.StructField("address", T.StringType(), False),
        T.StructField("bytecode", T.BinaryType()),
        T.StructField("has_code", T.BooleanType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("address", T.StringType(), False),
        T.StructField("abi", T.StringType()),
        T.StructField("source_code", T.StringType()),
        T.StructField("decompiled_code", T.StringType()),
        T.StructField("compiler_version", T.StringType()),
        T.StructField("verified", T.BooleanType()),
    ]
)
STORED_BEHAVIOR = T.StructType(
    [
        T.StructField("address", T.StringType(), False),
        T.StructField("sample_size", T.LongType()),
        T.StructField("embedding", EMBEDDING),
    ]
)
