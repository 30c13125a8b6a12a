import base64

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import scalars as S
from ledgerscope.functions.explanations import DEFAULT_EXPLANATION, explain_flags
from ledgerscope.functions.fingerprint import bytecode_embedding
from ledgerscope.functions.keccak import checksum_address
from ledgerscope.operators import records as R
from ledgerscope.schemas import RAW_TRANSACTIONS
from ledgerscope.sources.seed_labels import BUILTIN_LABELS


def apply(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_addresses(spark):
    name = "AB" * 20
    spelled = [f" 0x{name} ", f"0X{name}", name, "\tnot an address\n", "", None]
    assert apply(spark, spelled, "string", S.normalize_address) == ["0x" + name.lower()] * 3 + ["not an address", "", None]


def test_checksums(spark):
    known = [row[0] for row in BUILTIN_LABELS] + ["0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"]
    assert apply(spark, [k.lower() for k in known] + ["plain"], "string", checksum_address) == known + ["plain"]


def test_amounts(spark):
    eth = ["0", "1", "123456789012345678901", "-1500000000000000000", "1000000000000000000", "x1", "", None, "9" * 70, "99999999999999"]
    assert apply(spark, eth, "string", S.format_eth) == [
        "0 ETH", "0 ETH", "123.4567 ETH", "-1.5 ETH", "1 ETH", "x1", "0 ETH", "0 ETH", "9" * 52 + ".9999 ETH", "0 ETH"
    ]
    assert apply(spark, ["1230000000", "999"], "string", S.format_gwei) == ["1.23 Gwei", "0 Gwei"]


def test_display(spark):
    assert apply(spark, ["0x" + "1" * 40, "short", "", None], "string", S.short_address) == [
        "0x111111…111111", "short", "Unknown", "Unknown"
    ]
    assert apply(spark, [0, 999, 1000, 1234, 999949, 999950, 1500000, 2 * 10**9, 3 * 10**12, None], "long", S.compact_count) == [
        "0", "999", "1K", "1.2K", "999.9K", "1M", "1.5M", "2B", "3T", "0"
    ]
    assert apply(spark, [12.34, float("nan"), None], "double", S.format_percent) == ["12.3%", "0%", "0%"]
    assert apply(spark, [0.98], "double", S.format_similarity) == ["98.0%"]
    assert apply(spark, ["HIGH", "", None], "string", S.risk_text) == ["high", "unknown", "unknown"]
    assert apply(spark, ["send_receive_balance"], "string", S.feature_title) == ["Send Receive Balance"]
    assert apply(spark, [1.0, -0.5], "double", S.signed_value) == ["+1.00", "-0.50"]


def test_payloads(spark):
    packed = base64.b64encode(b"\x01\xff").decode()
    assert apply(spark, ["0xab", packed, "?!", "", None], "string", S.payload_text_to_hex) == ["0xab", "0x01ff", "?!", "0x", "0x"]
    assert apply(spark, [b"\x01\xff", b"", None], "binary", S.bytes_to_hex) == ["0x01ff", "0x", "0x"]


def test_search_terms(spark):
    terms = ["0x" + "a" * 64, " 0x" + "A" * 64 + " ", "0x" + "a" * 40, "vitalik", "0x" + "g" * 64]
    assert apply(spark, terms, "string", S.search_target) == ["transaction", "transaction", "account", "account", "account"]


def test_deltas(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (15, 10), (5, 10), (None, 4)], "a long, b long")
    assert [r[0] for r in df.select(S.delta_percent(F.col("a"), F.col("b"))).collect()] == [100, 0, 50, -50, -100]


def test_clamps():
    assert [S.clamp_limit(x, 20, 100) for x in (None, 0, -1, 7, 500)] == [20, 20, 20, 7, 100]
    assert [S.clamp_hours(x) for x in (None, 0, 5, 9999)] == [24, 24, 5, 720]
    assert [S.clamp_depth(x) for x in (None, 1, 9)] == [2, 1, 3]
    assert [S.clamp_hops(x) for x in (None, 4, 9)] == [3, 4, 4]
    assert [S.bucket_unit(x) for x in (None, "minute", "hour", "day", "week")] == ["hour", "minute", "hour", "day", "hour"]


def loop_fingerprint(code):
    """Byte by byte, as the definition says."""
    slots = [0.0] * 128
    for i, b in enumerate(code):
        slots[b % 128] += 1.0
        slots[(i + b) % 128] += 0.25
        if i:
            slots[(code[i - 1] ^ b) % 128] += 0.5
    length = sum(s * s for s in slots) ** 0.5
    return [round(s / length, 6) if length else 0.0 for s in slots]


def test_fingerprints(spark):
    codes = [b"\x60\x80", bytes(range(256)) * 7, b"\xff", b""]
    got = apply(spark, codes, "binary", bytecode_embedding)
    for code, vector in zip(codes, got):
        assert vector == pytest.approx(loop_fingerprint(code), abs=1e-6)


def test_explanations(spark):
    rows = explain_flags(spark.createDataFrame([("velocity_spike",), ("other",)], "flag_type string")).collect()
    assert rows[0].confidence == "medium" and rows[0].why_flagged.startswith("The address is transacting")
    assert rows[1].why_flagged == DEFAULT_EXPLANATION[0]


def test_raw_rows(spark):
    good = ("h1", " a ", "", None, 1, "", 0, b"", None)
    rows = [good, ("h2", "a", "b", "1" + "0" * 38, 1, "1", 0, None, None), (None, "a", "b", "1", 1, "1", 0, None, None),
            ("h4", "", "b", "1", 1, "1", 0, None, None), ("h5", "a", "b", "9" * 38, 1, "x", 0, b"d", None)]
    out = R.project_raw(spark.createDataFrame(rows, RAW_TRANSACTIONS)).collect()
    assert [r.problem for r in out] == [None, "value does not fit", "no hash", "no sender", "gas price does not fit"]
    assert (out[0].from_address, out[0].to_address, out[0].value, out[0].gas_price, out[0].data) == ("a", None, 0, 0, None)
    assert str(out[4].value) == "9" * 38


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(S.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.5**0.5), None]
