"""Lookups of a few addresses or hashes against the same rows of the whole documents."""

import random

from pyspark.sql import functions as F

from ledgerscope.plans import documents as docs
from ledgerscope.sources.by_address import AddressIndex, touching


def a_ledger(make, seed=3, count=300):
    rng = random.Random(seed)
    names = [f"0x{i:040x}" for i in range(40)]
    rows = [(rng.choice(names[:30]), rng.choice([*names, None]), i, rng.randrange(9), rng.choice([None, b"", b"x"])) for i in range(count)]
    code = [(n, b"\x01") for n in names[::3]]
    entities = [(names[2], "exchange", "high", True, "seed"), (names[7], "wallet", None, False, "seed")]
    flags = [(i, f"h{i * 7:03d}", names[i % 9], "circular_flow", "high", i) for i in range(20)]
    return names, make(rows, code=code, entities=entities, flags=flags)


def as_set(df):
    return {repr(r) for r in df.select(*sorted(df.columns)).collect()}


def test_profiles_by_keys(spark, make, tmp_path):
    names, ledger = a_ledger(make)
    index = AddressIndex(spark, str(tmp_path / "index"), slots=8)
    index.write(ledger.transactions)
    keys = [names[2], names[5].upper().replace("0X", "0x"), names[33], "0xunknown"]
    whole = docs.account_profiles(ledger, 4).filter(F.col("address").isin([names[2], names[5], names[33]]))
    expected = as_set(whole)
    assert len(expected) == 3
    assert as_set(docs.account_profiles(ledger, 4, keys)) == expected
    ledger.by_address = index
    assert as_set(docs.account_profiles(ledger, 4, keys)) == expected
    assert docs.account_profiles(ledger, 4, []).count() == 0


def test_dossiers_by_keys(make):
    names, ledger = a_ledger(make)
    hashes = ["h003", "h007", "h250", "none"]
    whole = docs.transaction_details(ledger).filter(F.col("hash").isin(hashes))
    assert as_set(docs.transaction_details(ledger, hashes)) == as_set(whole) and whole.count() == 3
    contracts = ledger.bytecode.select("address", "bytecode", F.lit(False).alias("flagged"))
    whole = docs.contract_details(ledger, contracts).filter(F.col("address").isin(names[:4]))
    assert as_set(docs.contract_details(ledger, contracts, names[:4])) == as_set(whole) and whole.count() == 2


def test_each_transaction_once(spark, make, tmp_path):
    names, ledger = a_ledger(make)
    index = AddressIndex(spark, str(tmp_path / "index"), slots=4)
    index.write(ledger.transactions)
    for keys in ([names[1]], names[:12], names):
        assert as_set(index.transactions(keys)) == as_set(touching(ledger.transactions, keys))
    assert index.transactions([]).count() == 0


def test_few_addresses_read_few_files(spark, make, tmp_path):
    names, ledger = a_ledger(make)
    index = AddressIndex(spark, str(tmp_path / "index"), slots=16)
    index.write(ledger.transactions)
    everything = spark.read.parquet(str(tmp_path / "index"))
    found = index.transactions([names[1]])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan
    while scan.children().size():
        scan = scan.children().head()
    read = scan.metrics().apply("numFiles").value()
    slots = {p.split("slot=")[1].split("/")[0] for p in everything.inputFiles()}
    assert len(slots) > 8 and 0 < read <= 2 < len(everything.inputFiles())
    assert "PushedFilters: [" in plan.toString() and "address" in plan.toString().split("PushedFilters: [")[1].split("]")[0]
