import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ledgerscope import schemas  # noqa: E402
from ledgerscope.session import build_session  # noqa: E402
from ledgerscope.sources.ledger import Ledger  # noqa: E402

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "ledgerscope-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Build tiny ledgers by hand: transfers are (from, to, minute[, value, data])."""

    def transactions(rows):
        full = []
        for i, row in enumerate(rows):
            sender, to, minute, value, data = (*row, *(100, None)[len(row) - 3 :]) if len(row) < 5 else row
            full.append(
                (f"h{i:03d}", sender, to, value, 21000, 10, i, 0, data, START + dt.timedelta(minutes=minute))
            )
        return spark.createDataFrame(_decimals(full), schemas.TRANSACTIONS)

    def ledger(rows, code=(), entities=(), flags=(), jobs=()):
        empty_meta = spark.createDataFrame([], schemas.METADATA)
        return Ledger(
            transactions=transactions(rows),
            bytecode=spark.createDataFrame([(a, c, bool(c)) for a, c in code], schemas.BYTECODE),
            metadata=empty_meta,
            entities=spark.createDataFrame(
                [(a, a.upper(), t, r, h, s, START) for a, t, r, h, s in entities], schemas.ENTITIES
            ),
            flags=spark.createDataFrame(
                [(i, tx, a, kind, sev, None, START + dt.timedelta(minutes=at)) for i, tx, a, kind, sev, at in flags],
                schemas.FLAGS,
            ),
            jobs=spark.createDataFrame(list(jobs), schemas.JOBS),
        )

    ledger.transactions = transactions
    return ledger


def _decimals(rows):
    from decimal import Decimal

    return [(*r[:3], Decimal(r[3]), r[4], Decimal(r[5]), *r[6:]) for r in rows]
