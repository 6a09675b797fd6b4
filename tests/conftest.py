from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from centwise.schema import TRANSACTIONS, USERS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from centwise.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


# Amounts, categories, types and dates of the demo account (22 rows, one user,
# three months), on which the golden values of FIXTURES.md section 2 rest.
DEMO_ROWS = [
    (50000.0, "Salary", "Income", "demo entry 1", "2026-01-01"),
    (52000.0, "Salary", "Income", "demo entry 2", "2026-02-01"),
    (52000.0, "Salary", "Income", "demo entry 3", "2026-03-01"),
    (6200.0, "Food", "Expense", "demo entry 4", "2026-01-05"),
    (2800.0, "Transport", "Expense", "demo entry 5", "2026-01-08"),
    (3500.0, "Bills", "Expense", "demo entry 6", "2026-01-11"),
    (4200.0, "Entertainment", "Expense", "demo entry 7", "2026-01-16"),
    (2600.0, "Health", "Expense", "demo entry 8", "2026-01-20"),
    (7900.0, "Shopping", "Expense", "demo entry 9", "2026-01-25"),
    (7500.0, "Food", "Expense", "demo entry 10", "2026-02-04"),
    (3000.0, "Transport", "Expense", "demo entry 11", "2026-02-07"),
    (4100.0, "Bills", "Expense", "demo entry 12", "2026-02-09"),
    (5600.0, "Entertainment", "Expense", "demo entry 13", "2026-02-14"),
    (3100.0, "Health", "Expense", "demo entry 14", "2026-02-18"),
    (9200.0, "Shopping", "Expense", "demo entry 15", "2026-02-22"),
    (9800.0, "Food", "Expense", "demo entry 16", "2026-03-03"),
    (3400.0, "Transport", "Expense", "demo entry 17", "2026-03-05"),
    (4500.0, "Bills", "Expense", "demo entry 18", "2026-03-10"),
    (8900.0, "Entertainment", "Expense", "demo entry 19", "2026-03-15"),
    (3500.0, "Health", "Expense", "demo entry 20", "2026-03-18"),
    (10400.0, "Shopping", "Expense", "demo entry 21", "2026-03-24"),
    (1800.0, "Other", "Expense", "demo entry 22", "2026-03-26"),
]
DEMO_AS_OF = dt.date(2026, 3, 31)


def make_tx(spark, rows, user_id=1):
    """rows: (amount, category, type, description, 'YYYY-MM-DD') -> clean tx with month."""
    from pyspark.sql import functions as F
    data = [(i + 1, user_id, Decimal(str(a)).quantize(Decimal("0.01")), c, t, d, dt.date.fromisoformat(day))
            for i, (a, c, t, d, day) in enumerate(rows)]
    return spark.createDataFrame(data, TRANSACTIONS).withColumn("month", F.trunc("date", "MM"))


@pytest.fixture(scope="session")
def demo_tx(spark):
    return make_tx(spark, DEMO_ROWS)


@pytest.fixture(scope="session")
def demo_users(spark):
    return spark.createDataFrame([(1, "Demo User", "demo@example.com")], USERS)


@pytest.fixture(scope="session")
def no_budgets(spark):
    from centwise.schema import BUDGETS
    return spark.createDataFrame([], BUDGETS)
