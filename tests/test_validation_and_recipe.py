"""FIXTURES.md: the manual alert recipe and the cleaning / validation edge tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from centwise.operators import budgets as bud
from centwise.operators import clean
from centwise.operators.facts import monthly_fact
from centwise.schema import BUDGETS, RAW_TRANSACTIONS, USERS
from conftest import make_tx


def test_manual_alert_recipe(spark, demo_users, tmp_path):
    as_of = dt.date(2026, 4, 30)
    tx = make_tx(spark, [(900.0, "Food", "Expense", "lunch", "2026-04-10")])
    budgets = spark.createDataFrame([(1, "Food", Decimal("1000.00"))], BUDGETS)
    beff = bud.effective_budgets(demo_users, budgets)
    cands = bud.crossing_candidates(bud.budget_alerts(beff, monthly_fact(tx), as_of), as_of)
    path = str(tmp_path / "events")
    first = bud.append_new_events(spark, cands, path, 1).collect()
    assert [(r.category, r.threshold_percent, r.usage_percent) for r in first] == [("Food", 85, 90.0)]
    assert bud.append_new_events(spark, cands, path, 2).collect() == []


def test_cleaning_edges(spark):
    amounts = ["1e3", "1_000", "abc", "", "nan", "inf", "1,000", " 12.5 "]
    rows = [(i, 1, a, "Food", "Expense", "x", "2026-01-05") for i, a in enumerate(amounts)]
    got = {r.id: float(r.amount) for r in clean.clean_transactions(spark.createDataFrame(rows, RAW_TRANSACTIONS)).collect()}
    assert got == {0: 1000.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: 12.5}
    dates = ["2026-1-5", "2026-01-05", "2026-02-30", "", "2026-01-05 10:00", " 2026-01-05", "20260105"]
    rows = [(i, 1, "5", "Food", "Expense", "x", d) for i, d in enumerate(dates)]
    kept = {r.id: r.date for r in clean.clean_transactions(spark.createDataFrame(rows, RAW_TRANSACTIONS)).collect()}
    assert kept == {0: dt.date(2026, 1, 5), 1: dt.date(2026, 1, 5)}


def test_validation_codes(spark):
    users = spark.createDataFrame([(1, "a", "a@example.com")], USERS)
    rows = [(1, 1, "-5", "Food", "Expense", "x", "2026-01-05"),
            (2, 1, "5", "Food", "Expense", "  ", "2026-01-05"),
            (3, 1, "5", "Food", "Transfer", "x", "2026-01-05"),
            (4, 1, "5", "Food", "Expense", "x", "2026-13-05"),
            (5, 9, "5", "", "Income", "x", "2026-01-05"),
            (6, 1, "5", "", "Expense", "x", "2026-01-05")]
    got = {r.id: (r.error_codes, r.category) for r in
           clean.validate_transactions(spark.createDataFrame(rows, RAW_TRANSACTIONS), users).collect()}
    assert got[1][0] == "amount_negative"
    assert got[2][0] == "description_missing"
    assert got[3][0] == "type_invalid"
    assert got[4][0] == "date_invalid"
    assert got[5] == ("user_unknown", "Income")
    assert got[6] == ("", "Other")


def test_user_validation(spark):
    raw = spark.createDataFrame([(1, "Ann", "Ann@Example.com"), (2, "Ann B", " ann@example.com "), (3, "", "x@y"),
                                 (4, "Bo", "not-an-email")], USERS)
    got = {r.id: r.error_codes for r in clean.validate_users(raw).collect()}
    assert got == {1: "", 2: "email_duplicate", 3: "name_missing", 4: "email_invalid"}
