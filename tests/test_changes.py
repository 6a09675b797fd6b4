"""Change application (SNK2/SNK3), budget upsert (SNK4), default seeding (SNK5), income seeding (SNK7)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from centwise.operators import budgets as bud
from centwise.operators import changes
from centwise.schema import BUDGETS, USERS
from conftest import make_tx

CHANGES = "seq long, op string, id long, user_id long, amount string, category string, type string, " \
          "description string, date string"


def test_apply_changes_semantics(spark):
    base = make_tx(spark, [(10.0, "Food", "Expense", "a", "2026-01-01"), (20.0, "Food", "Expense", "b", "2026-01-02"),
                           (30.0, "Food", "Expense", "c", "2026-01-03"), (40.0, "Food", "Expense", "d", "2026-01-04")])
    ch = spark.createDataFrame([
        (1, "U", 1, 1, "11", "Food", "Expense", "a1", "2026-01-01"),
        (5, "U", 1, 1, "15", "Bills", "Expense", "a5", "2026-02-01"),   # latest update wins
        (2, "D", 2, 1, None, None, None, None, None),                  # delete
        (3, "U", 2, 1, "99", "Food", "Expense", "b3", "2026-01-02"),    # update after delete: no-op
        (4, "U", 3, 9, "77", "Food", "Expense", "c4", "2026-01-03"),    # wrong user: no-op
    ], CHANGES)
    got = {r.id: (float(r.amount), r.category, r.description, r.date) for r in changes.apply_changes(base, ch).collect()}
    assert got == {1: (15.0, "Bills", "a5", dt.date(2026, 2, 1)), 3: (30.0, "Food", "c", dt.date(2026, 1, 3)),
                   4: (40.0, "Food", "d", dt.date(2026, 1, 4))}


def test_budget_upsert_and_seeding(spark, demo_users):
    base = spark.createDataFrame([(1, "Food", Decimal("100.00")), (1, "Travel", Decimal("50.00"))], BUDGETS)
    upd = spark.createDataFrame([(1, "Food", Decimal("200.00"), 1), (1, "Food", Decimal("300.00"), 2),
                                 (1, "Bills", Decimal("10.00"), 1)],
                                "user_id long, category string, monthly_budget decimal(18,2), seq long")
    got = {r.category: float(r.monthly_budget) for r in bud.apply_budget_updates(base, upd).collect()}
    assert got == {"Food": 300.0, "Travel": 50.0, "Bills": 10.0}
    seeded = {r.category for r in bud.seed_missing_budgets(demo_users, base).collect()}
    assert seeded == {"Transport", "Bills", "Entertainment", "Health", "Shopping", "Other"}
    eff = {r.category: (float(r.monthly_budget), r.is_default) for r in bud.effective_budgets(demo_users, base).collect()}
    assert eff["Food"] == (100.0, False) and eff["Travel"] == (50.0, False) and eff["Other"] == (4000.0, True)


def test_seed_income(spark):
    users = spark.createDataFrame([(1, "a", "a@x"), (2, "b", "b@x"), (3, "c", "c@x")], USERS)
    tx = make_tx(spark, [(5.0, "Salary", "Income", "pay", "2026-01-01")], user_id=1).unionByName(
        make_tx(spark, [(5.0, "Food", "Expense", "x", "2026-01-01")], user_id=2))
    got = {r.user_id: (float(r.amount), r.category, r.type) for r in
           changes.seed_income(users, tx, dt.date(2026, 3, 31)).collect()}
    assert got == {2: (0.0, "Salary", "Income"), 3: (0.0, "Salary", "Income")}
