"""Golden checks for the nested outputs (they have no SQL oracle): the financial
context (CTX1) and the chart payload (CHT1) on the 22 demo rows."""

from __future__ import annotations

import json

from centwise.operators import budgets as bud
from centwise.operators import context, insights
from centwise.operators.facts import monthly_fact


def test_financial_context(demo_tx, demo_users, no_budgets):
    fact = monthly_fact(demo_tx)
    usage = bud.budget_usage_latest(bud.effective_budgets(demo_users, no_budgets), fact)
    alerts = insights.context_alerts(fact, demo_users, usage)
    row = context.financial_context(fact, demo_users, usage, alerts).collect()[0]
    c = row.context
    assert c.currency == "Rs"
    assert (c.overall.total_income, c.overall.total_expense, c.overall.savings_rate) == (154000.0, 102000.0, 33.77)
    assert c.current_month.period == "2026-03" and c.previous_month.period == "2026-02"
    assert c.current_month.summary.savings_rate == 18.65
    assert [(t.category, t.amount, t.share_of_current_expense) for t in c.top_categories][:2] == [
        ("Shopping", 10400.0, 24.59), ("Food", 9800.0, 23.17)]
    assert [(m.month, m.amount) for m in c.monthly_spending_trend] == [
        ("2026-01", 27200.0), ("2026-02", 32500.0), ("2026-03", 42300.0)]
    assert sorted(c.monthly_summary_by_month.keys()) == ["2026-01", "2026-02", "2026-03"]
    assert [(i.category, i.change_percent) for i in c.categories_increased] == [
        ("Entertainment", 58.93), ("Food", 30.67), ("Transport", 13.33), ("Shopping", 13.04), ("Health", 12.9)]
    assert len(c.overspending_alerts) == 3
    assert [(b.category, b.usage_percent) for b in c.budget_usage][:2] == [("Entertainment", 178.0), ("Shopping", 130.0)]
    assert json.loads(row.context_json)["current_month"]["period"] == "2026-03"


def test_chart_payload(demo_tx, demo_users):
    row = context.chart_payload(monthly_fact(demo_tx), demo_users, 3).collect()[0]
    p = row.payload
    assert (p.summary.total_income, p.summary.total_expenses, p.summary.savings_rate) == (154000.0, 102000.0, 33.77)
    assert (p.prediction.predicted_expense, p.prediction.status, p.prediction.next_month) == (49100.0, "predicted", "2026-04")
    assert [c.category for c in p.category_distribution][:3] == ["Shopping", "Food", "Entertainment"]
    assert [(m.month, m.amount) for m in p.monthly_spending] == [
        ("2026-01", 27200.0), ("2026-02", 32500.0), ("2026-03", 42300.0)]
    assert [(s.month, s.income, s.expense, s.savings) for s in p.savings_vs_expenses] == [
        ("2026-01", 50000.0, 27200.0, 22800.0), ("2026-02", 52000.0, 32500.0, 19500.0),
        ("2026-03", 52000.0, 42300.0, 9700.0)]
    one = context.chart_payload(monthly_fact(demo_tx), demo_users, 1).collect()[0].payload
    assert [s.month for s in one.savings_vs_expenses] == ["2026-03"]
