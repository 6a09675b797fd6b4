"""Golden values on the 22 demo rows (FIXTURES.md section 2), as_of 2026-03-31,
default budgets.  Expected values were derived by hand from the rows."""

from __future__ import annotations

from conftest import DEMO_AS_OF

from centwise.operators import budgets as bud
from centwise.operators import facts, forecast, insights, summary


def _fact(demo_tx):
    return facts.monthly_fact(demo_tx)


def test_user_summary(demo_tx, demo_users):
    r = summary.user_summary(_fact(demo_tx), demo_users).collect()[0]
    assert (r.total_income, r.total_expenses, r.balance, r.savings_rate) == (154000.0, 102000.0, 52000.0, 33.77)


def test_monthly_summary(demo_tx):
    got = {r.month: (r.total_income, r.total_expense, r.balance, r.savings_rate)
           for r in summary.monthly_summary(_fact(demo_tx)).collect()}
    assert got == {"2026-01": (50000.0, 27200.0, 22800.0, 45.6),
                   "2026-02": (52000.0, 32500.0, 19500.0, 37.5),
                   "2026-03": (52000.0, 42300.0, 9700.0, 18.65)}


def test_category_distribution_and_avg(demo_tx):
    rows = summary.category_distribution(_fact(demo_tx)).orderBy("rank").collect()
    assert [(r.category, r.amount) for r in rows] == [
        ("Shopping", 27500.0), ("Food", 23500.0), ("Entertainment", 18700.0), ("Bills", 12100.0),
        ("Health", 9200.0), ("Transport", 9200.0), ("Other", 1800.0)]
    assert summary.avg_monthly_expense(_fact(demo_tx)).collect()[0].average_monthly_expense == 34000.0


def test_yearly_trend(demo_tx, demo_users):
    fact = _fact(demo_tx)
    t = summary.yearly_trend(fact, summary.report_years(fact, demo_users, DEMO_AS_OF)).orderBy("month_no").collect()
    assert [(r.month, r.amount) for r in t] == [
        ("Jan", 27200.0), ("Feb", 32500.0), ("Mar", 42300.0)] + [
        (m, 0.0) for m in ["Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]]


def test_top_categories_latest(demo_tx):
    rows = summary.top_categories_latest(_fact(demo_tx)).orderBy("rank").collect()
    assert [(r.category, r.amount, r.share_of_current_expense) for r in rows] == [
        ("Shopping", 10400.0, 24.59), ("Food", 9800.0, 23.17), ("Entertainment", 8900.0, 21.04),
        ("Bills", 4500.0, 10.64), ("Health", 3500.0, 8.27)]


def test_highest_month(demo_tx):
    r = summary.highest_month(_fact(demo_tx)).collect()[0]
    assert (r.month, r.total_expense) == ("2026-03", 42300.0)


def test_category_increases(demo_tx):
    rows = summary.category_increases(_fact(demo_tx)).orderBy("rank").collect()
    assert [(r.category, r.change_percent) for r in rows] == [
        ("Entertainment", 58.93), ("Food", 30.67), ("Transport", 13.33), ("Shopping", 13.04), ("Health", 12.9)]


def test_category_overspend_alerts(demo_tx):
    rows = summary.category_overspend_alerts(_fact(demo_tx), DEMO_AS_OF).orderBy("category").collect()
    assert [(r.category, r.increase_percent) for r in rows] == [
        ("Bills", 255.3), ("Entertainment", 444.9), ("Food", 329.2), ("Health", 268.4),
        ("Shopping", 264.9), ("Transport", 251.7)]
    assert rows[0].message == "Overspending alert: Bills spending is 255.3% above your 6-month average this month."


def test_budget_usage_and_alerts(demo_tx, demo_users, no_budgets):
    fact = _fact(demo_tx)
    beff = bud.effective_budgets(demo_users, no_budgets)
    usage = bud.budget_usage_latest(beff, fact).orderBy("rank").collect()
    assert [(r.category, r.usage_percent) for r in usage] == [
        ("Entertainment", 178.0), ("Shopping", 130.0), ("Food", 81.67), ("Transport", 56.67),
        ("Bills", 50.0), ("Health", 50.0), ("Other", 45.0)]
    alerts = bud.budget_alerts(beff, fact, DEMO_AS_OF).orderBy("rank").collect()
    assert [(r.category, r.usage_percent, r.is_exceeded) for r in alerts] == [
        ("Entertainment", 178.0, True), ("Shopping", 130.0, True)]
    assert alerts[0].message == "Alert: You have used 178.0% of your monthly entertainment budget."


def test_crossings_emit_once(spark, demo_tx, demo_users, no_budgets, tmp_path):
    fact = _fact(demo_tx)
    beff = bud.effective_budgets(demo_users, no_budgets)
    cands = bud.crossing_candidates(bud.budget_alerts(beff, fact, DEMO_AS_OF), DEMO_AS_OF)
    path = str(tmp_path / "events")
    first = bud.append_new_events(spark, cands, path, 1).collect()
    assert sorted((r.threshold_percent, r.category) for r in first) == [
        (85, "Entertainment"), (85, "Shopping"), (100, "Entertainment"), (100, "Shopping")]
    second = bud.append_new_events(spark, cands, path, 2).collect()
    assert second == []


def test_forecast(demo_tx, demo_users):
    r = forecast.expense_forecast(_fact(demo_tx), demo_users).collect()[0]
    assert (r.predicted_expense, r.next_month, r.months_used, r.status) == (49100.0, "2026-04", 3, "predicted")
    assert (r.trend_slope, r.average_monthly_expense) == (7550.0, 34000.0)


def test_period_suggestions(demo_tx, demo_users):
    rows = insights.period_suggestions(_fact(demo_tx), demo_users).collect()
    assert [r.message for r in rows] == [
        "Your top spending categories are Shopping, Food, Entertainment. Reviewing these first will have the "
        "biggest impact."]


def test_global_suggestions(demo_tx, demo_users):
    rows = insights.global_suggestions(_fact(demo_tx), demo_users).collect()
    assert [r.message for r in rows] == [
        "Your spending and savings pattern looks healthy. Keep tracking consistently."]


def test_context_alerts(demo_tx, demo_users, no_budgets):
    fact = _fact(demo_tx)
    usage = bud.budget_usage_latest(bud.effective_budgets(demo_users, no_budgets), fact)
    msgs = [r.message for r in insights.context_alerts(fact, demo_users, usage).orderBy("seq").collect()]
    assert msgs[0].startswith("Current month expenses are 81.3% of income")
    assert msgs[1].startswith("Entertainment budget is at 178.0% usage")
    assert msgs[2].startswith("Shopping budget is at 130.0% usage")
    assert len(msgs) == 3


def test_personalized_suggestions(demo_tx, demo_users, no_budgets):
    fact = _fact(demo_tx)
    usage = bud.budget_usage_latest(bud.effective_budgets(demo_users, no_budgets), fact)
    rows = insights.personalized_suggestions(fact, demo_users, usage).orderBy("rank").collect()
    assert [(r.priority, r.title) for r in rows] == [
        (100, "Low Savings Rate"), (95, "Overspending Risk"), (88, "Budget Limit Near"),
        (80, "Entertainment Is Rising"), (80, "Food Is Rising")]
