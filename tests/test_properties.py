"""Properties: outputs do not depend on how the input is partitioned, and the
category breakdown adds up to the summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from centwise.operators import budgets as bud
from centwise.operators import facts, forecast, insights, summary
from centwise.sources import testdata as td

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_partitioning_does_not_change_results(spark):
    tx = td.transactions_full(spark, SF)
    users = td.users(spark, SF)
    shuffled = tx.repartition(37, F.rand(11))
    for build in (lambda t: summary.user_summary(facts.monthly_fact(t), users),
                  lambda t: summary.category_distribution(facts.monthly_fact(t)),
                  lambda t: forecast.expense_forecast(facts.monthly_fact(t), users),
                  lambda t: summary.latest_transactions(t, 5).select("user_id", "rank", "date"),
                  lambda t: insights.period_suggestions(facts.monthly_fact(t), users)):
        assert _rows(build(tx)) == _rows(build(shuffled))


def test_breakdown_adds_up_to_summary(spark):
    tx = td.transactions_full(spark, SF)
    fact = facts.monthly_fact(tx)
    users = td.users(spark, SF)
    s = {r.user_id: r.total_expenses for r in summary.user_summary(fact, users).collect()}
    cd = summary.category_distribution(fact).groupBy("user_id").agg(F.sum("amount").alias("t"))
    for r in cd.collect():
        assert abs(r.t - s[r.user_id]) < 1e-6


def test_alerts_are_a_subset_of_usage(spark):
    tx = td.transactions_full(spark, SF)
    fact = facts.monthly_fact(tx)
    beff = bud.effective_budgets(td.users(spark, SF), td.budgets(spark, SF), default_scale=5)
    alerts = bud.budget_alerts(beff, fact, td.SCALE_AS_OF)
    assert alerts.filter(F.col("usage_percent") < 85.0).count() == 0
    assert alerts.filter(F.col("is_exceeded") & (F.col("spent") < F.col("budget"))).count() == 0
