"""Summaries, rankings and month windows (AGG1-AGG19, TOP1-TOP6, WIN1-WIN3).

All inputs are the monthly fact (bounded per user) except ``latest_transactions``
which ranks raw rows; there Spark's WindowGroupLimit trims each map partition
to k rows per user before the shuffle, so a hot user costs k rows, not all.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centwise.functions.columns import (
    div, EXPENSE, INCOME, MONEY, dbl, fmt, month_label, pct, rnd,
)
from centwise.operators.facts import expense_months, month_ranks, month_totals


def _summary_cols(inc: str = "income", exp: str = "expense", exp_name: str = "total_expense"):
    bal = F.col(inc) - F.col(exp)
    return [
        dbl(inc).alias("total_income"),
        dbl(exp).alias(exp_name),
        dbl(bal).alias("balance"),
        rnd(pct(bal, F.col(inc))).alias("savings_rate"),
    ]


def user_totals(fact: DataFrame) -> DataFrame:
    return fact.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(F.col("type") == INCOME, F.col("amount"))), F.lit(0).cast(MONEY)).alias("income"),
        F.coalesce(F.sum(F.when(F.col("type") == EXPENSE, F.col("amount"))), F.lit(0).cast(MONEY)).alias("expense"),
        F.sum(F.when(F.lower(F.col("category")) == "food", F.when(F.col("type") == EXPENSE, F.col("amount")))).alias("food"),
    )


def user_summary(fact: DataFrame, users: DataFrame) -> DataFrame:
    """AGG1: income, expenses, balance, savings rate; zeros for users without rows."""
    t = users.select(F.col("id").alias("user_id")).join(user_totals(fact), "user_id", "left")
    t = t.fillna(0, subset=["income", "expense"])
    return t.select("user_id", *_summary_cols(exp_name="total_expenses"))


def monthly_summary(fact: DataFrame) -> DataFrame:
    """AGG3 / AGG10: summary per present month (income-only months have expense 0)."""
    return month_totals(fact).select("user_id", month_label("month").alias("month"), *_summary_cols())


def monthly_spending(fact: DataFrame) -> DataFrame:
    """AGG4: monthly expense totals."""
    return expense_months(fact).select("user_id", month_label("month").alias("month"), dbl("amount").alias("amount"))


def _category_totals(fact: DataFrame) -> DataFrame:
    cat = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("Other"))
    return (
        fact.filter(F.col("type") == EXPENSE)
        .groupBy("user_id", cat.alias("category"))
        .agg(F.sum("amount").alias("amount"))
    )


def category_distribution(fact: DataFrame) -> DataFrame:
    """AGG5 / AGG7: expense per category, ranked by amount desc then category."""
    w = Window.partitionBy("user_id").orderBy(F.col("amount").desc(), F.col("category"))
    return _category_totals(fact).select(
        "user_id", "category", dbl("amount").alias("amount"), F.row_number().over(w).cast("long").alias("rank"))


def top_categories(fact: DataFrame, k: int = 3) -> DataFrame:
    """TOP2: top-k categories overall."""
    return category_distribution(fact).filter(F.col("rank") <= k)


def avg_monthly_expense(fact: DataFrame) -> DataFrame:
    """AGG6: mean of monthly expense totals over months that have expenses."""
    m = expense_months(fact)
    return m.groupBy("user_id").agg(
        rnd(dbl(F.sum("amount")) / F.count(F.lit(1)).cast("double")).alias("average_monthly_expense"))


def report_years(fact: DataFrame, users: DataFrame, as_of: dt.date) -> DataFrame:
    """AGG16 / SET3: years present in data plus the as-of year, per user."""
    data_years = fact.select("user_id", F.year("month").cast("string").alias("year"))
    this_year = users.select(F.col("id").alias("user_id"), F.lit(str(as_of.year)).alias("year"))
    return data_years.union(this_year).distinct()


def yearly_trend(fact: DataFrame, years: DataFrame) -> DataFrame:
    """AGG8: expense per calendar month of each report year, zero-filled, labelled Jan..Dec."""
    spine = years.select("user_id", "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_no"))
    spend = (
        fact.filter(F.col("type") == EXPENSE)
        .groupBy("user_id", F.year("month").cast("string").alias("year"),
                 F.month("month").alias("month_no"))
        .agg(F.sum("amount").alias("amount"))
    )
    j = spine.join(spend, ["user_id", "year", "month_no"], "left")
    return j.select(
        "user_id", "year", "month_no",
        F.date_format(F.make_date(F.col("year").cast("int"), F.col("month_no"), F.lit(1)), "MMM").alias("month"),
        dbl(F.coalesce(F.col("amount"), F.lit(0).cast(MONEY))).alias("amount"),
    )


def income_expense_savings(fact: DataFrame, n_months: int = 3) -> DataFrame:
    """AGG9 + FIL4: income / expense / savings for the N months ending at the
    user's latest data month.  Any type other than Income counts as expense."""
    latest = fact.groupBy("user_id").agg(F.max("month").alias("latest_month"))
    f = fact.join(latest, "user_id").filter(F.col("month") > F.add_months(F.col("latest_month"), -n_months))
    g = f.groupBy("user_id", "month").agg(
        F.coalesce(F.sum(F.when(F.col("type") == INCOME, F.col("amount"))), F.lit(0).cast(MONEY)).alias("income"),
        F.coalesce(F.sum(F.when(F.col("type") != INCOME, F.col("amount"))), F.lit(0).cast(MONEY)).alias("expense"),
    )
    return g.select("user_id", month_label("month").alias("month"), dbl("income").alias("income"),
                    dbl("expense").alias("expense"), dbl(F.col("income") - F.col("expense")).alias("savings"))


def overspend_ratio(fact: DataFrame, users: DataFrame) -> DataFrame:
    """AGG13 / AGG19: expenses as % of income; flag when above 80 %."""
    t = users.select(F.col("id").alias("user_id")).join(user_totals(fact), "user_id", "left")
    t = t.fillna(0, subset=["income", "expense"])
    has_income = F.col("income") > 0
    over = has_income & (div("expense", "income") > 0.8)
    return t.select(
        "user_id",
        over.alias("is_overspending"),
        F.when(has_income, rnd(div("expense", "income") * 100.0)).otherwise(0.0).alias("ratio"),
        # The three overspending messages.
        F.when(~has_income, F.lit("Add income transactions to enable overspending analysis."))
        .when(over, F.lit("Warning: You have spent over 80% of your income."))
        .otherwise(F.lit("Your spending is currently within a manageable range.")).alias("message"),
    )


def latest_transactions(tx: DataFrame, k: int = 5) -> DataFrame:
    """TOP1: newest k transactions per user by (date desc, id desc)."""
    w = Window.partitionBy("user_id").orderBy(F.col("date").desc(), F.col("id").desc())
    r = tx.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return r.select("id", "user_id", dbl("amount").alias("amount"), "category", "type", "description",
                    F.date_format("date", "yyyy-MM-dd").alias("date"), "rank")


def _month_category_expense(fact: DataFrame) -> DataFrame:
    return (fact.filter(F.col("type") == EXPENSE)
            .groupBy("user_id", "month", "category").agg(F.sum("amount").alias("amount")))


def top_categories_by_month(fact: DataFrame, k: int = 5) -> DataFrame:
    """TOP4: top-k expense categories of every present month."""
    w = Window.partitionBy("user_id", "month").orderBy(F.col("amount").desc(), F.col("category"))
    r = _month_category_expense(fact).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return r.select("user_id", month_label("month").alias("month"), "category", dbl("amount").alias("amount"), "rank")


def top_categories_latest(fact: DataFrame, k: int = 5) -> DataFrame:
    """TOP3 / AGG14: top-k categories of the user's latest present month with
    their share of that month's expense."""
    latest = month_ranks(fact).filter(F.col("mrank") == 1).select("user_id", "month")
    mc = _month_category_expense(fact).join(latest, ["user_id", "month"])
    w_tot = Window.partitionBy("user_id")
    w = Window.partitionBy("user_id").orderBy(F.col("amount").desc(), F.col("category"))
    r = (mc.withColumn("month_expense", F.sum("amount").over(w_tot))
         .withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k))
    return r.select(
        "user_id", month_label("month").alias("month"), "category", dbl("amount").alias("amount"),
        rnd(pct(F.col("amount"), F.col("month_expense"))).alias("share_of_current_expense"), "rank")


def highest_month(fact: DataFrame) -> DataFrame:
    """TOP5: month with the highest expense; ties -> earliest month."""
    w = Window.partitionBy("user_id").orderBy(F.col("expense").desc(), F.col("month"))
    r = month_totals(fact).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
    return r.select("user_id", month_label("month").alias("month"), dbl("expense").alias("total_expense"))


def mom_change(fact: DataFrame) -> DataFrame:
    """WIN3: month-over-month change of expense totals (months with expenses)."""
    w = Window.partitionBy("user_id").orderBy("month")
    m = expense_months(fact).withColumn("prev", F.lag("amount").over(w))
    return m.select(
        "user_id", month_label("month").alias("month"), dbl("amount").alias("amount"),
        dbl("prev").alias("prev_amount"),
        F.when(F.col("prev") > 0, rnd(div(F.col("amount") - F.col("prev"), "prev") * 100.0))
        .alias("change_percent"),
    )


def category_increases(fact: DataFrame, k: int = 5) -> DataFrame:
    """RUL8 / TOP6: categories that grew from the previous present month to the
    latest, previous > 0; top-k by rounded change % (ties: category)."""
    ranks = month_ranks(fact).filter(F.col("mrank") <= 2)
    f = fact.filter(F.col("type") == EXPENSE).join(ranks, ["user_id", "month"])
    g = f.groupBy("user_id", "category").agg(
        F.sum(F.when(F.col("mrank") == 1, F.col("amount"))).alias("cur"),
        F.sum(F.when(F.col("mrank") == 2, F.col("amount"))).alias("prev"),
    )
    g = g.filter(F.col("cur").isNotNull() & (F.col("prev") > 0))
    g = g.withColumn("chg", div(F.col("cur") - F.col("prev"), "prev") * 100.0).filter(F.col("chg") > 0)
    g = g.withColumn("change_percent", rnd("chg"))
    w = Window.partitionBy("user_id").orderBy(F.col("change_percent").desc(), F.col("category"))
    r = g.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return r.select("user_id", "category", dbl("prev").alias("previous"), dbl("cur").alias("current"),
                    "change_percent", "rank")


def category_overspend_alerts(fact: DataFrame, as_of: dt.date) -> DataFrame:
    """RUL1: as-of month spend per category more than 30 % above the zero-filled
    mean of the previous 6 full months; categories with mean 0 are skipped.

    One groupBy with conditional sums; ratio = (6*cur - hist) / hist exactly.
    """
    m0 = dt.date(as_of.year, as_of.month, 1)
    lo = F.add_months(F.lit(m0), -6)
    f = fact.filter((F.col("type") == EXPENSE) & (F.col("month") >= lo) & (F.col("month") <= F.lit(m0)))
    g = f.groupBy("user_id", "category").agg(
        F.sum(F.when(F.col("month") == F.lit(m0), F.col("amount"))).alias("cur"),
        F.sum(F.when(F.col("month") < F.lit(m0), F.col("amount"))).alias("hist"),
    ).filter(F.col("cur").isNotNull() & (F.col("hist") > 0))
    inc = div(F.col("cur") * 6 - F.col("hist"), "hist")
    g = g.withColumn("inc", inc).filter(F.col("inc") > 0.30)
    return g.select(
        "user_id", "category", dbl("cur").alias("current_total"),
        rnd(dbl("hist") / 6.0).alias("six_month_average"),
        rnd(F.col("inc") * 100.0, 1).alias("increase_percent"),
        # The category overspending message layout.
        F.concat(F.lit("Overspending alert: "), F.col("category"), F.lit(" spending is "),
                 fmt(F.col("inc") * 100.0, 1), F.lit("% above your 6-month average this month.")).alias("message"),
    )
