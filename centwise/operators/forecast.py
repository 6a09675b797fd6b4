"""Next-month expense forecast (FCT1, FCT2, WIN2).

Least squares of monthly expense on the month index 0..n-1 (present months
only, gaps ignored), evaluated at n.  With x = 0..n-1 the fit has a closed form
whose numerators are exact decimals:

    pred  = (6*Sxy - 2*(n-1)*Sy) / (n*(n-1))
    slope = (12*Sxy - 6*(n-1)*Sy) / (n*(n^2-1))

so one aggregate per user replaces a per-user model fit, and the single double
division happens last.  The window that numbers months runs over the monthly
totals (bounded per user), never over raw transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centwise.functions.columns import EXPENSE, dbl, month_label, rnd
from centwise.operators.facts import expense_months

# Forecast status codes.
INSUFFICIENT = "insufficient-data"
NO_EXPENSES = "no-expenses"
INVALID_DATES = "invalid-dates"
LIMITED = "limited-history"
PREDICTED = "predicted"


def monthly_index(fact: DataFrame) -> DataFrame:
    """WIN2: month index over present expense months."""
    w = Window.partitionBy("user_id").orderBy("month")
    return expense_months(fact).filter(F.col("month").isNotNull()).withColumn("x", F.row_number().over(w) - 1)


def expense_forecast(fact: DataFrame, users: DataFrame) -> DataFrame:
    m = monthly_index(fact)
    y = F.col("amount").cast("decimal(20,2)")
    g = m.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).cast("decimal(38,2)").alias("sy"),
        F.sum(F.col("x") * y).cast("decimal(38,2)").alias("sxy"),
        F.max("month").alias("last_month"),
    )
    seen = fact.groupBy("user_id").agg(F.max(F.col("type") == EXPENSE).alias("has_expenses"))
    t = users.select(F.col("id").alias("user_id")).join(seen, "user_id", "left").join(g, "user_id", "left")
    n = F.col("n")
    two_plus = n >= 2
    pred_num = F.col("sxy") * 6 - F.col("sy") * (F.lit(2) * (n - 1))
    slope_num = F.col("sxy") * 12 - F.col("sy") * (F.lit(6) * (n - 1))
    pred = F.greatest(dbl(pred_num) / (n * (n - 1)).cast("double"), F.lit(0.0))
    status = (F.when(F.col("has_expenses").isNull(), F.lit(INSUFFICIENT))
              .when(~F.col("has_expenses"), F.lit(NO_EXPENSES))
              .when(n.isNull(), F.lit(INVALID_DATES))
              .when(n == 1, F.lit(LIMITED))
              .otherwise(F.lit(PREDICTED)))
    return t.select(
        "user_id",
        status.alias("status"),
        F.when(two_plus, rnd(pred)).when(n == 1, dbl("sy")).otherwise(F.lit(0.0)).alias("predicted_expense"),
        F.when(two_plus, month_label(F.add_months("last_month", 1))).alias("next_month"),
        F.when(two_plus, n).alias("months_used"),
        F.when(two_plus, rnd(dbl(slope_num) / (n * (n * n - 1)).cast("double"))).alias("trend_slope"),
        F.when(two_plus, rnd(dbl("sy") / n.cast("double"))).alias("average_monthly_expense"),
    )
