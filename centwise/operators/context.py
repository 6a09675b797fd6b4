"""Nested per-user outputs: the financial context (CTX1) and the chart payload
(CHT1).  Every array is built from a part that is bounded per user (top-5
lists, present months, budget rows), never from raw transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centwise.functions.columns import dbl, month_label, pct, rnd
from centwise.operators import forecast as fc
from centwise.operators import insights as ins
from centwise.operators import summary as sm
from centwise.operators.facts import month_totals
from centwise.session import materialize


def _summary_struct(inc: str, exp: str) -> F.Column:
    bal = F.col(inc) - F.col(exp)
    return F.struct(dbl(inc).alias("total_income"), dbl(exp).alias("total_expense"), dbl(bal).alias("balance"),
                    rnd(pct(bal, F.col(inc))).alias("savings_rate"))


def _sorted_list(df: DataFrame, key: str, order: list[F.Column], fields: list[str], name: str) -> DataFrame:
    """collect a bounded per-user list in a fixed order (sort key first, then dropped)."""
    s = F.struct(*[o.alias(f"_k{i}") for i, o in enumerate(order)], *[F.col(c) for c in fields])
    return df.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(s)), lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias(name))


def financial_context(fact: DataFrame, users: DataFrame, usage: DataFrame, alerts: DataFrame,
                      recent: DataFrame | None = None) -> DataFrame:
    """CTX1: one row per user with the nested context and its JSON text.
    ``recent`` (optional): the latest-two-months slice for the month-local parts."""
    recent = fact if recent is None else recent
    ut = sm.user_totals(fact)
    lt = ins.latest_two_summaries(recent)
    mt = month_totals(fact)
    top = _sorted_list(sm.top_categories_latest(recent, 5), "user_id", [F.col("rank")],
                       ["category", "amount", "share_of_current_expense"], "top_categories")
    trend = _sorted_list(mt.select("user_id", month_label("month").alias("month"), dbl("expense").alias("amount")),
                         "user_id", [F.col("month")], ["month", "amount"], "monthly_spending_trend")
    # entries sorted by month, so the map (and its JSON) has one fixed key order
    by_month = mt.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        month_label("month"), _summary_struct("income", "expense"))))).alias("monthly_summary_by_month"))
    incs = _sorted_list(sm.category_increases(recent, 5), "user_id", [F.col("rank")],
                        ["category", "previous", "current", "change_percent"], "categories_increased")
    al = _sorted_list(alerts, "user_id", [F.col("seq")], ["message"], "alerts").select(
        "user_id", F.transform("alerts", lambda x: x["message"]).alias("overspending_alerts"))
    bu = _sorted_list(usage, "user_id", [F.col("rank")], ["category", "spent", "budget", "usage_percent"],
                      "budget_usage")
    d = (users.select(F.col("id").alias("user_id")).join(ut, "user_id", "left").join(lt, "user_id", "left")
         .join(top, "user_id", "left").join(trend, "user_id", "left").join(by_month, "user_id", "left")
         .join(incs, "user_id", "left").join(al, "user_id", "left").join(bu, "user_id", "left"))
    has = F.col("cur_month").isNotNull()
    empty = lambda c: F.coalesce(F.col(c), F.array())
    ctx = F.struct(
        F.lit("Rs").alias("currency"),
        _summary_struct("income_z", "expense_z").alias("overall"),
        F.when(has, F.struct(month_label("cur_month").alias("period"), _summary_struct("inc", "exp").alias("summary")))
        .alias("current_month"),
        F.when(F.col("prev_month").isNotNull(), F.struct(month_label("prev_month").alias("period"),
                                                         _summary_struct("prev_inc", "prev_exp").alias("summary")))
        .alias("previous_month"),
        empty("top_categories").alias("top_categories"),
        empty("monthly_spending_trend").alias("monthly_spending_trend"),
        F.coalesce(F.col("monthly_summary_by_month"), F.create_map()).alias("monthly_summary_by_month"),
        empty("categories_increased").alias("categories_increased"),
        empty("overspending_alerts").alias("overspending_alerts"),
        empty("budget_usage").alias("budget_usage"),
    )
    d = d.withColumn("income_z", F.coalesce("income", F.lit(0).cast("decimal(18,2)"))) \
         .withColumn("expense_z", F.coalesce("expense", F.lit(0).cast("decimal(18,2)")))
    return d.select("user_id", ctx.alias("context")).withColumn(
        "context_json", F.to_json("context", {"ignoreNullFields": "false"}))


def _payload(d: DataFrame, *keys: str) -> DataFrame:
    """The payload struct and its JSON text from the joined parts."""
    payload = F.struct(
        F.struct("total_income", "total_expenses", "balance", "savings_rate").alias("summary"),
        F.struct("predicted_expense", "status", "next_month", "months_used").alias("prediction"),
        F.coalesce("category_distribution", F.array()).alias("category_distribution"),
        F.coalesce("monthly_spending", F.array()).alias("monthly_spending"),
        F.coalesce("savings_vs_expenses", F.array()).alias("savings_vs_expenses"),
    )
    return d.select(*keys, payload.alias("payload")).withColumn(
        "payload_json", F.to_json("payload", {"ignoreNullFields": "false"}))


def _spending_parts(fact: DataFrame, users: DataFrame) -> DataFrame:
    """Summary, category distribution and monthly spending of each row of ``users``."""
    own = fact.repartition("user_id")                      # each list costs one shuffle, the joins none
    cd = _sorted_list(sm.category_distribution(own), "user_id", [F.col("rank")], ["category", "amount"],
                      "category_distribution")
    ms = _sorted_list(sm.monthly_spending(own), "user_id", [F.col("month")], ["month", "amount"], "monthly_spending")
    return sm.user_summary(fact, users).join(cd, "user_id", "left").join(ms, "user_id", "left")


def _savings(fact: DataFrame, months: int, name: str = "savings_vs_expenses") -> DataFrame:
    return _sorted_list(sm.income_expense_savings(fact, months), "user_id", [F.col("month")],
                        ["month", "income", "expense", "savings"], name)


def chart_payload(fact: DataFrame, users: DataFrame, compare_months: int = 3) -> DataFrame:
    """CHT1: summary, forecast, category distribution, monthly spending and the
    income / expense / savings comparison over the last N data months."""
    d = (_spending_parts(fact, users).join(fc.expense_forecast(fact, users), "user_id", "left")
         .join(_savings(fact, compare_months), "user_id", "left"))
    return _payload(d, "user_id")


def chart_payloads(fact: DataFrame, requests: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """CHT1 / SNK11 per request: spending of the request's month or year (of all history where
    the request names no report type), the comparison over its user's last 1 or 3 data months,
    the forecast over all of the user's history.  A period of a user is added up once, however many
    requests ask for it; requests meet it by (user, period), the rest by user."""
    from centwise.operators.reports import normalize_requests
    spark, whole = requests.sparkSession, F.coalesce("report_type", F.lit("")) == ""
    reqs = normalize_requests(requests.withColumn("request_id", F.struct("request_id", whole.alias("whole"))), as_of)
    span = (F.when(F.col("request_id.whole"), F.lit("")).when(F.col("report_type") == "yearly", F.col("year"))
            .otherwise(F.col("month_start").cast("string")))
    reqs = materialize(spark, reqs.select("request_id.request_id", "user_id", "compare_range",
                                          F.struct("user_id", span.alias("span")).alias("scope")), "requests")
    repeated = materialize(spark, reqs.groupBy("request_id").count().where("count > 1").select("request_id"), "repeated_requests")
    once = reqs.where(F.col("request_id").isNotNull()).join(repeated, "request_id", "left_anti")

    asked = once.groupBy("user_id").agg(F.collect_set("scope.span").alias("asked"))
    spans = F.array_intersect("asked", F.array(F.lit(""), F.year("month").cast("string"), F.col("month").cast("string")))
    # each user's rows lie together, with the periods that ask for them and the user's latest month
    fact = materialize(spark, fact.where(F.col("user_id").isNotNull()).repartition("user_id").join(asked, "user_id", "left")
                       .withColumn("spans", spans).drop("asked")
                       .withColumn("latest_month", F.max("month").over(Window.partitionBy("user_id"))), "scoped_fact")
    scoped = fact.withColumn("span", F.explode("spans")).withColumn("user_id", F.struct("user_id", "span")).drop("span", "spans", "latest_month")
    parts = _spending_parts(scoped, once.select(F.col("scope").alias("id")).distinct()).withColumnRenamed("user_id", "scope")
    recent = fact.where(F.col("month") > F.add_months("latest_month", -3)).drop("spans", "latest_month")
    fact = fact.drop("spans", "latest_month")
    out = _payload(_with_history(once, fact, recent, users).join(parts, "scope"), "request_id", "user_id")
    if not repeated.isEmpty():
        out = out.unionByName(_repeated_payloads(fact, recent, requests.join(repeated, "request_id", "left_semi"), users, as_of))
    return out


def _with_history(reqs: DataFrame, fact: DataFrame, recent: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with their user's forecast and the months they compare with (``recent``: the last three)."""
    d = (reqs.join(fc.expense_forecast(fact, users), "user_id", "left")
         .join(_savings(recent, 1, "last_1"), "user_id", "left").join(_savings(recent, 3, "last_3"), "user_id", "left"))
    return d.withColumn("savings_vs_expenses", F.when(F.col("compare_range") == "last_month", F.col("last_1"))
                        .otherwise(F.col("last_3"))).drop("last_1", "last_3")


def _repeated_payloads(fact: DataFrame, recent: DataFrame, requests: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """The payloads of requests whose id comes more than once: all rows of an id share one scope."""
    from centwise.operators.reports import normalize_requests
    whole = requests.select("request_id", (F.coalesce("report_type", F.lit("")) == "").alias("whole"))
    reqs = normalize_requests(requests, as_of).join(whole, "request_id")
    part = lambda cond, *cols: reqs.filter(cond).select("request_id", "user_id", *cols)
    yearly = F.col("report_type") == "yearly"
    years = fact.withColumn("year", F.year("month").cast("string"))
    cols = ["request_id", "month", "type", "category", "amount", "n_tx"]
    scoped = (fact.join(part(F.col("whole")), "user_id").select(*cols)
              .unionByName(fact.join(part(~F.col("whole") & ~yearly, F.col("month_start").alias("month")),
                                     ["user_id", "month"]).select(*cols))
              .unionByName(years.join(part(~F.col("whole") & yearly, "year"), ["user_id", "year"]).select(*cols))
              .withColumnRenamed("request_id", "user_id"))
    parts = _spending_parts(scoped, reqs.select(F.col("request_id").alias("id"))).withColumnRenamed("user_id", "request_id")
    d = _with_history(reqs.select("request_id", "user_id", "compare_range"), fact, recent, users).join(parts, "request_id")
    return _payload(d, "request_id", "user_id")
