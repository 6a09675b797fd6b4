"""Rule-based suggestions and alerts (RUL4, RUL5, RUL6, RUL9).

Each rule is a filter over a per-user table that is already bounded per user
(monthly fact, top-5 lists, budget rows); rules are unioned and ranked with a
window over that small set.  Messages are built with ``concat`` from rounded
decimals so they read the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centwise.functions.columns import EXPENSE, MONEY, div, fmt, pct, rnd
from centwise.operators.facts import expense_months, month_totals
from centwise.operators.summary import category_increases, top_categories_latest, user_totals


def _with_users(users: DataFrame, t: DataFrame) -> DataFrame:
    """users LEFT JOIN per-user table, with a has_rows flag."""
    return users.select(F.col("id").alias("user_id")).join(t.withColumn("has_rows", F.lit(True)), "user_id", "left")


def _explode_messages(df: DataFrame, messages: list[F.Column]) -> DataFrame:
    arr = F.filter(F.array(*messages), lambda m: m.isNotNull())
    return df.select("user_id", F.posexplode(arr).alias("pos", "message")).select(
        "user_id", (F.col("pos") + 1).cast("long").alias("seq"), "message")


# ---- RUL5 ------------------------------------------------------------------------

def global_suggestions(fact: DataFrame, users: DataFrame) -> DataFrame:
    """RUL5: food above 30 % of income; savings below 20 %; fallbacks.
    Comparisons are exact decimal arithmetic (food*10 > income*3)."""
    t = _with_users(users, user_totals(fact))
    rows = F.col("has_rows").isNotNull()
    inc_ok = rows & (F.col("income") > 0)
    food_hi = inc_ok & (F.coalesce(F.col("food"), F.lit(0).cast(MONEY)) * 10 > F.col("income") * 3)
    save_lo = inc_ok & ((F.col("income") - F.col("expense")) * 5 < F.col("income"))
    # The suggestion texts.
    msgs = [
        F.when(~rows, F.lit("Add transactions to unlock AI suggestions.")),
        F.when(rows & ~inc_ok, F.lit("Add at least one income transaction so AI suggestions can be calculated.")),
        F.when(food_hi, F.lit("Food spending is above 30% of income. Consider reducing dining out.")),
        F.when(save_lo, F.lit("Savings are below 20% of income. Consider setting a stricter budget.")),
        F.when(inc_ok & ~food_hi & ~save_lo,
               F.lit("Your spending and savings pattern looks healthy. Keep tracking consistently.")),
    ]
    return _explode_messages(t, msgs)


# ---- RUL4 ------------------------------------------------------------------------

def _last_two_expense_months(fact: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("month").desc())
    m = expense_months(fact).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    return m.groupBy("user_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("amount"))).alias("cur"),
        F.max(F.when(F.col("rn") == 2, F.col("amount"))).alias("prev"))


def period_suggestions(fact: DataFrame, users: DataFrame) -> DataFrame:
    """RUL4: savings < 20 %; each category > 30 % of income; month-over-month
    expense up > 40 %; top-3 categories line; fallback; empty-data line.

    One row per user carries its totals, its expense categories (one array,
    bounded by the category count) and its last two expense months; the rules
    are ``when`` columns in an array, exploded once in rule order."""
    ut = user_totals(fact).withColumn("has", F.lit(True))
    cats = (fact.filter(F.col("type") == EXPENSE).groupBy("user_id", "category")
            .agg(F.sum("amount").alias("amount"))
            .groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("category", "amount"))).alias("cats")))
    two = _last_two_expense_months(fact)
    base = users.select(F.col("id").alias("user_id")).unionByName(ut.select("user_id")).distinct()
    d = base.join(ut, "user_id", "left").join(cats, "user_id", "left").join(two, "user_id", "left")
    has = F.coalesce(F.col("has"), F.lit(False))
    inc = F.col("income")
    bal = inc - F.col("expense")
    cat_list = F.coalesce(F.col("cats"), F.array().cast("array<struct<category:string,amount:decimal(38,2)>>"))
    # The period-suggestion texts below, in rule order.
    r1 = F.when(has & (inc > 0) & (div(bal, inc) < 0.2), F.concat(
        F.lit("Your savings are "), fmt(rnd(pct(bal, inc)), 1),
        F.lit("% of income. Consider a budget that protects at least 20% for savings.")))
    heavy = F.transform(
        F.filter(cat_list, lambda x: (inc > 0) & (div(x["amount"], inc) > 0.30)),
        lambda x: F.concat(x["category"], F.lit(" spending is taking "), fmt(div(x["amount"], inc) * 100.0, 1),
                           F.lit("% of your income. Review this category for possible cuts.")))
    up = div(F.col("cur") - F.col("prev"), "prev")
    r3 = F.when(has & (F.col("prev") > 0) & (up > 0.40), F.concat(
        F.lit("This month's expenses are up "), fmt(up * 100.0, 1),
        F.lit("% compared to last month. Investigate the categories driving the increase.")))
    by_amount = F.array_sort(cat_list, lambda a, b: F.when(a["amount"] > b["amount"], -1)
                             .when(a["amount"] < b["amount"], 1).when(a["category"] < b["category"], -1)
                             .when(a["category"] > b["category"], 1).otherwise(0))
    names = F.array_join(F.transform(F.slice(by_amount, 1, 3), lambda x: x["category"]), ", ")
    r4 = F.when(F.size(cat_list) > 0, F.concat(
        F.lit("Your top spending categories are "), names,
        F.lit(". Reviewing these first will have the biggest impact.")))
    nonnull = lambda a: F.filter(a, lambda x: x.isNotNull())
    rules = nonnull(F.concat(F.array(r1), heavy, F.array(r3, r4)))
    every = nonnull(F.concat(rules, F.array(
        F.when(has & (F.size(rules) == 0),
               F.lit("Your spending is balanced right now. Continue logging transactions consistently to keep "
                     "insights accurate.")),
        F.when(~has, F.lit("Add income and expense transactions to unlock personalized financial suggestions.")))))
    return d.select("user_id", F.posexplode(every).alias("pos", "message")).select(
        "user_id", (F.col("pos") + 1).cast("long").alias("seq"), "message")


# ---- shared pieces of the financial context --------------------------------------

def latest_two_summaries(fact: DataFrame) -> DataFrame:
    """Per user: latest and previous present month with income / expense."""
    w = Window.partitionBy("user_id").orderBy(F.col("month").desc())
    mt = month_totals(fact).withColumn("mrank", F.row_number().over(w)).filter(F.col("mrank") <= 2)
    return mt.groupBy("user_id").agg(
        F.max(F.when(F.col("mrank") == 1, F.col("month"))).alias("cur_month"),
        F.max(F.when(F.col("mrank") == 1, F.col("income"))).alias("inc"),
        F.max(F.when(F.col("mrank") == 1, F.col("expense"))).alias("exp"),
        F.max(F.when(F.col("mrank") == 2, F.col("month"))).alias("prev_month"),
        F.max(F.when(F.col("mrank") == 2, F.col("income"))).alias("prev_inc"),
        F.max(F.when(F.col("mrank") == 2, F.col("expense"))).alias("prev_exp"),
    )


# ---- RUL6 ------------------------------------------------------------------------

def context_alerts(fact: DataFrame, users: DataFrame, usage: DataFrame) -> DataFrame:
    """RUL6: latest-month expense above 80 % of income; every budget at >= 85 %.

    ``usage`` is ``budgets.budget_usage_latest`` (keeps the unrounded ``usage``).
    One row per user: the latest summary and its high-usage budgets as one
    array in budget order (bounded by the user's budget count); the messages
    are built in order and exploded once."""
    cur = latest_two_summaries(fact).withColumn("has", F.lit(True))
    high = usage.filter((F.col("budget") > 0) & (F.col("usage") >= 85.0)).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "category", "usage", "spent", "budget"))).alias("high"))
    base = users.select(F.col("id").alias("user_id")).unionByName(cur.select("user_id")).distinct()
    d = base.join(cur, "user_id", "left").join(high, "user_id", "left")
    has = F.coalesce(F.col("has"), F.lit(False))
    ratio = div("exp", "inc")
    # The context-alert texts below.
    a1 = F.when(has & (F.col("inc") > 0) & (ratio > 0.8), F.concat(
        F.lit("Current month expenses are "), fmt(ratio * 100.0, 1), F.lit("% of income, above the 80% threshold.")))
    a2 = F.transform(
        F.coalesce(F.col("high"), F.array().cast(
            "array<struct<idx:int,category:string,usage:double,spent:double,budget:double>>")),
        lambda x: F.concat(x["category"], F.lit(" budget is at "), fmt(x["usage"], 1),
                           F.lit("% usage this month (Rs. "), fmt(x["spent"], 2), F.lit(" / Rs. "),
                           fmt(x["budget"], 2), F.lit(").")))
    empty = F.when(~has, F.lit("Add more transactions to unlock personalized insights."))
    msgs = F.filter(F.concat(F.array(a1), a2, F.array(empty)), lambda m: m.isNotNull())
    return d.select("user_id", F.posexplode(msgs).alias("pos", "message")).select(
        "user_id", (F.col("pos") + 1).cast("long").alias("seq"), "message")


# ---- RUL9 ------------------------------------------------------------------------

SUGGESTION = "struct<p:int,o:int,type:string,title:string,message:string>"


def _s(cond: F.Column, priority: int, order, typ: str, title, message) -> F.Column:
    """One suggestion as a struct, or NULL when its rule does not fire."""
    return F.when(cond, F.struct(F.lit(priority).alias("p"), F.lit(order).cast("int").alias("o")
                                 if isinstance(order, int) else order.cast("int").alias("o"),
                                 F.lit(typ).alias("type"), (F.lit(title) if isinstance(title, str) else title)
                                 .alias("title"), (F.lit(message) if isinstance(message, str) else message)
                                 .alias("message")))


def personalized_suggestions(fact: DataFrame, users: DataFrame, usage: DataFrame, k: int = 5) -> DataFrame:
    """RUL9: prioritised savings suggestions for the latest present month, at most k.

    All inputs are per-user and bounded (latest/previous month summary, the
    top-5 shares, the top-5 increases as one array, the top budget usage), so
    they are joined into one row per user; every rule is a ``when`` producing a
    struct, the rules are sorted by (priority desc, append order) inside the
    array, and one ``posexplode`` emits the ranked rows."""
    cur = latest_two_summaries(fact).withColumn("has", F.lit(True))
    top = top_categories_latest(fact, 5)
    shares = top.groupBy("user_id").agg(
        F.max(F.when(F.col("category") == "Food", F.col("share_of_current_expense"))).alias("food"),
        F.max(F.when(F.col("category") == "Shopping", F.col("share_of_current_expense"))).alias("shopping"),
        F.max(F.when(F.col("category") == "Entertainment", F.col("share_of_current_expense"))).alias("entertainment"))
    incs = category_increases(fact, 5).groupBy("user_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "category", "previous", "current", "change_percent"))).alias("incs"))
    hb = usage.filter(F.col("rank") == 1).select("user_id", F.col("category").alias("hb_cat"),
                                                  F.col("usage_percent").alias("hb_usage"))
    base = users.select(F.col("id").alias("user_id")).unionByName(cur.select("user_id")).distinct()
    d = (base.join(cur, "user_id", "left").join(shares, "user_id", "left").join(incs, "user_id", "left")
         .join(hb, "user_id", "left"))
    has = F.coalesce(F.col("has"), F.lit(False))
    inc, exp = F.col("inc"), F.col("exp")
    sr = rnd(pct(inc - exp, inc))
    er = div(exp, inc)
    inc_list = F.coalesce(F.col("incs"), F.array().cast(
        "array<struct<rank:bigint,category:string,previous:double,current:double,change_percent:double>>"))
    # The suggestion priorities, types, titles and texts below, in append order.
    rising = F.transform(F.filter(inc_list, lambda x: x["change_percent"] > 20.0), lambda x: F.struct(
        F.lit(80).alias("p"), x["rank"].cast("int").alias("o"), F.lit("warning").alias("type"),
        F.concat(x["category"], F.lit(" Is Rising")).alias("title"),
        F.concat(x["category"], F.lit(" increased by "), fmt(x["change_percent"], 1),
                 F.lit("% versus last month (Rs. "), fmt(x["previous"], 2), F.lit(" to Rs. "),
                 fmt(x["current"], 2), F.lit(")."))
        .alias("message")))
    transport = F.try_element_at(F.filter(inc_list, lambda x: F.lower(x["category"]) == "transport"), F.lit(1))
    discretionary = "% of this month's expenses. Set a tighter weekly cap for discretionary purchases."
    head = F.array(
        _s(has & (inc > 0) & (sr < 20), 100, 0, "warning", "Low Savings Rate",
           F.concat(F.lit("Your savings this month are "), fmt(sr, 1),
                    F.lit("% of income. Set a target of at least 20% and cap non-essential spending."))),
        _s(has & (inc > 0) & (er > 0.8), 95, 0, "danger", "Overspending Risk",
           F.concat(F.lit("Expenses are "), fmt(er * 100.0, 1),
                    F.lit("% of your income this month. Delay optional purchases until savings recover."))),
        _s(has & (inc > 0) & (F.col("food") > 30.0), 90, 0, "warning", "High Food Spending",
           F.concat(F.lit("Food spending is "), fmt("food", 1),
                    F.lit("% of your current month expenses. Consider reducing restaurant and delivery orders."))),
    )
    tail = F.array(
        _s(has & (F.col("shopping") >= 18.0), 75, 0, "info", "Discretionary Spend Check",
           F.concat(F.lit("Shopping is "), fmt("shopping", 1), F.lit(discretionary))),
        _s(has & (F.col("entertainment") >= 18.0), 75, 1, "info", "Discretionary Spend Check",
           F.concat(F.lit("Entertainment is "), fmt("entertainment", 1), F.lit(discretionary))),
        _s(has & transport.isNotNull() & (transport["change_percent"] > 10.0), 70, 0, "info",
           "Transport Cost Optimization",
           F.concat(F.lit("Transport spending rose "), fmt(transport["change_percent"], 1),
                    F.lit("% month-over-month. Try route clustering, ride sharing, or public transport passes."))),
        _s(has & (F.col("hb_usage") >= 90.0), 88, 0, "danger", "Budget Limit Near",
           F.concat(F.col("hb_cat"), F.lit(" has used "), fmt("hb_usage", 1),
                    F.lit("% of this month's budget. Reduce spend in this category to avoid crossing the limit."))),
    )
    nonnull = lambda a: F.filter(a, lambda x: x.isNotNull())
    rules = nonnull(F.concat(head, rising, tail))
    delta = div(F.col("exp") - F.col("prev_exp"), "prev_exp") * 100.0
    s50 = _s(has & (F.size(rules) == 0) & F.col("prev_month").isNotNull() & (inc > 0) & (F.col("prev_exp") > 0)
             & (delta <= 0), 50, 0, "success", "Good Spending Control",
             F.concat(F.lit("Expenses are down by "), fmt(F.abs(delta), 1),
                      F.lit("% compared to last month. Keep this pattern to grow savings.")))
    found = nonnull(F.concat(rules, F.array(s50)))
    fallback = F.array(
        _s(has & (F.size(found) == 0), 0, 0, "success", "Stable Month",
           "Your spending pattern looks balanced this month. Keep tracking transactions regularly."),
        _s(~has, 0, 0, "info", "Need More Data",
           "Add income and expense transactions to unlock personalized saving suggestions."))
    every = nonnull(F.concat(found, fallback))
    ranked = F.slice(F.array_sort(every, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1)
                                  .when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), 1, k)
    out = d.select("user_id", F.posexplode(ranked).alias("pos", "s"))
    return out.select("user_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("s.p").alias("priority"),
                      F.col("s.type").alias("type"), F.col("s.title").alias("title"),
                      F.col("s.message").alias("message"))


# ---- DSH1 ------------------------------------------------------------------------

def dashboard(tx: DataFrame | None, fact: DataFrame, users: DataFrame, beff: DataFrame, usage: DataFrame,
              as_of, recent: DataFrame | None = None, newest: DataFrame | None = None) -> DataFrame:
    """DSH1: one row per user: the summary, the forecast, and as JSON text the whole lists of
    overspending alerts, suggestions, saving actions (5 by their rule), budget alerts and the
    latest 5 transactions; the head of each list also as a column of its own.

    Every part is user-sized and built from the shared monthly fact, so the
    fact's exchange is reused across branches instead of re-scanning.  With ``newest`` (the
    ranked rows of ``latest.latest_transactions``) no raw row is read; else they come from ``tx``."""
    from centwise.operators import budgets as bud
    from centwise.operators import forecast as fc
    from centwise.operators import summary as sm

    def listed(df: DataFrame, order: str, fields: list[str], name: str, *heads: F.Column) -> DataFrame:
        s = F.struct(F.col(order).alias("_o"), *fields)
        rows = F.transform(F.array_sort(F.collect_list(s)), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
        return df.groupBy("user_id").agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias(name), *heads)

    s = sm.user_summary(fact, users)
    alerts = listed(sm.category_overspend_alerts(fact, as_of), "category",
                    ["category", "current_total", "six_month_average", "increase_percent", "message"],
                    "overspend_alerts", F.min_by("message", "category").alias("overspend_alert"))
    general = listed(global_suggestions(fact, users), "seq", ["message"], "suggestions",
                     F.min_by("message", "seq").alias("suggestion"))
    actions = listed(personalized_suggestions(fact if recent is None else recent, users, usage), "rank",
                     ["priority", "type", "title", "message"], "saving_actions",
                     F.min_by("title", "rank").alias("top_saving_action"))
    f = fc.expense_forecast(fact, users).withColumnRenamed("status", "forecast_status")
    ba = listed(bud.budget_alerts(beff, fact, as_of), "rank",
                ["category", "budget", "spent", "usage_percent", "is_exceeded", "message"], "budget_alerts",
                F.count(F.lit(1)).alias("budget_alert_count"), F.min_by("category", "rank").alias("top_budget_alert"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    latest = listed(sm.latest_transactions(tx, 5) if newest is None else newest, "rank", ["id", "amount", "category", "type", "description", "date"],
                    "recent_transactions", F.array_join(ids, ",").alias("recent_ids"))
    d = (s.join(alerts, "user_id", "left").join(general, "user_id", "left").join(actions, "user_id", "left")
         .join(f, "user_id", "left").join(ba, "user_id", "left").join(latest, "user_id", "left"))
    none = lambda c: F.coalesce(F.col(c), F.lit("[]")).alias(c)
    return d.select(
        "user_id", "total_income", "total_expenses", "balance", "savings_rate",
        F.when(F.col("total_income") > 0, rnd(div("total_expenses", "total_income") * 100.0))
        .otherwise(F.lit(0.0)).alias("expense_ratio"),
        F.col("overspend_alert").isNotNull().alias("is_overspending"),
        # The dashboard fallback message.
        F.coalesce(F.col("overspend_alert"),
                   F.lit("Your category-wise spending is currently within expected levels.")).alias("overspending_message"),
        "suggestion", "top_saving_action", "predicted_expense", "forecast_status",
        F.coalesce(F.col("budget_alert_count"), F.lit(0)).alias("budget_alert_count"),
        "top_budget_alert", F.coalesce(F.col("recent_ids"), F.lit("")).alias("recent_ids"),
        "next_month", "months_used", "trend_slope", "average_monthly_expense",
        none("overspend_alerts"), none("suggestions"), none("saving_actions"), none("budget_alerts"),
        none("recent_transactions"),
    )
