"""Budgets: defaults, usage, threshold alerts and emit-once crossings
(JOIN1, JOIN4, JOIN7, RUL2, RUL3, RUL7, SNK4-SNK6).

The 7 default categories are a fixed array exploded per user (no join, no
cross join).  Budgets and spend are user-sized tables joined on
(user_id, category); Catalyst/AQE choose the join strategy from their sizes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centwise.functions.columns import div, EXPENSE, MONEY, dbl, fmt, month_label, pct, rnd
from centwise.operators.facts import month_ranks
from centwise.schema import ALERT_EVENTS, CROSSING_THRESHOLDS, DEFAULT_BUDGETS, USAGE_ALERT_RATIO
from centwise.sources import batches

KEY = ["user_id", "category"]
EVENT_KEY = ["user_id", "category", "month", "threshold_percent"]
# Candidates of so few months push their months into the scan of the events.
MONTHS_PUSHED = 24


def _defaults_array(scale: float) -> F.Column:
    return F.array(*[
        F.struct(F.lit(i).alias("idx"), F.lit(c).alias("category"),
                 F.lit(a * scale).cast(MONEY).alias("default_budget"))
        for i, (c, a) in enumerate(DEFAULT_BUDGETS)
    ])


def effective_budgets(users: DataFrame, budgets: DataFrame, default_scale: float = 1.0) -> DataFrame:
    """JOIN4 / SNK5: every user's budgets with defaults filled in for missing
    default categories, plus any extra (non-default) budget rows.

    Output: user_id, category, idx (default order, 99 for extras), monthly_budget, is_default.
    """
    # a user is few bytes and seven budgets: users are spread before they multiply, and the products,
    # whose size Catalyst takes for that of the users, are never broadcast
    u = users.select(F.col("id").alias("user_id")).repartition("user_id").select(
        "user_id", F.explode(_defaults_array(default_scale)).alias("d"))
    u = u.select("user_id", F.col("d.idx").alias("idx"), F.col("d.category").alias("category"),
                 F.col("d.default_budget").alias("default_budget"))
    b = budgets.select("user_id", "category", F.col("monthly_budget").cast(MONEY).alias("b"))
    filled = u.hint("merge").join(b.hint("merge"), KEY, "left").select(
        "user_id", "category", "idx",
        F.coalesce(F.col("b"), F.col("default_budget")).alias("monthly_budget"),
        F.col("b").isNull().alias("is_default"))
    names = [c for c, _ in DEFAULT_BUDGETS]
    extra = budgets.filter(~F.col("category").isin(names)).select(
        "user_id", "category", F.lit(99).alias("idx"), F.col("monthly_budget").cast(MONEY).alias("monthly_budget"),
        F.lit(False).alias("is_default"))
    return filled.unionByName(extra)


def seed_missing_budgets(users: DataFrame, budgets: DataFrame, default_scale: float = 1.0) -> DataFrame:
    """SNK5: rows to insert-if-absent (defaults a user does not have yet)."""
    eff = effective_budgets(users, budgets, default_scale)
    return eff.filter(F.col("is_default")).select("user_id", "category", "monthly_budget")


def month_spend(fact: DataFrame, month_start: dt.date) -> DataFrame:
    return (fact.filter((F.col("type") == EXPENSE) & (F.col("month") == F.lit(month_start)))
            .groupBy(*KEY).agg(F.sum("amount").alias("spent")))


def _with_usage(beff: DataFrame, spend: DataFrame) -> DataFrame:
    j = beff.join(spend, KEY, "left").withColumn("spent", F.coalesce(F.col("spent"), F.lit(0).cast(MONEY)))
    return j.withColumn(
        "ratio", F.when(F.col("monthly_budget") > 0, div("spent", "monthly_budget")).otherwise(F.lit(0.0)))


def budget_alerts(beff: DataFrame, fact: DataFrame, as_of: dt.date,
                  threshold: float = USAGE_ALERT_RATIO) -> DataFrame:
    """RUL2: categories whose as-of-month spend reaches ``threshold`` of budget."""
    m0 = dt.date(as_of.year, as_of.month, 1)
    j = _with_usage(beff, month_spend(fact, m0)).filter(F.col("ratio") >= threshold)
    j = j.withColumn("usage_percent", rnd(F.col("ratio") * 100.0, 1))
    w = Window.partitionBy("user_id").orderBy(F.col("usage_percent").desc(), "idx", "category")
    return j.select(
        "user_id", "category", "idx",
        dbl("monthly_budget").alias("budget"), dbl("spent").alias("spent"), "usage_percent",
        (F.col("ratio") >= 1.0).alias("is_exceeded"),
        # The usage-alert message layout.
        F.concat(F.lit("Alert: You have used "), fmt(F.col("ratio") * 100.0, 1),
                 F.lit("% of your monthly "), F.lower("category"), F.lit(" budget.")).alias("message"),
        F.row_number().over(w).cast("long").alias("rank"),
    )


def budget_usage_latest(beff: DataFrame, fact: DataFrame) -> DataFrame:
    """RUL7: usage of every budget in the user's latest present month."""
    latest = month_ranks(fact).filter(F.col("mrank") == 1).select("user_id", "month")
    spend = (fact.filter(F.col("type") == EXPENSE).join(latest, ["user_id", "month"])
             .groupBy(*KEY).agg(F.sum("amount").alias("spent")))
    j = beff.join(latest, "user_id").join(spend, KEY, "left")
    j = j.withColumn("spent", F.coalesce(F.col("spent"), F.lit(0).cast(MONEY)))
    j = j.withColumn("usage", pct(F.col("spent"), F.col("monthly_budget")))
    j = j.withColumn("usage_percent", rnd("usage"))
    w = Window.partitionBy("user_id").orderBy(F.col("usage_percent").desc(), "idx", "category")
    return j.select(
        "user_id", month_label("month").alias("month"), "category", "idx", dbl("spent").alias("spent"),
        dbl("monthly_budget").alias("budget"), "usage", "usage_percent", F.row_number().over(w).cast("long").alias("rank"))


def crossing_candidates(alerts: DataFrame, as_of: dt.date,
                        thresholds: tuple[int, ...] = CROSSING_THRESHOLDS) -> DataFrame:
    """RUL3: every threshold reached by the one-digit usage percent."""
    c = alerts.select("*", F.explode(F.array(*[F.lit(int(t)) for t in sorted(thresholds)])).alias("threshold_percent"))
    c = c.filter(F.col("usage_percent") >= F.col("threshold_percent"))
    return c.select(
        "user_id", "category", F.lit(as_of.strftime("%Y-%m")).alias("month"), "threshold_percent",
        "usage_percent", "budget", "spent", "idx",
        # The crossing message layout.
        F.concat(F.lit("You crossed "), F.col("threshold_percent").cast("string"), F.lit("% of your monthly "),
                 F.lower("category"), F.lit(" budget ("), fmt("usage_percent", 1), F.lit("% used).")).alias("message"),
    )


def new_crossings(candidates: DataFrame, existing_events: DataFrame) -> DataFrame:
    """SNK6 / JOIN7: candidates not yet emitted (insert-if-absent); the output
    is exactly the 'was_created' set.  Ranked by (threshold, usage) desc."""
    fresh = candidates.dropDuplicates(EVENT_KEY).join(existing_events.select(*EVENT_KEY), EVENT_KEY, "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.col("threshold_percent").desc(), F.col("usage_percent").desc(),
                                              "idx", "category")
    return fresh.withColumn("rank", F.row_number().over(w).cast("long")).drop("idx")


def append_new_events(spark: SparkSession, candidates: DataFrame, events_path: str, batch: int,
                      created_at: dt.datetime | None = None) -> DataFrame:
    """SNK6: insert-if-absent into the batch table of events at ``events_path``, exactly once.

    ``batch`` numbers the run (a day, a micro-batch).  Returns the events that this batch created.  A
    run that died before its commit has left nothing visible and is repeated under its number; the
    repetition of a committed run returns what that run created and writes nothing.  Only earlier
    batches count as existing, and of them only the candidates' months are read."""
    existing = batches.read_batches(spark, events_path, ALERT_EVENTS, before=batch)
    months = [r.month for r in candidates.select("month").distinct().limit(MONTHS_PUSHED + 1).collect()]
    if len(months) <= MONTHS_PUSHED:
        existing = existing.where(F.col("month").isin(months))
    stamp = F.lit(created_at) if created_at else F.current_timestamp()
    fresh = new_crossings(candidates, existing).select(
        "user_id", "category", "month", F.col("threshold_percent").cast("int"), "usage_percent",
        stamp.cast("timestamp").alias("created_at"))
    return batches.write_batch(fresh, events_path, batch)


def apply_budget_updates(budgets: DataFrame, updates: DataFrame) -> DataFrame:
    """SNK4: upsert, last write wins per (user_id, category).

    ``updates`` carries a ``seq`` column; base rows rank before every update.
    """
    base = budgets.select(*KEY, F.col("monthly_budget").cast(MONEY).alias("monthly_budget"),
                          F.lit(-1).cast("long").alias("seq"))
    upd = updates.select(*KEY, F.col("monthly_budget").cast(MONEY).alias("monthly_budget"),
                         F.col("seq").cast("long"))
    # max_by is a partial aggregate: a hot key is combined map-side, never
    # gathered whole into one task.
    return (base.unionByName(upd).groupBy(*KEY)
            .agg(F.max_by("monthly_budget", "seq").alias("monthly_budget")))
