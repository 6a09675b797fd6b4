"""Registered queries over tables that live: batches, merges, versions, sinks and streams.

Each writes its table under the shared folder, changes it as a job would, and returns what a reader
then sees.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centwise.functions.columns import MONEY
from centwise.operators import budgets as bud
from centwise.operators import categorize as cat
from centwise.operators import changes as chg
from centwise.operators import clean as cln
from centwise.operators import facts
from centwise.operators import insights as ins
from centwise.operators import latest
from centwise.operators import model_store as store
from centwise.operators import reports as rep
from centwise.schema import ALERT_EVENTS
from centwise.session import materialize, shared_path
from centwise.sources import batches
from centwise.sources import files as fls
from centwise.sources import testdata as td

AS_OF = td.SCALE_AS_OF
MID_MONTH = dt.date(2001, 1, 15)
BUCKETS = 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def month_candidates(spark: SparkSession, sf_dir: str, beff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crossing candidates of the as-of month, by its middle and by its end.  One aggregate gives
    both sums; it is written once, both runs read it."""
    tx = facts.filter_range(td.transactions_full(spark, sf_dir), facts.month_start(AS_OF), facts.month_start(AS_OF, 1))
    both = materialize(spark, tx.groupBy("user_id", "month", "type", "category").agg(
        F.sum("amount").alias("amount"),
        F.sum(F.when(F.col("date") <= F.lit(MID_MONTH), F.col("amount"))).alias("mid")), "month_fact")
    mid_fact = both.filter(F.col("mid").isNotNull()).withColumn("amount", F.col("mid"))
    return (bud.crossing_candidates(bud.budget_alerts(beff, mid_fact, AS_OF), AS_OF),
            bud.crossing_candidates(bud.budget_alerts(beff, both, AS_OF), AS_OF))


def default_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bud.effective_budgets(td.users(spark, sf_dir), td.budgets(spark, sf_dir), default_scale=5)


@register("crossing_events")
def q_crossing_events(spark, sf_dir):
    """SNK6: the event table after a mid-month run, a month-end run and a repetition of that run."""
    path = shared_path(spark, "alert_events")
    mid, end = month_candidates(spark, sf_dir, default_budgets(spark, sf_dir))
    for batch, found, at in ((1, mid, MID_MONTH), (2, end, AS_OF), (2, end, AS_OF)):
        bud.append_new_events(spark, found, path, batch, dt.datetime(at.year, at.month, at.day))
    return batches.read_batches(spark, path, ALERT_EVENTS).select(
        "user_id", "category", "month", "threshold_percent", "usage_percent",
        F.date_format("created_at", "yyyy-MM-dd").alias("created"), "batch")


def changes_by_day(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """``order_changes`` as they come on three days: edits of the first lines, of later lines, the
    rest with the deletions.  A later edit of an order is never on an earlier day."""
    ch = materialize(spark, td.order_changes(spark, sf_dir), "order_changes")
    line = F.col("seq") % 10
    day = F.when((line == 0) | (line > 4), 3).when(line > 2, 2).otherwise(1)
    return [ch.where(day == d) for d in (1, 2, 3)]


@register("merged_transactions")
def q_merged_transactions(spark, sf_dir):
    """SNK2 + SNK3: a bucketed table after three days of merged changes."""
    path = shared_path(spark, "transactions")
    chg.write_buckets(td.transactions_orders(spark, sf_dir), path, BUCKETS)
    for day in changes_by_day(spark, sf_dir):
        chg.merge_changes(spark, path, day, BUCKETS)
    return chg.read_buckets(spark, path).select(
        "id", "user_id", F.col("amount").cast("double").alias("amount"), "category", "type", "description",
        F.date_format("date", "yyyy-MM-dd").alias("date"))


@register("stored_transaction_lookup")
def q_stored_transaction_lookup(spark, sf_dir):
    """SRC2: the rows behind the deletions, from the stored table."""
    path = shared_path(spark, "transactions")
    chg.write_buckets(td.transactions_orders(spark, sf_dir), path, BUCKETS)
    keys = td.order_changes(spark, sf_dir).where(F.col("op") == "D")
    return chg.lookup_buckets(spark, path, keys, BUCKETS).select(
        "id", "user_id", F.col("amount").cast("double").alias("amount"), "category", "type", "description",
        F.date_format("date", "yyyy-MM-dd").alias("date"))


@register("reference_violations")
def q_reference_violations(spark, sf_dir):
    """VAL5: keys of transactions, budgets, events, requests and questions that no user has."""
    customers = td.users(spark, sf_dir)
    tables = {"transactions": td.transactions_orders(spark, sf_dir), "budgets": td.budgets(spark, sf_dir),
              "events": td.event_transactions(spark, sf_dir), "report_requests": td.report_requests(spark, sf_dir),
              "questions": td.questions(spark, sf_dir), "sign_ups": td.raw_users(spark, sf_dir).withColumnRenamed("id", "user_id")}
    return cln.violations(tables, customers)


@register("monthly_fact_kept")
def q_monthly_fact_kept(spark, sf_dir):
    """The stored monthly fact after three days of changes, each added as its deltas and the first
    two folded into a base; the table itself is merged beside it."""
    table, path = shared_path(spark, "transactions"), shared_path(spark, "fact")
    tx = td.transactions_orders(spark, sf_dir)
    chg.write_buckets(tx, table, BUCKETS)
    batches.write_batch(facts.monthly_fact(tx).select(facts.FACT.names), path, 0)
    for day, changes in enumerate(changes_by_day(spark, sf_dir), 1):
        # deltas first: once they are committed, a repeated day only repeats the merge
        net = materialize(spark, chg.net_changes(changes), "net_changes")
        batches.write_batch(facts.fact_deltas(chg.net_row_changes(chg.read_buckets(spark, table), net)), path, day)
        chg.merge_changes(spark, table, changes, BUCKETS, net)
        if day == 2:
            batches.fold(spark, path, facts.FACT, facts.FACT_KEYS, facts.FACT_TOTALS)
    return facts.stored_fact(spark, path).select(
        "user_id", F.date_format("month", "yyyy-MM").alias("month"), "type", "category",
        F.col("amount").cast("double").alias("amount"), "n_tx")


def kept_tables(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The paths of the kept monthly fact and of the kept newest rows after three days of changes."""
    table, fact, newest = (shared_path(spark, x) for x in ("transactions", "fact", "newest"))
    tx = td.transactions_orders(spark, sf_dir)
    chg.write_buckets(tx, table, BUCKETS)
    batches.write_batch(facts.monthly_fact(tx).select(facts.FACT.names), fact, 0)
    latest.begin(tx, newest)
    for day, changes in enumerate(changes_by_day(spark, sf_dir), 1):
        now = chg.read_buckets(spark, table)
        net = materialize(spark, chg.net_changes(changes), "net_changes")
        delta = materialize(spark, chg.net_row_changes(now, net), "row_changes")
        batches.write_batch(facts.fact_deltas(delta), fact, day)
        latest.update(now, changes, newest, day, delta=delta)
        chg.merge_changes(spark, table, changes, BUCKETS, net)
    return fact, newest


@register("latest_transactions_kept")
def q_latest_transactions_kept(spark, sf_dir):
    """TOP1: the newest 5 rows a user from the kept states, after three days of changes."""
    return latest.latest_transactions(latest.stored(spark, kept_tables(spark, sf_dir)[1]), 5)


@register("dashboard_kept")
def q_dashboard_kept(spark, sf_dir):
    """DSH1 after three days of changes, from the kept fact and the kept newest rows alone."""
    fact_path, newest = kept_tables(spark, sf_dir)
    fact = materialize(spark, facts.stored_fact(spark, fact_path), "monthly_fact")
    recent = materialize(spark, facts.latest_months_slice(fact, 2), "recent_fact")
    beff = default_budgets(spark, sf_dir)
    return ins.dashboard(None, fact, td.users(spark, sf_dir), beff, bud.budget_usage_latest(beff, recent), AS_OF, recent=recent,
                         newest=latest.latest_transactions(latest.stored(spark, newest), 5))


@register("budgets_seeded")
def q_budgets_seeded(spark, sf_dir):
    """SNK5: insert-if-absent of the default budgets into the stored budgets, run twice."""
    path, users = shared_path(spark, "budgets"), td.users(spark, sf_dir)
    stored = batches.write_batch(td.budgets(spark, sf_dir), path, 0)
    for batch in (1, 2):
        now = batches.read_batches(spark, path, stored.schema).drop("batch")
        batches.write_batch(bud.seed_missing_budgets(users, now, 5).select(stored.columns), path, batch)
    return batches.read_batches(spark, path, stored.schema).select(
        "user_id", "category", F.col("monthly_budget").cast(MONEY).cast("double").alias("monthly_budget"), "batch")


@register("model_life_cycle")
def q_model_life_cycle(spark, sf_dir):
    """SRC6, SET1, SRC9, SNK12, ML8: a model is trained on a seed CSV and saved; the users' own rows make
    it stale, it is retrained from both and saved; loaded, it categorises the edits' descriptions."""
    path, seed = shared_path(spark, "model"), shared_path(spark, "seed")
    td.seed_rows(spark, sf_dir).write.option("header", True).csv(seed)
    store.add_rows(spark, path, cat.training_frame(fls.read_training_csv(spark, seed), None), 1)
    store.load_or_retrain(spark, path)
    own = td.transactions_orders(spark, sf_dir).where(F.col("type") == "Expense")
    store.add_rows(spark, path, cat.training_frame(None, own), 2)
    store.load_or_retrain(spark, path)
    edits = td.order_changes(spark, sf_dir).where(F.col("op") == "U").select(F.col("seq").alias("doc_id"), "description")
    names = td.seed_rows(spark, sf_dir, "p_partkey").select((-F.col("p_partkey")).alias("doc_id"), "description")
    return cat.auto_categorize(spark, store.load(spark, path), edits.distinct().unionByName(names))


@register("report_files")
def q_report_files(spark, sf_dir):
    """SNK8 + SNK9: every requested report written as a file of its name, read back as bytes."""
    path = shared_path(spark, "reports")
    rep.write_reports(rep.report_lines(td.transactions_full(spark, sf_dir), td.report_requests(spark, sf_dir),
                                       td.users(spark, sf_dir), AS_OF, spark=spark), path)
    return rep.read_report_files(spark, path).select(
        "request_id", "file_name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
