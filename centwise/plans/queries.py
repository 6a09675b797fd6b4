"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads whole tables from ``sf_dir`` through ``centwise.sources.testdata``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as _F

from centwise.functions.columns import rnd as _rnd
from centwise.operators import budgets as bud
from centwise.operators import categorize as cat
from centwise.operators import changes as chg
from centwise.operators import clean as cln
from centwise.operators import context as ctxm
from centwise.operators import facts, summary
from centwise.operators import forecast as fc
from centwise.operators import insights as ins
from centwise.operators import notify as ntf
from centwise.operators import questions as qna
from centwise.operators import reports as rep
from centwise.plans import table_queries as tbl
from centwise.sources import files as fls
from centwise.sources import testdata as td
from centwise.streaming import crossings as crs
from centwise.streaming import runner as srun

AS_OF = td.SCALE_AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(tbl.QUERIES)


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _fact(spark, sf_dir):
    return facts.monthly_fact(td.transactions_full(spark, sf_dir))


def _as_of_fact(spark, sf_dir, months: int = 1):
    """The fact of the ``months`` months that end with the as-of month."""
    tx = facts.filter_range(td.transactions_full(spark, sf_dir), facts.month_start(AS_OF, 1 - months),
                            facts.month_start(AS_OF, 1))
    return facts.monthly_fact(tx)


def _shared_fact(spark, sf_dir):
    """The monthly fact written once for jobs whose many branches all read it."""
    from centwise.session import materialize
    return materialize(spark, _fact(spark, sf_dir), "monthly_fact")


def _recent(spark, fact):
    """Each user's two latest present months of the fact, written once."""
    from centwise.session import materialize
    return materialize(spark, facts.latest_months_slice(fact, 2), "recent_fact")


@register("user_summary")
def q_user_summary(spark, sf_dir):
    return summary.user_summary(_fact(spark, sf_dir), td.users(spark, sf_dir))


@register("monthly_summary")
def q_monthly_summary(spark, sf_dir):
    return summary.monthly_summary(_fact(spark, sf_dir))


@register("monthly_spending")
def q_monthly_spending(spark, sf_dir):
    return summary.monthly_spending(_fact(spark, sf_dir))


@register("category_distribution")
def q_category_distribution(spark, sf_dir):
    return summary.category_distribution(_fact(spark, sf_dir))


@register("avg_monthly_expense")
def q_avg_monthly_expense(spark, sf_dir):
    return summary.avg_monthly_expense(_fact(spark, sf_dir))


@register("report_years")
def q_report_years(spark, sf_dir):
    return summary.report_years(_fact(spark, sf_dir), td.users(spark, sf_dir), AS_OF)


@register("yearly_trend_zero_filled")
def q_yearly_trend(spark, sf_dir):
    fact = _fact(spark, sf_dir)
    return summary.yearly_trend(fact, summary.report_years(fact, td.users(spark, sf_dir), AS_OF))


@register("income_expense_savings")
def q_income_expense_savings(spark, sf_dir):
    return summary.income_expense_savings(_fact(spark, sf_dir), 3)


@register("overspend_ratio")
def q_overspend_ratio(spark, sf_dir):
    return summary.overspend_ratio(_fact(spark, sf_dir), td.users(spark, sf_dir))


@register("latest_transactions")
def q_latest_transactions(spark, sf_dir):
    return summary.latest_transactions(td.transactions_orders(spark, sf_dir), 5)


@register("top_categories")
def q_top_categories(spark, sf_dir):
    return summary.top_categories(_fact(spark, sf_dir), 3)


@register("top_categories_latest")
def q_top_categories_latest(spark, sf_dir):
    return summary.top_categories_latest(_fact(spark, sf_dir), 5)


@register("top_categories_by_month")
def q_top_categories_by_month(spark, sf_dir):
    return summary.top_categories_by_month(_fact(spark, sf_dir), 5)


@register("highest_month")
def q_highest_month(spark, sf_dir):
    return summary.highest_month(_fact(spark, sf_dir))


@register("mom_change")
def q_mom_change(spark, sf_dir):
    return summary.mom_change(_fact(spark, sf_dir))


@register("category_increases")
def q_category_increases(spark, sf_dir):
    return summary.category_increases(_fact(spark, sf_dir), 5)


@register("category_overspend_alerts")
def q_category_overspend_alerts(spark, sf_dir):
    return summary.category_overspend_alerts(_as_of_fact(spark, sf_dir, 7), AS_OF)


# ---- budgets (JOIN4, RUL2, RUL3, RUL7, SNK5, SNK6) ---------------------------------

_beff = tbl.default_budgets


@register("budgets_with_defaults")
def q_budgets_with_defaults(spark, sf_dir):
    b = _beff(spark, sf_dir)
    return b.select("user_id", "category", _F.col("monthly_budget").cast("double").alias("monthly_budget"),
                    "is_default")


@register("budget_alerts")
def q_budget_alerts(spark, sf_dir):
    return bud.budget_alerts(_beff(spark, sf_dir), _as_of_fact(spark, sf_dir), AS_OF).drop("idx")


@register("budget_usage_latest")
def q_budget_usage_latest(spark, sf_dir):
    return bud.budget_usage_latest(_beff(spark, sf_dir), _fact(spark, sf_dir)).drop("idx", "usage")


@register("budget_crossings_new")
def q_budget_crossings_new(spark, sf_dir):
    """Crossings at month end that the mid-month run (data up to the 15th) had not emitted."""
    earlier, now = tbl.month_candidates(spark, sf_dir, _beff(spark, sf_dir))
    return bud.new_crossings(now, earlier)


@register("expense_forecast")
def q_expense_forecast(spark, sf_dir):
    return fc.expense_forecast(_fact(spark, sf_dir), td.users(spark, sf_dir))


# ---- rule-based insights (RUL4, RUL5, RUL6, RUL9) ----------------------------------


@register("global_suggestions")
def q_global_suggestions(spark, sf_dir):
    return ins.global_suggestions(_fact(spark, sf_dir), td.users(spark, sf_dir))


@register("period_suggestions")
def q_period_suggestions(spark, sf_dir):
    return ins.period_suggestions(_shared_fact(spark, sf_dir), td.users(spark, sf_dir))


@register("context_alerts")
def q_context_alerts(spark, sf_dir):
    recent = _recent(spark, _fact(spark, sf_dir))
    usage = bud.budget_usage_latest(_beff(spark, sf_dir), recent)
    return ins.context_alerts(recent, td.users(spark, sf_dir), usage)


@register("personalized_suggestions")
def q_personalized_suggestions(spark, sf_dir):
    recent = _recent(spark, _fact(spark, sf_dir))
    usage = bud.budget_usage_latest(_beff(spark, sf_dir), recent)
    return ins.personalized_suggestions(recent, td.users(spark, sf_dir), usage)


# ---- categoriser (ML1-ML9) ----------------------------------------------------------


def _nb_model(spark, sf_dir):
    return cat.train(spark, cat.training_frame(td.training_docs(spark, sf_dir), None))


@register("nb_train")
def q_nb_train(spark, sf_dir):
    m = _nb_model(spark, sf_dir)
    return m.prior.select("category", "doc_count", _rnd("log_prior", 6).alias("log_prior"),
                          _rnd("log_den", 6).alias("log_den"))


@register("nb_predict")
def q_nb_predict(spark, sf_dir):
    m = cat.materialize(spark, _nb_model(spark, sf_dir))
    return cat.auto_categorize(spark, m, td.predict_docs(spark, sf_dir))


# ---- cleaning and validation (CLN, VAL, PRJ1, SNK4) ---------------------------------


@register("clean_transactions")
def q_clean_transactions(spark, sf_dir):
    c = cln.clean_transactions(td.raw_transactions(spark, sf_dir))
    return c.select("id", "user_id", _F.col("amount").cast("double").alias("amount"), "category", "type",
                    "description", _F.date_format("date", "yyyy-MM-dd").alias("date"),
                    _F.date_format("month", "yyyy-MM").alias("month"))


def _global_categoriser(spark, sf_dir):
    """The global model: every expense row's (description, category) (SRC7)."""
    tx = td.transactions_full(spark, sf_dir).filter(_F.col("type") == "Expense")
    return cat.train(spark, cat.training_frame(None, tx))


@register("validated_transactions")
def q_validated_transactions(spark, sf_dir):
    raw = td.raw_transactions(spark, sf_dir)
    need = raw.filter((_F.trim("category") == "") & (_F.trim("type") == "Expense")).select(
        "id", _F.trim("description").alias("description"))
    predicted = cat.auto_categorize(spark, _global_categoriser(spark, sf_dir), need, key="id")
    return cln.validate_transactions(raw, td.users(spark, sf_dir), predicted)


@register("validated_budgets")
def q_validated_budgets(spark, sf_dir):
    return cln.validate_budgets(td.raw_budget_form(spark, sf_dir))


@register("validated_users")
def q_validated_users(spark, sf_dir):
    return cln.validate_users(td.raw_users(spark, sf_dir))


@register("budgets_upsert")
def q_budgets_upsert(spark, sf_dir):
    """SNK4: valid form rows upsert the budget table; last write wins per key."""
    form = td.raw_budget_form(spark, sf_dir)
    valid = cln.validate_budgets(form, keep=("seq",)).filter("is_valid")
    out = bud.apply_budget_updates(td.budgets(spark, sf_dir), valid)
    return out.select("user_id", "category", _F.col("monthly_budget").cast("double").alias("monthly_budget"))


# ---- event-driven crossings (STR1, STR2, STR4) ------------------------------------


@register("budget_crossings_replay")
def q_budget_crossings_replay(spark, sf_dir):
    tx = td.as_transactions(td.table(spark, sf_dir, "events"))
    return crs.replay_crossings(tx, budgets=td.event_budgets(_beff(spark, sf_dir)))


@register("stream_crossings")
def q_stream_crossings(spark, sf_dir):
    from centwise.session import materialize, shared_path
    src = srun.file_stream(spark, sf_dir, "events", srun.EVENTS_SCHEMA)
    budgets = materialize(spark, td.event_budgets(_beff(spark, sf_dir)), "event_budgets")  # read by every batch
    return crs.run_crossings(spark, td.as_transactions(src), crs.CrossingJob(shared_path(spark, "stream_crossings"), budgets))


# ---- table changes (SNK2, SNK3, SNK7) ---------------------------------------------


@register("apply_changes")
def q_apply_changes(spark, sf_dir):
    out = chg.apply_changes(td.transactions_orders(spark, sf_dir), td.order_changes(spark, sf_dir))
    return out.select("id", "user_id", _F.col("amount").cast("double").alias("amount"), "category", "type",
                      "description", _F.date_format("date", "yyyy-MM-dd").alias("date"))


@register("seed_income")
def q_seed_income(spark, sf_dir):
    out = chg.seed_income(td.users(spark, sf_dir), td.transactions_orders(spark, sf_dir), AS_OF)
    return out.select("user_id", _F.col("amount").cast("double").alias("amount"), "category", "type",
                      "description", _F.date_format("date", "yyyy-MM-dd").alias("date"))


# ---- dashboard (DSH1, flagship) -----------------------------------------------------
@register("dashboard")
def q_dashboard(spark, sf_dir):
    from centwise.session import materialize
    tx = td.transactions_full(spark, sf_dir)
    fact = materialize(spark, facts.monthly_fact(tx), "monthly_fact")
    recent = _recent(spark, fact)
    users = td.users(spark, sf_dir)
    beff = _beff(spark, sf_dir)
    usage = bud.budget_usage_latest(beff, recent)
    return ins.dashboard(tx, fact, users, beff, usage, AS_OF, recent=recent)


# ---- questions and replies (QNA1-QNA4, SCL10) -------------------------------------


@register("question_month")
def q_question_month(spark, sf_dir):
    fact = _fact(spark, sf_dir)
    months = fact.select("user_id", _F.date_format("month", "yyyy-MM").alias("month")).distinct()
    return qna.question_month(td.questions(spark, sf_dir), months, AS_OF).drop("q")


@register("question_answers")
def q_question_answers(spark, sf_dir):
    fact = _shared_fact(spark, sf_dir)
    recent = _recent(spark, fact)
    users = td.users(spark, sf_dir)
    usage = bud.budget_usage_latest(_beff(spark, sf_dir), recent)
    alerts = ins.context_alerts(recent, users, usage)
    ps = ins.personalized_suggestions(recent, users, usage)
    return qna.answer_questions(td.questions(spark, sf_dir), fact, alerts, ps, AS_OF, recent=recent)


@register("llm_reply_text")
def q_llm_reply_text(spark, sf_dir):
    return qna.reply_text(td.llm_replies(spark, sf_dir))


# ---- notifications and cool-down (OUT1, OUT3) ---------------------------------------


@register("alert_outbox")
def q_alert_outbox(spark, sf_dir):
    return ntf.alert_outbox(q_budget_crossings_new(spark, sf_dir), td.users(spark, sf_dir))


@register("throttle_requests")
def q_throttle_requests(spark, sf_dir):
    return ntf.throttle_requests(td.report_email_requests(spark, sf_dir))


# ---- nested outputs (CTX1, CHT1) and the streaming categoriser (STR3) --------------


@register("financial_context")
def q_financial_context(spark, sf_dir):
    fact = _shared_fact(spark, sf_dir)
    recent = _recent(spark, fact)
    users = td.users(spark, sf_dir)
    usage = bud.budget_usage_latest(_beff(spark, sf_dir), recent)
    ctx = ctxm.financial_context(fact, users, usage, ins.context_alerts(recent, users, usage), recent=recent)
    return ctx.select("user_id", "context_json")


@register("chart_payload")
def q_chart_payload(spark, sf_dir):
    """CHT1 as its JSON feed (the nested struct stays available from the operator)."""
    return ctxm.chart_payload(_shared_fact(spark, sf_dir), td.users(spark, sf_dir), 3).select("user_id", "payload_json")


@register("chart_payload_requests")
def q_chart_payload_requests(spark, sf_dir):
    """The chart payload of every report request, in its period and compare range."""
    return ctxm.chart_payloads(_fact(spark, sf_dir), td.report_requests(spark, sf_dir), td.users(spark, sf_dir),
                               AS_OF).select("request_id", "user_id", "payload_json")


DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@register("stream_categorize")
def q_stream_categorize(spark, sf_dir):
    """Documents arriving as files are categorised per micro-batch against the
    model tables trained once and materialised in the shared folder."""
    from pyspark.sql.types import StructType
    model = cat.materialize(spark, _nb_model(spark, sf_dir))
    src = srun.file_stream(spark, sf_dir, "documents", StructType.fromDDL(DOCS_SCHEMA))

    def per_batch(batch):
        docs = batch.select("doc_id", _F.col("text").alias("description"))
        return cat.auto_categorize(spark, model, docs)

    return srun.run_foreach_batch(spark, src, "stream_categorize",
                                  StructType.fromDDL("doc_id long, category string"), per_batch)


# ---- reports (PRJ3, RPT1, SNK8, SNK9, OUT2) -----------------------------------------


def _report_lines(spark, sf_dir):
    return rep.report_lines(td.transactions_full(spark, sf_dir), td.report_requests(spark, sf_dir),
                            td.users(spark, sf_dir), AS_OF, spark=spark)


@register("report_lines")
def q_report_lines(spark, sf_dir):
    return _report_lines(spark, sf_dir).withColumn("k_date", _F.date_format("k_date", "yyyy-MM-dd"))


@register("report_notices")
def q_report_notices(spark, sf_dir):
    return rep.report_notices(_fact(spark, sf_dir), td.report_requests(spark, sf_dir), td.users(spark, sf_dir), AS_OF)


# ---- lookups, feeds, counts (SRC2, SNK10, AGG15) ------------------------------------


@register("transaction_lookup")
def q_transaction_lookup(spark, sf_dir):
    """SRC2 in bulk: the current rows behind every (id, user_id) an edit targets."""
    keys = td.order_changes(spark, sf_dir).select("id", "user_id").distinct()
    out = chg.lookup(td.transactions_orders(spark, sf_dir), keys)
    return out.select("id", "user_id", _F.col("amount").cast("double").alias("amount"), "category", "type",
                      "description", _F.date_format("date", "yyyy-MM-dd").alias("date"))


@register("transactions_feed")
def q_transactions_feed(spark, sf_dir):
    return fls.transactions_feed(td.transactions_orders(spark, sf_dir))


@register("report_transaction_counts")
def q_report_transaction_counts(spark, sf_dir):
    return rep.transaction_counts(_fact(spark, sf_dir), td.report_requests(spark, sf_dir), AS_OF)
