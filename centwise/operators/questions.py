"""Questions over a table of (question_id, user_id, question): month extraction,
intent routing and rule-based answers (QNA1-QNA4), and answer text from raw
JSON replies (SCL10).

The question table is joined to user-sized context parts (latest and
previous month, month summaries, top categories, alerts, suggestions); every
join is on user_id or (user_id, month), so a user with very many questions is
a skewed join key that AQE splits, and no per-user state is collected.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centwise.functions.columns import div, fmt, month_label, pct, rnd

# Month names in calendar order.
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
               "october", "november", "december"]
# The explicit period and year patterns.
EXPLICIT_PERIOD = r"(20[0-9]{2})\s*[-/]\s*([0-9]{1,2})"
YEAR_IN_TEXT = r"(20[0-9]{2})"
# Years tried after the question's own year ("this year" first).
FALLBACK_YEARS = ["2026", "2025", "2024"]

STRIP = r"^\s+|\s+$"


def _strip(c: F.Column) -> F.Column:
    return F.regexp_replace(c, STRIP, "")


def question_month(questions: DataFrame, present_months: DataFrame, as_of: dt.date) -> DataFrame:
    """QNA1: target month per question (or NULL).

    ``present_months``: user_id, month ('yyyy-MM').  An explicit YYYY-MM /
    YYYY/M wins when its month is 1..12; otherwise the first month name (in
    calendar order, substring match) that resolves: year in the text, this
    year, 2026, 2025, 2024, then the earliest present month with that number.
    """
    q = questions.select("question_id", "user_id", _strip(F.col("question")).alias("q"))
    ey = F.regexp_extract("q", EXPLICIT_PERIOD, 1)
    em = F.regexp_extract("q", EXPLICIT_PERIOD, 2)
    emi = F.when(em != "", em.cast("int"))
    explicit = F.when((ey != "") & emi.between(1, 12), F.concat(ey, F.lit("-"), F.lpad(emi.cast("string"), 2, "0")))
    q = q.withColumn("explicit", explicit)
    names = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("name"), F.lit(f"{i + 1:02d}").alias("num"))
                      for i, n in enumerate(MONTH_NAMES)])
    low = F.lower("q")
    cand = q.filter(F.col("explicit").isNull()).select(
        "question_id", "user_id", F.regexp_extract(low, YEAR_IN_TEXT, 1).alias("yt"),
        F.explode(F.filter(names, lambda n: F.instr(low, n["name"]) > 0)).alias("n"))
    pm = present_months.select("user_id", "month", F.substring("month", 6, 2).alias("mnum"),
                               F.substring("month", 1, 4).alias("myear"))
    j = cand.join(pm, (cand.user_id == pm.user_id) & (F.col("n.num") == pm.mnum)).drop(pm.user_id)
    prio = F.when(F.col("myear") == F.col("yt"), 1).when(F.col("myear") == str(as_of.year), 2)
    for i, y in enumerate(FALLBACK_YEARS):
        prio = prio.when(F.col("myear") == y, 3 + i)
    prio = prio.otherwise(9)
    best = j.groupBy("question_id").agg(
        F.min_by("month", F.struct(F.col("n.idx"), prio, F.col("month"))).alias("by_name"))
    return (q.join(best, "question_id", "left")
            .select("question_id", "user_id", "q", F.coalesce("explicit", "by_name").alias("target_month")))


def _has(c: F.Column, *words: str) -> F.Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(c, w) > 0)
    return out


def _top_text(df: DataFrame, keys: list[str]) -> DataFrame:
    """', '.join('Cat (Rs. x.xx)') over rank <= 3 (bounded list)."""
    t = df.filter(F.col("rank") <= 3).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "category", "amount"))),
                                 lambda s: F.concat(s["category"], F.lit(" (Rs. "), fmt(s["amount"], 2), F.lit(")"))),
                     ", ").alias("top_text"))
    return t


def answer_questions(questions: DataFrame, fact: DataFrame, context_alerts: DataFrame,
                     personalized: DataFrame, as_of: dt.date, recent: DataFrame | None = None) -> DataFrame:
    """QNA2-QNA4: intent and answer text per question (source 'local').

    ``recent`` (optional) is ``facts.latest_months_slice(fact)``: the parts that
    only look at the latest two months read it instead of the whole fact."""
    recent = fact if recent is None else recent
    from centwise.operators import insights as ins
    from centwise.operators import summary as sm
    from centwise.operators.facts import month_totals

    mt = month_totals(fact).select("user_id", month_label("month").alias("month"), "income", "expense")
    qm = question_month(questions, mt.select("user_id", "month"), as_of)
    lt = ins.latest_two_summaries(recent)
    hm = sm.highest_month(fact).select("user_id", F.col("month").alias("hi_month"), "total_expense")
    alerts = context_alerts.filter(F.col("seq") <= 3).groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda s: s["message"]),
                     " ").alias("alerts"))
    ps = personalized.filter(F.col("rank") == 1).select("user_id", F.col("title").alias("ps_title"),
                                                       F.col("message").alias("ps_message"))
    tm = _top_text(sm.top_categories_by_month(fact, 3), ["user_id", "month"]).withColumnRenamed("month", "target_month") \
        .withColumnRenamed("top_text", "tm_text")
    tl = _top_text(sm.top_categories_latest(recent, 3), ["user_id"]).withColumnRenamed("top_text", "tl_text")
    ci = sm.category_increases(recent, 1).select("user_id", F.col("category").alias("ci_cat"),
                                                F.col("change_percent").alias("ci_chg"),
                                                F.col("previous").alias("ci_prev"), F.col("current").alias("ci_cur"))
    tgt = mt.select("user_id", F.col("month").alias("target_month"), F.col("income").alias("t_inc"),
                    F.col("expense").alias("t_exp"))
    d = (qm.join(lt, "user_id", "left").join(tgt, ["user_id", "target_month"], "left")
         .join(hm, "user_id", "left").join(alerts, "user_id", "left").join(ps, "user_id", "left")
         .join(tm, ["user_id", "target_month"], "left").join(tl, "user_id", "left").join(ci, "user_id", "left"))
    ql = F.lower("q")
    spend = _has(ql, "spend", "spent", "spending", "expense", "sped")
    t = F.col("target_month")
    cur = month_label("cur_month")
    prev = month_label("prev_month")
    found = F.col("t_inc").isNotNull()
    m2 = lambda c: fmt(c, 2)
    delta = div(F.col("exp") - F.col("prev_exp"), "prev_exp") * 100.0
    sr = rnd(pct(F.col("inc") - F.col("exp"), F.col("inc")))
    # Intent order, keywords and answer texts below (first matching rule wins).
    rules = [
        (F.col("q") == "", "blank",
         F.lit("Please ask a finance question, for example: 'Where did I overspend this month?'")),
        (F.col("cur_month").isNull(), "no_data",
         F.lit("I need more transaction history before I can answer. Add a few income and expense entries first.")),
        (t.isNotNull() & ~found, "month_not_found",
         F.concat(F.lit("No records were found for "), t,
                  F.lit(". Please check the month or add transactions for that period."))),
        (_has(ql, "highest", "max") & spend, "highest_spend",
         F.concat(F.lit("Your highest spending month is "), F.col("hi_month"),
                  F.lit(" with total expenses of Rs. "), m2("total_expense"), F.lit("."))),
        (t.isNotNull() & _has(ql, "income", "earn", "salary"), "month_income",
         F.concat(F.lit("Income for "), t, F.lit(" is Rs. "), m2("t_inc"), F.lit("."))),
        (t.isNotNull() & spend, "month_spend",
         F.concat(F.lit("Total expenses for "), t, F.lit(" are Rs. "), m2("t_exp"), F.lit("."))),
        (_has(ql, "overspend"), "overspend",
         F.when(F.col("alerts").isNotNull(), F.concat(F.lit("Top overspending signals: "), F.col("alerts")))
         .otherwise(F.lit("No major overspending alert is active right now. Your current expense pattern is "
                          "within the configured thresholds."))),
        (_has(ql, "compare") & _has(ql, "last month") & F.col("prev_month").isNotNull(), "compare",
         F.when(F.col("prev_exp") > 0, F.concat(
             F.lit("Comparison for "), cur, F.lit(" vs "), prev, F.lit(": expenses are "), fmt(F.abs(delta), 1),
             F.lit("% "), F.when(delta >= 0, F.lit("up")).otherwise(F.lit("down")), F.lit(" (Rs. "), m2("exp"),
             F.lit(" vs Rs. "), m2("prev_exp"), F.lit(")."))
         ).otherwise(F.concat(F.lit("Comparison is limited because last month ("), prev,
                              F.lit(") has very low or zero expenses recorded.")))),
        (_has(ql, "save", "saving"), "save",
         F.when(F.col("ps_title").isNotNull(),
                F.concat(F.lit("Top savings action: "), F.col("ps_title"), F.lit(". "), F.col("ps_message")))
         .otherwise(F.lit("Your savings pattern looks stable. Keep monthly expense caps for discretionary "
                          "categories to preserve savings."))),
        (_has(ql, "summarize", "summary"), "summary",
         F.when(t.isNotNull() & found, F.concat(
             F.lit("Summary for "), t, F.lit(": income Rs. "), m2("t_inc"), F.lit(", expenses Rs. "), m2("t_exp"),
             F.lit(", balance Rs. "), m2(F.col("t_inc") - F.col("t_exp")), F.lit(". Top categories: "),
             F.coalesce(F.col("tm_text"), F.lit("no expense categories recorded for this month."))))
         .otherwise(F.concat(
             F.lit("Summary for "), cur, F.lit(": income Rs. "), m2("inc"), F.lit(", expenses Rs. "), m2("exp"),
             F.lit(", balance Rs. "), m2(F.col("inc") - F.col("exp")), F.lit(". Top categories: "),
             F.coalesce(F.col("tl_text"), F.lit("no major expense categories yet")), F.lit(".")))),
    ]
    default = F.concat(
        F.lit("For "), cur, F.lit(", your income is Rs. "), m2("inc"), F.lit(", expenses are Rs. "), m2("exp"),
        F.lit(", and savings rate is "), fmt(sr, 1), F.lit("%."),
        F.when(F.col("ci_cat").isNotNull(), F.concat(
            F.lit(" Biggest increase: "), F.col("ci_cat"), F.lit(" up "), fmt("ci_chg", 1), F.lit("% (Rs. "),
            m2("ci_prev"), F.lit(" to Rs. "), m2("ci_cur"), F.lit(")."))).otherwise(F.lit("")))
    intent = F.lit("default")
    answer = default
    for cond, name, text in reversed(rules):
        intent = F.when(cond, F.lit(name)).otherwise(intent)
        answer = F.when(cond, text).otherwise(answer)
    return d.select("question_id", "user_id", F.col("target_month"), intent.alias("intent"),
                    answer.alias("answer"), F.lit("local").alias("source"))


def reply_text(replies: DataFrame) -> DataFrame:
    """SCL10: first string among text, response, choices[0].message.content,
    choices[0].text; trimmed; NULL for anything else (bad JSON, arrays, numbers)."""
    v = F.try_parse_json(F.col("body"))

    def pick(path: str) -> F.Column:
        got = F.variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(got) == "STRING", F.variant_get(v, path, "string"))

    text = F.coalesce(pick("$.text"), pick("$.response"), pick("$.choices[0].message.content"),
                      pick("$.choices[0].text"))
    return replies.select("reply_id", _strip(text).alias("answer"))


__all__ = ["question_month", "answer_questions", "reply_text"]
