"""Edge tables from FIXTURES.md section 3 and brute-force checks."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from centwise.operators import categorize as cat
from centwise.operators import notify, questions
from centwise.operators.facts import monthly_fact
from conftest import make_tx


def _brute_throttle(ts, c):
    out, last = [], None
    for t in ts:
        if last is None or t - last >= c:
            out.append((True, 0))
            last = t
        else:
            out.append((False, max(1, (c - (t - last)) // 1_000_000)))
    return out


def test_throttle_fixture(spark):
    secs = [0, 4, 9, 10, 15, 20]
    df = spark.createDataFrame([(i, 7, s * 1_000_000) for i, s in enumerate(secs)], "request_id long, user_id long, t long")
    got = sorted((r.request_id, r.accepted, r.remaining_seconds) for r in notify.throttle_requests(df).collect())
    assert [(a, rem) for _, a, rem in got] == [(True, 0), (False, 6), (False, 1), (True, 0), (False, 5), (True, 0)]


def test_throttle_matches_brute_force_across_segments(spark):
    rnd = random.Random(7)
    rows, per_user = [], defaultdict(list)
    rid = 0
    for user in range(3):
        t = 3590 * 1_000_000  # start just before an hour boundary
        for _ in range(400):
            t += rnd.choice([1, 2, 3, 6, 9, 11, 40, 3000]) * 1_000_000 + rnd.randrange(1_000_000)
            rows.append((rid, user, t))
            per_user[user].append((t, rid))
            rid += 1
    df = spark.createDataFrame(rows, "request_id long, user_id long, t long")
    got = {r.request_id: (r.accepted, r.remaining_seconds) for r in notify.throttle_requests(df, 10).collect()}
    for user, items in per_user.items():
        items.sort()
        want = _brute_throttle([t for t, _ in items], 10_000_000)
        assert [got[r] for _, r in items] == want


def test_reply_text(spark):
    bodies = ['{"text":" a "}', '{"text":5,"response":"b"}', '{"choices":[{"message":{"content":" c"}}]}',
              '{"choices":[{"text":"d "}]}', '{"choices":[]}', '["x"]', 'not json', '{"choices":[{"message":{}}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "reply_id long, body string")
    got = [r.answer for r in questions.reply_text(df).orderBy("reply_id").collect()]
    assert got == ["a", "b", "c", "d", None, None, None, None]


def test_question_intents(spark, demo_tx, demo_users):
    from centwise.operators import budgets as bud
    from centwise.operators import insights as ins
    from centwise.schema import BUDGETS
    fact = monthly_fact(demo_tx)
    usage = bud.budget_usage_latest(bud.effective_budgets(demo_users, spark.createDataFrame([], BUDGETS)), fact)
    alerts = ins.context_alerts(fact, demo_users, usage)
    ps = ins.personalized_suggestions(fact, demo_users, usage)
    qs = ["Summarize my March spending", "Where did I overspend this month?", "Compare this month with last month",
          "How can I save more?", "highest spending month", "income in 2026-02", "spend 2031-01",
          "2026-13 summary", "   ", "maybe later"]
    df = spark.createDataFrame([(i, 1, q) for i, q in enumerate(qs)], "question_id long, user_id long, question string")
    got = {r.question_id: r for r in questions.answer_questions(df, fact, alerts, ps, dt.date(2026, 3, 31)).collect()}
    assert got[0].intent == "month_spend" and got[0].target_month == "2026-03"
    assert got[0].answer == "Total expenses for 2026-03 are Rs. 42300.00."
    assert got[1].intent == "overspend" and got[1].answer.startswith("Top overspending signals: Current month expenses")
    assert got[2].intent == "compare"
    assert got[2].answer == ("Comparison for 2026-03 vs 2026-02: expenses are 30.2% up "
                             "(Rs. 42300.00 vs Rs. 32500.00).")
    assert got[3].intent == "save" and got[3].answer.startswith("Top savings action: Low Savings Rate.")
    assert got[4].answer == "Your highest spending month is 2026-03 with total expenses of Rs. 42300.00."
    assert got[5].answer == "Income for 2026-02 is Rs. 52000.00."
    assert got[6].intent == "month_not_found" and got[6].target_month == "2031-01"
    assert got[7].intent == "summary" and got[7].target_month is None
    assert got[7].answer.startswith("Summary for 2026-03: income Rs. 52000.00, expenses Rs. 42300.00")
    assert got[8].intent == "blank"
    assert got[9].target_month == "2026-05" or got[9].target_month is None  # 'may' inside 'maybe'
    assert got[9].intent == "month_not_found" or got[9].intent == "default"


# ---- naive Bayes against an independent pure-Python implementation ------------------

TOKEN = re.compile(r"[^\W_]{0}\w\w+", re.UNICODE)


def _tokens(text, stop):
    return [t for t in re.findall(r"\b\w\w+\b", text.lower()) if t not in stop]


def _brute_nb(train, docs, stop):
    n = len(train)
    tfs = [Counter(_tokens(d, stop)) for d, _ in train]
    df = Counter(t for tf in tfs for t in tf)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    classes = sorted({c for _, c in train})
    fc = {c: defaultdict(float) for c in classes}
    for (d, c), tf in zip(train, tfs):
        w = {t: k * idf[t] for t, k in tf.items()}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        for t, v in w.items():
            fc[c][t] += v / norm
    v_size = len(idf)
    prior = {c: math.log(sum(1 for _, k in train if k == c) / n) for c in classes}
    out = []
    for d in docs:
        tf = {t: k for t, k in Counter(_tokens(d, stop)).items() if t in idf}
        w = {t: k * idf[t] for t, k in tf.items()}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        x = {t: v / norm for t, v in w.items()}
        best = None
        for c in classes:
            tot = sum(fc[c].values()) + v_size
            s = prior[c] + sum(v * math.log((fc[c].get(t, 0.0) + 1) / tot) for t, v in x.items())
            if best is None or s > best[0] + 1e-12:
                best = (s, c)
        out.append(best[1])
    return out


def test_naive_bayes_matches_brute_force(spark):
    train = [("grocery shopping and snacks", "Food"), ("pizza dinner and cafe meals", "Food"),
             ("restaurant dinners and groceries", "Food"), ("uber ride and metro recharge", "Transport"),
             ("fuel refill", "Transport"), ("cab rides", "Transport"), ("electricity bill", "Bills"),
             ("internet recharge and water bill", "Bills"), ("mall shopping", "Shopping"),
             ("online order shoes and clothing purchase", "Shopping"), ("concert pass", "Entertainment"),
             ("movie tickets and gaming recharge", "Entertainment"), ("book fair purchase", "Other")]
    docs = ["weekend pizza", "metro card recharge", "water bill", "new shoes", "movie night", "zzz unknown",
            "gift purchase and clothing purchase", "electricity and mobile bill"]
    stop = set(cat.english_stop_words())
    tdf = cat.training_frame(spark.createDataFrame(train, "description string, category string"), None)
    model = cat.train(spark, tdf)
    ddf = spark.createDataFrame(list(enumerate(docs)), "doc_id long, description string")
    got = {r.doc_id: r.predicted for r in cat.predict(spark, model, ddf).collect()}
    assert [got[i] for i in range(len(docs))] == _brute_nb(train, docs, stop)


def test_auto_categorize_rules(spark):
    model = cat.train(spark, cat.training_frame(
        spark.createDataFrame([("fuel refill", "Transport"), ("pizza", "Food")], "description string, category string"),
        None))
    docs = spark.createDataFrame([(1, "   "), (2, "Dental checkup"), (3, "pizza night"), (4, "Blood Test lab")],
                                 "doc_id long, description string")
    got = {r.doc_id: r.category for r in cat.auto_categorize(spark, model, docs).collect()}
    assert got == {1: "Other", 2: "Health", 3: "Food", 4: "Health"}


def test_nb_many_classes_and_equal_priors(spark):
    """Hundreds of classes, ties and texts without a known term: the same as scoring every class."""
    train = [(f"word{i % 37} thing{i % 11} item{i}", f"c{i % 150:03d}") for i in range(450)]
    train += [("common word1 word2 word3 word4", "big")] * 3 + [("common thing1 " + "word5 " * 9, "big")]
    train = list(dict.fromkeys(train))
    docs = ["", "nothing known", "word1", "thing3 thing3", "item7 word2", "word5 " * 30, "common",
            " ".join(f"item{i}" for i in range(200))]
    stop = set(cat.english_stop_words())
    tdf = spark.createDataFrame(train, "description string, category string")
    model = cat.train(spark, cat.training_frame(tdf, None))
    ddf = spark.createDataFrame(list(enumerate(docs)), "doc_id long, description string")
    got = {r.doc_id: r.predicted for r in cat.predict(spark, model, ddf).collect()}
    assert [got[i] for i in range(len(docs))] == _brute_nb(train, docs, stop)


def test_forecast_status_invalid_dates(spark):
    """FCT2: expenses that have no valid date at all; income alone is no expense."""
    from centwise.operators.forecast import expense_forecast
    fact = spark.createDataFrame(
        [(1, None, "Expense", "Food", 5.0), (2, None, "Income", "Salary", 5.0), (3, "2026-01-01", "Expense", "Food", 7.0),
         (3, None, "Expense", "Food", 9.0)],
        "user_id long, month string, type string, category string, amount double").selectExpr(
        "user_id", "CAST(month AS DATE) AS month", "type", "category", "CAST(amount AS DECIMAL(28,2)) AS amount")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    got = {r.user_id: (r.status, r.predicted_expense) for r in expense_forecast(fact, users).collect()}
    assert got == {1: ("invalid-dates", 0.0), 2: ("no-expenses", 0.0), 3: ("limited-history", 7.0),
                   4: ("insufficient-data", 0.0)}


def test_throttle_one_user_with_most_requests_within_seconds(spark):
    """A user with most of all requests, many of them within ten seconds, over years: every level of the tree."""
    import random

    rnd = random.Random(6)
    hour, year = 3600 * 1_000_000, 365 * 24 * 3600 * 1_000_000
    times = [rnd.randrange(10_000_000) for _ in range(3000)] + [rnd.randrange(2 * hour) for _ in range(500)]
    times += [k * hour + rnd.choice([-3, 0, 2, 5]) * 1_000_000 for k in range(1, 1200)]        # across the hours' ends
    times += [30 * year + rnd.randrange(20_000_000) for _ in range(800)] + [-(1 << 40), -(1 << 40) + 9_999_999]
    times += [256 * hour * k - 1 for k in range(1, 5)] + [256 * hour * k + 9_999_998 for k in range(1, 5)]
    rows = [(i, 1, t) for i, t in enumerate(times)] + [(10**6 + i, 2 + i % 50, rnd.randrange(hour)) for i in range(1000)]
    df = spark.createDataFrame(rows, "request_id long, user_id long, t long").repartition(5)
    got = {r.request_id: (r.accepted, r.remaining_seconds) for r in notify.throttle_requests(df, 10).collect()}
    assert len(got) == len(rows)
    by_user = {}
    for i, u, t in rows:
        by_user.setdefault(u, []).append((t, i))
    for items in by_user.values():
        items.sort()
        want = _brute_throttle([t for t, _ in items], 10_000_000)
        assert [got[i] for _, i in items] == want
