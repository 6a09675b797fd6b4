"""Figures that must not grow faster than the input, each on rows of its own."""
from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from centwise.operators import budgets as bud
from centwise.operators import categorize as cat
from centwise.operators import context, notify, reports
from centwise.operators.facts import monthly_fact
from centwise.streaming import crossings as crs
from conftest import DEMO_ROWS, make_tx

TEXTS = [(f"{'rent' if i % 2 else 'bread'} market common word{i} word{i}", "Bills" if i % 2 else "Food") for i in range(40)]


def _model_and_predictions(spark):
    model = cat.train(spark, spark.createDataFrame(TEXTS, "description string, category string"))
    docs = [(i, f"{t} unheard{i}") for i, (t, _) in enumerate(TEXTS)] + [(90, "rent word4"), (91, "nothing known"), (92, " "), (93, "clinic bread")]
    docs = spark.createDataFrame(docs, "doc_id long, description string")
    terms = {(r.category, r.term): round(r.log_num, 9) for r in model.term.collect()}
    scores = {r.doc_id: (r.predicted, round(r.score, 9)) for r in cat.predict(spark, model, docs).collect()}
    return model, docs, terms, scores, sorted(map(tuple, cat.auto_categorize(spark, model, docs).collect()))


def test_frequent_terms_are_broadcast_and_only_rare_ones_shuffled_by_term(spark, monkeypatch):
    whole = _model_and_predictions(spark)
    monkeypatch.setattr(cat, "BROADCAST_BYTES", 600)       # holds the four frequent terms, not the forty others
    parts = _model_and_predictions(spark)
    assert parts[2:] == whole[2:]
    own, _ = cat._doc_weights(spark, parts[0], parts[1], "doc_id", "description", None, flags=False)
    left = {t["term"] for r in own.collect() for t in r.left}
    assert "word1" in left and not left & {"rent", "bread", "market", "common"}


def test_budgets_of_users_are_never_broadcast_and_spread_before_they_multiply(spark):
    users = spark.range(50).select("id")
    given = users.where("id % 3 = 0").select(F.col("id").alias("user_id"), F.lit("Food").alias("category"), F.lit(7).alias("monthly_budget"))
    out = bud.effective_budgets(users, given)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert out.count() == 350 and out.where("category = 'Food' AND monthly_budget = 7").count() == 17


def test_scoping_by_month_and_by_year_computes_the_transactions_once(spark):
    tx = spark.range(6).selectExpr(
        "id", "1L AS user_id", "CAST(id AS DECIMAL(18,2)) AS amount", "'Food' AS category", "'Expense' AS type",
        "'x' AS description", "add_months(DATE'2001-01-01', CAST(id * 3 AS INT)) AS date",
        "add_months(DATE'2001-01-01', CAST(id * 3 AS INT)) AS month")
    asked = spark.createDataFrame([(1, 1, "monthly", "2001-4"), (2, 1, "yearly", None), (3, 2, "monthly", "2001-04")],
                                  "request_id long, user_id long, report_type string, month string") \
        .selectExpr("*", "'2001' AS year", "CAST(NULL AS STRING) AS compare_range")
    scoped = reports.scope_transactions(tx, reports.normalize_requests(asked, dt.date(2001, 1, 31)))
    assert scoped._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert sorted((r.user_id, r.owner_id, r.id) for r in scoped.collect()) == [(1, 1, 1), (2, 1, 0), (2, 1, 1), (2, 1, 2), (2, 1, 3)]


def _greedy(rows, c):
    last, out = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        free = u not in last or t - last[u] >= c
        out[i] = (free, 0 if free else max(1, (c - (t - last[u])) // 1_000_000))
        last[u] = t if free else last[u]
    return out


def test_only_requests_that_an_earlier_hour_can_reach_go_through_the_tree(spark, monkeypatch):
    s, hour, maps = 1_000_000, 3600 * 1_000_000, []
    rows = [(10 * i + k, i % 9, i * hour + 1800 * s + k * 4 * s) for i in range(60) for k in range(4)]
    rows += [(1000, 50, hour - 3 * s), (1001, 50, hour + 2 * s), (1002, 50, hour + 7 * s), (1003, 50, hour + 900 * s)]
    real = notify._entries
    monkeypatch.setattr(notify, "_entries", lambda m, *rest: maps.append(m.count()) or real(m, *rest))
    df = spark.createDataFrame(rows, "request_id long, user_id long, t long")
    got = {r.request_id: (r.accepted, r.remaining_seconds) for r in notify.throttle_requests(df, 10).collect()}
    assert got == _greedy(rows, 10 * s)
    assert maps == [4]                # one exit at the hour's end; three entries into the next hour, of 61 hours


def test_throttle_with_equal_times_and_cooldowns_beyond_an_hour(spark):
    rnd, s = random.Random(3), 1_000_000
    rows = [(i, rnd.randrange(4), rnd.choice([0, -(1 << 41)]) + rnd.choice([i * 700 * s, (i // 20) * 900 * s, rnd.randrange(9000 * s)]))
            for i in range(600)]
    df = spark.createDataFrame(rows, "request_id long, user_id long, t long").repartition(3)
    for cooldown in (0, 1, 3599, 5000, 100_000):
        got = {r.request_id: (r.accepted, r.remaining_seconds) for r in notify.throttle_requests(df, cooldown).collect()}
        assert got == _greedy(rows, cooldown * s), cooldown


def test_throttle_where_spark_makes_its_joins_broadcasts_while_it_runs(spark):
    """Requests of a user on both sides of an hour's end, in many partitions: no segment may be split."""
    s, hour = 1_000_000, 3600 * 1_000_000
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    rows = [(1000 * u + 10 * h + k, u, h * hour + k * 4 * s - 5 * s) for u in range(40) for h in range(1, 9) for k in range(5)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "request_id long, user_id long, t long").repartition(8)
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "10m")
        spark.conf.set(names[2], "false")
        got = {r.request_id: (r.accepted, r.remaining_seconds) for r in notify.throttle_requests(df, 10).collect()}
    finally:
        for name in names:
            spark.conf.unset(name)
    assert got == _greedy(rows, 10 * s)


def test_a_period_of_a_user_is_added_up_once_for_all_its_requests(spark, monkeypatch):
    tx = make_tx(spark, DEMO_ROWS).unionByName(make_tx(spark, DEMO_ROWS[3:], user_id=2))
    users = spark.createDataFrame([(1, "a", "a@x"), (3, "c", "c@x")], "id long, name string, email string")
    asked = [(1, 1, "monthly", "2026-2", None, None), (2, 1, "monthly", "2026-02", None, "last_month"), (3, 1, " Yearly", None, "2026", None),
             (4, 1, None, None, None, None), (5, 1, "", "", None, "last_month"), (6, 2, "monthly", "2026-03", None, None),
             (7, None, None, None, None, None), (8, 3, "yearly", None, "x", None), (9, 1, None, None, None, None), (9, 1, "monthly", "2026-02", None, None)]
    asked = spark.createDataFrame(asked, "request_id long, user_id long, report_type string, month string, year string, compare_range string")
    scopes, real = [], context._spending_parts
    monkeypatch.setattr(context, "_spending_parts", lambda fact, of: scopes.append(of.count()) or real(fact, of))
    rows = context.chart_payloads(monthly_fact(tx), asked, users, dt.date(2026, 3, 31)).collect()
    got = {r.request_id: r.payload for r in rows if r.request_id != 9}
    assert scopes[0] == 6             # of eight requests: two ask for a month, two for all history of the same user
    spent = {i: [(m.month, m.amount) for m in p.monthly_spending] for i, p in got.items()}
    whole = [("2026-01", 27200.0), ("2026-02", 32500.0), ("2026-03", 42300.0)]
    assert spent == {1: whole[1:2], 2: whole[1:2], 3: whole, 4: whole, 5: whole, 6: whole[2:], 7: [], 8: []}
    assert got[1].summary.total_income == 52000.0 and got[4].summary.total_income == 154000.0 and got[7].summary.total_expenses == 0.0
    assert {i: [s.month[-1] for s in p.savings_vs_expenses] for i, p in got.items()} == {
        1: ["1", "2", "3"], 2: ["3"], 3: ["1", "2", "3"], 4: ["1", "2", "3"], 5: ["3"], 6: ["1", "2", "3"], 7: [], 8: []}
    assert [got[i].prediction.status for i in (1, 6, 7, 8)] == ["predicted", None, None, "insufficient-data"]
    # an id that comes twice: its rows share one scope, each of both rows' periods for each of the two types
    twice = [r.payload for r in rows if r.request_id == 9]
    assert len(twice) == 16 and {p.summary.total_income for p in twice} == {2 * 154000.0 + 2 * 52000.0}


def test_a_micro_batchs_replay_has_more_tasks_the_more_rows_it_has(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crs, "ROWS_PER_TASK", 40)
    tasks, real = [], crs._replay

    def replay(t, thresholds, *rest, **kw):
        found = real(t, thresholds, *rest, **kw)
        tasks.append(kw.get("tasks"))
        return found

    monkeypatch.setattr(crs, "_replay", replay)
    events = lambda lo, n: spark.range(lo, lo + n).selectExpr(
        "id", "id % 7 AS user_id", "'Food' AS category", "CAST(10 AS DECIMAL(18,2)) AS amount", "TIMESTAMP'2024-01-05' AS ts")
    job = crs.CrossingJob(str(tmp_path / "job"), flat_budget=200.0)
    job(events(1000, 400), 0)
    job(events(2000, 30), 1)
    job(events(0, 100), 2)                                # earlier ids: the stored rows are replayed
    assert tasks == [10, None, 3, 14]                     # 400, 30, 100 and all 530 rows
    got = sorted((r.user_id, r.threshold_percent, r.id) for r in job.crossings(spark).collect())
    ids = [*range(100), *range(1000, 1400), *range(2000, 2030)]
    assert got == sorted((u, th, [i for i in ids if i % 7 == u][n]) for u in range(7) for th, n in ((85, 16), (100, 19)))


def test_terms_are_counted_in_their_row(spark):
    """Training makes no row of every word; the counts are those of a plain count."""
    from collections import Counter
    texts = ["", "a", "the the the", "Zeta beta beta alpha ZETA beta", "x1 x1 x1", "über Über straße x_1"] + [f"w{i % 7} w{i % 3} w{i}{i}" for i in range(40)]
    rows = [(t, c) for t in texts for c in ("A", "B")] + [(None, "A"), ("lost", None), (texts[3], "A")]
    counts = cat.term_counts(spark.createDataFrame(rows, "description string, category string"))
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
    want = [Counter(w for w in re.findall(r"\w{2,}", t.lower()) if w not in cat.english_stop_words()) for t in texts for _ in "AB"]
    got = [{x.term: x.tf for x in r.terms} for r in counts.collect()]
    assert sorted(map(repr, (sorted(g.items()) for g in got))) == sorted(map(repr, (sorted(w.items()) for w in want)))
    assert all(len(r.terms) == len({x.term for x in r.terms}) for r in counts.collect())
