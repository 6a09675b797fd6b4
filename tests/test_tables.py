"""Tables that live: batches committed once (SNK6), merges by bucket (SNK2/SNK3), the kept fact."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from centwise.operators import budgets as bud
from centwise.operators import changes as chg
from centwise.operators import clean
from centwise.operators import facts
from centwise.operators import latest
from centwise.operators import summary
from centwise.schema import ALERT_EVENTS
from centwise.sources import batches
from conftest import make_tx

CANDS = "user_id long, category string, month string, threshold_percent int, usage_percent double, idx int"
CHANGES = "seq long, op string, id long, user_id long, amount string, category string, type string, " \
          "description string, date string"


def events(spark, path):
    return sorted((r.user_id, r.threshold_percent, r.batch) for r in batches.read_batches(spark, path, ALERT_EVENTS).collect())


def cands(spark, users, usage=90.0):
    return spark.createDataFrame([(u, "Food", "2026-01", 85, usage, 0) for u in users], CANDS)


def test_a_killed_run_repeated_emits_once(spark, tmp_path):
    path = str(tmp_path / "events")
    bud.append_new_events(spark, cands(spark, range(5)), path, 1, dt.datetime(2026, 1, 15))
    # the second run writes its data and dies before the commit: no mark
    bud.append_new_events(spark, cands(spark, range(8)), path, 2, dt.datetime(2026, 1, 31))
    os.remove(f"{path}/batch=2/_SUCCESS")
    assert events(spark, path) == [(u, 85, 1) for u in range(5)]
    again = bud.append_new_events(spark, cands(spark, range(8)), path, 2, dt.datetime(2026, 1, 31))
    assert sorted(r.user_id for r in again.collect()) == [5, 6, 7]
    want = [(u, 85, 1) for u in range(5)] + [(u, 85, 2) for u in (5, 6, 7)]
    assert events(spark, path) == want
    # a repetition after the commit writes nothing and returns what the run created
    last = bud.append_new_events(spark, cands(spark, range(8), 99.0), path, 2)
    assert sorted((r.user_id, r.usage_percent) for r in last.collect()) == [(5, 90.0), (6, 90.0), (7, 90.0)]
    assert events(spark, path) == want


def test_a_job_that_fails_while_writing_is_invisible(spark, tmp_path):
    path = str(tmp_path / "events")
    bad = cands(spark, range(6)).repartition(3).withColumn(
        "usage_percent", F.when(F.col("user_id") == 4, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("usage_percent")))
    with pytest.raises(Exception, match="lost"):
        bud.append_new_events(spark, bad, path, 1)
    assert events(spark, path) == []
    bud.append_new_events(spark, cands(spark, range(6)), path, 1)
    assert events(spark, path) == [(u, 85, 1) for u in range(6)]


def table(spark, n=600):
    return make_tx(spark, [(float(10 + i), "Food" if i % 3 else "Bills", "Expense", f"row {i}", f"2026-0{1 + i % 3}-0{1 + i % 9}")
                           for i in range(n)])


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def rows(df):
    return sorted((r.id, r.user_id, float(r.amount), r.category, r.type, r.description, r.date) for r in df.collect())


def test_merge_rewrites_only_touched_buckets(spark, tmp_path):
    path, buckets = str(tmp_path / "tx"), 100
    base = table(spark)
    chg.write_buckets(base, path, buckets)
    before = files(path)
    where = {}
    for r in chg.read_buckets(spark, path).select("id", "bucket").collect():
        where.setdefault(r.bucket, []).append(r.id)
    edit, gone = sorted(where)[:2]                         # one bucket edited, one emptied: 2 % of the table
    user = base.first().user_id
    rows_ = [(1, "U", where[edit][0], user, "77", "Health", "Expense", "edited", "2026-02-02")]
    rows_ += [(9, "D", i, user, None, None, None, None, None) for i in where[gone]]
    rows_ += [(3, "U", where[gone][0], user, "1", "Food", "Expense", "too late", "2026-01-01")]
    ch = spark.createDataFrame(rows_, CHANGES)
    assert chg.merge_changes(spark, path, ch, buckets) == sorted([edit, gone])
    after = files(path)
    changed = {f.split("bucket=")[1].split("/")[0] for f in before ^ after}
    assert changed == {str(edit), str(gone)} and len(before & after) >= 0.97 * len(before)
    assert not os.path.exists(f"{path}/bucket={gone}")
    want = rows(chg.apply_changes(base, ch))
    assert rows(chg.read_buckets(spark, path)) == want
    chg.merge_changes(spark, path, ch, buckets)            # a run that died is simply repeated
    assert rows(chg.read_buckets(spark, path)) == want
    assert chg.merge_changes(spark, path, ch.limit(0), buckets) == []


def test_merge_prunes_the_scan(spark, tmp_path):
    path = str(tmp_path / "tx")
    chg.write_buckets(table(spark), path, 20)
    plan = chg.read_buckets(spark, path).where(F.col("bucket").isin([3, 4]))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [bucket" in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_fact_equals_the_fact_from_scratch(spark, tmp_path, seed):
    rnd, path, where = random.Random(seed), str(tmp_path / "fact"), str(tmp_path / "tx")
    base = table(spark, 120)
    user = base.first().user_id
    chg.write_buckets(base, where, 10)
    batches.write_batch(facts.monthly_fact(base).select(facts.FACT.names), path, 0)
    for k in range(1, 5):
        ch = []
        for s in range(25):
            i = rnd.randrange(1, 130)                      # some ids are not there
            ch.append((s, "D", i, user, *[None] * 5) if rnd.random() < 0.3 else
                      (s, "U", i, user, str(rnd.randrange(100)), rnd.choice(["Food", "Health", "Bills"]),
                       rnd.choice(["Expense", "Income"]), "new", f"2026-0{rnd.randrange(1, 5)}-01"))
        changes = spark.createDataFrame(ch, CHANGES)
        for _ in range(2):                                 # each day is repeated, as after a crash
            now = chg.read_buckets(spark, where)
            batches.write_batch(facts.fact_deltas(chg.row_changes(now, changes)), path, k)
        touched = {(r.user_id, r.month) for r in batches.read_batches(spark, path, facts.FACT).where(F.col("batch") == k).collect()}
        assert len(touched) <= 8                           # only keys of changed rows
        chg.merge_changes(spark, where, changes, 10)
        if k in (2, 4):
            batches.fold(spark, path, facts.FACT, facts.FACT_KEYS, facts.FACT_TOTALS)
        if k == 4:
            batches.drop_folded(spark, path)
            assert batches.complete(spark, path) == [] and batches.complete(spark, path, "base") == [4]
        key = lambda df: sorted((r.user_id, r.month, r.type, r.category, r.amount, r.n_tx) for r in df.collect())
        assert key(facts.stored_fact(spark, path)) == key(facts.monthly_fact(chg.read_buckets(spark, where)))


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_newest_rows_equal_the_window(spark, tmp_path, seed):
    rnd, path, where = random.Random(seed), str(tmp_path / "newest"), str(tmp_path / "tx")
    base = (table(spark, 90).unionByName(table(spark, 8).withColumn("user_id", F.lit(77).cast("long"))
                                         .withColumn("id", F.col("id") + 1000)))
    user = table(spark, 1).first().user_id
    chg.write_buckets(base, where, 4)
    latest.begin(base, path, 6)
    scans = []
    for k in range(1, 5):
        ch = []
        for s in range(30 if k != 3 else 3):
            u = rnd.choice([user, user, 77, 999])          # 999 has no rows
            i = rnd.randrange(1001, 1010) if u == 77 else rnd.randrange(60 if k == 2 else 1, 95)
            ch.append((s, "D", i, u, *[None] * 5) if rnd.random() < .5 else
                      (s, "U", i, u, str(rnd.randrange(100)), "Food", "Expense", f"edit {k}",
                       rnd.choice(["no date", "2026-02-03", "2026-05-01", "2025-01-01"])))
        if k == 4:                                         # all of a user goes
            ch += [(100 + i, "D", 1000 + i, 77, *[None] * 5) for i in range(10)]
        changes = spark.createDataFrame(ch, CHANGES)
        now = chg.read_buckets(spark, where)
        latest.update(now, changes, path, k, 5, 6)
        if k == 2:                                         # a run that died before its commit, then one repeated whole
            os.remove(f"{path}/batch=2/_SUCCESS")
            latest.update(now, changes, path, k, 5, 6)
        chg.merge_changes(spark, where, changes, 4)
        latest.update(chg.read_buckets(spark, where), changes, path, k, 5, 6)
        if k == 3:
            batches.fold_newest(spark, path, latest.STATE, ["user_id"], "version")
            batches.drop_folded(spark, path)
        got = latest.latest_transactions(latest.stored(spark, path), 5)
        want = summary.latest_transactions(chg.read_buckets(spark, where), 5)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)
        scans.append(got.where("user_id = 77").count())
    assert scans[-1] == 0 and scans[0] > 0
    assert {r.user_id for r in latest.stored(spark, path).collect()} == {user, 77}


def test_kept_newest_rows_read_the_table_only_when_short(spark, tmp_path):
    path = str(tmp_path / "newest")
    base = table(spark, 40)
    user = base.first().user_id
    latest.begin(base, path, 8)
    top = [r.id for r in summary.latest_transactions(base, 9).orderBy("rank").collect()]
    drop = lambda ids: spark.createDataFrame([(i, "D", i, user, *[None] * 5) for i in ids], CHANGES)
    latest.update(base, drop(top[:3]), path, 1, 5, 8)      # 5 are left
    assert [r.id for r in latest.stored(spark, path).first().rows] == top[3:8]
    base = base.where(~F.col("id").isin(top[:3]))
    latest.update(base, drop(top[3:4]), path, 2, 5, 8)     # 4 are left: read again
    state = latest.stored(spark, path).first()
    assert len(state.rows) == 8 and not state.complete and state.rows[4].id == top[8]
    latest.begin(base.limit(0), str(tmp_path / "empty"))
    assert latest.stored(spark, str(tmp_path / "empty")).count() == 0


def test_lookup_reads_only_the_keys_buckets(spark, tmp_path):
    path = str(tmp_path / "tx")
    base = table(spark)
    chg.write_buckets(base, path, 20)
    user = base.first().user_id
    keys = spark.createDataFrame([(5, user), (5, user), (77, user), (78, user + 1), (100_000, user), (None, user)], "id long, user_id long")
    got = chg.lookup_buckets(spark, path, keys, 20)
    assert rows(got) == rows(base.where("id IN (5, 77)"))
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [In(id" in plan.replace("IsNotNull(id), ", "") and "PartitionFilters: [" in plan
    many = spark.range(1, 5000).select("id", F.lit(user).alias("user_id"))     # beyond the pushed list
    assert rows(chg.lookup_buckets(spark, path, many, 20)) == rows(base)
    assert chg.lookup_buckets(spark, path, keys.limit(0), 20).count() == 0


def test_violations_over_tables(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    t = {"a": spark.createDataFrame([(1,), (3,), (3,), (None,)], "user_id long"),
         "b": spark.createDataFrame([(2,), (9,)], "user_id int"), "c": spark.createDataFrame([], "user_id long")}
    got = sorted(map(tuple, clean.violations(t, users).collect()), key=str)
    assert got == [("a", 3, 2), ("a", None, 1), ("b", 9, 1)]


def test_a_day_that_reaches_most_users_spares_readers_the_earlier_batches(spark, tmp_path):
    path, where = str(tmp_path / "newest"), str(tmp_path / "tx")
    base = table(spark, 40).withColumn("user_id", F.col("id") % 4)
    chg.write_buckets(base, where, 3)
    latest.begin(base, path, 6)
    for day, ids in ((1, range(1, 21)), (2, [3, 7])):      # all users, then one of four
        changes = spark.createDataFrame([(i, "U", i, i % 4, "5", "Food", "Expense", f"day {day}", "2026-06-01") for i in ids], CHANGES)
        latest.update(chg.read_buckets(spark, where), changes, path, day, 5, 6)
        chg.merge_changes(spark, where, changes, 3)
    assert [p.rpartition("/")[2] for p in batches._parts(spark, path)] == ["batch=1", "batch=2"]
    assert batches.read_batches(spark, path, latest.STATE).where("batch = 2").count() == 1
    got = latest.latest_transactions(latest.stored(spark, path), 5)
    want = summary.latest_transactions(chg.read_buckets(spark, where), 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_a_merge_writes_without_a_shuffle_by_bucket(spark, tmp_path):
    path = str(tmp_path / "tx")
    base = table(spark, 200)
    chg.write_buckets(base, path, 5)
    ch = spark.createDataFrame([(i, "U", i, base.first().user_id, "1", "Food", "Expense", "new", "2026-01-01") for i in range(1, 150)], CHANGES)
    assert chg.merge_changes(spark, path, ch, 5) == list(range(5))
    assert len(files(path)) <= 5 * 8                       # the join's tasks write, none of more than 5 buckets
    assert rows(chg.read_buckets(spark, path)) == rows(chg.apply_changes(base, ch))


def test_stored_states_stay_dealt_out_by_user(spark, tmp_path):
    path = str(tmp_path / "newest")
    latest.begin(table(spark, 40).withColumn("user_id", F.col("id") % 4), path)
    users = spark.range(4).select(F.col("id").alias("user_id")).repartition("user_id").hint("merge")
    plan = latest.stored(spark, path).hint("merge").join(users, "user_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2    # the aggregate's and the users': none for the join


def test_latest_months_take_one_shuffle(spark):
    rows = [(u, m, "Expense", c, 1.0, 1) for u in (1, 2, 3, None) for c in ("Food", "Bills")
            for m in [dt.date(2026, k, 1) for k in range(1, 5 if u == 1 else 2)] + [None]]
    fact = spark.createDataFrame(rows, "user_id long, month date, type string, category string, amount double, n_tx long")
    cut = facts.latest_months_slice(fact, 2)
    keep = facts.month_ranks(fact).where("mrank <= 2").select("user_id", "month")
    want = fact.join(keep, ["user_id", "month"])
    assert cut.columns == want.columns and sorted(map(tuple, cut.collect())) == sorted(map(tuple, want.collect()))
    assert cut.count() == 2 * (2 + 1 + 1)
    plan = facts.latest_months_slice(fact, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan
