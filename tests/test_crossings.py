"""Stream = batch replay for crossings, and the bucketed replay equals a plain
running-sum window regardless of bucket size."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from centwise.functions.columns import rnd, div
from centwise.sources import batches
from centwise.sources import testdata as td
from centwise.streaming import crossings as crs
from centwise.streaming import runner as srun

SF = "/root/testdata/sf0.001"


def _brute(tx, budget):
    w = Window.partitionBy("user_id", "category", "month").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    r = tx.withColumn("running", F.sum("amount").over(w))
    r = r.withColumn("usage_percent", rnd(div("running", F.lit(budget).cast("decimal(18,2)")) * 100.0, 1))
    r = r.select("*", F.explode(F.array(F.lit(85), F.lit(100))).alias("threshold_percent"))
    r = r.filter(F.col("usage_percent") >= F.col("threshold_percent"))
    w2 = Window.partitionBy("user_id", "category", "month", "threshold_percent").orderBy("id")
    r = r.withColumn("rn", F.row_number().over(w2)).filter("rn = 1")
    return sorted((x.user_id, x.category, x.threshold_percent, x.id, x.usage_percent) for x in r.collect())


def _rows(df):
    return sorted((x.user_id, x.category, x.threshold_percent, x.id, x.usage_percent) for x in df.collect())


def test_bucketed_replay_matches_window(spark):
    tx = td.event_transactions(spark, SF)
    budget = 300.0
    want = _brute(tx, budget)
    assert want
    for bucket in (7, 64, 1 << 20):
        assert _rows(crs.replay_crossings(tx, flat_budget=budget, bucket=bucket)) == want


def test_stream_over_many_files_equals_replay(spark, tmp_path):
    ev = td.table(spark, SF, "events")
    folder = str(tmp_path / "incoming")
    os.makedirs(folder)
    # four files in arrival order, one micro-batch each
    bounds = ev.select(F.percentile_approx("event_id", [0.25, 0.5, 0.75]).alias("q")).collect()[0].q
    edges = [-1] + list(bounds) + [1 << 62]
    for i in range(4):
        part = ev.filter((F.col("event_id") > edges[i]) & (F.col("event_id") <= edges[i + 1]))
        part.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        src = [f for f in os.listdir(tmp_path / f"p{i}") if f.endswith(".parquet")][0]
        os.link(tmp_path / f"p{i}" / src, os.path.join(folder, f"events-{i}.parquet"))
    stream = srun.file_stream(spark, folder, "events", srun.EVENTS_SCHEMA)
    s = stream.select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("category"),
                      F.col("value").cast("decimal(18,2)").alias("amount"), F.col("ts").cast("timestamp").alias("ts"))
    got = crs.run_crossings(spark, s, crs.CrossingJob(str(tmp_path / "job"), flat_budget=300.0, fold_every=2))
    want = crs.replay_crossings(td.event_transactions(spark, SF), flat_budget=300.0)
    assert _rows(got) == _rows(want)
    assert len(_rows(got)) > 0


def _taken(spark, tmp_path, parts, again=(), **kw):
    """A job that took the parts as micro-batches 0, 1, ..., some of them twice."""
    job = crs.CrossingJob(str(tmp_path / "job"), **kw)
    for i, part in enumerate(parts):
        job(td.as_transactions(part), i)
        if i in again:
            job(td.as_transactions(part), i)
    return job


def test_state_drops_closed_months(spark, tmp_path):
    """STR4: months that closed leave the stored rows, their late rows count no more, the events stay."""
    rows = [(i, f"2024-0{1 + i // 40}-{1 + i % 28:02d}", "click", 10.0) for i in range(120)]
    parts = [_events(spark, rows[:40]), _events(spark, rows[40:80]), _events(spark, rows[80:]),
             _events(spark, [(900, "2024-01-30", "click", 1000.0), (901, "2024-03-30", "click", 1.0)])]
    job = _taken(spark, tmp_path, parts, flat_budget=1000.0, close_after=1)
    stored = batches.read_batches(spark, f"{job.base}/rows", crs.ROWS)
    assert {r.month for r in stored.select("month").distinct().collect()} == {"2024-02", "2024-03"}
    assert stored.where("id = 900").count() == 0
    assert {(r.month, r.threshold_percent) for r in job.crossings(spark).collect()} == set()
    open_ = _taken(spark, tmp_path / "open", parts, flat_budget=1000.0)
    assert {(r.month, r.threshold_percent) for r in open_.crossings(spark).collect()} == {("2024-01", 85), ("2024-01", 100)}


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [3, 0, 5, 1, 4, 2]])
def test_any_order_of_batches_equals_the_replay(spark, tmp_path, order):
    rows = [(i, "2024-01-10" if i % 7 else "2024-02-03", ["click", "view", "purchase", "signup"][i % 4], 0.5 + i % 9) for i in range(360)]
    parts = [_events(spark, rows[i::6] if order[0] == 3 else rows[60 * i:60 * i + 60]) for i in order]
    budgets = spark.createDataFrame([(1, "Food", 300.0), (1, "Entertainment", 250.0), (1, "Shopping", 9000.0)],
                                    "user_id long, category string, monthly_budget double")
    job = _taken(spark, tmp_path, parts, again=(1, 4), budgets=budgets, fold_every=3)
    want = crs.replay_crossings(td.as_transactions(_events(spark, rows)), budgets=budgets)
    full = lambda df: sorted(map(tuple, df.collect()))
    assert full(job.crossings(spark)) == full(want) and len(full(want)) >= 4
    keys = [tuple(r)[:4] for r in job.announced(spark).collect()]
    assert len(keys) == len(set(keys)) and set(keys) == {tuple(r)[:4] for r in want.collect()}


def test_a_batch_that_died_half_way_is_repeated(spark, tmp_path):
    rows = [(i, "2024-01-10", "click", 10.0) for i in range(40)]
    parts = [_events(spark, rows[:20]), _events(spark, rows[20:])]
    job = _taken(spark, tmp_path, parts, flat_budget=300.0)
    want = sorted(map(tuple, job.crossings(spark).collect()))
    for table in ("events", "state"):                      # the second batch died before its last commits
        os.remove(f"{job.base}/{table}/batch=1/_SUCCESS")
    assert sorted(map(tuple, job.crossings(spark).collect())) != want
    job(td.as_transactions(parts[1]), 1)
    assert sorted(map(tuple, job.crossings(spark).collect())) == want


def _streamed(spark, tmp_path, parts, **kw):
    """Crossings of a stream that takes one of ``parts`` (event tables) per micro-batch, with the
    files' times in the order of the parts."""
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"x{i}"))
        src = [f for f in os.listdir(tmp_path / f"x{i}") if f.endswith(".parquet")][0]
        dst = os.path.join(folder, f"events-{i}.parquet")
        os.link(tmp_path / f"x{i}" / src, dst)
        os.utime(dst, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    s = td.as_transactions(srun.file_stream(spark, folder, "events", srun.EVENTS_SCHEMA))
    return crs.run_crossings(spark, s, crs.CrossingJob(str(tmp_path / "job"), **kw))


def _events(spark, rows):
    return spark.createDataFrame([(i, t, 1, k, v, None) for i, t, k, v in rows],
                                 "event_id long, ts string, user_id long, event_type string, value double, props string"
                                 ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_late_rows_of_an_open_month_count(spark, tmp_path):
    """Rows weeks behind the newest one still count, in their own month and in the month before;
    income does not."""
    parts = [_events(spark, [(1, "2024-01-20", "click", 50.0), (2, "2024-01-20", "click", 1.0)]),
             _events(spark, [(3, "2024-01-05", "click", 40.0), (4, "2024-01-21", "signup", 500.0)]),
             _events(spark, [(5, "2024-02-27", "click", 10.0)]),
             _events(spark, [(6, "2024-01-06", "click", 20.0)])]
    got = _streamed(spark, tmp_path, parts, flat_budget=100.0)
    assert [(r.month, r.threshold_percent, r.id) for r in got.orderBy("id", "threshold_percent").collect()] == [
        ("2024-01", 85, 3), ("2024-01", 100, 6)]


def test_shuffled_batch_with_budgets(spark, tmp_path):
    rows = [(i, "2024-01-10", ["click", "view", "signup"][i % 3], 1.0 + i % 5) for i in range(300)]
    ev = _events(spark, rows[::-1])
    budgets = spark.createDataFrame([(1, "Food", 100.0), (1, "Entertainment", 90.0)],
                                    "user_id long, category string, monthly_budget double")
    got = _streamed(spark, tmp_path, [ev], budgets=budgets)
    want = crs.replay_crossings(td.as_transactions(ev), budgets=budgets)
    assert _rows(got) == _rows(want) and len(_rows(got)) == 4


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    ev = td.table(spark, SF, "events")
    later = ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL 100 DAYS")).withColumn("event_id", F.col("event_id") + 10_000_000)
    both = ev.unionByName(later)
    # the newest month in the first part file, a file per micro-batch
    both.repartitionByRange(4, F.col("event_id").desc()).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    s = td.as_transactions(srun.file_stream(spark, str(tmp_path / "sf"), "events", srun.EVENTS_SCHEMA, part_files_per_trigger=1))
    got = crs.run_crossings(spark, s, crs.CrossingJob(str(tmp_path / "job"), flat_budget=300.0))
    want = crs.replay_crossings(td.as_transactions(both), flat_budget=300.0)
    assert _rows(got) == _rows(want) and len(_rows(got)) > 0
    batch = srun.run_foreach_batch(spark, srun.file_stream(spark, str(tmp_path / "sf"), "events", srun.EVENTS_SCHEMA),
                                   "t_stream_parts_each", srun.EVENTS_SCHEMA, lambda b: b)
    assert batch.count() == both.count()


def test_stream_without_files_fails(spark, tmp_path):
    os.makedirs(tmp_path / "sf" / "documents.parquet")
    for table in ("events", "documents"):
        with pytest.raises(FileNotFoundError):
            srun.file_stream(spark, str(tmp_path / "sf"), table, srun.EVENTS_SCHEMA)
