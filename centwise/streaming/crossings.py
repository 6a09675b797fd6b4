"""Budget-threshold crossings over arriving expenses (STR1, STR2, STR4).

A crossing is the first transaction, in id order, after which the running spend of (user, category,
month) reaches a threshold of the budget, tested on the usage percent rounded to one digit -- the
same test the batch alert uses.  Each (user, category, month, threshold) is announced once.

* ``replay_crossings`` is the exact batch form (STR2).  A plain running-sum
  window over a (user, category, month) group would put a hot group in one
  task, so it runs in three steps: per-(group, id-bucket) partial sums (a
  partial aggregate), a prefix sum over buckets (one row per bucket), and a
  running-sum window only inside the one bucket that crosses.  A task never
  holds more than one bucket of one group.
* ``CrossingJob`` is the Structured Streaming form (STR1/STR4): ``foreachBatch`` over tables of
  committed batches (``sources.batches``), all in the JVM.  A micro-batch is aggregated by group and
  meets the stored totals of just its groups.  A group that stays below the lowest threshold costs no
  more.  One that has reached it is replayed: over the micro-batch alone, from the stored total, if its
  rows follow the earlier ones in id order, else over the group's stored rows of that month.  So the
  outcome does not depend on how rows were cut into micro-batches or in which order these came, and
  a repeated micro-batch writes nothing twice.  The earlier rows lie in folders by month; only the
  months a micro-batch touches are read, and ``close_after`` drops a month's state for good.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centwise.functions.columns import MONEY, div, rnd
from centwise.schema import CROSSING_THRESHOLDS
from centwise.sources import batches

GROUP = ["user_id", "category", "month"]
KEY = [*GROUP, "threshold_percent"]
ID_BUCKET = 1 << 20
ROWS_PER_TASK = 1 << 17                        # of a micro-batch's replay, on average

OUT_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("threshold_percent", T.IntegerType()),
    T.StructField("id", T.LongType()),
    T.StructField("running_spent", T.DoubleType()),
    T.StructField("usage_percent", T.DoubleType()),
])


def _with_budget(tx: DataFrame, budgets: DataFrame | None, flat_budget: float | None) -> DataFrame:
    if budgets is not None:
        return tx.join(budgets.select("user_id", "category", F.col("monthly_budget").cast(MONEY).alias("budget")),
                       ["user_id", "category"])
    return tx.withColumn("budget", F.lit(flat_budget).cast(MONEY))


def _usage(spent: F.Column, budget: F.Column) -> F.Column:
    return rnd(F.when(budget > 0, div(spent, budget) * 100.0).otherwise(F.lit(0.0)), 1)


def replay_crossings(tx: DataFrame, budgets: DataFrame | None = None, flat_budget: float | None = None,
                     thresholds: tuple[int, ...] = CROSSING_THRESHOLDS, bucket: int = ID_BUCKET) -> DataFrame:
    """STR2: exact first crossing row per (user, category, month, threshold).

    ``tx``: id, user_id, category, amount (non-negative), month (date).
    """
    t = tx.filter(F.col("type") == "Expense") if "type" in tx.columns else tx
    t = t.withColumn("month", F.date_format("month", "yyyy-MM"))
    return _replay(_with_budget(t, budgets, flat_budget), thresholds, bucket)


def _replay(t: DataFrame, thresholds: tuple[int, ...], bucket: int = ID_BUCKET, spent: DataFrame | None = None,
            tasks: int | None = None) -> DataFrame:
    """Crossings among rows (id, GROUP, amount, budget) of groups that start at ``spent`` (GROUP, start).
    With ``tasks`` the rows are sorted in so many, which Spark does not merge to as few as there are cores."""
    t = t.select("id", *GROUP, "amount", "budget", F.floor(F.col("id") / bucket).alias("bkt"))
    keys = GROUP + ["bkt"]
    spread = (lambda df: df.repartition(tasks, *keys)) if tasks else (lambda df: df)
    sums = t.groupBy(*keys).agg(F.sum("amount").alias("bsum"), F.first("budget").alias("budget"))
    w = Window.partitionBy(*GROUP).orderBy("bkt")
    sums = sums.withColumn("after", F.sum("bsum").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if spent is not None:
        sums = sums.join(spent, GROUP, "left").withColumn("after", F.col("after") + F.coalesce("start", F.lit(0).cast(MONEY)))
    sums = sums.withColumn("before", F.col("after") - F.col("bsum"))
    ths = F.explode(F.array(*[F.lit(int(x)) for x in sorted(thresholds)])).alias("threshold_percent")
    hit = sums.select("*", ths).filter(
        (_usage(F.col("after"), F.col("budget")) >= F.col("threshold_percent"))
        & (_usage(F.col("before"), F.col("budget")) < F.col("threshold_percent")))
    rows = spread(t).join(spread(hit.select(*keys, "threshold_percent", "before")), keys)
    wr = Window.partitionBy(*keys, "threshold_percent").orderBy("id")
    rows = rows.withColumn("running", F.col("before") + F.sum("amount").over(wr.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("usage_percent", _usage(F.col("running"), F.col("budget")))
    first = (rows.filter(F.col("usage_percent") >= F.col("threshold_percent"))
             .withColumn("rn", F.row_number().over(wr)).filter(F.col("rn") == 1))
    return first.select(*GROUP, F.col("threshold_percent").cast("int"), "id",
                        F.col("running").cast("double").alias("running_spent"), "usage_percent")


# ---- Structured Streaming --------------------------------------------------------

_GROUP_FIELDS = [T.StructField("user_id", T.LongType()), T.StructField("category", T.StringType()), T.StructField("month", T.StringType())]
ROWS = T.StructType([T.StructField("id", T.LongType()), *_GROUP_FIELDS[:2], T.StructField("amount", T.DecimalType(18, 2)),
                     _GROUP_FIELDS[2]])
TOTALS = {"amount": "sum", "n": "sum", "first": "min", "last": "max"}
STATE = T.StructType([*_GROUP_FIELDS, T.StructField("amount", T.DecimalType(28, 2)), T.StructField("n", T.LongType()),
                      T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
EVENTS = T.StructType([*OUT_SCHEMA.fields, T.StructField("is_new", T.BooleanType())])


@dataclass
class CrossingJob:
    """One stream's tables under ``base``: ``rows`` (the expenses, by month), ``state`` (totals by
    group) and ``events`` (crossings as they were found).

    ``fold_every`` micro-batches the totals are folded into one base.  With ``close_after`` = k, months
    more than k before the newest one seen are closed: their late rows are left out, their state goes."""

    base: str
    budgets: DataFrame | None = None
    flat_budget: float | None = None
    thresholds: tuple[int, ...] = CROSSING_THRESHOLDS
    fold_every: int = 16
    close_after: int | None = None

    def _expenses(self, events: DataFrame) -> DataFrame:
        if "type" in events.columns:                       # income is no spending
            events = events.filter(F.col("type") == "Expense")
        return events.filter(F.col("ts").isNotNull()).select(
            "id", "user_id", "category", F.col("amount").cast(MONEY).alias("amount"), F.date_format("ts", "yyyy-MM").alias("month"))

    def _open_from(self, spark: SparkSession, rows: DataFrame, batch: int) -> str | None:
        """The first open month, from the months of this micro-batch and of earlier ones."""
        if self.close_after is None:
            return None
        state = batches.read_total(spark, f"{self.base}/state", STATE, GROUP, TOTALS, batch - 1)
        newest = rows.select("month").unionByName(state.select("month")).agg(F.max("month")).first()[0]
        if newest is None:
            return None
        months = int(newest[:4]) * 12 + int(newest[5:]) - 1 - self.close_after
        return dt.date(months // 12, months % 12 + 1, 1).strftime("%Y-%m")

    def __call__(self, events: DataFrame, batch: int) -> None:
        """Take one micro-batch; taking it again changes nothing."""
        spark, base = events.sparkSession, self.base
        rows = self._expenses(events)
        since = self._open_from(spark, rows, batch)
        if since is not None:
            rows = rows.where(F.col("month") >= since)
        rows = batches.write_batch(rows, f"{base}/rows", batch, ("month",))
        own = batches.write_batch(rows.groupBy(*GROUP).agg(
            F.sum("amount").cast("decimal(28,2)").alias("amount"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first"),
            F.max("id").alias("last")), f"{base}/state", batch)
        months = [r.month for r in own.select("month").distinct().collect()]
        hot = self._hot(spark, own, months, batch)
        stray = hot.where(~F.col("in_order"))
        found = _replay(rows.join(hot.where("in_order"), GROUP), self.thresholds, spent=hot.select(*GROUP, "start"),
                        tasks=self._tasks(own))
        if not stray.isEmpty():
            earlier = batches.read_batches(spark, f"{base}/rows", ROWS, before=batch + 1).where(F.col("month").isin(months))
            stored = batches.read_total(spark, f"{base}/state", STATE, GROUP, TOTALS, batch).join(stray, GROUP, "left_semi")
            found = found.unionByName(_replay(earlier.join(stray, GROUP), self.thresholds, tasks=self._tasks(stored)))
        known = (batches.read_batches(spark, f"{base}/events", EVENTS, before=batch).where(F.col("month").isin(months))
                 .groupBy(*KEY).agg(F.max_by("id", "batch").alias("known_id"), F.max_by("running_spent", "batch").alias("known_spent")))
        news = found.join(known, KEY, "left").withColumn("is_new", F.col("known_id").isNull())
        news = news.where(F.col("is_new") | (F.col("id") != F.col("known_id")) | (F.col("running_spent") != F.col("known_spent")))
        batches.write_batch(news.select(*EVENTS.names), f"{base}/events", batch)
        batches.remove(spark, f"{base}/hot-{batch}")
        if batch % self.fold_every == self.fold_every - 1:
            batches.fold(spark, f"{base}/state", STATE, GROUP, TOTALS, None if since is None else F.col("month") >= since)
            batches.drop_folded(spark, f"{base}/state")
        if since is not None:
            self._close(spark, since)

    @staticmethod
    def _tasks(totals: DataFrame) -> int | None:
        """In how many tasks to replay the rows that ``totals`` counts; left to Spark where they are few."""
        n = totals.agg(F.sum("n")).first()[0] or 0
        return -(-n // ROWS_PER_TASK) if n > ROWS_PER_TASK else None

    def _hot(self, spark: SparkSession, own: DataFrame, months: list[str], batch: int) -> DataFrame:
        """(GROUP, start, budget, in_order) of the micro-batch's groups that have reached a threshold."""
        prior = (batches.read_total(spark, f"{self.base}/state", STATE, GROUP, TOTALS, batch - 1).where(F.col("month").isin(months))
                 .select(*GROUP, F.col("amount").alias("start"), F.col("last").alias("prior_last")))
        g = _with_budget(own.join(prior, GROUP, "left"), self.budgets, self.flat_budget)
        start = F.coalesce("start", F.lit(0).cast("decimal(28,2)"))
        hot = g.where(_usage(start + F.col("amount"), F.col("budget")) >= min(self.thresholds)).select(
            *GROUP, start.alias("start"), "budget", F.coalesce(F.col("prior_last") < F.col("first"), F.lit(True)).alias("in_order"))
        path = f"{self.base}/hot-{batch}"
        hot.write.mode("overwrite").parquet(path)
        return spark.read.schema(hot.schema).parquet(path)

    def _close(self, spark: SparkSession, since: str) -> None:
        """Remove the stored rows of closed months; their totals go with the next fold."""
        for n in batches.complete(spark, f"{self.base}/rows"):
            own = batches.folder(f"{self.base}/rows", n)
            for name in batches.children(spark, own):
                if name.startswith("month=") and name[len("month="):] < since:
                    batches.remove(spark, f"{own}/{name}")

    def crossings(self, spark: SparkSession) -> DataFrame:
        """The crossings as of the last micro-batch: the latest finding for each key."""
        last = batches.read_batches(spark, f"{self.base}/events", EVENTS).groupBy(*KEY).agg(
            F.max_by(F.struct("id", "running_spent", "usage_percent"), "batch").alias("e"))
        return last.select(*KEY, "e.id", "e.running_spent", "e.usage_percent").select(*OUT_SCHEMA.names)

    def announced(self, spark: SparkSession) -> DataFrame:
        """Every key once, as it was first found, with its micro-batch: what went out as a message."""
        return batches.read_batches(spark, f"{self.base}/events", EVENTS).where("is_new").drop("is_new")


def run_crossings(spark: SparkSession, stream: DataFrame, job: CrossingJob) -> DataFrame:
    """Run ``job`` over a stream (id, user_id, category, amount, ts, maybe type) to the end of what is
    there, and read the crossings back.  Run again, it goes on after the last committed micro-batch."""
    q = (stream.writeStream.foreachBatch(job).option("checkpointLocation", f"{job.base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return job.crossings(spark)
