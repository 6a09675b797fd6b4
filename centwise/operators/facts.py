"""The shared monthly fact and the period filters (FIL1-FIL7).

``monthly_fact`` is the one shuffle most analytics share: clean transactions
grouped by (user_id, month, type, category) with an exact decimal sum.  Its
size is users x months x categories, independent of transaction volume, so
every later window over it is bounded per user.  A hot user is absorbed by
the partial (map-side) aggregate before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centwise.functions.columns import EXPENSE, INCOME, MONEY
from centwise.sources import batches


def monthly_fact(tx: DataFrame) -> DataFrame:
    return tx.groupBy("user_id", "month", "type", "category").agg(
        F.sum("amount").cast("decimal(28,2)").alias("amount"),
        F.count(F.lit(1)).alias("n_tx"),
    )


FACT_KEYS = ["user_id", "month", "type", "category"]
FACT_TOTALS = {"amount": "sum", "n_tx": "sum"}
FACT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("month", T.DateType()),
                     T.StructField("type", T.StringType()), T.StructField("category", T.StringType()),
                     T.StructField("amount", T.DecimalType(28, 2)), T.StructField("n_tx", T.LongType())])


def fact_deltas(row_changes: DataFrame) -> DataFrame:
    """What changed rows (``changes.row_changes``) add to the monthly fact: a changed row is taken
    out of its old key and put into its new one.  Only keys of changed rows appear, so a batch of
    this table costs as much as the changes, whatever the size of the fact."""
    row = lambda side, sign: F.when(F.col(side).isNotNull(), F.struct(F.lit(sign).alias("sign"), F.col(side).alias("r")))
    both = row_changes.select(F.explode(F.filter(F.array(row("old", -1), row("new", 1)), lambda x: x.isNotNull())).alias("x"))
    signed = both.select(*[F.col(f"x.r.{k}").alias(k) for k in FACT_KEYS], (F.col("x.r.amount") * F.col("x.sign")).alias("amount"),
                         F.col("x.sign").cast("long").alias("n_tx"))
    return (signed.groupBy(*FACT_KEYS).agg(F.sum("amount").cast("decimal(28,2)").alias("amount"), F.sum("n_tx").alias("n_tx"))
            .where("amount != 0 OR n_tx != 0"))


def stored_fact(spark: SparkSession, path: str) -> DataFrame:
    """The monthly fact kept as additive batches at ``path`` (``sources.batches``)."""
    return batches.read_total(spark, path, FACT, FACT_KEYS, FACT_TOTALS)


def month_totals(fact: DataFrame) -> DataFrame:
    """Per (user, present month): income, expense (exact decimals)."""
    return fact.groupBy("user_id", "month").agg(
        F.coalesce(F.sum(F.when(F.col("type") == INCOME, F.col("amount"))), F.lit(0).cast(MONEY)).alias("income"),
        F.coalesce(F.sum(F.when(F.col("type") == EXPENSE, F.col("amount"))), F.lit(0).cast(MONEY)).alias("expense"),
    )


def month_ranks(fact: DataFrame) -> DataFrame:
    """Present months per user, newest first: mrank 1 = latest, 2 = previous (WIN1).

    ``distinct`` is a partial hash aggregate (skew-safe); the window runs over
    one row per (user, month)."""
    w = Window.partitionBy("user_id").orderBy(F.col("month").desc())
    return fact.select("user_id", "month").distinct().withColumn("mrank", F.row_number().over(w))


def latest_month(fact: DataFrame) -> DataFrame:
    return fact.groupBy("user_id").agg(F.max("month").alias("latest_month"))


def filter_range(tx: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Days from ``start`` to before ``end``: a range on the date that reaches the parquet scan."""
    return tx.filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))


def month_start(as_of: dt.date, shift: int = 0) -> dt.date:
    """The first day of the month ``shift`` months from that of ``as_of``."""
    n = as_of.year * 12 + as_of.month - 1 + shift
    return dt.date(n // 12, n % 12 + 1, 1)


def expense_months(fact: DataFrame) -> DataFrame:
    """AGG4 source: monthly expense totals for months with expenses."""
    return (
        fact.filter(F.col("type") == EXPENSE)
        .groupBy("user_id", "month")
        .agg(F.sum("amount").alias("amount"))
    )



def latest_months_slice(fact: DataFrame, n: int = 2) -> DataFrame:
    """The fact rows of each user's ``n`` latest present months.

    Everything that looks only at the latest / previous month (context,
    suggestions, budget usage, increases) gives the same answer on this slice
    as on the whole fact, because month ranks among the kept months are
    unchanged; the slice is users x n x categories rows."""
    # one shuffle; months beyond the n latest are cut before it.  Rows without a user or month are in no one's.
    w = Window.partitionBy("user_id").orderBy(F.col("month").desc())
    return (fact.where(F.col("user_id").isNotNull() & F.col("month").isNotNull())
            .withColumn("__rank", F.dense_rank().over(w)).where(F.col("__rank") <= n)
            .select("user_id", "month", *[c for c in fact.columns if c not in ("user_id", "month")]))
