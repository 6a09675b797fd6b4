"""File sources and sinks with declared schemas (SRC6, SNK1, SNK10).  Never inferSchema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centwise.schema import TRAINING


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: labelled seed rows (description, category) from CSV with a header."""
    return (spark.read.option("header", True).option("mode", "PERMISSIVE").schema(TRAINING).csv(path))


def append_transactions(df: DataFrame, path: str) -> None:
    """SNK1: append validated transactions to the table at ``path``."""
    df.write.mode("append").parquet(path)


def transactions_feed(tx: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """SNK10: one JSON object per transaction, newest first per user by
    (date desc, id desc) -- the ``rank`` column carries that order.

    Rows are counted per (user, date, id bucket); a running sum over these counts gives each
    bucket its offset, and rows are ranked inside their bucket only, so no task holds all
    rows of a user.  The join on the bucket's key also meets a null date."""
    from pyspark.sql import Window
    key = ["user_id", "date", "bkt"]
    t = tx.withColumn("bkt", F.floor(F.col("id") / bucket))
    order = [F.col("date").desc(), F.col("bkt").desc()]
    before = F.sum("n").over(Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    offsets = t.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.coalesce(before, F.lit(0)).alias("offset"))
    o = offsets.select(*[F.col(k).alias(f"_{k}") for k in key], "offset")
    meet = F.lit(True)
    for k in key:
        meet = meet & F.col(k).eqNullSafe(F.col(f"_{k}"))
    t = t.join(o, meet)
    w = Window.partitionBy(*key).orderBy(F.col("id").desc())
    body = F.to_json(F.struct("id", "user_id", F.col("amount").cast("double").alias("amount"), "category", "type",
                              "description", F.date_format("date", "yyyy-MM-dd").alias("date")))
    rank = F.col("offset") + F.row_number().over(w)
    return t.select("user_id", rank.cast("long").alias("rank"), body.alias("json"))


__all__ = ["read_training_csv", "append_transactions", "transactions_feed"]
