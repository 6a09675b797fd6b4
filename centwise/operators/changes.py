"""Table changes as DataFrame transforms (SNK1, SNK2, SNK3, SNK7, SRC2).

Parquet has no UPDATE, so a change set produces a new table version:
deletes win (an UPDATE of a deleted row touches nothing, as in SQL), and among
updates the highest ``seq`` wins.  ``max_by`` is a partial aggregate, so a key
with very many updates is combined map-side, never gathered into one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centwise.functions.columns import MONEY, month_of
from centwise.operators.clean import parse_amount, parse_date
from centwise.schema import TRANSACTIONS
from centwise.session import materialize
from centwise.sources.batches import children, remove

KEY = ["id", "user_id"]
FIELDS = ["amount", "category", "type", "description", "date"]
# A bloom filter on id in each row group of a bucketed table, for lookups.
BLOOM = {"parquet.bloom.filter.enabled#id": "true"}
PUSHED_IDS = 1_000
BUCKETED = T.StructType([*TRANSACTIONS.fields, T.StructField("month", T.DateType()), T.StructField("bucket", T.IntegerType())])


def apply_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """SNK2 + SNK3: ``changes`` has seq, op ('U' | 'D'), id, user_id and the raw
    text columns; returns the new clean table (id, user_id, amount, category,
    type, description, date, month)."""
    return _changed(base.join(net_changes(changes), KEY, "left"))


def net_changes(changes: DataFrame) -> DataFrame:
    """(id, user_id, gone, u): what ``changes`` come to for each key, its deletion or its last update, by
    one aggregate."""
    # Order by (seq, amount): equal seqs are broken by the parsed amount so the
    # winner never depends on row order.
    order = F.struct(F.col("seq"), parse_amount(F.col("amount").cast("string")))
    return changes.where(F.col("op").isin("U", "D")).groupBy(*KEY).agg(
        F.max(F.col("op") == "D").alias("gone"),
        F.max_by(F.struct(*[F.col(c).cast("string").alias(c) for c in FIELDS]), F.when(F.col("op") == "U", order)).alias("u"))


def _changed(rows: DataFrame, *more: str) -> DataFrame:
    """The clean rows that rows with their key's ``net_changes`` become, without the deleted ones
    (all of them, where ``more`` columns are asked for)."""
    upd = F.col("u").isNotNull()
    rows = rows if more else rows.where(~F.coalesce("gone", F.lit(False)))
    return rows.select(
        *more, *KEY,
        F.when(upd, F.coalesce(parse_amount(F.col("u.amount")), F.lit(0).cast(MONEY))).otherwise(F.col("amount"))
        .alias("amount"),
        F.when(upd, F.col("u.category")).otherwise(F.col("category")).alias("category"),
        F.when(upd, F.col("u.type")).otherwise(F.col("type")).alias("type"),
        F.when(upd, F.col("u.description")).otherwise(F.col("description")).alias("description"),
        F.when(upd, parse_date(F.col("u.date"))).otherwise(F.col("date")).alias("date"),
    ).withColumn("month", month_of("date"))


def row_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, user_id, old, new) for every row of ``base`` that ``changes`` reach; both are the row's
    columns as a struct, ``new`` is null for a deleted row.  ``base`` has the columns of ``apply_changes``."""
    return net_row_changes(base, net_changes(changes))


def net_row_changes(base: DataFrame, net: DataFrame) -> DataFrame:
    """``row_changes`` from ``net_changes``: the table is shuffled once.  Rows that share a key are each
    paired with all new rows of the key."""
    cols = [*KEY, *FIELDS, "month"]
    hit = base.select(*cols, F.struct(*cols).alias("old")).join(net, KEY)
    rows = _changed(hit, "old", "gone").select(*KEY, "old", F.when(~F.col("gone"), F.struct(*cols)).alias("new"))
    return rows.withColumn("new", F.collect_list("new").over(Window.partitionBy(*KEY))).select(
        *KEY, "old", F.explode_outer("new").alias("new"))


def _bucket(buckets: int) -> F.Column:
    # of the whole key, by which a merge joins: its tasks then have few buckets each and need no shuffle to write them
    return F.pmod(F.hash(*[F.col(c).cast("long") for c in KEY]), F.lit(buckets)).cast("int")


def write_buckets(tx: DataFrame, path: str, buckets: int) -> None:
    """A transactions table in folders ``bucket=<hash of id and user_id>``.  A bucket is what a merge rewrites:
    choose ``buckets`` so that one is a few hundred MB."""
    (tx.repartition(buckets, *KEY).withColumn("bucket", _bucket(buckets)).sortWithinPartitions("bucket", "id")
     .write.mode("overwrite").options(**BLOOM).partitionBy("bucket").parquet(path))


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUCKETED).parquet(path)


def merge_changes(spark: SparkSession, path: str, changes: DataFrame, buckets: int, net: DataFrame | None = None) -> list[int]:
    """SNK2 + SNK3 on a bucketed table: rewrite only the buckets that ``changes`` touch, deletes and
    updates in one pass.  Returns those buckets (at most ``buckets`` numbers reach the driver).

    The new rows are put in place by a dynamic partition overwrite: Spark stages them and, once all are
    written, moves them folder by folder.  A bucket that got no new file lost all its rows and is removed.
    Deletes and last-write-wins updates give the same rows when applied again, so a run that died is
    repeated.  ``net`` is a stored ``net_changes(changes)``, where the job has one already.  The rows
    are written by the tasks that joined them: a bucket has at most as many files as the join has tasks."""
    net = materialize(spark, net_changes(changes), "net-changes") if net is None else net
    touched = sorted(r.bucket for r in net.select(_bucket(buckets).alias("bucket")).distinct().collect())
    if not touched:
        return []
    files = {b: children(spark, f"{path}/bucket={b}") for b in touched}
    now = read_buckets(spark, path).where(F.col("bucket").isin(touched)).drop("bucket")
    new = _changed(now.repartition(buckets, *KEY).join(net, KEY, "left"))
    (new.withColumn("bucket", _bucket(buckets)).sortWithinPartitions("bucket", "id").write.mode("overwrite")
     .options(**BLOOM).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    for b in touched:
        if children(spark, f"{path}/bucket={b}") == files[b]:
            remove(spark, f"{path}/bucket={b}")
    return touched


def lookup_buckets(spark: SparkSession, path: str, keys: DataFrame, buckets: int) -> DataFrame:
    """SRC2 on a bucketed table: the rows of (id, user_id) pairs.

    Only the buckets of the keys are read (partition pruning).  Up to ``PUSHED_IDS`` distinct ids also go
    into the scan as a filter: rows lie sorted by id in a bucket's file, whose row groups and pages
    carry the least and greatest id, and a bloom filter.  More keys are a semi-join over the buckets."""
    k = materialize(spark, keys.select(*KEY).distinct().withColumn("bucket", _bucket(buckets)), "lookup-keys")
    touched = [r.bucket for r in k.select("bucket").distinct().collect() if r.bucket is not None]
    ids = [r.id for r in k.select("id").distinct().limit(PUSHED_IDS + 1).collect()]
    rows = read_buckets(spark, path).where(F.col("bucket").isin(touched))
    if len(ids) <= PUSHED_IDS:
        rows = rows.where(F.col("id").isin(ids))
    return lookup(rows.drop("bucket"), k)


def append_transactions(table_path: str, new_rows: DataFrame) -> None:
    """SNK1: append validated rows."""
    new_rows.write.mode("append").parquet(table_path)


def seed_income(users: DataFrame, tx: DataFrame, as_of: dt.date) -> DataFrame:
    """SNK7: a zero 'Salary' income row for every user without any income."""
    has_income = tx.filter(F.col("type") == "Income").select("user_id").distinct()
    return users.select(F.col("id").alias("user_id")).join(has_income, "user_id", "left_anti").select(
        "user_id", F.lit(0).cast(MONEY).alias("amount"), F.lit("Salary").alias("category"),
        F.lit("Income").alias("type"), F.lit("Initial balance setup").alias("description"),
        F.lit(as_of).alias("date"))


def lookup(tx: DataFrame, keys: DataFrame) -> DataFrame:
    """SRC2 in bulk: the rows matching (id, user_id) pairs (a semi-join)."""
    return tx.join(keys.select(*KEY), KEY, "left_semi")
