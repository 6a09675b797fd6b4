"""TOP1 kept up to date: each user's newest transactions as stored state.

A user's state holds the newest rows, at most ``KEEP`` of them, and says whether they are all the
user has.  A batch of changed rows takes out old versions, puts in new ones that are not older than
the last row held, and cuts again.  Deletions eat into the rows beyond the k that readers ask for;
only when fewer than k are left of a user who has more are that user's rows read again from the
table.  So a batch reads and writes the states of the users it changes, and rarely a raw row.

States are committed as numbered batches (``sources.batches``), the newest of a user counts; a batch that
reaches half of the users holds the states of the others too, as they were, and readers begin with it.

Defined cases: the order is (date, id), newest first, a null date last; a user whose rows are all gone keeps
an empty state and has no rows; a user unknown so far begins with the new rows; changes of rows that
are not there reach nothing (``changes.row_changes``); a repeated batch changes nothing; empty tables
give empty states.  A row of a null user is in the first state and no change reaches it, as no key
equals null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centwise.functions.columns import dbl
from centwise.operators.changes import apply_changes, row_changes
from centwise.session import materialize
from centwise.sources import batches

KEEP = 20                                                  # rows held a user; readers ask for 5
ROW = T.StructType([T.StructField("date", T.DateType()), T.StructField("id", T.LongType()),
                    T.StructField("amount", T.DecimalType(18, 2)), T.StructField("category", T.StringType()),
                    T.StructField("type", T.StringType()), T.StructField("description", T.StringType())])
STATE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("version", T.LongType()),
                      T.StructField("complete", T.BooleanType()), T.StructField("rows", T.ArrayType(ROW))])


def _row(source: str = "") -> F.Column:
    return F.struct(*[F.col(source + f.name).cast(f.dataType).alias(f.name) for f in ROW.fields])


def _newest(rows: DataFrame, keep: int) -> DataFrame:
    """(user_id, complete, rows) of the ``keep`` newest of (user_id, r).  The rank is cut before the
    shuffle, so a user with a third of all rows sends each task's newest only."""
    w = Window.partitionBy("user_id").orderBy(F.col("r.date").desc(), F.col("r.id").desc())
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep + 1)
    listed = F.array_sort(F.collect_list(F.struct("rank", "r")))
    return (top.groupBy("user_id").agg(listed.alias("l"))
            .select("user_id", (F.size("l") <= keep).alias("complete"),
                    F.transform(F.slice("l", 1, keep), lambda x: x["r"]).alias("rows")))


def _versioned(states: DataFrame, version: int) -> DataFrame:
    return states.withColumn("version", F.lit(version).cast("long")).select(*STATE.names)


def begin(tx: DataFrame, path: str, keep: int = KEEP) -> None:
    """The states of a whole table, as batch 0."""
    batches.write_batch(_versioned(_newest(tx.select("user_id", _row().alias("r")), keep), 0), path, 0)


def stored(spark: SparkSession, path: str, before: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """The newest state of each user (of the users of a table; by the batches before a number)."""
    return batches.read_newest(spark, path, STATE, ["user_id"], "version", before, of)


def update(table: DataFrame, changes: DataFrame, path: str, number: int, k: int = 5, keep: int = KEEP,
           delta: DataFrame | None = None) -> None:
    """Commit what ``changes`` make of the states as batch ``number``; ``table`` is the bucketed table
    before they are merged into it.  States come first: a run that died before its merge is repeated whole.
    ``delta`` is a stored ``row_changes(table, changes)``, where the job has one already."""
    spark = table.sparkSession
    if number in batches.complete(spark, path):
        return
    delta = materialize(spark, row_changes(table, changes), "latest-delta") if delta is None else delta
    changed = _changed_rows(delta, keep)
    whole = _most_change(spark, path, number, delta)
    old = stored(spark, path, number, None if whole else delta.select("user_id").distinct())
    had_all, rows = F.coalesce("complete", F.lit(True)), F.coalesce("rows", F.array().cast(T.ArrayType(ROW)))
    floor = F.when(~had_all, F.try_element_at(rows, F.lit(-1)))
    held = F.filter(rows, lambda r: ~F.coalesce(F.array_contains("gone", r["id"]), F.lit(False)))
    new = F.filter(F.coalesce("new", F.array().cast(T.ArrayType(ROW))), lambda r: floor.isNull() | (
        F.struct(r["date"], r["id"]) >= F.struct(floor["date"], floor["id"])))
    found = old.join(changed, "user_id", "full").select(
        "user_id", had_all.alias("had_all"), F.sort_array(F.concat(held, new), asc=False).alias("found")).select(
        "user_id", (F.col("had_all") & (F.size("found") <= keep)).alias("complete"), F.slice("found", 1, keep).alias("rows"))
    states = batches.stage_batch(_versioned(found, number), path, number)
    is_short = ~F.col("complete") & (F.size("rows") < k)
    short = states.where(is_short).select("user_id")
    if short.isEmpty():
        batches.publish(spark, batches.folder(path, number))
    else:
        again = apply_changes(table.join(short, "user_id", "left_semi"), changes.join(short, "user_id", "left_semi"))
        refilled = _newest(again.select("user_id", _row().alias("r")), keep)
        none = short.join(refilled, "user_id", "left_anti").select(
            "user_id", F.lit(True).alias("complete"), F.array().cast(T.ArrayType(ROW)).alias("rows"))
        states = states.where(~is_short).drop("version").unionByName(refilled).unionByName(none)
        batches.write_batch(materialize(spark, _versioned(states, number), "latest-cut"), path, number)
    if whole:
        batches.mark_whole(spark, path, number)


def _changed_rows(delta: DataFrame, keep: int) -> DataFrame:
    """(user_id, gone, new): the ids and the new rows of ``delta`` that can matter to a state.  An old row
    that a state holds is among its user's newest ``keep`` old ones.  Both are cut before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.col("r.date").desc(), F.col("r.id").desc())
    old = delta.select("user_id", F.struct("old.date", "old.id").alias("r"))
    gone = old.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= keep).groupBy("user_id").agg(
        F.collect_set("r.id").alias("gone"))
    new = delta.where(F.col("new").isNotNull()).select("user_id", _row("new.").alias("r"))
    top = new.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep + 1).groupBy("user_id").agg(
        F.collect_list("r").alias("new"))
    return gone.join(top, "user_id", "left")


def _most_change(spark: SparkSession, path: str, number: int, delta: DataFrame) -> bool:
    """Whether ``delta`` reaches half of the users: then all states are written, so that the next
    reader need not visit a batch for each day."""
    states = batches.count_rows(spark, path, STATE, number)
    return 2 * delta.agg(F.approx_count_distinct("user_id")).first()[0] >= states > 0


def latest_transactions(states: DataFrame, k: int = 5) -> DataFrame:
    """The rows of ``summary.latest_transactions`` from the states; k is at most what ``update`` was told."""
    r = states.select("user_id", F.posexplode(F.slice("rows", 1, k)).alias("pos", "r"))
    return r.select("r.id", "user_id", dbl(F.col("r.amount")).alias("amount"), "r.category", "r.type", "r.description",
                    F.date_format("r.date", "yyyy-MM-dd").alias("date"), (F.col("pos") + 1).cast("long").alias("rank"))
