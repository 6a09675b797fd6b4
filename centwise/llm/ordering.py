"""Row numbers within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from centwise.llm.common import materialize

PART_BITS = 33                                             # of monotonically_increasing_id


def laid_out(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """``rows`` written in the order of (group, order), range-partitioned on all of it, with ``seq``
    increasing in that order.  A group of many rows lies in many partitions; end ``order`` with a
    row's own number, so that equal rows are split too."""
    return materialize(rows.sparkSession, rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                       .withColumn("seq", F.monotonically_increasing_id()), name)


def part_of(seq):
    return F.shiftright(seq, PART_BITS)


def spans(laid: DataFrame, group: str) -> DataFrame:
    """(group, part, first, before, total, cid): for each group and partition its first ``seq``, the
    group's rows in earlier partitions and in all, and the group's first ``seq`` as its id.  The windows
    see a row per group and partition."""
    own = Window.partitionBy(group)
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (laid.groupBy(group, part_of(F.col("seq")).alias("part")).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
            .select(group, "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                    F.sum("n").over(own).alias("total"), F.min("first").over(own).alias("cid")))


def numbered(laid: DataFrame, known: DataFrame, group: str) -> DataFrame:
    """``laid`` with ``n``, the row's number within its group from 0, ``total`` and ``cid``."""
    k = known.select(F.col(group).alias("__group"), F.col("part").alias("__part"), "first", "before", "total", "cid")
    meet = F.col(group).eqNullSafe(F.col("__group")) & (part_of(F.col("seq")) == F.col("__part"))
    return (laid.join(k, meet).withColumn("n", F.col("before") + F.col("seq") - F.col("first"))
            .drop("__group", "__part", "first", "before"))
