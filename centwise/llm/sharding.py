"""Sharding by sampled splitters (operator 7): DataFrame functions only.

Law ``bytes``: shard sizes are near equal - any two differ by less than two of the largest record.

1. One aggregate gives rows and bytes.
2. A size-weighted sample of keys is drawn (a record of twice the size is drawn twice as likely;
   the draw is a hash of the record, so a rerun draws the same) and its quantiles become the
   splitters of ``RANGES`` key ranges.  The key is the hash of the text, so equal texts share a range.
3. The records (ids and sizes, no text) are partitioned by range.  A range with more bytes than
   twice its share, or more than ``ROWS_PER_RANGE`` rows - a hot key, or an unlucky sample - is
   subdivided by a hash of the record.  Rows alike in every respect are counted first and dealt out in
   lots of ``COPIES``, each with a hash of its own, so that they too fill as many subranges as it takes.
4. Exact bytes per subrange, summed up, give each record its offset in the whole; the shard is
   that offset's share of the total, so the sample only decides the balance of the work.

What reaches one task besides a bounded subrange is the table of subranges (a row for every
``ROWS_PER_RANGE`` records at most, plus RANGES).

Defined cases: a null text has no bytes (size 1) and CRC-32 0; null ids and repeated rows are
records of their own; ties between equal records fall either way without a difference in the
result; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centwise.llm.common import materialize, read

RANGES = 256
SAMPLE = 20_000
ROWS_PER_RANGE = 250_000
COPIES = 1_000
TWO_64 = 18446744073709551616.0


def _uniform(*cols):
    """A number in [0, 1) from a hash of the columns."""
    return F.xxhash64(F.lit("draw"), *cols).cast("double") / F.lit(TWO_64) + F.lit(0.5)


def splitters(records: DataFrame, total: int, ranges: int = RANGES, sample: int = SAMPLE) -> list[int]:
    """Quantiles of a size-weighted key sample of some ``sample`` rows (bounded by the parameter)."""
    drawn = records.where(_uniform("key", "doc_id") < F.col("size") * (sample / max(total, 1)))
    row = drawn.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()
    return sorted(set(row.q or []))


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, lot) for every row; of equal rows ``COPIES`` share a lot."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    alike = ["doc_id", "size", "text_crc32", "key"]
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.xxhash64(text).alias("key"))
    n, upto = F.col("n"), lambda c: F.sequence(F.lit(0).cast("long"), c)
    lots = rows.groupBy(*alike).agg(F.count("*").alias("n")).withColumn("lot", F.explode(upto(F.floor((n - 1) / COPIES))))
    copies = F.least(n - F.col("lot") * COPIES, F.lit(COPIES))
    return lots.withColumn("copy", F.explode(upto(copies - 1))).select(*alike, "lot")


def ranged(recs: DataFrame, ranges: int, sample: int, rows_per_range: int) -> tuple[DataFrame, int]:
    """The records with their range and part, row number and running size within the part; and the
    size of all.  Written, as what follows reads it three times."""
    total = recs.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(recs, total, ranges, sample)
    placed = recs.withColumn("range", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key")))
                             if cuts else F.lit(0))
    share = max(1, total // ranges)
    fill = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    parts = {r["range"]: max(-(-r["n"] // rows_per_range), r["bytes"] // share if r["bytes"] > 2 * share else 1)
             for r in fill.collect()}                      # at most ``ranges`` rows
    split = [(k, n) for k, n in sorted(parts.items()) if n > 1]
    n_parts = F.coalesce(F.element_at(F.create_map(*[F.lit(int(x)) for pair in split for x in pair]), F.col("range")),
                         F.lit(1)) if split else F.lit(1)
    spread = F.least(F.floor(_uniform("doc_id", "key", "text_crc32", "lot") * n_parts), n_parts - 1).cast("int")
    order = Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "text_crc32")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return materialize(recs.sparkSession, placed.withColumn("part", spread)
                       .withColumn("n", F.row_number().over(order))
                       .withColumn("upto", F.sum("size").over(upto)), "shard-ranges"), total


def assign(docs: DataFrame, shards: int = 16, ranges: int = RANGES, sample: int = SAMPLE,
           rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``."""
    ordered, total = ranged(materialize(docs.sparkSession, records(docs), "shard-records"), ranges, sample, rows_per_range)
    chain = Window.orderBy("range", "part")
    starts = (ordered.groupBy("range", "part").agg(F.sum("size").alias("bytes"))
              .withColumn("start", F.sum("bytes").over(chain) - F.col("bytes")).select("range", "part", "start"))
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    shard = F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int")
    sharded = ordered.join(starts, ["range", "part"]).withColumn("shard", shard)
    chain = Window.partitionBy("shard").orderBy("range", "part")
    slots = (sharded.groupBy("range", "part", "shard").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
             .withColumn("before", F.sum("rows").over(chain) - F.col("rows") - F.col("first"))
             .select("range", "part", "shard", "before"))
    return (sharded.join(slots, ["range", "part", "shard"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("n") + F.col("before")).cast("long").alias("slot")))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """The rows of ``docs`` (distinct ids) as one folder per shard, rows in slot order in each file.
    A shard is written by as many tasks as its slots need, never by one."""
    where = assigned.select(F.col("doc_id").alias("__id"), "shard", "slot")
    block = F.floor(F.col("slot") / 100_000)
    (docs.drop("shard", "slot").join(where, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id")
     .repartition("shard", block).sortWithinPartitions("shard", "slot")
     .write.mode("error").partitionBy("shard").parquet(path))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(read(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
