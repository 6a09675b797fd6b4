"""Mixing sources to target weights (operator 13): DataFrame functions only.

Targets.  Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of
the whole corpus.  A target stops at ``cap`` times its source's words; what is over goes to the open
sources by weight, until none is above its cap.  Each round is one aggregate over the source table.

Selection.
1. A document's key is a hash-random MD5 of its id and text.  Rows alike in every respect are one
   record with a count (at most ``COPIES``, then a further record with a key of its own), so a
   repeated row is combined before the shuffle and never fills one range.
2. Records are range-partitioned by (source, bucket), a bucket being a stretch of the source's key
   space with some ``ROWS_PER_BUCKET`` records, and sorted by key inside it.  The running sum of
   words needs no further shuffle, and a source with a third of all rows is many buckets.
3. A prefix sum over the buckets' totals (one row per bucket) gives each bucket its start.
4. A source's budget is its target rounded to a whole word: ``budget // source_size`` whole epochs,
   and one more up to the exact word at which the budget ends.  The document at the cut gives its
   first words only, so the words taken are the budget exactly.

The order is that of the keys, whatever the partitioning: a rerun takes the same.

Defined cases: a null or empty text has no words and gives none; a null doc_id is an id like any
other; a null source is a source, the last one; equal rows share the budget one after the other,
which of them comes first makes no difference; a source without words has target 0; an empty table
gives an empty result; extra columns are not read, their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centwise.llm.common import BLANK, materialize, read

CAP = 3
WEIGHTS = (1, 2, 3)
COPIES = 1_000
ROWS_PER_BUCKET = 8_192
WORD = f"[^{BLANK}]+"
RECORD = ["doc_id", "source", "size", "body"]


def _whole(col):
    return col.cast("decimal(38,0)")


def records(docs: DataFrame, copies: int = COPIES) -> DataFrame:
    """(doc_id, source, size, body, copies, key): equal rows as one record with a count."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.md5(text).alias("body"))
    n = F.col("n")
    parts = rows.groupBy(*RECORD).agg(F.count("*").alias("n")).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / copies))))
    key = F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "body",
                            F.col("part").cast("string")))
    return parts.select(*RECORD, F.least(n - F.col("part") * copies, F.lit(copies)).alias("copies"), key.alias("key"))


def weighted_sources(recs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, records, weight), weights dealt out in code-point order, null last.

    The order is a range partitioning; a source's rank is its place in its partition plus the rows
    of the partitions before it (one row per partition)."""
    spark = recs.sparkSession
    sizes = recs.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                       F.count("*").alias("records"))
    order = F.col("source").asc_nulls_last()
    laid = materialize(spark, sizes.repartitionByRange(order).sortWithinPartitions(order)
                       .withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (laid.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
              .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    rank = (F.col("start") + F.col("place")) % len(weights)
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank + 1).cast("int"))
    return (laid.withColumn("part", part).withColumn("place", place).join(starts, "part")
            .select("source", "source_size", "records", pick.cast("long").alias("weight")))


def with_targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: shares by weight, none above cap x its size."""
    limit = F.col("source_size") * cap
    row = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, all_weight = row.t or 0, row.w or 0
    full, open_weight, closed = 0, all_weight, F.lit(False)
    while open_weight:
        level = total - full
        closed = _whole(F.col("weight")) * F.lit(level) > _whole(limit) * F.lit(open_weight)
        now = sources.where(closed).agg(F.sum(limit).alias("t"), F.sum("weight").alias("w")).first()
        if (now.t or 0, all_weight - (now.w or 0)) == (full, open_weight):
            break
        full, open_weight = now.t or 0, all_weight - (now.w or 0)
    share = F.lit(float(total - full)) * F.col("weight").cast("double") / F.lit(float(max(1, open_weight)))
    return sources.withColumn("target", F.when(closed, limit.cast("double")).otherwise(share))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, copies: int = COPIES,
        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(doc_id, source, body, size, source_size, target, taken) for every row of ``docs``
    (doc_id, source, text); ``body`` is the MD5 of the text."""
    spark = docs.sparkSession
    recs = materialize(spark, records(docs, copies), "mix-records")
    sources = materialize(spark, with_targets(weighted_sources(recs, weights), cap), "mix-targets")
    s = sources.select(F.col("source").alias("__s"), "source_size", "target",
                       F.ceil(F.col("records") / rows_per_bucket).cast("long").alias("buckets"))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    placed = (recs.join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
              .withColumn("bucket", F.floor(place * F.col("buckets"))).drop("buckets"))
    own = Window.partitionBy("source", "bucket")
    upto = own.orderBy("key", *RECORD).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("size") * F.col("copies")
    ordered = materialize(spark, placed.repartitionByRange("source", "bucket")
                          .withColumn("upto", F.sum(words).over(upto)), "mix-ranges")
    chain = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ordered.groupBy("source", "bucket").agg(F.max("upto").alias("words"))
              .select(F.col("source").alias("__s"), F.col("bucket").alias("__b"),
                      F.coalesce(F.sum("words").over(chain), F.lit(0)).alias("start")))
    at = ordered.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    budget = F.round("target", 0).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = budget - F.col("epochs") * F.col("source_size") - (F.col("start") + F.col("upto") - words)
    each = (at.withColumn("epochs", epochs).withColumn("rest", rest)
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))))
    size = F.col("size")
    last = F.greatest(F.least(F.col("rest") - F.col("copy") * size, size), F.lit(0).cast("long"))
    return each.select("doc_id", "source", "body", "size", "source_size", "target",
                       (F.col("epochs") * size + last).alias("taken"))


def mixture(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: (doc_id, source, epoch, words, text), a row per document and epoch taken.

    A document's last epoch may be its first words only, then joined by single spaces.  Equal rows
    count as one document here, whose epochs are those of all its rows."""
    took = (mixed.groupBy("doc_id", "source", "body", "size").agg(F.sum("taken").alias("taken")).where("taken > 0")
            .select(*[F.col(c).alias(f"__{c}") for c in RECORD], "taken"))
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", "source", text.alias("text"), F.md5(text).alias("body")).dropDuplicates(
        ["doc_id", "source", "body"])
    meet = (F.col("body") == F.col("__body")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) \
        & F.col("source").eqNullSafe(F.col("__source"))
    size = F.col("__size")
    e = whole.join(took, meet).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / size))))
    words = F.least(F.col("taken") - F.col("epoch") * size, size)
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col("words").cast("int")), " ")
    return e.withColumn("words", words).select("doc_id", "source", "epoch", "words",
                                               F.when(F.col("words") == size, F.col("text")).otherwise(first).alias("text"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLE_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                      md5(COALESCE(text, '')) AS body FROM documents),
copies AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, body) - 1 AS copy FROM sized),
keyed AS (SELECT *, md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || body || ':'
                        || CAST(copy // 1000 AS VARCHAR)) AS key FROM copies),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS weight
        FROM keyed GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS HUGEINT) AS t, CAST(sum(weight) AS HUGEINT) AS w FROM src),
filled AS (SELECT source, source_size, weight, t, w,
                  COALESCE(sum(CAST(3 * source_size AS HUGEINT)) OVER pre, 0) AS cap_before,
                  w - COALESCE(sum(CAST(weight AS HUGEINT)) OVER pre, 0) AS weight_left
           FROM src, total
           WINDOW pre AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, weight * (t - cap_before) > 3 * source_size * weight_left AS closed FROM filled),
level AS (SELECT max(t) - COALESCE(sum(3 * source_size) FILTER (WHERE closed), 0) AS words,
                 max(w) - COALESCE(sum(weight) FILTER (WHERE closed), 0) AS weight FROM marked),
targets AS (SELECT source, source_size,
                   CASE WHEN closed THEN CAST(3 * source_size AS DOUBLE)
                        ELSE CAST(l.words AS DOUBLE) * CAST(m.weight AS DOUBLE) / CAST(greatest(l.weight, 1) AS DOUBLE) END AS target
            FROM marked m, level l),
budgets AS (SELECT *, CAST(round(target) AS BIGINT) AS budget,
                   CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
placed AS (SELECT k.*, b.source_size, b.target, b.budget, b.epochs,
                  sum(size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.body, k.copy
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
           FROM keyed k JOIN budgets b ON b.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(least(budget - epochs * source_size - before, size), 0) AS BIGINT) AS taken, source
FROM placed"""
