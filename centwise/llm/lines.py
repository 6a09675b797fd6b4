"""Line dedup (operator 4): DataFrame functions only, no Python on the executors.

1. Every line becomes (key hash, document, position); the text itself does not travel.
2. The occurrences are range-partitioned by key hash with a secondary sort by document and
   position, so one pass over a partition meets each key's occurrences in order: the first one
   and the number of documents come from windows over that very layout, with no further shuffle.
3. Lines to drop are folded per document into a run-length encoded keep bitmap; a document's
   text is joined with its bitmap only when the caller asks for the text.

Hot keys: every key with more rows than a quarter of an average partition (and some with an eighth)
is salted by document before the range partitioning; there are at most some ``HOT_SHARE`` keys a shuffle
partition, hence their table may be broadcast.  A sample of ``SAMPLED`` occurrences a shuffle partition
finds them; their exact document counts and first occurrences come from an aggregate over all their
rows with map-side combine.  Salting never changes the result.

A document is a distinct (doc_id, text); repeated rows count once.  Keys are compared by two
64-bit hashes.

Defined cases: a null or empty text is one empty line, whose key is shorter than any
``min_chars`` >= 1, so it stays; a null doc_id is a document like any other (null equals null);
ties are broken by (doc_id, text hash, position); an empty table gives empty results; extra
columns pass through ``apply_bitmaps`` untouched, and clashing names cannot matter to the
bitmaps, which read doc_id and text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centwise.llm.common import ascii_lower, materialize, read

HOT_SHARE = 8                                              # a hot key holds over 1 / HOT_SHARE of a partition
SAMPLED = 1024
SALTS = 64
BLANKS = " \t\n\x0b\x0c\r"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _doc_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, doc_hash, pos) of every line whose key has ``min_chars`` code points."""
    key = ascii_lower(F.trim(F.col("line"), F.lit(BLANKS)))
    return (docs.select("doc_id", _doc_hash(F.col("text")).alias("doc_hash"),
                        F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
            .withColumn("key", key)
            .where(F.char_length("key") >= min_chars)
            .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"),
                    "doc_id", "doc_hash", "pos"))


def _hot_keys(occ: DataFrame) -> DataFrame:
    """(h1, h2) of the keys to salt.  A key of a quarter of a partition is expected 256 times in the
    sample and taken from 128 times on."""
    partitions, total = int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions")), occ.count()
    share = min(1.0, SAMPLED * partitions / max(1, total))
    some = occ.select("h1", "h2")
    some = some.sample(share, 7) if share < 1 else some
    return some.groupBy("h1", "h2").count().where(F.col("count") > share * total / (HOT_SHARE * partitions)).select("h1", "h2")


def keep_bitmaps(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """Run-length encoded keep bitmaps: (doc_id, doc_hash, dropped_runs array<struct<start,length>>),
    one row per document that loses lines; a document without a row keeps them all.

    A key found in ``min_docs`` documents or more loses all its lines (``keep="none"``) or all but
    its first occurrence (``keep="first"``)."""
    if keep not in ("none", "first"):
        raise ValueError(keep)
    spark = docs.sparkSession
    occ = materialize(spark, occurrences(docs, min_chars), "line-occurrences")
    where = F.struct("doc_id", "doc_hash", "pos")
    hot = materialize(spark, occ.join(F.broadcast(_hot_keys(occ)), ["h1", "h2"], "left_semi").groupBy("h1", "h2")
                      .agg(F.count_distinct(F.struct("doc_id", "doc_hash")).alias("all_docs"), F.min(where).alias("first")),
                      "hot-lines")
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id", "doc_hash"), F.lit(SALTS))).otherwise(F.lit(0))
    ranged = (occ.join(F.broadcast(hot.select("h1", "h2", F.lit(True).alias("is_hot"))), ["h1", "h2"], "left")
              .withColumn("salt", salt.cast("int")).drop("is_hot")
              .repartitionByRange("h1", "h2", "salt")
              .sortWithinPartitions("h1", "h2", "salt", "doc_id", "doc_hash", "pos"))
    slice_ = Window.partitionBy("h1", "h2", "salt")
    stream = slice_.orderBy("doc_id", "doc_hash", "pos")
    new_doc = F.lag(F.struct("doc_id", "doc_hash")).over(stream).eqNullSafe(F.struct("doc_id", "doc_hash"))
    seen = (ranged.withColumn("is_first", F.row_number().over(stream) == 1)
            .withColumn("new_doc", (~new_doc).cast("int"))
            .withColumn("n_docs", F.sum("new_doc").over(slice_))
            .join(F.broadcast(hot), ["h1", "h2"], "left")
            .withColumn("n_docs", F.coalesce("all_docs", "n_docs"))
            .withColumn("is_first", F.when(F.col("all_docs").isNotNull(), where.eqNullSafe(F.col("first")))
                        .otherwise(F.col("is_first"))))
    drop = F.col("n_docs") >= min_docs
    if keep == "first":
        drop = drop & ~F.col("is_first")
    at = (seen.where(drop).groupBy("doc_id", "doc_hash")
          .agg(F.array_sort(F.collect_set("pos")).alias("at")))
    n = F.size("at")
    begins = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: (i == n - 1) | (F.get("at", i + 1) != x + 1))
    runs = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
    return at.select("doc_id", "doc_hash", runs.alias("dropped_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to the kept lines, plus n_lines and n_dropped."""
    b = bitmaps.select(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash"),
                       F.col("dropped_runs").alias("__runs"))
    base = docs.drop("n_lines", "n_dropped")
    joined = base.withColumn("__doc_hash", _doc_hash(F.col("text"))).join(
        b, (F.col("__doc_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    lines, runs = _lines(F.col("text")), F.col("__runs")
    with_lines = joined.withColumn("__lines", lines)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"])
    end = lambda i: F.when(i == F.size(runs), F.size("__lines")).otherwise(F.get(runs, i)["start"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)),
                                 lambda i: F.slice("__lines", begin(i) + 1, end(i) - begin(i))))
    dropped = F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["length"])
    text = F.when(runs.isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    out = with_lines.withColumns({"text": text, "n_lines": F.size("__lines").cast("long"),
                                  "n_dropped": F.coalesce(dropped, F.lit(0).cast("long"))})
    return out.select(*base.columns, "n_lines", "n_dropped")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars=1, min_docs=10))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, COALESCE(text, '') AS text FROM documents),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
bad AS (SELECT key FROM (SELECT DISTINCT key, doc_id, text FROM keyed WHERE length(key) >= 1)
        GROUP BY key HAVING count(*) >= 10),
marked AS (SELECT k.doc_id, k.text, k.line, k.pos, b.key IS NOT NULL AS gone FROM keyed k LEFT JOIN bad b ON b.key = k.key),
folded AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                  COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept
           FROM marked GROUP BY doc_id, text)
SELECT d.doc_id, f.n_lines, f.n_dropped, sha256(f.kept) AS kept_sha256
FROM documents d JOIN folded f ON f.doc_id IS NOT DISTINCT FROM d.doc_id AND f.text = COALESCE(d.text, '')"""
