"""Approximate nearest neighbours by multi-index hashing (operator 8).

1. Rotations are learned (ITQ: principal axes, then the rotation that binarises them with the least
   error) on at most ``SAMPLE`` vectors, with several starts until there are ``BITS`` bits.  Inner
   products become angles by one more coordinate, sqrt(1 - |x|^2 / max|x|^2).
2. Every vector gets its code, split into byte-sized substrings, each of which is indexed.
3. Pigeonhole: a code within Hamming radius r agrees with the query to within floor(r / substrings)
   bits on some substring, so probing the buckets that near retrieves every code within r.
   These are checked on the whole code and reranked by exact inner products (doubles).
4. The radius is the one that held ``TARGET`` of the true neighbours of sample queries within the
   sample.  A slice that yields fewer than k + 1 codes widens its radius until it does.

The queries are a stated set and go in blocks (``BLOCK`` queries) against slices (``SLICE`` vectors,
dealt by a hash), each with its own index: a task holds one slice and one block whatever the data.
What leaves it are k + 1 rows a query, merged by a window with a pre-shuffle limit.

Equal vectors are one class, searched once; a class keeps its k + 1 smallest ids, the only ones that
can be among k nearest (ties go to the smaller id), so a vector that a third of all rows share
costs no more than any other.

Defined cases: vectors null, zero, with null or non-finite components, or of another length than
the most frequent one take no part, nor do null ids; rows repeating an id and its vector count once
(an id with several vectors is several candidates), and a query never finds its own id; fewer than
k candidates give all; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centwise.llm.common import materialize, read

BITS = 128
SAMPLE = 20_000
SAMPLE_QUERIES = 300
TARGET = 0.96
SLICE = 16_384
BLOCK = 4_096
NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that turns inner products into angles."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], axis=1)


def lift_query(q: np.ndarray) -> np.ndarray:
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def learn(x: np.ndarray, bits: int = BITS, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of the learned codes for lifted vectors ``x``."""
    mean = x.mean(0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    out, start = [], 0
    while sum(w.shape[1] for w in out) < bits:
        width = min(bits - sum(w.shape[1] for w in out), axes.shape[1], 64)
        main = axes[:, :width]
        z = centred @ main
        turn = np.linalg.qr(np.random.default_rng(start).normal(size=(width, width)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ vt).T
        out.append(main @ turn)
        start += 1
    return mean, np.concatenate(out, axis=1)


def encode(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes as bytes, one per substring."""
    return np.packbits((x - model[0]) @ model[1] > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count((codes ^ code).view(np.uint64)).sum(axis=1, dtype=np.int64)


def calibrate(x: np.ndarray, longest: float, model, k: int, target: float) -> int:
    """Smallest radius that holds ``target`` of the k nearest of sample queries in the sample."""
    codes = encode(lift(x, longest), model)
    queries = np.random.default_rng(7).choice(len(x), min(len(x), SAMPLE_QUERIES), replace=False)
    seen = []
    for i, code in zip(queries, encode(lift_query(x[queries]), model)):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.argpartition(-score, min(k, len(x) - 1))[:k]
        seen.append(distances(codes[best], code))
    return int(np.ceil(np.quantile(np.concatenate(seen), target)))


class Slice:
    """The vectors of a slice with an index of each substring of their codes."""

    def __init__(self, vectors: np.ndarray, longest: float, model) -> None:
        self.vectors, self.codes = vectors, encode(lift(vectors, longest), model)
        self.order = [np.argsort(c, kind="stable") for c in self.codes.T]
        self.count = [np.bincount(c, minlength=256) for c in self.codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within ``radius``."""
        step = radius // len(code)
        found = np.zeros(len(self.codes), bool)
        for j, value in enumerate(code):
            found[self.order[j][np.repeat(NEAR[value] <= step, self.count[j])]] = True
        at = np.flatnonzero(found)
        return at[distances(self.codes[at], code) <= radius]

    def search(self, query: np.ndarray, code: np.ndarray, radius: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the codes within the radius, widened until there are ``least``."""
        at = self.within(code, radius)
        while len(at) < min(least, len(self.codes)):
            radius += len(code)
            at = self.within(code, radius)
        return at, (self.vectors[at] * query).sum(axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _valid(vectors: DataFrame) -> DataFrame:
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common.n if common else 0))


def search(vectors: DataFrame, queries: str, k: int = 20, bits: int = BITS, sample: int = SAMPLE, target: float = TARGET,
           slice_rows: int = SLICE, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``vectors`` (vec_id,
    embedding) for which the SQL condition ``queries`` on vec_id holds, among all other rows."""
    spark = vectors.sparkSession
    asks = F.expr(queries)
    rows = materialize(spark, _valid(vectors), "vectors")
    classes = materialize(spark, rows.groupBy("v").agg(F.min("vec_id").alias("cid"), F.max(asks).alias("asks")), "vector-classes")
    # two classes cannot share a smallest id unless an id repeats with several vectors
    classes = classes.withColumn("cls", F.struct("cid", F.xxhash64("v").alias("h")))
    total = classes.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = classes.where("asks")
    longest = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] ** 0.5
    drawn = classes.orderBy(F.xxhash64("cid", F.lit("sample")), "cid").limit(sample).select("v").toArrow()
    x = _matrix(drawn.column("v"))
    model = learn(lift(x, longest), bits)
    radius = calibrate(x, longest, model, k, target)
    n_slices, n_blocks = -(-total // slice_rows), -(-asked.count() // block_rows)

    def dealt(df, who, own, n_own, other, n_other):
        # names differ on the two sides: cogrouped frames of one lineage mix up equal ones
        return (df.select(F.col("cls").alias(who), F.transform("v", lambda x: x.cast("double")).alias(f"{who}_v"),
                          F.pmod(F.xxhash64("cls", F.lit(who)), F.lit(max(1, n_own))).cast("int").alias(own))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(1, n_other) - 1)))))

    out = "q struct<cid: long, h: long>, c struct<cid: long, h: long>, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        picked_q, picked_c, scores = [], [], []
        if len(left) and len(right):
            part = Slice(_matrix(left.column("one_v")), longest, model)
            smallest = left.column("one").combine_chunks().field("cid").to_numpy(zero_copy_only=False)
            asking = _matrix(right.column("asker_v"))
            for i, code in enumerate(encode(lift_query(asking), model)):
                at, score = part.search(asking[i], code, radius, k + 1)
                best = np.lexsort((smallest[at], -score))[:k + 1]
                picked_q += [i] * len(best)
                picked_c += at[best].tolist()
                scores += score[best].tolist()
        def ids(table, who, at):
            cls = table.column(who).combine_chunks().take(pa.array(at, pa.int64()))
            return pa.StructArray.from_arrays([cls.field("cid"), cls.field("h")], names=["cid", "h"])

        return pa.table({"q": ids(right, "asker", picked_q), "c": ids(left, "one", picked_c),
                         "score": pa.array(scores, pa.float64())})

    found = (dealt(classes, "one", "slice", n_slices, "of_block", n_blocks).groupBy("slice", "of_block")
             .cogroup(dealt(asked, "asker", "block", n_blocks, "of_slice", n_slices).groupBy("of_slice", "block"))
             .applyInArrow(run, out))
    nearest = Window.partitionBy("q").orderBy(F.desc("score"), "c.cid", "c.h")
    near = found.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).select("q", "c", "score")
    # members of the classes: the k + 1 smallest ids of each are all that can matter
    named = rows.select("vec_id", "v").distinct().join(classes.select("v", "cls"), "v").select("vec_id", "cls")
    small = Window.partitionBy("cls").orderBy("vec_id")
    members = (named.withColumn("n", F.row_number().over(small)).where(F.col("n") <= k + 1)
               .select(F.col("cls").alias("c"), "vec_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "c.h")
    lists = (near.join(members, "c").withColumn("n", F.row_number().over(best)).where(F.col("n") <= 2 * k + 2)
             .select("q", "vec_id", "score"))
    asking = named.where(asks).select(
        F.col("vec_id").alias("query_id"), F.col("cls").alias("q"))
    last = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (asking.join(lists, "q").where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)
