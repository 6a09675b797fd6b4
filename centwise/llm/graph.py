"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two equi-joins on the edge list, written
to the shared folder; no neighbourhood is ever gathered into one task.  Spark takes an edge list's
size from its file, where repeated ends take next to nothing, so only ``FEW`` edges may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centwise.llm.common import materialize

FEW = 100_000


def _joined(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    return (edges.hint("merge") if many else edges).join(least, "u")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, many: bool = False) -> DataFrame:
    sym = _both_ways(edges)
    least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _joined(sym, least, many).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, many: bool = False) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _joined(down, least, many).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v; not null) other than the roots themselves;
    the root is the smallest node of its component.  Rounds go on until the edge list stays."""
    spark = edges.sparkSession
    now = materialize(spark, edges.where(F.col("u") != F.col("v")).select("u", "v"), "edges")
    before, many = None, now.count() > FEW
    while True:
        large = _large_star(now, many).where(F.col("u") != F.col("v")).distinct()
        now = materialize(spark, _small_star(large, many), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, many = mark, mark[0] > FEW
