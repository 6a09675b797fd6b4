"""Hard-negative mining (operator 12) with bounds along a spanning tree of the anchors.

Scores are integer inner products.  Moving from anchor p to anchor a changes the score of a
candidate c by at most |a - p| * |c| (Cauchy-Schwarz).  So:

1. Anchors are range-partitioned by the signs of their first components and taken in blocks of
   ``BLOCK``; each block gets its minimum spanning tree (Prim).  Near anchors mostly share a block.
2. Candidates are dealt into slices of some ``SLICE`` rows; every block visits every slice (a stated
   query set against all rows, in blocks; anchors travel, candidates move once).
3. In a slice a chunk of candidates is scored exactly at the root.  Down the tree each anchor takes
   its parent's interval, widened by edge x norm, and rescores only candidates whose interval meets
   what it looks for; the others keep the interval, which its own children widen further.
4. First pass: the ``positives`` best rows of the anchor's label; the window is open upwards and
   starts at the best found so far (at first: within the block itself).  Second pass: for every
   positive the rows of another label with low * positive <= 100 * negative <= high * positive,
   from the worst of the ``negatives`` best found so far.

Nothing is approximate: an interval always holds the score.  Where anchors lie far apart, the
intervals are wide and nearly every candidate is rescored; that costs time, never a result.

Defined cases: rows with a null label, a null vector or a null component take no part; rows equal in
id, label and vector are one row; rows with the anchor's own id are neither its positives nor its
negatives; two different rows with one anchor id are two anchors; a null id is a candidate, last in
ties; vectors of unequal length are compared as if filled up with zeros; a score beyond 64 bits is
the nearest 64-bit number; an anchor without positives, or a window without rows, gives no row; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from centwise.llm.common import materialize, read

BLOCK = 512
SLICE = 65_536
CHUNK = 2_048
SIGNS = 24
NO_ID = np.iinfo(np.int64).max
LONG = (-(1 << 63), (1 << 63) - 1)


# ---- vectors -------------------------------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """A list<long> column as a matrix, short rows filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Scorer:
    """Exact inner products of candidate rows with anchors."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray) -> None:
        width = max(rows.shape[1], anchors.shape[1])
        self.rows, self.anchors = widened(rows, width), widened(anchors, width)
        self.floats, self.float_anchors = self.rows.astype(np.float64), self.anchors.astype(np.float64)
        top = float(np.abs(self.floats).max(initial=0)) * float(np.abs(self.float_anchors).max(initial=0)) * width
        self.exact = top < 2 ** 53                         # then doubles hold every sum exactly
        self.norms = np.sqrt((self.floats ** 2).sum(axis=1))
        # rounding of the bounds themselves
        self.slack = 1e-9 * self.norms * np.sqrt((self.float_anchors ** 2).sum(axis=1)).max(initial=0) + 1e-6

    def scores(self, at: np.ndarray, anchor: int) -> np.ndarray:
        if self.exact:
            return (self.floats[at] @ self.float_anchors[anchor]).astype(np.int64)
        a = self.anchors[anchor].tolist()
        sums = (sum(x * y for x, y in zip(self.rows[i].tolist(), a)) for i in at)
        return np.array([min(max(s, LONG[0]), LONG[1]) for s in sums], np.int64)


def spanning_tree(vectors: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """(order, parent, edge) of the minimum spanning tree by Prim: parents come before children;
    ``parent`` is a place in the order, -1 for the root."""
    x = vectors.astype(np.float64)
    n = len(x)
    best, via, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    order, parent, edge, place = [], [], [], {-1: -1}
    now = 0
    for _ in range(n):
        done[now] = True
        place[now] = len(order)
        order.append(now)
        parent.append(place[int(via[now])])
        edge.append(float(np.sqrt(best[now])) if via[now] >= 0 else 0.0)
        far = ((x - x[now]) ** 2).sum(axis=1)
        nearer = ~done & (far < best)
        best[nearer], via[nearer] = far[nearer], now
        now = int(np.where(done, np.inf, best).argmin())
    return order, parent, edge


class Best:
    """The k best (score, id) of one window [least, most]; higher scores first, then smaller ids."""

    def __init__(self, k: int, least: float, most: float) -> None:
        self.k, self.least, self.most = k, least, most
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def raise_to(self, scores: np.ndarray) -> None:
        """The k-th best of some rows of the table bounds the k-th best of all."""
        inside = scores[(scores >= self.least) & (scores <= self.most)]
        if len(inside) >= self.k:
            self.least = max(self.least, int(np.partition(inside, -self.k)[-self.k]))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.least) & (scores <= self.most)
        if not inside.any():
            return
        s, i = np.concatenate([self.scores, scores[inside]]), np.concatenate([self.ids, ids[inside]])
        top = np.lexsort((i, -s))[:self.k]
        self.scores, self.ids = s[top], i[top]
        if len(top) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def search(rows: dict, block: dict, windows: list[list[Best]], same: bool) -> tuple[int, int]:
    """Fill the windows of every anchor of ``block`` (tree order) with candidates ``rows`` of its
    label (``same``) or of another.  Returns (pairs rescored, pairs looked at)."""
    own = Scorer(block["v"], block["v"])
    n = len(block["aid"])
    for a in range(n):
        fit = ((block["label"] == block["label"][a]) == same) & (block["id"] != block["id"][a])
        if windows[a] and fit.any():
            seeds = own.scores(np.flatnonzero(fit), a)
            for w in windows[a]:
                w.raise_to(seeds)
    scorer = Scorer(rows["v"], block["v"])
    rescored = looked = 0
    for start in range(0, len(rows["id"]), CHUNK):
        at = slice(start, start + CHUNK)
        ids, labels, norms, slack = rows["id"][at], rows["label"][at], scorer.norms[at], scorer.slack[at]
        low, high = np.empty((n, len(ids))), np.empty((n, len(ids)))
        for a in range(n):
            if block["parent"][a] < 0:
                low[a] = high[a] = scorer.scores(np.arange(start, start + len(ids)), a)
                need = np.zeros(len(ids), bool)
                for w in windows[a]:
                    need |= (high[a] >= w.least) & (low[a] <= w.most)
            else:
                step = block["edge"][a] * norms + slack
                low[a], high[a] = low[block["parent"][a]] - step, high[block["parent"][a]] + step
                need = np.zeros(len(ids), bool)
                for w in windows[a]:
                    need |= (high[a] >= w.least) & (low[a] <= w.most)
            need &= ((labels == block["label"][a]) == same) & (ids != block["id"][a])
            found = np.flatnonzero(need)
            looked += len(ids)
            if len(found):
                rescored += len(found)
                scores = scorer.scores(found + start, a)
                low[a, found] = high[a, found] = scores
                for w in windows[a]:
                    w.add(scores, ids[found])
    return rescored, looked


# ---- Spark ---------------------------------------------------------------------------------------


def _trees(batches) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive anchors of a partition, each in the order of its spanning tree."""
    part, no, held, n = TaskContext.get().partitionId(), 0, [], 0

    def emit(table: pa.Table):
        order, parent, edge = spanning_tree(matrix(table.column("v").combine_chunks()))
        block = (part << 32) + no
        t = table.take(pa.array(order))
        cols = [pa.array([block] * len(t), pa.int64()), pa.array([block * BLOCK + i for i in range(len(t))], pa.int64()),
                pa.array(parent, pa.int32()), pa.array(edge, pa.float64())]
        full = pa.table(cols + [t.column(c) for c in ("id", "label", "v")],
                        names=["block", "aid", "parent", "edge", "id", "label", "v"])
        return full.combine_chunks().to_batches()

    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, BLOCK - n)
            held.append(take)
            n += take.num_rows
            batch = batch.slice(take.num_rows)
            if n == BLOCK:
                yield from emit(pa.Table.from_batches(held))
                no, held, n = no + 1, [], 0
    if held:
        yield from emit(pa.Table.from_batches(held))


def _stretches(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys (whole numbers) as one table each."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(k[a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _arrays(table: pa.Table) -> dict:
    out = {c: pc.fill_null(table.column(c), NO_ID if c == "id" else 0).to_numpy() for c in ("aid", "id", "label", "parent", "edge")}
    return out | {"v": matrix(table.column("v").combine_chunks())}


FOUND = "aid long, most long, id long, score long"
DEALT = ["slice", "block", "aid", "id", "label", "parent", "edge", "windows", "v"]


def _searched(rows: DataFrame, anchors: DataFrame, slices: int, k: int, low: int, same: bool) -> DataFrame:
    """FOUND for every slice: up to ``k`` rows of each window of each anchor (``most`` null: of its label)."""
    none = F.lit(None)
    cands = rows.select("slice", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("aid"), "id", "label",
                        none.cast("int").alias("parent"), none.cast("double").alias("edge"),
                        none.cast("array<long>").alias("windows"), "v")
    asked = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = (cands.unionByName(asked.select(*DEALT)).repartition(slices, "slice").sortWithinPartitions("slice", "block", "aid"))

    def run(batches):
        cand, at = None, None
        for table in _stretches(batches, ["slice", "block"]):
            where, block = table.column("slice")[0].as_py(), table.column("block")[0].as_py()
            if block < 0:
                cand, at = _arrays(table), where
                continue
            if at != where:                                # a slice without candidates
                continue
            b = _arrays(table)
            if same:
                windows = [[Best(k, float("-inf"), float("inf"))] for _ in b["aid"]]
            else:
                windows = [[Best(k, -(-low * p // 100), p) for p in w] for w in table.column("windows").to_pylist()]
            search(cand, b, windows, same)
            got = [(a, None if same else w.most, None if i == NO_ID else int(i), int(s))
                   for a, ws in zip(b["aid"].tolist(), windows) for w in ws for i, s in zip(w.ids, w.scores)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["aid", "most", "id", "score"])

    return dealt.mapInArrow(run, FOUND)


def mine(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 5, low: int = 80,
         slice_rows: int = SLICE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors``
    (id, label, v array<long>); the SQL condition ``anchors`` on id picks the anchors.  Negatives score
    between ``low`` per cent of the positive and the positive itself."""
    spark = vectors.sparkSession
    rows = (vectors.select("id", F.col("label").cast("long").alias("label"), "v")
            .where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", lambda x: x.isNotNull()))
            .dropDuplicates(["id", "label", "v"]))
    rows = materialize(spark, rows, "mine-rows")
    # at least a slice for every core that may be there; beyond that, bounded slices
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // slice_rows))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("id", "label", "v"), F.lit(slices)).cast("int"))
    signs = F.array_join(F.transform(F.slice("v", 1, SIGNS), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    trees = materialize(spark, rows.where(anchors).select("id", "label", "v", signs.alias("signs"))
                        .repartitionByRange("signs", "id").sortWithinPartitions("signs", "id", "label", "v")
                        .select("id", "label", "v")
                        .mapInArrow(_trees, "block long, aid long, parent int, edge double, id long, label long, v array<long>"),
                        "mine-trees")
    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    near = _searched(rows, trees.withColumn("windows", F.lit(None).cast("array<long>")), slices, positives, low, True)
    order = Window.partitionBy("aid").orderBy(*best)
    pos = materialize(spark, near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
                      .select("aid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-positives")
    # a positive below zero has an empty window
    windows = pos.where("positive_score >= 0").groupBy("aid").agg(F.array_sort(F.collect_set("positive_score")).alias("windows"))
    # every node of a tree stays, anchors without a window too: their children start from them
    asked = trees.join(windows, "aid", "left").withColumn("windows", F.coalesce("windows", F.lit([]).cast("array<long>")))
    found = _searched(rows, asked, slices, negatives, low, False)
    order = Window.partitionBy("aid", "most").orderBy(*best)
    neg = (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
           .select("aid", F.col("most").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
                   F.col("score").alias("negative_score")))
    names = trees.select("aid", F.col("id").alias("anchor_id"))
    return (pos.join(neg, ["aid", "positive_score"]).join(names, "aid")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                    "negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = e.where(F.col("embedding").isNotNull()).where(fine).select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))
    return mine(rows, "id % 100 = 0")


ORACLE_SQL = """
WITH fine AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
              FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(embedding) = list_count(embedding)
                AND isfinite(COALESCE(list_sum(CAST(embedding AS DOUBLE[])), 0))),
parts AS (SELECT id, label, embedding, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM fine),
whole AS (SELECT id, label, embedding, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS q FROM parts),
scores AS (SELECT a.id AS anchor_id, a.label AS anchor_label, c.id, c.label, c.embedding, CAST(sum(a.q * c.q) AS BIGINT) AS score
           FROM whole a JOIN whole c ON a.i = c.i AND a.id <> c.id
           WHERE a.id % 100 = 0 GROUP BY ALL),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score, anchor_label FROM scores WHERE label = anchor_label
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM pos p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
     AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5"""
