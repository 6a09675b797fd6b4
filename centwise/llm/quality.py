"""Quality classifier with hierarchical empirical Bayes (operator 6).

1. Document evidence: a logistic regression over the shape of the whole text (``FEATURES``),
   fitted on the documents of at most ``SAMPLE`` labels (the ones of the smallest id hash, so a
   rerun draws the same), gives each document a probability p of good quality.  Where ids repeat so
   that those join to more than 2 ``SAMPLE`` rows, the rows of the smallest hash of id and text are
   drawn, whatever the partitions.
2. Site evidence: grouped sums of p over *all* documents give each host, and each path within a
   host, a beta posterior.  A host shrinks towards the global mean and a path towards its host,
   with prior strengths from the spread of hosts around that mean and of paths around their own host
   (method of moments), so that a sparse site says little.  The document's own p is left out of its site's sums.
3. The document's posterior log-odds: its own evidence (p against the global mean) plus the
   log-odds of its path's posterior.  Documents below ``THRESHOLD`` are rejected.

Host and path sums are two-level aggregations with map-side combine, joined back without the texts;
a host with a third of all rows is a skewed join key that AQE splits.

Defined cases: null and empty texts have the features of a text of no characters; a null host or
path is a site of its own; labels with a null quality or for absent documents are ignored; repeated
labels each count; with no labels, or labels of one class only, p is the smoothed label mean and
every document is kept unless that falls below the threshold; repeated rows are scored alike; empty
tables give empty results; extra columns pass ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centwise.llm.common import materialize, pieces, read

SAMPLE = 20_000
THRESHOLD = 0.5
NO_EVIDENCE = 1e3          # pseudo-documents of a prior where no two groups can be compared
RIDGE = 1.0
FEATURES = ["log_bytes", "upper", "digits", "beyond_ascii", "spaces", "stops", "shouts", "symbols", "bars",
            "log_word_length", "distinct", "adjacent_repeats", "line_length", "repeated_lines", "bare_words"]
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{}~", np.uint8)
_BLANK = np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8)


def features(text: str | None) -> list[float]:
    """The shape of a text, in the order of FEATURES."""
    text = text or ""
    data = text.encode()
    size = max(1, len(data))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    # texts of any length compare: Guiraud's ratio grows little with the length
    distinct = len(set(words)) / n ** 0.75
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    solid = [x for x in lines if x]
    return [
        np.log1p(len(data)), upper / max(1, upper + lower), int(count[48:58].sum()) / size, int(count[128:].sum()) / size,
        int(count[_BLANK].sum()) / size, int(count[[44, 46, 58, 59]].sum()) / n, int(count[[33, 63]].sum()) / n,
        int(count[_SYMBOLS].sum()) / n, int(count[124]) / n, np.log1p(size / n), distinct, repeats,
        np.log1p(len(data) / max(1, len(solid))), 1 - len(set(solid)) / max(1, len(solid)),
        sum(map(str.isalpha, words)) / n,
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights) of a ridge logistic regression over the features and their squares."""
    good = (y.sum() + 1) / (len(y) + 2)
    width = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(width), np.ones(width), np.concatenate([[np.log(good / (1 - good))], np.zeros(2 * width)])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = expand(x, mean, scale)
    w = np.zeros(z.shape[1])
    w[0] = np.log(good / (1 - good))
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - penalty * w
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit on the documents of at most ``sample`` labels, 2 ``sample`` rows at most; only their features reach the driver."""
    drawn = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .select(F.col("doc_id").alias("__id"), F.col("quality").cast("double").alias("__y"))
             .orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample))
    # at most ``sample`` rows, hence a broadcast of bounded size
    some = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).select(
        "text", "__y", F.xxhash64("__id", "text").alias("__row"), F.xxhash64(F.lit(1), "text").alias("__text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__y", "__row", "__text"]
        for batch in pieces(batches):
            x = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), *(batch.column(c) for c in names)], names=["x", *names])

    # repeated ids can join to more rows than labels: those of the smallest row hash are drawn
    rows = (some.mapInArrow(run, "x array<double>, __y double, __row long, __text long")
            .orderBy("__row", "__text", "__y").limit(2 * sample).select("x", F.col("__y").alias("y")).collect())
    rows.sort()
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.y for r in rows]))


def scores(docs: DataFrame, model, host_col: str, path_col: str) -> DataFrame:
    """(doc_id, text_hash, host, path, p) for every document."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, w = model
        for batch in pieces(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()])
            odds = np.clip(expand(x, mean, scale) @ w, -12, 12)
            names = ["doc_id", "text_hash", "host", "path"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(1 / (1 + np.exp(-odds)))],
                                             names=[*names, "p"])

    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                       F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), "text")
    return base.mapInArrow(run, base.drop("text").schema.add("p", "double"))


def strengths(paths: DataFrame) -> tuple[float, float]:
    """Pseudo-documents behind a host's prior (the global mean) and behind a path's prior (its host),
    from the path sums (host, path, s, n) by the method of moments of a nested analysis of variance.

    A path is compared with its own host only, and the paths' spread is taken out of the hosts', so
    hosts that differ do not count as paths that differ, nor the reverse."""
    mean = F.col("s") / F.col("n")
    spread = F.when(F.col("n") > 1, F.col("n") * mean * (1 - mean) / (F.col("n") - 1))   # of one document in its host
    hosts = (paths.groupBy("host").agg(F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("sq"),
                                       F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum("s").alias("s"), F.sum("n").alias("n"))
             .withColumn("spread", spread).withColumn("q", F.col("nn") / F.col("n")))
    row = hosts.agg(
        F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("nn").alias("nn"), F.sum("q").alias("q"),
        F.sum(F.col("n") * F.col("n")).alias("hh"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("hq"),
        F.sum(F.col("sq") - F.col("s") * F.col("s") / F.col("n") - (F.col("k") - 1) * F.col("spread")).alias("excess"),
        F.sum((F.col("n") - F.col("q") - F.col("k") + 1) * F.col("spread")).alias("size"),
        F.sum(F.col("n") * F.col("spread")).alias("within"),
        F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("within_n")).first()
    if not row.n or row.n < 2:
        return NO_EVIDENCE, NO_EVIDENCE
    of_path = _pseudo(row.excess, row.size)
    path_variance = row.within / row.within_n / (of_path + 1) if row.size and row.size > 0 else 0.0
    mean = row.s / row.n
    spread = row.n * mean * (1 - mean) / (row.n - 1)
    excess = (row.hq - row.s * row.s / row.n - (row.k - 1) * spread
              - path_variance * (row.q - row.nn / row.n - row.k + 1))
    return _pseudo(excess, (row.n - row.hh / row.n - row.k + 1) * spread), of_path


def _pseudo(excess: float | None, size: float | None) -> float:
    """The strength of a beta prior whose share of the variance is excess / size, from 1 to 1e6."""
    if size is None or size <= 1e-9:
        return NO_EVIDENCE
    return float(min(1e6, max(1.0, size / excess - 1))) if excess > 0 else 1e6


def posteriors(scored: DataFrame) -> DataFrame:
    """``scored`` with host_posterior, path_posterior and posterior."""
    spark = scored.sparkSession
    paths = materialize(spark, scored.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "path-sums")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = min(1 - 1e-6, max(1e-6, (total.s or 0.0) / total.n if total.n else 0.5))
    of_host, of_path = strengths(paths)
    # left joins whose every row has its match: only the sums may be broadcast, whatever size Spark takes the rows to have
    sites = (paths.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("s").alias("ps"), F.col("n").alias("pn"))
             .join(hosts.select(F.col("host").alias("__h2"), F.col("s").alias("hs"), F.col("n").alias("hn")),
                   F.col("__h").eqNullSafe(F.col("__h2")), "left"))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")), "left")
    host = (F.lit(of_host * mean) + F.col("hs") - F.col("p")) / (F.lit(of_host) + F.col("hn") - 1)
    path = (F.lit(of_path) * F.col("host_posterior") + F.col("ps") - F.col("p")) / (F.lit(of_path) + F.col("pn") - 1)
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda c: F.ln(c / (1 - c))
    odds = logit(bound(F.col("p"))) - F.lit(float(np.log(mean / (1 - mean)))) + logit(F.col("path_posterior"))
    return (joined.withColumn("host_posterior", bound(host)).withColumn("path_posterior", bound(path))
            .withColumn("posterior", 1 / (1 + F.exp(-odds)))
            .select(*scored.columns, "host_posterior", "path_posterior", "posterior"))


def judge(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang",
          sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, host, path, p, host_posterior, path_posterior, posterior, keep)."""
    model = train(docs, labels, sample)
    scored = materialize(docs.sparkSession, scores(docs, model, host_col, path_col), "quality-scores")
    return posteriors(scored).withColumn("keep", F.col("posterior") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected documents."""
    bad = judge(docs, labels, **options).where(~F.col("keep")).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hashed = docs.withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    return hashed.join(bad, (F.col("__text") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")),
                       "left_anti").select(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select(
        "doc_id", "host", "path", F.col("p").alias("classifier_p"), "host_posterior", "path_posterior", "posterior", "keep")
