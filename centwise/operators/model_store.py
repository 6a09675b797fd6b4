"""The categoriser's model as it lives: saved, loaded, found stale, retrained (SRC9, SNK12, ML8, SET1).

* ``terms``: the training corpus as term counts (``categorize.term_counts``) in numbered batches
  (``sources.batches``).  New rows are tokenised once, when their batch comes; rows that an earlier
  batch has are left out, so the corpus stays free of duplicates across batches.
* ``v=<number>``: a version of the model, fitted from the batches up to that number.  Its tables become
  visible together when the folder is marked, and never change: a reader that has loaded one version
  keeps it while the next is being written.

Retraining reads no text: document frequencies and class counts are sums over the batches, and the
idf, which rescales every document when the corpus grows, is applied to the stored counts.  So the
model after any number of batches is the one trained on all their rows at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from centwise.operators import categorize as cat
from centwise.sources import batches

TERMS = T.StructType([T.StructField("doc", T.BinaryType()), T.StructField("category", T.StringType()),
                      T.StructField("terms", T.ArrayType(T.StructType([T.StructField("term", T.StringType()),
                                                                       T.StructField("tf", T.LongType())])))])


def add_rows(spark: SparkSession, path: str, training: DataFrame, batch: int, stop_words=None) -> None:
    """Commit the training rows (description, category) of one delivery; repeating it adds nothing."""
    if batch in batches.complete(spark, f"{path}/terms"):
        return
    known = batches.read_batches(spark, f"{path}/terms", TERMS, before=batch).select("doc")
    fresh = cat.term_counts(training, stop_words).join(known, "doc", "left_anti")
    batches.write_batch(fresh.select(TERMS.names), f"{path}/terms", batch)


def current(spark: SparkSession, path: str) -> int | None:
    """The newest complete version."""
    return max(batches.complete(spark, path, "v"), default=None)


def is_stale(spark: SparkSession, path: str) -> bool:
    """Whether training rows came after the newest version (or there is none)."""
    rows = max(batches.complete(spark, f"{path}/terms"), default=None)
    return rows is not None and rows != current(spark, path)


def load(spark: SparkSession, path: str, version: int | None = None) -> cat.NBModel:
    """SRC9: a version of the model, the newest by default."""
    version = current(spark, path) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no model in {path}")
    return cat.load(spark, batches.folder(path, version, "v"))


def retrain(spark: SparkSession, path: str) -> cat.NBModel:
    """ML8 + SNK12: fit the model on all rows there are and switch to it at once."""
    version = max(batches.complete(spark, f"{path}/terms"))
    own = batches.folder(path, version, "v")
    if version not in batches.complete(spark, path, "v"):
        counts = batches.read_batches(spark, f"{path}/terms", TERMS, before=version + 1).select(TERMS.names)
        cat.save(cat.fit(spark, counts), own)
        batches.publish(spark, own)
    return cat.load(spark, own)


def load_or_retrain(spark: SparkSession, path: str) -> cat.NBModel:
    """SRC9: the saved model where it is up to date, else a new one."""
    return retrain(spark, path) if is_stale(spark, path) else load(spark, path)


def forget(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` versions."""
    for version in batches.complete(spark, path, "v")[:-keep]:
        batches.remove(spark, batches.folder(path, version, "v"))
