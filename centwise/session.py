"""SparkSession construction and shared-storage helpers.

Jobs never write to a machine-local folder on a cluster: intermediate tables
and streaming checkpoints go under ``spark.checkpoint.dir`` which the cluster
names.  Only when that setting is absent (local tests) do we pick a scratch
folder ourselves.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "centwise") -> SparkSession:
    """Session for tests and the bench.  On a cluster the submitter's settings win."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", os.environ.get("CENTWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  Where ``spark.checkpoint.dir`` is unset a
    scratch folder is made, on a local master only: on a cluster a folder of one
    machine would lose data, so that is an error."""
    sc = spark.sparkContext
    current = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="centwise-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for a written table."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it
    back.  Used for an intermediate that several branches of one job read (the
    monthly fact): branches scan the written table instead of re-running its
    lineage, and a lost executor re-reads files instead of recomputing joins."""
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_by(spark: SparkSession, df, name: str, key: str):
    """``materialize`` with the rows laid by ``key``, in as many buckets as a shuffle has partitions:
    what groups or joins by it then reads the table without a shuffle.  Returned is the table so laid
    and, for whom the layout is no use, as plain files.  The table's entry in the
    catalog is dropped once it is read; its files stay in the shared folder."""
    path, table = shared_path(spark, name), f"{name}_{uuid.uuid4().hex[:12]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    laid = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return laid, spark.read.schema(laid.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in its store; errors of the store are not hidden."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
