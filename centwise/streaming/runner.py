"""Run a streaming query over files in a folder to completion (availableNow)
into a parquet table under the shared checkpoint folder, and read it back.

The checkpoint sits beside the table, so a restarted driver or a lost executor
resumes from the last committed micro-batch, and a repeated micro-batch
replaces its own output.
"""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from centwise.session import path_exists, shared_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def file_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType,
                files_per_trigger: int = 1, part_files_per_trigger: int = 64) -> DataFrame:
    """A file-source stream over ``folder/<table>.parquet`` (and later files of that name).  Where that
    path is a folder of part files, they come so many at a time, in no particular order."""
    reader = spark.readStream.schema(schema)
    part_folder = f"{folder.rstrip('/')}/{table}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(part_folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(where) and fs.getFileStatus(where).isDirectory():
        found, names = fs.listFiles(where, True), []
        while found.hasNext():
            names.append(found.next().getPath().toString().rpartition(f"/{table}.parquet/")[2])
        if not any(map(_is_data, names)):
            raise FileNotFoundError(f"no file in {part_folder}")
        return reader.option("maxFilesPerTrigger", part_files_per_trigger).parquet(part_folder)
    if not any(fnmatch(f.getPath().getName(), f"{table}*.parquet") for f in fs.listStatus(where.getParent())):
        raise FileNotFoundError(f"no file {table}*.parquet in {folder}")
    return (reader.option("pathGlobFilter", f"{table}*.parquet")
            .option("maxFilesPerTrigger", files_per_trigger)
            .parquet(folder))


def _is_data(name: str) -> bool:
    """Whether Spark reads a file of this path within a table's folder."""
    return not any(part[:1] == "." or part[:1] == "_" and "=" not in part for part in name.split("/"))


def run_foreach_batch(spark: SparkSession, stream: DataFrame, name: str, out_schema: T.StructType,
                      transform) -> DataFrame:
    """foreachBatch: ``transform(batch_df)`` is appended to a parquet table.

    Each batch writes to its own ``b<id>`` folder with overwrite, so a
    retried batch replaces its own output instead of duplicating it.
    """
    base = shared_path(spark, name)

    def sink(batch_df, batch_id):
        transform(batch_df).write.mode("overwrite").parquet(f"{base}/data/b{batch_id:010d}")

    q = (stream.writeStream.foreachBatch(sink)
         .option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, f"{base}/data"):             # no batch came
        return spark.createDataFrame([], out_schema)
    return spark.read.schema(out_schema).parquet(f"{base}/data/b*")
