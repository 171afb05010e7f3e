"""Integrity checks on streams: an addition to the batch checks, with the same results once all of the input is in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shadowset.operators.validate import orphans
from shadowset.plans.ranking import shared_dir


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/shadowset-streams/{name}-{uuid.uuid4().hex}"


def watch_orphans(stream: DataFrame, column: str, parent: DataFrame, key: str, out: str, checkpoint: str):
    """Start a query that appends every micro-batch's orphan rows to the Parquet folder ``out``: each row of the stream is tested once, exactly."""

    def write(batch: DataFrame, number: int) -> None:
        orphans(batch, column, parent, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def stream_orphans(spark: SparkSession, path: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The orphan rows of a Parquet table read as a stream, after all of it has been read."""
    schema = spark.read.parquet(path).schema
    top, _, name = path.rpartition("/")
    pattern = f"{top}/{name}"
    out = _place(spark, "orphans")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = reader.parquet(pattern if not name.endswith(".parquet") or _is_folder(spark, path) else f"{top}/{name[:-8]}*.parquet")
    query = watch_orphans(stream, column, parent, key, out, _place(spark, "checkpoint"))
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.option("recursiveFileLookup", True).schema(schema).parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
