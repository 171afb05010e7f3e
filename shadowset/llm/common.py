"""Helpers shared by the operators: inputs, shared scratch tables, Arrow batches."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of one Arrow batch handed to Python, so that long texts cannot fill a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Words remembered in a worker, at most.
WORDS = 250_000
#: How tables of rows of megabytes are written. Parquet's writer looks at a page's size after 100 rows first, however large they are, and a
#: reader unpacks a row group (of so many compressed bytes) at once: so a page may end after any row, and a row group has few.
GROUP_ROWS = 4
LARGE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.block.row.count.limit": GROUP_ROWS, "parquet.enable.dictionary": "false"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small by rows and by bytes; smaller settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).lower().removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may go without; it gets one in the temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/shadowset-{os.getpid()}"


class _Hashes(dict):
    """The XXH3 hash of a word; operators share one memory of it in each worker."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORDS:
            self[word] = value
        return value


HASHES = _Hashes()
_MADE: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/shadowset/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Scratch tables that are made in here are deleted at its end."""
    _MADE.append(made := [])
    try:
        yield
    finally:
        _MADE.pop()
        dropped(spark, *made)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, stored; all scratch tables that it made on the way are deleted."""
    path = scratch(spark, name)
    with temporary(spark):
        df = make()
        df.write.option("compression", "zstd").parquet(path)
        kind = df.schema
    return spark.read.schema(kind).parquet(path)


def stored(df: DataFrame, name: str, codec: str = "zstd", large_rows: bool = False) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: the lineage ends there and outlives lost executors. large_rows: rows may have megabytes each."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", codec).options(**LARGE_ROWS if large_rows else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, stored with a key of its own for each row, and the name of the key's column."""
    key = unused(df, "_row")
    return stored(df.withColumn(key, F.monotonically_increasing_id()), name)[0], key


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no returned plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a per-task function: make() runs once in each task, its result once for each batch."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
