"""Global ranks, prefix sums and nearest values without a one-partition window."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may go without; it gets one in the temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/shadowset-{os.getpid()}"


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: the rows are fixed, made once (a checkpoint makes them twice), and outlive lost executors."""
    if any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):  # not to be written as a table
        spark = df.sparkSession
        if not spark.conf.get("spark.checkpoint.dir", None):
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        return df.checkpoint()
    return stored(df)[0]


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and its path: what several aggregates read is made once."""
    path = f"{shared_dir(df.sparkSession)}/shadowset/{df.sparkSession.sparkContext.applicationId}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def with_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a gapless rank from 0 by order: ranges are sorted on their own, and each begins where the ranges before it end."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    base = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_r", own).join(base, "_p").withColumn(name, F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def with_prefix(df: DataFrame, index: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over all smaller indexes. index: gapless from 0."""
    return with_prefixes(df, index, {name: value})


def with_prefixes(df: DataFrame, index: str, sums: dict[str, str]) -> DataFrame:
    """with_prefix for several columns: name of the sum -> value."""
    blocks = df.withColumn("_k", F.floor(F.col(index) / BLOCK))
    totals = blocks.groupBy("_k").agg(*(F.sum(v).alias(f"_s{i}") for i, v in enumerate(sums.values())))
    before = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    base = totals.select("_k", *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))))
    within = Window.partitionBy("_k").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    own = blocks.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_o{i}") for i, v in enumerate(sums.values())))
    return own.join(base, "_k").select(*(f"`{c}`" for c in df.columns), *((F.col(f"_b{i}") + F.col(f"_o{i}")).alias(name) for i, name in enumerate(sums)))


def with_fills(df: DataFrame, order: list[str], fills: dict[str, tuple[Column, bool]]) -> DataFrame:
    """df with further columns: the nearest value that is not null in the order of the columns ``order``. fills: name -> (value, whether it
    comes from the rows after a row and not from it and those before). Ranges are filled on their own; what a range cannot know comes from
    its neighbours' ends, of which there is a row per range."""
    kept = df.columns
    ranged = cut(df.withColumns({f"_f{i}": value for i, (value, _) in enumerate(fills.values())}).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    place = F.struct(*order)
    ends = ranged.groupBy("_p").agg(*((F.min_by if after else F.max_by)(F.col(f"_f{i}"), F.when(F.col(f"_f{i}").isNotNull(), place)).alias(f"_e{i}") for i, (_, after) in enumerate(fills.values())))
    # from the rows after a row: backwards, as a frame that ends with the partition is gone through anew for every row
    turned = {False: F.asc, True: F.desc}
    over = {after: Window.orderBy(turn("_p")).rowsBetween(Window.unboundedPreceding, -1) for after, turn in turned.items()}  # a row per partition
    ends = ends.select("_p", *(F.last(f"_e{i}", ignorenulls=True).over(over[after]).alias(f"_e{i}") for i, (_, after) in enumerate(fills.values())))
    within = {after: Window.partitionBy("_p").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, -1 if after else 0) for after, turn in turned.items()}
    near = ranged.select("*", *(F.last(f"_f{i}", ignorenulls=True).over(within[after]).alias(f"_o{i}") for i, (_, after) in enumerate(fills.values())))
    return near.join(ends, "_p").select(*(f"`{c}`" for c in kept), *(F.coalesce(f"_o{i}", f"_e{i}").alias(name) for i, name in enumerate(fills)))
