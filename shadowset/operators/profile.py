"""Column profiles: what the detection rules need to know of a table, in few passes.

Distinct counts are exact and count NULL as a value (``distinct_values``) or not (``distinct_known``). Several distinct counts
in one aggregate would make Spark expand every row, with all its columns, once per column. Here a row gives a number and a
128-bit digest for each column, which are added up in the task and then by column and digest: one scan, whatever the source,
and a shuffle of distinct digests. A rule that only needs the columns near its threshold names them by an estimate first (a
HyperLogLog pass, without any shuffle of values), and only those are counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

R = TypeVar("R")

@dataclass
class ColumnProfile:
    name: str
    ordinal: int
    type: T.DataType
    rows: int
    nulls: int
    distinct_known: int
    mean_length: float | None

    @property
    def distinct_values(self) -> int:
        return self.distinct_known + (self.nulls > 0)

    @property
    def ratio(self) -> float:
        return self.distinct_values / self.rows if self.rows else 0.0


#: Relative standard deviation of an estimate, and how many of them a decision leaves on either side.
DEVIATION, SIGMAS = 0.02, 6
SLACK = DEVIATION * SIGMAS


def digest(c: str, kind: T.DataType) -> Column:
    """What stands for a value in distinct counts: two independent hashes. Maps have no equality, so their sorted entries; -0.0 is 0.0, as in groups."""
    col = F.col(f"`{c}`")
    value = F.array_sort(F.map_entries(col)) if isinstance(kind, T.MapType) else col + F.lit(0.0).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else col
    return F.when(col.isNotNull(), F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b")))


def state(df: DataFrame) -> DataFrame:
    """What df's profile is made of: ordinal, d (digest, or null), n, chars. Such tables of files that came one after the other are put together by merged()."""
    return _digests(df, list(enumerate(df.schema.fields)), True)


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows that the given states are of."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("ordinal", "d").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


def _digests(df: DataFrame, fields: list[tuple[int, T.StructField]], lengths: bool = False) -> DataFrame:
    length = lambda f: F.char_length(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.lit(None)
    each = F.array(*(F.struct(F.lit(i).alias("ordinal"), digest(f.name, f.dataType).alias("d"), *([length(f).cast("long").alias("c")] if lengths else [])) for i, f in fields))
    return df.select(F.inline(each)).groupBy("ordinal", "d").agg(F.count(F.lit(1)).alias("n"), *([F.sum("c").alias("chars")] if lengths else []))


def _counted(values: DataFrame) -> DataFrame:
    null = F.col("d").isNull()
    lengths = [(F.sum("chars") / F.sum(F.when(~null, F.col("n")))).alias("mean_length")] if "chars" in values.columns else []
    return values.groupBy("ordinal").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("n_null"), F.count("d").alias("n_known"), *lengths)


def distinct_counts(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    """ordinal, n_rows, n_null, n_known: a row for each of the fields, if df has rows; n_known: distinct values that are not null."""
    return _counted(_digests(df, fields))


def profile_of_state(kept: DataFrame, schema: T.StructType) -> dict[str, ColumnProfile]:
    """The profile of the rows that a state is of, without reading them again."""
    counts = {r["ordinal"]: r for r in _counted(kept).collect()}  # a row per column
    row = lambda i: counts[i].asDict() if i in counts else {"n_rows": 0, "n_null": 0, "n_known": 0, "mean_length": None}
    return {f.name: ColumnProfile(f.name, i, f.dataType, (r := row(i))["n_rows"], r["n_null"], r["n_known"], r["mean_length"]) for i, f in enumerate(schema.fields)}


#: Bits of a sketch's buckets, and how far a decision stays from its estimate.
SKETCH_BITS, SKETCH_SLACK = 14, 0.06


def sketches(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """names, sketch: a HyperLogLog sketch of the distinct combinations of each set of columns, NULL being a value, from one scan.

    Stored, such a table can be put together with that of other rows by merged_sketches().
    """
    each = [F.hll_sketch_agg(F.xxhash64(*(x for c in s for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`")))), SKETCH_BITS).alias(f"s{i}") for i, s in enumerate(sets)]
    rows = F.array(*(F.struct(F.array(*map(F.lit, s)).alias("names"), F.col(f"s{i}").alias("sketch")) for i, s in enumerate(sets)))
    return df.agg(*each).select(F.inline(rows))


def merged_sketches(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("names").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(kept: DataFrame) -> dict[tuple[str, ...], int]:
    """How many distinct combinations each set of columns has, about."""
    return {tuple(r["names"]): r["n"] for r in kept.select("names", F.hll_sketch_estimate("sketch").alias("n")).collect()}


def combinations(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """How many distinct combinations each set of columns has, exactly, NULL being a value; one scan."""
    if not sets:
        return {}
    hashed = lambda s: [x for c in s for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.xxhash64(*hashed(s)).alias("a"), F.xxhash64(F.lit(1), *hashed(s)).alias("b")) for i, s in enumerate(sets)))
    counts = {r["i"]: r["n"] for r in df.select(F.inline(each)).distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {s: counts.get(i, 0) for i, s in enumerate(sets)}


def profile(df: DataFrame, needed: Callable[[ColumnProfile], bool] | None = None, kind: type[T.DataType] = T.DataType, names: Collection[str] | None = None) -> dict[str, ColumnProfile]:
    """All columns of a kind, exactly. needed: only the columns whose estimated profile it accepts are counted and given. names: only these columns."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, kind) and (names is None or f.name in names)]
    if not fields:
        return {}
    asked = [F.count(F.lit(1)).alias("rows")]
    for i, f in fields:
        value = digest(f.name, f.dataType) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
        asked += [*_simple(i, f), *([F.approx_count_distinct(value, DEVIATION).alias(f"d{i}")] if needed else [])]
    if needed:
        row = df.agg(*asked).first().asDict()
        fields = [(i, f) for i, f in fields if needed(_of(i, f, row))]
        counts = {r["ordinal"]: r for r in distinct_counts(df, fields).collect()} if fields else {}
    else:
        with ThreadPoolExecutor(2) as pool:
            one, two = pool.submit(inheritable_thread_target(df.sparkSession)(lambda: df.agg(*asked).first().asDict())), pool.submit(inheritable_thread_target(df.sparkSession)(distinct_counts(df, fields).collect))
            row, counts = one.result(), {r["ordinal"]: r for r in two.result()}
    return {f.name: _of(i, f, row | {f"d{i}": counts[i]["n_known"] if i in counts else 0}) for i, f in fields}


def _simple(i: int, f: T.StructField) -> list[Column]:
    c = F.col(f"`{f.name}`")
    return [F.count_if(c.isNull()).alias(f"n{i}"), *([F.avg(F.char_length(c)).alias(f"l{i}")] if isinstance(f.dataType, T.StringType) else [])]


def _of(i: int, f: T.StructField, row: dict) -> ColumnProfile:
    return ColumnProfile(f.name, i, f.dataType, row["rows"], row[f"n{i}"], row[f"d{i}"], row.get(f"l{i}"))


def profile_frame(df: DataFrame, table: str) -> DataFrame:
    """The profile as rows: table_name, column_name, ordinal, n_rows, n_null, n_distinct (NULL as a value), uniqueness."""
    fields = list(enumerate(df.schema.fields))
    names = df.sparkSession.createDataFrame([(i, f.name) for i, f in fields], "ordinal int, column_name string")
    counts = names.join(F.broadcast(distinct_counts(df, fields)), "ordinal", "left")  # a row per column
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    distinct = zero(F.col("n_known")) + (zero(F.col("n_null")) > 0).cast("long")
    flat = counts.select(F.lit(table).alias("table_name"), "column_name", "ordinal", zero(F.col("n_rows")).alias("n_rows"), zero(F.col("n_null")).alias("n_null"), distinct.alias("n_distinct"))
    return flat.withColumn("uniqueness", F.when(F.col("n_rows") > 0, F.col("n_distinct") / F.col("n_rows")).otherwise(0.0))


def together(spark: SparkSession, jobs: Iterable[Callable[[], R]], at_once: int = 4) -> list[R]:
    """The results of jobs of several tables, some run at the same time."""
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
