"""Plausible rows without a model, column by column.

Values of the source are drawn with replacement, exactly and from all of them: the first values of a random order (a top-k of each
partition) and their number are all that n draws need, since a draw is either one of the values drawn before, in proportion to how
many those are, or the next of the order. So the driver holds as many values as the preview has rows. All columns of a source are
looked at side by side, and the ranges of its numbers and times in one aggregate.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shadowset.functions import random as R
from shadowset.functions.fakes import Fakes, fake_column
from shadowset.models import Analysis, Role
from shadowset.operators.profile import together

ROW = "_row"


def resampled(source: DataFrame, column: str, n: int, seed: int, stream: str, distinct: bool = False) -> list:
    """n draws with replacement from the non-null values of source: as often as they occur, or evenly among the distinct ones. Empty if there are none.

    Draws of distinct values depend on seed and values alone, others also on the order of the source's rows in its partitions.
    """
    c = F.col(f"`{column}`")
    values = source.filter(c.isNotNull()).select(c.alias("v"))
    if distinct:
        values = values.distinct()
        key = F.struct(F.xxhash64(F.lit(seed), F.lit(stream), "v").alias("h"), F.xxhash64(F.lit(seed + 1), F.lit(stream), "v").alias("g"))
    else:
        key = F.xxhash64(F.lit(seed), F.lit(stream), F.monotonically_increasing_id())
    first, count = together(source.sparkSession, [lambda: [r["v"] for r in values.withColumn("_k", key).orderBy("_k").limit(n).collect()], values.count])
    rnd, seen, out = random.Random(f"{seed}/{stream}"), 0, []
    for _ in range(n if count else 0):
        if rnd.random() * count < seen:
            out.append(first[rnd.randrange(seen)])
        else:
            out.append(first[seen])
            seen += 1
    return out


def preview(table: str, analysis: Analysis, tables: dict[str, DataFrame], n_rows: int = 10, redact: bool = False, seed: int = 0) -> DataFrame:
    """n_rows rows of the table's shape. redact: nothing of the source's values shows but ranges of numbers and times."""
    meta, source = analysis.tables[table], tables.get(table)
    spark = next(iter(tables.values())).sparkSession
    row, fakes = F.col(ROW), Fakes(seed)
    draws: dict[str, tuple[T.DataType, Callable[[], list]]] = {}
    ranges: dict[str, list[Column]] = {}
    made: dict[str, Callable[[dict], Column]] = {}

    def draw(name: str, of: DataFrame, column: str, distinct: bool = False) -> None:
        draws[name] = of.schema[column].dataType, lambda: resampled(of, column, n_rows, seed, f"preview/{table}.{name}", distinct)

    for name, c in meta.columns.items():
        kind = source.schema[name].dataType if source is not None and name in source.columns else None
        own = source if kind is not None else None
        stream, col = f"preview/{table}.{name}", F.col(f"`{name}`")
        made[name] = lambda known: F.lit(None).cast("string")
        if c.role == Role.PRIMARY_KEY or c.is_primary_key:
            made[name] = lambda known, kind=kind, stream=stream: R.uuid(row, seed, stream) if isinstance(kind, T.StringType) else row + 1
        elif c.role == Role.FOREIGN_KEY and c.foreign_key_target:
            parent, _, key = c.foreign_key_target.partition(".")
            if redact:
                made[name] = lambda known: row + 1
            elif parent in tables and key in tables[parent].columns and not tables[parent].filter(F.col(f"`{key}`").isNotNull()).isEmpty():
                draw(name, tables[parent], key)
            elif own is not None:
                draw(name, own, name)
        elif c.role == Role.TEXT:
            made[name] = lambda known, c=c, name=name, stream=stream: fake_column(fakes, name, c.faker_override)(row, stream)
        elif c.sdtype == "numerical" or c.role == Role.MEASURE:
            if own is not None:
                ranges[name] = [F.min(col), F.max(col)]
            made[name] = lambda known, name=name, kind=kind, stream=stream: _number(*known.get(name, (None, None)), kind, row, seed, stream)
        elif c.sdtype == "datetime" or c.role == Role.DATE:
            if own is not None:
                at = F.unix_micros(col.try_cast("timestamp"))
                ranges[name] = [F.min(at), F.max(at)]
            made[name] = lambda known, name=name, stream=stream: _time(*known.get(name, (None, None)), row, seed, stream)
        elif c.sdtype == "boolean":
            made[name] = lambda known, stream=stream: R.uniform(row, seed, stream) < 0.5
        elif c.sdtype == "categorical" or c.role == Role.DIMENSION:
            if redact:
                if own is not None:
                    ranges[name] = [F.count_distinct(col), F.lit(0)]
                made[name] = lambda known, name=name, stream=stream: F.concat(F.lit("Category_"), (R.integer(row, seed, stream, known.get(name, (0, 0))[0] or 5) + 1).cast("string"))
            else:
                made[name] = lambda known: F.concat(F.lit("cat_"), row.cast("string"))
                if own is not None:
                    draw(name, own, name, distinct=True)
        elif redact:
            made[name] = lambda known: F.concat(F.lit("value_"), (row + 1).cast("string"))
        elif own is not None:
            draw(name, own, name)

    def bounds() -> dict[str, tuple]:
        if not ranges:
            return {}
        found = source.agg(*(e.alias(f"{i}_{k}") for i, two in enumerate(ranges.values()) for k, e in enumerate(two))).first()
        return {name: (found[f"{i}_0"], found[f"{i}_1"]) for i, name in enumerate(ranges)}

    known, *found = together(spark, [bounds, *(job for _, job in draws.values())], 8)
    drawn = {name: values for name, values in zip(draws, found, strict=True) if values}
    kinds = T.StructType([T.StructField(ROW, T.LongType()), *(T.StructField(name, draws[name][0]) for name in drawn)])
    out = spark.createDataFrame([(i, *(values[i] for values in drawn.values())) for i in range(n_rows)], kinds)
    return out.select(ROW, *(F.col(f"`{c}`") if c in drawn else make(known).alias(c) for c, make in made.items())).orderBy(ROW).drop(ROW)


def _number(low, high, kind: T.DataType | None, row: Column, seed: int, stream: str) -> Column:
    u = R.uniform(row, seed, stream)
    if low is None:
        return 100 * u
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.lit(low) + R.integer(row, seed, stream, max(1, high - low + 1))
    return F.round(F.lit(float(low)) + (float(high) - float(low)) * u, 2)


def _time(low: int | None, high: int | None, row: Column, seed: int, stream: str) -> Column:
    low, span = (0, 50 * 365 * 86_400_000_000) if low is None else (low, high - low or 86_400_000_000)
    return F.timestamp_micros((F.lit(low) + span * R.uniform(row, seed, stream)).cast("long"))
