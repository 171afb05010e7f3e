"""CSV files whose rows go on over several lines, read by many tasks.

Where a row ends depends on whether a line end lies inside quotes, which depends on all quotes before it. So the quotes of each
byte range (a split of the text reader) are counted first, and the parities of the ranges of a file added up in order: each
range then knows whether it begins inside a value. A second pass cuts every range into rows on its own. What belongs to a row
of another range comes out as a fragment - the end of a row that began before, or the begin of one that goes on - and fragments
are put together by file and row; there are two of them a range at most.

Quotes must be where the format has them: around whole values, and doubled inside. Where they are not (a stray quote), rows()
says so by None, and the caller reads the file in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
#: Kinds of what a range gives: whole rows, the end of a row, a part that neither begins nor ends a row, the begin of a row.
WHOLE, END, THROUGH, BEGIN = 0, 1, 2, 3
_CUT = "file string, block long, place long, kind int, value string"


class _Range:
    """Cuts the lines of a range into rows; lines come in order, in batches."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.pending: list[str] = []
        self.began_inside, self.place = inside, 0

    def take(self, lines: pa.Array) -> pa.RecordBatch | None:
        odd = np.asarray(pc.count_substring(lines, QUOTE)) % 2
        after = (np.cumsum(odd) + self.inside) % 2
        if not len(odd):
            return None
        if not after.any() and not self.pending and not self.inside:
            return self._rows(lines, WHOLE)
        ends = np.flatnonzero(after == 0)
        self.inside = bool(after[-1])
        text, values, start = lines.to_pylist(), [], 0
        for e in ends.tolist():
            values.append("\n".join([*self.pending, *text[start : e + 1]]))
            self.pending, start = [], e + 1
        self.pending += text[start:]
        if not values:
            return None
        kinds = [WHOLE] * len(values)
        if self.began_inside:
            kinds[0], self.began_inside = END, False
        return self._rows(pa.array(values, pa.string()), kinds)

    def close(self) -> pa.RecordBatch | None:
        if not self.pending and not self.began_inside:
            return None
        return self._rows(pa.array(["\n".join(self.pending)], pa.string()), THROUGH if self.began_inside else BEGIN)

    def _rows(self, values: pa.Array, kind: int | list[int]) -> pa.RecordBatch:
        n = len(values)
        out = [pa.array([self.file] * n), pa.array([self.block] * n, pa.int64()), pa.array(np.arange(self.place, self.place + n)), pa.array([kind] * n if isinstance(kind, int) else kind, pa.int32()), values]
        self.place += n
        return pa.RecordBatch.from_arrays(out, names=["file", "block", "place", "kind", "value"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Range | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
        turns = [0, *(i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]), len(files)]
        for a, b in zip(turns, turns[1:], strict=False):
            if now is None or (now.file, now.block) != (files[a], blocks[a]):
                if now is not None and (out := now.close()) is not None:
                    yield out
                now = _Range(files[a], int(blocks[a]), bool(batch.column("inside")[a].as_py()))
            if (out := now.take(batch.column("value").slice(a, b - a).combine_chunks() if isinstance(batch.column("value"), pa.ChunkedArray) else batch.column("value").slice(a, b - a))) is not None:
                yield out
    if now is not None and (out := now.close()) is not None:
        yield out


def logical_rows(spark: SparkSession, uri: str) -> DataFrame:
    """file, block, place, value: the rows of CSV files, as text, and where they begin."""
    lines = spark.read.text(uri).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    ranges = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    known = ranges.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    cut = lines.join(F.broadcast(known), ["file", "block"]).select("file", "block", "inside", "value").mapInArrow(_cut, _CUT)
    parts = cut.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)  # two rows per range at most
    numbered = parts.withColumn("row", F.sum((F.col("kind") == BEGIN).cast("int")).over(order))
    piece = F.struct("block", "kind", "value", "place")
    joined = numbered.groupBy("file", "row").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    whole = joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["place"].alias("place"), F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    return cut.filter(F.col("kind") == WHOLE).select("file", "block", "place", "value").unionByName(whole).filter(F.trim("value") != "")


def rows(spark: SparkSession, uri: str, sep: str) -> DataFrame | None:
    """The rows of one CSV file with a header, all columns as text; None if quotes are not where the format has them."""
    every = logical_rows(spark, uri)
    mark = rf"\x{ord(sep):02x}"
    value = rf'(?:"(?:[^"]|"")*+"|[^"{mark}]*+)'
    if not every.filter(~F.col("value").rlike(rf"^{value}(?:{mark}{value})*+$")).isEmpty():
        return None
    first = every.orderBy("block", "place").limit(1).collect()
    if not first:
        return None
    options = {"sep": sep, "escape": QUOTE, "quote": QUOTE}
    head = spark.createDataFrame([(first[0]["value"],)], "value string").select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(first[0]["value"].count(sep) + 1)), options).alias("h")).first()["h"]
    names = [n for n in head if n is not None]
    body = every.filter((F.col("block") != first[0]["block"]) | (F.col("place") != first[0]["place"]))
    said = body.select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), options).alias("r"))
    return said.select(*(F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)))


def typed(df: DataFrame) -> DataFrame:
    """df's text columns as whole numbers, numbers or booleans where all values are such; one aggregate."""
    kinds = (("bigint", T.LongType()), ("double", T.DoubleType()), ("boolean", T.BooleanType()))
    asked = []
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        asked += [F.count(v).alias(f"n{i}"), *(F.count(v.try_cast(k)).alias(f"{k}{i}") for k, _ in kinds)]
        asked.append(F.count_if(v.rlike(r"^\s*[tTfFyYnN01]\S{0,1}\s*$") & ~F.lower(v).isin("true", "false")).alias(f"odd{i}"))  # t, y, 1: no booleans of a file
    said = df.agg(*asked).first().asDict()
    out = []
    for i, c in enumerate(df.columns):
        fit = next((k for k, _ in kinds if said[f"n{i}"] and said[f"{k}{i}"] == said[f"n{i}"] and (k != "boolean" or not said[f"odd{i}"])), None)
        out.append(F.col(f"`{c}`").cast(fit).alias(c) if fit else F.col(f"`{c}`"))
    return df.select(*out)
