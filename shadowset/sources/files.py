"""Loading a folder of CSV, TSV and XLSX files as tables."""

from __future__ import annotations

import datetime as dt
import logging
import os
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shadowset.functions.names import distinct_columns, distinct_table, table_name
from shadowset.sources import multiline
from shadowset.sources import multiline
from shadowset.sources import multiline
from shadowset.sources.xlsx import Workbook

log = logging.getLogger(__name__)
TEXT_FILES, BOOKS = (".csv", ".tsv"), (".xlsx", ".xls")
MB = 1 << 20


def _env(name: str, default: int) -> int:
    return int(os.environ.get(f"SHADOWSET_{name}", default))


@dataclass
class Limits:
    """Bounds of a load; each but warn_mb has an environment variable SHADOWSET_<NAME>."""

    max_depth: int = field(default_factory=lambda: _env("MAX_DEPTH", 10))
    max_files: int = field(default_factory=lambda: _env("MAX_FILES", 500))
    discovery_timeout: int = field(default_factory=lambda: _env("DISCOVERY_TIMEOUT", 60))
    max_file_mb: int = field(default_factory=lambda: _env("MAX_FILE_MB", 500))
    max_total_mb: int = field(default_factory=lambda: _env("MAX_TOTAL_MB", 2000))
    warn_mb: int = 200


@dataclass
class Loaded:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    sources: dict[str, str] = field(default_factory=dict)
    relative_dirs: dict[str, str] = field(default_factory=dict)


def discover(folder: str | Path, limits: Limits | None = None) -> list[Path]:
    """All data files below folder, sorted. Too many, none at all, a missing folder or a slow listing are errors; deeper files are passed over."""
    limits, top = limits or Limits(), Path(folder)
    if not top.exists():
        raise FileNotFoundError(f"no folder {folder}")
    top, began, found = top.resolve(), time.monotonic(), []
    for where, _, names in os.walk(top):
        if time.monotonic() - began > limits.discovery_timeout:
            raise TimeoutError(f"listing {folder} took more than {limits.discovery_timeout} s")
        here = Path(where)
        if len(here.relative_to(top).parts) > limits.max_depth:
            continue
        found += [here / n for n in names if Path(n).suffix.lower() in TEXT_FILES + BOOKS]
        if len(found) > limits.max_files:
            raise ValueError(f"more than {limits.max_files} data files in {folder}")
    if not found:
        raise ValueError(f"no data files in {folder}")
    return sorted(found)


discover_workbooks = discover


def _renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*distinct_columns(df.columns))


def _one_row_a_line(spark: SparkSession, uri: str) -> bool:
    """Whether no row goes on in the next line: a line that opens a quoted value and does not close it has an odd number of quotes."""
    lines = spark.read.text(uri)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    blank = F.col("value").rlike(r"^[\x00-\x20]+$")  # a row, which reading by lines would pass over
    return lines.filter(odd | blank).isEmpty()


def load_csv(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    """A CSV or TSV file as one table; numbers and booleans are inferred, dates stay text. None if it has no rows."""
    path = Path(path)
    sep, uri = "\t" if path.suffix.lower() == ".tsv" else ",", path.resolve().as_uri()
    read = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    if not _one_row_a_line(spark, uri):  # by lines many tasks share a file
        if (rows := multiline.rows(spark, uri, sep)) is not None:
            return {table_name(path.stem): df} if (df := multiline.typed(rows)).limit(1).count() else {}
        read = read.option("multiLine", True)  # a stray quote
    inferred = read.option("inferSchema", True).option("samplingRatio", 1.0).csv(uri)
    plain = {T.DateType, T.TimestampType, T.TimestampNTZType}
    schema = T.StructType([T.StructField(f.name, T.StringType() if type(f.dataType) in plain else T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType) for f in inferred.schema.fields])
    df = read.schema(schema).csv(uri)
    return {table_name(path.stem): df} if df.limit(1).count() else {}


def _sheet_type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int} and kinds:
        return T.LongType()
    if kinds <= {int, float} and kinds:
        return T.DoubleType()
    return T.BooleanType() if kinds == {bool} else T.TimestampType() if kinds == {dt.datetime} else T.StringType()


def load_workbook(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    """Each sheet with rows as a table: named after the file, and after the sheet too if the workbook has several."""
    path = Path(path)
    if path.suffix.lower() == ".xls":
        raise NotImplementedError("binary .xls workbooks are not read; save as .xlsx")
    book, out = Workbook(str(path)), {}
    for sheet in book.sheets:
        head, *rows = list(book.rows(sheet)) or [[]]
        if not rows:
            continue
        head = [str(h) if h is not None else f"column_{i + 1}" for i, h in enumerate(head)]
        rows = [(r + [None] * len(head))[: len(head)] for r in rows]
        kinds = [_sheet_type([r[i] for r in rows]) for i in range(len(head))]
        make = lambda v, k: None if v is None else float(v) if isinstance(k, T.DoubleType) else str(v) if isinstance(k, T.StringType) else v
        data = [tuple(make(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows]
        name = table_name(path.stem if len(book.sheets) == 1 else f"{path.stem}_{sheet.replace(' ', '_')}")
        out[name] = spark.createDataFrame(data, T.StructType([T.StructField(h, k) for h, k in zip(distinct_columns(head), kinds, strict=True)]))
    return out


def load_all(spark: SparkSession, folder: str | Path, limits: Limits | None = None) -> Loaded:
    """All tables of a folder. Files that cannot be read, or are too large, are passed over with a warning; nothing loaded is an error."""
    limits, out, total = limits or Limits(), Loaded(), 0.0
    top = Path(folder).resolve()
    for path in discover(folder, limits):
        mb = path.stat().st_size / MB
        if mb > limits.max_file_mb:
            log.warning("%s is too large", path.name)
            continue
        if mb > limits.warn_mb:
            log.warning("%s is large", path.name)
        total += mb
        if total > limits.max_total_mb:
            raise ValueError(f"more than {limits.max_total_mb} MB in {folder}")
        try:
            found = load_csv(spark, path) if path.suffix.lower() in TEXT_FILES else load_workbook(spark, path)
        except Exception as error:
            log.warning("%s could not be read: %s", path.name, error)
            continue
        for name, df in found.items():
            name = distinct_table(name, out.tables)
            where = path.parent.relative_to(top).as_posix()
            out.tables[name], out.sources[name], out.relative_dirs[name] = _renamed(df), str(path), "" if where == "." else where
    if not out.tables:
        raise ValueError(f"no tables in {folder}")
    return out
