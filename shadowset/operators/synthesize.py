"""Synthesis of whole table sets: models per table or along the relationships, references, text, labels."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shadowset.functions import random as R
from shadowset.functions.fakes import Fakes, fake_column
from shadowset.models import METHODS, Analysis, Relationship, Role
from shadowset.operators import copula, repair
from shadowset.operators.stitch import stitch_all
from shadowset.operators.validate import expected_rows
from shadowset.plans.ranking import cut, with_rank

log = logging.getLogger(__name__)
ROW, SCORES, GIVEN = "_row", "_scores", "_given"
MULTI_TABLE_LIMIT = 10
WARN_ROWS, SMALL_ROWS = 1_000_000, 3


def max_rows() -> int | None:
    """As many rows as may be made, if SHADOWSET_MAX_OUTPUT_ROWS says so; rows are made by tasks, so no other limit is needed."""
    most = os.environ.get("SHADOWSET_MAX_OUTPUT_ROWS")
    return int(most) if most else None


def choose_method(analysis: Analysis, method: str = "auto") -> str:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method != "auto":
        return method
    return "hma" if analysis.relationships and len(analysis.tables) <= MULTI_TABLE_LIMIT else "per_table"


def guard_output(analysis: Analysis, scale: float, warn: Callable[[str], None]) -> int:
    """The rows to come; more than allowed are an error before any job starts."""
    rows = sum(expected_rows(t.row_count, scale) for t in analysis.tables.values())
    if (most := max_rows()) is not None and rows > most:
        raise ValueError(f"{rows} rows would be made, {most} are allowed (SHADOWSET_MAX_OUTPUT_ROWS)")
    if rows > WARN_ROWS:
        warn(f"{rows} rows will be made")
    return rows


def _key_values(df: DataFrame, key: str | None, kind: T.DataType | None, seed: int) -> DataFrame:
    """Fresh unique keys: 1, 2, ... for numbers, UUIDs for text."""
    if key is None:
        return df
    if isinstance(kind, T.StringType):
        return df.withColumn(key, R.uuid(F.col(ROW), seed, f"key/{key}"))
    return df.withColumn(key, (F.col(ROW) + 1).cast(kind) if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)) else F.col(ROW) + 1)


def single_tables(analysis: Analysis, clean: dict[str, DataFrame], scale: float, seed: int, progress: Callable[[float, str], None]) -> dict[str, DataFrame]:
    out = {}
    for i, (name, df) in enumerate(clean.items()):
        progress(0.2 + 0.5 * i / len(clean), f"modelling {name}")
        out[name] = one_table(analysis, name, df, df.sparkSession.range(expected_rows(analysis.tables[name].row_count, scale)).withColumnRenamed("id", ROW), seed)
    return out


def one_table(analysis: Analysis, name: str, df: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """rows with the columns of df, modelled."""
    t = analysis.tables[name]
    model = copula.fit(df, *copula.constraints(analysis, name), skip=[c for c in (t.primary_key,) if c in df.columns])
    return _keyed(analysis, name, df, copula.sample(rows, ROW, model, seed, name), seed)


def _keyed(analysis: Analysis, name: str, df: DataFrame, made: DataFrame, seed: int) -> DataFrame:
    key = analysis.tables[name].primary_key
    return _key_values(made, key, df.schema[key].dataType, seed) if key in df.columns else made


#: Children of one parent row that are made together.
FAMILY = 1 << 14


def _children(parents: DataFrame, key: str, column: str, count: str) -> DataFrame:
    """A row for each child, numbered from 0 by parent: the row id, the reference and the parent's scores. A parent of many is split, so no task makes them all."""
    blocks = parents.filter(F.col(count) > 0).select(F.col(ROW).alias("_parent"), F.col(f"`{key}`").alias(column), F.col(SCORES).alias(GIVEN), F.col(count).alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / FAMILY))).alias("_k"))
    dealt = blocks.repartition("_parent", "_k")
    made = dealt.withColumn("_j", F.explode(F.sequence(F.col("_k") * FAMILY, F.least(F.col("_n"), (F.col("_k") + 1) * FAMILY) - 1)))
    return with_rank(made.select("_parent", "_j", f"`{column}`", GIVEN), ["_parent", "_j"], ROW).select(ROW, f"`{column}`", GIVEN)


def multi_table(analysis: Analysis, clean: dict[str, DataFrame], scale: float, seed: int, progress: Callable[[float, str], None]) -> tuple[dict[str, DataFrame], set[tuple]]:
    """The tables, and the edges whose references are made with them. Parents first.

    How many children a row has, along the child's first relationship, is modelled as a further column of the parent: drawn from the
    counts that occur, as often as they do, and correlated with the parent's other columns. A child's row is made for its parent: its
    normals are drawn on condition of the parent's scores, so that correlations between the two tables come back.
    """
    lead: dict[str, Relationship] = {}
    for r in analysis.relationships:
        if r.child_table in clean and r.parent_table in clean:
            lead.setdefault(r.child_table, r)
    out: dict[str, DataFrame] = {}
    models: dict[str, copula.Model] = {}
    keys: dict[str, str | None] = {}
    left = list(clean)
    while left:
        ready = [t for t in left if t not in lead or lead[t].parent_table in out]
        if not ready:
            raise ValueError("the relationships form a circle")
        for name in ready:
            progress(0.2 + 0.5 * len(out) / len(clean), f"modelling {name}")
            df, r = clean[name], lead.get(name)
            rows = df.sparkSession.range(expected_rows(analysis.tables[name].row_count, scale)).withColumnRenamed("id", ROW) if r is None else _children(out[r.parent_table], r.parent_column, r.child_column, f"_n_{name}")
            counts, key = [], None
            for child, of in lead.items():
                if of.parent_table == name:
                    counts.append(f"_n_{child}")
                    key = of.parent_column
                    often = clean[child].groupBy(F.col(f"`{of.child_column}`").alias("_c")).agg(F.count(F.lit(1)).alias(counts[-1]))
                    df = df.join(often, F.col(f"`{of.parent_column}`") == F.col("_c"), "left").drop("_c").fillna(0, [counts[-1]])
            skip = {c for c in (analysis.tables[name].primary_key, r.child_column if r else None) if c in df.columns}
            given, on = (models[r.parent_table].scored, r.child_column) if r and keys[r.parent_table] == r.parent_column else (None, None)
            keys[name] = key
            models[name] = copula.fit(df, *copula.constraints(analysis, name), skip=list(skip), exact=counts, key=key, given=given, on=on)
            made = copula.sample(rows, ROW, models[name], seed, name, GIVEN if r else None, SCORES if counts else None)
            made = _keyed(analysis, name, df, made, seed)
            out[name] = cut(made) if counts else made
        left = [t for t in left if t not in out]
    bare = {t: df.drop(SCORES, *(c for c in df.columns if c.startswith("_n_") and c[3:] in lead)) for t, df in out.items()}
    return bare, {r.edge for r in lead.values()}


def fill_text(tables: dict[str, DataFrame], analysis: Analysis, seed: int, locale: str | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """Every text column gets made-up values."""
    fakes, out = Fakes(seed, locale), dict(tables)
    for name, df in tables.items():
        for c in analysis.columns_with(name, Role.TEXT) if name in analysis.tables else ():
            meta = analysis.tables[name].columns[c]
            df = df.withColumn(c, fake_column(fakes, c, meta.faker_override, strict)(F.col(ROW), f"{name}.{c}"))
        out[name] = df
    return out


def synthesize(
    analysis: Analysis,
    tables: dict[str, DataFrame],
    scale: float = 1.0,
    seed: int | None = None,
    locale: str | None = None,
    method: str = "auto",
    anonymize_dimensions: bool = False,
    progress: Callable[[float, str], None] = lambda share, text: None,
    warn: Callable[[str], None] = log.warning,
) -> dict[str, DataFrame]:
    """Synthetic tables with the columns of the originals. The same seed gives the same rows, whatever the partitions."""
    if seed is None:
        seed = int.from_bytes(os.urandom(6), "big")
    guard_output(analysis, scale, warn)
    tables = {t: df for t, df in tables.items() if t in analysis.tables}
    clean = repair.swap_all(repair.align_types(repair.without_text(tables, analysis), analysis, warn), analysis)
    for t in analysis.tables.values():
        if t.row_count <= SMALL_ROWS:
            warn(f"{t.name} has {t.row_count} rows, too few for a distribution")
    kept: set[tuple] = set()
    if choose_method(analysis, method) == "hma":
        try:
            made, kept = multi_table(analysis, clean, scale, seed, progress)
        except (ArithmeticError, ValueError, PySparkException) as error:  # what a model or its fit can raise
            warn(f"multi-table model failed ({error}); modelling each table on its own")
            made = single_tables(analysis, clean, scale, seed, progress)
    else:
        made = single_tables(analysis, clean, scale, seed, progress)
    progress(0.75, "assigning references")
    made = stitch_all(made, analysis, ROW, seed, tables, kept)
    made = fill_text(made, analysis, seed, locale)
    if anonymize_dimensions:
        made = repair.relabel_dimensions(made, analysis, ROW)
    progress(1.0, "done")
    return {t: df.select(*(f"`{c}`" for c in tables[t].columns)) for t, df in made.items()}
