"""Table repairs before and after synthesis: dropping text, aligning key types, swapping date violations, relabelling dimensions."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.models import Analysis, DateOrder, Role
from shadowset.plans.ranking import cut, with_rank

log = logging.getLogger(__name__)


def text_columns(analysis: Analysis) -> dict[str, list[str]]:
    return {t: found for t in analysis.tables if (found := analysis.columns_with(t, Role.TEXT))}


def without_text(tables: dict[str, DataFrame], analysis: Analysis) -> dict[str, DataFrame]:
    texts = text_columns(analysis)
    return {t: df.drop(*texts.get(t, ())) for t, df in tables.items()}


def align_types(tables: dict[str, DataFrame], analysis: Analysis, warn: Callable[[str], None] = log.warning) -> dict[str, DataFrame]:
    """Child references in the type of the parent's key; where a value would be lost the column stays as it is, with a warning."""
    out = dict(tables)
    for r in analysis.relationships:
        child, parent = out.get(r.child_table), out.get(r.parent_table)
        if child is None or parent is None or r.child_column not in child.columns or r.parent_column not in parent.columns:
            continue
        kind = parent.schema[r.parent_column].dataType
        if child.schema[r.child_column].dataType == kind:
            continue
        c = F.col(f"`{r.child_column}`")
        cast = c.try_cast(kind)
        if child.filter(c.isNotNull() & cast.isNull()).limit(1).count():
            warn(f"{r.child_table}.{r.child_column} cannot be cast to {kind.simpleString()}")
        else:
            out[r.child_table] = child.withColumn(r.child_column, cast)
    return out


def swap_violations(df: DataFrame, orders: list[DateOrder]) -> DataFrame:
    """Low and high change places where low is above high; pair after pair, NULLs stay."""
    for d in orders:
        if {d.low_column, d.high_column} <= set(df.columns):
            low, high = F.col(f"`{d.low_column}`"), F.col(f"`{d.high_column}`")
            df = df.withColumns({d.low_column: F.when(low > high, high).otherwise(low), d.high_column: F.when(low > high, low).otherwise(high)})
    return df


def swap_all(tables: dict[str, DataFrame], analysis: Analysis) -> dict[str, DataFrame]:
    return {t: swap_violations(df, [d for d in analysis.date_constraints if d.table_name == t]) for t, df in tables.items()}


def relabel(df: DataFrame, column: str, row: str) -> DataFrame:
    """Distinct non-null values become column_0, column_1, ... by their first row; NULL stays."""
    c = F.col(f"`{column}`")
    first = df.filter(c.isNotNull()).groupBy(c.alias("_v")).agg(F.min(row).alias("_at"))
    labels = with_rank(first, ["_at", "_v"], "_i").select("_v", F.concat(F.lit(f"{column}_"), F.col("_i").cast("string")).alias("_label"))
    return df.join(labels, c == F.col("_v"), "left").withColumn(column, F.col("_label")).drop("_v", "_label")


def relabel_dimensions(tables: dict[str, DataFrame], analysis: Analysis, row: str) -> dict[str, DataFrame]:
    out = dict(tables)
    for t, df in tables.items():
        columns = df.columns
        found = [c for c in (analysis.columns_with(t, Role.DIMENSION) if t in analysis.tables else ()) if c in columns]
        if found:
            df = cut(df)  # read for every dimension and for the result
        for c in found:
            df = relabel(df, c, row)
        out[t] = df.select(*(f"`{c}`" for c in columns))
    return out
