"""Integrity checks of synthetic tables, each one aggregate or anti join, and their summary."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shadowset.models import Analysis, Role


@dataclass
class Check:
    name: str
    rows: int
    bad: int

    @property
    def passed(self) -> bool:
        return self.bad == 0


@dataclass
class RowCount:
    expected: int
    actual: int

    @property
    def passed(self) -> bool:
        return self.expected == self.actual


@dataclass
class Report:
    primary_keys: dict[str, Check] = field(default_factory=dict)
    foreign_keys: dict[str, Check] = field(default_factory=dict)
    dates: dict[str, Check] = field(default_factory=dict)
    row_counts: dict[str, RowCount] = field(default_factory=dict)
    column_stats: dict[str, dict[str, dict]] = field(default_factory=dict)

    @property
    def all_passed(self) -> bool:
        """Keys, references and dates; row counts inform only."""
        return all(c.passed for part in (self.primary_keys, self.foreign_keys, self.dates) for c in part.values())

    def summary(self) -> list[str]:
        says = lambda ok: "[PASS]" if ok else "[FAIL]"
        out = [f"{says(c.passed)} PK {t}.{c.name}: {c.bad} duplicates" for t, c in self.primary_keys.items()]
        out += [f"{says(c.passed)} FK {k}: {c.bad} orphans" for k, c in self.foreign_keys.items()]
        out += [f"{says(c.passed)} Date {k}: {c.bad} violations" for k, c in self.dates.items()]
        return out + [f"{says(c.passed)} Rows {t}: {c.actual} (expected {c.expected})" for t, c in self.row_counts.items()]

    def to_json(self) -> dict:
        block = lambda checks, bad: {k: {"column": c.name, "rows": c.rows, bad: c.bad, "passed": c.passed} for k, c in checks.items()}
        return {"all_passed": self.all_passed, "primary_keys": block(self.primary_keys, "duplicates"), "foreign_keys": block(self.foreign_keys, "orphans"), "date_constraints": block(self.dates, "violations")}


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row: n_rows, n_distinct (without NULL), n_duplicates; so NULLs count as duplicates."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(f"`{key}`")).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The non-null child rows whose value the parent lacks."""
    from shadowset.operators.discover import _same_footing, as_text

    kinds = child.schema[column].dataType, parent.schema[key].dataType
    cast = _same_footing(*kinds)
    left, right = (cast(F.col(f"`{column}`")), cast(F.col(f"`{key}`"))) if cast else (as_text(F.col(f"`{column}`"), kinds[0]), as_text(F.col(f"`{key}`"), kinds[1]))
    own = parent.select(right.alias("_parent_key")).filter("_parent_key is not null").distinct()
    return child.filter(F.col(f"`{column}`").isNotNull()).join(own, left == F.col("_parent_key"), "left_anti")


def date_violations(df: DataFrame, low: str, high: str) -> DataFrame:
    """One row: n_both, n_violations."""
    a, b = F.col(f"`{low}`"), F.col(f"`{high}`")
    return df.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("n_both"), F.count_if(a > b).alias("n_violations"))


def expected_rows(rows: int, scale: float) -> int:
    return max(1, int(rows * scale))


def is_missing(c, kind: T.DataType):
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c.isNull()


def statistics(df: DataFrame, columns: list[str], numbers: list[str]) -> DataFrame:
    """One row per column: n_rows, null_ratio, and for numbers mean, std (of a sample), min and max; what is not finite is NULL."""
    asked = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(columns):
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        asked.append(F.count_if(is_missing(c, kind)).alias(f"z{i}"))
        if name in numbers:
            v = c.try_cast("double")
            v = F.when(~F.isnan(v), v)
            asked += [f(v).alias(f"{k}{i}") for k, f in (("m", F.avg), ("s", F.stddev_samp), ("l", F.min), ("h", F.max))]
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < math.inf), c)
    none = F.lit(None).cast("double")
    rows = [
        F.struct(F.lit(name).alias("column_name"), F.when(F.col("n") > 0, F.col(f"z{i}") / F.col("n")).otherwise(0.0).alias("null_ratio"), *((finite(F.col(f"{k}{i}")) if name in numbers else none).alias(a) for k, a in (("m", "mean"), ("s", "std"), ("l", "min"), ("h", "max"))))
        for i, name in enumerate(columns)
    ]
    return df.agg(*asked).select(F.col("n").alias("n_rows"), F.inline(F.array(*rows)))


def check_primary_keys(analysis: Analysis, data: dict[str, DataFrame]) -> dict[str, Check]:
    out = {}
    for name, t in analysis.tables.items():
        if t.primary_key and name in data and t.primary_key in data[name].columns:
            row = duplicates(data[name], t.primary_key).first()
            out[name] = Check(t.primary_key, row["n_rows"], row["n_duplicates"])
    return out


def check_foreign_keys(analysis: Analysis, data: dict[str, DataFrame]) -> dict[str, Check]:
    out = {}
    for r in analysis.relationships:
        child, parent = data.get(r.child_table), data.get(r.parent_table)
        if child is not None and parent is not None and r.child_column in child.columns and r.parent_column in parent.columns:
            rows = child.filter(F.col(f"`{r.child_column}`").isNotNull()).count()
            out[f"{r.child_table}.{r.child_column}->{r.parent_table}.{r.parent_column}"] = Check(r.child_column, rows, orphans(child, r.child_column, parent, r.parent_column).count())
    return out


def check_dates(analysis: Analysis, data: dict[str, DataFrame]) -> dict[str, Check]:
    out = {}
    for d in analysis.date_constraints:
        df = data.get(d.table_name)
        if df is not None and {d.low_column, d.high_column} <= set(df.columns):
            row = date_violations(df, d.low_column, d.high_column).first()
            out[f"{d.table_name}.{d.low_column}<={d.high_column}"] = Check(d.high_column, row["n_both"], row["n_violations"])
    return out


def check_row_counts(analysis: Analysis, data: dict[str, DataFrame], scale: float) -> dict[str, RowCount]:
    return {name: RowCount(expected_rows(t.row_count, scale), data[name].count()) for name, t in analysis.tables.items() if name in data}


def column_stats(analysis: Analysis, original: dict[str, DataFrame], synthetic: dict[str, DataFrame]) -> dict[str, dict[str, dict]]:
    """Per table and column (texts left out): the statistics of both sides."""
    out: dict[str, dict[str, dict]] = {}
    for name, t in analysis.tables.items():
        if name not in original or name not in synthetic:
            continue
        sides = {}
        for side, df in (("orig", original[name]), ("synth", synthetic[name])):
            columns = [c for c, m in t.columns.items() if m.role != Role.TEXT and c in original[name].columns and c in synthetic[name].columns]
            numbers = [c for c in columns if t.columns[c].sdtype == "numerical" or t.columns[c].role == Role.MEASURE]
            sides[side] = {r["column_name"]: r.asDict() for r in statistics(df, columns, numbers).collect()} if columns else {}
        out[name] = {c: {f"{side}_{k}": v for side in sides for k, v in sides[side][c].items() if k not in ("column_name", "n_rows")} for c in sides["orig"]}
    return out


def validate(analysis: Analysis, synthetic: dict[str, DataFrame], original: dict[str, DataFrame], scale: float = 1.0) -> Report:
    return Report(check_primary_keys(analysis, synthetic), check_foreign_keys(analysis, synthetic), check_dates(analysis, synthetic), check_row_counts(analysis, synthetic, scale), column_stats(analysis, original, synthetic))
