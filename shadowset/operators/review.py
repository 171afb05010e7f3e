"""Looking at and editing an analysis."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.models import SDTYPES, Analysis, DateOrder, DimensionGroup, Relationship, Role, Sensitivity
from shadowset.operators.validate import Report, is_missing


def overview(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Per table: rows, columns, references, dimensions and the key. columns, tables: of Analysis.to_dataframes."""
    counted = columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(F.col("role") == "foreign_key").alias("n_foreign_keys"),
        F.count_if(F.col("role") == "dimension").alias("n_dimensions"),
        F.max(F.when(F.col("is_primary_key"), F.col("column_name"))).alias("primary_key"),
    )
    return counted.join(tables.select("table_name", F.col("row_count").alias("n_rows")), "table_name")


def data_profile(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns and the mean share of missing values over the columns."""
    shares = [F.avg(is_missing(F.col(f"`{f.name}`"), f.dataType).cast("double")) for f in df.schema.fields]
    mean = sum(shares[1:], shares[0]) / len(shares) if shares else F.lit(0.0)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(shares)).cast("long").alias("n_columns"), F.coalesce(mean, F.lit(0.0)).alias("mean_null_ratio"))


def sensitive_columns(analysis: Analysis, table: str) -> dict[Sensitivity, list[str]]:
    return {level: [c.name for c in analysis.tables[table].columns.values() if c.sensitivity == level] for level in (Sensitivity.HIGH, Sensitivity.LOW)}


def reference_targets(analysis: Analysis, table: str) -> list[str]:
    return [f"{t.name}.{t.primary_key}" for t in analysis.tables.values() if t.name != table and t.primary_key]


def update_column(analysis: Analysis, table: str, column: str, **changes) -> None:
    """Change a column's sdtype, role, is_primary_key, foreign_key_target, faker_override or sensitivity. A new key replaces the old one; unsetting one leaves the table's key as it is."""
    t = analysis.tables[table]
    c = t.columns[column]
    if "sdtype" in changes and changes["sdtype"] not in SDTYPES:
        raise ValueError(f"unknown sdtype {changes['sdtype']}")
    for name, value in changes.items():
        if name not in ("sdtype", "role", "is_primary_key", "foreign_key_target", "faker_override", "sensitivity"):
            raise ValueError(f"{name} cannot be changed")
        setattr(c, name, Role(value) if name == "role" else Sensitivity(value) if name == "sensitivity" else value)
    if changes.get("is_primary_key"):
        for other in t.columns.values():
            other.is_primary_key = other.name == column
        t.primary_key = column


def visible_columns(analysis: Analysis, table: str, everything: bool = False) -> list[str]:
    linked = (Role.PRIMARY_KEY, Role.FOREIGN_KEY, Role.DIMENSION)
    return [c.name for c in analysis.tables[table].columns.values() if everything or c.is_primary_key or c.role in linked or c.sdtype == "id"]


def _mermaid(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]", "_", name) or "table"


def er_diagram(analysis: Analysis) -> str:
    """The relationships as a mermaid diagram; tables without one follow by name."""
    lines = ["erDiagram"] if analysis.tables else []
    lines += [f'    {_mermaid(r.parent_table)} ||--o{{ {_mermaid(r.child_table)} : "{r.parent_column} to {r.child_column}"' for r in analysis.relationships]
    linked = {t for r in analysis.relationships for t in (r.parent_table, r.child_table)}
    return "\n".join(lines + [f"    {_mermaid(t)}" for t in sorted(set(analysis.tables) - linked)])


def add_relationship(analysis: Analysis, parent: str, key: str, child: str, column: str) -> bool:
    """Link by hand. False for a link within a table or one that exists."""
    new = Relationship(parent, key, child, column)
    if parent == child or new.edge in {r.edge for r in analysis.relationships}:
        return False
    analysis.relationships.append(new)
    return True


def remove_relationship(analysis: Analysis, edge: tuple[str, str, str, str]) -> None:
    analysis.relationships = [r for r in analysis.relationships if r.edge != edge]


def set_edges(analysis: Analysis, edges: list[tuple[str, str, str, str]]) -> tuple[int, int]:
    """Make the relationships these edges: how many came and went."""
    before = len(analysis.relationships)
    analysis.relationships = [r for r in analysis.relationships if r.edge in set(edges)]
    gone = before - len(analysis.relationships)
    return sum(add_relationship(analysis, *e) for e in edges), gone


def edge_changes(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """The same on relational edges: added (without links within a table) and removed."""
    keys = ["parent_table", "parent_column", "child_table", "child_column"]
    proper = new.select(*keys).filter("parent_table <> child_table").distinct()
    return {"added": proper.join(old.select(*keys), keys, "left_anti"), "removed": old.select(*keys).join(new.select(*keys), keys, "left_anti")}


def date_columns(analysis: Analysis, table: str) -> list[str]:
    return [c.name for c in analysis.tables[table].columns.values() if c.role == Role.DATE or c.sdtype == "datetime"]


def add_date_order(analysis: Analysis, table: str, low: str, high: str) -> bool:
    if low == high or not {low, high} <= set(date_columns(analysis, table)) or any((d.table_name, d.low_column, d.high_column) == (table, low, high) for d in analysis.date_constraints):
        return False
    analysis.date_constraints.append(DateOrder(table, low, high))
    return True


def remove_date_order(analysis: Analysis, table: str, low: str, high: str) -> None:
    analysis.date_constraints = [d for d in analysis.date_constraints if (d.table_name, d.low_column, d.high_column) != (table, low, high)]


def add_dimension_group(analysis: Analysis, table: str, columns: list[str]) -> bool:
    if len(set(columns)) < 2 or not set(columns) <= set(analysis.tables[table].columns):
        return False
    analysis.dimension_groups.append(DimensionGroup(table, list(columns)))
    return True


def remove_dimension_group(analysis: Analysis, table: str, columns: list[str]) -> None:
    analysis.dimension_groups = [g for g in analysis.dimension_groups if (g.table_name, g.column_names) != (table, columns)]


def report_frames(spark, report: Report) -> dict[str, DataFrame]:
    """A validation report as DataFrames; statistics only of columns with a mean."""
    make = spark.createDataFrame
    checks = lambda part: make([(k, c.name, c.rows, c.bad, c.passed) for k, c in part.items()], "name string, column string, n_rows long, n_bad long, passed boolean")
    stats = [(t, c, s["orig_mean"], s["synth_mean"], s["orig_std"], s["synth_std"], s["orig_null_ratio"], s["synth_null_ratio"]) for t, cs in report.column_stats.items() for c, s in cs.items() if s["orig_mean"] is not None]
    return {
        "primary_keys": checks(report.primary_keys),
        "foreign_keys": checks(report.foreign_keys),
        "dates": checks(report.dates),
        "row_counts": make([(t, c.expected, c.actual, c.passed) for t, c in report.row_counts.items()], "name string, expected long, actual long, passed boolean"),
        "column_stats": make(stats, "table_name string, column_name string, orig_mean double, synth_mean double, orig_std double, synth_std double, orig_null_ratio double, synth_null_ratio double"),
    }
