"""What is known about tables: plain records on the driver, with a relational form for queries."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession


# The names that saved analyses use for roles, sensitivities, semantic types and methods, and the records' fields.
class Role(StrEnum):
    PRIMARY_KEY = "primary_key"
    FOREIGN_KEY = "foreign_key"
    DIMENSION = "dimension"
    MEASURE = "measure"
    TEXT = "text"
    DATE = "date"
    OTHER = "other"


class Sensitivity(StrEnum):
    NONE = "none"
    LOW = "low"
    HIGH = "high"


SDTYPES = ("id", "numerical", "datetime", "categorical", "boolean", "unknown")
METHODS = ("auto", "hma", "per_table")


@dataclass
class Column:
    name: str
    sdtype: str = "unknown"
    role: Role = Role.OTHER
    is_primary_key: bool = False
    foreign_key_target: str | None = None
    uniqueness_ratio: float = 0.0
    datetime_format: str | None = None
    faker_override: str | None = None
    sample_values: list = field(default_factory=list)
    sensitivity: Sensitivity = Sensitivity.NONE


@dataclass
class Table:
    name: str
    file_path: str = ""
    row_count: int = 0
    columns: dict[str, Column] = field(default_factory=dict)
    primary_key: str | None = None
    relative_dir: str = ""


@dataclass
class Relationship:
    parent_table: str
    parent_column: str
    child_table: str
    child_column: str
    overlap_ratio: float = 0.0

    @property
    def edge(self) -> tuple[str, str, str, str]:
        return self.parent_table, self.parent_column, self.child_table, self.child_column


@dataclass
class DateOrder:
    table_name: str
    low_column: str
    high_column: str
    strict: bool = False
    violation_count: int = 0


@dataclass
class DimensionGroup:
    table_name: str
    column_names: list[str]
    combination_count: int = 0


@dataclass
class Analysis:
    tables: dict[str, Table] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)
    date_constraints: list[DateOrder] = field(default_factory=list)
    dimension_groups: list[DimensionGroup] = field(default_factory=list)

    def columns_with(self, table: str, role: Role) -> list[str]:
        return [c.name for c in self.tables[table].columns.values() if c.role == role]

    def to_dataframes(self, spark: SparkSession) -> dict[str, DataFrame]:
        """tables, columns, relationships, date_constraints and dimension_groups as DataFrames."""
        tables = [(t.name, t.file_path, t.row_count, t.primary_key, t.relative_dir) for t in self.tables.values()]
        columns = [
            (t.name, i, c.name, c.sdtype, str(c.role), c.is_primary_key, c.foreign_key_target, float(c.uniqueness_ratio), c.datetime_format, c.faker_override, str(c.sensitivity))
            for t in self.tables.values()
            for i, c in enumerate(t.columns.values())
        ]
        make = spark.createDataFrame
        return {
            "tables": make(tables, "table_name string, file_path string, row_count long, primary_key string, relative_dir string"),
            "columns": make(columns, "table_name string, ordinal int, column_name string, sdtype string, role string, is_primary_key boolean, foreign_key_target string, uniqueness_ratio double, datetime_format string, faker_override string, sensitivity string"),
            "relationships": make([tuple(asdict(r).values()) for r in self.relationships], "parent_table string, parent_column string, child_table string, child_column string, overlap_ratio double"),
            "date_constraints": make([tuple(asdict(d).values()) for d in self.date_constraints], "table_name string, low_column string, high_column string, strict boolean, violation_count long"),
            "dimension_groups": make([tuple(asdict(g).values()) for g in self.dimension_groups], "table_name string, column_names array<string>, combination_count long"),
        }
