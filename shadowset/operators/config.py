"""Saved analyses: JSON out with samples redacted and paths shortened, JSON in with bad entries mended or left out, and merging with new data."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from pathlib import PureWindowsPath

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.models import Analysis, Column, DateOrder, DimensionGroup, Relationship, Role, Sensitivity, Table
from shadowset.operators.discover import analyze

log = logging.getLogger(__name__)
VERSION = "1.0"
REDACTED = "[REDACTED]"
_OPEN = ("", "None", "nan")


def redact(value: object) -> str:
    text = str(value)
    return text if text in _OPEN else REDACTED


def redact_column(value: Expr) -> Expr:
    text = F.coalesce(value.cast("string"), F.lit("None"))
    return F.when(text.isin(*_OPEN), text).otherwise(REDACTED)


def to_json(analysis: Analysis, settings: dict | None = None) -> str:
    def column(c: Column) -> dict:
        return asdict(c) | {"role": str(c.role), "sensitivity": str(c.sensitivity), "sample_values": [redact(v) for v in c.sample_values]}

    def table(t: Table) -> dict:
        return asdict(t) | {"file_path": PureWindowsPath(t.file_path).name, "columns": {k: column(c) for k, c in t.columns.items()}}

    data = {"version": VERSION, "tables": {k: table(t) for k, t in analysis.tables.items()}}
    data |= {k: [asdict(x) for x in getattr(analysis, k)] for k in ("relationships", "date_constraints", "dimension_groups")}
    return json.dumps(data | ({"settings": settings} if settings else {}), indent=2)


def _one_of(kind, value, default):
    try:
        return kind(value)
    except (ValueError, TypeError):
        return default


def _number(value, kind, low, high):
    try:
        return max(low, min(high, kind(value)))
    except (ValueError, TypeError, OverflowError):
        return low


def _listed(data: dict, key: str, make) -> list:
    out = []
    for entry in data.get(key) or []:
        try:
            out.append(make(entry))
        except (KeyError, TypeError, ValueError, AttributeError) as error:
            log.warning("an entry of %s was left out: %r", key, error)
    return out


def from_json(text: str) -> tuple[Analysis, dict]:
    """The analysis and its settings. Unknown roles become other, unknown sensitivities none, counts and ratios are clamped, incomplete entries are left out."""
    data = json.loads(text)

    def column(name: str, c: dict) -> Column:
        return Column(
            str(c.get("name", name)), str(c.get("sdtype", "unknown")), _one_of(Role, c.get("role"), Role.OTHER), bool(c.get("is_primary_key", False)), c.get("foreign_key_target"),
            _number(c.get("uniqueness_ratio", 0.0), float, 0.0, 1.0), c.get("datetime_format"), c.get("faker_override"), c.get("sample_values", []), _one_of(Sensitivity, c.get("sensitivity", "none"), Sensitivity.NONE),
        )

    tables = {}
    for name, t in data.get("tables", {}).items():
        columns = {k: column(k, c) for k, c in t.get("columns", {}).items()}
        tables[name] = Table(str(t.get("name", name)), str(t.get("file_path", "")), _number(t.get("row_count"), int, 0, 2**63 - 1), columns, t.get("primary_key"), str(t.get("relative_dir", "")))
    analysis = Analysis(
        tables,
        _listed(data, "relationships", lambda r: Relationship(*(str(r[k]) for k in ("parent_table", "parent_column", "child_table", "child_column")), float(r.get("overlap_ratio", 0.0)))),
        _listed(data, "date_constraints", lambda d: DateOrder(*(str(d[k]) for k in ("table_name", "low_column", "high_column")), bool(d.get("strict", False)), int(d.get("violation_count", 0)))),
        _listed(data, "dimension_groups", lambda g: DimensionGroup(str(g["table_name"]), [str(c) for c in g.get("column_names", [])], int(g.get("combination_count", 0)))),
    )
    return analysis, data.get("settings", {})


@dataclass
class Settings:
    """What is saved beside an analysis and given back."""

    scale: float = 1.0
    seed: int | None = None
    locale: str = "en_US"
    method: str = "auto"
    thresholds: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"scale": self.scale, "seed": self.seed, "locale": self.locale, "synthesis_method": self.method, **self.thresholds}

    @classmethod
    def from_dict(cls, d: dict) -> Settings:
        keys = ("pk_threshold", "fk_threshold", "dim_threshold")
        return cls(float(d.get("scale", 1.0)), d.get("seed"), d.get("locale", "en_US"), d.get("synthesis_method", "auto"), {k: d[k] for k in keys if k in d})


def merge(saved: Analysis, tables: dict[str, DataFrame], sources: dict[str, str] | None = None, relative_dirs: dict[str, str] | None = None, **thresholds) -> tuple[Analysis, dict[str, set[str]]]:
    """The saved analysis brought up to the loaded tables: new ones are analysed, missing ones go. Also which were matched, new and extra."""
    loaded, known = set(tables), set(saved.tables)
    parts = {"matched": loaded & known, "new": loaded - known, "extra": known - loaded}
    out = Analysis(dict(saved.tables), list(saved.relationships), list(saved.date_constraints), list(saved.dimension_groups))
    if parts["new"]:
        fresh = analyze(tables, sources, relative_dirs, **thresholds)
        out.tables |= {t: fresh.tables[t] for t in fresh.tables if t in parts["new"]}
        have = {r.edge for r in out.relationships}
        out.relationships += [r for r in fresh.relationships if r.edge not in have]
        out.date_constraints += [d for d in fresh.date_constraints if d.table_name in parts["new"]]
        out.dimension_groups += [g for g in fresh.dimension_groups if g.table_name in parts["new"]]
    out.tables = {t: m for t, m in out.tables.items() if t in loaded}
    out.relationships = [r for r in out.relationships if {r.parent_table, r.child_table} <= loaded]
    out.date_constraints = [d for d in out.date_constraints if d.table_name in loaded]
    out.dimension_groups = [g for g in out.dimension_groups if g.table_name in loaded]
    for t, m in out.tables.items():
        m.relative_dir = (relative_dirs or {}).get(t, "")
    return out, parts


def merge_frames(saved: DataFrame, loaded: DataFrame, keys: Iterable[str]) -> dict[str, DataFrame]:
    """The same on relational metadata: matched, new (only loaded) and extra (only saved) rows by keys."""
    keys = list(keys)
    a, b = saved.select(*keys).distinct(), loaded.select(*keys).distinct()
    return {"matched": a.intersect(b), "new": b.join(a, keys, "left_anti"), "extra": a.join(b, keys, "left_anti")}
