"""Writing tables: workbooks, CSV files, an archive of workbooks, the manifest. Rows are streamed through the driver partition by partition."""

from __future__ import annotations

import datetime as dt
import io
import json
import logging
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shadowset.functions.names import safe_filename
from shadowset.models import Analysis
from shadowset.operators.validate import Report
from shadowset.sources import xlsx

log = logging.getLogger(__name__)


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, decimals as doubles."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    of = lambda f: F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
    return df.select(*(of(f).alias(f.name) for f in df.schema.fields))


def _target(folder: Path, name: str, relative: str, suffix: str) -> Path | None:
    """Where a table goes; None for places outside the folder."""
    top = folder.resolve()
    path = (top / relative / f"{safe_filename(name)}{suffix}").resolve()
    if ".." in relative or not path.is_relative_to(top):
        log.warning("%s is not written: it would leave the folder", name)
        return None
    return path


def write_workbooks(tables: dict[str, DataFrame], folder: str | Path, relative_dirs: dict[str, str] | None = None) -> list[Path]:
    out = []
    for name, df in tables.items():
        if path := _target(Path(folder), name, (relative_dirs or {}).get(name, ""), ".xlsx"):
            path.parent.mkdir(parents=True, exist_ok=True)
            xlsx.write(str(path), df.columns, _flat(df).toLocalIterator())
            out.append(path)
    return out


def write_csvs(tables: dict[str, DataFrame], folder: str | Path, relative_dirs: dict[str, str] | None = None) -> list[Path]:
    """One CSV file a table. For large tables use df.write.csv, which writes in parallel."""
    import csv

    out = []
    for name, df in tables.items():
        if path := _target(Path(folder), name, (relative_dirs or {}).get(name, ""), ".csv"):
            path.parent.mkdir(parents=True, exist_ok=True)
            with path.open("w", newline="", encoding="utf-8") as f:
                sheet = csv.writer(f)
                sheet.writerow(df.columns)
                sheet.writerows(_flat(df).toLocalIterator())
            out.append(path)
    return out


def workbook_buffer(df: DataFrame) -> io.BytesIO:
    buffer = io.BytesIO()
    xlsx.write(buffer, df.columns, _flat(df).toLocalIterator())
    buffer.seek(0)
    return buffer


def manifest(tables: dict[str, DataFrame], analysis: Analysis | None = None, scale: float | None = None, seed: int | None = None) -> dict:
    rows = {t: df.count() for t, df in tables.items()}
    known = analysis.tables if analysis else {}
    out: dict = {
        "generated_at": dt.datetime.now(dt.UTC).isoformat(),
        "tables": {t: {"rows": rows[t], "columns": len(df.columns)} | ({"original_rows": known[t].row_count} if t in known else {}) for t, df in tables.items()},
        "total_synthetic_rows": sum(rows.values()),
    }
    out |= {k: v for k, v in (("scale_factor", scale), ("seed", seed)) if v is not None}
    if analysis:
        out["relationships"] = [{"parent": f"{r.parent_table}.{r.parent_column}", "child": f"{r.child_table}.{r.child_column}"} for r in analysis.relationships]
        out["date_constraints"] = [{"table": d.table_name, "low": d.low_column, "high": d.high_column} for d in analysis.date_constraints]
        out["dimension_groups"] = [{"table": g.table_name, "columns": g.column_names} for g in analysis.dimension_groups]
    return out


def archive_buffer(tables: dict[str, DataFrame], relative_dirs: dict[str, str] | None = None, contents: dict | None = None) -> io.BytesIO:
    """A ZIP of workbooks and, if given, the manifest."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            where = (relative_dirs or {}).get(name, "")
            if ".." in where:
                log.warning("%s is not archived: its folder leads upwards", name)
                continue
            z.writestr("/".join(filter(None, (where, f"{safe_filename(name)}.xlsx"))), workbook_buffer(df).getvalue())
        if contents:
            z.writestr("manifest.json", json.dumps(contents, indent=2))
    buffer.seek(0)
    return buffer


def report_json(report: Report) -> str:
    return json.dumps(report.to_json(), indent=2)
