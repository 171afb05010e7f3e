import datetime as dt
import io
import json
import zipfile

import pytest

from shadowset.models import Analysis, Column, DateOrder, DimensionGroup, Relationship, Role, Table
from shadowset.operators import config, review
from shadowset.operators.validate import Check, Report
from shadowset.sources import files, multiline, sinks, xlsx


def folder(path):
    (path / "sub" / "deep").mkdir(parents=True)
    (path / "a.csv").write_text("id,name?,when\n1,\"x, y\",2024-01-02\n2,z,2024-01-03\n")
    (path / "sub" / "a.tsv").write_text("id\tok\n1\ttrue\n")
    (path / "sub" / "deep" / "empty.csv").write_text("id,x\n")
    (path / "notes.txt").write_text("no")
    xlsx.write(str(path / "book.xlsx"), ["k", "v", "at", "b"], [(1, 1.5, dt.datetime(2024, 1, 2, 3, 4, 5), True), (2, None, None, False)])
    (path / "broken.xlsx").write_text("no workbook")
    return path


def test_load_all(spark, tmp_path):
    got = files.load_all(spark, folder(tmp_path))
    assert set(got.tables) == {"a", "a_2", "book"} and got.relative_dirs == {"a": "", "a_2": "sub", "book": ""}
    assert got.tables["a"].dtypes == [("id", "bigint"), ("name", "string"), ("when", "string")]
    assert got.tables["a"].orderBy("id").first()["name"] == "x, y"
    assert got.tables["a_2"].dtypes == [("id", "bigint"), ("ok", "boolean")]
    rows = got.tables["book"].orderBy("k").collect()
    assert (rows[0].k, rows[0].v, rows[0]["at"], rows[0].b) == (1, 1.5, dt.datetime(2024, 1, 2, 3, 4, 5), True) and rows[1].v is None


@pytest.mark.parametrize("text, by_lines, rows", [
    ('id,t\n1,"a ""b"", c"\n\n2,d\n', True, [(1, 'a "b", c'), (2, "d")]),
    ('id,t\n1,"a\n\nb, c"\n2,d\n', False, [(1, "a\n\nb, c"), (2, "d")]),
    ('id,t\n1,5" pipe\n2,d\n', False, [(1, '5" pipe'), (2, "d")]),
])
def test_rows_over_several_lines(spark, tmp_path, text, by_lines, rows):
    path = tmp_path / "t.csv"
    path.write_text(text)
    assert files._one_row_a_line(spark, path.as_uri()) == by_lines
    assert sorted(map(tuple, files.load_csv(spark, path)["t"].collect())) == rows


@pytest.mark.parametrize("size", [40, 150, 1000, 1 << 20])
def test_rows_over_several_lines_by_many_tasks(spark, tmp_path, size):
    """Whatever the byte ranges, the rows are those that one task reads; values hold line ends, quotes, separators and blank lines."""
    import csv
    import random

    rnd = random.Random(size)
    word = lambda: rnd.choice(["plain", "a,b", 'say ""x""', "two\nlines", "\n\n", "x\n" * 60, "", "é😀\n,\"\n", "7"])
    rows = [(i, word(), rnd.choice(["1.5", "2", ""]), rnd.choice(["true", "false"]), word()) for i in range(150)]
    path = tmp_path / "many.csv"
    with path.open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("id", "t", "v", "ok", "last\nname"), *rows])
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        lines = multiline.logical_rows(spark, path.as_uri())
        assert lines.select("block").distinct().count() > (1 if size < 2000 else 0)
        got = files.load_csv(spark, path)["many"]
        assert got.dtypes == [("id", "bigint"), ("t", "string"), ("v", "double"), ("ok", "boolean"), ("last\nname", "string")]
        plain = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path.as_uri())
        text = lambda df: sorted(str([None if v is None else str(v) for v in r]) for r in df.select("id", "t", "last\nname").collect())
        assert text(got) == text(plain) and got.count() == len(rows)
        assert got.agg({"v": "sum"}).first()[0] == sum(float(r[2] or 0) for r in rows)
    finally:
        for k in keys:
            spark.conf.unset(k)


@pytest.mark.parametrize("size", [40, 150, 1000, 1 << 20])
def test_rows_over_several_lines_by_many_tasks(spark, tmp_path, size):
    """Whatever the byte ranges, the rows are those that one task reads; values hold line ends, quotes, separators and blank lines."""
    import csv
    import random

    rnd = random.Random(size)
    word = lambda: rnd.choice(["plain", "a,b", 'say ""x""', "two\nlines", "\n\n", "x\n" * 60, "", "é😀\n,\"\n", "7"])
    rows = [(i, word(), rnd.choice(["1.5", "2", ""]), rnd.choice(["true", "false"]), word()) for i in range(150)]
    path = tmp_path / "many.csv"
    with path.open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("id", "t", "v", "ok", "last\nname"), *rows])
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        lines = multiline.logical_rows(spark, path.as_uri())
        assert lines.select("block").distinct().count() > (1 if size < 2000 else 0)
        got = files.load_csv(spark, path)["many"]
        assert got.dtypes == [("id", "bigint"), ("t", "string"), ("v", "double"), ("ok", "boolean"), ("last\nname", "string")]
        plain = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path.as_uri())
        text = lambda df: sorted(str([None if v is None else str(v) for v in r]) for r in df.select("id", "t", "last\nname").collect())
        assert text(got) == text(plain) and got.count() == len(rows)
        assert got.agg({"v": "sum"}).first()[0] == sum(float(r[2] or 0) for r in rows)
    finally:
        for k in keys:
            spark.conf.unset(k)


@pytest.mark.parametrize("size", [40, 150, 1000, 1 << 20])
def test_rows_over_several_lines_by_many_tasks(spark, tmp_path, size):
    """Whatever the byte ranges, the rows are those that one task reads; values hold line ends, quotes, separators and blank lines."""
    import csv
    import random

    rnd = random.Random(size)
    word = lambda: rnd.choice(["plain", "a,b", 'say ""x""', "two\nlines", "\n\n", "x\n" * 60, "", "é😀\n,\"\n", "7"])
    rows = [(i, word(), rnd.choice(["1.5", "2", ""]), rnd.choice(["true", "false"]), word()) for i in range(150)]
    path = tmp_path / "many.csv"
    with path.open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("id", "t", "v", "ok", "last\nname"), *rows])
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        lines = multiline.logical_rows(spark, path.as_uri())
        assert lines.select("block").distinct().count() > (1 if size < 2000 else 0)
        got = files.load_csv(spark, path)["many"]
        assert got.dtypes == [("id", "bigint"), ("t", "string"), ("v", "double"), ("ok", "boolean"), ("last\nname", "string")]
        plain = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path.as_uri())
        text = lambda df: sorted(str([None if v is None else str(v) for v in r]) for r in df.select("id", "t", "last\nname").collect())
        assert text(got) == text(plain) and got.count() == len(rows)
        assert got.agg({"v": "sum"}).first()[0] == sum(float(r[2] or 0) for r in rows)
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_discovery_limits(tmp_path):
    with pytest.raises(FileNotFoundError):
        files.discover(tmp_path / "none")
    with pytest.raises(ValueError):
        files.discover(tmp_path)
    folder(tmp_path)
    assert [p.name for p in files.discover(tmp_path)] == ["a.csv", "book.xlsx", "broken.xlsx", "a.tsv", "empty.csv"]
    assert len(files.discover(tmp_path, files.Limits(max_depth=1))) == 4
    with pytest.raises(ValueError):
        files.discover(tmp_path, files.Limits(max_files=2))
    with pytest.raises(TimeoutError):
        files.discover(tmp_path, files.Limits(discovery_timeout=-1))


def test_sizes(spark, tmp_path, monkeypatch):
    folder(tmp_path)
    with pytest.raises(ValueError):
        files.load_all(spark, tmp_path, files.Limits(max_total_mb=0))
    with pytest.raises(ValueError):
        files.load_all(spark, tmp_path, files.Limits(max_file_mb=0))
    monkeypatch.setenv("SHADOWSET_MAX_FILES", "7")
    assert files.Limits().max_files == 7


def test_workbook_round_trip():
    buffer = io.BytesIO()
    rows = [("ünï <&>\n", 2**40, -1.25, dt.date(2020, 2, 29), None), ("", 0, 1e-9, dt.date(1999, 1, 1), True)]
    xlsx.write(buffer, ["s", "i", "f", "d", "b"], rows, "My sheet")
    book = xlsx.Workbook(buffer)
    head, *got = book.rows("My sheet")
    assert head == ["s", "i", "f", "d", "b"] and got[0][:3] == list(rows[0][:3]) and got[0][3] == dt.datetime(2020, 2, 29) and got[1][4] is True


def analysis():
    return Analysis(
        {"p": Table("p", "/home/ann/in/p.csv", 3, {"id": Column("id", "id", Role.PRIMARY_KEY, True, sample_values=[1, None, float("nan"), ""])}, "id", "sub"), "c": Table("c", "x", 2, {"p_id": Column("p_id", "id", Role.FOREIGN_KEY, foreign_key_target="p.id"), "a": Column("a", "datetime", Role.DATE), "b": Column("b", "datetime", Role.DATE)})},
        [Relationship("p", "id", "c", "p_id", 1.0)], [DateOrder("c", "a", "b", False, 1)], [DimensionGroup("c", ["a", "b"], 4)],
    )


def test_config_round_trip():
    text = config.to_json(analysis(), {"scale": 2.0, "seed": 3, "synthesis_method": "hma"})
    assert "/home" not in text and json.loads(text)["tables"]["p"]["columns"]["id"]["sample_values"] == ["[REDACTED]", "None", "nan", ""]
    back, settings = config.from_json(text)
    assert back.relationships == analysis().relationships and back.date_constraints == analysis().date_constraints and back.tables["p"].file_path == "p.csv"
    assert config.Settings.from_dict(settings).method == "hma" and config.Settings.from_dict(settings).scale == 2.0


def test_bad_configs():
    bad = {"tables": {"t": {"row_count": -999, "columns": {"c": {"role": "boss", "uniqueness_ratio": 99.9, "sensitivity": "x", "more": 1}}}, "u": {"row_count": "x"}}, "relationships": [{"parent_table": "t"}, 5], "date_constraints": [{}], "dimension_groups": [{"column_names": ["a"]}]}
    a, settings = config.from_json(json.dumps(bad))
    c = a.tables["t"].columns["c"]
    assert (a.tables["t"].row_count, a.tables["u"].row_count, c.role, c.uniqueness_ratio, str(c.sensitivity)) == (0, 0, Role.OTHER, 1.0, "none")
    assert not a.relationships and not a.date_constraints and not a.dimension_groups and settings == {}


def test_merge(spark):
    tables = {"p": spark.range(3), "n": spark.createDataFrame([(1, 0), (2, 1)], "n_id long, p_id long")}
    out, parts = config.merge(analysis(), tables, relative_dirs={"n": "q"})
    assert parts == {"matched": {"p"}, "new": {"n"}, "extra": {"c"}} and set(out.tables) == {"p", "n"}
    assert [r.edge for r in out.relationships] == [("p", "id", "n", "p_id")] and not out.date_constraints and out.tables["n"].relative_dir == "q"


def test_sinks(spark, tmp_path):
    tables = {"t": spark.createDataFrame([(1, [1.5], "x")], "a long, v array<double>, s string"), "../evil": spark.range(1), "up": spark.range(1)}
    dirs = {"t": "sub", "up": "../.."}
    assert [p.relative_to(tmp_path).as_posix() for p in sinks.write_workbooks(tables, tmp_path, dirs)] == ["sub/t.xlsx", "evil.xlsx"]
    assert (tmp_path / "sub" / "t.xlsx").exists()
    (one, _) = sinks.write_csvs(tables, tmp_path, dirs)
    assert one.read_text().splitlines() == ["a,v,s", "1,[1.5],x"]
    m = sinks.manifest(tables, analysis(), 0.5, None)
    assert m["total_synthetic_rows"] == 3 and m["scale_factor"] == 0.5 and "seed" not in m and m["relationships"] == [{"parent": "p.id", "child": "c.p_id"}]
    with zipfile.ZipFile(sinks.archive_buffer(tables, dirs, m)) as z:
        assert set(z.namelist()) == {"sub/t.xlsx", "evil.xlsx", "manifest.json"}
        assert list(xlsx.Workbook(io.BytesIO(z.read("sub/t.xlsx"))).rows("Sheet1"))[1] == [1, "[1.5]", "x"]


def test_review(spark):
    a = analysis()
    assert review.reference_targets(a, "c") == ["p.id"] and review.visible_columns(a, "c") == ["p_id"]
    assert review.er_diagram(a).splitlines() == ["erDiagram", '    p ||--o{ c : "id to p_id"']
    review.update_column(a, "c", "a", is_primary_key=True, role="other")
    assert a.tables["c"].primary_key == "a"
    for wrong in ({"sdtype": "zzz"}, {"role": "zzz"}, {"name": "x"}):
        with pytest.raises(ValueError):
            review.update_column(a, "c", "a", **wrong)
    assert not review.add_relationship(a, "p", "id", "p", "id") and not review.add_relationship(a, "p", "id", "c", "p_id")
    assert review.set_edges(a, [("c", "a", "p", "id")]) == (1, 1)
    assert not review.add_date_order(a, "c", "a", "a") and not review.add_date_order(a, "c", "a", "b") and review.add_date_order(a, "c", "b", "a")
    assert review.add_dimension_group(a, "c", ["a", "b"]) and not review.add_dimension_group(a, "c", ["a"])
    frames = review.report_frames(spark, Report(primary_keys={"p": Check("id", 3, 0)}, column_stats={"p": {"id": {"orig_mean": None}}}))
    assert frames["primary_keys"].first().passed and frames["column_stats"].count() == 0
    assert json.loads(sinks.report_json(Report()))["all_passed"]


def test_stream_gives_the_batch_result(spark):
    from shadowset.streaming.checks import stream_orphans

    parents = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").filter("c_custkey % 10 <> 0")
    assert stream_orphans(spark, "/root/testdata/sf0.001/orders.parquet", "o_custkey", parents, "c_custkey").count() == 161
