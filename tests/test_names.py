import logging

import pytest
from pyspark.sql import functions as F

from shadowset.functions import names as N


@pytest.mark.parametrize(("raw", "table", "column"), [("../../etc/passwd", "etc_passwd", ".._.._etc_passwd"), ("foo/bar", "foo_bar", "foo_bar"), ("a\x01b", "a_b", "a_b"), ("", "table", "column"), ("...", ".", "..."), ("__x__", "x", "x"), ('q"?*', "q", "q")])
def test_cleaning(spark, raw, table, column):
    assert (N.table_name(raw), N.column_name(raw)) == (table, column)
    assert tuple(spark.range(1).select(N.table_name_column(F.lit(raw)), N.column_name_column(F.lit(raw))).first()) == (table, column)


def test_distinct_names():
    assert N.distinct_columns(["a", "a", "b?", "b_", "a", "A"]) == ["a", "a_1", "b", "b_1", "a_2", "A"]
    assert N.distinct_table("t", {"t", "t_2"}) == "t_3" and N.distinct_table("u", {"t"}) == "u"


@pytest.mark.parametrize(("line", "clean"), [("read /home/ann/in/a.csv now", "read a.csv now"), (r"C:\Users\ann\b.csv, x", "b.csv, x"), ("mail a.b+c@mail.example.com", "mail [REDACTED_EMAIL]"), ("nothing", "nothing")])
def test_scrubbing(spark, line, clean):
    assert N.scrub(line) == clean
    assert spark.createDataFrame([(line,)], "v string").select(N.scrub_column(F.col("v"))).first()[0] == clean
    record = logging.LogRecord("x", 20, "", 0, "%s", (line,), None)
    assert N.ScrubbingFilter().filter(record) and record.getMessage() == clean


def test_folders(tmp_path):
    assert N.data_folder("") is None and N.data_folder("  ") is None
    for bad in ("/", "/etc", "/usr/share", "/tmp/x"):
        with pytest.raises(ValueError):
            N.data_folder(bad)
    assert str(N.data_folder("/root/data")) == "/root/data"
    (tmp_path / "link").symlink_to("/root")
    with pytest.raises(ValueError):
        N.data_folder(str(tmp_path / "link"))
