import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from shadowset.plans.catalog import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = ("hma_sample", "per_table_sample", "validation_report", "copula_sample", "text_fill")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        where = f"{DATA}/{t}" if os.path.isfile(f"{DATA}/{t}") else f"{DATA}/{t}/*.parquet"
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{where}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, oracle, name):
    df, want = QUERIES[name](spark, DATA), oracle.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - set(SLOW)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_the_renamed_views_have_eight_references(spark):
    assert entry.entry(spark).filter("overlap_ratio = 1.0").count() == 8


def test_only_the_entry_point_knows_the_other_subpackage():
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for where, _, names in os.walk(f"{top}/shadowset"):
        if not where.endswith("/llm"):
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"\bllm\b|corpus_pipeline", open(f"{where}/{n}").read()), n
