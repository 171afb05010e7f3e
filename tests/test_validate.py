import math

from pyspark.sql import functions as F

from shadowset.models import Analysis, Column, DateOrder, Relationship, Role, Table
from shadowset.operators import validate


def setup(spark):
    parent = spark.createDataFrame([(10,), (20,), (None,)], "id long")
    child = spark.createDataFrame([(1, 10, 1.0), (1, 99, 2.0), (3, None, None)], "c_id long, p_id long, v double")
    t = lambda name, key, rows, **kinds: Table(name, "", rows, {c: Column(c, "numerical" if r == Role.MEASURE else "id", r) for c, r in kinds.items()}, key)
    a = Analysis({"p": t("p", "id", 100, id=Role.PRIMARY_KEY), "c": t("c", "c_id", 3, c_id=Role.PRIMARY_KEY, p_id=Role.FOREIGN_KEY, v=Role.MEASURE)}, [Relationship("p", "id", "c", "p_id")])
    return a, {"p": parent, "c": child}


def test_report(spark):
    a, data = setup(spark)
    r = validate.validate(a, data, data, 0.29)
    assert r.primary_keys["c"].bad == 1 and r.primary_keys["p"].bad == 1  # NULL counts as a duplicate
    assert r.foreign_keys["c.p_id->p.id"].bad == 1 and not r.all_passed
    assert r.row_counts["p"].expected == 28 and r.row_counts["c"].expected == 1
    s = r.column_stats["c"]["v"]
    assert s["orig_mean"] == 1.5 and s["orig_null_ratio"] == 1 / 3 and math.isclose(s["synth_std"], 0.5**0.5)
    assert any(x.startswith("[FAIL] FK") for x in r.summary()) and r.to_json()["all_passed"] is False


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-02"), (None, "2024-01-02")], "a string, b string").select(F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    a = Analysis(date_constraints=[DateOrder("t", "a", "b")])
    assert validate.check_dates(a, {"t": df})["t.a<=b"].bad == 1


def test_statistics_of_odd_numbers(spark):
    df = spark.createDataFrame([(float("nan"), "1", 1.0), (2.0, "x", float("inf")), (4.0, None, 1.0)], "a double, b string, c double")
    got = {r["column_name"]: r for r in validate.statistics(df, ["a", "b", "c"], ["a", "b", "c"]).collect()}
    assert got["a"]["mean"] == 3.0 and got["a"]["null_ratio"] == 1 / 3
    assert got["b"]["mean"] == 1.0 and got["b"]["std"] is None
    assert got["c"]["mean"] is None and got["c"]["min"] == 1.0 and got["c"]["max"] is None
    one = validate.statistics(df.limit(0), ["a"], ["a"]).first()
    assert one["null_ratio"] == 0.0 and one["mean"] is None
