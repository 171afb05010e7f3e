import pytest
from pyspark.sql import functions as F

from shadowset.models import Role, Sensitivity
from shadowset.operators import discover
from shadowset.operators.profile import profile


@pytest.fixture(scope="module")
def shop(spark):
    customers = spark.createDataFrame([(1, "Ann", "North", "US", "a@x"), (2, "Bob", "South", "UK", "b@x"), (3, "Cid", "North", "US", "c@x"), (4, "Dee", "South", "UK", "d@x"), (5, "Eve", "North", "US", "e@x")], "customer_id long, name string, region string, country string, email string")
    orders = spark.createDataFrame([(101 + i, c, f"2024-01-{i + 10}", f"2024-01-{i + 14}", 100.0 + i) for i, c in enumerate((1, 1, 2, 3, 3, 3, 4, 5))], "order_id long, customer_id long, order_date string, ship_date string, amount double")
    return {"customers": customers, "orders": orders}


def test_shop(shop):
    a = discover.analyze(shop)
    assert {t: m.primary_key for t, m in a.tables.items()} == {"customers": "customer_id", "orders": "order_id"}
    (r,) = a.relationships
    assert r.edge == ("customers", "customer_id", "orders", "customer_id") and r.overlap_ratio == 1.0
    (g,) = a.dimension_groups
    assert g.column_names == ["region", "country"] and g.combination_count == 2
    (d,) = a.date_constraints
    assert (d.low_column, d.high_column, d.violation_count) == ("order_date", "ship_date", 0)
    roles = {c.name: c.role for c in a.tables["orders"].columns.values()}
    assert roles == {"order_id": Role.PRIMARY_KEY, "customer_id": Role.FOREIGN_KEY, "order_date": Role.TEXT, "ship_date": Role.TEXT, "amount": Role.MEASURE}
    assert a.tables["orders"].columns["customer_id"].foreign_key_target == "customers.customer_id"
    dated = discover.analyze(shop, parse_string_dates=True).tables["orders"].columns["order_date"]
    assert dated.role == Role.DATE and dated.sdtype == "datetime"


@pytest.mark.parametrize(("rows", "schema", "want"), [([], "id long", []), ([(i,) for i in range(5)], "code long", ["code"]), ([(1,), (2,), (None,), (4,)], "item_id long", []), ([(1,), (1,), (2,)], "category_id long", []), ([(i if i < 96 else 95,) for i in range(100)], "part_id long", ["part_id"])])
def test_primary_keys(spark, rows, schema, want):
    assert [c for c, _ in discover.primary_keys(spark.createDataFrame(rows, schema))] == want


def test_key_order(spark):
    df = spark.createDataFrame([(i, i // 1, f"k{min(i, 38)}") for i in range(40)], "b_id long, paid long, a_code string")
    assert [c for c, _ in discover.primary_keys(df)] == ["b_id", "paid", "a_code"]


@pytest.mark.parametrize(("child", "parent", "kinds", "found"), [([1.0, 2.0], [1, 2], ("double", "long"), True), (["1", "2"], [1, 2], ("string", "long"), True), (["1.0", "2.0"], [1.0, 2.0], ("string", "double"), True), ([True, False], ["True", "False"], ("boolean", "string"), True), (["x"], [1], ("string", "long"), False), ([None], [1], ("long", "long"), False), ([1, 2, 3, 4, 9], [1, 2, 3, 4], ("long", "long"), True), ([1, 2, 3, 8, 9], [1, 2, 3, 4], ("long", "long"), False)])
def test_foreign_keys(spark, child, parent, kinds, found):
    c = spark.createDataFrame([(v,) for v in child], f"p_id {kinds[0]}")
    p = spark.createDataFrame([(v,) for v in parent], f"id {kinds[1]}")
    assert bool(discover.foreign_keys({"c": c, "p": p}, {"p": "id"})) == found


def test_own_key_and_own_table_refer_to_nothing():
    assert discover.fk_candidates({"a": ["id", "b_id"], "b": ["id", "a_id", "ID"]}, {"a": "id", "b": "id"}) == [("a", "b_id", "b", "id"), ("b", "a_id", "a", "id")]


def test_nulls_are_a_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), (None, None)], "p string, q string")
    known = profile(df)
    assert known["p"].distinct_values == 2 and known["p"].nulls == 2
    assert df.agg(discover._distinct(["p", "q"])).first()[0] == 4


@pytest.mark.parametrize(("rows", "limit"), [(49, 0.5), (50, 0.15), (199, 0.15), (200, 0.05)])
def test_limits(rows, limit):
    assert discover.dimension_limit(rows) == limit


def test_groups_close_over_chains(spark):
    df = spark.range(400).select((F.col("id") % 8).cast("string").alias("a"), (F.col("id") % 4).cast("string").alias("b"), (F.col("id") % 2).cast("string").alias("c"), (F.floor(F.col("id") / 80)).cast("string").alias("d"))
    groups = discover.dimension_groups("t", df, ["a", "b", "c", "d"])
    assert [(g.column_names, g.combination_count) for g in groups] == [(["a", "b", "c"], 8)]


def test_date_tolerance(spark):
    def frame(bad):
        return spark.range(100).select(F.lit("2024-01-05").cast("date").alias("a"), F.when(F.col("id") < bad, F.lit("2024-01-01")).otherwise("2024-01-09").cast("date").alias("b"))

    assert [d.violation_count for d in discover.date_orders("t", frame(2))] == [2]
    assert discover.date_orders("t", frame(3)) == []
    mixed = spark.createDataFrame([("x",)], "due_date string").withColumn("at", F.current_timestamp())
    assert discover.date_orders("t", mixed) == []


def test_types_without_rules(spark):
    df = spark.createDataFrame([([1.0],), ([2.0],)], "v array<float>").withColumn("m", F.create_map(F.lit("a"), F.col("v"))).withColumn("d", F.lit(1).cast("decimal(5,2)")).withColumn("b", F.lit(True))
    columns = discover.analyze({"t": df}).tables["t"].columns
    assert {c: (columns[c].sdtype, columns[c].role) for c in "mdb"} == {"m": ("categorical", Role.OTHER), "d": ("categorical", Role.OTHER), "b": ("boolean", Role.OTHER)}


def test_relational_form(spark, shop):
    frames = discover.analyze(shop).to_dataframes(spark)
    assert {k: v.count() for k, v in frames.items()} == {"tables": 2, "columns": 10, "relationships": 1, "date_constraints": 1, "dimension_groups": 1}


@pytest.mark.parametrize(("name", "level"), [("SSN", "high"), ("rating", "high"), ("credit card", "high"), ("email", "low"), ("first_name", "low"), ("phone_number", "low"), ("table_name", "none"), ("amount", "none"), ("home zip", "low"), ("emailed", "none")])
def test_sensitivity(spark, name, level):
    from shadowset.functions.names import sensitivity, sensitivity_column

    assert sensitivity(name) == Sensitivity(level)
    assert spark.range(1).select(sensitivity_column(F.lit(name))).first()[0] == level


def test_shared_values_are_those_of_sets(spark):
    """More attributes than a word has bits, of many types, against Python's sets."""
    import itertools
    import random

    rnd = random.Random(4)
    kinds = {"long": lambda: rnd.randint(0, 30), "double": lambda: rnd.choice([1.0, 2.0, 2.5, 7.0, -0.0, 0.0]), "string": lambda: str(rnd.randint(0, 12)), "boolean": lambda: rnd.random() < 0.5}
    tables, values = {}, {}
    for t in range(7):
        names = [f"c{i} {k}" for i, k in enumerate(rnd.choices(list(kinds), k=10))]
        rows = [tuple(None if rnd.random() < 0.1 else kinds[n.split()[1]]() for n in names) for _ in range(25)]
        tables[f"t{t}"] = spark.createDataFrame(rows, ", ".join(names)).repartition(3)
        for i, n in enumerate(names):
            values[f"t{t}", n.split()[0]] = {r[i] for r in rows} - {None}
    attributes = list(values)
    got = discover.shared_values(tables, attributes)
    for (i, a), (j, b) in itertools.product(enumerate(attributes), repeat=2):
        assert got.get((i, j, False), 0) == len(values[a] & values[b]), (a, b)


def test_unnamed_references(spark):
    parent = spark.range(50).select(F.col("id").alias("p_id"))
    child = spark.range(200).select((F.col("id") % 40).alias("owner"), (F.col("id") + 1000).alias("other"), (F.col("id") % 40).cast("string").alias("text"))
    tables = {"p": parent, "c": child}
    assert discover.foreign_keys(tables, {"p": "p_id"}) == []
    assert [r.edge for r in discover.foreign_keys(tables, {"p": "p_id"}, unnamed=True)] == [("p", "p_id", "c", "owner")]


def test_references_read_each_table_once(spark, tmp_path):
    for t, c in (("p", "id"), ("q", "id"), ("c", "p_id")):
        spark.range(100).select(F.col("id").alias(c), F.col("id").alias("q_id")).write.parquet(str(tmp_path / t))
    tables = {t: spark.read.parquet(str(tmp_path / t)) for t in ("p", "q", "c")}
    tracker, seen = spark.sparkContext.statusTracker(), []
    spark.sparkContext.setJobGroup("references", "references")
    found = discover.foreign_keys(tables, {"p": "id", "q": "id"})
    seen = tracker.getJobIdsForGroup("references")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.edge for r in found} == {("p", "id", "c", "p_id"), ("q", "id", "c", "q_id"), ("q", "id", "p", "q_id"), ("p", "id", "q", "id")} - {("p", "id", "q", "id")}
    stages = {s for j in seen for s in tracker.getJobInfo(j).stageIds}
    assert len(stages) <= 3 + 3 * len(seen)


def test_a_profile_that_grows_equals_the_full_one(spark):
    from shadowset.operators import profile as P

    df = spark.range(300).select((F.col("id") % 70).alias("k"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("v"), F.col("id") % 40)).alias("s"), F.when(F.col("id") < 10, F.lit(None)).otherwise(F.array("id")).alias("a"), F.create_map(F.lit("x"), F.col("id") % 3).alias("m"))
    parts = [df.filter("k < 20"), df.filter("k between 20 and 50"), df.filter("k > 50"), df.limit(0)]
    whole = profile(df)
    assert P.profile_of_state(P.merged(*map(P.state, parts)), df.schema) == whole == P.profile_of_state(P.state(df), df.schema)
    again = P.merged(P.merged(*map(P.state, parts[:2])), P.state(parts[2]))
    assert P.profile_of_state(again, df.schema) == whole
    none = P.profile_of_state(P.state(df.limit(0)), df.schema)
    assert none["s"].rows == 0 and none["s"].ratio == 0.0 and whole["s"].distinct_known == df.select("s").distinct().count() - 1


def test_sketches_grow_and_groups_are_exact(spark):
    from shadowset.operators import profile as P

    df = spark.range(6000).select((F.col("id") % 60).cast("string").alias("city"), (F.col("id") % 60 % 7).cast("string").alias("land"), (F.col("id") % 11).cast("string").alias("day"), F.when(F.col("id") % 60 > 3, (F.col("id") % 60 % 7).cast("string")).alias("holed"))
    columns = df.columns
    groups = discover.dimension_groups("t", df, columns)
    assert [(g.column_names, g.combination_count) for g in groups] == [(["city", "land", "holed"], 60)]
    sets = [(c,) for c in columns] + [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    kept = P.merged_sketches(P.sketches(df.filter("id < 2000") if "id" in df.columns else df.filter("day < 5"), sets), P.sketches(df.filter("day >= 5"), sets))
    assert discover.dimension_groups("t", df, columns, kept) == groups
    exact = P.combinations(df, sets)
    about = P.estimates(kept)
    assert all(abs(about[s] - exact[s]) <= 2 + 0.03 * exact[s] for s in sets)
    assert exact["land", "holed"] == df.select("land", "holed").distinct().count()
