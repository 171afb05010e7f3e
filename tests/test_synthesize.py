import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shadowset.functions import random as R
from shadowset.functions.fakes import LOCALES, PROVIDERS, Fakes, provider_for
from shadowset.models import Analysis, Column, DateOrder, DimensionGroup, Relationship, Role, Table
from shadowset.operators import copula, preview, repair, stitch, synthesize, validate
from shadowset.operators.discover import analyze
from shadowset.plans.ranking import with_prefix, with_rank


@pytest.fixture(scope="module")
def shop(spark):
    customers = spark.range(60).select((F.col("id") + 1).alias("customer_id"), F.concat(F.lit("Person "), F.col("id")).alias("customer_name"), F.element_at(F.array(F.lit("N"), F.lit("S")), (F.col("id") % 2 + 1).cast("int")).alias("region"), F.element_at(F.array(F.lit("US"), F.lit("UK")), (F.col("id") % 2 + 1).cast("int")).alias("country"))
    orders = spark.range(300).select((F.col("id") + 1).alias("order_id"), (F.floor(F.sqrt("id") * 3) % 60 + 1).alias("customer_id"), (F.col("id") * 1.5).alias("amount"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("order_time"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600 + 7200).alias("ship_time"))
    return {"customers": customers, "orders": orders}


def test_uniforms_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select("id", R.uniform(F.col("id"), 5, "s").alias("u"), R.normal(F.col("id"), 5, "n").alias("z"))
    a, b = (sorted(map(tuple, df.repartition(n).collect())) for n in (2, 7))
    assert a == b
    u, z = np.array([r[1] for r in a]), np.array([r[2] for r in a])
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02 and abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06


def test_normal_functions(spark):
    from statistics import NormalDist

    p = [1e-4, 0.01, 0.3, 0.5, 0.77, 0.999]
    for r in spark.createDataFrame([(x,) for x in p], "p double").select("p", copula.normal_quantile(F.col("p")).alias("z"), copula.normal_cdf(copula.normal_quantile(F.col("p"))).alias("q")).collect():
        assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-6 and abs(r.q - r.p) < 1e-6


def test_ranks_and_prefixes(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    assert sorted((r.v, r.i) for r in with_rank(df, [F.col("v").desc()], "i").collect()) == [(v, 999 - v) for v in range(1000)]
    sums = with_prefix(spark.range(200_000).select(F.col("id").alias("i"), F.lit(2).alias("w")), "i", "w", "p")
    assert sums.filter("p <> 2 * i").count() == 0


@pytest.mark.parametrize("parents", [2, 5, 8])
def test_weights(spark, parents):
    rows = [v for v, n in ((3, 9), (1, 5), (4, 5), (2, 2), (9, 1)) for _ in range(n)]
    f = stitch.frequencies(spark.createDataFrame([(v,) for v in [*rows, None]], "v long"), "v")
    by = sorted({v: rows.count(v) for v in rows}.items(), key=lambda x: (-x[1], x[0]))
    want = [0] * parents
    if parents <= len(by):
        for i, (_, n) in enumerate(by):
            want[i % parents] += n
    else:
        want = [by[i % len(by)][1] for i in range(parents)]
    assert [r.w for r in stitch.weights(f, parents).orderBy("i").collect()] == want


def test_stitch(spark):
    parent = spark.createDataFrame([(i, k) for i, k in enumerate((10, 20, 30, 40, 50))], "_row long, id long")
    child = spark.range(4000).select(F.col("id").alias("_row"), F.lit(-1).cast("long").alias("ref"))
    original = spark.createDataFrame([(v,) for v in [1] * 6 + [2] * 3 + [3] + [None] * 10], "ref long")
    out = stitch.stitch(child, "ref", parent, "id", "_row", 3, original)
    n = {r.ref: r["count"] for r in out.groupBy("ref").count().collect()}
    assert sum(n.values()) == 4000 and 0.45 < n.pop(None) / 4000 < 0.55 and set(n) <= {10, 20, 30, 40, 50}
    assert n[10] > n[20] > n[30] and abs(n[10] / sum(n.values()) - 6 / 19) < 0.05
    assert sorted(map(str, out.collect())) == sorted(map(str, stitch.stitch(child.repartition(7), "ref", parent, "id", "_row", 3, original).collect()))
    assert stitch.stitch(child, "ref", parent.limit(0), "id", "_row", 3, original).filter("ref = -1").count() == 4000


def test_swaps_keep_nulls_and_order_the_rest(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (None, 1), (1, None)], "a long, b long")
    assert sorted(map(str, map(tuple, repair.swap_violations(df, [DateOrder("t", "a", "b")]).collect()))) == sorted(map(str, [(1, 2), (1, 2), (None, 1), (1, None)]))


def test_types_are_aligned_or_left(spark):
    a = Analysis(relationships=[Relationship("p", "id", "c", "ref"), Relationship("p", "id", "c", "bad")])
    said = []
    out = repair.align_types({"p": spark.range(3), "c": spark.createDataFrame([("1", "x"), (None, "2")], "ref string, bad string")}, a, said.append)
    assert dict(out["c"].dtypes) == {"ref": "bigint", "bad": "string"} and len(said) == 1


def test_relabel(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "_row long, d string")
    assert {r._row: r.d for r in repair.relabel(df, "d", "_row").collect()} == {1: "d_0", 2: None, 3: "d_1", 4: "d_0"}


def test_copula_keeps_correlation_and_range(spark):
    df = spark.range(3000).select(R.normal(F.col("id"), 1, "a").alias("x"), R.normal(F.col("id"), 1, "b").alias("e")).select("x", (F.col("x") * 2 + F.col("e") * 0.5).alias("y"), F.when(F.col("x") > 0.3, "hi").otherwise("lo").alias("k"))
    out = copula.sample(spark.range(3000).withColumnRenamed("id", "_row"), "_row", copula.fit(df), 4, "t")
    assert out.columns == ["_row", "x", "y", "k"]
    assert abs(out.select(F.corr("x", "y")).first()[0] - df.select(F.corr("x", "y")).first()[0]) < 0.05
    assert abs(out.filter("k = 'hi'").count() - df.filter("k = 'hi'").count()) < 150
    assert out.filter("k = 'hi'").agg(F.avg("x")).first()[0] > out.filter("k = 'lo'").agg(F.avg("x")).first()[0] + 0.5


@pytest.mark.parametrize("method", ["per_table", "hma"])
def test_whole_synthesis(spark, shop, method):
    a = analyze(shop)
    assert a.relationships and a.date_constraints and a.dimension_groups
    out = synthesize.synthesize(a, shop, 0.5, seed=11, method=method)
    assert {t: df.columns for t, df in out.items()} == {t: df.columns for t, df in shop.items()}
    assert {t: df.dtypes for t, df in out.items()} == {t: df.dtypes for t, df in shop.items()}
    report = validate.validate(a, out, shop, 0.5)
    assert report.all_passed
    assert report.row_counts["customers"].passed and (method == "hma" or report.row_counts["orders"].passed)
    assert {(r.region, r.country) for r in out["customers"].select("region", "country").distinct().collect()} <= {("N", "US"), ("S", "UK")}
    again = synthesize.synthesize(a, {t: df.repartition(3) for t, df in shop.items()}, 0.5, seed=11, method=method)
    assert sorted(map(str, out["orders"].collect())) == sorted(map(str, again["orders"].collect()))


def test_method_guard_and_fallback(spark, shop, monkeypatch):
    a = analyze(shop)
    assert synthesize.choose_method(a) == "hma" and synthesize.choose_method(Analysis()) == "per_table"
    with pytest.raises(ValueError):
        synthesize.choose_method(a, "other")
    monkeypatch.setenv("SHADOWSET_MAX_OUTPUT_ROWS", "10")
    with pytest.raises(ValueError):
        synthesize.synthesize(a, shop)
    monkeypatch.delenv("SHADOWSET_MAX_OUTPUT_ROWS")
    monkeypatch.setattr(synthesize, "multi_table", lambda *x: 1 / 0)
    said = []
    assert synthesize.synthesize(a, shop, 0.1, seed=1, warn=said.append)["orders"].count() == 30 and any("multi-table" in x for x in said)


def test_relabelled_dimensions(spark, shop):
    out = synthesize.synthesize(analyze(shop), shop, 1.0, seed=2, method="per_table", anonymize_dimensions=True)["customers"]
    assert {r.region for r in out.select("region").distinct().collect()} <= {"region_0", "region_1"}


@pytest.mark.parametrize("redact", [False, True])
def test_preview(spark, shop, redact):
    a = analyze(shop)
    rows = preview.preview("orders", a, shop, 20, redact, seed=1).collect()
    assert len(rows) == 20 and [r.order_id for r in rows] == list(range(1, 21))
    assert all(0 <= r.amount <= 448.5 for r in rows)
    people = preview.preview("customers", a, shop, 20, redact, seed=1).collect()
    assert all(r.region.startswith("Category_") if redact else r.region in "NS" for r in people)


@pytest.mark.parametrize("locale", ["de_DE", "it_IT", "pt_BR", "nl_BE", "sv_SE"])
def test_providers(spark, locale):
    fakes = Fakes(3, locale)
    row = spark.range(5).select("id", *(getattr(fakes, p)(F.col("id"), p).alias(p) for p in (*PROVIDERS, "short_sentence"))).collect()
    assert all(v for r in row for k, v in r.asDict().items() if k != "id")
    assert len(row[0].sentence.split()) == 10 and len(row[0].short_sentence.split()) == 6 and "@" in row[0].email
    assert len(row[0].uuid) == 36 and row[0].uuid[14] == "4"
    with pytest.raises(ValueError):
        Fakes(1, "xx_XX")
    with pytest.raises(NotImplementedError):
        Fakes(1, "ja_JP")
    assert len(LOCALES) == 35


@pytest.mark.parametrize(("column", "override", "want"), [("first_name", None, "name"), ("fname", None, "first_name"), ("surname", None, "last_name"), ("company_name", None, "name"), ("company", None, "company"), ("home email", None, "email"), ("zzz", None, "short_sentence"), ("zzz", "job", "job"), ("city", "auto", "city"), ("city", "bogus", "city"), ("notes", None, "sentence")])
def test_dispatch(column, override, want):
    assert provider_for(column, override) == want


def test_strict_dispatch():
    assert provider_for("first_name", strict=True) == "first_name" and provider_for("company_name", strict=True) == "company"


def test_groups_and_small_tables(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "x string, y long")
    a = Analysis({"t": Table("t", "", 2, {"x": Column("x", "categorical", Role.DIMENSION), "y": Column("y", "numerical", Role.MEASURE)})}, dimension_groups=[DimensionGroup("t", ["x", "y"], 2)])
    said = []
    out = synthesize.synthesize(a, {"t": df}, 20.0, seed=5, warn=said.append)["t"]
    assert set(map(tuple, out.collect())) <= {("a", 1), ("b", 2)} and out.count() == 40 and any("too few" in x for x in said)
    assert math.isclose(validate.expected_rows(100, 0.29), 28)


def test_every_category_has_a_score_of_its_own(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("c"), F.explode(F.sequence(F.lit(0), 60 - F.col("id"))).alias("n"))
    m = copula.fit(df).marginals
    assert copula._scored(df, ["c"], m).distinct().count() == 60


def test_no_category_is_cut(spark, monkeypatch):
    monkeypatch.setattr(copula, "VALUES", 40)
    df = spark.range(6000).select((F.col("id") % 70).alias("x"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), F.col("id") % 70)).alias("c"))
    df = df.select(F.when(F.col("c").isNotNull(), F.length("c") + F.col("x")).alias("x"), "c")
    want = {r.c for r in df.filter("c is not null").select("c").distinct().collect()}
    out = copula.sample(spark.range(5000).withColumnRenamed("id", "_row"), "_row", copula.fit(df), 3, "t")
    rows = out.collect()
    assert len(rows) == 5000 and len({r._row for r in rows}) == 5000 and {r.c for r in rows} - {None} == want
    assert abs(sum(r.c is None for r in rows) / 5000 - 0.25) < 0.03


@pytest.mark.parametrize("rows", [[(1.0, "a", None), (2.0, "a", None), (3.0, "a", None)], [(1.0, "a", None)], [(5.0, "a", 1), (5.0, "b", 1)], []])
def test_columns_without_spread(spark, rows):
    df = spark.createDataFrame(rows, "x double, c string, e long")
    model = copula.fit(df)
    assert np.array_equal(model.factor, np.eye(3))
    out = copula.sample(spark.range(7).withColumnRenamed("id", "_row"), "_row", model, 3, "t").collect()
    assert len(out) == 7 and {r.c for r in out} <= {r[1] for r in rows} | {None} and {r.e for r in out} <= {r[2] for r in rows} | {None}


def test_correlations_where_values_are_missing(spark):
    df = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("x"), F.when(F.col("id") % 4 > 0, F.col("id") * 2.0).alias("y"))
    f = copula.fit(df).factor
    assert (f @ f.T)[0, 1] > 0.99


def test_child_counts_are_those_that_occur(spark):
    """One parent has a third of all children; what is made has neither more such parents nor other counts, and follows the parent's columns."""
    parents = spark.range(400).select((F.col("id") + 1).alias("p_id"), F.when(F.col("id") < 200, 1.0).otherwise(9.0).alias("size"))
    n = F.when(F.col("id") == 300, 900).when(F.col("id") < 200, 0).otherwise(F.lit(9))
    children = spark.range(400).select((F.col("id") + 1).alias("p_id"), F.explode(F.sequence(F.lit(1), F.when(n > 0, n))).alias("amount")).withColumn("c_id", F.monotonically_increasing_id())
    a = Analysis({"p": Table("p", "", 400, {}, "p_id"), "c": Table("c", "", children.count(), {}, "c_id")}, relationships=[Relationship("p", "p_id", "c", "p_id")])
    out, kept = synthesize.multi_table(a, {"p": parents, "c": children}, 1.0, 4, lambda *x: None)
    assert kept == {r.edge for r in a.relationships}
    assert set(out["p"].columns) == {"_row", "p_id", "size"}
    counts = out["c"].groupBy("p_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_row").alias("k"))
    got = counts.collect()
    assert all(r.n == r.k for r in got) and {r.n for r in got} <= {9, 900} and sum(r.n == 900 for r in got) <= 6
    mean = out["p"].join(counts.withColumnRenamed("p_id", "q"), F.col("p_id") == F.col("q"), "left").groupBy("size").agg(F.avg((F.coalesce("n", F.lit(0)) > 0).cast("int")).alias("some"))
    by = {r["size"]: r["some"] for r in mean.collect()}
    assert max(by.values()) > 0.8


@pytest.mark.parametrize("weights", [[1], [5, 5, 5], [1, 0, 9, 2, 2], [1000] + [1] * 99, [3, 1, 4, 1, 5, 9, 2, 6] * 20, [0, 0, 7], [10**9, 1, 10**9 + 1], [1, 2, 3, 100, 100, 100]])
def test_alias_cells_hold_each_weight(spark, weights):
    """What the cells give to a value, own shares and what others lack, is its part of all weights."""
    df = spark.createDataFrame([(i, w, f"v{i}") for i, w in enumerate(weights)], "i long, w long, v string").repartition(5)
    cells, n = stitch.alias_cells(df)
    got, total = dict.fromkeys(range(len(weights)), 0.0), sum(weights)
    rows = cells.collect()
    assert sorted(r.cell for r in rows) == list(range(n)) == list(range(len(weights)))
    for r in rows:
        assert -1e-12 <= r.share <= 1 + 1e-12 and r.own == f"v{r.cell}"
        got[r.cell] += r.share
        got[int(r.other[1:])] += 1 - r.share
    for i, w in enumerate(weights):
        assert abs(got[i] / n - w / total) < 1e-9
    again, _ = stitch.alias_cells(df.repartition(2))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))


def test_a_value_of_half_the_weight_is_dealt_out(spark):
    """One of 50,000 parents has half of the weight: it is drawn that often, no partition of the table has far more cells than another, and no key of the join is hot."""
    n = 50_000
    df = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") == 7, n).otherwise(1).cast("long").alias("w"), F.col("id").alias("v"))
    cells, _ = stitch.alias_cells(df)
    assert cells.count() == cells.select("cell").distinct().count() == n
    sizes = [r["count"] for r in cells.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 3 * n / len(sizes)
    made = stitch.drawn(spark.range(40_000).withColumnRenamed("id", "_row"), "_row", df, 5, "half")
    hot = made.filter("_v = 7").count()
    assert made.count() == 40_000 and abs(hot - 20_000) < 6 * 100
    assert "Generate" not in made._jdf.queryExecution().toString()


def test_spans_of_a_table_and_of_a_list_draw_alike(spark):
    spans = [("a", 0.0, 0.5), ("b", 0.5, 0.5), ("c", 0.5, 0.5004), ("d", 0.5004, 0.75), *((f"e{i}", 0.75 + i / 8192, 0.75 + (i + 1) / 8192) for i in range(2048))]
    rows = spark.range(5000).select(F.col("id").alias("_row"), (F.col("id") / 5000).alias("_u"))
    table = spark.createDataFrame(spans, "v string, lo double, hi double").repartition(6)
    from pyspark.sql import types as T

    one = stitch.drawn_values(rows, "_u", table, len(spans), "got")
    two = stitch.drawn_values(rows, "_u", spans, len(spans), "got", T.StringType())
    want = {(i, next(v for v, lo, hi in spans if lo <= i / 5000 < hi)) for i in range(5000)}
    assert {(r._row, r.got) for r in one.collect()} == want == {(r._row, r.got) for r in two.collect()}
    assert one.count() == two.count() == 5000


def family(spark, n=1500, rho=0.8):
    """Parents with a number and a kind; children whose number goes with the parent's number (rho), and whose label is mostly the parent's kind."""
    z = lambda c, s: R.normal(F.col(c), 11, s)
    kind = F.when(R.uniform(F.col("id"), 11, "kind") < 0.6, "a").otherwise("b")
    parents = spark.range(n).select(F.col("id").alias("p_id"), (50 + 10 * z("id", "p")).alias("size"), kind.alias("kind"), z("id", "p").alias("_z"), F.when(F.col("id") == 3, 40).otherwise(F.col("id") % 4).alias("_n"))
    own = parents.filter("_n > 0").withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).withColumn("c_id", F.col("p_id") * 1000 + F.col("_j"))
    value = 7 + rho * F.col("_z") + math.sqrt(1 - rho * rho) * z("c_id", "c")
    label = F.when(R.uniform(F.col("c_id"), 11, "label") < 0.9, F.col("kind")).otherwise("z")
    children = own.select("c_id", F.when(F.col("c_id") % 17 != 0, F.col("p_id")).alias("p_id"), value.alias("value"), label.alias("label"), z("c_id", "free").alias("free"))
    meta = lambda name, key, rows, cols: Table(name, "", rows, {c: Column(c, sdtype=k, role=role, is_primary_key=role == Role.PRIMARY_KEY) for c, k, role in cols}, key)
    a = Analysis(
        {
            "p": meta("p", "p_id", n, [("p_id", "id", Role.PRIMARY_KEY), ("size", "numerical", Role.MEASURE), ("kind", "categorical", Role.DIMENSION)]),
            "c": meta("c", "c_id", children.count(), [("c_id", "id", Role.PRIMARY_KEY), ("p_id", "id", Role.FOREIGN_KEY), ("value", "numerical", Role.MEASURE), ("label", "categorical", Role.DIMENSION), ("free", "numerical", Role.MEASURE)]),
        },
        [Relationship("p", "p_id", "c", "p_id")],
    )
    return {"p": parents.select("p_id", "size", "kind"), "c": children}, a


def test_children_go_with_their_parents(spark):
    tables, a = family(spark)
    made = synthesize.synthesize(a, tables, 1.0, seed=5, method="hma")
    facts = lambda t: t["c"].join(t["p"], "p_id").agg(F.corr("size", "value").alias("r"), F.corr("size", "free").alias("f"), F.avg((F.col("kind") == F.col("label")).cast("int")).alias("same"), F.stddev("value").alias("sd"), F.avg("value").alias("mean")).first()
    old, new = facts(tables), facts(made)
    assert abs(old.r - 0.8) < 0.06 and abs(new.r - old.r) < 0.1 and abs(new.f) < 0.1
    assert new.same > 0.7 and abs(new.sd - old.sd) < 0.1 and abs(new.mean - old.mean) < 0.15
    often = lambda t: {r["n"]: r["count"] for r in t["p"].join(t["c"].groupBy("p_id").agg(F.count(F.lit(1)).alias("n")), "p_id", "left").fillna(0).groupBy("n").count().collect()}
    assert made["c"].join(made["p"], "p_id", "left_anti").filter("p_id is not null").count() == 0
    share = made["c"].filter("p_id is null").count() / made["c"].count()
    assert abs(share - tables["c"].filter("p_id is null").count() / tables["c"].count()) < 0.02
    assert sum(often(made).values()) == 1500 and 0.25 < often(made)[0] / 1500 < 0.45


def test_conditional_scores_need_no_partition(spark):
    tables, a = family(spark, 200)
    one = synthesize.multi_table(a, tables, 0.5, 4, lambda *x: None)[0]["c"]
    two = synthesize.multi_table(a, {t: df.repartition(5) for t, df in tables.items()}, 0.5, 4, lambda *x: None)[0]["c"]
    close = lambda df: sorted((r.c_id, r.p_id, round(r.value, 4), r.label) for r in df.collect())
    assert close(one) == close(two)


def test_moments_are_those_of_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    x[::7, 1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "s0 double, s1 double, s2 double").repartition(4)
    got = copula.correlations(*copula._moments(df, 3))
    for i in range(3):
        for j in range(3):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert abs(got[i, j] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-8
    assert (copula.correlations(*copula._moments(df.limit(1), 3)) == np.eye(3)).all()


def test_previews_draw_from_all_values(spark):
    """A chi-square test over 5,000 distinct values, drawn as often as they occur and evenly."""
    df = spark.range(20_000).select(F.when(F.col("id") < 15_000, F.col("id") % 2500).otherwise(2500 + F.col("id") % 2500).alias("v"))
    for distinct in (False, True):
        got = np.bincount(preview.resampled(df, "v", 50_000, 3, "s", distinct), minlength=5000)
        want = 50_000 * (np.full(5000, 1 / 5000) if distinct else np.r_[np.full(2500, 6 / 20_000), np.full(2500, 2 / 20_000)])
        chi = ((got - want) ** 2 / want).sum()
        assert got.sum() == 50_000 and (got > 0).sum() > 4900 and abs(chi - 4999) < 5 * math.sqrt(2 * 4999)
    assert preview.resampled(df.limit(0), "v", 5, 3, "s") == [] and set(preview.resampled(df.limit(1), "v", 5, 3, "s")) == {0}
    one = preview.resampled(df, "v", 40, 3, "t", True)
    assert one == preview.resampled(df.repartition(7), "v", 40, 3, "t", True) and len(set(one)) > 30


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_draws_are_not_filtered_by_their_own_expressions(spark):
    """A cell that can be null would be filtered below the join, its number's whole expression written out for every use."""
    u = copula.normal_cdf(R.normal(F.col("id"), 7, "s"))
    got = stitch.drawn_values(spark.range(100).select("id", u.alias("u")), "u", [("a", 0.0, 0.25), ("b", 0.25, 1.0)], 2, "v", T.StringType())
    assert not any("xxhash64" in line for line in _plan(got).split("\n") if "Filter" in line)
    assert got.count() == 100 and {r.v for r in got.collect()} == {"a", "b"}


def test_tables_are_made_once_for_all_their_labels(spark):
    columns = {c: Column(c, role=Role.DIMENSION) for c in "ab"}
    df = spark.range(50).select(F.col("id").alias("_row"), (F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 5).cast("string").alias("b"))
    out = repair.relabel_dimensions({"t": df}, Analysis({"t": Table("t", "", 50, columns)}), "_row")["t"]
    assert "Range" not in _plan(out)
    assert sorted((r["_row"], r.a, r.b) for r in out.collect()) == [(i, f"a_{i % 3}", f"b_{i % 5}") for i in range(50)]


def test_scores_of_numbers_are_those_of_their_middle_ranks(spark):
    from statistics import NormalDist

    q = [float(min(j, 60)) for j in range(copula.QUANTILES)]
    rows = [None, float("nan"), -1.0, 0.0, 0.5, 60.0, 61.0]
    m = copula.Marginal(T.DoubleType(), quantiles=q)
    got = [r.s0 for r in copula._scored(spark.createDataFrame([(x,) for x in rows], "x double").coalesce(1), ["x"], {"x": m}).collect()]
    rank = lambda x: 2 * len(q) if math.isnan(x) else sum(v < x for v in q) + sum(v <= x for v in q)
    assert got == [None if x is None else NormalDist().inv_cdf(max(1e-4, min(1 - 1e-4, rank(x) / (2 * len(q))))) for x in rows]


def test_large_outputs_are_made_unless_a_limit_is_set(monkeypatch):
    a, said = Analysis({"t": Table("t", "", 9_900_000, {})}), []
    monkeypatch.delenv("SHADOWSET_MAX_OUTPUT_ROWS", raising=False)
    assert synthesize.guard_output(a, 1.0, said.append) == 9_900_000 and len(said) == 1
    monkeypatch.setenv("SHADOWSET_MAX_OUTPUT_ROWS", "5000000")
    with pytest.raises(ValueError):
        synthesize.guard_output(a, 1.0, said.append)
