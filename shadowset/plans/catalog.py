"""The registered queries of the library's own operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shadowset.functions import names as N
from shadowset.models import Analysis, Column, Relationship, Role, Table
from shadowset.operators import config, copula, discover, preview, profile, repair, review, stitch, synthesize, validate
from shadowset.plans import ranking
from shadowset.plans.views import VIEWS, columns_of, raw, renamed, renamed_sql
from shadowset.streaming.checks import stream_orphans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---- profiles and keys

_KEYED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "orders_str"]


def _profile_sql(views: list[str]) -> str:
    one = "SELECT '{v}' AS table_name, '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS n_distinct FROM v_{v}"
    rows = " UNION ALL ".join(one.format(v=v, c=c, i=i) for v in views for i, c in enumerate(columns_of(v)))
    return renamed_sql() + f", prof AS (SELECT *, CASE WHEN n_rows > 0 THEN n_distinct / n_rows ELSE 0.0 END AS uniqueness FROM ({rows}))"


@query(_profile_sql(_KEYED) + " SELECT * FROM prof")
def column_profile(spark, sf_dir):
    return _union([profile.profile_frame(df, v) for v, df in renamed(spark, sf_dir, *_KEYED).items()])


_SUFFIX = "lower(column_name) SIMILAR TO '.*(_id|_key|_nr|_no|_pk|_code|id)'"


@query(
    _profile_sql(_KEYED)
    + f""", named AS (SELECT *, uniqueness >= 0.95 AND {_SUFFIX} AS by_name, n_distinct = n_rows AS by_value FROM prof WHERE n_rows > 0 AND n_null = 0),
    per AS (SELECT table_name, bool_or(by_name) AS any_name FROM named GROUP BY 1)
    SELECT table_name, column_name, uniqueness, row_number() OVER (PARTITION BY table_name ORDER BY uniqueness DESC, ordinal) AS place
    FROM named JOIN per USING (table_name) WHERE by_name OR (NOT any_name AND by_value)"""
)
def pk_candidates(spark, sf_dir):
    views = renamed(spark, sf_dir, *_KEYED)
    found = profile.together(spark, [lambda df=df: discover.primary_keys(df) for df in views.values()])
    rows = [(v, c, r, i + 1) for v, keys in zip(views, found, strict=True) for i, (c, r) in enumerate(keys)]
    return spark.createDataFrame(rows, "table_name string, column_name string, uniqueness double, place long")


_EDGES = [("nation", "region_id", "region"), ("customer", "nation_id", "nation"), ("supplier", "nation_id", "nation"), ("orders", "customer_id", "customer"), ("lineitem", "order_id", "orders"), ("lineitem", "part_id", "part"), ("lineitem", "supplier_id", "supplier"), ("orders_str", "customer_id", "customer")]
_KEYS = {"region": "region_id", "nation": "nation_id", "customer": "customer_id", "supplier": "supplier_id", "part": "part_id", "orders": "order_id", "orders_str": "order_key"}


def _overlap_sql(text: bool) -> str:
    one = "SELECT '{p}' AS parent_table, '{k}' AS parent_column, '{c}' AS child_table, '{f}' AS child_column, (SELECT count(*) FROM (SELECT DISTINCT {a} AS v FROM v_{c} WHERE {f} IS NOT NULL) WHERE v IN (SELECT {b} FROM v_{p})) AS n_hit, (SELECT count(DISTINCT {f}) FROM v_{c}) AS n_values"
    rows = []
    for c, f, p in _EDGES:
        k = _KEYS[p]
        if text:
            rows.append(one.format(p=p, k=k, c=c, f=f, a=f"CAST({f} AS VARCHAR)", b=f"CAST({k} AS VARCHAR)"))
        elif c == "orders_str":
            rows.append(f"SELECT '{p}', '{k}', '{c}', '{f}', 0, (SELECT count(DISTINCT {f}) FROM v_{c})")
        else:
            rows.append(one.format(p=p, k=k, c=c, f=f, a=f, b=k))
    return " UNION ALL ".join(rows)


def _overlaps(spark, sf_dir, as_string: bool) -> DataFrame:
    views, out = renamed(spark, sf_dir), []
    for c, f, p, k in discover.fk_candidates({v: df.columns for v, df in views.items()}, _KEYS):
        row = discover.overlap(views[c], f, views[p], k, as_string)
        out.append(row.select(F.lit(p).alias("parent_table"), F.lit(k).alias("parent_column"), F.lit(c).alias("child_table"), F.lit(f).alias("child_column"), F.col("hit").alias("n_hit"), F.col("n").alias("n_values")))
    return _union(out)


@query(renamed_sql() + f" SELECT *, n_hit / n_values AS overlap FROM ({_overlap_sql(False)})")
def fk_overlap(spark, sf_dir):
    return _overlaps(spark, sf_dir, False).withColumn("overlap", F.col("n_hit") / F.col("n_values"))


@query(renamed_sql() + f" SELECT *, n_hit / n_values AS overlap FROM ({_overlap_sql(True)})")
def fk_overlap_string_cast(spark, sf_dir):
    return _overlaps(spark, sf_dir, True).withColumn("overlap", F.col("n_hit") / F.col("n_values"))


@query(
    renamed_sql()
    + f""" SELECT parent_table, parent_column, child_table, child_column, round_even(max(n_hit / n_values), 3) AS overlap_ratio
    FROM ({_overlap_sql(False)} UNION ALL {_overlap_sql(True)}) GROUP BY 1, 2, 3, 4 HAVING max(n_hit / n_values) >= 0.8"""
)
def fk_detect(spark, sf_dir):
    views = renamed(spark, sf_dir)
    known = profile.together(spark, [lambda df=df: discover.primary_keys(df) for df in views.values()])
    found = discover.foreign_keys(views, {v: k[0][0] for v, k in zip(views, known, strict=True) if k})
    return spark.createDataFrame([(*r.edge, r.overlap_ratio) for r in found], "parent_table string, parent_column string, child_table string, child_column string, overlap_ratio double")


# ---- dimensions, dates, texts, roles

_STRINGS = [("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("events", "event_type"), ("events", "props"), ("pages", "url"), ("pages", "html"), ("documents", "text"), ("documents", "lang"), ("documents", "source"), ("conversations", "role"), ("conversations", "text"), ("benchmark", "text")]
_STRING_TABLES = list(dict.fromkeys(t for t, _ in _STRINGS))
_STRING_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS d, avg(length({c})) AS len FROM {t}" for t, c in _STRINGS)


@query(f"SELECT table_name, column_name, d / n AS uniqueness FROM ({_STRING_SQL}) WHERE n > 0 AND d / n < CASE WHEN n < 50 THEN 0.5 WHEN n < 200 THEN 0.15 ELSE 0.05 END")
def dimension_detect(spark, sf_dir):
    rows = []
    profiles = profile.together(spark, [lambda t=t: discover.dimension_profiles(raw(spark, sf_dir, t)) for t in _STRING_TABLES])
    for t, known in zip(_STRING_TABLES, profiles, strict=True):
        rows += [(t, c, known[c].ratio) for c in discover.dimensions(None, profiled=known)]
    return spark.createDataFrame(rows, "table_name string, column_name string, uniqueness double")


@query(f"SELECT table_name, column_name, d / n AS uniqueness FROM ({_STRING_SQL}) WHERE n > 0 AND d / n >= 0.05 AND len > 3")
def text_columns(spark, sf_dir):
    rows = []
    profiles = profile.together(spark, [lambda t=t: discover.text_profiles(raw(spark, sf_dir, t)) for t in _STRING_TABLES])
    for t, known in zip(_STRING_TABLES, profiles, strict=True):
        rows += [(t, c, known[c].ratio) for c in discover.text_columns(None, profiled=known)]
    return spark.createDataFrame(rows, "table_name string, column_name string, uniqueness double")


def _places(spark, sf_dir) -> DataFrame:
    c, n, r = (raw(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name", "c_mktsegment")


_PLACES = "SELECT c_custkey, n_name, r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(
    f"""WITH p AS ({_PLACES}), k AS (SELECT count(*) AS n, count(DISTINCT n_name) AS a, count(DISTINCT r_name) AS b, count(DISTINCT c_mktsegment) AS m, count(DISTINCT (n_name, r_name)) AS ab,
    count(DISTINCT (n_name, c_mktsegment)) AS am, count(DISTINCT (r_name, c_mktsegment)) AS bm, CASE WHEN count(*) < 50 THEN 0.5 WHEN count(*) < 200 THEN 0.15 ELSE 0.05 END AS lim FROM p)
    SELECT 'places' AS table_name, 'n_name,r_name' AS column_names, ab AS combination_count FROM k WHERE a / n < lim AND b / n < lim AND (ab = a OR ab = b) AND am NOT IN (a, m) AND bm NOT IN (b, m)"""
)
def dimension_groups(spark, sf_dir):
    df = _places(spark, sf_dir)
    found = discover.dimension_groups("places", df, discover.dimensions(df))
    return spark.createDataFrame([(g.table_name, ",".join(g.column_names), g.combination_count) for g in found], "table_name string, column_names string, combination_count long")


_SHIPPED = "SELECT l_orderkey, l_linenumber, o_orderdate AS order_date, l_shipdate AS ship_date, l_shipdate + {} AS receipt_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_SHIPPED_SQL = _SHIPPED.format("to_days(l_linenumber)")


def _shipped(spark, sf_dir) -> DataFrame:
    li, o = raw(spark, sf_dir, "lineitem"), raw(spark, sf_dir, "orders")
    later = F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", F.col("o_orderdate").alias("order_date"), F.col("l_shipdate").alias("ship_date"), later.alias("receipt_date"))


def _pairs_sql() -> str:
    pairs = [("order_date", "ship_date"), ("order_date", "receipt_date"), ("ship_date", "receipt_date")]
    return " UNION ALL ".join(f"SELECT '{a}' AS low_column, '{b}' AS high_column, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n_both, count(*) FILTER ({a} > {b}) AS n_violations FROM s" for a, b in pairs)


@query(f"WITH s AS ({_SHIPPED_SQL}) SELECT low_column, high_column, n_violations FROM ({_pairs_sql()}) WHERE n_both > 0 AND n_violations <= 0.02 * n_both")
def date_constraints(spark, sf_dir):
    found = discover.date_orders("shipped", _shipped(spark, sf_dir))
    return spark.createDataFrame([(d.low_column, d.high_column, d.violation_count) for d in found], "low_column string, high_column string, n_violations long")


_NAMED = {"events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "conversations": ["conv_id", "turn", "role", "text"], "pages": ["page_id", "url", "html"]}
_LOW = "replace(lower(column_name), ' ', '_')"
_SENSITIVITY = f"""CASE WHEN regexp_matches({_LOW}, '{'|'.join(N.HIGH)}') THEN 'high' WHEN {_LOW} IN ('name', 'email') OR regexp_matches({_LOW}, '{'|'.join(N.LOW_ANYWHERE)}') OR list_has_any(string_split({_LOW}, '_'), {N.LOW_SEGMENT!r}) THEN 'low' ELSE 'none' END"""


def _named_sql() -> str:
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n_values FROM {f}"
    return " UNION ALL ".join([one.format(t=v, c=c, f=f"v_{v}") for v in _KEYED for c in columns_of(v)] + [one.format(t=t, c=c, f=t) for t, columns in _NAMED.items() for c in columns])


@query(renamed_sql() + f" SELECT *, {_SENSITIVITY} AS sensitivity FROM ({_named_sql()})")
def sensitivity(spark, sf_dir):
    """Which columns of the tables may be personal by their names, and how many values they hold."""
    frames = renamed(spark, sf_dir, *_KEYED) | {t: raw(spark, sf_dir, t) for t in _NAMED}
    counted = []
    for t, df in frames.items():
        one = df.agg(*(F.count(f"`{c}`").alias(c) for c in df.columns))
        counted.append(one.select(F.lit(t).alias("table_name"), F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_values")) for c in df.columns)))))
    return _union(counted).withColumn("sensitivity", N.sensitivity_column(F.col("column_name")))


def _roles_sql() -> str:
    """cols: every column of the views with its role, by the rules that the analysis goes by."""
    one = "SELECT '{v}' AS table_name, {t} AS place, '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal, count(*) AS n, count(*) - count({c}) AS z, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS d, any_value(typeof({c})) AS kind, avg(length(CAST({c} AS VARCHAR))) AS len FROM v_{v}"
    rows = " UNION ALL ".join(one.format(v=v, t=t, c=c, i=i) for t, v in enumerate(VIEWS) for i, c in enumerate(columns_of(v)))
    return (
        renamed_sql()
        + f""", prof AS MATERIALIZED (SELECT *, d / n AS ratio FROM ({rows})),
    named AS (SELECT *, ratio >= 0.95 AND {_SUFFIX} AS by_name FROM prof WHERE n > 0 AND z = 0 AND (ratio >= 0.95 AND {_SUFFIX} OR d = n)),
    keys AS MATERIALIZED (SELECT table_name, column_name AS k FROM named QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY by_name DESC, ratio DESC, ordinal) = 1),
    edges AS MATERIALIZED (SELECT parent_table, parent_column, child_table, child_column FROM ({_overlap_sql(False)} UNION ALL {_overlap_sql(True)}) GROUP BY ALL HAVING max(n_hit / n_values) >= 0.8),
    cols AS MATERIALIZED (SELECT p.table_name, place, ordinal, column_name, n, CASE WHEN column_name = k THEN 'primary_key' WHEN child_column IS NOT NULL THEN 'foreign_key'
      WHEN kind = 'VARCHAR' AND ratio < CASE WHEN n < 50 THEN 0.5 WHEN n < 200 THEN 0.15 ELSE 0.05 END THEN 'dimension' WHEN kind LIKE 'TIMESTAMP%' OR kind = 'DATE' THEN 'date' WHEN kind = 'VARCHAR' AND ratio >= 0.05 AND len > 3 THEN 'text'
      WHEN kind IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') THEN 'measure' ELSE 'other' END AS role, kind, CASE WHEN column_name = k THEN NULL ELSE parent_table || '.' || parent_column END AS target
      FROM prof p LEFT JOIN keys USING (table_name) LEFT JOIN edges ON child_table = p.table_name AND child_column = column_name)"""
    )


@query(
    _roles_sql()
    + f""" SELECT table_name, ordinal, column_name, CASE role WHEN 'primary_key' THEN 'id' WHEN 'foreign_key' THEN 'id' WHEN 'dimension' THEN 'categorical' WHEN 'date' THEN 'datetime' WHEN 'text' THEN 'unknown' WHEN 'measure' THEN 'numerical'
    ELSE CASE WHEN kind = 'BOOLEAN' THEN 'boolean' ELSE 'categorical' END END AS sdtype, role, role = 'primary_key' AS is_primary_key, target AS foreign_key_target, {_SENSITIVITY} AS sensitivity FROM cols"""
)
def column_roles(spark, sf_dir):
    columns = discover.analyze(renamed(spark, sf_dir)).to_dataframes(spark)["columns"]
    return columns.select("table_name", "ordinal", "column_name", "sdtype", "role", "is_primary_key", "foreign_key_target", "sensitivity")


@query(
    _roles_sql()
    + """ SELECT table_name, count(*) AS n_columns, count(*) FILTER (role = 'foreign_key') AS n_foreign_keys, count(*) FILTER (role = 'dimension') AS n_dimensions, max(CASE WHEN role = 'primary_key' THEN column_name END) AS primary_key, max(n) AS n_rows FROM cols GROUP BY 1"""
)
def table_overview(spark, sf_dir):
    frames = discover.analyze(renamed(spark, sf_dir)).to_dataframes(spark)
    return review.overview(frames["columns"], frames["tables"])


# ---- integrity

_CLAIMED = [("customer", "c_custkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("part", "p_partkey"), ("events", "event_id"), ("documents", "doc_id")]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, count(*) - count(DISTINCT {c}) AS n_duplicates FROM {t}" for t, c in _CLAIMED))
def pk_uniqueness(spark, sf_dir):
    return _union([validate.duplicates(raw(spark, sf_dir, t), c).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "n_rows", "n_distinct", "n_duplicates") for t, c in _CLAIMED])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END FROM customer)")
def fk_integrity(spark, sf_dir):
    parents = raw(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey")
    return validate.orphans(raw(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


@query(f"WITH s AS ({_SHIPPED_SQL}) {_pairs_sql()}")
def date_check(spark, sf_dir):
    s = _shipped(spark, sf_dir)
    pairs = [("order_date", "ship_date"), ("order_date", "receipt_date"), ("ship_date", "receipt_date")]
    return _union([validate.date_violations(s, a, b).select(F.lit(a).alias("low_column"), F.lit(b).alias("high_column"), "n_both", "n_violations") for a, b in pairs])


_COUNTED, _SCALES = ["region", "nation", "customer", "orders", "lineitem"], [0.1, 0.29, 1.0, 2.5]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, {s}::DOUBLE AS scale, count(*) AS n_rows, greatest(1, CAST(trunc(count(*) * {s}::DOUBLE) AS BIGINT)) AS expected FROM {t}" for t in _COUNTED for s in _SCALES))
def row_counts(spark, sf_dir):
    one = lambda t, s: raw(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), F.lit(s).alias("scale"), "n_rows", F.greatest(F.lit(1).cast("long"), (F.col("n_rows") * F.lit(s)).cast("long")).alias("expected"))
    return _union([one(t, s) for t in _COUNTED for s in _SCALES])


_HOLED = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nation, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN '12.5' WHEN c_custkey % 3 = 1 THEN 'x' END AS mixed FROM customer"


def _holed(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return raw(spark, sf_dir, "customer").select("c_custkey", F.when(k % 7 != 0, F.col("c_acctbal")).alias("balance"), F.when(k % 5 != 0, F.col("c_nationkey")).alias("nation"), F.when(k % 7 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 3 == 0, "12.5").when(k % 3 == 1, "x").alias("mixed"))


def _stats_sql(c: str, number: bool) -> str:
    v = f"TRY_CAST({c} AS DOUBLE)"
    values = f"round(avg({v}), 4), round(stddev_samp({v}), 4), min({v}), max({v})" if number else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
    names = ("mean", "std", "min", "max")
    values = ", ".join(f"{x} AS {n}" for x, n in zip(values.split(", ") if not number else [f"round(avg({v}), 4)", f"round(stddev_samp({v}), 4)", f"min({v})", f"max({v})"], names, strict=True))
    return f"SELECT '{c}' AS column_name, count(*) AS n_rows, round(count(*) FILTER ({c} IS NULL) / count(*), 9) AS null_ratio, {values} FROM h"


@query(f"WITH h AS ({_HOLED}) " + " UNION ALL ".join(_stats_sql(c, c != "segment") for c in ("c_custkey", "balance", "nation", "segment", "mixed")))
def column_stats(spark, sf_dir):
    df = validate.statistics(_holed(spark, sf_dir), ["c_custkey", "balance", "nation", "segment", "mixed"], ["c_custkey", "balance", "nation", "mixed"])
    return df.select("column_name", "n_rows", F.round("null_ratio", 9).alias("null_ratio"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


@query(f"WITH h AS ({_HOLED}) SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, round((" + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ("c_custkey", "balance", "nation", "segment", "mixed")) + ") / (5.0 * count(*))::DOUBLE, 9) AS mean_null_ratio FROM h")
def null_profile(spark, sf_dir):
    return review.data_profile(_holed(spark, sf_dir)).withColumn("mean_null_ratio", F.round("mean_null_ratio", 9))


# ---- repair and synthesis

@query(f"WITH s AS ({_SHIPPED_SQL}) SELECT l_orderkey, l_linenumber, CASE WHEN order_date > ship_date THEN ship_date ELSE order_date END AS order_date, CASE WHEN order_date > ship_date THEN order_date ELSE ship_date END AS ship_date FROM s")
def date_repair(spark, sf_dir):
    from shadowset.models import DateOrder

    return repair.swap_violations(_shipped(spark, sf_dir).drop("receipt_date"), [DateOrder("shipped", "order_date", "ship_date")])


@query("SELECT o_orderkey AS order_key, o_custkey AS customer_id FROM orders")
def fk_type_align(spark, sf_dir):
    from shadowset.models import Analysis, Relationship

    views = renamed(spark, sf_dir, "customer", "orders_str")
    return repair.align_types(views, Analysis(relationships=[Relationship("customer", "customer_id", "orders_str", "customer_id")]))["orders_str"]


@query(
    """WITH f AS (SELECT o_custkey AS v, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, v) - 1 AS j FROM f),
    k AS (SELECT count(*) AS m FROM f) SELECT j % 40 AS i, CAST(sum(n) AS BIGINT) AS w, 40::BIGINT AS parents FROM r GROUP BY 1
    UNION ALL SELECT t.i, r.n, (SELECT m + 25 FROM k) FROM (SELECT unnest(range(0, (SELECT m + 25 FROM k))) AS i) t JOIN r ON r.j = t.i % (SELECT m FROM k)"""
)
def fk_weights(spark, sf_dir):
    ranked = stitch.frequencies(raw(spark, sf_dir, "orders"), "o_custkey")
    sizes = [40, ranked.count() + 25]
    return _union([stitch.weights(ranked, p).select("i", "w", F.lit(p).cast("long").alias("parents")) for p in sizes])


@query(
    """WITH f AS (SELECT p_brand AS v, min(p_partkey) AS first FROM part WHERE p_brand IS NOT NULL GROUP BY 1), r AS (SELECT v, 'p_brand_' || CAST(row_number() OVER (ORDER BY first) - 1 AS VARCHAR) AS label FROM f)
    SELECT p_partkey, label AS p_brand FROM part LEFT JOIN r ON p_brand = v"""
)
def dimension_anonymize(spark, sf_dir):
    return repair.relabel(raw(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query(f"WITH h AS ({_HOLED}) SELECT c_custkey, CASE WHEN segment IS NULL THEN 'None' WHEN segment IN ('', 'None', 'nan') THEN segment ELSE '[REDACTED]' END AS segment FROM h")
def sample_redaction(spark, sf_dir):
    return _holed(spark, sf_dir).select("c_custkey", config.redact_column(F.col("segment")).alias("segment"))


def _merged(spark, sf_dir, part: str) -> DataFrame:
    saved = raw(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS key")
    loaded = raw(spark, sf_dir, "orders").selectExpr("CASE WHEN o_custkey % 4 = 0 THEN -o_custkey ELSE o_custkey END AS key")
    return config.merge_frames(saved, loaded, ["key"])[part]


_SAVED, _NOW = "SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS key FROM customer", "SELECT CASE WHEN o_custkey % 4 = 0 THEN -o_custkey ELSE o_custkey END AS key FROM orders"


@query(f"({_SAVED}) INTERSECT ({_NOW})")
def config_merge_matched(spark, sf_dir):
    return _merged(spark, sf_dir, "matched")


@query(f"({_NOW}) EXCEPT ({_SAVED})")
def config_merge_new(spark, sf_dir):
    return _merged(spark, sf_dir, "new")


@query(f"({_SAVED}) EXCEPT ({_NOW})")
def config_merge_extra(spark, sf_dir):
    return _merged(spark, sf_dir, "extra")


_LINE = "'read /home/u' || CAST(page_id AS {}) || '/in/data.csv, for a.b' || CAST(page_id AS {}) || '@mail.example.com from ' || url"


@query(
    "SELECT page_id, regexp_replace(regexp_replace("
    + _LINE.format("VARCHAR", "VARCHAR")
    + r""", '/(?:home|Users|tmp|var|etc|opt|mnt|data)/(?:[^\s,;"''/]*/)*([^\s,;"''/]+)/*', '\1', 'g'), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+', '[REDACTED_EMAIL]', 'g') AS line FROM pages"""
)
def log_scrub(spark, sf_dir):
    return raw(spark, sf_dir, "pages").select("page_id", N.scrub_column(F.expr(_LINE.format("STRING", "STRING"))).alias("line"))


_BAD = r"""[<>:"/\\|?*\x00-\x1f]"""


@query(rf"""SELECT page_id, coalesce(nullif(trim(regexp_replace(replace(url, '..', ''), '{_BAD}', '_', 'g'), '_'), ''), 'table') AS as_table, coalesce(nullif(trim(regexp_replace(url, '{_BAD}', '_', 'g'), '_'), ''), 'column') AS as_column FROM pages""")
def name_sanitize(spark, sf_dir):
    return raw(spark, sf_dir, "pages").select("page_id", N.table_name_column(F.col("url")).alias("as_table"), N.column_name_column(F.col("url")).alias("as_column"))


_EVENT_EDGES = "SELECT DISTINCT CASE WHEN user_id % {m} = 0 THEN 'other' ELSE event_type END AS parent_table, CAST(user_id % 7 AS {s}) AS parent_column, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'child' END AS child_table, CAST(user_id % 3 AS {s}) AS child_column FROM {t}"


@query("SELECT *, 'added' AS change FROM ((SELECT * FROM (" + _EVENT_EDGES.format(t="events", m=2, s="VARCHAR") + ") WHERE parent_table <> child_table) EXCEPT (" + _EVENT_EDGES.format(t="events", m=3, s="VARCHAR") + ")) UNION ALL SELECT *, 'removed' FROM ((" + _EVENT_EDGES.format(t="events", m=3, s="VARCHAR") + ") EXCEPT (" + _EVENT_EDGES.format(t="events", m=2, s="VARCHAR") + "))")
def relationship_changes(spark, sf_dir):
    events = raw(spark, sf_dir, "events")
    edges = lambda m: spark.sql(_EVENT_EDGES.format(t="{events}", m=m, s="STRING"), events=events)
    changes = review.edge_changes(edges(3), edges(2))
    return changes["added"].withColumn("change", F.lit("added")).unionByName(changes["removed"].withColumn("change", F.lit("removed")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END FROM customer)")
def stream_fk_integrity(spark, sf_dir):
    parents = raw(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END AS c_custkey")
    return stream_orphans(spark, f"{sf_dir}/orders.parquet", "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


_SET = ("nation", "customer", "orders")


def _synthesis(spark, sf_dir):
    views = renamed(spark, sf_dir, "region", *_SET)
    return views, discover.analyze(views)


@query("SELECT (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM orders) AS n_references, 0::BIGINT AS n_orphans, true AS hot_first, true AS as_often")
def fk_stitch_properties(spark, sf_dir):
    """What assigned references must have: every row one, of a parent that exists, the most frequent parent as often as the original's most frequent value (within six deviations)."""
    made = fk_stitch(spark, sf_dir)
    parents = raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    often = made.groupBy("customer_id").count()
    most = raw(spark, sf_dir, "orders").groupBy("o_custkey").count().agg(F.max("count")).scalar()
    first = often.filter("customer_id = 1").agg(F.coalesce(F.max("count"), F.lit(0))).scalar()
    lost = made.join(parents, "customer_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    one = spark.range(1).select(made.agg(F.count(F.lit(1))).scalar().alias("n_rows"), made.agg(F.count("customer_id")).scalar().alias("n_references"), lost.alias("n_orphans"), most.alias("m"), first.alias("first"), often.agg(F.max("count")).scalar().alias("top"))
    return one.select("n_rows", "n_references", "n_orphans", (F.col("first") >= F.col("m") - 6 * F.sqrt("m")).alias("hot_first"), (F.col("top") <= F.col("m") + 6 * F.sqrt("m") + 6).alias("as_often"))


@query()
def fk_stitch(spark, sf_dir):
    views, _ = _synthesis(spark, sf_dir)
    child = views["orders"].withColumn("_row", F.col("order_id"))
    parent = views["customer"].withColumn("_row", F.col("customer_id"))
    return stitch.stitch(child, "customer_id", parent, "customer_id", "_row", 7, views["orders"]).select("order_id", "customer_id")


@query()
def text_fill(spark, sf_dir):
    views, analysis = _synthesis(spark, sf_dir)
    df = views["customer"].withColumn("_row", F.col("customer_id"))
    return synthesize.fill_text({"customer": df}, analysis, 7)["customer"].select("customer_id", "customer_name")


@query()
def preview_rows(spark, sf_dir):
    views, analysis = _synthesis(spark, sf_dir)
    return preview.preview("orders", analysis, views, 50, seed=7)


@query("SELECT 50::BIGINT AS n_rows, 50::BIGINT AS n_keys, 0::BIGINT AS n_orphans, 0::BIGINT AS n_other_statuses, 0::BIGINT AS n_out_of_range")
def preview_properties(spark, sf_dir):
    """What a preview must have: row numbers as keys, references, categories and numbers of the source."""
    made = preview_rows(spark, sf_dir)
    orders = raw(spark, sf_dir, "orders")
    lost = made.join(raw(spark, sf_dir, "customer"), F.col("customer_id") == F.col("c_custkey"), "left_anti")
    other = made.join(orders.select(F.col("o_orderstatus").alias("s")).distinct(), F.col("o_orderstatus") == F.col("s"), "left_anti")
    low, high = (orders.agg(f("o_totalprice")).scalar() for f in (F.min, F.max))
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    keys = made.agg(F.count_distinct(F.when(F.col("order_id").between(1, 50), F.col("order_id")))).scalar()
    out = made.filter((F.col("o_totalprice") < low - 0.01) | (F.col("o_totalprice") > high + 0.01))
    return spark.range(1).select(count(made).alias("n_rows"), keys.alias("n_keys"), count(lost).alias("n_orphans"), count(other).alias("n_other_statuses"), count(out).alias("n_out_of_range"))


@query()
def copula_sample(spark, sf_dir):
    views = renamed(spark, sf_dir, "part")
    model = copula.fit(views["part"].drop("part_id", "p_name"))
    return copula.sample(spark.range(views["part"].count()).withColumnRenamed("id", "_row"), "_row", model, 7, "part").drop("_row")


@query()
def hma_sample(spark, sf_dir):
    views, analysis = _synthesis(spark, sf_dir)
    return synthesize.synthesize(analysis, views, 0.5, seed=7, method="hma")["orders"]


@query()
def per_table_sample(spark, sf_dir):
    views, analysis = _synthesis(spark, sf_dir)
    return synthesize.synthesize(analysis, views, 0.5, seed=7, method="per_table", anonymize_dimensions=True)["orders"]


@query()
def validation_report(spark, sf_dir):
    views, analysis = _synthesis(spark, sf_dir)
    made = synthesize.synthesize(analysis, views, 0.2, seed=7, method="per_table")
    lines = validate.validate(analysis, made, views, 0.2).summary()
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")


@query(
    _roles_sql()
    + """, place AS (SELECT DISTINCT table_name, place FROM cols), line AS (SELECT 0 AS a, 0 AS b, 0 AS c, 'erDiagram' AS line
      UNION ALL SELECT 1, p.place * 100 + k.place, c.ordinal, '    ' || parent_table || ' ||--o{ ' || child_table || ' : "' || parent_column || ' to ' || child_column || '"' FROM edges JOIN place p ON p.table_name = child_table JOIN place k ON k.table_name = parent_table
      JOIN cols c ON c.table_name = child_table AND c.column_name = child_column
      UNION ALL SELECT 2, row_number() OVER (ORDER BY table_name), 0, '    ' || table_name FROM place WHERE table_name NOT IN (SELECT parent_table FROM edges UNION SELECT child_table FROM edges))
    SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS line_no, line FROM line"""
)
def er_diagram(spark, sf_dir):
    return spark.createDataFrame([(i, x) for i, x in enumerate(review.er_diagram(discover.analyze(renamed(spark, sf_dir))).split("\n"))], "line_no long, line string")


# ---- what drawn tables must have

_PLANTED = """p AS (SELECT c_custkey AS customer_id, c_acctbal AS balance, c_mktsegment AS segment FROM customer),
    c AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, 0.8 * (balance - 4500) / 3200 + 0.6 * (o_totalprice - 250000) / 144000 AS amount, CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority ELSE segment END AS label FROM orders JOIN p ON customer_id = o_custkey)"""


@query(
    f"""WITH {_PLANTED}, often AS (SELECT customer_id, count(*) AS n FROM c GROUP BY 1)
    SELECT round(5 * (SELECT corr(balance, amount) FROM c JOIN p USING (customer_id))) / 5 AS correlation, 0::BIGINT AS n_orphans, true AS as_many_rows, round(10 * (SELECT count(*) FROM often) / (SELECT count(*) FROM p)) / 10 AS share_with_children, true AS counts_occur"""
)
def hma_properties(spark, sf_dir):
    """Children follow their parents: a planted correlation comes back through the references, and parents have as many children as originals have."""
    customer, orders = raw(spark, sf_dir, "customer"), raw(spark, sf_dir, "orders")
    tables = {"p": customer.selectExpr("c_custkey AS customer_id", "c_acctbal AS balance", "c_mktsegment AS segment")}
    own = orders.join(tables["p"], F.col("o_custkey") == F.col("customer_id"))
    tables["c"] = own.selectExpr("o_orderkey AS order_id", "customer_id", "0.8 * (balance - 4500) / 3200 + 0.6 * (o_totalprice - 250000) / 144000 AS amount", "CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority ELSE segment END AS label")
    edge = Relationship("p", "customer_id", "c", "customer_id", 1.0)
    kinds = {"p": [("customer_id", "id", Role.PRIMARY_KEY), ("balance", "numerical", Role.MEASURE), ("segment", "categorical", Role.DIMENSION)], "c": [("order_id", "id", Role.PRIMARY_KEY), ("customer_id", "id", Role.FOREIGN_KEY), ("amount", "numerical", Role.MEASURE), ("label", "categorical", Role.DIMENSION)]}
    metas = {t: Table(t, "", tables[t].count(), {c: Column(c, sdtype=k, role=r, is_primary_key=r == Role.PRIMARY_KEY) for c, k, r in columns}, columns[0][0]) for t, columns in kinds.items()}
    made = synthesize.synthesize(Analysis(metas, [edge]), tables, 1.0, seed=7, method="hma")
    children, _ = ranking.stored(made["c"])
    parents, _ = ranking.stored(made["p"])
    met = children.join(parents, "customer_id")
    often = children.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    known = tables["c"].groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).select("n").distinct()
    number = lambda df, e: df.agg(e).scalar()
    one = spark.range(1).select(
        (F.round(5 * number(met, F.corr("balance", "amount"))) / 5).alias("correlation"),
        number(children.join(parents, "customer_id", "left_anti"), F.count(F.lit(1))).alias("n_orphans"),
        (F.abs(number(children, F.count(F.lit(1))) - metas["c"].row_count) <= 0.1 * metas["c"].row_count).alias("as_many_rows"),
        (F.round(10 * number(often, F.count(F.lit(1))) / number(parents, F.count(F.lit(1)))) / 10).alias("share_with_children"),
        (number(often.join(known, "n", "left_anti"), F.count(F.lit(1))) == 0).alias("counts_occur"),
    )
    return one


@query(
    """SELECT (SELECT count(*) FROM part) AS n_rows, 0::BIGINT AS n_other_brands, 0::BIGINT AS n_other_types, 0::BIGINT AS n_out_of_range, true AS medians_near, true AS brands_as_often"""
)
def copula_properties(spark, sf_dir):
    """What a modelled table must have: values of its categories, numbers within their range and about the median, the most frequent brand about as often."""
    made, _ = ranking.stored(copula_sample(spark, sf_dir))
    part = raw(spark, sf_dir, "part")
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    other = lambda c: count(made.join(part.select(c).distinct(), c, "left_anti"))
    low, high, middle, dev = part.agg(F.min("p_retailprice"), F.max("p_retailprice"), F.percentile("p_retailprice", 0.5), F.stddev("p_retailprice")).first()
    n = part.count()
    often = lambda df: df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    far = often(made).withColumnRenamed("n", "m").join(often(part), "p_brand").filter(F.abs(F.col("m") - F.col("n")) > 6 * F.sqrt(2 * F.col("n")) + 6)
    out = made.filter((F.col("p_retailprice") < low - 0.01) | (F.col("p_retailprice") > high + 0.01))
    median = made.agg(F.percentile("p_retailprice", 0.5)).scalar()
    return spark.range(1).select(count(made).alias("n_rows"), other("p_brand").alias("n_other_brands"), other("p_type").alias("n_other_types"), count(out).alias("n_out_of_range"), (F.abs(median - middle) <= F.lit(6 * 1.26 * dev / n**0.5 + 0.02 * dev)).alias("medians_near"), (count(far) == 0).alias("brands_as_often"))


@query("SELECT greatest(1, CAST(trunc(count(*) * 0.5::DOUBLE) AS BIGINT)) AS n_rows, greatest(1, CAST(trunc(count(*) * 0.5::DOUBLE) AS BIGINT)) AS n_keys, 0::BIGINT AS n_null_references, true AS dates_within, count(DISTINCT o_orderstatus) >= 1 AS labels_are_new FROM orders")
def per_table_properties(spark, sf_dir):
    """What a table modelled on its own must have: as many rows and keys as asked for, references, dates of the source's range, relabelled dimensions."""
    made, _ = ranking.stored(per_table_sample(spark, sf_dir))
    orders = raw(spark, sf_dir, "orders")
    low, high = (orders.agg(f("o_orderdate")).scalar() for f in (F.min, F.max))
    old = made.join(orders.select("o_orderstatus").distinct(), "o_orderstatus", "left_anti").agg(F.count(F.lit(1))).scalar()
    n = made.agg(F.count(F.lit(1))).scalar()
    one = lambda e: made.agg(e).scalar()
    return spark.range(1).select(n.alias("n_rows"), one(F.count_distinct("order_id")).alias("n_keys"), one(F.count_if(F.col("customer_id").isNull())).alias("n_null_references"), ((one(F.min("order_date")) >= low) & (one(F.max("order_date")) <= high)).alias("dates_within"), (old == n).alias("labels_are_new"))


@query("SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys, 0::BIGINT AS n_null, 0::BIGINT AS n_from_source, true AS many_names FROM customer")
def text_fill_properties(spark, sf_dir):
    """What made-up text must be: one for every row, none of the source, many of them."""
    made = text_fill(spark, sf_dir)
    real = raw(spark, sf_dir, "customer").select(F.col("c_name").alias("customer_name")).distinct()
    one = lambda df, e: df.agg(e).scalar()
    return spark.range(1).select(one(made, F.count(F.lit(1))).alias("n_rows"), one(made, F.count_distinct("customer_id")).alias("n_keys"), one(made, F.count_if(F.col("customer_name").isNull())).alias("n_null"), one(made.join(real, "customer_name", "left_semi"), F.count(F.lit(1))).alias("n_from_source"), (one(made, F.count_distinct("customer_name")) >= 50).alias("many_names"))
