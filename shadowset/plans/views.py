"""Views over the test tables whose names let the discovery rules work, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "region": ("region", ["r_regionkey AS region_id", "r_name AS region_name"]),
    "nation": ("nation", ["n_nationkey AS nation_id", "n_name AS nation_name", "n_regionkey AS region_id"]),
    "customer": ("customer", ["c_custkey AS customer_id", "c_name AS customer_name", "c_nationkey AS nation_id", "c_acctbal", "c_mktsegment"]),
    "supplier": ("supplier", ["s_suppkey AS supplier_id", "s_name AS supplier_name", "s_nationkey AS nation_id", "s_acctbal"]),
    "part": ("part", ["p_partkey AS part_id", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "orders": ("orders", ["o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderstatus", "o_totalprice", "o_orderdate AS order_date", "o_orderpriority"]),
    "lineitem": (
        "lineitem",
        ["l_orderkey AS order_id", "l_partkey AS part_id", "l_suppkey AS supplier_id", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    ),
    "orders_str": ("orders", ["o_orderkey AS order_key", "CAST(o_custkey AS STRING) AS customer_id"]),
}


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def renamed(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {v: raw(spark, sf_dir, VIEWS[v][0]).selectExpr(*VIEWS[v][1]) for v in names or VIEWS}


def renamed_sql() -> str:
    """The views as common table expressions v_<name>."""
    return "WITH " + ", ".join(f"v_{v} AS (SELECT {', '.join(c.replace('STRING', 'VARCHAR') for c in columns)} FROM {table})" for v, (table, columns) in VIEWS.items())


def columns_of(view: str) -> list[str]:
    return [c.split(" AS ")[-1] for c in VIEWS[view][1]]
