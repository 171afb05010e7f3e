"""Connected components of a link table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import dropped, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the least of the node and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a")).filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the least of those neighbours."""
    down = links.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a > b
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b"), F.col("m").alias("a"))
    return moved.unionByName(least.select(F.col("a").alias("b"), F.col("m").alias("a"))).distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, name: str = "components") -> tuple[DataFrame, str]:
    """links: columns a, b (long, not null). Returns node, component: the least node that each one reaches, for every node of a link with a != b;
    and the scratch table that this reads.

    Each round is two small shuffles, written to the shared folder; the rounds end when the table no longer changes, after
    about the logarithm of the longest chain. Hot nodes are pre-aggregated; the join on them is one that AQE can split.
    """
    spark = links.sparkSession
    now, path = stored(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    state = _digest(now)
    while state[0]:
        after, new = stored(_small_star(_large_star(now)).select("a", "b"), name)
        dropped(spark, path)
        now, path, last = after, new, state
        state = _digest(now)
        if state == last:
            break
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), path
