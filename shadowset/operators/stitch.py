"""Weighted reference assignment: synthetic children point to synthetic parents as often as the originals did.

Ranks and cumulative weights are computed over ranges and blocks, so neither parents nor frequencies need to fit one task. A draw
is an equi-join with an alias table: every parent has one cell, which holds its own key up to a share and another parent's above it.
A row meets one cell, all cells are drawn alike, and a parent of half the weight is the other of many cells, but no key of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shadowset.functions import random as R
from shadowset.models import Analysis
from shadowset.plans.ranking import cut, with_fills, with_prefixes, with_rank

#: Cells of [0, 1) at least, and at most for each span.
LEAST_CELLS = 1 << 12


def cells_for(spans: int) -> int:
    """A power of two of cells, one or two for each span, so that a row meets few spans whatever their number."""
    return max(LEAST_CELLS, 1 << max(0, spans - 1).bit_length())


def frequencies(original: DataFrame, column: str) -> DataFrame:
    """v, n, j: the non-null values with their counts, ranked by count (ties by value) from 0."""
    c = F.col(f"`{column}`")
    counts = original.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return with_rank(counts, [F.col("n").desc(), F.col("v")], "j")


def weights(ranked: DataFrame, parents: int) -> DataFrame:
    """i, w: a weight for each parent index. With fewer parents than values the weights of values with one remainder add up, with more they repeat."""
    values = ranked.count()
    if not values:
        return ranked.sparkSession.range(parents).select(F.col("id").alias("i"), F.lit(1).cast("long").alias("w"))
    if parents <= values:
        return ranked.groupBy((F.col("j") % parents).alias("i")).agg(F.sum("n").alias("w"))
    every = ranked.sparkSession.range(parents).select(F.col("id").alias("i"), (F.col("id") % values).alias("j"))
    return every.join(ranked.select("j", F.col("n").alias("w")), "j").select("i", "w")


def drawn_values(df: DataFrame, u: str, spans: DataFrame | list[tuple], n: int, name: str, kind: T.DataType | None = None, middle: str | None = None) -> DataFrame:
    """df with column name: the v of the span [lo, hi) that holds the number u. The spans follow each other and fill [0, 1); n: how many there are.
    middle: the name of a further column for the span's middle.

    Each cell of [0, 1) knows the spans that begin in it and the one that it begins in, so a row meets few spans whatever their
    number. A list of spans (with the type of v) becomes cells on the driver. In a table the span in force is carried on from cell to
    cell, so that a wide span is spread over as many tasks as its cells are.
    """
    cells, spark = cells_for(n), df.sparkSession
    cell = lambda c: F.floor(c * cells).cast("long")
    if isinstance(spans, list):
        rows = [(b, v, lo, hi) for v, lo, hi in spans if hi > lo for b in range(min(int(lo * cells), cells - 1), min(int(hi * cells), cells - 1) + 1)]
        known = T.StructType([T.StructField("_b", T.LongType()), T.StructField(name, kind), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())])
        values = F.broadcast(spark.createDataFrame(rows, known))  # as many as there are cells and spans of the list
    else:
        span = F.struct(F.col("v"), F.col("lo"), F.col("hi"))
        begun = spans.filter("hi > lo").select(F.least(cell(F.col("lo")), F.lit(cells - 1)).alias("_b"), F.col("lo").alias("_at"), span.alias("_s"))
        edges = spark.range(cells).select(F.col("id").alias("_b"), (F.col("id") / cells).alias("_at"), F.lit(None).cast(begun.schema["_s"].dataType).alias("_s"))
        filled = with_fills(begun.unionByName(edges).withColumn("_e", F.col("_s").isNull()), ["_b", "_at", "_e"], {"_in": (F.col("_s"), False)})
        values = filled.select("_b", F.col("_in.v").alias(name), F.col("_in.lo").alias("_lo"), F.col("_in.hi").alias("_hi")).filter("_lo is not null").dropDuplicates(["_b", "_lo"])
    # a key that can be null is filtered below the join, where u's whole expression would be written out once for every use
    asked = df.withColumn(u, F.greatest(F.least(F.col(u), F.lit(1 - 2.0**-53)), F.lit(0.0))).withColumn("_b", F.coalesce(cell(F.col(u)), F.lit(0).cast("long")))
    met = asked.join(values, "_b").filter(f"{u} >= _lo and {u} < _hi")
    return (met.withColumn(middle, (F.col("_lo") + F.col("_hi")) / 2) if middle else met).drop("_b", "_lo", "_hi")


def alias_cells(weighted: DataFrame) -> tuple[DataFrame, int]:
    """The alias table of i, w, v (i gapless from 0): cell, share, own, other; and how many cells there are.

    Every value has the cell of its index. Values below the mean weight are light: their cell lacks something, which a heavy value
    gives. In the order of the indexes, lights lie where the deficits before them end and heavies where the excesses up to them end;
    a light is filled by the next heavy, and a heavy that has given more than its excess is itself filled by the next one. So the two
    sequences are merged and the nearest neighbours carried along, range by range; no value is joined with all that it fills.
    Weights are whole numbers, times the number of cells decimals of 38 digits, so the table does not depend on the partitions.
    """
    weighted = cut(weighted)
    total, n = weighted.agg(F.sum("w"), F.count(F.lit(1))).first()
    whole = "decimal(38,0)"
    mean = F.lit(total or 0).cast(whole)
    grown = weighted.withColumn("_w", (F.col("w").cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)")).cast(whole))
    none = F.lit(0).cast(whole)
    grown = grown.withColumn("_d", F.greatest((mean - F.col("_w")).cast(whole), none)).withColumn("_x", F.greatest((F.col("_w") - mean).cast(whole), none))
    summed = with_prefixes(grown, "i", {"_db": "_d", "_xb": "_x"})
    light, heavy = F.col("_d") > 0, F.col("_x") > 0
    at = F.when(heavy, F.col("_xb") + F.col("_x")).otherwise(F.col("_db")).cast(whole)
    merged = summed.withColumn("_at", at).withColumn("_h", heavy)
    filled = with_fills(merged, ["_at", "_h", "i"], {"_lack": (F.when(light, (F.col("_db") + F.col("_d")).cast(whole)), False), "_giver": (F.when(heavy, F.struct("v")), True)})
    kept = F.when(light, F.col("_w")).when(heavy & (F.col("_lack") > F.col("_at")), mean + F.col("_at") - F.col("_lack")).otherwise(mean)
    return filled.select(F.col("i").alias("cell"), (kept.cast("double") / mean.cast("double")).alias("share"), F.col("v").alias("own"), F.coalesce(F.col("_giver.v"), F.col("v")).alias("other")), n


def drawn(rows: DataFrame, row: str, weighted: DataFrame, seed: int, stream: str, name: str = "_v") -> DataFrame:
    """rows with column name: the v of weighted (i, w, v), drawn by weight w, with replacement."""
    cells, n = alias_cells(weighted)
    asked = rows.withColumn("_cell", R.integer(F.col(row), seed, f"{stream}/cell", n)).withColumn("_u", R.uniform(F.col(row), seed, stream))
    value = F.when(F.col("_u") < F.col("share"), F.col("own")).otherwise(F.col("other"))
    return asked.join(cells.withColumnRenamed("cell", "_cell"), "_cell").withColumn(name, value).drop("_cell", "_u", "share", "own", "other")


def stitch(child: DataFrame, column: str, parent: DataFrame, key: str, row: str, seed: int, original: DataFrame | None = None) -> DataFrame:
    """child with column drawn anew from the parent's keys, by the original's frequencies and share of NULLs. row: a row id of both."""
    ids = parent.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min(row).alias("_at"))
    indexed = with_rank(ids, ["_at", "_key"], "_i").select("_i", "_key")
    n = indexed.count()
    if not n:
        return child
    stream = f"stitch/{column}/{key}"
    nulls = 0.0
    known = original is not None and column in original.columns
    if known:
        nulls = original.agg(F.avg(F.col(f"`{column}`").isNull().cast("int"))).first()[0] or 0.0
    weighted = weights(frequencies(original, column), n) if known else child.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(1).cast("long").alias("w"))
    weighted = weighted.join(indexed.select(F.col("_i").alias("i"), F.col("_key").alias("v")), "i")
    out = drawn(child, row, weighted, seed, stream, "_key")
    value = F.when(R.uniform(F.col(row), seed, stream + "/null") >= nulls, F.col("_key")) if nulls else F.col("_key")
    return out.withColumn(column, value).select(*(f"`{c}`" for c in child.columns))


def with_nulls(child: DataFrame, column: str, row: str, seed: int, original: DataFrame | None) -> DataFrame:
    """child with as large a share of NULL in column as the original has, in place of references that it keeps."""
    if original is None or column not in original.columns:
        return child
    nulls = original.agg(F.avg(F.col(f"`{column}`").isNull().cast("int"))).first()[0] or 0.0
    return child.withColumn(column, F.when(R.uniform(F.col(row), seed, f"stitch/{column}/null") >= nulls, F.col(f"`{column}`"))) if nulls else child


def stitch_all(tables: dict[str, DataFrame], analysis: Analysis, row: str, seed: int, originals: dict[str, DataFrame], kept: set[tuple] = frozenset()) -> dict[str, DataFrame]:
    """Every relationship in order; of two on one column the later one holds. kept: edges whose references were made with the child's rows and stay."""
    out = dict(tables)
    for r in analysis.relationships:
        child, parent = out.get(r.child_table), out.get(r.parent_table)
        if child is not None and parent is not None and r.child_column in child.columns and r.parent_column in parent.columns:
            if r.edge in kept:
                out[r.child_table] = with_nulls(child, r.child_column, row, seed, originals.get(r.child_table))
                continue
            out[r.child_table] = stitch(child, r.child_column, parent, r.parent_column, row, seed, originals.get(r.child_table))
    return out
