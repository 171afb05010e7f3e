"""Gaussian copula models of tables: fitted by aggregates, sampled as column expressions over spark.range.

A model holds per column a marginal (quantiles of numbers and times, a table of the intervals of all values of anything else)
and the correlations of normal scores. On the driver it is bounded by the number of columns and the parameters here, not by
the rows: scores and draws are joins with the intervals, which stay a distributed table above VALUES values. Sampling
draws independent normals by row id, mixes them with the Cholesky factor and maps them through the marginals, all in the JVM.
A column of one value, of none or of one row has no spread and so no correlation. A child's model can be that on condition of its
parent's scores: slopes on them, and the rest of the variation by the Schur complement of the joint correlations.

Constraints: of an ordered date pair the low column and the non-negative gap are modelled; the columns of a dimension group
are modelled as one composite value, so that only combinations that exist are drawn. Numbers are interpolated between
quantiles and so need not be source values; values of categories are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shadowset.functions import random as R
from shadowset.models import Analysis, DateOrder, DimensionGroup
from shadowset.operators.stitch import drawn_values
from shadowset.plans.ranking import cut, with_prefix, with_rank

QUANTILES, VALUES, ACCURACY = 101, 1000, 10_000
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def normal_cdf(x: Column) -> Column:
    """Zelen and Severo's approximation (26.2.17 in Abramowitz and Stegun), within 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """Odeh and Evans' approximation, within 1.5e-8."""
    q = F.least(F.when(p < 0.5, p).otherwise(1 - p), F.lit(0.5))
    t = F.sqrt(-2 * F.log(F.greatest(q, F.lit(1e-18))))
    top = -0.322232431088 + t * (-1.0 + t * (-0.342242088547 + t * (-0.0204231210245 + t * -0.453642210148e-4)))
    low = 0.0993484626060 + t * (0.588581570495 + t * (0.531103462366 + t * (0.103537752850 + t * 0.38560700634e-2)))
    z = t + top / low
    return F.when(p < 0.5, -z).otherwise(z)


@dataclass
class Marginal:
    """nulls: share of NULL. Numbers have quantiles; other columns have spans, a table of all their n known values: v, lo, hi; few: the same as a list, of at most VALUES."""

    type: T.DataType
    nulls: float = 0.0
    quantiles: list[float] = field(default_factory=list)
    decimals: int | None = None
    spans: DataFrame | None = None
    few: list[tuple] | None = None
    n: int = 0
    exact: bool = False

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, (*_NUMBERS, *_TIMES)) and not self.exact


@dataclass
class Model:
    columns: list[str]
    marginals: dict[str, Marginal]
    factor: np.ndarray
    orders: list[DateOrder]
    groups: dict[str, list[str]]
    schema: T.StructType
    #: s0, s1, ... of the rows that the model was fitted on, by _key (only if fit was asked to keep one)
    scored: DataFrame | None = None
    #: of a model given a parent's scores: the slopes on them (columns x parent's columns), and their means and deviations
    slopes: np.ndarray | None = None
    means: np.ndarray | None = None
    deviations: np.ndarray | None = None


def _number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        c = c.cast("timestamp")
    return F.unix_micros(c).cast("double") if isinstance(kind, _TIMES) else c.cast("double")


def _from_number(c: Column, m: Marginal) -> Column:
    if isinstance(m.type, T.DateType):
        return F.date_from_unix_date(F.round(c).cast("int"))
    if isinstance(m.type, _TIMES):
        return F.timestamp_micros(F.round(c).cast("long")).cast(m.type)
    if isinstance(m.type, (T.FloatType, T.DoubleType)):
        return (F.round(c, m.decimals) if m.decimals is not None else c).cast(m.type)
    return F.round(c).cast(m.type)


def _prepared(df: DataFrame, orders: list[DateOrder], groups: list[DimensionGroup]) -> tuple[DataFrame, dict[str, list[str]], list[DateOrder]]:
    """df with gaps in place of high columns and composites in place of groups."""
    used: set[str] = set()
    taken = []
    for d in orders:
        kinds = [df.schema[c].dataType for c in (d.low_column, d.high_column) if c in df.columns]
        if len(kinds) == 2 and all(isinstance(k, _TIMES) for k in kinds) and kinds[0] == kinds[1] and d.high_column not in used:
            used.add(d.high_column)
            taken.append(d)
            low, high = (_number(F.col(f"`{c}`"), kinds[0]) for c in (d.low_column, d.high_column))
            df = df.withColumn(f"_gap_{d.high_column}", F.greatest(high - low, F.lit(0.0)))
    df = df.drop(*used)
    composites: dict[str, list[str]] = {}
    for i, g in enumerate(groups):
        names = [c for c in g.column_names if c in df.columns]
        if len(names) > 1:
            composites[f"_group_{i}"] = names
            df = df.withColumn(f"_group_{i}", F.struct(*(F.col(f"`{c}`") for c in names))).drop(*names)
    return df, composites, taken


def fit(df: DataFrame, orders: list[DateOrder] = (), groups: list[DimensionGroup] = (), skip: list[str] = (), exact: list[str] = (), key: str | None = None, given: DataFrame | None = None, on: str | None = None) -> Model:
    """Marginals and correlations of df's columns but those in skip. exact: numbers drawn from their own values only, in their order.

    key: a column by which the model keeps the rows' scores, for models of children. given, on: a parent's scores by _key, and df's
    reference to it; the model is then that of df's columns on condition of the parent's scores.
    """
    schema = df.schema
    hidden = {"_key": key, "_on": on if given is not None else None}
    work, composites, orders = _prepared(df.withColumns({h: F.col(f"`{c}`") for h, c in hidden.items() if c}).drop(*skip), list(orders), list(groups))
    columns = [c for c in work.columns if c not in hidden]
    marginals = {c: Marginal(work.schema[c].dataType, exact=c in exact) for c in columns}
    asked = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        col, m = F.col(f"`{c}`"), marginals[c]
        asked.append(F.count(col).alias(f"k{i}"))
        if m.numeric:
            v = _number(col, m.type)
            v = F.when(~F.isnan(v) & (F.abs(v) < math.inf), v)
            asked.append(F.percentile_approx(v, [j / (QUANTILES - 1) for j in range(QUANTILES)], ACCURACY).alias(f"q{i}"))
            if isinstance(m.type, (T.FloatType, T.DoubleType)):
                asked += [F.bool_and(v == F.round(v, d)).alias(f"d{d}_{i}") for d in (0, 2)]
    row = work.agg(*asked).first().asDict()
    for i, c in enumerate(columns):
        m, known = marginals[c], row[f"k{i}"]
        m.nulls = 1 - known / row["rows"] if row["rows"] else 1.0
        if m.numeric:
            m.quantiles = [float(x) for x in row[f"q{i}"] or ()]
            m.decimals = next((d for d in (0, 2) if row.get(f"d{d}_{i}")), None)
        elif known:
            m.spans, m.few, m.n = _spans(work, c, known, m.exact)
    scored = _scored(work, columns, marginals, [h for h, c in hidden.items() if c])
    if given is not None:
        scored = cut(scored)  # read for the columns' own correlations and for those with the parent's
    model = Model(columns, marginals, np.eye(len(columns)), orders, composites, schema, scored.drop("_on") if key else None)
    own = correlations(*_moments(scored, len(columns)))
    if given is None:
        model.factor = factor(own)
    else:
        _condition(model, own, scored, given)
    return model


def _spans(work: DataFrame, c: str, total: int, by_value: bool) -> tuple[DataFrame, list[tuple] | None, int]:
    """v, lo, hi: the part of [0, 1) of each known value, as wide as its share, the most frequent first or by value; the same as a list, if short; and how many there are."""
    counts = work.filter(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("v")] if by_value else [F.desc("n"), F.col("v").cast("string")]
    few = counts.orderBy(*order).limit(VALUES + 1).collect()
    if len(few) <= VALUES:
        ends = list(itertools.accumulate(r["n"] for r in few))
        kind = T.StructType([T.StructField("v", counts.schema["v"].dataType), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
        rows = [(r["v"], (e - r["n"]) / total, e / total) for r, e in zip(few, ends, strict=True)]
        return work.sparkSession.createDataFrame(rows, kind), rows, len(few)
    sums = cut(with_prefix(with_rank(counts, order, "i"), "i", "n", "lo").select("v", (F.col("lo") / total).alias("lo"), ((F.col("lo") + F.col("n")) / total).alias("hi")))
    return sums, None, sums.count()


def _normal_score(u: Column) -> Column:
    return normal_quantile(F.greatest(F.least(u, F.lit(1 - 1e-4)), F.lit(1e-4)))


def _scored(work: DataFrame, columns: list[str], marginals: dict[str, Marginal], keep: list[str] = ()) -> DataFrame:
    """s0, s1, ...: the normal score of each column's value, of its middle rank. keep: further columns of work."""
    values, sorted_ = [], {}
    for i, c in enumerate(columns):
        m, col = marginals[c], F.col(f"`{c}`")
        if m.spans is not None:
            middle = m.spans.select(F.col("v").alias(f"_v{i}"), _normal_score((F.col("lo") + F.col("hi")) / 2).alias(f"s{i}"))
            work = work.join(F.broadcast(middle) if m.few else middle, col == F.col(f"_v{i}"), "left")
            values.append(F.col(f"s{i}"))
        elif m.quantiles:
            sorted_[i] = np.array(m.quantiles)
            values.append(_number(col, m.type).alias(f"s{i}"))
        else:
            values.append(F.lit(None).cast("double").alias(f"s{i}"))
    ready = work.select(*keep, *values)
    if not sorted_:
        return ready
    ranks = np.array([NormalDist().inv_cdf(max(1e-4, min(1 - 1e-4, r / (2 * QUANTILES)))) for r in range(2 * QUANTILES + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            for i, q in sorted_.items():
                at = len(keep) + i
                x = arrays[at].fill_null(0.0).to_numpy(zero_copy_only=False)
                rank = np.searchsorted(q, x, "left") + np.searchsorted(q, x, "right")
                arrays[at] = pa.array(ranks[rank], mask=arrays[at].is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return ready.mapInArrow(run, ready.schema)


def _summed(df: DataFrame, make: Callable[[pa.RecordBatch], list[np.ndarray]], shape: tuple[int, int], parts: int) -> list[np.ndarray]:
    """Sums over all rows of matrices that make() gives for a batch of them: added up in each task, then by place."""
    rows, columns = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(shape) for _ in range(parts)]
        for batch in batches:
            for t, m in zip(total, make(batch), strict=True):
                t += m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows * columns)), *(pa.array(t.ravel()) for t in total)], names=["at", *(f"m{i}" for i in range(parts))])

    said = df.mapInArrow(run, "at long, " + ", ".join(f"m{i} double" for i in range(parts)))
    out = [np.zeros(rows * columns) for _ in range(parts)]
    for r in said.groupBy("at").agg(*(F.sum(f"m{i}").alias(f"m{i}") for i in range(parts))).collect():  # a row per pair of columns
        for i in range(parts):
            out[i][r["at"]] = r[f"m{i}"]
    return [o.reshape(shape) for o in out]


def _values(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The columns as a matrix with 0 for NULL, and where they are known."""
    x = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1) if names else np.zeros((len(batch), 0))
    known = np.isfinite(x)
    return np.where(known, x, 0.0), known.astype(float)


def _moments(scored: DataFrame, k: int) -> list[np.ndarray]:
    """For each pair (i, j) over the rows that have both: their number, the sums of s_i, of its square and of s_i * s_j."""

    def make(batch: pa.RecordBatch) -> list[np.ndarray]:
        x, known = _values(batch, [f"s{i}" for i in range(k)])
        return [known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x]

    return _summed(scored.select(*(f"s{i}" for i in range(k))), make, (k, k), 4) if k else [np.zeros((0, 0))] * 4


def correlations(n: np.ndarray, one: np.ndarray, two: np.ndarray, both: np.ndarray, other: np.ndarray | None = None, other_two: np.ndarray | None = None) -> np.ndarray:
    """From sums over pairs: n, of x_i, of its square, of x_i * y_j; other, other_two: the same of y_j (those of x transposed, if it is x)."""
    same = other is None
    other, other_two = (one.T, two.T) if same else (other, other_two)
    with np.errstate(all="ignore"):
        a, b = one / n, other / n
        spread = np.sqrt(np.maximum(two / n - a * a, 0) * np.maximum(other_two / n - b * b, 0))
        v = (both / n - a * b) / spread
    # rounded, so that the order in which partitions are added up does not show in what is drawn
    v = np.where(np.isfinite(v) & (spread > 1e-12), np.clip(np.nan_to_num(v), -0.999, 0.999), 0.0).round(9)
    if same:
        np.fill_diagonal(v, 1.0)
    return v


def positive(corr: np.ndarray) -> np.ndarray:
    """corr, or the nearest mix with the identity that has no eigenvalue below 1e-6."""
    low = np.linalg.eigvalsh(corr)[0] if len(corr) else 1.0
    return (corr + (1e-6 - low) * np.eye(len(corr))) / (1 + 1e-6 - low) if low < 1e-6 else corr


def factor(corr: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(positive(corr)) if len(corr) else corr


def _condition(model: Model, own: np.ndarray, scored: DataFrame, given: DataFrame) -> None:
    """Set the model's factor and slopes: the distribution of its normals on condition of the parent's, by the Schur complement.

    Children are added up by their reference first, so a parent of very many is one row in the join with the parents' scores.
    """
    k, names = len(model.columns), [c for c in given.columns if c != "_key"]
    p = len(names)
    sums = [x for i in range(k) for x in (F.sum(f"s{i}").alias(f"t{i}"), F.sum(F.col(f"s{i}") * F.col(f"s{i}")).alias(f"q{i}"), F.count(f"s{i}").alias(f"n{i}"))]
    families = scored.filter(F.col("_on").isNotNull()).groupBy("_on").agg(F.count(F.lit(1)).alias("n"), *sums)
    parents = given.filter(F.col("_key").isNotNull()).groupBy("_key").agg(*(F.avg(c).alias(f"g{i}") for i, c in enumerate(names)))
    if not k or not p:
        model.factor = factor(own)
        return
    met = cut(families.join(parents, F.col("_on") == F.col("_key")))

    def cross(batch: pa.RecordBatch) -> list[np.ndarray]:
        t, _ = _values(batch, [f"t{i}" for i in range(k)])
        q, _ = _values(batch, [f"q{i}" for i in range(k)])
        n, _ = _values(batch, [f"n{i}" for i in range(k)])
        g, known = _values(batch, [f"g{i}" for i in range(p)])
        return [n.T @ known, t.T @ known, q.T @ known, t.T @ g, n.T @ g, n.T @ (g * g)]

    def among(batch: pa.RecordBatch) -> list[np.ndarray]:
        n, _ = _values(batch, ["n"])
        g, known = _values(batch, [f"g{i}" for i in range(p)])
        return [(n * known).T @ known, (n * g).T @ known, (n * g * g).T @ known, (n * g).T @ g]

    between = correlations(*_summed(met, cross, (k, p), 6))
    n, one, two, both = _summed(met, among, (p, p), 4)
    theirs = correlations(n, one, two, both)
    whole = positive(np.block([[theirs, between.T], [between, own]]))
    theirs, between, own = whole[:p, :p], whole[p:, :p], whole[p:, p:]
    model.slopes = np.linalg.solve(theirs, between.T).T
    model.factor = factor(own - model.slopes @ between.T) if k else own
    with np.errstate(all="ignore"):
        model.means = np.nan_to_num(np.diag(one) / np.diag(n)).round(9)
        model.deviations = np.sqrt(np.maximum(np.nan_to_num(np.diag(two) / np.diag(n)) - model.means**2, 0)).round(9)


def _value(u: Column, m: Marginal) -> Column:
    if not m.quantiles:
        return F.lit(None).cast(m.type)
    q, x = F.array(*map(F.lit, m.quantiles)), F.greatest(F.least(u, F.lit(1.0)), F.lit(0.0)) * (QUANTILES - 1)
    i = F.least(F.floor(x), F.lit(QUANTILES - 2)).cast("int")
    a, b = F.element_at(q, i + 1), F.element_at(q, i + 2)
    return _from_number(a + (b - a) * (x - i), m)


def sample(rows: DataFrame, row: str, model: Model, seed: int, stream: str, given: str | None = None, scores: str | None = None) -> DataFrame:
    """rows (with a row id) plus the model's columns, in the order of the source. given: a column of rows with the parent's scores, which
    is left out of the result; scores: the name of a further column for the scores of the rows made."""
    k = len(model.columns)
    z = rows.select("*", *(R.normal(F.col(row), seed, f"{stream}/{c}").alias(f"_z{i}") for i, c in enumerate(model.columns)))

    def mixed(i: int) -> Column:
        own = [F.col(f"_z{j}") * float(model.factor[i, j]) for j in range(i + 1) if abs(model.factor[i, j]) > 1e-12]
        if given is not None and model.slopes is not None:
            for p in range(model.slopes.shape[1]):
                if abs(model.slopes[i, p]) > 1e-9 and model.deviations[p] > 1e-6:
                    own.append(F.coalesce((F.element_at(given, p + 1) - float(model.means[p])) / float(model.deviations[p]), F.lit(0.0)) * float(model.slopes[i, p]))
        return sum(own, F.lit(0.0))

    kept = [f"`{c}`" for c in rows.columns if c != given]
    out = z.select(*kept, *(mixed(i).alias(f"_m{i}") for i in range(k)))
    out = out.select(*kept, *(F.col(f"_m{i}") for i in range(k) if scores), *(normal_cdf(F.col(f"_m{i}")).alias(f"_u{i}") for i in range(k)))
    known = []
    for i, c in enumerate(model.columns):
        m = model.marginals[c]
        if m.spans is not None:
            out = drawn_values(out, f"_u{i}", m.spans if m.few is None else m.few, m.n, f"_value{i}", m.type, f"_mid{i}" if scores else None)
        known.append((f"_mid{i}", f"_m{i}")[m.spans is None])
    drawn = []
    for i, c in enumerate(model.columns):
        m = model.marginals[c]
        value = _value(F.col(f"_u{i}"), m) if m.spans is None else F.col(f"_value{i}")
        there = R.uniform(F.col(row), seed, f"{stream}/{c}/null") >= m.nulls
        drawn.append((F.when(there, value) if m.nulls > 0 else value).alias(c))
        if scores:  # a category's score is that of the middle of its span, as in the fit
            score = _normal_score(F.col(known[i])) if m.spans is not None else F.col(known[i])
            known[i] = F.when(there, score) if m.nulls > 0 else score
    out = out.select(*kept, *drawn, *([F.array(*known).cast("array<double>").alias(scores)] if scores else []))
    for g, names in model.groups.items():
        out = out.withColumns({c: F.col(f"`{g}`.`{c}`") for c in names}).drop(g)
    for d in model.orders:
        kind = model.schema[d.low_column].dataType
        high = _from_number(_number(F.col(f"`{d.low_column}`"), kind) + F.col(f"`_gap_{d.high_column}`"), Marginal(kind))
        out = out.withColumn(d.high_column, high).drop(f"_gap_{d.high_column}")
    return out.select(*kept, *(f"`{f.name}`" for f in model.schema.fields if f.name in out.columns and f.name not in rows.columns), *([scores] if scores else []))


def constraints(analysis: Analysis, table: str) -> tuple[list[DateOrder], list[DimensionGroup]]:
    return [d for d in analysis.date_constraints if d.table_name == table], [g for g in analysis.dimension_groups if g.table_name == table]
