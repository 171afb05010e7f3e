"""Metadata discovery: keys, references, dimensions, functional dependencies, date orders, free text, roles.

Rules run on the driver over profiles; anything that looks at values is an aggregate or a semi join in Spark. Name rules come
first, so no job is built for pairs that cannot qualify.
"""

from __future__ import annotations

import itertools
import logging
import re
from collections.abc import Callable, Collection, Iterable
from functools import reduce

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shadowset.functions.names import sensitivity
from shadowset.models import Analysis, Column, DateOrder, DimensionGroup, Relationship, Role, Table
from shadowset.operators.profile import SKETCH_SLACK, SLACK, ColumnProfile, combinations, estimates, profile, sketches, together

log = logging.getLogger(__name__)

# Fixed values.
PK_THRESHOLD, DIMENSION_THRESHOLD, FK_THRESHOLD = 0.95, 0.05, 0.80
PK_SUFFIXES = ("_id", "_key", "_nr", "_no", "_pk", "_code", "id")
DATE_TOLERANCE = 0.02
DATE_NAME = re.compile(r"(^|_)(date|time|timestamp|datetime)(_|$)", re.I)
DATE_FORMAT, TIME_FORMAT = "%Y-%m-%d", "%Y-%m-%d %H:%M:%S"

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType)


def primary_keys(df: DataFrame | None, threshold: float = PK_THRESHOLD, profiled: dict[str, ColumnProfile] | None = None) -> list[tuple[str, float]]:
    """(column, uniqueness) of key candidates, most unique first, ties in column order. Columns with a NULL or of an empty table are none."""
    near = lambda p: p.rows and not p.nulls and p.ratio >= min(threshold, 1) * (1 - SLACK)
    named = lambda name: name.lower().endswith(PK_SUFFIXES)
    fits = lambda p: p.rows and not p.nulls and (p.ratio >= threshold if named(p.name) else False)
    known = profiled
    if known is None:  # columns named like keys first: where one is found, no other is read
        known = profile(df, near, names=[c for c in df.columns if named(c)])
        if not any(map(fits, known.values())):
            known |= profile(df, near, names=[c for c in df.columns if not named(c)])
    sound = sorted((p for p in known.values() if p.rows and not p.nulls), key=lambda p: p.ordinal)
    found = [p for p in sound if fits(p)] or [p for p in sound if p.distinct_known == p.rows]
    return [(p.name, p.ratio) for p in sorted(found, key=lambda p: -p.ratio)]


def fk_candidates(columns: dict[str, Iterable[str]], keys: dict[str, str]) -> list[tuple[str, str, str, str]]:
    """(child, column, parent, key): name-gated pairs, children and parents in order. A child's own key refers to nothing."""
    out = []
    for child, parent in itertools.product(columns, keys):
        key = keys[parent]
        wanted = {f"{parent}_{key}".lower(), f"{parent}_id".lower()}
        if child != parent:
            out += [(child, c, parent, key) for c in columns[child] if c != keys.get(child) and (c == key or c.lower() in wanted)]
    return out


def as_text(c: Expr, kind: T.DataType) -> Expr:
    """A value's text as it is written elsewhere: whole floats with ``.0``, ``True`` and ``False``."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        return F.when((d == F.floor(d)) & (F.abs(d) < 1e16), F.concat(F.when(d < 1e16, d).cast("decimal(17,0)").cast("string"), F.lit(".0"))).otherwise(d.cast("string"))
    return c.cast("string")


def _family(kind: T.DataType) -> str:
    if isinstance(kind, (*_NUMBERS, T.BooleanType, T.DecimalType)):
        return "number"
    return "time" if isinstance(kind, (T.DateType, *_TIMES)) else kind.typeName()


def _same_footing(child: T.DataType, parent: T.DataType) -> Callable[[Expr], Expr] | None:
    """How to bring both sides to one type, or None where no value of one equals one of the other."""
    if child == parent:
        return lambda c: c
    if _family(child) != _family(parent):
        return None
    if isinstance(child, (*_WHOLE, T.BooleanType)) and isinstance(parent, (*_WHOLE, T.BooleanType)):
        return lambda c: c.cast("long")
    return (lambda c: c.cast("double")) if _family(child) == "number" else None


def _share(child: DataFrame, parent: DataFrame) -> DataFrame:
    """hit and n: how many distinct non-null child values (column v) the parent has, and how many there are."""
    values = child.filter(F.col("v").isNotNull()).distinct()
    own = parent.filter(F.col("v").isNotNull()).distinct().select(F.col("v").alias("w"))
    return values.join(own, F.col("v") == F.col("w"), "left").agg(F.count("w").alias("hit"), F.count("v").alias("n"))


def overlap(child: DataFrame, column: str, parent: DataFrame, key: str, as_string: bool = False) -> DataFrame:
    """One row: hit, n. as_string: compare the values' texts."""
    kinds = child.schema[column].dataType, parent.schema[key].dataType
    if as_string:
        sides = [as_text(F.col(f"`{c}`"), k) for c, k in zip((column, key), kinds, strict=True)]
    elif (cast := _same_footing(*kinds)) is None:
        return child.filter(F.col(f"`{column}`").isNotNull()).agg(F.lit(0).cast("long").alias("hit"), F.count_distinct(F.col(f"`{column}`")).alias("n"))
    else:
        sides = [cast(F.col(f"`{column}`")), cast(F.col(f"`{key}`"))]
    return _share(child.select(sides[0].alias("v")), parent.select(sides[1].alias("v")))


def _canonical(c: Expr, kind: T.DataType) -> Expr:
    """What equal values have in common whatever their types: whole numbers as such, others by type."""
    if isinstance(kind, (*_WHOLE, T.BooleanType)):
        return F.struct(F.lit("whole").alias("k"), c.cast("long").cast("string").alias("v"))
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 2.0**63)
        return F.struct(F.when(whole, "whole").otherwise("number").alias("k"), F.when(whole, d.cast("long").cast("string")).otherwise((d + 0.0).cast("string")).alias("v"))
    value = F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c
    return F.struct(F.lit(kind.simpleString()).alias("k"), value.alias("v"))


def shared_values(tables: dict[str, DataFrame], attributes: list[tuple[str, str]], texts: Collection[tuple[str, str]] = ()) -> dict[tuple[int, int, bool], int]:
    """How many distinct values two attributes (table, column) share: (i, j, as text) -> count; (i, i) is how many attribute i has.

    An inverted index of all of them at once: each table is read once and gives a digest for every value of its attributes; a
    digest's attributes are a set of bits, joined in the task first and then by digest; equal sets are counted, and only counts of
    pairs reach the driver. texts: attributes whose values are also compared by their text.
    """
    place = {a: i for i, a in enumerate(attributes)}
    words = -(-len(attributes) // 63)
    frames = []
    for t in dict.fromkeys(t for t, _ in attributes):
        schema, each = tables[t].schema, []
        for a in (a for a in attributes if a[0] == t):
            c, kind = F.col(f"`{a[1]}`"), schema[a[1]].dataType
            for text, value in ((False, _canonical(c, kind)), *([(True, as_text(c, kind))] if a in texts else ())):
                known = F.struct(F.lit(text).alias("t"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))
                each.append(F.struct(F.lit(place[a]).alias("i"), F.when(c.isNotNull(), known).alias("d")))
        frames.append(tables[t].select(F.inline(F.array(*each))).filter("d is not null"))
    if not frames:
        return {}
    bits = [F.bit_or(F.when(F.floor(F.col("i") / 63) == w, F.expr("shiftleft(1L, i % 63)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    sets = reduce(DataFrame.unionByName, frames).groupBy("d").agg(*bits).groupBy(F.col("d.t").alias("t"), *(f"w{w}" for w in range(words))).agg(F.count(F.lit(1)).alias("n"))
    members = F.filter(F.sequence(F.lit(0), F.lit(len(attributes) - 1)), lambda i: F.getbit(F.element_at(F.array(*(F.col(f"w{w}") for w in range(words))), (F.floor(i / 63) + 1).cast("int")), i % 63) == 1)
    pairs = sets.select("t", "n", members.alias("m")).select("t", "n", "m", F.explode("m").alias("i")).select("t", "n", "i", F.explode("m").alias("j"))
    return {(r["i"], r["j"], r["t"]): r["n"] for r in pairs.groupBy("t", "i", "j").agg(F.sum("n").alias("n")).collect()}


def foreign_keys(tables: dict[str, DataFrame], keys: dict[str, str], threshold: float = FK_THRESHOLD, unnamed: bool = False) -> list[Relationship]:
    """Inclusion dependencies: the share of distinct child values that the parent's key has, by value or else by text. Pairs pass the
    name gate first, unless unnamed asks for all columns of a type that the key's can equal."""
    if unnamed:
        wanted = [(child, f.name, parent, key) for child, parent in itertools.product(tables, keys) if child != parent for key in [keys[parent]] for f in tables[child].schema.fields if f.name != keys.get(child) and _same_footing(f.dataType, tables[parent].schema[key].dataType)]
    else:
        wanted = fk_candidates({t: df.columns for t, df in tables.items()}, keys)
    kind = lambda a: tables[a[0]].schema[a[1]].dataType
    sides = [((c, f), (p, k)) for c, f, p, k in wanted]
    attributes = list(dict.fromkeys(a for pair in sides for a in pair))
    texts = {a for pair in sides if kind(pair[0]) != kind(pair[1]) for a in pair}
    shared, place, out = shared_values(tables, attributes, texts), {a: i for i, a in enumerate(attributes)}, []
    for child, parent in sides:
        i, j = place[child], place[parent]
        share = lambda text: shared.get((i, j, text), 0) / shared[i, i, text] if (i, i, text) in shared else 0.0  # noqa: E731, B023
        if (i, i, False) not in shared:
            continue
        ratio = share(False)
        if ratio < threshold:
            ratio = max(ratio, share(True))
        if ratio >= threshold:
            out.append(Relationship(*parent, *child, round(ratio, 3)))
    return out


def dimension_limit(rows: int, threshold: float = DIMENSION_THRESHOLD) -> float:
    """Small tables get a looser limit."""
    return 0.50 if rows < 50 else 0.15 if rows < 200 else threshold


def dimensions(df: DataFrame | None, exclude: Iterable[str] = (), threshold: float = DIMENSION_THRESHOLD, profiled: dict[str, ColumnProfile] | None = None) -> list[str]:
    found = dimension_profiles(df, threshold) if profiled is None else profiled
    return [p.name for p in found.values() if p.rows and isinstance(p.type, T.StringType) and p.name not in set(exclude) and p.ratio < dimension_limit(p.rows, threshold)]


def dimension_profiles(df: DataFrame, threshold: float = DIMENSION_THRESHOLD) -> dict[str, ColumnProfile]:
    """Exact profiles of the string columns that may be dimensions."""
    return profile(df, lambda p: p.ratio * (1 - SLACK) <= dimension_limit(p.rows, threshold), T.StringType)


def text_profiles(df: DataFrame, threshold: float = DIMENSION_THRESHOLD) -> dict[str, ColumnProfile]:
    """Exact profiles of the string columns that may be free text."""
    return profile(df, lambda p: p.ratio * (1 + SLACK) >= threshold and (p.mean_length or 0) > 3, T.StringType)


def _distinct(columns: Iterable[str]) -> Expr:
    """Distinct combinations, NULL being a value."""
    return F.count_distinct(F.struct(*(F.col(f"`{c}`") for c in columns)))


def dimension_groups(table: str, df: DataFrame, columns: list[str], kept: DataFrame | None = None) -> list[DimensionGroup]:
    """Closures of functional dependencies (in either direction) between dimension columns.

    Sketches of the columns and of all their pairs come from one scan (kept: from a table that earlier runs stored and merged); only
    pairs that may be as many as one of their columns are counted exactly, in a second one.
    """
    if len(columns) < 2:
        return []
    pairs = list(itertools.combinations(columns, 2))
    about = estimates(sketches(df, [(c,) for c in columns] + pairs) if kept is None else kept)
    likely = [(a, b) for a, b in pairs if about[a, b] * (1 - SKETCH_SLACK) - 2 <= max(about[a,], about[b,]) * (1 + SKETCH_SLACK)]
    counts = combinations(df, [(c,) for c in columns if any(c in p for p in likely)] + likely)
    group = {c: {c} for c in columns}
    for a, b in likely:
        if counts[a, b] in (counts[a,], counts[b,]) and group[a] is not group[b]:
            both = group[a] | group[b]
            for c in both:
                group[c] = both
    found = [tuple(c for c in columns if c in g) for g in {id(g): g for g in group.values()}.values() if len(g) > 1]
    counts |= combinations(df, [names for names in found if names not in counts])
    return [DimensionGroup(table, list(names), counts[names]) for names in found]


def is_date_column(name: str, kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, *_TIMES)) or isinstance(kind, T.StringType) and bool(DATE_NAME.search(name))


def date_orders(table: str, df: DataFrame) -> list[DateOrder]:
    """Pairs (earlier column, later column) of date columns that hold low <= high but for at most 2 % of the rows with both."""
    columns = [f for f in df.schema.fields if is_date_column(f.name, f.dataType)]
    pairs = []
    for a, b in itertools.combinations(columns, 2):
        if _family(a.dataType) == _family(b.dataType):
            pairs.append((a.name, b.name))
        else:
            log.warning("%s: %s and %s cannot be compared", table, a.name, b.name)
    if not pairs:
        return []
    asked = []
    for i, (a, b) in enumerate(pairs):
        low, high = F.col(f"`{a}`"), F.col(f"`{b}`")
        asked += [F.count_if(low.isNotNull() & high.isNotNull()).alias(f"n{i}"), F.count_if(low > high).alias(f"v{i}")]
    row = df.agg(*asked).first()
    return [DateOrder(table, a, b, False, row[f"v{i}"]) for i, (a, b) in enumerate(pairs) if row[f"n{i}"] and row[f"v{i}"] <= DATE_TOLERANCE * row[f"n{i}"]]


def text_columns(df: DataFrame | None, exclude: Iterable[str] = (), threshold: float = DIMENSION_THRESHOLD, profiled: dict[str, ColumnProfile] | None = None) -> list[str]:
    """String columns of many values that are longer than three characters on average."""
    found = text_profiles(df, threshold) if profiled is None else profiled
    return [p.name for p in found.values() if p.rows and isinstance(p.type, T.StringType) and p.name not in set(exclude) and p.ratio >= threshold and (p.mean_length or 0) > 3]


def classify(p: ColumnProfile, key: str | None, references: Iterable[str], dims: Iterable[str], texts: Iterable[str], samples: list | None = None) -> Column:
    """Role and semantic type of a column: key, reference, dimension, date, text, number, boolean, other - the first that holds."""
    out = Column(p.name, uniqueness_ratio=p.ratio, sample_values=samples or [], sensitivity=sensitivity(p.name))
    if p.name == key:
        out.role, out.sdtype, out.is_primary_key = Role.PRIMARY_KEY, "id", True
    elif p.name in references:
        out.role, out.sdtype = Role.FOREIGN_KEY, "id"
    elif p.name in dims:
        out.role, out.sdtype = Role.DIMENSION, "categorical"
    elif isinstance(p.type, (T.DateType, *_TIMES)):
        out.role, out.sdtype = Role.DATE, "datetime"
        out.datetime_format = DATE_FORMAT if isinstance(p.type, T.DateType) else TIME_FORMAT
    elif p.name in texts:
        out.role = Role.TEXT
    elif isinstance(p.type, _NUMBERS):
        out.role, out.sdtype = Role.MEASURE, "numerical"
    else:
        out.sdtype = "boolean" if isinstance(p.type, T.BooleanType) else "categorical"
    return out


def analyze(
    tables: dict[str, DataFrame],
    sources: dict[str, str] | None = None,
    relative_dirs: dict[str, str] | None = None,
    pk_threshold: float | None = None,
    fk_threshold: float | None = None,
    dim_threshold: float | None = None,
    parse_string_dates: bool = False,
) -> Analysis:
    """Everything above for a set of tables. parse_string_dates: string columns named like dates are dates, not text."""
    pk = PK_THRESHOLD if pk_threshold is None else pk_threshold
    fk = FK_THRESHOLD if fk_threshold is None else fk_threshold
    dim = DIMENSION_THRESHOLD if dim_threshold is None else dim_threshold
    spark = next(iter(tables.values())).sparkSession if tables else None
    profiles = dict(zip(tables, together(spark, [lambda df=df: profile(df) for df in tables.values()]), strict=True))
    keys = {t: found[0][0] for t in tables if (found := primary_keys(None, pk, profiles[t]))}
    out = Analysis(relationships=foreign_keys(tables, keys, fk))
    for name, df in tables.items():
        known, key = profiles[name], keys.get(name)
        target: dict[str, str] = {}
        for r in out.relationships:
            if r.child_table == name:
                target.setdefault(r.child_column, f"{r.parent_table}.{r.parent_column}")
        used = {key, *target}
        dims = dimensions(None, used, dim, known)
        dates = {c for c, p in known.items() if parse_string_dates and is_date_column(c, p.type)}
        texts = text_columns(None, used | set(dims) | dates, dim, known)
        head = [r.asDict() for r in df.limit(5).collect()]
        columns = {c: classify(p, key, target, dims, texts, [h[c] for h in head]) for c, p in known.items()}
        for c in columns.values():
            c.foreign_key_target = target.get(c.name)
            if c.name in dates and c.role == Role.OTHER:
                c.role, c.sdtype, c.datetime_format = Role.DATE, "datetime", DATE_FORMAT
        rows = next((p.rows for p in known.values()), 0)
        out.tables[name] = Table(name, (sources or {}).get(name, ""), rows, columns, key, (relative_dirs or {}).get(name, ""))
        out.dimension_groups += dimension_groups(name, df, dims)
        out.date_constraints += date_orders(name, df)
    return out
