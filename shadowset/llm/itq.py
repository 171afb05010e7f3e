"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank, components.

1. *Fit.* At most SAMPLE unit vectors (those with the least hash of their digest, and no more than SAMPLE_BYTES) go to the
   driver. Their principal axes are rotated so that the signs of the coordinates lose least (alternating between signs and the
   orthogonal Procrustes solution), which balances the bits; further rotations give further bits.
2. *Index.* Every distinct vector gets TABLES parts of code, each a key of its own table. Parts have SPARE bits more than the
   largest label's count asks for, so a key holds less than one unrelated vector however many there are. A vector asks each
   table for its own key, for those with one of its PROBES least certain bits changed, and for the one with two changed.
3. *Balls.* In a crowd of near copies all would find all. Vectors within half of the threshold's angle of a key's first vector
   join its ball: any two of them are links, so they are counted, not listed. Tables hold a ball once for each key.
4. *Rerank.* Of two balls that a table brings together, the angle of their centres and their radii may tell that all or none
   of their members are links. If not, the members of the smaller one are compared with the centre of the other, and where
   that tells nothing either, with its members: by the cosine of the original vectors in double precision, as two single
   vectors are. Nothing is capped; angles decide only where they do by more than EPSILON.
5. Equal vectors are one class from the start, with a count. Components come from large-star and small-star.

Only vectors of one label and one dimension are compared. Defined results: vectors that are null, empty or zero or hold null
or non-finite components, and those without a label, link with nothing and stand alone, repeated rows among them too; rows
with a null vec_id are vectors as all others, and a component is named by its least id that is not null (null if it has none);
repeated ids are vectors of their own; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import arrow_map, dropped, stored
from shadowset.llm.components import components

SAMPLE, SAMPLE_BYTES = 20_000, 128 << 20
TABLES, PROBES, SPARE = 12, 4, 3
#: Codes of unrelated vectors differ in half of their first CODE bits, those of near ones in fewer than FAR.
CODE, FAR = 128, 42
EPSILON = 1e-6


def width(n: int) -> int:
    """Bits of a part, for at most n vectors of a label."""
    return min(60, max(8, math.ceil(math.log2(max(2, n))) + SPARE))


def fit(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes (dimension x bits) of a sample of unit vectors."""
    d = sample.shape[1]
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    k = min(d, bits)
    if len(sample) > d:
        _, axes = np.linalg.eigh(np.cov((sample - mean).T).reshape(d, d))
        axes = axes[:, ::-1][:, :k]
    else:
        axes = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :k]
    flat = (sample - mean) @ axes
    turns = []
    for _ in range(math.ceil(bits / k)):
        turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(rounds if len(sample) else 0):
            signs = np.where(flat @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ flat)
            turn = v.T @ u.T
        turns.append(axes @ turn)
    return mean, np.hstack(turns)[:, :bits]


def code(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: the key of each table, the keys to ask for (table by table), and the first CODE bits as signed 64-bit numbers."""
    side = (x - model[0]) @ model[1]
    bits = side >= 0
    parts = bits[:, : TABLES * w].reshape(len(x), TABLES, w)
    keys = parts @ (1 << np.arange(w, dtype=np.int64))
    unsure = np.argsort(np.abs(side[:, : TABLES * w]).reshape(parts.shape), axis=2)[:, :, :PROBES]
    flip = 1 << unsure.astype(np.int64)
    probes = np.concatenate([keys[:, :, None], keys[:, :, None] ^ flip, (keys ^ flip[:, :, 0] ^ flip[:, :, 1])[:, :, None]], axis=2)
    start = np.packbits(bits[:, :CODE], axis=1, bitorder="little")
    return keys, probes.reshape(len(x), -1), np.pad(start, ((0, 0), (0, CODE // 8 - start.shape[1]))).view(np.int64)


def _usable(x) -> np.ndarray | None:
    v = np.array([np.nan if c is None else c for c in x], np.float64) if x else None
    return v if v is not None and np.isfinite(v).all() and v.any() else None


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim, same (a digest of label and vector; null if it links with nothing), vector (doubles as bytes)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            dim, same, data = [], [], []
            for label, x in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                v = None if label is None else _usable(x)
                dim.append(None if v is None else len(v))
                data.append(None if v is None else v.tobytes())
                same.append(None if v is None else xxhash.xxh3_128_digest(f"{label} ".encode() + v.tobytes()))
            return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dim, pa.int32()), pa.array(same, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "label", "dim", "same", "vector"])

        return each

    ready = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return arrow_map(ready, make, "vec_id long, label string, dim int, same binary, vector binary")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def models(classes: DataFrame, bits: int, sample: int = SAMPLE) -> dict[int, tuple]:
    """A model for each dimension in the sample."""
    widest = classes.agg(F.max("dim")).first()[0] or 1
    rows = classes.orderBy(F.xxhash64("same"), "node").limit(max(1, min(sample, SAMPLE_BYTES // (8 * widest)))).select("dim", "vector").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.dim, []).append(np.frombuffer(r.vector))
    return {d: fit(_unit(np.array(x)), bits) for d, x in by.items()}


def codes(classes: DataFrame, fitted: dict[int, tuple], w: int) -> DataFrame:
    """node, label, dim, keys, probes, h0, h1. A dimension that the sample lacks gets random axes."""
    bits = max(CODE, TABLES * w)

    def make():
        known = dict(fitted)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            dim, raw = batch.column("dim").to_numpy(), batch.column("vector").to_pylist()
            keys, probes, start = np.zeros((len(batch), TABLES), np.int64), np.zeros((len(batch), TABLES * (PROBES + 2)), np.int64), np.zeros((len(batch), 2), np.int64)
            for d in np.unique(dim):
                if d not in known:
                    known[d] = fit(np.empty((0, d)), bits)
                at = np.flatnonzero(dim == d)
                keys[at], probes[at], start[at] = code(_unit(np.array([np.frombuffer(raw[i]) for i in at])), known[d], w)
            arrays = [*(batch.column(c) for c in ("node", "label", "dim")), pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(probes), pa.list_(pa.int64())), pa.array(start[:, 0]), pa.array(start[:, 1])]
            return pa.RecordBatch.from_arrays(arrays, names=["node", "label", "dim", "keys", "probes", "h0", "h1"])

        return each

    return arrow_map(classes.select("node", "label", "dim", "vector"), make, "node long, label string, dim int, keys array<long>, probes array<long>, h0 long, h1 long")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))) + F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1")))


CELL = ("label", "dim", "t", "key")


def _cells(coded: DataFrame, *columns: str, asked: bool = False) -> DataFrame:
    """A row for each key that a vector has (asked: asks for)."""
    out = coded.select(*columns, "label", "dim", "h0", "h1", F.posexplode("probes" if asked else "keys").alias("t", "key"))
    return out.withColumn("t", F.floor(F.col("t") / (PROBES + 2)).cast("int")) if asked else out


def compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, cos: the cosine of the vectors of each pair."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("vector").alias(f"v{x}"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            va, vb = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
            out = np.zeros(len(batch))
            size = np.array([len(v) for v in va])
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x, y = (np.frombuffer(b"".join(v[i] for i in at)).reshape(len(at), -1) for v in (va, vb))
                x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
                dot = lambda p, q: np.einsum("ij,ij->i", p, q)
                out[at] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "cos"])

        return each

    return arrow_map(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb"), make, "a long, b long, cos double")


def _angle() -> Column:
    return F.acos(F.greatest(F.least(F.col("cos"), F.lit(1.0)), F.lit(-1.0)))


def balls(coded: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """node, center, r: the centre within half of the threshold's angle that each vector belongs to, itself where there is none, and the angle to it."""
    first = _cells(coded, "node").groupBy(*CELL).agg(F.min(F.struct("node", F.col("h0").alias("g0"), F.col("h1").alias("g1"))).alias("x"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    near = _cells(coded, "node").join(first.select(*CELL, "x.*").withColumnRenamed("node", "hub"), list(CELL)).filter((F.col("node") != F.col("hub")) & (_apart("h", "g") < FAR))
    angles = compared(near.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), classes).select("a", F.struct(F.col("b").alias("center"), _angle().alias("r")).alias("x"))
    joined = angles.filter(F.col("x.r") <= math.acos(least) / 2 - EPSILON).groupBy("a").agg(F.min("x").alias("x"))
    return classes.select("node", "n").join(joined.withColumnRenamed("a", "node"), "node", "left").select("node", "n", F.coalesce("x.center", "node").alias("center"), F.coalesce("x.r", F.lit(0.0)).alias("r"))


def candidates(coded: DataFrame, member: DataFrame) -> DataFrame:
    """a < b: centres of balls that a table brings together, each pair once."""
    of = coded.join(member.select("node", "center"), "node")

    def once(asked: bool, x: str) -> DataFrame:
        some = _cells(of, "center", asked=asked).groupBy("center", *CELL).agg(F.count(F.lit(1)).alias(f"n{x}"), F.any_value("h0").alias(f"{x}0"), F.any_value("h1").alias(f"{x}1"))
        return some.withColumnRenamed("center", f"c{x}")

    met = once(True, "p").join(once(False, "q"), list(CELL)).filter((F.col("cp") != F.col("cq")) & ((F.col("np") > 1) | (F.col("nq") > 1) | (_apart("p", "q") < FAR)))
    return met.select(F.least("cp", "cq").alias("a"), F.greatest("cp", "cq").alias("b")).distinct()


def near_vectors(rows: DataFrame, least: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of rows (vec_id, embedding, label)."""
    spark, most = rows.sparkSession, math.acos(least)
    seen, _ = stored(vectors(rows), "vectors")
    classes = seen.filter("same is not null").groupBy("same").agg(F.min("vec_id").alias("of"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    classes, _ = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    w = width(classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1)
    coded, coded_at = stored(codes(classes, models(classes, max(CODE, TABLES * w), sample), w), "codes")
    member, _ = stored(balls(coded, classes, least), "balls")
    ball = member.groupBy("center").agg(F.max("r").alias("r"), F.sum("n").alias("weight"), F.count(F.lit(1)).alias("k"), F.min("node").alias("rep"), F.max(F.col("node") == F.col("center")).alias("own"))
    ball, _ = stored(ball.withColumn("single", (F.col("k") == 1) & F.col("own")), "ball")
    side = lambda x: ball.select(F.col("center").alias(x), *(F.col(c).alias(c + x) for c in ("r", "weight", "k", "rep", "single")))

    # two balls: all, none, or to be looked into
    pairs = compared(candidates(coded, member), classes).join(side("a"), "a").join(side("b"), "b").withColumn("angle", _angle())
    alone = F.col("singlea") & F.col("singleb")
    every = F.when(alone, F.col("cos") >= least).otherwise(F.col("angle") + F.col("ra") + F.col("rb") <= most - EPSILON)
    never = alone | (F.col("angle") - F.col("ra") - F.col("rb") > most + EPSILON)
    pairs, _ = stored(pairs.withColumn("state", F.when(every, 2).when(never, 0).otherwise(1)).filter("state > 0").select("a", "b", "state", *(c + x for x in "ab" for c in ("weight", "k", "rep"))), "pairs")
    whole = pairs.filter("state = 2")

    # the members of the smaller one and the other's centre
    swap = F.col("ka") > F.col("kb")
    open_ = pairs.filter("state = 1").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("center"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    asked, asked_at = stored(open_.join(member.select("center", F.col("node").alias("a"), F.col("n").alias("na")), "center").select("a", "b", "na"), "asked")
    met = compared(asked.select("a", "b"), classes).join(asked, ["a", "b"]).join(side("b"), "b").withColumn("angle", _angle())
    every = F.when(F.col("singleb"), F.col("cos") >= least).otherwise(F.col("angle") + F.col("rb") <= most - EPSILON)
    never = F.col("singleb") | (F.col("angle") - F.col("rb") > most + EPSILON)
    met, _ = stored(met.withColumn("state", F.when(every, 2).when(never, 0).otherwise(1)).filter("state > 0").select("a", "b", "state", "na", "weightb", "repb"), "met")
    some = met.filter("state = 2")

    # member by member
    last = met.filter("state = 1").select("a", "na", F.col("b").alias("center")).join(member.select("center", F.col("node").alias("b"), F.col("n").alias("nb")), "center").select("a", "b", "na", "nb")
    links, _ = stored(compared(last.select("a", "b"), classes).filter(F.col("cos") >= least).select("a", "b"), "links")

    reps = ball.select("center", "rep")
    part = components(
        member.join(reps, "center").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        .unionByName(whole.select(F.col("repa").alias("a"), F.col("repb").alias("b")))
        .unionByName(some.select("a", F.col("repb").alias("b")))
        .unionByName(links)
    )[0]
    dropped(spark, coded_at, asked_at)
    of_ball = whole.select(F.col("a").alias("center"), F.col("weightb").alias("w")).unionByName(whole.select(F.col("b").alias("center"), F.col("weighta").alias("w"))).unionByName(some.select(F.col("b").alias("center"), F.col("na").alias("w")))
    weight = lambda x: member.select(F.col("node").alias(x), F.col("n").alias("w"))
    of_node = some.select(F.col("a").alias("node"), F.col("weightb").alias("w")).unionByName(links.join(weight("b"), "b").select(F.col("a").alias("node"), "w")).unionByName(links.join(weight("a"), "a").select(F.col("b").alias("node"), "w"))
    of_ball, of_node = of_ball.groupBy("center").agg(F.sum("w").alias("more")), of_node.groupBy("node").agg(F.sum("w").alias("far"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    named = classes.select("same", "of", "node").join(member.select("node", "center"), "node").join(ball.select("center", "weight"), "center").join(of_ball, "center", "left").join(of_node, "node", "left").join(part, "node", "left")
    named = named.select("same", "of", (F.col("weight") - 1 + zero("more") + zero("far")).alias("n_links"), F.coalesce("component", "node").alias("part"))
    lowest = named.groupBy("part").agg(F.min("of").alias("component_id"))
    named = named.join(lowest, "part").select("same", "n_links", "component_id")
    out = seen.select("vec_id", "same").join(named, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
