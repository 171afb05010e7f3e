"""Hard negatives for contrastive training, by a pivot table.

1. *Pivot table.* A vector x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared norm, a query q gets 0: then
   |q - x|^2 = M + |q|^2 - 2 q.x, and the largest inner product is the smallest Euclidean distance. PIVOTS vectors, far from
   each other, are chosen from a bounded sample; every row's distances to them are stored with it. Rows lie in blocks by label
   and nearest pivot, with each pivot's range of distances.
2. *Brackets.* By the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) for every pivot p, so stored distances
   bracket a score from both sides. An anchor passes over a block, and then over a row, whose bracket cannot reach what it asks for.
3. *Exact check.* Scores of the rows left are computed from the vectors, in integers.
4. Two searches: the first gives each anchor its positives (the best rows of its label; the best of its own block give a
   threshold from the start), the second gives each positive the best rows of other labels between LOW percent of its score and
   its score. Anchors are a stated query set, in blocks of at most ANCHORS; a slot of SLOT_ROWS rows meets one block after the
   other, so that a task holds the best rows of one block of anchors. Nothing but the pivots passes through the driver.

Scores are exact where sums of products stay below 2^53. Defined results: rows without an id, label or vector, empty vectors and those
with a null or non-finite component take no part; vectors of different lengths are not compared; repeated rows are rows of their own
(each an anchor, and each the other's positive); an anchor without positives gives no rows, nor does a positive without negatives;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shadowset.llm.common import arrow_map, bound_batches, stored

PIVOTS, SAMPLE, SAMPLE_BYTES = 16, 1024, 32 << 20
ANCHORS, SLOT_ROWS = 512, 1 << 14
FIRST, LOW = 5, 80
ROWS = "row long, id long, label long, size int, x binary"
BLOCK = "block long, row binary, id binary, label binary, size binary, x binary, near binary"
ASKED = "asked long, row binary, id binary, label binary, size binary, x binary, near binary, floor binary, aims binary"
FAR = np.iinfo(np.int64).max


def usable(vectors: DataFrame, label: Column, size: int = 256) -> DataFrame:
    """row, id, label, size, x: the rows that take part, their components scaled and rounded down."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(size * c).cast("double"))
    sound = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & sound)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))


def padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for o, x in zip(out, rows, strict=True):
        o[: len(x)] = x
    return out


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """x with the coordinate that makes all squared norms equal to most."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0.0))


def chosen(sample: np.ndarray, most: float, count: int = PIVOTS) -> np.ndarray:
    """Lifted vectors of the sample that are far from each other: each the one farthest from those before it."""
    up = lifted(sample, most)
    gap = distances(up, up.mean(axis=0, keepdims=True))[:, 0]
    out: list[int] = []
    for _ in range(min(count, len(up))):
        if out and gap.max() <= 0:
            break
        out.append(int(gap.argmax()))
        own = distances(up, up[out[-1:]])[:, 0]
        gap = own if len(out) == 1 else np.minimum(gap, own)
    return up[out]


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def pivot_table(rows: DataFrame, pivots: np.ndarray, most: float) -> DataFrame:
    """The stored blocks of rows (row, id, label, x), by label and nearest pivot."""
    width = pivots.shape[1] - 1

    def near():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("x").to_pylist()
            x = padded(lists, width)
            cell = distances(lifted(x, most), pivots).argmin(axis=1)
            names = ["row", "id", "label"]
            size = pa.array(np.fromiter(map(len, lists), np.int32, len(lists)))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), size, pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell)], names=[*names, "size", "x", "cell"])

        return each

    def pack():
        count = iter(range(1 << 33))
        part = TaskContext.get().partitionId() << 33

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(len(batch), width)
            said = _binary(*(batch.column(c).to_numpy() for c in ("row", "id", "label", "size")), x, distances(lifted(x, most), pivots))
            return pa.RecordBatch.from_arrays([pa.array([part + next(count)], pa.int64()), *said], names=[c.split()[0] for c in BLOCK.split(", ")])

        return each

    ordered = arrow_map(rows, near, ROWS + ", cell long").repartitionByRange("label", "cell", "row").sortWithinPartitions("label", "cell", "row").drop("cell")
    return stored(arrow_map(ordered, pack, BLOCK), "pivots")[0]


class Rows:
    """A block's arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, width: int):
        of = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)
        self.row, self.id, self.label, self.size = of("row", np.int64), of("id", np.int64), of("label", np.int64), of("size", np.int32)
        n = len(self.row)
        self.x, self.near = of("x", np.float64).reshape(n, width), of("near", np.float64).reshape(n, -1)


class Best:
    """The first k (score descending, id ascending) of each group."""

    def __init__(self, groups: int, k: int):
        self.k, self.score, self.id = k, np.full((groups, k), -np.inf), np.full((groups, k), FAR)

    def better(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        s, i = self.score[group, -1], self.id[group, -1]
        return (score > s) | ((score == s) & (ids < i))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = self.better(group, score, ids)
        group, score, ids = group[good], score[good], ids[good]
        if not len(group):
            return
        met = np.unique(group)
        old = np.repeat(met, self.k)
        group, score, ids = np.concatenate((old, group)), np.concatenate((self.score[met].ravel(), score)), np.concatenate((self.id[met].ravel(), ids))
        by = np.lexsort((ids, -score, group))
        group, score, ids = group[by], score[by], ids[by]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        first = place < self.k
        self.score[group[first], place[first]], self.id[group[first], place[first]] = score[first], ids[first]


def reach(q_near: np.ndarray, low: np.ndarray, high: np.ndarray, norms: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The brackets of scores of queries with rows whose distances to each pivot lie between low and high: lower and upper bounds.

    q_near: queries x pivots; low, high: rows x pivots; norms: the queries' squared norms.
    """
    least, farthest = np.zeros((len(q_near), len(low))), np.full((len(q_near), len(low)), np.inf)
    for p in range(q_near.shape[1]):
        d = q_near[:, p][:, None]
        np.maximum(least, np.maximum(d - high[:, p], low[:, p] - d), out=least)
        np.minimum(farthest, d + high[:, p], out=farthest)
    total = most + norms[:, None]
    slack = 0.5 + 1e-9 * total
    return (total - farthest * farthest) / 2 - slack, (total - least * least) / 2 + slack


def first_floor(rows: Rows, of: np.ndarray, k: int) -> np.ndarray:
    """For the rows ``of`` of a block: the k-th best score among the block's others of the same label and size, or -inf."""
    scores = rows.x[of] @ rows.x.T
    other = (rows.label[of][:, None] == rows.label) & (rows.size[of][:, None] == rows.size) & (rows.row[of][:, None] != rows.row)
    scores[~other] = -np.inf
    return np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(of), -np.inf)


def _anchors(blocks: DataFrame, width: int, every: int, k: int) -> DataFrame:
    """The anchors of all blocks, a row each: row, id, label, size, x, near, floor."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for i in range(len(batch)):
                rows = Rows(batch, i, width)
                of = np.flatnonzero(rows.id % every == 0)
                for j, floor in zip(of, first_floor(rows, of, k), strict=True):
                    out.append((int(rows.row[j]), int(rows.id[j]), int(rows.label[j]), int(rows.size[j]), rows.x[j].tobytes(), rows.near[j].tobytes(), float(floor)))
            if not out:
                return None
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "id", "label", "size", "x", "near", "floor"])

        return each

    return arrow_map(blocks, make, ROWS + ", near binary, floor double")


def _query_near(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)


def _blocks_of(anchors: DataFrame, count: int, pivots: np.ndarray, aims: bool) -> DataFrame:
    """Anchors in blocks of at most ANCHORS; near becomes a query's distances. aims: there is a column of FIRST positive scores."""
    width = pivots.shape[1] - 1

    def make():
        number = iter(range(1 << 33))
        part = TaskContext.get().partitionId() << 33

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for at in range(0, len(batch), ANCHORS):
                some = batch.slice(at, ANCHORS)
                x = np.frombuffer(b"".join(some.column("x").to_pylist()), np.float64).reshape(len(some), width)
                aim = some.column("aims").flatten().to_numpy() if aims else np.zeros(0)
                said = _binary(*(some.column(c).to_numpy() for c in ("row", "id", "label", "size")), x, _query_near(x, pivots), some.column("floor").to_numpy(), aim)
                out.append(pa.RecordBatch.from_arrays([pa.array([part + next(number)], pa.int64()), *said], names=[c.split()[0] for c in ASKED.split(", ")]))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return each

    return arrow_map(anchors.repartitionByRange(max(1, -(-count // ANCHORS)), "label", "row"), make, ASKED)


def search(asked: DataFrame, blocks: DataFrame, slots: int, width: int, most: float, k: int, low: int | None) -> DataFrame:
    """row, aim, score, id: for each anchor the k best rows of its label in each slot (low is None), or for each of its positives the k best
    of other labels with a score between low percent of the positive's and the positive's."""
    bound_batches(asked.sparkSession)
    many = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    names = [c.split()[0] for c in BLOCK.split(", ")]
    theirs = blocks.select(F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"), *(F.col(c).alias(f"_{c}") for c in names))
    pairs = many.hint("merge").join(theirs, "slot").drop("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, best, aims = None, None, None, 1

        def told() -> pa.RecordBatch | None:
            have = np.argwhere(np.isfinite(best.score))
            if not len(have):
                return None
            g, j = have[:, 0], have[:, 1]
            return pa.RecordBatch.from_arrays([pa.array(q.row[g // aims]), pa.array(g % aims), pa.array(best.score[g, j].astype(np.int64)), pa.array(best.id[g, j])], names=["row", "aim", "score", "id"])

        for batch in batches:
            theirs = batch.select([f"_{c}" for c in names]).rename_columns(names)
            for i in range(len(batch)):
                if batch.column("asked")[i].as_py() != now:
                    if q is not None and (out := told()) is not None:
                        yield out
                    now, q = batch.column("asked")[i].as_py(), Rows(batch, i, width)
                    q.norm = (q.x * q.x).sum(axis=1)
                    q.floor = np.frombuffer(batch.column("floor")[i].as_py(), np.float64)
                    q.aims = np.frombuffer(batch.column("aims")[i].as_py(), np.float64).reshape(len(q.row), -1)
                    aims = 1 if low is None else q.aims.shape[1]
                    best = Best(len(q.row) * aims, k)
                _compare(q, Rows(theirs, i, width), best, most, low)
        if q is not None and (out := told()) is not None:
            yield out

    return pairs.mapInArrow(run, "row long, aim long, score long, id long")


def _compare(q: Rows, rows: Rows, best: Best, most: float, low: int | None) -> None:
    """Take a block's rows into the best of the anchors q."""
    aims = 1 if low is None else q.aims.shape[1]
    if low is None:
        floor, ceiling = q.floor[:, None], np.full((len(q.row), 1), np.inf)
    else:
        ceiling = q.aims  # nan where an anchor has fewer positives: no comparison with it holds
        floor = np.ceil(low * ceiling / 100)
    known = best.score[:, -1].reshape(len(q.row), aims)
    ask = np.where(floor <= ceiling, np.maximum(floor, known), np.inf)
    _, upper = reach(q.near, rows.near.min(axis=0, keepdims=True), rows.near.max(axis=0, keepdims=True), q.norm, most)
    some = np.flatnonzero(upper[:, 0] >= ask.min(axis=1))
    if not len(some):
        return
    lower, upper = reach(q.near[some], rows.near, rows.near, q.norm[some], most)
    same = q.label[some][:, None] == rows.label
    fit = (q.size[some][:, None] == rows.size) & ((same & (q.row[some][:, None] != rows.row)) if low is None else ~same)
    open_ = fit & (upper >= ask[some].min(axis=1)[:, None])
    if low is not None:
        open_ &= lower <= np.where(np.isnan(ceiling[some]), -np.inf, ceiling[some]).max(axis=1)[:, None]
    left, there = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(left):
        return
    scores = q.x[some[left]] @ rows.x[there].T
    open_ = open_[np.ix_(left, there)]
    for a in range(aims):
        mine = some[left]
        a_, r_ = np.nonzero(open_ & (scores >= ask[mine, a][:, None]) & (scores <= ceiling[mine, a][:, None]))
        best.add(mine[a_] * aims + a, scores[a_, r_], rows.id[there[r_]])


def hard_negatives(vectors: DataFrame, label: Column | None = None, every: int = 100, positives: int = FIRST, negatives: int = FIRST, low: int = LOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. label: what the rows' labels are; every: anchors' ids are its multiples."""
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(vectors, F.col("label") if label is None else label)
    said = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)).alias("most"), F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    if not said.n or not said.width:
        return vectors.sparkSession.createDataFrame([], empty)
    many = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * said.width)))
    sample = [r.x for r in rows.orderBy(F.xxhash64("id"), "row").limit(many).select("x").collect()]  # bounded: the pivots' sample
    pivots = chosen(padded(sample, said.width), said.most)
    blocks = pivot_table(rows, pivots, said.most)
    slots = -(-said.n // SLOT_ROWS)
    anchors, _ = stored(_anchors(blocks, said.width, every, positives), "anchors")
    count = anchors.count()
    best = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    first = search(_blocks_of(anchors, count, pivots, False), blocks, slots, said.width, said.most, positives, None)
    first = first.withColumn("aim", best(["row"])).filter(F.col("aim") <= positives)
    first, _ = stored(first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("aim", "score", "id"))).alias("first")), "positives")
    missing = F.lit(float("nan"))
    aims = F.array(*(F.coalesce(F.get("first", F.lit(i))["score"].cast("double"), missing) for i in range(positives)))
    asked = anchors.join(first, "row").select(*anchors.columns, aims.alias("aims"))
    found = search(_blocks_of(asked, count, pivots, True), blocks, slots, said.width, said.most, negatives, low)
    found = found.withColumn("rank", best(["row", "aim"])).filter(F.col("rank") <= negatives)
    whose = anchors.select("row", F.col("id").alias("anchor_id")).join(first, "row").select("row", "anchor_id", F.posexplode("first").alias("aim", "p"))
    whose = whose.select("row", "anchor_id", F.col("aim").cast("long").alias("aim"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return found.join(whose, ["row", "aim"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def negatives_report(vectors: DataFrame) -> DataFrame:
    """hard_negatives of the embeddings table, with every seventh label moved on by one of ten."""
    return hard_negatives(vectors, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
