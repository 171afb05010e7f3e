"""Sequence packing by non-negative least squares over the length histogram.

1. Each task tokenises its documents and cuts each at multiples of the window: full pieces, and a remainder shorter than the
   window. A piece gets its rank among the pieces of its length within the task (its chunk). The table is written once.
2. The histogram of lengths (at most ``window`` bins) goes to the driver. Combinations of up to three lengths that fill the
   window exactly are enumerated; non-negative least squares (active set, columns taken in batches by gradient) solves how
   often each is used; counts are rounded and clamped to what is left; what remains is packed greedily, longest first with
   the longest that still fits. The plan has a row per combination and slot, not per document.
3. Ranks within a length become global by adding the counts of earlier chunks; a piece finds its plan row by binary search,
   and so its sequence and offset.

What the driver and the broadcast hold depends on the window only. Hot lengths are no group of one task anywhere: chunks
carry counts, not rows.

Defined results: null texts are empty and give one piece, the end token; every input row gives pieces, repeated rows too;
a null doc_id stays null; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shadowset.llm.common import arrow_map, stored
from shadowset.llm.tokens import Encoder, WordEncoder, encoder_of

WINDOW = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, chunk long, rank long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, Encoder | WordEncoder] = {}


def encoder(path: str) -> Encoder | WordEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = encoder_of(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with their ranks within the task and length; with_ids: also their ids."""
    tokenizer = tokenizer or tokenizer_path()

    def make():
        enc, tail = encoder(tokenizer), end.to_bytes(4, "little")
        chunk, ranks = TaskContext.get().partitionId(), [0] * (window + 1)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            row: list[int] = []
            out: list[tuple] = []
            ids: list[bytes] = []
            for i, data in enumerate(enc.ids_many(batch.column("text").to_pylist())):
                data += tail
                total = len(data) // 4
                for start in range(0, total, window):
                    part = data[4 * start : 4 * (start + window)]
                    n = len(part) // 4
                    row.append(i)
                    out.append((start, n, zlib.crc32(part), total, chunk, ranks[n]))
                    ranks[n] += 1
                    if with_ids:
                        ids.append(part)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "rank"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        return each

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, PIECES + (", ids binary" if with_ids else ""))


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three of the given lengths (descending, padded with 0) that sum to the window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [np.array([[window, 0, 0]])] if have[window] else []
    a = lengths[lengths < window]
    b = window - a
    two = have[b] & (a >= b)
    out.append(np.stack([a[two], b[two], np.zeros(two.sum(), int)], axis=1))
    for x in a[a >= -(-window // 3)]:
        y = a[(a <= x) & (a < window - x)]
        z = window - x - y
        good = (z <= y) & have[z]
        out.append(np.stack([np.full(good.sum(), x), y[good], z[good]], axis=1))
    return np.concatenate(out).astype(np.int64)


def solve(combos: np.ndarray, hist: np.ndarray, turns: int = 60, batch: int = 64) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that make the lengths' use least different from hist, in least squares. Active set method; columns enter in batches."""
    bins = len(hist)

    def matrix(which: np.ndarray) -> np.ndarray:
        m = np.zeros((bins, len(which)))
        for k in range(combos.shape[1]):
            np.add.at(m, (combos[which, k], np.arange(len(which))), (combos[which, k] > 0).astype(float))
        return m

    x, rest = np.zeros(len(combos)), hist.astype(float)
    active = np.zeros(len(combos), bool)
    for _ in range(turns):
        weight = rest.copy()
        weight[0] = 0
        gain = weight[combos].sum(axis=1)
        gain[active] = -np.inf
        order = np.argsort(-gain, kind="stable")[: batch * 8]
        used, enter = set(), []
        for j in order[gain[order] > 1e-6]:  # columns that share no length, so that all of them can grow
            if not used & (mine := set(combos[j].tolist()) - {0}):
                used |= mine
                enter.append(j)
            if len(enter) == batch:
                break
        if not enter:
            break
        active[enter] = True
        while True:
            which = np.flatnonzero(active)
            m = matrix(which)
            gram = m.T @ m
            gram[np.diag_indices_from(gram)] += 1e-9
            s = np.linalg.solve(gram, m.T @ hist)
            if (s > 0).all():
                x[:] = 0
                x[which] = s
                break
            low = s <= 0
            old = x[which]
            step = np.min(np.where(low, old / np.maximum(old - s, 1e-12), 1.0))
            x[which] = old + step * (s - old)
            out = which[(x[which] <= 1e-9) & low]
            active[out if len(out) else which[low]] = False
            x[~active] = 0
        rest = hist - m @ x[np.flatnonzero(active)]
        if np.abs(rest[1:]).sum() < 0.5:
            break
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, how many such sequences): uses every piece of the histogram exactly once."""
    left = hist.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        if times > 0:
            for n in lengths:
                left[n] -= times
            out.append((lengths, times))

    lengths = np.flatnonzero(left)
    if not len(lengths):
        return out
    take((window,), int(left[window]))
    combos = combinations(lengths[lengths < window], window)
    if len(combos):
        x = solve(combos, left[: window + 1].astype(float))
        for j in np.argsort(-x, kind="stable")[: int((x >= 0.5).sum())]:
            parts = tuple(int(n) for n in combos[j] if n)
            take(parts, min(int(np.rint(x[j])), *(int(left[n]) // parts.count(n) for n in set(parts))))
    while (have := np.flatnonzero(left)).size:  # greedily: the longest, then again and again the longest that fits
        parts, space, mine = [], window, {}
        while space:
            fits = [n for n in have[have <= space][::-1] if left[n] > mine.get(int(n), 0)][:1]
            if not fits:
                break
            n = int(fits[0])
            parts.append(n)
            mine[n] = mine.get(n, 0) + 1
            space -= n
        take(tuple(parts), min(int(left[n]) // k for n, k in mine.items()))
    return out


def slots(sequences: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Plan rows sorted by (length, first rank): key, first sequence, offset. Sequences of one combination are numbered one after the other."""
    rows, used, number = [], {}, 0
    for parts, times in sequences:
        offset = 0
        for n in parts:
            first = used.get(n, 0)
            rows.append((n, first, number, offset))
            used[n] = first + times
            offset += n
        number += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return (table[:, 0] << 44) + table[:, 1], table[:, 2] - table[:, 1], table[:, 3]


def placed(cut: DataFrame, window: int, planned: Callable[[np.ndarray, int], list[tuple[tuple[int, ...], int]]], kept: list[str]) -> DataFrame:
    """The columns kept of stored pieces, with sequence_id and offset: planned(histogram, window) says which lengths go together, and how often."""
    counts = cut.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    key, sequence, offset = slots(planned(hist, window))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("chunk", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cut.join(base, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("base"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rank = batch.column("rank").to_numpy()
            row = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + rank, "right") - 1
            where = {"sequence_id": pa.array(sequence[row] + rank), "offset": pa.array(offset[row])}
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *where.values()], names=[*kept, *where])

        return each

    kinds = dict(cut.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id long, offset long"
    return arrow_map(ranked.select(*kept, "rank"), make, schema)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (with_ids: and ids). Sequences of ``window`` tokens at most."""
    cut, _ = stored(pieces(docs, window, tokenizer, end, with_ids), "pieces")
    return placed(cut, window, plan, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])])
