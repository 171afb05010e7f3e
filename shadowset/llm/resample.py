"""Importance resampling towards a target: hashed n-gram counts as compressed sparse rows, gains by bucket, a draw by Gumbel keys.

1. *Count matrix.* Every task counts its documents' runs of 1 to 3 words by bucket (CRC-32 modulo BUCKETS) and stores the counts
   as CSR blocks of about TOGETHER words: row pointers, bucket steps within a row, counts. The CRC of a run follows from those of
   its words: appending bytes is linear over bits, so tables by length move a whole array of them at once.
2. *Distributions.* Column sums of the blocks, added up in each task and then by bucket, give the corpus' counts; the target's
   text goes the same way. BUCKETS numbers of each reach the driver, whatever the tables' size.
3. *Weights.* The sparse matrix times the vector of gains, block by block; a row's gains are added as integers.
4. *Draw.* Gumbel noise from a hash of the id makes the highest scores a sample without replacement in proportion to the
   exponential of the weights. Ranks come from sorted ranges; no window runs over all rows.

Defined results: a null or wordless text has no features, weight 0 and is not drawn (it has fewer than LEAST words); every row
gives one row, repeated rows too, each with a rank of its own; a null doc_id is hashed as an empty one and comes last among ties;
an empty target has no counts (gains are then those of smoothing alone); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import WORDS, arrow_map, bound_batches, keyed, stored
from shadowset.llm.decontam import words
from shadowset.plans.ranking import with_rank

BUCKETS, GRAM, LEAST, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Words that are counted together, about; bytes by which CRCs are moved by table, longer words go one by one.
TOGETHER, FAR = 1 << 16, 64
BLOCK = "rows array<long>, doc_ids array<long>, n_words array<long>, n_features array<long>, indptr binary, steps binary, counts binary"


def _shifts() -> np.ndarray:
    """[n, k, b]: the CRC register after n more zero bytes if its k-th byte is b and all else is zero."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(FAR):
        now = (now >> np.uint32(8)) ^ byte[now & np.uint32(255)]
        out.append(now)
    return np.stack(out)


class Grams:
    """Buckets of the runs of words of a document, with a memory of words' CRCs."""

    def __init__(self, buckets: int, gram: int):
        self.buckets, self.gram, self.shifts = buckets, gram, _shifts()
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        """The CRCs of the word (low half) and of a space and the word (high half)."""
        value = zlib.crc32(word) | zlib.crc32(b" " + word) << 32
        if len(self.known) < WORDS:
            self.known[word] = value
        return value

    def keys(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """document * buckets + bucket of every run, ascending, and how often it occurs."""
        flat = [w for t in texts for w in t]
        get, make = self.known.get, self._word
        packed = np.fromiter((get(w) or make(w) for w in flat), np.uint64, len(flat))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        crc, tail = packed.astype(np.uint32), (packed >> np.uint64(32)).astype(np.uint32)
        length = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        far = np.flatnonzero(length > FAR)
        length[far] = 0
        out = [doc * self.buckets + crc.astype(np.int64) % self.buckets]
        for n in range(1, self.gram):
            before = np.concatenate((np.zeros(1, np.uint32), crc[:-1])) if len(crc) else crc
            crc = tail.copy()
            for k in range(4):
                crc ^= self.shifts[length, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
            for i in far:
                crc[i] = zlib.crc32(b" " + flat[i], int(before[i]))
            whole = place >= n
            out.append(doc[whole] * self.buckets + crc[whole].astype(np.int64) % self.buckets)
        return np.unique(np.concatenate(out), return_counts=True)


def _gathered(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Documents in groups of about TOGETHER words."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= TOGETHER:
            yield group
            group, n = [], 0
    if group:
        yield group


def count_matrix(docs: DataFrame, row: str = "row", buckets: int = BUCKETS, gram: int = GRAM) -> tuple[DataFrame, str]:
    """The CSR blocks of docs (row, doc_id, text), stored."""

    def make():
        grams = Grams(buckets, gram)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ends, n_words, blocks = [0], [], []
            for group in _gathered(words(t.as_py()) for t in batch.column("text")):
                ends.append(ends[-1] + len(group))
                n_words += map(len, group)
                keys, n = grams.keys(group)
                doc, bucket = np.divmod(keys, buckets)
                indptr = np.searchsorted(doc, np.arange(len(group) + 1))
                step = np.diff(bucket, prepend=0)
                first = indptr[:-1][np.diff(indptr) > 0]
                step[first] = bucket[first]
                blocks.append((indptr.astype(np.int64).tobytes(), step.astype(np.uint16 if buckets <= 1 << 16 else np.uint32).tobytes(), n.astype(np.int32).tobytes()))
            n_words = np.array(n_words, np.int64)
            n_features = sum(np.maximum(n_words - k, 0) for k in range(gram))
            dealt = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [
                    dealt(batch.column(row).cast(pa.int64())),
                    dealt(batch.column("doc_id").cast(pa.int64())),
                    dealt(pa.array(n_words)),
                    dealt(pa.array(n_features)),
                    *(pa.array(x, pa.binary()) for x in zip(*blocks, strict=True)),
                ],
                names=[c.split()[0] for c in BLOCK.split(", ")],
            )

        return each

    return stored(arrow_map(docs.select(F.col(f"`{row}`").alias(row), F.col("doc_id").cast("long").alias("doc_id"), "text"), make, BLOCK), "csr", large_rows=True)


def _opened(batch: pa.RecordBatch, i: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, buckets and counts of a block."""
    data = {c: batch.column(c)[i].as_py() for c in ("indptr", "steps", "counts")}
    indptr, counts = np.frombuffer(data["indptr"], np.int64), np.frombuffer(data["counts"], np.int32)
    run = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.frombuffer(data["steps"], np.uint16 if buckets <= 1 << 16 else np.uint32), dtype=np.int64)))
    return indptr, run[1:] - np.repeat(run[indptr[:-1]], np.diff(indptr)), counts


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all blocks."""
    bound_batches(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, bucket, counts = _opened(batch, i, buckets)
                total += np.bincount(bucket, counts, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    sums = blocks.select("indptr", "steps", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # a row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: a thousand times the logarithm of how much likelier it is in the target, smoothed by one and rounded down."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * s_all / ((float(corpus[b]) + 1) * t_all))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, target: DataFrame, row: str = "row", buckets: int = BUCKETS, gram: int = GRAM) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of every row of docs (row, doc_id, text). target: a table with a text."""
    blocks, _ = count_matrix(docs, row, buckets, gram)
    aim, _ = count_matrix(target.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("doc_id"), "text"), "row", buckets, gram)
    gain = gains(column_sums(blocks, buckets), column_sums(aim, buckets))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            weights = []
            for i in range(batch.num_rows):
                indptr, bucket, counts = _opened(batch, i, buckets)
                run = np.concatenate((np.zeros(1, np.int64), np.cumsum(gain[bucket] * counts)))
                weights.append(run[indptr[1:]] - run[indptr[:-1]])
            flat = [batch.column(c).flatten() for c in ("rows", "doc_ids", "n_words", "n_features")]
            return pa.RecordBatch.from_arrays([*flat, pa.array(np.concatenate(weights))], names=[row, "doc_id", "n_words", "n_features", "weight"])

        return each

    return arrow_map(blocks, make, f"{row} long, doc_id long, n_words long, n_features long, weight long")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, seed: int = SEED, row: str = "row") -> DataFrame:
    """row, doc_id, n_features, weight, score, rank of every row of docs (row, doc_id, text); rank is null for those not drawn."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored, _ = stored(weighed(docs, target, row).withColumn("score", F.col("weight") + noise).withColumn("_out", F.col("n_words") < least), "weights")
    many = percent * scored.filter("not _out").count() // 100
    order = [F.col("_out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col(row)]
    ranked = with_rank(scored, order, "_rank")
    return ranked.select(row, "doc_id", "n_features", "weight", "score", F.when(F.col("_rank") < many, F.col("_rank").cast("long") + 1).alias("rank"))


def importance_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs."""
    return drawn(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), target).drop("row")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    rows, key = keyed(docs, "resample")
    kept = drawn(rows.select(F.col(f"`{key}`").alias("row"), "doc_id", "text"), target, percent).filter("rank is not null")
    return rows.join(kept.select(F.col("row").alias(key)), key, "left_semi").select(*(f"`{c}`" for c in docs.columns))
