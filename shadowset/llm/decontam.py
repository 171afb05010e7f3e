"""Benchmark decontamination with a distributed positional inverted index.

1. *Index.* Every task tokenises its documents and stores index shards (one for each Arrow batch) in the shared folder.
   A shard lays its documents out in one token space, with a gap after each, and holds for every word (as a 64-bit hash) the
   sorted list of its positions. The index knows nothing of the benchmark: the corpus is read once, whatever is searched for.
2. *Counts.* How often the benchmark's words occur in the whole corpus is summed from the shards' list lengths.
3. *Search.* Each shard is searched on its own. Phrases are dropped from their rarest word on as soon as the shard lacks one of
   their words. A phrase's starting points are the list of its rarest word, moved back by the word's offset; they are
   intersected with the offset-adjusted lists of its other words, rarest first, for all phrases at once. No shuffle, no pairs of
   documents and items.

The benchmark is handled in blocks of about BLOCK_CHARS characters by item hash (an item is never cut), one on the driver at a
time and each a pass over the index; a block's results are merged by document row.

Defined results: a null or wordless text has no words and is never contaminated; items without words match nothing; equal
items share their windows and all of their ids count; the windows of items with a null id count as hits, but such items are
not named or counted; an empty benchmark contaminates nothing; repeated document rows give a row each; a null doc_id stays
null; extra columns are ignored. Two words that share a 64-bit hash would be taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import HASHES, arrow_map, bound_batches, keyed, settled, stored

WINDOW = 13
BLOCK_CHARS = 4 << 20
#: Starting points compared at a time, at most.
POINTS = 1 << 20
#: A-Z in lower case, word characters as they are, everything else a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = "shard long, doc_ids array<long>, starts array<int>, n_words array<int>, terms binary, counts binary, positions binary"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def hashed(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(HASHES.__getitem__, w), np.uint64, len(w))


class Phrases:
    """The windows of a block of items: distinct word sequences, and the items that each stands for."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        seen: dict[bytes, set] = {}
        for item, text in items:
            h = hashed(text)
            for i in range(max(1, len(h) - window + 1) if len(h) else 0):
                seen.setdefault(h[i : i + window].tobytes(), set()).update(() if item is None else (str(item),))
        rows = [np.frombuffer(p, np.uint64) for p in seen]
        self.vocabulary = np.unique(np.concatenate(rows)) if rows else np.empty(0, np.uint64)
        self.window = window
        self.items = list(seen.values())
        self.lengths = np.array([len(p) for p in rows], np.int32)
        self.terms = np.full((len(rows), window), -1, np.int32)
        for row, p in zip(self.terms, rows, strict=True):
            row[: len(p)] = np.searchsorted(self.vocabulary, p)


def build_index(docs: DataFrame, gap: int = 64) -> tuple[DataFrame, str]:
    """Store the positional index of docs (doc_id, text): the positions of all words."""

    def make():
        count = iter(range(1 << 33))
        part = TaskContext.get().partitionId() << 33

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, where, starts, lengths, at = [], [], [], [], 0
            for text in batch.column("text"):
                h = hashed(text.as_py())
                ids.append(h)
                where.append(np.arange(at, at + len(h), dtype=np.int32))
                starts.append(at)
                lengths.append(len(h))
                at += len(h) + gap
            ids, where = np.concatenate(ids), np.concatenate(where)
            by = np.argsort(ids, kind="stable")
            ids, where = ids[by], where[by]
            first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)
            counts = np.diff(np.append(first, len(ids))).astype(np.int32)
            steps = np.diff(where, prepend=np.int32(0)).astype(np.int32)  # small numbers compress well
            one = lambda values: pa.array([np.array(values, np.int32)], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part + next(count)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column("doc_id").cast(pa.int64())),
                    one(starts),
                    one(lengths),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (ids[first], counts, steps)),
                ],
                names=[c.split()[0] for c in INDEX.split(", ")],
            )

        return each

    return stored(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, INDEX), "postings", large_rows=True)


class Shard:
    """A row of the index as arrays: the sorted words, where each one's list begins, and the lists."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        data = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        self.number = batch.column("shard")[i].as_py()
        self.terms = data("terms", np.uint64)
        self.edge = np.concatenate(([0], np.cumsum(data("counts", np.int32), dtype=np.int64)))
        self.positions = np.cumsum(data("positions", np.int32), dtype=np.int32)
        self.starts, self.n_words = (batch.column(c)[i].values.to_numpy() for c in ("starts", "n_words"))
        self.doc_ids = batch.column("doc_ids")[i].values

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length of each word's list."""
        return _found(self.terms, self.edge, terms)

    def list(self, term: int) -> np.ndarray:
        begin, n = self.lists(np.array([term], np.uint64))
        return self.positions[begin[0] : begin[0] + n[0]]

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def _found(known: np.ndarray, edge: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    i = np.minimum(np.searchsorted(known, terms), len(known) - 1)
    return edge[i], np.where(known[i] == terms, edge[i + 1] - edge[i], 0)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the (sorted, distinct) terms occurs in the whole index. Every task sends one row for each of them that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for a, c in zip(batch.column("terms"), batch.column("counts"), strict=True):
                edge = np.concatenate(([0], np.cumsum(np.frombuffer(c.as_buffer(), np.int32), dtype=np.int64)))
                total += _found(np.frombuffer(a.as_buffer(), np.uint64), edge, terms)[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    bound_batches(index.sparkSession)
    out = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def rarest_first(phrases: Phrases, counts: np.ndarray) -> np.ndarray:
    """For each phrase its offsets, by how rare their words are."""
    often = np.append(counts, np.iinfo(np.int64).max)
    return np.argsort(often[phrases.terms], axis=1, kind="stable").astype(np.int32)


def search(shard: Shard, phrases: Phrases, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which phrases start where in the shard."""
    begin, n = shard.lists(phrases.vocabulary)
    alive = np.arange(len(phrases.terms))
    for k in range(phrases.window):
        t = phrases.terms[alive, order[alive, k]]
        alive = alive[(t < 0) | (n[t] > 0)]
    if not len(alive):
        return alive, alive
    # the lists of the block's words, as the word at each position
    size = int(shard.starts[-1] + shard.n_words[-1]) + phrases.window
    word_at = np.full(size, -1, np.int32)
    for t in np.unique(phrases.terms[alive]):
        if t >= 0:
            word_at[shard.positions[begin[t] : begin[t] + n[t]]] = t
    found, where = [], []
    rarest = phrases.terms[alive, order[alive, 0]]
    chunk = np.cumsum(n[rarest]) // POINTS
    for part in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(chunk)) + 1):
        many = n[rarest[part]]
        phrase = np.repeat(alive[part], many)
        inner = np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many)
        at = shard.positions[np.repeat(begin[rarest[part]], many) + inner] - order[phrase, 0]
        keep = at >= 0
        phrase, at = phrase[keep], at[keep]
        for k in range(1, phrases.window):
            o = order[phrase, k]
            t = phrases.terms[phrase, o]
            keep = (t < 0) | (word_at[np.minimum(at + o, size - 1)] == t)
            phrase, at = phrase[keep], at[keep]
            if not len(at):
                break
        found.append(phrase), where.append(at)
    return np.concatenate(found), np.concatenate(where)


MATCHES = "shard long, row int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def find_phrases(index: DataFrame, phrases: Phrases, matched_only: bool = False) -> DataFrame:
    """One row per document (matched_only: with a match): the joined stretches that phrases cover, and the ids of the items they are of."""
    order = rarest_first(phrases, term_counts(index, phrases.vocabulary))

    def make():
        def one(shard: Shard) -> pa.RecordBatch:
            phrase, at = search(shard, phrases, order)
            size = int(shard.starts[-1] + shard.n_words[-1]) + 1
            step = np.bincount(at, minlength=size + 1) - np.bincount(at + phrases.lengths[phrase], minlength=size + 1) if len(at) else np.zeros(size + 1, np.int64)
            items: dict[int, set] = {}
            for d, p in np.unique(np.stack([shard.documents(at), phrase], 1), axis=0).tolist() if len(at) else ():
                items.setdefault(d, set()).update(phrases.items[p])
            covered = np.concatenate(([False], np.cumsum(step[:-1]) > 0, [False]))
            edges = np.flatnonzero(np.diff(covered.astype(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            of = shard.documents(starts)
            took = np.array(sorted(items), np.int64) if matched_only else np.arange(len(shard.starts))
            lo, hi = np.searchsorted(of, took), np.searchsorted(of, took, "right")
            base = shard.starts
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(took), shard.number), pa.int64()),
                    pa.array(took.astype(np.int32)),
                    shard.doc_ids.take(pa.array(took)),
                    pa.array(shard.n_words[took].astype(np.int64)),
                    pa.array([(starts[a:b] - base[d]).astype(np.int32) for d, a, b in zip(took, lo, hi, strict=True)], pa.list_(pa.int32())),
                    pa.array([(ends[a:b] - base[d]).astype(np.int32) for d, a, b in zip(took, lo, hi, strict=True)], pa.list_(pa.int32())),
                    pa.array([sorted(items.get(int(d), ())) for d in took], pa.list_(pa.string())),
                ],
                names=[c.split()[0] for c in MATCHES.split(", ")],
            )

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = pa.Table.from_batches([one(Shard(batch, i)) for i in range(len(batch))]).combine_chunks().to_batches()
            return found[0] if found else None

        return each

    return arrow_map(index, make, MATCHES)


def find_near(index: DataFrame, queries: list[tuple], slop: int) -> DataFrame:
    """Proximity: for each query (id, text) the documents that hold all of its distinct words within ``slop`` consecutive words, with the tightest such
    stretch (the first of equally tight ones). index: of build_index with a gap of at least slop."""
    asked = [(q, t) for q, t in ((q, np.unique(hashed(text))) for q, text in queries) if len(t)]
    every = np.unique(np.concatenate([t for _, t in asked])) if asked else np.empty(0, np.uint64)
    often = dict(zip(every.tolist(), term_counts(index, every).tolist(), strict=True))
    asked = [(q, sorted(t.tolist(), key=often.get)) for q, t in asked]

    def make():
        def tightest(shard: Shard, terms: list[int]) -> dict[int, tuple[int, int]]:
            near = []
            for i, t in enumerate(terms):  # the rarest first: the others only count near it
                pos = shard.list(t)
                if i:
                    j = np.searchsorted(near[0], pos)
                    gap = np.minimum(np.abs(near[0][np.minimum(j, len(near[0]) - 1)] - pos), np.abs(near[0][np.maximum(j - 1, 0)] - pos))
                    pos = pos[gap < slop]
                if not len(pos):
                    return {}
                near.append(pos)
            best: dict[int, tuple[int, int]] = {}
            last = [-slop - 1] * len(terms)
            for p, i in sorted((int(p), i) for i, x in enumerate(near) for p in x):
                last[i] = p
                low = min(last)
                if low >= 0 and p - low < slop:
                    d = int(shard.documents(np.array([p]))[0])
                    if low >= shard.starts[d] and (d not in best or p + 1 - low < best[d][1] - best[d][0]):
                        best[d] = (low, p + 1)
            return best

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for i in range(len(batch)):
                shard = Shard(batch, i)
                for q, terms in asked:
                    out += [(str(q), shard.doc_ids[d].as_py(), int(a - shard.starts[d]), int(b - shard.starts[d])) for d, (a, b) in tightest(shard, terms).items()]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["query", "doc_id", "start", "end"])

        return each

    return arrow_map(index, make, "query string, doc_id long, start long, end long")


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items, in blocks of about BLOCK_CHARS characters, one at a time."""
    items = benchmark.select("item_id", "text")
    n = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [(r[0], r[1]) for r in (items.filter(block == i) if n > 1 else items).collect()]


def _merged(matches: DataFrame) -> DataFrame:
    """Matches of several blocks as one row per document."""
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    whole = matches.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def join(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], x["ends"]).alias("ends"))))
        return F.when((F.size(acc) > 0) & (last["ends"] >= x["starts"]), longer).otherwise(F.concat(acc, F.array(x)))

    spans = F.aggregate("spans", F.expr("array()").cast("array<struct<starts:int,ends:int>>"), join)
    return whole.withColumn("spans", spans).select("shard", "row", "doc_id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: how many of its words lie inside an occurrence of a window of a benchmark item, and whose."""
    bound_batches(docs.sparkSession)
    index, _ = build_index(docs)
    found, blocks = None, blocks_of(benchmark)
    for i, items in enumerate(blocks):
        some = find_phrases(index, Phrases(items, window), matched_only=i > 0)
        found = some if found is None else found.unionByName(stored(some, "matches")[0])
    if i:
        found = _merged(found)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        found.withColumn("n_hit", hit)
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, null_ids: bool = False) -> DataFrame:
    """docs without the contaminated rows; of a repeated doc_id only those go. Rows with a null doc_id stay, unless null_ids: then they are judged as all others."""
    rows, key = keyed(docs, "rows")
    asked = rows if null_ids else rows.filter("doc_id is not null")
    judged = lambda: contamination(asked.select(F.col(key).alias("doc_id"), "text"), benchmark)
    bad = settled(docs.sparkSession, "contaminated", lambda: judged().filter("contaminated").select(F.col("doc_id").alias(key)))
    return rows.join(bad, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
