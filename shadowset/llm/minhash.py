"""MinHash near-duplicates: universal hash minima, banding, signature check, exact check, components.

1. Each document's distinct word shingles become 64-bit values (words are hashed with XXH3, a shingle is a mixed sum). A
   128-bit digest of the whole set finds equal sets: they are one class, so copies cost nothing further.
2. A class has BANDS * ROWS minima under functions (a*x + b) mod 2^32. Classes that agree on all rows of a band share a
   bucket. At a similarity of 0.8 a pair misses all buckets with probability (1 - 0.8^6)^40 = 5e-6.
3. Pairs to compare come from buckets without listing all pairs of a large one. First every bucket's members are compared
   with its least one. Of buckets that then hold several components, those of at most SMALL members give all pairs across
   components. In a larger one the members are first compared with the one that has the fewest shingles of its own (none
   other among these classes has them). Members that are still outside a bucket's largest component are compared with its
   other components in blocks of bounded size, and only links come out of a block. What two sets have of their own bounds
   their similarity; pairs that this bound rules out are not compared. So a large group of near copies collapses after two
   stars of comparisons, and nothing is capped: in the end every pair of a bucket is compared, ruled out or connected.
4. A pair whose signatures agree on fewer than ``floor`` of the rows is dropped (at the threshold that is 8 standard
   deviations below the mean); the rest is compared on the whole texts' shingle sets.
5. Components come from large-star and small-star.

Defined results: texts that are null or without words have an empty set and link with nothing; fewer words than a shingle
give one shingle of all of them; equal sets link; every row is a document of its own, also where its id is null or rows
repeat an id, with the same text or another; a component is named by its least id that is not null (null if it has none);
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import HASHES, arrow_map, dropped, keyed, settled, stored
from shadowset.llm.components import components

BANDS, ROWS = 40, 6
SMALL = 24
_ODD = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles of the whole text, as sorted 64-bit values."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total += _mixed(h[i : len(h) - n + 1 + i] + _ODD[i]) * _ODD[i + 32]
    return np.unique(_mixed(total))


class Minima:
    """The minima of sets under ``k`` universal functions, in blocks that stay in the cache."""

    def __init__(self, k: int, block: int = 64):
        draw = np.random.default_rng(9).integers(0, 2**32, (2, k), dtype=np.uint64).astype(np.uint32)
        self.a, self.b, self.block = draw[0] | np.uint32(1), draw[1], block
        self.room = np.empty((block, k), np.uint32)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        x = (values >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), self.block):
            part = x[i : i + self.block, None]
            room = self.room[: len(part)]
            np.multiply(part, self.a, out=room)
            np.add(room, self.b, out=room)
            np.minimum(least, room.min(axis=0), out=least)
        return least


SIGNED = "doc_id long, m0 long, m1 long, n_shingles long, same binary, bands array<long>, low binary"


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of both, by which a row is found again."""
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), "text", F.xxhash64(doc, "text").alias("m0"), F.xxhash64(F.lit(1), "text", doc).alias("m1"))


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row: the size and a digest of its shingle set, a value for each band, and the low byte of each minimum."""

    def make():
        minima = Minima(bands * rows)
        weight = _ODD[:rows]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, same, keys, low = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                if not len(s):
                    same.append(None), keys.append(None), low.append(None)
                    continue
                same.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minima(s)
                key = _mixed((m.reshape(bands, rows).astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                keys.append(key.view(np.int64))
                low.append((m & np.uint32(255)).astype(np.uint8).tobytes())
            made = [pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "m0", "m1")), *made], names=[c.split()[0] for c in SIGNED.split(", ")])

        return each

    return arrow_map(_marked(docs), make, SIGNED)


#: Rows of one bucket that a join deals to one place, about; and the share of all rows beyond which a bucket counts as hot.
SPREAD, HOT = 128, 1000


def _places(n):
    return F.greatest(F.ceil(n / SPREAD), F.lit(1)).cast("int")


def _dealt(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """rows (band, n, ...) with one of their bucket's places, so that a large bucket's rows meet its facts in many tasks."""
    return rows.withColumn("place", F.pmod(F.xxhash64(doc), _places(F.col("n"))).cast("int"))


def _everywhere(facts: DataFrame) -> DataFrame:
    """facts on buckets (band, n, ...) at each of their bucket's places: one row for about SPREAD of the bucket."""
    return facts.withColumn("place", F.explode(F.sequence(F.lit(0), _places(F.col("n")) - 1)))


def _buckets(banded: DataFrame, counted: DataFrame) -> DataFrame:
    """Members of the buckets in counted (band, n, hub). Buckets with a share of 1 / HOT of all members, of which there are at
    most HOT, are made known to every task, which deals their members to many places."""
    least = max(SPREAD, (counted.agg(F.sum("n")).first()[0] or 0) / HOT)
    hot = F.broadcast(counted.filter(F.col("n") >= least).select("band", "n"))
    known = _dealt(banded.join(hot, "band", "left")).drop("n")  # place 0 where the bucket is not hot
    facts = _everywhere(counted.filter(F.col("n") >= least)).unionByName(counted.filter(F.col("n") < least).withColumn("place", F.lit(0)))
    return known.join(facts, ["band", "place"]).drop("place")


def _mixed_buckets(buckets: DataFrame, part: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: band, doc, size, n, part, major (whether in the bucket's largest component),
    others and others_size (members outside it and their shingles), all_size."""
    now = buckets.join(part, buckets.doc == part.node, "left").select(*(buckets[c] for c in ("band", "doc", "size", "n", "alone") if c in buckets.columns), F.coalesce("component", "doc").alias("part"))
    sizes = now.groupBy("band", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    mixed = sizes.groupBy("band").agg(F.max_by("part", "c").alias("most"), (F.sum("c") - F.max("c")).alias("others"), (F.sum("s") - F.max_by("s", "c")).alias("others_size"), F.sum("s").alias("all_size"), F.sum("c").alias("n")).filter("others > 0")
    return _dealt(now).join(_everywhere(mixed).drop("n"), ["band", "place"]).drop("place").withColumn("major", F.col("part") == F.col("most")).drop("most")


def _possible(x: str, y: str, percent: int):
    """Whether two sets can have the similarity, given their sizes and how many members of each no other set has."""
    most = F.least(F.col(f"n{x}") - F.col(f"u{x}"), F.col(f"n{y}") - F.col(f"u{y}"))
    return 100 * most >= percent * (F.col(f"n{x}") + F.col(f"n{y}") - most)


def _across(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs of a hub and a member of its bucket in another component. Both: band, n, doc, part, major, size, alone."""
    side = lambda d, x: d.select("band", "place", *(F.col(c).alias(f"{k}{x}") for c, k in (("doc", "d"), ("part", "p"), ("major", "m"), ("size", "n"), ("alone", "u"))))
    pairs = side(_dealt(members), "x").join(side(_everywhere(hubs), "y"), ["band", "place"]).filter((F.col("px") != F.col("py")) & _possible("x", "y", percent))
    return pairs.select(F.least("dx", "dy").alias("a"), F.greatest("dx", "dy").alias("b"))


#: Members of a block, of those outside a bucket's largest component and of all, and their shingles, about.
FEW, MANY, SHINGLES = 256, 1024, 1 << 20


def _blocks(now: DataFrame, payload: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between the members outside each bucket's largest component and its members in other components.

    now: of _mixed_buckets, with alone. payload: doc, size, bands, text. A task has one block of either kind, finds the links
    on whole shingle sets and gives nothing but links; a pair that shares several buckets is compared in the first of them.
    """
    few, many = (F.greatest(F.ceil(F.col(c) / n), F.ceil(F.col(s) / SHINGLES), F.lit(1)).cast("int") for c, n, s in (("others", FEW, "others_size"), ("n", MANY, "all_size")))
    own = lambda k: F.pmod(F.xxhash64("doc"), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    columns = ("band", "doc", "part", "major", "alone")
    hubs = now.filter(~F.col("major")).select(*columns, F.lit(True).alias("hub"), own(few).alias("f"), every(many).alias("m"))
    rest = now.select(*columns, F.lit(False).alias("hub"), every(few).alias("f"), own(many).alias("m"))

    def compare(group: pa.Table) -> pa.Table:
        hub = group.column("hub").to_numpy()
        doc, part, size, alone, major = (group.column(c).to_numpy() for c in ("doc", "part", "size", "alone", "major"))
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        text, known = group.column("text"), {}

        def of(i: int) -> np.ndarray:
            if doc[i] not in known:
                known[doc[i]] = shingles(text[i].as_py(), words)
            return known[doc[i]]

        at = int(np.flatnonzero(bands[0] == group.column("band")[0].as_py())[0])
        members, a, b = np.flatnonzero(~hub), [], []
        for i in np.flatnonzero(hub):
            most = np.minimum(size[i] - alone[i], size[members] - alone[members])
            good = (part[members] != part[i]) & (major[members] | (doc[members] > doc[i])) & (100 * most >= percent * (size[i] + size[members] - most))
            some = members[good]
            some = some[(bands[some, : at + 1] == bands[i, : at + 1]).argmax(axis=1) == at] if len(some) else some
            x = of(i)
            for j in some:
                y = of(j)
                where = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[where] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(min(doc[i], doc[j])), b.append(max(doc[i], doc[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return hubs.unionByName(rest).join(payload, "doc").groupBy("band", "f", "m").applyInArrow(compare, "a long, b long")


def _alone(texts: DataFrame, total: int, words: int) -> DataFrame:
    """doc, alone: how many shingles of each text no other one of texts has. total: about how many there are in all."""
    slots = max(1, total // 1_000_000)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            slot, doc, values = [], [], []
            for d, t in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                s = shingles(t.as_py(), words)
                at = s % np.uint64(slots)
                for k in np.unique(at):
                    slot.append(int(k)), doc.append(d), values.append(s[at == k].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(doc, pa.int64()), pa.array(values, pa.binary())], names=["slot", "doc", "shingles"])

        return each

    def count(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) for x in sets])
        single = np.concatenate(([0], np.cumsum(often[at] == 1)))
        return pa.table({"doc": group.column("doc"), "alone": pa.array(single[ends] - single[ends - [len(x) for x in sets]], pa.int64())})

    dealt = arrow_map(texts.select("doc", "text"), make, "slot long, doc long, shingles binary")
    return dealt.groupBy("slot").applyInArrow(count, "doc long, alone long").groupBy("doc").agg(F.sum("alone").alias("alone"))


def _near_signatures(pairs: DataFrame, classes: DataFrame, threshold: float, rows: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures do not speak against it."""
    side = lambda x: classes.select(F.col("doc").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("low").alias(f"l{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * round(100 * threshold)))
    floor = threshold - 8 * (threshold * (1 - threshold) / rows) ** 0.5

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            la, lb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), rows) for c in ("la", "lb"))
            return batch.select(["a", "b"]).filter(pa.array((la == lb).mean(axis=1) >= floor))

        return each

    return arrow_map(both.select("a", "b", "la", "lb"), make, "a long, b long")


def _alike(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Pairs whose whole shingle sets have the similarity."""
    percent = round(100 * threshold)
    side = lambda x: texts.select(F.col("doc").alias(x), F.col("text").alias(f"t{x}"))

    def make():
        recent: dict[int, np.ndarray] = {}

        def of(doc: int, text: pa.Scalar) -> np.ndarray:
            if doc not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[doc] = shingles(text.as_py(), words)
            return recent[doc]

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i, ta, tb in zip(range(len(batch)), batch.column("ta"), batch.column("tb"), strict=True):
                x, y = of(a[i], ta), of(b[i], tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return each

    return arrow_map(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb"), make, "a long, b long")


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc (a class) and a text of it."""
    return _marked(docs).join(classes.select("doc", "m0", "m1"), ["m0", "m1"]).select("doc", "text").dropDuplicates(["doc"])


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    signed, _ = stored(signatures(docs, words), "signed")
    reps = signed.filter("same is not null").groupBy("same").agg(F.min("doc_id").alias("of"), F.min(F.struct("m0", "m1", "n_shingles", "bands", "low")).alias("x"))
    classes, _ = stored(reps.select(F.monotonically_increasing_id().alias("doc"), "same", "of", "x.*"), "classes")
    banded = classes.select("doc", F.explode("bands").alias("band"))
    counted = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("hub")).filter("n > 1")
    counted, counted_at = stored(counted, "counted")
    buckets, buckets_at = stored(_buckets(banded, counted), "buckets")
    dropped(spark, counted_at)
    percent = round(100 * threshold)
    part, part_at = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component")), []  # without Python workers of its own

    def text_of(some: DataFrame) -> DataFrame:
        return _texts(docs, classes.join(some, "doc", "left_semi"))

    def compared(pairs: DataFrame, part: DataFrame) -> DataFrame:
        """The components after comparing pairs."""
        pairs, pairs_at = stored(pairs.distinct(), "pairs")
        if not pairs.limit(1).count():
            return part
        near, near_at = stored(_near_signatures(pairs, classes, threshold, BANDS * ROWS), "near")
        needed = near.select(F.col("a").alias("doc")).unionByName(near.select(F.col("b").alias("doc"))).distinct()
        part = joined(_alike(near, text_of(needed), words, threshold), part)
        dropped(spark, pairs_at, near_at)
        return part

    def joined(links: DataFrame, part: DataFrame) -> DataFrame:
        """The components with links added."""
        nonlocal part_at
        links, links_at = stored(links, "links")
        if not links.limit(1).count():
            dropped(spark, links_at)
            return part
        for x in ("a", "b"):
            links = links.join(part.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(x, F.coalesce(f"c{x}", x)).select("a", "b")
        new, new_at = components(links)
        moved = part.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        after, after_at = stored(moved.unionByName(new.join(part, "node", "left_anti")), "parts")
        dropped(spark, links_at, new_at, *part_at)
        part_at = [after_at]
        return after

    # every bucket's members meet its least one: a large group of near copies becomes few components
    part = compared(buckets.filter("doc != hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")), part)
    sized = classes.select("doc", F.col("n_shingles").alias("size"))
    open_, open_at = stored(_mixed_buckets(buckets.drop("hub").join(sized, "doc"), part), "open")
    small = open_.filter(F.col("n") <= SMALL).withColumn("alone", F.lit(0).cast("long"))
    pairs = _across(small, small, percent)
    large = open_.filter(F.col("n") > SMALL)
    members = large.select("doc", "size").distinct().agg(F.count(F.lit(1)), F.sum("size")).first()
    if members[0]:
        # the rest of a large one meets the member that has least of its own, and pairs that what each has of its own rules out are not asked
        alone, alone_at = stored(_alone(text_of(large.select("doc").distinct()), members[1], words), "alone")
        large, large_at = stored(large.join(alone, "doc"), "large")
        center = large.groupBy("band").agg(F.min(F.struct("alone", "doc")).alias("c")).select("band", F.col("c.doc").alias("doc"))
        pairs = pairs.unionByName(_across(large, large.join(center, ["band", "doc"], "left_semi"), percent))
    part = compared(pairs, part)
    if members[0]:
        now, now_at = stored(_mixed_buckets(large, part), "open")
        if now.limit(1).count():
            payload = text_of(now.select("doc").distinct()).join(classes.select("doc", F.col("n_shingles").alias("size"), "bands"), "doc")
            part = joined(_blocks(now.drop("size"), payload, words, percent), part)
        dropped(spark, now_at, alone_at, large_at)
    dropped(spark, buckets_at, open_at)
    parts = classes.select("same", "of", "doc").join(part, F.col("doc") == F.col("node"), "left").select("same", "of", F.coalesce("component", "doc").alias("part"))
    least = parts.groupBy("part").agg(F.min("of").alias("component"))
    named = parts.join(least, "part").select("same", "component")
    out = signed.select("doc_id", "n_shingles", "same").join(named, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each group (one with the least id; rows with a null doc_id come last).

    Every row is a document of its own, also where ids repeat or are null. Texts that are null or without words stay.
    """
    rows, key = keyed(docs, "rows")

    def chosen() -> DataFrame:
        near = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), words, threshold)
        named = near.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, F.col("doc_id").cast("long").alias("id")), key)
        return named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", F.col(key).alias("row"))).alias("x")).select(F.col("x.row").alias(key))

    kept = settled(docs.sparkSession, "kept", chosen)
    return rows.join(kept, key, "left_semi").select(*(f"`{c}`" for c in docs.columns))
