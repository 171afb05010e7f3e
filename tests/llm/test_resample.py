import glob
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from shadowset.llm import resample
from shadowset.llm.common import GROUP_ROWS


def runs(text, most=3):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20):
    """(doc_id, n_features, weight, score, rank) of every row."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    counts = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in counts:
        s.update(map(bucket, f))
    for x in target:
        t.update(map(bucket, runs(x)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for i, n, f in counts:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(x)) for x in f)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return sorted(map(str, (x[:5] for x in out)))


def rows_of(df):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r.rank]) for r in df.collect())


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["alpha", "Beta", "gamma9", "\u00e9t\u00e9", "x" * 90, "\U0001f600z", "d", "the", "of"]
    return [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(n)]


ODD = [None, "", " -- ", "one", "Two Words", "w" * 3000 + " tail " + "w" * 3000, "long text " * 30000]


def test_against_brute_force(spark):
    docs = list(enumerate(texts(120) + ODD)) + [(3, "again the same id " * 8)] * 2 + [(None, "row without an id " * 9)] * 3
    target = texts(9, 2) + ["alpha alpha of gamma9 " * 5, None, ""]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, _rank string").repartition(5)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert rows_of(resample.importance_report(frame, aim)) == brute(docs, target)


def test_empty_tables(spark):
    docs, aim = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert resample.importance_report(docs, aim).count() == 0
    some = list(enumerate(texts(50, 4)))
    assert rows_of(resample.importance_report(spark.createDataFrame(some, "doc_id long, text string"), aim)) == brute(some, [])


def test_drawn_rows_keep_their_columns(spark):
    docs = [(i, t) for i, t in enumerate(texts(200, 6))]
    frame = spark.createDataFrame([(i, t, "a", i) for i, t in docs], "doc_id long, text string, _row string, rank long")
    aim = spark.createDataFrame([("alpha the of " * 9,)], "text string")
    got = resample.resampled(frame, aim, 20)
    assert got.dtypes == frame.dtypes
    ranked = {r.doc_id for r in resample.drawn(frame.selectExpr("doc_id as row", "doc_id", "text"), aim, 20).collect() if r.rank}
    assert {r.doc_id for r in got.collect()} == ranked and all(r.rank == r.doc_id for r in got.collect())


def test_runs_have_the_crc_of_their_bytes():
    words = [w.encode() for w in ("a", "\u00e9", "x" * 63, "y" * 64, "z" * 500, "q")]
    keys, counts = resample.Grams(1 << 32, 3).keys([words, [], words[:1]])
    want = Counter()
    for d, w in enumerate((words, [], words[:1])):
        want.update((d << 32) + zlib.crc32(b" ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert dict(zip(keys.tolist(), counts.tolist())) == want


def test_more_likely_texts_weigh_more(spark):
    docs = [(i, "common words all over the place " * 6) for i in range(50)] + [(99, "rare target phrase " * 12)]
    aim = spark.createDataFrame([("rare target phrase " * 5,)], "text string")
    got = {r.doc_id: r.weight for r in resample.importance_report(spark.createDataFrame(docs, "doc_id long, text string"), aim).collect()}
    assert got[99] > max(v for k, v in got.items() if k != 99)


def test_blocks_and_row_groups_are_bounded(spark):
    """A block has about TOGETHER words, and a row group few blocks, however long a task's input is."""
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda k: F.substring(F.md5(F.concat_ws("-", "id", k).cast("binary")), 1, 6))
    docs = spark.range(1200).coalesce(1).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    blocks, path = resample.count_matrix(docs)
    sizes = [sum(r.n_words) for r in blocks.select("n_words").collect()]
    assert sum(sizes) == 1200 * 400 and max(sizes) < resample.TOGETHER + 400
    files = glob.glob(path.removeprefix("file://") + "/*.parquet")
    groups = [m.row_group(i) for m in (pq.ParquetFile(f).metadata for f in files) for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == len(sizes) > GROUP_ROWS and max(g.num_rows for g in groups) <= GROUP_ROWS
