"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from every whole text in one pass over Arrow batches. The model is fitted on the driver from at most
SAMPLE labelled rows outside the held-out fifth (those with the least hash of their id; the bound is a parameter). Only
their statistics are collected. The trees are flattened into arrays and all rows of a batch go down a tree together, level
by level. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have statistics of zero and a score like any other; rows of labels with a null id or
quality do not count, several labels of one id are averaged (a tie counts as 0); without labels of both kinds the score is
the share of label 1 (0.5 without any); repeated rows give a row each; a null doc_id is not held out; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import arrow_map

SAMPLE = 20_000
THRESHOLD = 0.3

_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": (32,),
    "line": (10, 13),
    "stop": map(ord, ".,;:?"),
    "bang": map(ord, "!"),
    "quote": map(ord, "'\"()-"),
    "symbol": map(ord, "#$%&*+/<=>@[\\]^_`{|}~"),
    "other": range(128, 256),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _MEMBER[list(_c), _i] = 1
NAMES = (
    "log_bytes", *(f"share_{c}" for c in _CLASSES), "entropy", "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs", "stutter",
    "log_lines", "distinct_lines", "line_words", "plain_words", "lone_marks", "shouted", "marked_ends",
)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, in the order of NAMES."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    some = share[share > 0]
    words = raw.split()
    n = len(words)
    often = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    plain = sum(c for w, c in often.items() if w.isalpha() or w[-1:] in b".,;:?!" and w[:-1].isalpha())
    lone = sum(c for w, c in often.items() if len(w) == 1 and not w.isalnum() and w < b"\x80")
    shouted = sum(c for w, c in often.items() if len(w) > 1 and w.isupper())
    marked = sum(c for w, c in often.items() if len(w) > 2 and w[-1] in b"!#$%&*|~" and w[-2] == w[-1])
    pairs = len(set(zip(words, words[1:], strict=False)))
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    out[:] = (
        np.log1p(len(raw)), *(share @ _MEMBER), -(some * np.log2(some)).sum(), np.log1p(n), len(raw) / (n + 1), len(often) / (n + 1), max(often.values(), default=0) / (n + 1),
        pairs / max(1, n - 1), stutter / max(1, n - 1), np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), plain / (n + 1), lone / (n + 1),
        shouted / (n + 1), marked / (n + 1),
    )
    return out


@dataclass
class Trees:
    """Boosted trees as arrays: row t of each belongs to tree t; a leaf points to itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, cut, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, f[at]] <= cut[at], left[at], right[at])
            total += value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 48, rate: float = 0.15, penalty: float = 2.0, least: float = 2.0) -> Trees:
    """Gradient boosting of the logistic loss; split points from histograms over quantile bins."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    size = 2 ** (depth + 1) - 1
    model = Trees(float(np.log(p / (1 - p))), *(np.zeros((0, size), t) for t in (np.int32, float, np.int32, np.int32, float)), depth)
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    total, kinds = np.full(len(y), model.base), x.shape[1]
    flat = binned + np.arange(kinds) * bins
    grown = []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        g, h = prob - y, prob * (1 - prob)
        feature, cut, value = np.zeros(size, np.int32), np.zeros(size), np.zeros(size)
        left, right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        members = {0: np.arange(len(y))}
        for node in range(size):
            rows = members.pop(node, None)
            if rows is None:
                continue
            sg, sh = g[rows].sum(), h[rows].sum()
            value[node] = -rate * sg / (sh + penalty)
            if node >= 2**depth - 1 or len(rows) < 2 * least:
                continue
            index = flat[rows].ravel()
            hg = np.bincount(index, np.repeat(g[rows], kinds), kinds * bins).reshape(kinds, bins).cumsum(axis=1)
            hh = np.bincount(index, np.repeat(h[rows], kinds), kinds * bins).reshape(kinds, bins).cumsum(axis=1)
            gain = hg**2 / (hh + penalty) + (sg - hg) ** 2 / (sh - hh + penalty) - sg**2 / (sh + penalty)
            gain[(hh < 1e-3) | (sh - hh < 1e-3)] = 0
            f, b = divmod(int(gain.argmax()), bins)
            if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                continue
            goes = binned[rows, f] <= b
            if goes.all() or not goes.any():
                continue
            feature[node], cut[node], left[node], right[node] = f, cuts[f][b], 2 * node + 1, 2 * node + 2
            members[2 * node + 1], members[2 * node + 2] = rows[goes], rows[~goes]
        grown.append((feature, cut, left, right, value))
        at = np.zeros(len(y), np.int32)
        for _ in range(depth):
            at = np.where(x[np.arange(len(y)), feature[at]] <= cut[at], left[at], right[at])
        total += value[at]
    model.feature, model.threshold, model.left, model.right, model.value = (np.stack(a) for a in zip(*grown, strict=True))
    return model


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled rows outside the held-out fifth."""
    said = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(~held_out())
    said = said.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("_y"))
    said = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so the broadcast has at most that many rows
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(said), "doc_id")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [statistics(t.as_py()) for t in batch.column("text")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

        return each

    seen = arrow_map(chosen.select("doc_id", "_y", "text"), make, "doc_id long, y int, x array<double>")
    rows = sorted(seen.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.y", "r.x").collect())
    return fit(np.array([r.x for r in rows]).reshape(-1, len(NAMES)), np.array([r.y for r in rows], float))


def scored(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """docs (whatever columns) with the score, in place of a column that has its name."""
    columns = [c for c in docs.columns if c != name]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(f"`{c}`" for c in columns)).schema) + f", `{name}` double"

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, len(NAMES))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*columns, name])

        return each

    return arrow_map(docs.select(*(f"`{c}`" for c in columns)), make, schema)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels, sample))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """docs without those that the classifier rejects: every row by itself, repeated ones and those with a null id or text included."""
    name = "score"
    while name in docs.columns:
        name = "_" + name
    return scored(docs, train(docs, labels, sample), name).filter(F.col(name) >= threshold).drop(name)
