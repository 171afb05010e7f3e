import random
import zlib

import numpy as np
import pytest

from shadowset.llm import quality


def corpus(n):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(["the", "house", "of", "réal", "words", "and", "more"]) for _ in range(rnd.randint(5, 80))]
        good = rnd.random() < 0.7
        if not good:
            w = rnd.choice(([x.upper() + "!!" for x in w], [x + "$$$" for x in w], [w[0]] * len(w)))
        docs.append((i, " ".join(w), 0.5))
        labels.append((i, int(good), "de"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame([*docs, (9000, None, 1.0), (9001, "", 1.0), (None, "the house", 1.0), (3, docs[3][1], 0.1)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1, "x"), (5000, None, "x"), labels[0]], "doc_id long, quality int, lang string")
    rows = quality.quality_report(d, lab).collect()
    assert len(rows) == 604
    truth = {i: y for i, y, _ in labels}
    out = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 60 and np.mean([a == b for a, b in out]) > 0.97
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, n double")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, x) for i, y, x in labels]
    a, b = (sorted(map(tuple, quality.quality_report(d, spark.createDataFrame(x, "doc_id long, quality int, lang string")).collect())) for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 1, "x")]])
def test_without_both_labels(spark, labels):
    docs, _ = corpus(5)
    d = spark.createDataFrame(docs, "doc_id long, text string, n double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, lang string")
    assert {round(r.score, 6) for r in quality.quality_report(d, lab).collect()} == {0.5 if not labels else 0.999}
    assert quality.quality_report(d.limit(0), lab).count() == 0


def test_stage_keeps_columns(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    out = quality.accepted(d, spark.createDataFrame(labels, "doc_id long, quality int, lang string"))
    assert out.columns == d.columns and out.schema["score"].dataType.simpleString() == "double"
    kept = {r.doc_id for r in out.collect()}
    assert all((i in kept) == bool(y) for i, y, _ in labels)


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    m = quality.fit(x, y, trees=30)
    assert np.mean((m.score(x) > 0.5) == y) > 0.97
    for row in x[:20]:
        total = m.base
        for t in range(len(m.value)):
            at = 0
            while m.left[t, at] != at:
                at = m.left[t, at] if row[m.feature[t, at]] <= m.threshold[t, at] else m.right[t, at]
            total += m.value[t, at]
        assert abs(1 / (1 + np.exp(-total)) - m.score(row[None])[0]) < 1e-12


def test_the_first_split_is_the_best_of_all():
    """Every split between two values of every column is tried by adding up its halves."""
    rng = np.random.default_rng(8)
    for _ in range(10):
        x = rng.integers(0, 12, (60, 4)).astype(float)
        y = ((x[:, 2] > 6) ^ (rng.random(60) < 0.2)).astype(float)
        m = quality.fit(x, y, trees=1, depth=1, bins=200, rate=1.0, penalty=2.0)
        p = y.mean()
        g, h = p - y, np.full(60, p * (1 - p))
        part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 2.0)
        gain = {(f, v): part(x[:, f] <= v) + part(x[:, f] > v) for f in range(4) for v in np.unique(x[:, f])[:-1]}
        f, cut = int(m.feature[0, 0]), m.threshold[0, 0]
        went = x[:, f] <= cut
        assert abs(part(went) + part(~went) - max(gain.values())) < 1e-9
        for rows, leaf in ((went, m.left[0, 0]), (~went, m.right[0, 0])):
            assert abs(m.value[0, leaf] + g[rows].sum() / (h[rows].sum() + 2.0)) < 1e-9


def test_statistics_against_plain_counts():
    for text in ("", "Some words, some MORE words!!\nA line ; A line ; b\n\n a a a 42 é", "x" * 5000, "word " * 300_000):
        got = dict(zip(quality.NAMES, quality.statistics(text), strict=True))
        raw, words = text.encode(), text.encode().split()
        n = len(words)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        share = [raw.count(bytes([b])) / len(raw) for b in set(raw)] if raw else []
        want = {"log_bytes": np.log1p(len(raw)), "entropy": -sum(s * np.log2(s) for s in share), "log_words": np.log1p(n), "word_length": len(raw) / (n + 1) if raw else 0, "distinct_words": len(set(words)) / (n + 1)}
        want |= {"distinct_pairs": len({(a, b) for a, b in zip(words, words[1:])}) / max(1, n - 1), "stutter": sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1)}
        want |= {"log_lines": np.log1p(len(lines)), "distinct_lines": len(set(lines)) / max(1, len(lines)), "shouted": sum(len(w) > 1 and w.isupper() for w in words) / (n + 1), "top_word": max((words.count(w) for w in set(words)), default=0) / (n + 1)}
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items()), text[:20]
