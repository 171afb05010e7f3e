import math

import numpy as np

from shadowset.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, row string, slot int"


def brute(rows, every=100, k=5, low=80):
    part = []
    for n, (i, x, label, *_) in enumerate(rows):
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        part.append((n, i, (label + 1) % 10 if i % 7 == 0 else label, v))
    out = []
    for n, i, label, v in part:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, own == label) for m, j, own, w in part if m != n and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:k]:
            fit = [(t, j) for t, j, same in scored if not same and low * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 7) for r in rows], SCHEMA)


def vectors(n, seed=1, dims=8, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    out = []
    for i in range(n):
        x = centres[rng.integers(5)] + 0.3 * rng.normal(size=dims)
        out.append((i, (x / np.linalg.norm(x)).tolist(), int(rng.integers(labels))))
    return out


def got(spark, rows, **more):
    return sorted(map(tuple, hardneg.negatives_report(frame(spark, rows).repartition(3)).collect()))


def test_against_brute_force(spark):
    rows = vectors(900)
    assert got(spark, rows) == brute(rows) and len(brute(rows)) > 100


def test_odd_rows(spark):
    rows = vectors(400, 2)
    nan, inf = float("nan"), float("inf")
    rows += [(None, rows[0][1], 1), (500, None, 1), (600, [], 1), (700, [1.0, nan], 1), (800, [None] * 8, 0), (900, rows[3][1], None), (1000, [inf] * 8, 2)]
    rows += [(1100, rows[5][1], 1)] * 3 + [(1200, [0.0] * 8, 0)] * 2 + [(1300, [1.0, 0.5], 1), (1301, [1.0, 0.25], 1), (1302, [0.75, 0.5], 2)]
    rows += [(1400 + i, rows[7][1], i % 2) for i in range(30)]  # ties
    rows += [(2000, [-c for c in rows[9][1]], 9)]  # alone in its label
    assert got(spark, rows) == brute(rows)


def test_a_hot_vector(spark):
    rows = vectors(300, 3)
    rows = [(i, rows[0][1] if i % 3 else x, label) for i, x, label in rows]
    assert got(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    assert got(spark, [(100, [1.0, 0.0], 1)]) == []


def test_many_slots_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "SLOT_ROWS", 100)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    rows = vectors(1000, 4)
    want = []
    plain = [(i * 7 + 1, x, label) for i, x, label in rows]  # no id is divisible by 7: labels stay
    found = sorted(map(tuple, hardneg.hard_negatives(frame(spark, plain), every=20, positives=3, negatives=4, low=60).collect()))
    for i, x, label in plain:
        if i % 20:
            continue
        v = np.floor(256 * np.array(x, np.float32).astype(float))
        scored = sorted((-int(np.floor(256 * np.array(y, np.float32).astype(float)) @ v), j, own == label) for j, y, own in plain if j != i)
        for s, p, _ in [y for y in scored if y[2]][:3]:
            fit = [(t, j) for t, j, same in scored if not same and 60 * -s <= 100 * -t <= 100 * -s][:4]
            want += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    assert found == sorted(want) and len(want) > 100


def test_brackets_hold_and_tell_rows_apart():
    rng = np.random.default_rng(5)
    centres = 200 * rng.normal(size=(6, 16))
    x = np.floor(np.concatenate([c + 20 * rng.normal(size=(200, 16)) for c in centres]))
    most = (x * x).sum(axis=1).max()
    pivots = hardneg.chosen(x[::7], most)
    near = hardneg.distances(hardneg.lifted(x, most), pivots)
    q = x[::50]
    lower, upper = hardneg.reach(hardneg._query_near(q, pivots), near, near, (q * q).sum(axis=1), most)
    scores = q @ x.T
    assert (lower <= scores).all() and (scores <= upper).all()
    fifth = np.sort(scores, axis=1)[:, -5][:, None]
    assert (upper < fifth).mean() > 0.5  # most rows are told off without their vectors
    low, high = near[:200].min(axis=0, keepdims=True), near[:200].max(axis=0, keepdims=True)
    _, block = hardneg.reach(hardneg._query_near(q, pivots), low, high, (q * q).sum(axis=1), most)
    assert (block[:, 0] >= scores[:, :200].max(axis=1)).all() and (block[:, 0] < fifth[:, 0]).any()


def test_best_keeps_order_and_ties():
    best = hardneg.Best(2, 3)
    best.add(np.array([0, 0, 1, 0, 0]), np.array([5.0, 7, 1, 5, 5]), np.array([9, 1, 4, 3, 8]))
    best.add(np.array([0, 0, 1]), np.array([5.0, 6, 2]), np.array([2, 7, 4]))
    assert best.id[0].tolist() == [1, 7, 2] and best.score[0].tolist() == [7, 6, 5]
    assert best.id[1, :2].tolist() == [4, 4] and not np.isfinite(best.score[1, 2])
