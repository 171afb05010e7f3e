import math

import numpy as np
import pytest

from shadowset.llm import itq

SHAPE = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.93):
    keep = list(rows)
    ok = [i for i, r in enumerate(keep) if r[2] is not None and r[1] and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])]
    links, up = [0] * len(keep), list(range(len(keep)))
    v = {i: np.array(keep[i][1], np.float32).astype(float) for i in ok}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ok:
        for b in ok:
            if a < b and keep[a][2] == keep[b][2] and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]) >= least:
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    low = {}
    for i, r in enumerate(keep):
        known = [x for x in (r[0], low.get(top(i))) if x is not None]
        low[top(i)] = min(known) if known else None
    return sorted(((r[0], links[i], low[top(i)], low[top(i)] == r[0]) for i, r in enumerate(keep)), key=str)


def data(n=300, d=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, d))
    rows = [(int(i * 2), (base[rng.integers(40)] + rng.normal(size=d) * rng.choice([0, 0.02, 0.1, 0.25])).tolist(), int(i % 2)) for i in range(n)]
    x = rows[0][1]
    return rows + [(1, None, 0), (3, [], 0), (5, [0.0] * d, 0), (7, [float("nan")] * d, 0), (9, [None, *x[1:]], 0), (11, x, None), (13, x, 0), (13, x, 0), (0, rows[8][1], 1), (None, x, 0), (None, None, 0), (None, [9.0, -9.0], 1), (15, [1.0, 2.0], 0), (17, [1.0, 2.1], 0), (19, [1e30] * d, 0), (21, [3e30] * d, 0)]


@pytest.mark.parametrize("sample", [20000, 30])
def test_against_brute_force(spark, sample):
    rows = data()
    d = spark.createDataFrame([(*r, "x") for r in rows], SHAPE).repartition(3)
    got, want = sorted(map(tuple, itq.near_vectors(d, sample=sample).collect()), key=str), brute(rows)
    by = lambda rows: sorted((str(r[0]), r[1]) for r in rows)
    assert [r[0] for r in by(got)] == [r[0] for r in by(want)]
    assert sum(r[1] for r in got) <= sum(r[1] for r in want) and all(g[1] <= w[1] for g, w in zip(by(got), by(want), strict=True))  # nothing below the threshold
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 500 and found >= 0.97 * there


def test_recall_on_the_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding, r.label) for r in d.collect()])
    assert sorted(map(tuple, itq.near_vectors(d).collect()), key=str) == want


def crowd(n, noise, d=48, seed=3):
    """Near copies of a few vectors, many of one of them, some just inside and some just outside the threshold."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    pick = np.where(rng.random(n) < 0.6, 0, rng.integers(6, size=n))
    x = base[pick] + rng.normal(size=(n, d)) * rng.choice(noise, n)[:, None] / math.sqrt(d)
    return [(i, v.tolist(), 0) for i, v in enumerate(x)]


@pytest.mark.parametrize(("noise", "floor"), [([0.05, 0.1], 1.0), ([0.1, 0.2, 0.27], 0.97)])
def test_crowds_of_near_copies(spark, noise, floor):
    rows = crowd(400, noise)
    got, want = itq.near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SHAPE)).collect(), brute(rows)
    have, there = {r.vec_id: r.n_links for r in got}, {r[0]: r[1] for r in want}
    assert all(have[v] <= n for v, n in there.items()) and sum(have.values()) >= floor * sum(there.values())
    if floor == 1.0:
        assert sorted(map(tuple, got), key=str) == want


def test_a_link_at_the_threshold(spark):
    """A cosine of exactly the threshold links, the next smaller one does not."""
    rows = [(1, [3.0, 4.0] + [0.0] * 14, 0), (2, [1.0, 0.0] + [0.0] * 14, 0), (3, [0.0, 0.0, 1.0] + [0.0] * 13, 0)]
    d = spark.createDataFrame([(*r, "x") for r in rows], SHAPE)
    exact = float(np.array([3.0, 4.0]) @ np.array([1.0, 0.0]) / 5)
    at = {r.vec_id: r.n_links for r in itq.near_vectors(d, exact).collect()}
    above = {r.vec_id: r.n_links for r in itq.near_vectors(d, np.nextafter(exact, 1)).collect()}
    assert above == {1: 0, 2: 0, 3: 0} and at[3] == 0 and at[1] == at[2]


def test_parts_widen_with_the_table():
    assert [itq.width(n) for n in (1, 100, 5000, 1_000_000)] == [8, 10, 16, 23]


def test_rotation_balances_and_loses_less_than_none():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 32)) * np.geomspace(1, 0.1, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, axes = itq.fit(x, 64)
    loss = lambda y: np.square(np.sign(y) * np.abs(y).mean() - y).sum()
    plain = itq.fit(x, 64, rounds=0)
    assert loss((x - mean) @ axes[:, :32]) < loss((x - plain[0]) @ plain[1][:, :32])
    bits = ((x - mean) @ axes[:, :32] >= 0).mean(axis=0)
    assert np.abs(bits - 0.5).max() < 0.15


def test_empty(spark):
    d = spark.createDataFrame([], SHAPE)
    assert itq.near_vectors(d).count() == 0
