import random

import numpy as np
import pytest

from shadowset.llm import minhash
from shadowset.llm.components import components


def split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def sets(text, n):
    w = split(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, n, percent=80):
    s = [sets(t, n) for _, t in docs]
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j]:
                both = len(s[i] & s[j])
                if 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                    up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min((x for x in (d, least.get(top(i))) if x is not None), default=None)
    return sorted(((d, len(s[i]), least[top(i)], least[top(i)] == d) for i, (d, _) in enumerate(docs)), key=str)


def corpus(n, seed, group=30):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for g in range(n):
        base = rnd.choices(vocabulary, k=rnd.choice((3, 8, 40, 120)))
        for _ in range(rnd.choice((1, 1, 2, group))):
            w = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 6))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            docs.append(" ".join(w).replace("w1", "W1"))
    rnd.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("small", [24, 3])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SHINGLES", 300 if small == 3 else 1 << 20)
    monkeypatch.setattr(minhash, "SPREAD", 2 if small == 3 else 128)
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "FEW", 2 if small == 3 else 256)
    monkeypatch.setattr(minhash, "MANY", 5 if small == 3 else 1024)
    docs = corpus(40, small)
    docs += [(None, docs[5][1]), (None, "no id at all here"), (None, "no id at all here"), (docs[7][0], docs[9][1]), (docs[7][0], docs[7][1] + " w3"), (1, None), (4, ""), (7, "  \n"), (10, "one two"), (13, "ONE two"), (16, "x " * 30000)]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, n_shingles int").repartition(3)
    got = sorted(map(tuple, minhash.near_duplicates(d, 4).collect()), key=str)
    assert got == brute(docs, 4)


def test_repeated_ids(spark):
    docs = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (3, "g h i j k l"), (9, "a b c d e f"), (None, "a b c d e f")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(d, 4).collect()), key=str)
    assert got == [(3, 3, 3, True), (5, 3, 3, False), (5, 3, 5, True), (5, 3, 5, True), (9, 3, 5, False), (None, 3, 5, False)]


def test_a_near_copy_of_one_of_an_ids_texts(spark):
    a = " ".join(f"a{i}" for i in range(40))
    docs = [(5, a), (5, "g h i j k l"), (3, "g h i j k l"), (9, a.replace("a0 ", "z "))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(d, 4).collect())) == sorted(brute(docs, 4))


def test_stage_with_repeated_and_null_ids(spark):
    docs = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (3, "g h i j k l"), (9, "a b c d e f"), (None, "a b c d e f"), (None, "m n o p q r"), (None, "m n o p q r"), (4, None), (None, "")]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id long, text string, _row int").repartition(3)
    out = minhash.deduplicated(d, 4)
    assert out.dtypes == d.dtypes
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(5, docs[0][1]), (3, docs[2][1]), (None, docs[6][1]), (4, None), (None, "")], key=str)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(d).count() == 0 and minhash.deduplicated(d).count() == 0


def test_stage(spark):
    docs = corpus(15, 3)
    d = spark.createDataFrame([*docs, (None, "null id")], "doc_id long, text string")
    kept = sorted(r.doc_id for r in minhash.deduplicated(d).collect() if r.doc_id is not None)
    assert kept == sorted(r[0] for r in brute(docs, 5) if r[3])


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)))
    m = minhash.Minima(240)
    assert abs((m(a) == m(b)).mean() - 0.8) < 0.1


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(100, 180)] + [(1000, i) for i in range(1001, 1200)] + [(rnd.randrange(50), rnd.randrange(50)) for _ in range(30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"))[0].collect()))
    up = {x: x for ab in links for x in ab}
    for _ in range(200):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: up[x] for x in up if any(x in ab and ab[0] != ab[1] for ab in links)}
