import hashlib
import random
import re

from shadowset.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w = split(text)
        hit, who = set(), set()
        for item, t in items:
            q = split(t)
            if not q:
                continue
            for i in range(max(1, len(q) - window + 1)):
                p = q[i : i + window]
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit |= set(range(k, k + len(p)))
                        who |= {str(item)} - {"None"}
        sha = hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(who), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def data():
    rnd = random.Random(5)
    some = ["alpha", "beta", "gamma", "delta", "eta", "é1", "Zeta", "x9"]
    items = [(i, " ".join(rnd.choices(some, k=rnd.choice((3, 12, 13, 20, 30))))) for i in range(12)]
    items += [(50, items[3][1]), (51, None), (52, "...!"), (None, items[2][1]), (53, "beta"), (7, items[1][1].upper())]
    docs = [(i, ", ".join(rnd.choices(some + ["other", "words"], k=rnd.randint(1, 200)))) for i in range(60)]
    docs += [(100 + i, "Intro text. " + items[i % 12][1].replace(" ", "\n") + " end " * rnd.randint(0, 300)) for i in range(20)]
    docs += [(200, None), (201, ""), (202, "!!"), (None, items[0][1]), (5, docs[5][1]), (300, "word " * 30000 + items[4][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int").repartition(3)
    return d, spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")


def test_against_brute_force(spark):
    docs, items = data()
    got = decontam.contamination(*frames(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items = data()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    got = decontam.contamination(*frames(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_only_whole_windows(spark):
    docs, items = data()
    items = [(i, t) for i, t in items if t and len(split(t)) >= 13]
    got = decontam.contamination(*frames(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = data()
    d, b = frames(spark, docs, items)
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert decontam.contamination(d, b.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def test_stage_keeps_clean_documents(spark):
    docs, items = data()
    d, b = frames(spark, docs, items)
    bad = {r[0] for r in brute(docs, items) if r[-1]}
    out = decontam.decontaminated(d, b)
    assert out.columns == d.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((i for i, _ in docs if i is None or i not in bad), key=str)


def test_stage_judges_each_row(spark):
    bad = " ".join(f"q{i}" for i in range(20))
    docs = [(5, "a b c d e f"), (5, "a b c d e f"), (5, bad), (3, bad), (9, "a b c"), (None, bad), (None, "a b c")]
    d, b = frames(spark, docs, [(1, bad)])
    clean = sorted([docs[0], docs[1], docs[4], docs[6]], key=str)
    rows = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert rows(decontam.decontaminated(d, b, null_ids=True)) == clean
    assert rows(decontam.decontaminated(d, b)) == sorted([*clean, docs[5]], key=str)


def test_proximity(spark):
    docs = [(1, "a b c d e"), (2, "a x x x x x c"), (3, "c a"), (4, "a"), (5, "c x a c")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index, _ = decontam.build_index(d, gap=10)
    got = {(r.query, r.doc_id): (r.start, r.end) for r in decontam.find_near(index, [("q", "a c"), ("none", "zz a")], 4).collect()}
    assert got == {("q", 1): (0, 3), ("q", 3): (0, 2), ("q", 5): (2, 4)}


def test_one_index_serves_all_blocks(spark, monkeypatch):
    docs, items = data()
    built = []
    plain = decontam.build_index
    monkeypatch.setattr(decontam, "build_index", lambda *x: built.append(1) or plain(*x))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    monkeypatch.setattr(decontam, "POINTS", 50)
    got = decontam.contamination(*frames(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items) and len(built) == 1


def test_items_without_an_id_count_as_hits(spark):
    text = " ".join(f"q{i}" for i in range(20))
    d, b = frames(spark, [(1, text), (2, "a b")], [(None, text)])
    got = {r.doc_id: r for r in decontam.contamination(d, b).collect()}
    assert got[1].n_hit == 20 and got[1].contaminated and got[1].n_items == 0 and not got[2].contaminated
