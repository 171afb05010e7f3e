import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shadowset.llm import packing
from shadowset.llm.tokens import Encoder


def test_encoder_equals_tokenizer():
    path = packing.tokenizer_path()
    whole, own = Tokenizer.from_file(path), Encoder(path)
    assert own.ranks is not None
    rnd = random.Random(4)
    letters = [*"aB1 .,'\n\té-_", "  ", "<|endoftext|>", "don't", "ſ", "²", "\x1c", "\x85", "😀", "\0,", " the"]
    for _ in range(4000):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 25)))
        assert list(np.frombuffer(own.ids(text), np.uint32)) == whole.encode(text, add_special_tokens=False).ids, ascii(text)


def check(rows, docs, window, end=0):
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(str((d, whole.encode(t or "", add_special_tokens=False).ids + [end])) for d, t in docs)
    by_doc = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 0 < r.length <= window
        by_doc.setdefault(r.doc_id, []).append(r)
    got = []
    for d, mine in by_doc.items():
        mine.sort(key=lambda r: r.start)
        ids = [int(i) for r in mine for i in np.frombuffer(r.ids, np.uint32)]
        assert len(ids) == mine[0].doc_tokens
        got.append(str((d, ids)))
    assert sorted(got) == want
    full = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for mine in full.values():
        at = 0
        for o, n in sorted(mine):
            assert o == at
            at += n
        assert at <= window
    return sum(r.length for r in rows), len(full)


@pytest.mark.parametrize("window", [64, 1024])
def test_pieces_are_whole_and_gapless(spark, window):
    rnd = random.Random(window)
    docs = [(i, " ".join(rnd.choices(["alpha", "beta,", "Gamma.", "x9", "é"], k=rnd.choice((1, 5, 40, 300, 900))))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "word " * 6000), (None, "null id")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, length int").repartition(5)
    tokens, sequences = check(packing.pack(d, window, with_ids=True).collect(), docs, window)
    assert sequences <= 1.1 * tokens / window + 2


def test_repeated_rows_and_empty_table(spark):
    d = spark.createDataFrame([(1, "same"), (1, "same"), (2, "same")], "doc_id long, text string")
    rows = packing.pack(d).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert packing.pack(d.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(257, np.int64)
    for n in rng.integers(1, 257, 6000 if seed else 5) if seed < 3 else np.minimum(256, rng.geometric(0.02, 6000)):
        hist[n] += 1
    sequences = packing.plan(hist, 256)
    used = np.zeros_like(hist)
    for parts, times in sequences:
        assert sum(parts) <= 256 and times > 0
        for n in parts:
            used[n] += times
    assert (used == hist).all()
    if seed:
        tokens, n = int((hist * np.arange(257)).sum()), sum(t for _, t in sequences)
        assert n * 256 <= 1.03 * tokens


def test_least_squares_is_optimal():
    """The conditions of Karush, Kuhn and Tucker: no unused combination would help, every used one is balanced."""
    combos = packing.combinations(np.array([10, 20, 24, 30, 40, 44]), 64)
    hist = np.zeros(65)
    hist[[10, 20, 24, 40, 44]] = 5, 9, 2, 30, 9
    x = packing.solve(combos, hist)
    use = np.zeros((65, len(combos)))
    for j, c in enumerate(combos):
        for n in c[c > 0]:
            use[n, j] += 1
    gradient = use.T @ (hist - use @ x)
    assert (x >= 0).all() and (gradient <= 1e-4).all() and np.abs(gradient[x > 0]).max() < 1e-4
