import functools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shadowset.llm import bestfit, tokens
from shadowset.llm.packing import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def used(plan, window):
    out = np.zeros(window + 1, int)
    for parts, times in plan:
        assert times > 0 and 0 < sum(parts) <= window
        for n in parts:
            out[n] += times
    return out


def exact(lengths, window):
    """The fewest sequences, by trying all."""

    @functools.lru_cache(None)
    def go(rest, bins):
        if not rest:
            return len(bins)
        best = 99
        for b in sorted(set(bins)):
            if b >= rest[0]:
                left = list(bins)
                left.remove(b)
                best = min(best, go(rest[1:], tuple(sorted((*left, b - rest[0])))))
        return min(best, go(rest[1:], tuple(sorted((*bins, window - rest[0])))))

    return go(tuple(sorted(lengths, reverse=True)), ())


def one_by_one(hist, window):
    """Best-fit decreasing, a piece at a time."""
    room = []
    for n in np.repeat(np.arange(window + 1), hist)[::-1]:
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(window - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(30))
def test_small_cases_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(10, 60, 9).tolist()
    hist = np.bincount(lengths, minlength=101)
    plan = bestfit.complete(hist, 100, nodes=5000, width=50)
    assert (used(plan, 100) == hist).all()
    assert sum(t for _, t in plan) == exact(lengths, 100) >= bestfit.least_sequences(hist, 100)


@pytest.mark.parametrize("seed", range(10))
def test_best_fit_is_that_of_single_pieces(seed):
    rng = np.random.default_rng(seed)
    hist = np.bincount(rng.integers(1, 64, rng.integers(1, 400)), minlength=65)
    plan = bestfit.best_fit(hist, 64)
    assert (used(plan, 64) == hist).all()
    assert sorted(64 - sum(p) for p, t in plan for _ in range(t)) == one_by_one(hist, 64)


def test_the_search_beats_best_fit_decreasing():
    many = lambda plan: sum(t for _, t in plan)
    better = 0
    for seed in range(300):
        hist = np.bincount(np.random.default_rng(seed).integers(15, 60, 11), minlength=101)
        if many(bestfit.best_fit(hist, 100)) > (least := bestfit.least_sequences(hist, 100)):
            found = many(bestfit.complete(hist, 100, nodes=5000, width=50))
            if least == found:
                better += 1
                bulk = bestfit.complete(hist * 10**6, 100, nodes=5000, width=50)
                assert (used(bulk, 100) == hist * 10**6).all() and many(bulk) <= many(bestfit.best_fit(hist * 10**6, 100))
    assert better >= 3


def test_domination():
    assert bestfit.fits_in((3, 2), (5,)) and bestfit.fits_in((4, 2, 2), (4, 4)) and not bestfit.fits_in((5,), (4, 4))
    left = np.zeros(101, int)
    left[[10, 20, 30, 35, 60]] = (1, 1, 2, 1, 1)
    found = bestfit.fillings(left, 65)
    assert found[0] in ((35, 30), (35, 20, 10)) and all(sum(f) <= 65 for f in found)
    assert not any(bestfit.fits_in(a, b) for a in found for b in found if a != b)


TEXTS = ["Plain words, and more of them.", "a  b\tc\nd \u00a0 e\u2028f \x1c g", "<|endoftext|> special <|startoftext|>", "it's 12:30 o'clock -- don't", "\u00c9te\u0301 \u0301x \u03a3\u03a3 \u0130I \U0001f600\u200d", "mark \x01 in\x01side \x01", "", " ", "\n\n", "x" * 5000, "#" * 40 + " ab!!cd??", "CamelCase ABC def" * 3]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    for enc in (tokens.encoder_of(PATH), tokens.encoder_of(PATH)):
        for _ in range(2):  # unknown, then known stretches
            got = enc.ids_many([*TEXTS, None])
            assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in [*TEXTS, ""]]


def check(rows, got, window):
    """Every piece in one place, every sequence gapless, the ids those of the tokenizer."""
    enc, place, parts = tokens.encoder_of(PATH), defaultdict(list), defaultdict(list)
    for r in got:
        place[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in place.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= window
    want = defaultdict(list)
    for i, text in rows:
        data = enc.ids(text or "") + bytes(4)
        for k, start in enumerate(range(0, len(data) // 4, window)):
            part = data[4 * start : 4 * (start + window)]
            want[i].append((k, start, len(part) // 4, zlib.crc32(part)))
    assert {i: sorted(p) for i, p in parts.items()} == {i: sorted(p) for i, p in want.items()}
    return len(place)


def test_packing(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["word"] * int(n))) for i, n in enumerate(rng.integers(0, 200, 300))] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(5, "a repeated id"), (5, "a repeated id"), (None, "no id"), (None, None), (2000, None), (3000, "very long text " * 40000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, rank int").repartition(5)
    got = bestfit.pack(docs, 64).collect()
    total = sum(r.length for r in got)
    assert -(-total // 64) <= check(rows, got, 64) <= total / 64 * 1.01 + 1


def test_empty_and_single(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bestfit.pack(docs).count() == 0
    one = bestfit.pack(spark.createDataFrame([(1, "")], "doc_id long, text string"), with_ids=True).collect()
    assert [(r.length, r.offset, bytes(r.ids)) for r in one] == [(1, 0, bytes(4))]


def test_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = bestfit.pack(docs).collect()
    n = check([tuple(r) for r in docs.collect()], got, 2048)
    hist = np.bincount([r.length for r in got], minlength=2049)
    assert n - bestfit.least_sequences(hist, 2048) <= 1
