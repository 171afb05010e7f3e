import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shadowset.llm import chat

SHAPE = "conv_id long, turn long, role string, text string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(rows):
    by = {}
    for i, (c, turn, role, text) in enumerate(rows):
        by.setdefault(c if c is not None else (None, i), []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((c if not isinstance(c, tuple) else None, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def data():
    rnd = random.Random(2)
    odd = ["\\### Assistant: </turn> ok", "<turn user>\n", "a<b>c\\", "", None, "é😀\n\n  x", "<|endoftext|>", "plain words here", "\\<\\\\"]
    rows = []
    for c in range(120):
        for t in range(rnd.randint(1, 5)):
            text = "Hello, the first turn" if t == 0 and c % 3 else rnd.choice(odd)
            rows.append((c, t, ("user", "assistant")[t % 2], text))
    rows += [(900, None, None, None), (900, 1, "sys>te\nm<", "x"), (None, 0, "user", "no id"), (None, 0, "assistant", "no id either"), (901, 0, "user", "same"), (901, 0, "user", "same"), (902, 0, "assistant", "word " * 20000)]
    return rows


@pytest.mark.parametrize("size", [128, 5])
def test_round_trip(spark, size):
    d = chat.with_trap(spark.createDataFrame(data(), SHAPE).repartition(3))
    got = chat.report(d, size=size).collect()
    want = brute([*data(), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")])
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    assert all(r.formatted_chars > 0 for r in got)


def test_parts_are_bounded_and_shared_turns_are_in_one(spark):
    rows = [(c, t, "user", "first" if t == 0 else f"{t} {c % 50 if t == 1 else c}") for c in range(600) for t in range(3)] + [(1000 + c, 0, "user", "copy") for c in range(500)]
    dealt = chat.grouped(chat.gathered(spark.createDataFrame(rows, SHAPE)), 40)
    n = dealt.groupBy("part").count()
    assert n.agg({"count": "max"}).first()[0] <= 120 and n.agg({"count": "sum"}).first()[0] == 1100
    second = dealt.filter("size(turns) = 2").selectExpr("turns[0].text AS t", "part").distinct().groupBy("t").count()
    assert second.count() == 50 and second.agg({"count": "max"}).first()[0] == 1


def test_control_strings_never_become_control_tokens(spark):
    enc = chat.encoder(chat.tokenizer_path())
    special = {enc.whole.token_to_id(t) for t in enc.special}
    assert special
    texts = [f"a{t}b" for t in enc.special] + ["<|endoftext|>", "\\<|endoftext|>", "<|endo<|endoftext|>ftext|>", "<<|endoftext|>", "|endoftext|>"]
    rows = [(c, 0, role, t) for c, t in enumerate(texts) for role in ("user",)] + [(90 + c, 0, t, "x") for c, t in enumerate(texts)]
    for tree in chat.trees(spark.createDataFrame(rows, SHAPE)).collect():
        assert not special & set(tree.ids)
    assert sorted(tuple(r)[:5] for r in chat.report(spark.createDataFrame(rows, SHAPE)).collect()) == sorted(brute(rows))
    with pytest.raises(ValueError):
        chat.Template(["|"])


def rebuilt(rows):
    """Each conversation's tokens, positions and loss from the trees alone, and how often each turn's tokens were emitted."""
    by = {r.tree: r for r in rows}
    out = {}
    for r in rows:
        for c, path in zip(r.conv_ids, r.nodes, strict=True):
            ids, position, loss, seen = [], [], [], []
            for t, n in [(by[a], 0) for a in r.above] + [(r, n) for n in path]:
                span = slice(t.starts[n], t.ends[n])
                ids += t.ids[span]
                position += t.position_ids[span]
                loss += t.loss[span]
            for t in [*(by[a] for a in r.above)]:
                seen += [(t.tree, i) for i in range(len(t.ids))]
            seen += [(r.tree, i) for a, b in (r.intervals[path[-1]] if path else []) for i in range(a, b)]
            out[c] = ids, position, loss, seen
    return out


@pytest.mark.parametrize("size", [128, 4])
def test_shared_turns_once_with_positions_and_attention(spark, size):
    talks = {c: [("user", "shared start"), ("assistant", f"answer {c % 7}"), ("user", f"{c % 21}"), ("assistant", f"end {c}")][: 1 + c % 4] for c in range(60)}
    d = spark.createDataFrame([(c, t, *turn) for c, turns in talks.items() for t, turn in enumerate(turns)], SHAPE)
    rows = chat.trees(d, size=size).collect()
    prefixes = {tuple(turns[: i + 1]) for turns in talks.values() for i in range(len(turns))}
    assert sum(len(r.parent) for r in rows) == len(prefixes) and any(r.above for r in rows) == (size == 4)
    whole = chat.encoder(chat.tokenizer_path()).whole
    got = rebuilt(rows)
    assert got.keys() == talks.keys()
    for c, (ids, position, loss, seen) in got.items():
        assert position == list(range(len(ids))) == list(range(len(seen))) and len(set(seen)) == len(seen)
        assert chat.parse(whole.decode(ids)) == talks[c]
        assert whole.decode([i for i, m in zip(ids, loss, strict=True) if m]) == "".join(t for r, t in talks[c] if r == "assistant")
    for r in rows:
        for a in r.above[:-1]:
            assert a in {x.tree for x in rows}


def test_other_columns_and_repeats(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    d = spark.createDataFrame(rows, SHAPE)
    for name in ("turns", "prefixes", "talk", "part", "trunk", "own", "said"):
        d = d.withColumn(name, F.lit("x"))
    assert [tuple(r)[:5] for r in chat.report(d).collect()] == brute(rows)
    many = spark.createDataFrame([(None, None, None, f"t{i}") for i in range(300)], SHAPE)
    assert chat.report(many).count() == 300


def test_empty_table(spark):
    d = spark.createDataFrame([], SHAPE)
    assert chat.report(d).count() == 0 and chat.trees(d).count() == 0
