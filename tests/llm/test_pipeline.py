import random
import re
import zlib

from tokenizers import Tokenizer

import corpus_pipeline
from shadowset.llm import packing
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_minhash import brute as duplicates
from tests.llm.test_secrets import brute as secret_spans

WORDS = ["The", "house", "of", "réal", "words", "and", "more", "trees", "stand", "by", "water", "north", "small"]


def fixture():
    rnd = random.Random(6)
    plain = lambda n: " ".join(rnd.choices(WORDS, k=n))
    docs = [plain(rnd.randint(20, 120)) for _ in range(120)]
    docs += [" ".join(w.upper() + "!!" for w in plain(40).split()) for _ in range(40)]
    for i in range(0, 40, 4):
        w = docs[i].split()
        w[3] = "changed"
        docs += [docs[i], docs[i] + " end.", " ".join(w)]
    items = [(i, plain(20)) for i in range(5)]
    docs += [plain(30) + " " + t + " " + plain(20) for _, t in items]
    docs += [plain(30) + f' token = "{"%040x" % rnd.getrandbits(160)}" ' + plain(30) for _ in range(8)]
    docs = [(i, t, "en", "src", len(t)) for i, t in enumerate(docs)]
    return docs, items, [(d[0], 0 if "!!" in d[1] else 1, 0) for d in docs[:160]]


def test_against_plain_version(spark, tmp_path):
    docs, items, labels = fixture()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, schema in (("documents", docs, columns), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    left = [(d, t) for d, t, *_ in docs if "!!" not in t]
    kept = {d for d, _, _, k in duplicates(left, 5) if k}
    left = [(d, t) for d, t in left if d in kept]
    bad = {r[0] for r in contaminated(left, items) if r[-1]}
    left = [(d, t) for d, t in left if d not in bad]
    assert len(bad) == 5 and len(kept) < 160
    masked = {}
    for d, t in left:
        at, out = 0, ""
        for s, _, _, e in secret_spans(t):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        masked[d] = out + t[at:]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = {d: len(whole.encode(t, add_special_tokens=False).ids) + 1 for d, t in masked.items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, _row string, part string, ids string"


def written(spark, where, docs, items, labels):
    for name, rows, schema in (("documents", docs, ODD), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    return str(where)


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text, ties, and columns with the operators' names."""
    docs, items, labels = fixture()
    more = [(None, docs[0][1]), (None, None), (7, None), (8, ""), (8, ""), (9, "  \n"), (5, docs[5][1]), (5, docs[5][1]), (None, items[0][1]), (5000, " ".join(WORDS) + " word" * 200_000 + ' token="abcdefghij"')]
    odd = [(*d, "a", "b", "c", "d") for d in docs] + [(i, t, None, None, None if t is None else len(t), None, "b", None, "d") for i, t in more]
    where = written(spark, tmp_path, odd, [*items, (None, "null id but words of an item"), (99, None)], [*labels, (None, 1, 0), (3, None, None)])
    d = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, where)
        assert out.dtypes == d.dtypes
        key = lambda r: (r.doc_id, r.score, r._row, r.part, r.ids)
        assert {key(r) for r in out.collect()} <= {key(r) for r in d.collect()}
    kept = corpus_pipeline.drop_near_duplicates(spark, d, where)
    texts = [r.text for r in kept.collect()]
    assert texts.count(docs[0][1]) + texts.count(docs[0][1] + " end.") <= 1 and texts.count(None) == 2 and texts.count("") == 2 and texts.count(docs[5][1]) <= 1
    clean = [r.text for r in corpus_pipeline.drop_contaminated(spark, d, where).collect()]
    assert items[0][1] not in clean and None in clean and "" in clean
    assert any(t and t.endswith(' [SECRET]"') and len(t) > 1_000_000 for t in (r.text for r in corpus_pipeline.mask_secrets(spark, d, where).collect()))
    rows = corpus_pipeline.run(spark, where).collect()
    by = {}
    for r in rows:
        by.setdefault((r.sequence_id), []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_tables(spark, tmp_path):
    docs, items, labels = fixture()
    where = written(spark, tmp_path / "a", [], items, labels)
    assert corpus_pipeline.run(spark, where).count() == 0
    where = written(spark, tmp_path / "b", [(*d, "a", "b", "c", "d") for d in docs], [], [])
    assert 0 < len({r.doc_id for r in corpus_pipeline.run(spark, where).collect()}) <= len(docs)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items, labels = fixture()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, schema in (("documents", docs, columns), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.dtypes == d.dtypes
        assert not out.filter("n_chars != length(text)").count()
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])


def test_result_has_the_token_ids(spark, tmp_path):
    docs, items, labels = fixture()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, schema in (("documents", docs, columns), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
