import base64
import gzip
import hashlib
import random

import pytest

from shadowset.llm import warc


def rows():
    rnd = random.Random(1)
    bodies = ["<p>é body %d</p>" % i * rnd.randint(1, 50) for i in range(20)]
    hosts = ["example.com", "www.example.com", "a.example.org:8080", "hot.example.net"]
    out = [(i, f"http://{hosts[-1] if i % 3 else rnd.choice(hosts)}/p/{i % 40}?q={i % 7}", rnd.choice(bodies) if i % 2 else f"<i>{i}</i>") for i in range(400)]
    return out + [(1000, None, None), (1001, "", ""), (1002, "http://[bad/x", "bad"), (1003, "no url\nat all", "x"), (None, "u", "y"), (None, "v", "z"), (None, "v", "z"), (None, "w", "x"), (7, "http://again/", "unlike"), (1004, out[0][1], None)]


def brute(rows, least=0):
    rows = [(p, (h or "").encode()) for p, _, h in rows]
    best = {}
    for p, b in rows:
        best[b] = max((x for x in (p, best.get(b)) if x is not None), default=None)
    out = []
    for p, b in rows:
        response = best[b] == p or len(b) < least
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else best[b]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK", 16)
    monkeypatch.setattr(warc, "SMALL_RANGE", 50)
    monkeypatch.setattr(warc, "READ", 2000)
    pages = spark.createDataFrame([(*r, 1) for r in rows()], "page_id long, url string, html string, refers_to int").repartition(4)
    got = warc.archived_report(pages, least).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows(), least)


def test_lookup_reads_the_record(spark, tmp_path):
    some = [r for r in rows() if r[0] is not None]
    folder, ranges = warc.archive(spark.createDataFrame(some, "page_id long, url string, html string"), f"file://{tmp_path}")
    index = warc.Index(ranges, f"{folder}/archives")
    texts = {}
    for p, u, h in some:
        places = index.find(warc.sort_key(u, p))
        assert len(places) == 1
        fields, payload = next(index.read(places))
        if fields["WARC-Type"] == "response":
            assert payload.decode() == (h or "")
        texts[p, u] = fields
    assert index.find("zzz nothing") == [] and index.find("") == []
    for f in (tmp_path / "archives").glob("*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_keys_sort_by_host():
    a, b, c = (warc.sort_key(u, 1) for u in ("http://b.example.com/z", "http://example.com/a", "http://a.example.org/"))
    assert a.startswith("com,example,b)/z") and sorted((a, b, c))[2] == c


def test_equal_keys_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (1, "http://a/", "same"), (1, "http://a/", "other")], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archived_report(pages).collect()))
    assert [r[1] for r in got] == [4, 4, 5] and {r[3] for r in got} == {"response"}
    assert warc.archived_report(pages.limit(0)).count() == 0


def test_long_payloads_and_full_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 1000)
    rnd = random.Random(3)
    some = [(i, "http://h/", "".join(rnd.choices("abcdefgh<>é", k=3_000_000 if i == 5 else 2000))) for i in range(30)]
    pages = spark.createDataFrame([(*r, "x") for r in some], "page_id long, url string, html string, of string")
    assert sorted(map(tuple, warc.archived_report(pages).collect()), key=str) == brute(some)
