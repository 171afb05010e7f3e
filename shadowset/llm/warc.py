"""WARC archives with a two-level capture index.

*Writing.* Each task writes its pages as gzip members, one record each, to archive files in the shared folder. Of records
with equal payloads that with the largest page_id is the response and the others are revisits of it; equal payloads are
found by SHA-1 of the UTF-8 bytes before any record is written, and only pages that share theirs get a row in that join.

*Index.* A capture's key is its URL with the host's labels reversed, then the page id. Captures are sorted by key over all
tasks (ranges of the key, so one host can span many; as many ranges as the captures ask for), and each task writes its range
as blocks of BLOCK entries, each block compressed on its own and written as it is full, plus a sparse directory: first key,
offset and length of every block. Above that stands the list of the ranges, one entry per task.

*Reading.* A lookup binary-searches the range list, the range's directory and the unpacked block, then reads the record's
byte range from its archive. Lookups in bulk are sorted by key, so a task walks few blocks; the places found are then sorted
by archive and offset over all tasks, and near ones are read together.

Defined results: null html is an empty payload; null urls are archived under an empty URL; rows with a null page_id are
archived without one, revisit the largest id with their payload, and are responses where no row of that payload has an id;
rows that repeat a page_id are separate captures, and all of those with the winning id and payload are responses; extra
columns are ignored; an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shadowset.llm.common import arrow_map, bound_batches, dropped, scratch, stored
from shadowset.llm.storage import opened, write_bytes, writing

BLOCK = 1000
#: Captures of an index range at most, and in a table of few captures.
RANGE, SMALL_RANGE = 500_000, 5_000
#: Bytes read at once, and between two records read together, at most.
READ, NEAR = 8 << 20, 64 << 10
#: Bytes after which a task begins its next archive file.
ARCHIVE = 64 << 20
#: Payloads shorter than this are never revisits.
LEAST = 0
DATE = "2024-01-01T00:00:00Z"


def sort_key(url: str | None, page_id: int | None) -> str:
    """The reversed host, then port, path and query, then the page id."""
    url, number = url or "", "" if page_id is None else f"{page_id + 2**63:020d}"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f")-{'%20'.join(url.split())} {number}"
    rest = parts.path + ("?" + parts.query if parts.query else "") + ("#" + parts.fragment if parts.fragment else "")
    name = ",".join(reversed(host.lower().split("."))) + (f":{port}" if port else "") + ")" + rest
    return f"{'%20'.join(name.split())} {number}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no payload; its headers tell the payload's digest and size and the response."""
    kind, digest = "response" if refers_to is None else "revisit", digest32(payload)
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = head.encode() + (payload if refers_to is None else b"")
    uri = "".join(c if " " < c else "%%%02X" % ord(c) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(body)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record and its payload, both checked against its digests."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n" or "sha1:" + digest32(body) != fields["WARC-Block-Digest"]:
        raise ValueError("a damaged record")
    payload = body.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha1:" + digest32(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError("a damaged payload")
    return fields, payload


def _with_digest(pages: DataFrame) -> DataFrame:
    """page_id, url, html, of (the payload's SHA-1), n (its bytes)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("of"), F.length(payload).alias("n"))


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, refers_to, of: the pages whose payload another page with a larger id has too; a null id is less than all others. ``of`` is the payload's SHA-1."""
    some = _with_digest(pages).filter(F.col("n") >= least).select("page_id", "of")
    best = some.groupBy("of").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k"), F.count("page_id").alias("named"))
    best = best.filter("refers_to > first or k > named and named > 0").select("of", "refers_to")
    return some.join(best, "of").filter("page_id is null or page_id < refers_to").select("page_id", "refers_to", "of").distinct()


ENTRIES = "key string, page_id long, archive string, offset long, size long"


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> tuple[DataFrame, str]:
    """Write the archives; returns the captures: key, page_id, archive, offset, size."""
    again = revisits(pages, least).alias("r")
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.of") == F.col("r.of"))
    ready = _with_digest(pages).alias("p").join(again, same, "left").select("p.page_id", "p.url", "p.html", "r.refers_to")

    def run(batches):
        task, serial, room, held, at = TaskContext.get(), 0, bytearray(), [], 0

        def flush():
            nonlocal serial, room, held
            if not held:
                return None
            name = f"part-{task.partitionId():06d}-{serial:04d}-{task.taskAttemptId()}.warc.gz"
            write_bytes(f"{folder}/{name}", bytes(room))
            out = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((k, p, name, o, n) for k, p, o, n in held), strict=True)], names=["key", "page_id", "archive", "offset", "size"])
            serial, room, held = serial + 1, bytearray(), []
            return out

        for batch in batches:
            for page_id, url, text, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = (text.as_py() or "").encode("utf-8", "surrogatepass")
                member = gzip.compress(record(page_id.as_py(), url.as_py(), payload, refers_to.as_py()), 6, mtime=0)
                held.append((sort_key(url.as_py(), page_id.as_py()), page_id.as_py(), len(room), len(member)))
                room += member
                if len(room) >= ARCHIVE:
                    yield flush()
        if (last := flush()) is not None:
            yield last

    bound_batches(pages.sparkSession)
    return stored(ready.mapInArrow(run, ENTRIES), "captures")


def _ranges_for(spark, n: int) -> int:
    """In how many ranges to sort n captures: by their number, and in a small table one for each core that has enough of them."""
    return max(-(-n // RANGE), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SMALL_RANGE)), 1)


def write_index(captures: DataFrame, folder: str) -> tuple[DataFrame, str]:
    """Sort the captures by key and write each range's blocks and directory. Returns the list of ranges: first, last, path, n."""
    spark = captures.sparkSession
    bound_batches(spark)
    ranged = captures.repartitionByRange(_ranges_for(spark, captures.count()), "key").sortWithinPartitions("key", "archive", "offset")

    def run(batches):
        task, directory, lines, first, last, total = TaskContext.get(), [], [], None, None, 0
        path = f"{folder}/range-{task.partitionId():06d}-{task.taskAttemptId()}"
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "archive", "offset", "size")), strict=True))
        begun = next(rows, None)
        if begun is None:
            return
        with writing(path + ".blocks") as out:

            def close():
                if lines:
                    data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
                    directory.append((lines[0].split("\t", 1)[0], out.tell(), len(data)))
                    out.write(data)
                    lines.clear()

            for row in itertools.chain([begun], rows):
                first, last, total = first if first is not None else row[0], row[0], total + 1
                lines.append("\t".join("" if x is None else str(x) for x in row))
                if len(lines) == BLOCK:
                    close()
            close()
        write_bytes(path + ".directory", json.dumps(directory).encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([path]), pa.array([total], pa.int64())], names=["first", "last", "path", "n"])

    return stored(ranged.mapInArrow(run, "first string, last string, path string, n long"), "ranges")


class Index:
    """Lookups in a two-level index. ranges: (first key, last key, path), sorted."""

    def __init__(self, ranges: list[tuple[str, str, str]], archives: str, blocks: int = 8):
        self.ranges, self.archives, self.most = ranges, archives, blocks
        self.first = [r[0] for r in ranges]
        self.directories: dict[str, tuple] = {}
        self.blocks: dict[tuple[str, int], tuple] = {}

    def _range(self, path: str, suffix: str, offset: int | None = None, size: int | None = None) -> bytes:
        where, name = opened(path + suffix)
        with where.open_input_file(name) as f:
            if offset is None:
                return f.read()
            return f.read_at(size, offset)

    def _directory(self, path: str) -> tuple:
        if path not in self.directories:
            if len(self.directories) >= 4:
                self.directories.clear()
            entries = json.loads(self._range(path, ".directory"))
            self.directories[path] = ([e[0] for e in entries], entries)
        return self.directories[path]

    def _block(self, path: str, i: int) -> tuple:
        if (path, i) not in self.blocks:
            if len(self.blocks) >= self.most:
                self.blocks.clear()
            _, offset, size = self._directory(path)[1][i]
            lines = [x.split("\t") for x in zlib.decompress(self._range(path, ".blocks", offset, size)).decode("utf-8", "surrogatepass").split("\n")]
            self.blocks[path, i] = ([x[0] for x in lines], lines)
        return self.blocks[path, i]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, offset, size) of all captures with the key; equal keys may go on in the next block or range."""
        out: list[tuple[str, int, int]] = []
        r = max(0, bisect.bisect_left(self.first, key) - 1)
        while r < len(self.ranges) and self.ranges[r][0] <= key:
            if self.ranges[r][1] >= key:
                path = self.ranges[r][2]
                firsts, entries = self._directory(path)
                b = max(0, bisect.bisect_left(firsts, key) - 1)
                while b < len(entries) and firsts[b] <= key:
                    keys, lines = self._block(path, b)
                    i = bisect.bisect_left(keys, key)
                    while i < len(keys) and keys[i] == key:
                        out.append((lines[i][2], int(lines[i][3]), int(lines[i][4])))
                        i += 1
                    b += 1
            r += 1
        return out

    def read(self, places: list[tuple[str, int, int]]):
        """(headers, payload) of each place, archive by archive."""
        return Archives(self.archives).read(places)


class Archives:
    """Records by archive, offset and size. Places in order are read together where they are near; the last archive stays open."""

    def __init__(self, folder: str):
        self.folder, self.name, self.handle = folder, None, None

    def _open(self, name: str):
        if name != self.name:
            if self.handle:
                self.handle.close()
            where, path = opened(f"{self.folder}/{name}")
            self.name, self.handle = name, where.open_input_file(path)
        return self.handle

    def read(self, places: list[tuple[str, int, int]]):
        at = 0
        while at < len(places):
            archive, start, size = places[at]
            stop, end = at + 1, start + size
            while stop < len(places) and places[stop][0] == archive and 0 <= places[stop][1] - end <= NEAR and places[stop][1] + places[stop][2] - start <= READ:
                end = places[stop][1] + places[stop][2]
                stop += 1
            data = self._open(archive).read_at(end - start, start)
            for _, offset, size in places[at:stop]:
                yield parse(gzip.decompress(data[offset - start : offset - start + size]))
            at = stop


def range_list(ranges: DataFrame) -> list[tuple[str, str, str]]:
    """The upper level: one entry per index task, however many captures there are."""
    return sorted((r["first"], r["last"], r["path"]) for r in ranges.select("first", "last", "path").collect())


def find_all(keys: DataFrame, ranges: list[tuple[str, str, str]], archives: str) -> DataFrame:
    """archive, offset, size of every capture of the distinct ``key``s, through the index."""

    def make():
        index = Index(ranges, archives)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            places = [p for k in batch.column("key").to_pylist() for p in index.find(k)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*places, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "offset", "size"]) if places else None

        return each

    spark = keys.sparkSession
    sorted_ = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
    return arrow_map(sorted_, make, "archive string, offset long, size long")


def read_back(keys: DataFrame, ranges: list[tuple[str, str, str]], archives: str) -> DataFrame:
    """keys: distinct ``key``. Each capture's record, found through the index and read from its archive."""

    def make():
        files = Archives(archives)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for fields, payload in files.read(list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "size")), strict=True))):
                revisit = fields["WARC-Type"] == "revisit"
                size = int(fields["X-Payload-Length"]) if revisit else len(payload)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest32(payload)
                rows.append((int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, size, digest, fields["WARC-Type"], int(fields["X-Refers-To-Page-Id"]) if revisit else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        return each

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = find_all(keys, ranges, archives).repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return arrow_map(places, make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def keys_of(pages: DataFrame) -> DataFrame:
    """The distinct index keys of the pages' own captures."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([sort_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True)])], names=["key"])

        return each

    return arrow_map(pages.select("url", F.col("page_id").cast("long").alias("page_id")), make, "key string").distinct()


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> tuple[str, list[tuple[str, str, str]]]:
    """Write archives and index of pages (page_id, url, html) below folder. Returns the folder and the list of index ranges."""
    folder = folder or scratch(pages.sparkSession, "warc")
    captures, captures_at = write_archives(pages, f"{folder}/archives", least)
    ranges, ranges_at = write_index(captures, f"{folder}/index")
    found = range_list(ranges)
    dropped(pages.sparkSession, captures_at, ranges_at)
    return folder, found


def archived_report(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Archive all pages, then read every record back through the index."""
    folder, ranges = archive(pages, None, least)
    return read_back(keys_of(pages), ranges, f"{folder}/archives")
