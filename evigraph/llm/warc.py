"""WARC archives with a two-level capture index.

Writing: one record per page, each a gzip member, one archive per task. Of pages with equal payloads of at least
`least_bytes` bytes, those with the largest page id are responses, the others revisits that name it; smaller payloads are
all responses.

Index: capture lines are sorted by reversed-host URL key (then page id) over all tasks, compressed in blocks of
`block_lines` lines, and each index file has a sparse directory with the first key of each block. The driver holds one
line per index file: its first key and its place. A lookup bisects the files, then the directories, which tells the blocks that
a key may stand in; these are dealt to tasks, which range-read and unpack each block once, bisect its lines and range-read the
records. A key of very many captures has many blocks, so many tasks share it. Sizes and digests come from the bytes read. A
revisit names its response's URL too, and its payload is read through the index.

Files go to the shared folder through pyarrow's file systems, so any store that those know will do. A task writes under a
name of its own attempt and the table of captures is committed by Spark, so lost executors and repeated tasks leave at
most files that nothing refers to.

Rows: a null html is an empty payload; a null URL is an empty one; a page of a null id is written, and a revisit where its payload
stands under an id too; repeated rows give a record each (rows with the same largest id are responses alike); of responses that
share id and URL a revisit reads any, since their payloads are equal; payloads are kept whole, whatever their size; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import arrow_stage, new_folder, written

#: Bytes of payloads that a task holds for the revisits to come; emptied when exceeded.
KEPT_BYTES = 16 << 20
CAPTURES = "key string, page_id long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.Example.com:80/a?b=2&a=1 -> com,example)/a?a=1&b=2. Keys sort hosts with their subdomains."""
    text = (url or "").strip().split("#", 1)[0]
    m = re.match(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?]*)(.*)$", text, re.S)
    if not m:
        return text.lower()
    host, rest = m[1].rpartition("@")[2].lower(), m[2]
    host = re.sub(r":(?:80|443)?$", "", host)
    host = re.sub(r"^www\d*\.", "", host)
    name, _, port = host.partition(":")
    path, _, query = rest.partition("?")
    query = "&".join(sorted(query.split("&"))) if query else ""
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (path.lower() or "/") + (f"?{query.lower()}" if query else "")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@lru_cache(maxsize=64)
def _opened(uri: str):
    system, path = _store(uri)
    return system.open_input_file(path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    return _opened(uri).read_at(length, offset)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_to_url: str | None = None) -> bytes:
    """A WARC 1.1 record. A revisit has no payload, but the id and URL of the response that has it."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {json.dumps(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    body = payload
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Refers-To-Target-URI: {json.dumps(refers_to_url or '')}"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields and the payload of an unpacked record; ValueError if it isn't whole."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    got = dict(x.split(": ", 1) for x in lines[1:])
    size = int(got["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    return {"page_id": page(got["WARC-Record-ID"]), "url": json.loads(got["WARC-Target-URI"]), "type": got["WARC-Type"], "digest": got["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": page(got.get("WARC-Refers-To")), "refers_to_url": json.loads(got.get("WARC-Refers-To-Target-URI", "null")), "payload": rest[:size]}


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """Writes the archives; returns their captures as a table."""
    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    last = one.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("last.page_id").alias("last"), F.col("last.url").alias("last_url"))
    told = one.join(last, "digest", "left").withColumn("refers_to", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))

    def rows(batches):
        system, root = _store(folder)
        uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        system.create_dir(root, recursive=True)
        at = 0
        with system.open_output_stream(_store(uri)[1], compression=None) as out:
            for b in batches:
                for page, url, payload, digest, refers_to, last_url in zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"], b["last_url"], strict=True):
                    data = gzip.compress(record(page, url, bytes(payload), digest, "response" if refers_to is None else "revisit", refers_to, last_url), 3, mtime=0)
                    out.write(data)
                    yield url_key(url), page, uri, at, len(data)
                    at += len(data)

    return written(arrow_stage(told.select("page_id", "url", "payload", "digest", "refers_to", "last_url"), CAPTURES, rows), "captures")


class CaptureIndex:
    """files: (first key, index file, directory file, captures, bytes of their records) in key order."""

    def __init__(self, files: list[tuple[str, str, str, int, int]]):
        self.files = files
        self.firsts = [f[0] for f in files]
        self._directory: dict[int, list] = {}
        self._block: dict[tuple[int, int], list] = {}
        self._payload: dict[tuple[str, int], bytes] = {}
        self._held = 0

    def directory(self, n: int) -> list:
        """[first key, offset, length] of the blocks of an index file."""
        if n not in self._directory:
            if len(self._directory) >= 8:
                self._directory.clear()
            system, path = _store(self.files[n][2])
            with system.open_input_file(path) as f:
                self._directory[n] = [json.loads(x) for x in f.read().decode().splitlines()]
        return self._directory[n]

    def block(self, n: int, k: int) -> list:
        """[key, page id, archive, offset, length] of the captures of one block."""
        if (n, k) not in self._block:
            if len(self._block) >= 8:
                self._block.clear()
            _, offset, length = self.directory(n)[k]
            self._block[n, k] = [json.loads(x) for x in zlib.decompress(read_range(self.files[n][1], offset, length)).decode().splitlines()]
        return self._block[n, k]

    def blocks(self, key: str):
        """(file, block) of the blocks that captures of a URL key may stand in, by binary search in the directories alone."""
        if not self.files:
            return
        n = max(0, bisect.bisect_left(self.firsts, key) - 1)
        k = max(0, bisect.bisect_left(self.directory(n), [key]) - 1)
        while n < len(self.files) and (k or self.firsts[n] <= key):
            firsts = self.directory(n)
            while k < len(firsts) and firsts[k][0] <= key:
                yield n, k
                k += 1
            if k < len(firsts):
                return
            n, k = n + 1, 0

    def lines(self, n: int, k: int, key: str) -> list:
        """The captures of a URL key in one block, by binary search; they are sorted by page id, null first."""
        lines = self.block(n, k)
        at = bisect.bisect_left(lines, key, key=lambda x: x[0])
        return lines[at : bisect.bisect_right(lines, key, lo=at, key=lambda x: x[0])]

    def find(self, key: str):
        """The captures of a URL key; they may run on over blocks and files."""
        for n, k in self.blocks(key):
            yield from self.lines(n, k, key)

    @staticmethod
    def fetch(line: list) -> dict:
        """The record of a capture, by a range read."""
        return parse_record(gzip.decompress(read_range(line[2], line[3], line[4])))

    def payload(self, got: dict) -> bytes:
        """The payload of a record; that of a revisit is read from the response which it names. ValueError if its digest is another."""
        if got["type"] == "response":
            payload = got["payload"]
        else:
            at = url_key(got["refers_to_url"]), got["refers_to"]
            if at not in self._payload:
                if self._held > KEPT_BYTES:
                    self._payload.clear()
                    self._held = 0
                found = self._payload[at] = next(r["payload"] for line in self._page(*at) if (r := self.fetch(line))["type"] == "response" and r["digest"] == got["digest"])
                self._held += len(found)
            payload = self._payload[at]
        if hashlib.sha1(payload).hexdigest() != got["digest"]:
            raise ValueError(f"the payload of page {got['page_id']} is not what was written")
        return payload

    def _page(self, key: str, page_id: int):
        """The captures of one page under a URL key, by binary search over the key's blocks and in them."""
        places = list(self.blocks(key))
        last = lambda place: lines[-1][1] if (lines := self.lines(*place, key)) and lines[-1][1] is not None else -(1 << 64)
        for place in places[bisect.bisect_left(places, page_id, key=last) :]:
            lines = self.lines(*place, key)
            known = lines[sum(x[1] is None for x in lines) :]
            for line in known[bisect.bisect_left(known, page_id, key=lambda x: x[1]) :]:
                if line[1] != page_id:
                    return
                yield line


def build_index(captures: DataFrame, folder: str, files: int | None = None, block_lines: int = 512) -> CaptureIndex:
    spark = captures.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")

    def rows(batches):
        system, root = _store(folder)
        system.create_dir(root, recursive=True)
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        first, lines, directory, at, total, size = None, [], [], 0, 0, 0
        with system.open_output_stream(_store(name + ".cdx.z")[1], compression=None) as out:

            def flush():
                nonlocal at, total
                data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
                out.write(data)
                directory.append(json.dumps([lines[0][0], at, len(data)]))
                at, total = at + len(data), total + len(lines)
                lines.clear()

            for b in batches:
                for line in zip(b["key"], b["page_id"], b["archive"], b["offset"], b["length"], strict=True):
                    first = line[0] if first is None else first
                    lines.append(line)
                    size += line[4]
                    if len(lines) >= block_lines:
                        flush()
            if lines:
                flush()
        if total:
            with system.open_output_stream(_store(name + ".idx")[1], compression=None) as out:
                out.write("\n".join(directory).encode())
            yield TaskContext.get().partitionId(), first, name + ".cdx.z", name + ".idx", total, size

    made = written(arrow_stage(ordered, "part int, first string, blocks string, directory string, n long, size long", rows), "index")
    return CaptureIndex([(r["first"], r["blocks"], r["directory"], r["n"], r["size"]) for r in made.orderBy("part").collect()])


def lookup(requests: DataFrame, index: CaptureIndex, key_col: str = "key", payloads: bool = True, task_bytes: int = 32 << 20) -> DataFrame:
    """The records of all captures of the requested URL keys, with their payloads if these are wanted.

    Tasks are as many as the records of the whole index hold task_bytes, at least spark.sql.shuffle.partitions.
    """
    files = index.files

    def places(batches):
        own = CaptureIndex(files)
        for b in batches:
            for key in b["k"]:
                for n, k in own.blocks(key):
                    yield n, k, key

    def rows(batches):
        own = CaptureIndex(files)
        for b in batches:
            for n, k, key in zip(b["n"], b["b"], b["key"], strict=True):
                for line in own.lines(n, k, key):
                    got = own.fetch(line)
                    payload = own.payload(got)
                    yield key, got["page_id"], got["url"], len(payload), hashlib.sha1(payload).hexdigest(), got["type"], got["refers_to"], payload if payloads else None

    tasks = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(f[4] for f in files) // task_bytes)
    wanted = requests.select(F.col(key_col).alias("k")).distinct().sortWithinPartitions("k")
    dealt = arrow_stage(wanted, "n int, b int, key string", places).repartition(tasks, "n", "b").sortWithinPartitions("n", "b", "key")
    return arrow_stage(dealt, "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary", rows)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, least_bytes: int = 1000) -> tuple[DataFrame, CaptureIndex]:
    """(captures, index) of the archives written for the pages."""
    folder = folder or new_folder(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives", least_bytes)
    return captures, build_index(captures, f"{folder}/index")


def query(spark, sf_dir: str) -> DataFrame:
    captures, index = archive(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))

    return lookup(captures, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as d from pages),
g as (select d, max(page_id) as last, count(*) as n from p where octet_length(b) >= 1000 group by d)
select p.page_id, octet_length(b)::bigint as payload_bytes, p.d as payload_digest,
       case when n > 1 and p.page_id is distinct from last then 'revisit' else 'response' end as record_type,
       case when n > 1 and p.page_id is distinct from last then last end as refers_to
from p left join g on p.d = g.d
"""
