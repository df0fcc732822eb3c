"""WARC archives with a two-level capture index.

Records are written in the order of their reversed-host URL keys, one gzip member each.  The index holds a line per
capture, sorted by key, in compressed blocks; a sparse directory holds the first key and place of each block.
A lookup searches the directory by bisection, reads one or more blocks, searches those by bisection, and range-reads
the records.  Files go through Arrow file systems to the shared folder, and tasks list them in a Spark table, so a
file of a lost or repeated task is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, shared_dir

#: Index lines per block; bytes at which a task starts another archive file.
LINES, FILE_BYTES = 1000, 512 << 20
#: Archived bytes that a task reads back.
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, a closing bracket, then path and query; lower-cased, scheme, www and fragment dropped."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return quote(url.lower(), safe="/?=&,):%")
    host = host.removeprefix("www.")
    path = parts.path or "/"
    path = path if path == "/" else path.rstrip("/")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + path + ("?" + "&".join(sorted(parts.query.split("&"))) if parts.query else "")
    return quote(key.lower(), safe="/?=&,):%;@!$'(*+~")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record; lengths must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not agree with its block")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class Files:
    """Range reads from few open files."""

    def __init__(self) -> None:
        self.open: dict[str, object] = {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            while len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            fs, p = _open(path)
            self.open[path] = fs.open_input_file(p)
        f = self.open[path]
        f.seek(offset)
        return f.read(length)


def _id(urn: str) -> int | None:
    got = urn[len("<urn:page:"):-1]
    return None if got == "None" else int(got)


def write(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write all pages (page_id, url, html) as archives; returns (captures, folder).

    captures: key, page_id, file, offset, length.  Null html is an empty payload, a null url an empty one.  Among equal
    payloads the largest page_id (null least; of repeated rows, any one) is the response, the others revisit it.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    key = F.pandas_udf(lambda urls: urls.map(url_key), "string")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", key(F.col("url")).alias("key"), payload.alias("payload"))
    packed = F.pandas_udf(lambda payloads: payloads.map(zlib.compress), "binary")  # payloads are shuffled twice below
    p = p.withColumns({"sha1": F.sha1("payload"), "bytes": F.length("payload").cast("long")}).withColumn("payload", packed(F.col("payload")))
    best = p.groupBy("sha1", "bytes").agg(F.max("page_id").alias("winner"), F.max_by("key", F.struct("page_id", "key")).alias("winner_key"))
    p = p.join(best, ["sha1", "bytes"])
    # rows of the winning id and key write the response in turn; a task sees such equal rows together below, and the first writes it
    p = p.withColumn("first", F.col("page_id").eqNullSafe(F.col("winner")) & (F.col("key") == F.col("winner_key")))
    p = p.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "sha1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, path, at, last = None, "", 0, None
        for pdf in batches:
            rows = []
            for page_id, url, k, payload, sha1, n, winner, first in zip(*(pdf[c].tolist() for c in ("page_id", "url", "key", "payload", "sha1", "bytes", "winner", "first"))):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    path, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{path}", compression=None)
                pid, winner = (None if x == "" else int(x) for x in (page_id, winner))
                this = (k, pid, sha1)
                revisit = not first or this == last
                payload = b"" if revisit else zlib.decompress(payload)
                last = this
                data = gzip.compress(record(pid, url, payload, base32(sha1), n, winner, revisit), 6, mtime=0)
                out.write(data)
                rows.append((k, page_id, f"{folder}/{path}", at, len(data)))
                at += len(data)
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    text_id = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)  # noqa: E731  keeps long ids exact beside nulls
    rows = p.select(text_id("page_id"), "url", "key", "payload", "sha1", "bytes", text_id("winner"), "first")
    captures = rows.mapInPandas(run, "key string, page_id string, file string, offset long, length long")
    return materialise(captures, "captures"), folder


def index(captures: DataFrame, folder: str, lines: int = LINES) -> str:
    """Write the two-level index of `captures`; returns the path of its directory table.

    Each task writes one index file of compressed blocks for a range of keys; the directory has a row per block:
    first and last line's key, file, offset, length, lines, and the bytes of the records they name.
    """
    where = f"{folder}/index"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _open(where)
        fs.create_dir(root, recursive=True)
        out, name, at, held = None, "", 0, []

        def block(some: list[tuple]) -> tuple:
            nonlocal out, name, at
            if out is None:
                name = f"{where}/part-{uuid.uuid4().hex}.idx"
                out = fs.open_output_stream(_open(name)[1], compression=None)
            data = zlib.compress("\n".join(json.dumps(x) for x in some).encode())
            out.write(data)
            row = (some[0][0], some[-1][0], name, at, len(data), len(some), sum(x[4] for x in some))
            at += len(data)
            return row

        names = ["first", "last", "file", "offset", "length", "lines", "archived"]
        for pdf in batches:
            held += zip(*(pdf[c].tolist() for c in ("key", "page_id", "file", "offset", "length")))
            rows = []
            while len(held) >= lines:
                rows.append(block(held[:lines]))
                held = held[lines:]
            yield pd.DataFrame(rows, columns=names)
        if held:
            yield pd.DataFrame([block(held)], columns=names)
        if out is not None:
            out.close()

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    made = ordered.mapInPandas(run, "first string, last string, file string, offset long, length long, lines long, archived long")
    path = f"{folder}/directory"
    made.write.parquet(path)
    return path


class Reader:
    """Lookups by URL key through the directory (sorted tuples first, last, file, offset, length)."""

    def __init__(self, directory: list[tuple], files: Files | None = None) -> None:
        self.directory = sorted(directory)
        self.firsts = [d[0] for d in self.directory]
        self.files, self.block_at, self.block = files or Files(), None, ([], [])

    def _lines(self, i: int) -> tuple[list, list]:
        if self.block_at != i:
            _, _, file, offset, length = self.directory[i]
            rows = [json.loads(x) for x in zlib.decompress(self.files.read(file, offset, length)).decode().split("\n")]
            self.block_at, self.block = i, ([r[0] for r in rows], rows)
        return self.block

    def captures(self, key: str) -> Iterator[list]:
        """Index lines [key, page_id, file, offset, length] of a key; a key may fill several blocks."""
        i = max(0, bisect_left(self.firsts, key) - 1)  # the block before may end with the key
        while i < len(self.directory) and self.firsts[i] <= key:
            if self.directory[i][1] >= key:
                keys, rows = self._lines(i)
                yield from rows[bisect_left(keys, key):bisect_right(keys, key)]
            i += 1

    def records(self, key: str, page_id: str | None = None) -> Iterator[tuple[dict, dict, bytes]]:
        for k, p, file, offset, length in self.captures(key):
            if page_id is None or p == page_id:
                yield parse(gzip.decompress(self.files.read(file, offset, length)))


def lookup(spark: SparkSession, directory: str, url: str) -> list[tuple[dict, dict, bytes]]:
    """All records of a URL, from the driver; only directory rows whose range holds the key are read."""
    key = url_key(url)
    rows = spark.read.parquet(directory).where((F.col("first") <= key) & (F.col("last") >= key)).select("first", "last", "file", "offset", "length").collect()
    return list(Reader([tuple(r) for r in rows]).records(key))


def _ranges(spark: SparkSession, directory: str) -> list[tuple[str, str, str]]:
    """(file, first key, last key) of the directory's files; one is written per index task."""
    rows = spark.read.parquet(directory).groupBy(F.input_file_name().alias("f")).agg(F.min("first").alias("lo"), F.max("last").alias("hi")).collect()
    return sorted((r["f"], r["lo"], r["hi"]) for r in rows)


def read_back(pages: DataFrame, directory: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, found by its page's URL key and id.

    Requests are dealt and sorted by key, so a batch needs a run of directory rows alone: it reads those whose key ranges
    meet its own (row-group statistics prune the rest), and no task holds the whole directory.
    """
    spark = pages.sparkSession
    key = F.pandas_udf(lambda urls: urls.map(url_key), "string")
    wanted = pages.select(key(F.col("url")).alias("key"), F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("")).alias("page_id")).distinct()
    files = _ranges(spark, directory)
    amount = spark.read.parquet(directory).agg(F.sum("archived")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(amount / TASK_BYTES))  # AQE would go by the size of the keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        columns, opened = ["first", "last", "file", "offset", "length"], Files()
        for pdf in batches:
            rows = []
            for f in [f for f, lo, hi in files if hi >= pdf["key"].iloc[0] and lo <= pdf["key"].iloc[-1]] if len(pdf) else []:
                fs, p = _open(f)
                meets = [("last", ">=", pdf["key"].iloc[0]), ("first", "<=", pdf["key"].iloc[-1])]
                rows += pq.read_table(p, filesystem=fs, columns=columns, filters=meets).to_pandas().itertuples(index=False, name=None)
            reader = Reader(rows, opened)
            out = []
            for key, page_id in zip(pdf["key"].tolist(), pdf["page_id"].tolist()):
                for fields, http, payload in reader.records(key, page_id):
                    revisit = fields["WARC-Type"] == "revisit"
                    n, digest = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"the payload of page {page_id} does not match its digest")
                    to = _id(fields["WARC-Refers-To"]) if revisit else None
                    out.append((page_id, n, digest, fields["WARC-Type"], "" if to is None else str(to)))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ordered = wanted.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    got = ordered.mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long")).alias(c)
    return got.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def warc_digest(pages: DataFrame) -> DataFrame:
    """Contract columns, read back from the archives: one row per page row."""
    p = pages.select("page_id", "url", "html")
    captures, folder = write(p)
    return read_back(p, index(captures, folder))
