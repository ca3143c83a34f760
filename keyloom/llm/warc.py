"""Web archives and a two-level capture index over them.

Records are gzip members of their own in WARC files, so that one record is one range of bytes. The index has one line per
capture, sorted by a key that begins with the reversed host. Its first level are parts: files of compressed blocks of lines.
Each part's sparse directory has the first key, offset and length of every block. A lookup finds the part by its first and
last key, searches the directory by bisection, reads one block, searches its lines by bisection, and reads one record.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import few, keep, row_key, shared_folder, text_batches

# Fixed values of the archive format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
# A WARC file is closed beyond so many bytes; a block has so many lines; records are read together within so many bytes.
FILE_BYTES, BLOCK_LINES, READ_TOGETHER = 512 << 20, 300, 64 << 20
# Parts of an index at most; their first and last keys are what every lookup task holds.
MOST_PARTS = 20_000


def filesystem(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and path that a folder name of the cluster stands for."""
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return arrow_fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*://", uri) else (arrow_fs.LocalFileSystem(), uri)


def url_key(url: str | None) -> str:
    """Sort key of a URL: the host's labels from the last to the first, the port unless usual, then path and query, lower-cased.

    Scheme, user, a leading www label and the fragment do not matter. White space and control characters are escaped.
    Null and empty URLs have the key "-"; what cannot be parsed is kept as it is, lower-cased.
    """
    url = quote((url or "").strip().lower(), safe="".join(map(chr, range(33, 127))))
    if not url:
        return "-"
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not re.fullmatch(r"[\d.]+|.*:.*", host):  # an address stays as it is
        labels = host.split(".")
        if len(labels) > 2 and re.fullmatch(r"www\d*", labels[0]):
            labels = labels[1:]
        host = ",".join(labels[::-1])
    at = host + (f":{port}" if port and port not in (80, 443) else "")
    return f"{at}){parts.path.rstrip('/') or '/'}" + (f"?{parts.query}" if parts.query else "")


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def record(kind: str, url: str | None, page_id: int | None, payload: bytes, size: int, digest: str, refers_to: int | None, mark: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {mark}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Bytes", str(size)),
        ("X-Capture", mark),
    ]
    if url:
        fields.append(("WARC-Target-URI", quote(url.strip(), safe="".join(map(chr, range(33, 127))))))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-Id", str(refers_to))]
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record; the block's length comes from the record, not from what the payload looks like."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return fields, block.partition(b"\r\n\r\n")[2]


def planned(pages: DataFrame, row: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(row, url, html, mark, kind, refers_to): which page is a response and which revisits an equal payload.

    Of pages with equal payloads of ``least_bytes`` or more, that of the smallest id is the response, and so are rows that
    repeat its id; the others revisit it. Null ids come last; a payload of null ids alone has responses only. A null payload
    is empty. mark tells rows apart; rows that agree in id, url and payload share it.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    keyed = pages.select(F.col(row).cast("long").alias("row"), F.col(url).alias("url"), payload.alias("html"))
    keyed = keyed.withColumns({"sha": F.sha1("html"), "mark": F.lower(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in row_key("row", "url", "html")]))})
    light = keyed.where(F.octet_length("html") >= least_bytes).select("row", "mark", "sha")
    first = light.groupBy("sha").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count_if(F.col("row").isNull()).alias("nulls"))
    shared = first.where("first is not null and (first <> last or nulls > 0)").select("sha", "first")
    revisits = light.join(shared, "sha").where("row is null or row <> first").select("mark", F.col("first").alias("refers_to"))
    revisits = keep(revisits.distinct(), "revisits")
    joined = keyed.drop("sha").join(few(revisits), "mark", "left")
    return joined.withColumn("kind", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of ``planned`` and returns (key, file, offset, length) of all captures, written once.

    Files are named by task attempt; those of an attempt that failed are never referred to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        task = TaskContext.get()
        out, name, at, files = None, "", 0, 0
        for batch, texts in text_batches(batches, "html"):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("row", "url", "mark", "kind", "refers_to"))
            for page_id, url, mark, kind, refers_to, html in zip(*columns, texts, strict=True):
                payload = html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = _gzip(record(kind, url, page_id, payload, len(payload), digest, refers_to, mark))
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}.warc.gz"
                    out, at, files = store.open_output_stream(f"{base}/{name}", compression=None), 0, files + 1
                out.write(data)
                rows.append((f"{url_key(url)} {mark}", name, at, len(data)))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return keep(plan.mapInArrow(run, "key string, file string, offset long, length long"), "captures")


def build_index(captures: DataFrame, folder: str, parts: int) -> DataFrame:
    """Sorts captures by key into parts of compressed blocks; returns the parts (first, last, name, blocks), written once.

    The order is by key, file and offset, so that one key's captures may spread over parts. A part is its blocks, one after
    the other, then its directory, a compressed list of block lines; blocks holds where the directory begins and its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        task = TaskContext.get()
        out, name, at, directory, lines, first, last = None, "", 0, [], [], "", ""

        def flush() -> int:
            data = _gzip("\n".join(lines).encode())
            out.write(data)
            directory.append(f"{lines[0].split('\t', 1)[0]}\t{at}\t{len(data)}")
            lines.clear()
            return at + len(data)

        for batch in batches:
            for key, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.gz"
                    out, first = store.open_output_stream(f"{base}/{name}", compression=None), key
                lines.append(f"{key}\t{file}\t{offset}\t{length}")
                last = key
                if len(lines) == BLOCK_LINES:
                    at = flush()
        if out is not None:
            if lines:
                at = flush()
            data = _gzip("\n".join(directory).encode())
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, last, name, at, len(data))], ["first", "last", "name", "directory", "size"])

    dealt = captures.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return keep(dealt.mapInArrow(run, "first string, last string, name string, directory long, size long"), "index-parts")


class Part:
    """One part of the index, opened for bisection; keeps the block it read last."""

    def __init__(self, store: arrow_fs.FileSystem, path: str, directory: int, size: int):
        self.file = store.open_input_file(path)
        rows = [line.split("\t") for line in _gunzip(self.file.read_at(size, directory)).decode().split("\n")]
        self.first = [r[0] for r in rows]
        self.place = [(int(r[1]), int(r[2])) for r in rows]
        self.number, self.lines, self.reads = -1, [], 0

    def block(self, k: int) -> list[str]:
        if k != self.number:
            at, size = self.place[k]
            self.number, self.lines, self.reads = k, _gunzip(self.file.read_at(size, at)).decode().split("\n"), self.reads + 1
        return self.lines

    def captures(self, prefix: str) -> Iterator[list[str]]:
        """(key, file, offset, length) of all lines whose key begins with ``prefix``."""
        k = max(0, bisect.bisect_left(self.first, prefix) - 1)
        while k < len(self.first) and (self.first[k] <= prefix or self.first[k].startswith(prefix)):
            lines = self.block(k)
            i = bisect.bisect_left(lines, prefix)
            while i < len(lines) and lines[i].startswith(prefix):
                yield lines[i].split("\t")
                i += 1
            if i < len(lines):
                return
            k += 1


def lookup(requests: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """(prefix, key, file, offset, length) of all captures for the different values of ``prefix`` in ``requests``.

    A prefix is a whole key, or a URL key and a space for all captures of a URL, or a reversed host for all below it.
    Requests go to the parts whose range their prefix may touch; each part is read by up to four tasks.
    """
    parts = sorted((tuple(r) for r in index.select("last", "first", "name", "directory", "size").collect()), key=lambda r: (r[0], r[1], r[2]))
    shared = requests.sparkSession.sparkContext.broadcast(parts)  # MOST_PARTS rows at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        lasts = [r[0] for r in parts]
        for batch in batches:
            rows = []
            for prefix in batch.column("prefix").to_pylist():
                k = bisect.bisect_left(lasts, prefix)
                while k < len(parts) and (parts[k][1] <= prefix or parts[k][1].startswith(prefix)):
                    rows.append((prefix, *parts[k][2:]))
                    k += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["prefix", "name", "directory", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        part, name, rows = None, None, []

        def sent() -> pa.RecordBatch:
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["prefix", "key", "file", "offset", "length"])

        for batch in batches:
            for prefix, at, directory, size in zip(*(batch.column(c).to_pylist() for c in ("prefix", "name", "directory", "size")), strict=True):
                if at != name:
                    part, name = Part(store, f"{base}/{at}", directory, size), at
                for key, file, offset, length in part.captures(prefix):
                    rows.append((prefix, key, file, int(offset), int(length)))
                    if len(rows) >= 20_000:
                        yield sent()
        if rows:
            yield sent()

    wanted = requests.select("prefix").where("prefix is not null").distinct()
    touched = wanted.mapInArrow(route, "prefix string, name string, directory long, size long")
    dealt = touched.repartition("name", F.pmod(F.xxhash64("prefix"), F.lit(4))).sortWithinPartitions("name", "prefix")
    return dealt.mapInArrow(run, "prefix string, key string, file string, offset long, length long")


def read_records(found: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Reads the captures' ranges and parses them: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, html].

    Length and digest of a response are those of the payload that was read; they must agree with the record's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        name, file = None, None
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["html"] * payload
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * payload
        for batch in batches:
            rows, held = [], 0

            def sent(rows):
                return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

            for at, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if at != name:
                    file, name = store.open_input_file(f"{base}/{at}"), at
                fields, body = parse(_gunzip(file.read_at(length, offset)))
                size, digest = int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                    raise ValueError(f"{at} at {offset}: the payload is not what the record says")
                number = fields.get("X-Page-Id")
                refers = int(fields["X-Refers-To-Page-Id"]) if kind == "revisit" else None
                rows.append((int(number) if number else None, fields.get("WARC-Target-URI"), size, digest, kind, refers) + ((body.decode(),) if payload else ()))
                held += len(body) if payload else 0
                if held > 8 << 20:
                    yield sent(rows)
                    rows, held = [], 0
            if rows:
                yield sent(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payload
    dealt = found.withColumn("range", F.expr(f"offset div {READ_TOGETHER}")).repartition("file", "range").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(run, schema)


def archive(spark: SparkSession, pages: DataFrame, parts: int | None = None, row: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """Writes archives and index for all pages into a new shared folder: (captures, index parts, folder)."""
    folder = shared_folder(spark, "archive")
    captures = write_archives(planned(pages, row, url, html, least_bytes), folder)
    wanted = min(MOST_PARTS, parts or max(1, captures.count() // (BLOCK_LINES * 16)))
    return captures, build_index(captures, folder, wanted), folder
