"""WARC archives with revisit records, and a two-level capture index over them.

Writing. Every row becomes one record, a gzip member of its own; equal payloads of ``revisit_from`` bytes or more are
stored once, by the record of the smallest id, and the others are revisits of it. A task cuts its records into files of
``file_bytes`` (or one record). Files are written by Spark's text writer, so they land whole or not at all on any file
system Spark knows: a gzip member ends with the zero byte of its size field, and that byte serves as the line separator
(a member of 16 MiB or more gets an empty member behind it).

Index. Captures are sorted by reversed-host key over range partitions, cut into blocks of ``lines`` lines that are
compressed one by one, and a sparse directory keeps the first key and the place of each block. A lookup bisects the
directory, reads the one block's range, bisects its lines, and reads the record's range of the archive. :func:`captures_of`
does so for a table of URLs in parallel: keys are dealt to blocks, each block is read once, and the captures found are read
record by record, in the order of their files. A URL with many captures lies in many blocks, which are read apart.

URLs stand in headers and keys with white space, controls and what else is not visible percent-encoded, so keys sort and
compare as lines do.

Defined cases: a null payload is empty; a null URL has the key ``-``; a null id comes after all others and is no response
for anyone unless a group has null ids only; rows that repeat id and payload have equal record types; empty tables give
no records; other columns may have any names and are never looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_folder, plain

DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PLACE = "file string, offset long, length long"
#: Bytes of an archive file.
FILE_BYTES = 4 << 20
#: Blocks of a directory that one process may hold.
MOST_BLOCKS = 500_000


def visible(url: str) -> str:
    """The URL without white space around it, and what is not visible in it percent-encoded."""
    t = url.strip()
    if t.isprintable() and " " not in t:
        return t
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in t)


def key_of(url: str | None) -> str:
    """``com,example,www)/path?query`` of an absolute URL."""
    url = visible(url or "")
    if not url:
        return "-"
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.lower()
    at = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{at}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def member(data: bytes) -> bytes:
    """A gzip member (or two) that ends with a zero byte."""
    pack = lambda x: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + c.flush()
    out = pack(data)
    return out if out[-1] == 0 else out + pack(b"")


def members(data: bytes, feed: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the members of a file."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, start, parts = zlib.decompressobj(31), at, []
        while not d.eof and at < len(data):
            parts.append(d.decompress(view[at : at + feed]))
            at += min(feed, len(data) - at)
        at -= len(d.unused_data)
        content = b"".join(parts)
        if content:
            yield start, at - start, content


def record(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else visible(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", size)]
    block = HTTP
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; the payload's digest and size are those of the stored payload where there is one."""
    cut = data.index(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in data[:cut].decode().split("\r\n")[1:])
    block = data[cut + 4 : cut + 4 + int(head["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    number = lambda x: None if x is None or x.endswith(":null>") else int(x[len("<urn:page:") : -1])
    stored = head["WARC-Type"] == "response"
    return {
        "page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload": payload if stored else None,
        "payload_bytes": len(payload) if stored else int(head["X-Payload-Length"]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if stored else head["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")),
    }


def _save(chunks: DataFrame, path: str, by: str | None = None) -> None:
    """Write the binary column ``data``, whose values end with a zero byte, back to back, into a folder for each ``by``."""
    line = F.expr("substring(data, 1, length(data) - 1)").cast("string").alias("value")
    w = chunks.select(line, *([by] if by else [])).write.option("lineSep", "\0").option("compression", "none")
    (w.partitionBy(by) if by else w).text(path)


def _columns(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _schema(schema: str) -> pa.Schema:
    return pa.schema([(c, pa.string() if kind == "string" else pa.int64()) for c, kind in (x.split() for x in schema.split(", "))])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 100, file_bytes: int = FILE_BYTES) -> None:
    pages, i, u, p = plain(pages, id_col, url_col, payload_col)
    payload = F.coalesce(F.col(p).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(i).cast("long").alias("page_id"), F.col(u).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long"), "mark": F.coalesce(F.col("page_id").cast("string"), F.lit("null"))})
    large = checkpoint(rows.filter(F.col("size") >= revisit_from).select("mark", "page_id", "digest").distinct())
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"))
    # Payloads are dealt by id and digest, so that the copies of one payload are spread.
    roles = large.join(first, "digest").filter(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).select("mark", "digest", F.col("first").alias("refers_to"))
    rows = rows.join(roles, ["mark", "digest"], "left").withColumn("kind", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, at, n = 0, 0, 0
        for b in batches:
            for start in range(0, b.num_rows, 256):
                out = []
                for r in zip(*[c.to_pylist() for c in b.slice(start, 256).columns], strict=True):
                    data = member(record(*r))
                    if at and at + len(data) > file_bytes:
                        sub, at = sub + 1, 0
                    out.append((sub, n, data))
                    at, n = at + len(data), n + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["sub", "n", "data"])

    made = rows.select("page_id", "url", "payload", "digest", "size", "kind", "refers_to").mapInArrow(run, "sub long, n long, data binary")
    _save(made.sortWithinPartitions("sub", "n"), path, "sub")


def _named(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of all files below ``path``; a file's name is its path from there on."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+=[^/]+/)*[^/]+$", 0).alias("file"), "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of all archives below ``path``, by reading them file by file: CAPTURE, PLACE, key."""
    schema = f"{CAPTURE}, {PLACE}, key string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True):
                rows = [{k: v for k, v in parse(data).items() if k != "payload"} | {"file": file, "offset": at, "length": n} for at, n, data in members(content)]
                for r in rows:
                    r["key"] = key_of(r["url"])
                yield pa.RecordBatch.from_pylist(rows, schema=_schema(schema))

    return _named(spark, path).mapInArrow(run, schema)


def write_index(captures: DataFrame, path: str, lines: int = 3000, partitions: int | None = None) -> None:
    """Blocks under ``path``/blocks and their directory (first_key, last_key, part, offset, length) under ``path``/directory."""
    from pyspark import TaskContext

    n = partitions or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    names = _columns(f"{CAPTURE}, {PLACE}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = 0, []

        def block() -> pa.RecordBatch:
            nonlocal at, held
            data = member("".join(f"{k} {v}\n" for k, v in held).encode("utf-8", "surrogatepass"))
            row = [held[0][0], held[-1][0], TaskContext.get().partitionId(), at, len(data), data]
            at, held = at + len(data), []
            kinds = {"first_key": pa.string(), "last_key": pa.string(), "part": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "data": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds.values(), strict=True)], list(kinds))

        for b in batches:
            for r in b.to_pylist():
                held.append((r["key"], json.dumps({k: r[k] for k in names})))
                if len(held) == lines:
                    yield block()
        if held:
            yield block()

    blocks = checkpoint(ordered.mapInArrow(run, "first_key string, last_key string, part long, offset long, length long, data binary"))
    _save(blocks, f"{path}/blocks")
    blocks.drop("data").write.parquet(f"{path}/directory")


def found_in(block: bytes, key: str) -> list[dict]:
    """The captures of a key in a block."""
    lines = block.decode("utf-8", "surrogatepass").split("\n")[:-1]
    return _found_in(lines, key)


def _found_in(lines: list[str], key: str) -> list[dict]:
    out = []
    for line in lines[bisect.bisect_left(lines, key + " ") :]:
        if not line.startswith(key + " "):
            break
        out.append(json.loads(line[len(key) + 1 :]))
    return out


# ---- range reads in workers ------------------------------------------------------------------------------------------


def file_system(path: str):
    """(file system, path in it) for workers. An error where Arrow has none for the scheme: there is no other way to read ranges there."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError, NotImplementedError) as e:
        raise ValueError(f"records cannot be read by ranges from {path}: name a folder on a file system that Arrow opens") from e


class Ranges:
    """Ranges of the files below a folder; the file read last stays open."""

    def __init__(self, folder: str):
        self.fs, self.root = file_system(folder)
        self.name, self.file = "", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        return self.file.read_at(length, offset)


def _blocks_of(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """(key, file, offset, length) of the blocks that may hold each key, by bisection of the directory.

    The directory goes along in pieces of MOST_BLOCKS blocks; one piece is all there is up to MOST_BLOCKS * ``lines`` captures.
    """
    spark, schema = keys.sparkSession, "key string, file string, offset long, length long"
    total = directory.count()
    passes = max(1, -(-total // MOST_BLOCKS))
    parts = []
    for i in range(passes):
        piece = directory if passes == 1 else directory.filter(F.pmod(F.xxhash64("first_key", "part", "offset"), F.lit(passes)) == i)
        rows = piece.select("first_key", "last_key", "file", "offset", "length").toArrow().to_pydict()
        order = sorted(range(len(rows["file"])), key=lambda j: (rows["first_key"][j], rows["last_key"][j]))
        shared = spark.sparkContext.broadcast([[c[j] for j in order] for c in rows.values()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            first, last, *place = shared.value
            for b in batches:
                out = []
                for key in b.column(0).to_pylist():
                    for at in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                        out.append((key, *[c[at] for c in place]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 4, _schema(schema), strict=True)], _columns(schema))

        parts.append(keys.mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def captures_of(urls: DataFrame, archives: str, index: str) -> DataFrame:
    """CAPTURE and PLACE of every capture of the URLs (url) of a table, by directory, blocks and the records themselves.

    Sizes and digests of responses are those of the payload that was read.
    """
    spark = urls.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key_of(u) for u in b.column(0).to_pylist()], pa.string())], ["key"])

    keys = urls.select(F.col(urls.columns[0]).cast("string").alias("url")).mapInArrow(keyed, "key string").distinct()
    names = _named(spark, f"{index}/blocks").select("file", F.regexp_extract("file", r"part-(\d+)-", 1).cast("long").alias("part"))
    directory = checkpoint(spark.read.parquet(f"{index}/directory").join(names, "part"))
    wanted = _blocks_of(keys, directory)
    schema = f"{CAPTURE}, {PLACE}"

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, place, lines = Ranges(f"{index}/blocks"), None, []
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                out = []
                for key, *here in zip(*[c.to_pylist() for c in b.slice(at, 2000).columns], strict=True):
                    if here != place:
                        place = here
                        lines = next(members(ranges.read(*here)))[2].decode("utf-8", "surrogatepass").split("\n")[:-1]
                    out += _found_in(lines, key)
                yield pa.RecordBatch.from_pylist(out, schema=_schema(schema))

    block = ["file", "offset"]
    found = wanted.repartition(*block).sortWithinPartitions(*block).mapInArrow(in_blocks, schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(archives)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for r in b.slice(at, 256).to_pylist():
                    own = parse(next(members(ranges.read(r["file"], r["offset"], r["length"])))[2])
                    out.append(own | {k: r[k] for k in ("file", "offset", "length")})
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in _columns(schema)} for x in out], schema=_schema(schema))

    # Records go to tasks by stretches of their files, so a large file is read by several.
    stretch = F.floor(F.col("offset") / (4 << 20))
    return found.repartition("file", stretch).sortWithinPartitions("file", "offset").mapInArrow(records, schema)


class CaptureIndex:
    """Lookups of single URLs on the driver. The directory is sparse; it is read whole, up to ``most`` blocks."""

    def __init__(self, spark: SparkSession, archives: str, index: str, most: int = MOST_BLOCKS):
        self.spark, self.archives, self.index = spark, archives, index
        directory = spark.read.parquet(f"{index}/directory")
        if directory.count() > most:
            raise ValueError("the directory is too large for one process; use captures_of")
        self.blocks = sorted((r["first_key"], r["last_key"], r["part"], r["offset"], r["length"]) for r in directory.collect())
        self.first, self.last = [b[0] for b in self.blocks], [b[1] for b in self.blocks]
        self.parts = {int(n.split("-")[1]): n for n in self._names(f"{index}/blocks")}
        self.ranges_read: list[tuple[str, int, int]] = []

    def _fs(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(conf)

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("part-")]

    def _range(self, path: str, offset: int, length: int) -> bytes:
        self.ranges_read.append((path, offset, length))
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            stream.seek(offset)
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(length)))
        finally:
            stream.close()

    def lookup(self, url: str | None) -> list[dict]:
        """The captures of a URL."""
        key, found = key_of(url), []
        for _, _, part, offset, length in self.blocks[bisect.bisect_left(self.last, key) : bisect.bisect_right(self.first, key)]:
            found += found_in(next(members(self._range(f"{self.index}/blocks/{self.parts[part]}", offset, length)))[2], key)
        return found

    def fetch(self, capture: dict) -> dict:
        """The record of a capture, read by its range."""
        return parse(next(members(self._range(f"{self.archives}/{capture['file']}", capture["offset"], capture["length"])))[2])


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors can both read and write."""
    return f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"


def archive_and_read(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write archives and index, look every page's URL up in the index, and read its records by their ranges."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    file_system(folder)  # before anything is written
    own, url = plain(pages, columns.get("url_col", "url"))
    write_archives(pages, f"{folder}/archives", **columns)
    captures = checkpoint(read_archives(spark, f"{folder}/archives"))
    write_index(captures, f"{folder}/index")
    return captures_of(own.select(F.col(url).alias("url")), f"{folder}/archives", f"{folder}/index").select(*[c for c in _columns(CAPTURE) if c != "url"])


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when first is not null and first is distinct from page_id then 'revisit' else 'response' end as record_type,
       case when first is distinct from page_id then first end as refers_to
from d left join f using (payload_digest)
"""
