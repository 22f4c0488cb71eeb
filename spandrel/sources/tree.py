"""Source trees as a Spark data source: after ``register(spark)``, ``spark.read.format("sourcetree").option("path", root).load()``.

A partition is a folder with all below it, or a share of one folder's own files. Planning lists folders breadth first only
until there are enough partitions (option ``partitions``), everything else is listed by the tasks; names never come together on the driver.
Files are (path, rel, lang, size, modified in nanoseconds), with option ``content`` also hash and content. Conditions on ``lang`` (equality, in) and on
``rel`` (equality, prefix) are pushed down: they prune folders and extensions before anything is opened.

The folder may be on any file system that Arrow opens by URI (``file``, ``hdfs``, ``s3``, ``gs``, ...). Files that vanish or
cannot be read are left out, as are folders; ``../`` and links out of the tree are followed as the file system does.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from spandrel.operators.tables import written

# Languages by file extension, folders that are never entered, files that the engine itself writes.
EXTENSIONS = {
    "py": "python", "rs": "rust", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
}
SKIPPED_FOLDERS = {"target", "node_modules", "__pycache__", "dist", "build"}
OUTPUTS = {"graph.html", "graph.json", "diff.html"}
DEFAULT_LANGUAGES = ("python", "rust")

LISTED, READ = "path string, rel string, lang string, size long, modified long", "hash string, content binary"
#: Files of one folder in a partition, bytes of content in a batch, files that a task reads; beyond so many tasks it reads up to eight times as many.
SHARE, BATCH, FILES_PER_TASK, TASKS = 1000, 8 << 20, 256, 64


def language_of(name: str) -> str | None:
    return EXTENSIONS.get(name.rpartition(".")[2]) if "." in name else None


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool, share: int = 0, shares: int = 1):
        self.folder, self.deep, self.share, self.shares = folder, deep, share, shares


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.content = options["path"].rstrip("/"), options.get("content", "false").lower() == "true"
        self.enough = int(options.get("partitions", "256"))
        self.languages = set(filter(None, options.get("languages", ",".join(DEFAULT_LANGUAGES)).split(",")))
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("lang",):
                self.languages &= {f.value}
            elif isinstance(f, In) and f.attribute == ("lang",):
                self.languages &= set(f.value)
            elif isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("rel",):
                self.prefixes.append(f.value)
                if isinstance(f, EqualTo):
                    yield f
            else:
                yield f

    def _wanted(self, rel: str, folder: bool) -> bool:
        return all(rel.startswith(p) or (folder and p.startswith(f"{rel}/")) for p in self.prefixes)

    def _list(self, system: pafs.FileSystem, top: str, folder: str) -> tuple[list[str], list[tuple[str, str, int, int]]]:
        """(folders, files as (rel, language, size, modified)) right inside a folder."""
        try:
            found = system.get_file_info(pafs.FileSelector(f"{top}/{folder}" if folder else top))
        except OSError:
            return [], []
        folders, files = [], []
        for x in found:
            rel = f"{folder}/{x.base_name}" if folder else x.base_name
            if x.type == pafs.FileType.Directory:
                if not x.base_name.startswith(".") and x.base_name not in SKIPPED_FOLDERS and self._wanted(rel, True):
                    folders.append(rel)
            elif x.type == pafs.FileType.File and x.base_name not in OUTPUTS and (lang := language_of(x.base_name)) in self.languages and self._wanted(rel, False):
                files.append((rel, lang, x.size, x.mtime_ns))
        return sorted(folders), files

    def partitions(self) -> list[Part]:
        if not self.languages:
            return [Part("", False, 0, 0)]
        system, top = open_folder(self.root)
        parts, open_ = [], [""]
        while open_ and len(parts) + len(open_) < self.enough:
            folder = open_.pop(0)
            more, files = self._list(system, top, folder)
            shares = -(-len(files) // SHARE)
            parts += [Part(folder, False, k, shares) for k in range(shares)]
            open_ += more
        return parts + [Part(f, True) for f in open_] or [Part("", False, 0, 0)]

    def _files(self, system: pafs.FileSystem, top: str, part: Part) -> Iterator[tuple[str, str, int, int]]:
        if not part.shares:
            return
        open_ = [part.folder]
        while open_:
            more, files = self._list(system, top, open_.pop())
            yield from (f for f in files if part.shares == 1 or zlib.crc32(f[0].encode()) % part.shares == part.share)
            open_ += more if part.deep else []

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(self.root)
        rows: list[tuple] = []
        held = 0
        for rel, *told in self._files(system, top, part):
            row = (f"{self.root}/{rel}", rel, *told)
            if self.content:
                data = contents(system, f"{top}/{rel}")
                if data is None:
                    continue
                row, held = (*row, hashlib.sha256(data).hexdigest(), data), held + len(data)
            rows.append(row)
            if len(rows) >= SHARE or held >= BATCH:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()] + [pa.string(), pa.binary()] * self.content
        names = [c.split()[0] for c in (f"{LISTED}, {READ}" if self.content else LISTED).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return f"{LISTED}, {READ}" if self.options.get("content", "false").lower() == "true" else LISTED

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark hand conditions to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


def contents(system: pafs.FileSystem, path: str) -> bytes | None:
    try:
        with system.open_input_file(path) as f:
            return f.read()
    except OSError:
        return None


def listing(spark: SparkSession, root: str, languages: Iterable[str] = DEFAULT_LANGUAGES) -> DataFrame:
    """(path, rel, lang, file_seq): the files of a tree, numbered in the order of rel (ascending, with gaps), by range partitions."""
    register(spark)
    files = spark.read.format("sourcetree").option("languages", ",".join(languages)).option("path", root).load()
    return written(files.repartitionByRange("rel").sortWithinPartitions("rel").withColumn("file_seq", F.monotonically_increasing_id()).select("path", "rel", "lang", "file_seq"))


def with_contents(files: DataFrame) -> DataFrame:
    """files (path, rel, lang, file_seq) + hash (SHA-256), content, dealt out evenly; files that cannot be read are left out."""
    shape = "path string, rel string, lang string, file_seq long, hash string, content binary"
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, pafs.FileSystem] = {}

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in shape.split(", ")])

        for b in batches:
            rows, held = [], 0
            for path, rel, lang, seq in zip(*(c.to_pylist() for c in b.columns), strict=True):
                scheme = path.partition(":/")[0] if ":/" in path else ""
                system, at = (systems[scheme], open_folder(path)[1]) if scheme in systems else open_folder(path)
                systems[scheme] = system
                if (data := contents(system, at)) is None:
                    continue
                rows.append((path, rel, lang, seq, hashlib.sha256(data).hexdigest(), data))
                held += len(data)
                if held >= BATCH:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    files = files.select("path", "rel", "lang", "file_seq")
    n = files.count()
    return files.repartition(max(1, min(-(-n // FILES_PER_TASK), max(TASKS, -(-n // (8 * FILES_PER_TASK)))))).mapInArrow(run, shape)


def write_tree(files: DataFrame, root: str) -> int:
    """Write files (rel, content binary) below ``root``, each from the task that holds it; gives their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(root)
        made: set[str] = set()
        for b in batches:
            for rel, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                folder = f"{top}/{rel}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{rel}") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return files.select("rel", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
