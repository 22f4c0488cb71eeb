"""Incremental analysis: facts and answers of the last run are kept, changed files are parsed and what they alter is resolved again.

The cache is a folder of numbered versions, each of four Parquet tables (facts, and the three tables of ``resolve.Answers``)
and a mark that is written last. The newest marked version counts; a run that dies leaves the one before it, and versions
without a mark are overwritten by nobody and removed with the old ones after the next run. Any file system that Spark
writes to will do. The result of a run with the cache is that of a cold run.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import incremental
from spandrel.operators.components import checkpoint
from spandrel.operators.graph import Graph
from spandrel.operators.resolve import Answers, answers, assemble, build_graph, questions
from spandrel.schema import FACTS
from spandrel.sources import scan as scans

PARTS = ("names", "imports", "mods")


class Cache:
    def __init__(self, folder: str):
        self.path = f"{folder.rstrip('/')}/{scans.CACHE}"

    def _fs(self, spark: SparkSession, path: str) -> tuple:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def versions(self, spark: SparkSession) -> list[tuple[int, bool]]:
        """(number, marked) of the versions that are there, ascending."""
        fs, top = self._fs(spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        numbers = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
        return [(n, fs.exists(self._fs(spark, f"{self.path}/v{n}/COMPLETE")[1])) for n in numbers]

    def current(self, spark: SparkSession) -> str | None:
        """The folder of the newest whole version."""
        whole = [n for n, marked in self.versions(spark) if marked]
        return f"{self.path}/v{whole[-1]}" if whole else None

    def load(self, spark: SparkSession) -> DataFrame:
        """The kept facts; none if there is no whole version or it cannot be read."""
        if at := self.current(spark):
            try:
                return spark.read.schema(FACTS).parquet(f"{at}/facts")
            except Exception:  # noqa: BLE001  a broken cache is no cache
                pass
        return spark.createDataFrame([], FACTS)

    def load_answers(self, spark: SparkSession) -> Answers | None:
        if at := self.current(spark):
            try:
                return Answers(*[spark.read.parquet(f"{at}/{p}") for p in PARTS])
            except Exception:  # noqa: BLE001
                pass
        return None

    def save(self, facts: DataFrame, found: Answers) -> None:
        """A new version; what it is made from may be the one before, so that goes last."""
        spark = facts.sparkSession
        before = [n for n, _ in self.versions(spark)]
        new = f"{self.path}/v{max(before, default=0) + 1}"
        facts.write.parquet(f"{new}/facts")
        for p in PARTS:
            getattr(found, p).write.parquet(f"{new}/{p}")
        fs, mark = self._fs(spark, f"{new}/COMPLETE")
        fs.create(mark, True).close()
        for n in before:
            fs.delete(self._fs(spark, f"{self.path}/v{n}")[1], True)

    def hash_for(self, spark: SparkSession, rel: str) -> str | None:
        row = self.load(spark).filter(F.col("file") == rel).select("hash").first()
        return row["hash"] if row else None


def incremental_facts(files: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, changed): facts of all files, those of unchanged ones from ``kept``; ``changed`` are the files parsed anew."""
    known = kept.select(F.col("file").alias("rel"), "hash", "lang").distinct()
    files = checkpoint(files)
    changed = files.join(known, ["rel", "hash", "lang"], "left_anti")
    same = files.select("rel", "hash", "lang", F.col("file_seq").alias("now")).join(known, ["rel", "hash", "lang"], "left_semi")
    old = kept.join(same.withColumnRenamed("rel", "file"), ["file", "hash", "lang"]).withColumn("file_seq", F.col("now")).select(*[f.name for f in FACTS])
    return old.unionByName(scans.extract_facts(changed)), changed


def analyze(spark: SparkSession, root: str, languages: Iterable[str] = scans.DEFAULT_LANGUAGES, use_cache: bool = True, **options) -> Graph:
    """The graph of a source tree."""
    files = scans.scan(spark, root, languages)
    if not use_cache:
        return build_graph(checkpoint(scans.extract_facts(files)), **options)
    return analyze_again(Cache(root), files, **options)[0]


def analyze_again(cache: Cache, files: DataFrame, **options) -> tuple[Graph, incremental.Redone | None]:
    """The graph of files (with contents), and what had to be resolved again; None where nothing was kept."""
    spark = files.sparkSession
    old, kept = cache.load(spark), cache.load_answers(spark)
    facts = checkpoint(incremental_facts(files, old)[0])
    q = questions(facts, **options)
    found, redone = incremental.update(old, q, kept) if kept else (answers(q), None)
    graph = assemble(q, found)
    cache.save(facts, found)
    return graph, redone


def analyze_git(spark: SparkSession, repo: str, ref: str, languages: Iterable[str] = scans.DEFAULT_LANGUAGES, strict_compat: bool = False) -> Graph:
    """The graph of a git reference."""
    files = scans.read_git(scans.files_frame(spark, scans.list_git(repo, ref, languages, strict_compat)), repo)
    return build_graph(checkpoint(scans.extract_facts(files)))


def git_diff(spark: SparkSession, repo: str, ref: str = "main", languages: Iterable[str] = scans.DEFAULT_LANGUAGES) -> tuple[Graph, Graph, dict[str, DataFrame]]:
    """(old, new, changes) between a git reference and the working tree, each file of which is parsed once."""
    from spandrel.sources import git

    out = git.diff_worktree(spark, repo, ref, languages)
    return out.old, out.new, out.changes
