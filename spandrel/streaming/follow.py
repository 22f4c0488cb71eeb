"""Changes of a source tree as a streaming query.

Every trigger lists the tree through the data source of ``tree``, in the executors, and writes the list as a numbered snapshot;
what differs from the snapshot before are the changes. Snapshots are named by the batch they belong to and count once a
mark is there, and the query has a checkpoint, so a restarted query goes on where it stopped: a batch that was begun but not
finished is given again with the same number and the same changes, a finished one never, and what changed while nothing
ran is in the first batch. Handlers that act once per number act once per change. The engine's own outputs and caches are no
sources, so an analysis does not set off the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spandrel.operators.graph import Graph
from spandrel.sources import cache, tree

SHAPE = "rel string, lang string, size long, modified long"


class Snapshots:
    """Numbered lists of a tree's files in a folder on any file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        """The whole ones, ascending."""
        fs, top = self._fs(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[1:]) for n in names if n.startswith("s") and n[1:].isdigit() and fs.exists(self._fs(f"{self.folder}/{n}/COMPLETE")[1]))

    def read(self, number: int | None) -> DataFrame:
        return self.spark.createDataFrame([], SHAPE) if number is None else self.spark.read.schema(SHAPE).parquet(f"{self.folder}/s{number}/files")

    def take(self, number: int, root: str, languages: Iterable[str]) -> DataFrame:
        """The snapshot ``number``: as it was taken, or taken now."""
        if number not in self.numbers():
            tree.register(self.spark)
            files = self.spark.read.format("sourcetree").option("path", root).option("languages", ",".join(languages)).load()
            files.select("rel", "lang", "size", "modified").write.mode("overwrite").parquet(f"{self.folder}/s{number}/files")
            fs, mark = self._fs(f"{self.folder}/s{number}/COMPLETE")
            fs.create(mark, True).close()
        return self.read(number)

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                fs, p = self._fs(f"{self.folder}/s{n}")
                fs.delete(p, True)


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel, lang, change): files added, removed or changed (size or time) between two snapshots."""
    a = old.select("rel", F.col("lang").alias("lang_then"), F.struct("size", "modified").alias("then"))
    b = new.select("rel", "lang", F.struct("size", "modified").alias("now"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return a.join(b, "rel", "full").filter(~F.col("then").eqNullSafe(F.col("now"))).select("rel", F.coalesce("lang", "lang_then").alias("lang"), change.alias("change"))


def follow(spark: SparkSession, root: str, state: str, on_changes: Callable[[DataFrame, int], None], languages: Iterable[str] = tree.DEFAULT_LANGUAGES, every: str = "1 second") -> StreamingQuery:
    """A running query that hands (changes, batch number) on whenever there are any; ``state`` holds snapshots and checkpoint."""
    kept, languages = Snapshots(spark, f"{state}/snapshots"), tuple(languages)

    def step(_: DataFrame, number: int) -> None:
        earlier = [n for n in kept.numbers() if n < number]
        now = kept.take(number, root, languages)
        changes = differences(kept.read(earlier[-1] if earlier else None), now)
        if not changes.isEmpty():
            on_changes(changes, number)
        kept.forget(number)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/checkpoint").trigger(processingTime=every).start()


def analyses(spark: SparkSession, root: str, state: str, on_graph: Callable[[Graph, int], None], languages: Iterable[str] = tree.DEFAULT_LANGUAGES, every: str = "1 second") -> StreamingQuery:
    """A running query that analyses the tree after every change, with the cache, and hands each graph on."""
    return follow(spark, root, state, lambda _, number: on_graph(cache.analyze(spark, root, languages), number), languages, every)
