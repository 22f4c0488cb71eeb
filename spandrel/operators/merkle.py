"""Digests of folders, compared from the top down: two versions of a tree differ where the digests of their folders do.

The digest of a folder is a sum over all files below it: the SHA-256 of a file's path and hash, cut into eight numbers of
32 bits, each summed for itself. Sums know no order and combine before they travel, so one aggregation gives the folders of
all levels, and a folder of millions of files is no group in one task. Sums of 2**31 files stay exact.

A ``Digests`` is a table in folders by depth and by bucket of the parent's path. A comparison opens, level by level, the
folders whose digests differ, and reads only the buckets that hold these. A folder and a file of one name are two things. Of
rows with one ``rel`` that with the smallest hash counts, a null hash counts as empty, rows without ``rel`` are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators.components import checkpoint_folder, side
from spandrel.operators.tables import Scratch, written

LIMBS = 8
#: Entries that a bucket of a level holds at least on average, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 1024
CHANGES = "rel string, change string, old_hash string, new_hash string"


def _bucket(path: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def entries(files: DataFrame) -> DataFrame:
    """(parent, path, folder, depth, digest, files, hash): every file (rel, hash) and every folder above one; the root is '' without parent."""
    files = files.filter("rel is not null").groupBy("rel").agg(F.min(F.coalesce("hash", F.lit(""))).alias("hash"))
    key = F.sha2(F.concat_ws("\0", "rel", "hash"), 256)
    limbs = [F.conv(F.substring("key", 8 * i + 1, 8), 16, 10).cast("long").alias(f"s{i}") for i in range(LIMBS)]
    names = F.split("rel", "/")
    one = files.withColumn("key", key).select("rel", "hash", names.alias("names"), *limbs)
    sums = [f"s{i}" for i in range(LIMBS)]
    own = one.select("rel", F.lit(False).alias("folder"), F.size("names").alias("depth"), F.array(*sums).alias("digest"), F.lit(1).cast("long").alias("files"), "hash")
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.struct(F.array_join(F.slice("names", 1, i), "/").alias("rel"), i.alias("depth"))))
    folders = one.select(above.alias("f"), *sums).groupBy("f.rel", "f.depth").agg(*[F.sum(s).alias(s) for s in sums], F.count(F.lit(1)).alias("files"))
    folders = folders.select("rel", F.lit(True).alias("folder"), "depth", F.array(*sums).alias("digest"), "files", F.lit(None).cast("string").alias("hash"))
    parent = F.when(F.col("depth") > 0, F.regexp_replace("rel", "/?[^/]*$", ""))
    return own.unionByName(folders).select(parent.alias("parent"), F.col("rel").alias("path"), "folder", "depth", "digest", "files", "hash")


class Digests:
    """The entries of a tree, kept in the shared folder (or in ``folder``) by depth and bucket of the parent."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    @classmethod
    def of(cls, files: DataFrame, folder: str | None = None, buckets: int | None = None) -> Digests:
        spark = files.sparkSession
        folder = folder or f"{checkpoint_folder(spark)}/digests-{uuid.uuid4().hex}"
        rows = written(entries(files))
        n = buckets or max(1, min(rows.count() // BUCKET_ROWS, MOST_BUCKETS))
        rows = rows.withColumn("bucket", _bucket(F.coalesce("parent", F.lit("")), n))
        # A bucket with a large folder spreads over tasks, by the names in it.
        rows.repartition("depth", "bucket", F.pmod(F.xxhash64("path"), F.lit(8))).write.partitionBy("depth", "bucket").parquet(folder)
        return cls(spark, folder, n)

    def all(self) -> DataFrame:
        shape = "parent string, path string, folder boolean, digest array<bigint>, files bigint, hash string, depth int, bucket int"
        return self.spark.read.schema(shape).parquet(self.folder)

    def root(self) -> DataFrame:
        return self.all().filter("depth = 0")

    def below(self, depth: int, folders: DataFrame, rows: int) -> DataFrame:
        """The entries right inside ``folders`` (path), which are ``rows`` folders at ``depth``; other buckets are not read."""
        wanted = [r[0] for r in folders.select(_bucket("path", self.buckets)).distinct().collect()]  # numbers below MOST_BUCKETS
        near = side(folders.select(F.col("path").alias("parent")), rows)
        return self.all().filter((F.col("depth") == depth + 1) & F.col("bucket").isin(wanted)).join(near, "parent", "left_semi")


@dataclass
class Opened:
    """Folders whose digests differ, and entries that were looked at in them (either side's, once if on both)."""

    folders: int = 0
    entries: int = 0


def compare(old: Digests, new: Digests) -> tuple[DataFrame, Opened]:
    """((rel, change, old_hash, new_hash), opened): files that were added, removed or changed between two trees."""
    spark, opened = old.spark, Opened()
    scratch = Scratch(spark)
    cut = lambda df, name: df.select("path", "folder", F.col("digest").alias(f"{name}_digest"), F.col("hash").alias(f"{name}_hash"))
    meet = lambda a, b: cut(a, "old").join(cut(b, "new"), ["path", "folder"], "full")
    differ = ~F.col("old_digest").eqNullSafe(F.col("new_digest"))
    out, depth = [], 0
    level = scratch.keep(meet(old.root(), new.root()))
    while True:
        front = level.filter(F.col("folder") & differ).select("path")
        rows = front.count()
        change = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").otherwise("changed")
        out.append(level.filter(~F.col("folder") & differ).select(F.col("path").alias("rel"), change.alias("change"), "old_hash", "new_hash"))
        if not rows:
            break
        level = scratch.keep(meet(old.below(depth, front, rows), new.below(depth, front, rows)))
        opened.folders, opened.entries, depth = opened.folders + rows, opened.entries + level.count(), depth + 1
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return scratch.close(found), opened


def folder_changes(old: Digests, new: Digests) -> DataFrame:
    """(path, old_files, new_files, same) of every folder of either tree: how many files are below it, and whether all are equal."""
    cut = lambda t, name: t.all().filter("folder").select("path", F.col("digest").alias(f"{name}_digest"), F.col("files").alias(f"{name}_files"))
    both = cut(old, "old").join(cut(new, "new"), "path", "full")
    files = [F.coalesce(f"{n}_files", F.lit(0)).cast("long").alias(f"{n}_files") for n in ("old", "new")]
    return both.select("path", *files, F.col("old_digest").eqNullSafe(F.col("new_digest")).alias("same"))
