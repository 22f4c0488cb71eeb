"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators.components import checkpoint, checkpoint_folder, fitted, side
from spandrel.operators.tables import written

__all__ = ["checkpoint", "checkpoint_folder", "crc_mod", "crc_mod_py", "drop_folder", "fitted", "plain", "plan_bytes", "side", "table", "without_collector", "written"]

#: Runs of these code points count as one space, and separate words.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(docs: DataFrame, *wanted: str) -> tuple:
    """``docs`` with its columns named c0, c1, ... by place, and those names of the wanted columns.

    So no name of the input can clash with a name of ours or, but for its case, with another of the input. Give the names
    back by ``toDF``.
    """
    names = docs.columns
    lower = [n.lower() for n in names]
    at = [names.index(w) if w in names else lower.index(w.lower()) for w in wanted]
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), *[f"c{i}" for i in at]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def without_collector() -> Iterator[None]:
    """Large tables without cycles grow in here; looking through them for cycles again and again would cost a third of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size in bytes; 0 where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 56 else 0


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def crc_mod_py(value, n: int) -> int:
    return 0 if value is None else zlib.crc32(str(value).encode()) % n
