"""Exact deduplication as a tree-merge of sorted digest runs, with DataFrame functions only.

A run holds each digest once, in order, with the smallest id and the count. Input partitions fold their own copies and
hand them to the base runs (partition number modulo ``runs``), so a text that fills a third of all rows travels as one
row per partition. In each binomial round the runs ``i * fan_in .. i * fan_in + fan_in - 1`` send what they hold to run
``i``, slice by slice of the digest space: a task gets the like slices of the partners (an exchange by run and slice,
never by digest), and a sort aggregate brings them into one order and merges neighbours of equal digest, keeping the
smallest id. The last run holds each text once. Slices keep a task's share of a run bounded: there are SLICES of them.

Verification. Digests merge only together with the length and a second hash of the normalised text, at every level. In
the end the texts themselves are compared: over the rows of every merged group the least text must equal the greatest (an
aggregate that folds copies before anything is shuffled). Groups that fail, digest collisions, are split by their texts.

Defined cases: a null text is the empty text; a null id loses against any other id and is kept only where a group has
no other; rows that repeat both id and text are all reported with ``kept`` true in :func:`exact_dedup`, and one of them
survives :func:`keep_first`; empty tables give empty results; other columns may have any names and are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, plain, side

KEY = ["digest", "length", "check"]
SLICES = 1 << 16
#: Rows of the filter that leaves rows of single texts out of the verification.
BUCKETS = 1 << 18


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space (a lone space is left alone, which is the same)."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def second(text: Column) -> Column:
    return F.xxhash64(text)


def _keys(text: Column, digest: Callable, check: Callable) -> list[Column]:
    return [digest(text).alias(KEY[0]), F.octet_length(text).cast("long").alias(KEY[1]), check(text).alias(KEY[2])]


def _least(id_: Column) -> Column:
    """Sorts ids, null last. A struct, so that groups are merged by a sort aggregate."""
    return F.struct(id_.isNull().alias("none"), id_.alias("id"))


def merge_runs(digests: DataFrame, runs: int = 16, fan_in: int = 4) -> DataFrame:
    """From (KEY, id): a row per KEY with keep (smallest id) and size. ``runs``: base runs; ``fan_in``: partners of a round."""
    place = ["run", "slice"]
    level = digests.select(F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), F.pmod(F.xxhash64(*KEY), F.lit(SLICES)).cast("int").alias("slice"), *KEY, _least(F.col("id")).alias("least"))
    level = level.groupBy(*place, *KEY).agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("size"))
    while runs > 1:
        runs = -(-runs // fan_in)
        partners = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition(*place)
        level = partners.groupBy(*place, *KEY).agg(F.min("least").alias("least"), F.sum("size").alias("size"))
    return level.select(*KEY, F.col("least.id").alias("keep"), "size")


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS)).cast("int").alias("bucket")


def verified(texts: DataFrame, merged: DataFrame) -> DataFrame | None:
    """From (KEY, text, id): (KEY, text, keep, size) of the texts whose KEY also stands for another text; None if there are none.

    Only rows whose KEY falls in the bucket of a group of several rows are compared; the filter has BUCKETS rows at most.
    """
    several = F.broadcast(merged.filter("size > 1").select(_bucket()).distinct())
    compared = texts.withColumn("bucket", _bucket()).join(several, "bucket", "left_semi").groupBy(*KEY).agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    apart = checkpoint(compared.filter("lo <> hi").select(*KEY))
    n = apart.count()
    if not n:
        return None
    rows = texts.join(side(apart, n), KEY, "left_semi").groupBy(*KEY, "text").agg(F.min(_least(F.col("id"))).alias("least"), F.count(F.lit(1)).alias("size"))
    return checkpoint(rows.select(*KEY, "text", F.col("least.id").alias("keep"), "size"))


def _merged(docs: DataFrame, id_col: str, text_col: str, runs: int, digest: Callable, check: Callable) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(texts, rows, merged, split): texts with their KEY, the same without the text, and the two tables of groups."""
    docs, i, t = plain(docs, id_col, text_col)
    texts = docs.select(F.col(i).alias("id"), normalised(F.col(t)).alias("text"))
    texts = texts.select("id", "text", *_keys(F.col("text"), digest, check))
    rows = checkpoint(texts.drop("text"))
    merged = checkpoint(merge_runs(rows, runs))
    split = verified(texts, merged)
    if split is not None:
        merged = merged.join(split.select(*KEY).distinct(), KEY, "left_anti")
    return texts, rows, merged, split


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 16, digest: Callable = sha256, check: Callable = second) -> DataFrame:
    """A row per input row: id, keep_id, group_size, kept, text_sha256 (what ``digest`` gives)."""
    texts, rows, merged, split = _merged(docs, id_col, text_col, runs, digest, check)
    columns = [F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col(KEY[0]).alias("text_sha256")]
    out = rows.join(merged, KEY).select(*columns)
    return out if split is None else out.unionByName(texts.join(split, [*KEY, "text"]).select(*columns))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 16, digest: Callable = sha256, check: Callable = second) -> DataFrame:
    """The rows that stay, with the columns of ``docs``.

    Texts are dealt by id and digest together, so the copies of one text spread over all tasks.
    """
    _, _, merged, split = _merged(docs, id_col, text_col, runs, digest, check)
    rows, i, t = plain(docs, id_col, text_col)
    back = rows.columns
    marked = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("mark")
    own = rows.withColumn("text", normalised(F.col(t)))
    own = own.select(*back, "text", *_keys(F.col("text"), digest, check), marked(i))
    out = own.drop("text").join(merged.select(*KEY, marked("keep")), [*KEY, "mark"], "left_semi").dropDuplicates([*KEY, "mark"]).select(*back)
    if split is not None:
        rest = own.join(split.select(*KEY, "text", marked("keep")), [*KEY, "text", "mark"], "left_semi").dropDuplicates([*KEY, "text", "mark"]).select(*back)
        out = out.unionByName(rest)
    return out.toDF(*docs.columns)


ORACLE = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from d join g using (text_sha256)
"""
