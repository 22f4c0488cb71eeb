"""Mixing of sources to target weights, with DataFrame functions only.

1. *Blocks.* The words (tokens) of a source are laid end to end, documents in a pseudorandom order, and cut into blocks of
   ``block`` words; only a source's last block may be shorter. Where a document starts is a running sum over range
   partitions (sums of partitions first, then inside each), so no source is gathered, however much of the corpus it holds.
2. *Targets.* Sources share ``share`` of all words by weight; what exceeds a source's cap is reshared until none is above
   (found at once: a source is capped if, with all sources of a smaller cap per weight capped too, the rest would still reach it).
   A target of t words needs whole passes over the source and a rest, hence a known number of slots.
3. *Multinomial counts.* Slots are dealt to output shards; each draws its source with the probability of its slots, so the
   counts of a shard are multinomial. A source drawn more often than it has slots hands its last draws over to those drawn
   too rarely: a few (the square root of all), so that every source ends on its target to the word (the last slot is cut).
4. *Permutations.* The j-th slot of a source takes, in pass j / blocks, block permutation(j mod blocks). The permutation is a
   swap-or-not shuffle: a keyed bijection of any number range, computed for one index at a time; each pass has its own, and a
   short last block comes last. So a block is used once a pass, and no document more often than there are passes.
5. Slots meet blocks by (source, index) in one join, spread evenly over both.

Defined cases: a null or empty text has no words, takes part in nothing and is reported with 0; null sources are one source,
the last; null ids are ids; rows that repeat id and text are documents of their own; equal documents of different ids too;
one very long text is laid over many blocks; a source without words has target 0; no documents give no rows; other columns
may have any names. Reruns give the same rows, however the table is split.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spandrel.operators.components import SMALL

from .common import plain, written

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of an output shard, rounds of the shuffle, rows of a range partition, parts of a salted source.
BLOCK, SHARD, ROUNDS, ROWS, SALT = 256, 8192, 24, 50_000, 64


def running(df: DataFrame, order: list[str], values: list[str], rows: int) -> DataFrame:
    """``df`` with ``<value>_before``: the sum of the rows that come before in ``order`` (unique), by range partitions."""
    laid = written(df.repartitionByRange(max(1, -(-rows // ROWS)), *order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(*order)
    sums = laid.groupBy("__part").agg(*[F.sum(v).alias(f"__{v}") for v in values])  # a row per ROWS rows
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", *[F.coalesce(F.sum(f"__{v}").over(ahead), F.lit(0)).alias(f"__{v}") for v in values])
    sums = F.broadcast(sums) if rows <= ROWS * SMALL else sums
    before = lambda v: F.col(f"__{v}") + F.sum(v).over(within) - F.col(v)
    return laid.join(sums, "__part").withColumns({f"{v}_before": before(v) for v in values}).drop("__part", *[f"__{v}" for v in values])


def many(df: DataFrame, n: str, name: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0; no array is longer than the square root of what a long one would be."""
    df = df.filter(F.col(n) > 0).withColumn("__hi", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{n}` - 1) div 4096"))))
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(4095).cast("long"), F.col(n) - 1 - F.col("__hi") * 4096)))
    return df.withColumn("__lo", low).withColumn(name, F.col("__hi") * 4096 + F.col("__lo")).drop("__hi", "__lo")


def beside(df: DataFrame, sources: DataFrame, count: int, spread: Column) -> DataFrame:
    """``df`` with the columns of its source (by ``sid``): broadcast where the counted sources are few, else salted."""
    if count <= SMALL:
        return df.join(F.broadcast(sources), "sid")
    salted = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return df.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(salted, ["sid", "__salt"]).drop("__salt")


def shuffled(index: str, n: str, *key: Column) -> Column:
    """``index`` in [0, n) under the keyed swap-or-not shuffle."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), F.col(n)) - x, F.col(n))
        return F.when(F.xxhash64(*key, r, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.col(index), swap)


def _targets(sources: DataFrame, weights: tuple[int, ...], share: tuple[int, int], cap: int, block: int, count: int, total: int) -> DataFrame:
    """Sources (sid, source, source_size, source_size_before) with target, passes, rest, blocks, full and slots."""
    whole, (num, den) = math.lcm(*weights), share
    big = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")).cast("long")
    rows = sources.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    rows = running(rows.withColumn("per", big("most") * big(F.lit(whole) / F.col("w"))), ["per", "sid"], ["most", "w"], count)
    all_w = rows.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    reached = big(F.lit(den)) * (big(F.col("most_before") + F.col("most")) * big("w") + big("most") * big(F.lit(all_w) - F.col("w_before") - F.col("w"))) <= big(F.lit(num * total)) * big("w")
    rows = written(rows.withColumn("capped", reached))
    of = lambda column, which: F.coalesce(F.sum(F.when(which, F.col(column))), F.lit(0))
    held, open_w = rows.agg(of("most", F.col("capped")), of("w", ~F.col("capped"))).first()
    left = num * total - den * held
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise((big("w") * big(F.lit(left))).cast("double") / F.lit(float(den * open_w or 1)))
    rows = rows.withColumn("target", target).withColumn("words", F.least(F.col("most"), F.floor(F.col("target") + 0.5)))
    some = F.col("source_size") > 0
    rows = rows.withColumns({"passes": F.when(some, F.expr("words div source_size")).otherwise(0), "blocks": F.ceil(F.col("source_size") / block), "full": F.expr(f"source_size div {block}")})
    rows = rows.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    rows = rows.withColumn("slots", (F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).cast("long"))
    return rows.select("sid", "source", "source_size", "source_size_before", "target", "passes", "rest", "blocks", "full", "slots")


@dataclass
class Mixture:
    """``documents``: (doc_id, sid, source, start, size, source_size, target); ``sources``; ``slots``: (shard, sid, rank, pass, index, limit, source); ``count`` sources."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    count: int
    block: int
    seed: int

    def pieces(self) -> DataFrame:
        """(sid, index, doc_id, start, digest, from, at, length): the part of each document in each block, from its word ``from`` on, at place ``at`` of the block."""
        b = self.block
        rows = self.documents.filter("size > 0").withColumn("__first", F.expr(f"start div {b}")).withColumn("__n", F.expr(f"(start + size - 1) div {b}") - F.col("__first") + 1)
        rows = many(rows, "__n", "__k").withColumn("index", F.col("__first") + F.col("__k"))
        rows = rows.withColumn("lo", F.greatest("start", F.col("index") * b)).withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * b))
        return rows.select("sid", "index", "doc_id", "digest", "start", (F.col("lo") - F.col("start")).alias("from"), (F.col("lo") - F.col("index") * b).alias("at"), (F.col("hi") - F.col("lo")).alias("length"))

    def stream(self) -> DataFrame:
        """What the mix takes, by slot: the pieces of each slot's block up to the slot's limit; ``order`` sorts the slots of a shard."""
        met = self.slots.join(self.pieces(), ["sid", "index"]).withColumn("length", F.least("length", F.col("limit") - F.col("at")))
        order = F.xxhash64(F.lit(self.seed), "shard", "sid", "rank")
        return met.filter("length > 0").select("shard", order.alias("order"), "sid", "source", "rank", "pass", "index", "at", "doc_id", "digest", "start", "from", "length")

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
        """(shard, order, source, rank, at, doc_id, from, length, text): the words of ``stream``, joined by spaces."""
        docs, i, t, s = plain(docs, id_col, text_col, source_col)
        text = F.coalesce(F.col(t).cast("string"), F.lit(""))
        each = docs.select(F.col(i).cast("long").alias("d"), F.col(s).cast("string").alias("s"), F.sha2(text.cast("binary"), 256).alias("h"), text.alias("t"))
        each = each.groupBy("d", "s", "h").agg(F.first("t").alias("t"))  # rows that repeat id and text have the same words
        pieces = self.pieces().join(self.sources.select("sid", "source"), "sid")
        pieces = pieces.join(each, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("digest") == F.col("h")))
        words = F.slice(F.regexp_extract_all("t", F.lit(f"({WORD})")), (F.col("from") + 1).cast("int"), F.col("length").cast("int"))
        met = self.slots.drop("source").join(pieces.withColumn("words", words), ["sid", "index"]).withColumn("length", F.least("length", F.col("limit") - F.col("at"))).filter("length > 0")
        return met.select("shard", F.xxhash64(F.lit(self.seed), "shard", "sid", "rank").alias("order"), "source", "rank", "at", "doc_id", "from", "length", F.array_join(F.slice("words", F.lit(1), F.col("length").cast("int")), " ").alias("text"))


def _drawn(sources: DataFrame, count: int, slots: int, shard: int, seed: int) -> DataFrame:
    """(shard, sid, n): how often each shard draws each source."""
    spark = sources.sparkSession
    width = -(-slots // count)
    lot = sources.filter("slots > 0").select("sid", F.col("slots_before").alias("lo"), (F.col("slots_before") + F.col("slots")).alias("hi"))
    lot = lot.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))  # two cells a source on average
    draws = spark.range(0, slots, 1, max(1, -(-slots // (shard * 16)))).select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(slots)).alias("draw"))
    draws = draws.withColumn("cell", F.expr(f"draw div {width}"))
    return draws.join(F.broadcast(lot) if count <= SMALL else lot, "cell").filter("lo <= draw and draw < hi").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2,
    block: int = BLOCK, shard: int = SHARD, seed: int = 1,
) -> Mixture:
    """A mixture of ``share`` of all words; weights go to the sources in the order of their names, repeating."""
    spark = docs.sparkSession
    docs, i, t, s = plain(docs, id_col, text_col, source_col)
    text = F.coalesce(F.col(t).cast("string"), F.lit(""))
    base = docs.select(F.col(i).cast("long").alias("doc_id"), F.col(s).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("digest"))
    base = written(base.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("copies")).withColumn("all", F.col("size") * F.col("copies")))
    rows = base.count()
    totals = base.groupBy("source").agg(F.sum("all").alias("source_size")).withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    totals = written(totals)
    count, total = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    named = running(totals, ["last", "source"], ["one", "source_size"], count).select(F.col("one_before").alias("sid"), "source", "source_size", "source_size_before")
    sources = written(running(_targets(named, weights, share, cap, block, count, total), ["sid"], ["slots"], count))
    n_slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    own = base.withColumns({"last": F.col("source").isNull(), "h": F.xxhash64(F.lit(seed), "doc_id", "digest")})
    placed = many(running(own, ["last", "source", "h", "doc_id", "digest"], ["all"], rows), "copies", "copy").withColumn("place", F.col("all_before") + F.col("copy") * F.col("size"))
    # A source's words lie in one interval; its number comes from its name.
    ids = sources.select("sid", F.col("source").alias("name"), "source_size", "source_size_before", "target")
    placed = placed.join(F.broadcast(ids), F.col("source").eqNullSafe(F.col("name"))) if count <= SMALL else _by_name(placed, ids)
    documents = written(placed.select("doc_id", "digest", "sid", "source", (F.col("place") - F.col("source_size_before")).alias("start"), "size", "source_size", "target"))

    drawn = written(_drawn(sources, count, n_slots, shard, seed)) if n_slots else spark.range(0).select(*[F.col("id").alias(c) for c in ("shard", "sid", "n")])
    n_drawn = drawn.count()
    got = drawn.groupBy("sid").agg(F.sum("n").alias("drawn"))
    need = sources.join(got, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).withColumn("short", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)))
    need = written(running(need, ["sid"], ["drawn", "short"], count))
    ranked = running(drawn, ["sid", "shard"], ["n"], n_drawn)
    ranked = beside(ranked, need.select("sid", "slots", "drawn_before"), count, F.col("shard")).withColumn("first", F.col("n_before") - F.col("drawn_before"))
    ranked = ranked.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("first")))).withColumn("over", F.col("n") - F.col("kept"))
    ranked = written(running(ranked.select("shard", "sid", "first", "kept", "over"), ["sid", "shard"], ["over"], n_drawn))
    dealt = ranked.repartition(max(1, -(-n_slots // (shard * 16))), "shard")  # a row becomes up to ``shard`` slots
    kept = many(dealt, "kept", "k").select("shard", "sid", (F.col("first") + F.col("k")).alias("rank"))
    handed = many(ranked, "over", "k").select("shard", (F.col("over_before") + F.col("k")).alias("p"))
    taken = many(need, "short", "k").select("sid", (F.col("drawn") + F.col("k")).alias("rank"), (F.col("short_before") + F.col("k")).alias("p"))
    slots = kept.unionByName(handed.join(taken, "p").select("shard", "sid", "rank"))
    slots = beside(slots, sources.select("sid", "source", "passes", "rest", "blocks", "full"), count, F.col("rank"))
    slots = slots.withColumn("pass", F.expr("rank div blocks")).withColumn("i", F.col("rank") - F.col("pass") * F.col("blocks"))
    index = F.when(F.col("i") == F.col("full"), F.col("i")).otherwise(shuffled("i", "full", F.lit(seed), F.col("sid"), F.col("pass")))
    limit = F.when(F.col("pass") == F.col("passes"), F.least(F.lit(block), F.col("rest") - F.col("i") * block)).otherwise(block)
    slots = slots.select("shard", "sid", "source", "rank", "pass", index.alias("index"), limit.cast("long").alias("limit"))
    return Mixture(documents, sources, slots, count, block, seed)


def _by_name(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents with their source's columns where sources are too many to broadcast: salted, so that a source's documents go to many tasks."""
    salted = ids.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return placed.withColumn("__own", F.pmod("h", F.lit(SALT)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("name")) & (F.col("__own") == F.col("__salt")))


def report(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row per document."""
    m = mix(docs, **how)
    took = m.stream().groupBy("sid", "start").agg(F.sum("length").alias("taken"))  # a start is one document's: those without words take no part
    some, none = m.documents.filter("size > 0").join(took, ["sid", "start"], "left"), m.documents.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
    return reduce(DataFrame.unionByName, (d.select(*columns) for d in (some, none)))
