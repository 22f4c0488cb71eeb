"""A graph kept for point look-ups and repeated joins: nodes bucketed by id, edges once by source and once by target.

Buckets are Spark's own (``bucketBy``), so a condition on an id reads one bucket of each table and, since buckets are sorted,
few row groups of it; degrees and the rows of both ends come without a shuffle. Either edge table carries the row of the other
end. A node with more than ``HUB_ROWS`` edges on one side would make one bucket too large: edges of such hubs lie in a table
apart, ordered by range, so that one hub spreads over many files. Of hubs there are at most ``SMALL``, which is what is broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators.components import SMALL, checkpoint_folder, side
from spandrel.operators.graph import Graph
from spandrel.operators.tables import written
from spandrel.schema import EDGE_COLUMNS, NODE_COLUMNS

#: Rows of a bucket on average, and buckets at most; edges on one side that make a node a hub; ids that are looked up by value.
BUCKET_ROWS, MOST_BUCKETS, HUB_ROWS, FEW = 500_000, 8192, 1_000_000, 1000
#: Slots for each hub there can be; nodes of a bucket that a join holds in memory.
SLOTS, HELD = 8, 50_000
#: Table, the end by which it is bucketed, the end whose row it carries.
SIDES = (("outgoing", "source", "target"), ("incoming", "target", "source"))
KEYS = {"nodes": "id", "outgoing": "source", "incoming": "target"}


def _row_of(nodes: DataFrame, end: str) -> DataFrame:
    return nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in NODE_COLUMNS if c != "id"])


def _in_bucket(nodes: DataFrame, per_bucket: int) -> DataFrame:
    """Nodes as the side of a join within buckets: held in memory where they are few, so that edges need not be sorted."""
    return nodes.hint("shuffle_hash" if per_bucket <= HELD else "merge")


def _beside(edges: DataFrame, nodes: DataFrame, end: str, per_bucket: int) -> DataFrame:
    """Edges that lie in buckets by ``end``, with the row of that end."""
    return edges.join(_in_bucket(_row_of(nodes, end), per_bucket), end)


def _beside_hubs(edges: DataFrame, nodes: DataFrame, end: str, few: DataFrame) -> DataFrame:
    """Edges of hubs with the hub's row; ``few`` is what is broadcast."""
    return edges.join(F.broadcast(_row_of(nodes, end).join(few, end, "left_semi")), end)


def _hubs(edges: DataFrame, n: int, most: int) -> dict[str, tuple[DataFrame | None, int]]:
    """By end: the nodes with more than ``most`` of ``n`` edges there, to be broadcast, and how many edges these have.

    Ends are counted in slots by their hashes first, which is a small table a task; only those of a slot with more than ``most``
    edges can be hubs, and are counted one by one.
    """
    slot = lambda end: F.pmod(F.xxhash64(end), F.lit(SLOTS * (n // most + 1)))
    sides = [F.struct(F.lit(end).alias("end"), slot(end).alias("slot")) for _, end, _ in SIDES]
    full = written(edges.select(F.explode(F.array(*sides)).alias("s")).groupBy("s.end", "s.slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))
    out = {}
    for _, end, _ in SIDES:
        slots = full.filter(F.col("end") == end).select("slot")  # at most n / most
        out[end] = (None, 0)
        if not slots.isEmpty():
            hubs = written(edges.select(end, slot(end).alias("slot")).join(F.broadcast(slots), "slot", "left_semi").groupBy(end).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))
            out[end] = (F.broadcast(hubs.select(end)), hubs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])  # more than n / SMALL edges each
    return out


class Layout:
    """A stored graph in ``folder``; its bucketed tables are registered in the session under names of their own."""

    def __init__(self, spark: SparkSession, folder: str):
        about = spark.read.parquet(f"{folder}/about").first()
        self.spark, self.folder, self.buckets = spark, folder, about["buckets"]
        rows = about.asDict().get("node_rows")  # older layouts do not say
        self.per_bucket = HELD + 1 if rows is None else rows // self.buckets
        self._name = f"layout_{uuid.uuid4().hex}"
        for table, key in KEYS.items():
            spark.sql(f"create table {self._name}_{table} ({about[table]}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{folder}/{table}'")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Layout:
        """A layout that was written before, by this or another session."""
        return cls(spark, folder)

    @classmethod
    def write(cls, graph: Graph, folder: str | None = None, buckets: int | None = None, hub_rows: int = HUB_ROWS) -> Layout:
        """``graph`` as a new layout; edges without a node at either end are left out.

        Nodes are bucketed first and do not move again. Edges come to them by source, once, and with the source's row by target into
        ``incoming``; from there, with the row of the target, by source into ``outgoing``.
        """
        spark = graph.nodes.sparkSession
        folder = folder or f"{checkpoint_folder(spark)}/layout-{uuid.uuid4().hex}"
        nodes, edges = written(graph.nodes.select(*NODE_COLUMNS)), written(graph.edges.select(*EDGE_COLUMNS))
        n, many = edges.count(), nodes.count()
        buckets = buckets or max(1, min(max(n, many) // BUCKET_ROWS, MOST_BUCKETS))
        hubs = _hubs(edges, n, max(hub_rows, n // SMALL))
        own, columns = f"layout_new_{uuid.uuid4().hex}", {}

        def bucketed(table: str, rows: DataFrame) -> None:
            rows.write.format("parquet").option("path", f"{folder}/{table}").bucketBy(buckets, KEYS[table]).sortBy(KEYS[table]).saveAsTable(f"{own}_{table}")
            columns[table] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

        bucketed("nodes", nodes.repartition(buckets, "id"))
        kept = spark.table(f"{own}_nodes")
        single = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        rest = lambda rows, end: rows.join(hubs[end][0], end, "left_anti") if hubs[end][1] else rows
        # A semi-join would be moved below the exchange, which takes one more of its own.
        known = lambda rows, end: rows.join(_in_bucket(kept.select(F.col("id").alias(end)).distinct(), many // buckets), end)
        for table, end, other in reversed(SIDES):
            few, total = hubs[other]
            if table == "outgoing" and single:
                near, hot = spark.table(f"{own}_incoming").select(*EDGE_COLUMNS), spark.read.parquet(f"{folder}/incoming_hubs").select(*EDGE_COLUMNS)
            else:
                near, hot = rest(edges, other).repartition(buckets, other), edges.join(few, other, "left_semi") if total else None
            rows = _beside(near, kept, other, many // buckets)
            rows = rows.unionByName(_beside_hubs(hot, kept, other, few)) if total else rows
            few, total = hubs[end]
            bucketed(table, known(rest(rows, end).repartition(buckets, end), end))
            hot = known(rows.join(few, end, "left_semi"), end).repartitionByRange(total // BUCKET_ROWS + 1, end, other).sortWithinPartitions(end, other) if total else spark.table(f"{own}_{table}").limit(0)
            hot.write.parquet(f"{folder}/{table}_hubs")
        for table in KEYS:
            spark.sql(f"drop table {own}_{table}")  # the files stay
        about = {"buckets": F.lit(buckets), "node_rows": F.lit(many).cast("long")} | {t: F.lit(c) for t, c in columns.items()}
        spark.range(0, 1, 1, 1).select(*[c.alias(name) for name, c in about.items()]).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    @classmethod
    def write(cls, graph: Graph, folder: str | None = None, buckets: int | None = None, hub_rows: int = HUB_ROWS) -> Layout:
        """``graph`` as a new layout; edges without a node at either end are left out.

        Nodes are bucketed first and do not move again. Edges come to them by source, once, and with the source's row by target into
        ``incoming``; from there, with the row of the target, by source into ``outgoing``.
        """
        spark = graph.nodes.sparkSession
        folder = folder or f"{checkpoint_folder(spark)}/layout-{uuid.uuid4().hex}"
        nodes, edges = written(graph.nodes.select(*NODE_COLUMNS)), written(graph.edges.select(*EDGE_COLUMNS))
        n, many = edges.count(), nodes.count()
        buckets = buckets or max(1, min(max(n, many) // BUCKET_ROWS, MOST_BUCKETS))
        hubs = _hubs(edges, n, max(hub_rows, n // SMALL))
        own, columns = f"layout_new_{uuid.uuid4().hex}", {}

        def bucketed(table: str, rows: DataFrame) -> None:
            rows.write.format("parquet").option("path", f"{folder}/{table}").bucketBy(buckets, KEYS[table]).sortBy(KEYS[table]).saveAsTable(f"{own}_{table}")
            columns[table] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

        bucketed("nodes", nodes.repartition(buckets, "id"))
        kept = spark.table(f"{own}_nodes")
        single = kept.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        rest = lambda rows, end: rows.join(hubs[end][0], end, "left_anti") if hubs[end][1] else rows
        # A semi-join would be moved below the exchange, which takes one more of its own.
        known = lambda rows, end: rows.join(_in_bucket(kept.select(F.col("id").alias(end)).distinct(), many // buckets), end)
        for table, end, other in reversed(SIDES):
            few, total = hubs[other]
            if table == "outgoing" and single:
                near, hot = spark.table(f"{own}_incoming").select(*EDGE_COLUMNS), spark.read.parquet(f"{folder}/incoming_hubs").select(*EDGE_COLUMNS)
            else:
                near, hot = rest(edges, other).repartition(buckets, other), edges.join(few, other, "left_semi") if total else None
            rows = _beside(near, kept, other, many // buckets)
            rows = rows.unionByName(_beside_hubs(hot, kept, other, few)) if total else rows
            few, total = hubs[end]
            bucketed(table, known(rest(rows, end).repartition(buckets, end), end))
            hot = known(rows.join(few, end, "left_semi"), end).repartitionByRange(total // BUCKET_ROWS + 1, end, other).sortWithinPartitions(end, other) if total else spark.table(f"{own}_{table}").limit(0)
            hot.write.parquet(f"{folder}/{table}_hubs")
        for table in KEYS:
            spark.sql(f"drop table {own}_{table}")  # the files stay
        spark.createDataFrame([(buckets, many, *[columns[t] for t in KEYS])], ", ".join(["buckets int", "node_rows long", *[f"{t} string" for t in KEYS]])).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    def close(self) -> None:
        """The names go from the session, the files stay."""
        for table in KEYS:
            self.spark.sql(f"drop table if exists {self._name}_{table}")

    # ---- tables ----

    def nodes(self) -> DataFrame:
        return self.spark.table(f"{self._name}_nodes")

    def _parts(self, table: str) -> tuple[DataFrame, DataFrame]:
        """(bucketed, hubs) of an edge table, with equal columns."""
        rows = self.spark.table(f"{self._name}_{table}")
        return rows, self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{table}_hubs").select(*rows.columns)

    def graph(self) -> Graph:
        a, b = self._parts("outgoing")
        return Graph(self.nodes(), a.select(*EDGE_COLUMNS).unionByName(b.select(*EDGE_COLUMNS)))

    # ---- look-ups ----

    def node(self, id_: str) -> DataFrame:
        return self.nodes().filter(F.col("id") == id_).select(*NODE_COLUMNS)

    def edges_at(self, table: str, id_: str) -> DataFrame:
        """The edges out of or into a node, with the row of the other end."""
        _, end, _ = next(s for s in SIDES if s[0] == table)
        a, b = (p.filter(F.col(end) == id_) for p in self._parts(table))
        return a.unionByName(b)

    def detail(self, id_: str) -> dict[str, DataFrame]:
        """The row, and the edges in and out with the rows of both ends, as ``views.node_detail`` gives them."""
        out = {"node": self.node(id_)}
        for table, end, _ in SIDES:
            out[table] = self.edges_at(table, id_).join(F.broadcast(_row_of(self.node(id_), end)), end)  # one row
        return out

    def neighbours(self, front: DataFrame, rows: int) -> DataFrame:
        """(id) beside the ids of ``front``, which are ``rows``: few are looked up by value in their buckets, more are joined."""
        ids = [r["id"] for r in front.select("id").collect()] if rows <= FEW else None
        found = []
        for table, end, other in SIDES:
            for part in self._parts(table):
                near = part.filter(F.col(end).isin(ids)) if ids is not None else part.join(side(front.select(F.col("id").alias(end)), rows), end, "left_semi")
                found.append(near.select(F.col(other).alias("id")))
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out.distinct()

    def within_hops(self, start: str, depth: int) -> DataFrame:
        """(id, distance) of the nodes within ``depth`` undirected hops, as ``analytics.within_hops``, from the buckets of each hop's new nodes."""
        seen = front = written(self.node(start).select("id", F.lit(0).cast("long").alias("distance")))
        rows = total = front.count()
        for hop in range(1, depth + 1):
            if not rows:
                break
            near = self.neighbours(front, rows).join(side(seen.select("id"), total), "id", "left_anti")
            front = written(near.select("id", F.lit(hop).cast("long").alias("distance")))
            rows = front.count()
            total, seen = total + rows, seen.unionByName(front)
        return seen

    # ---- whole tables ----

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree), as ``analytics.degrees``: counted within buckets, without a shuffle but for the counts of hubs."""
        out = self.nodes().select("id")
        zero = F.lit(0)
        for table, end, _ in SIDES:
            bucketed, hubs = (p.groupBy(end).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(end, "id") for p in self._parts(table))
            out = out.join(bucketed.withColumnRenamed("n", f"{table}_n"), "id", "left").join(F.broadcast(hubs.withColumnRenamed("n", f"{table}_h")), "id", "left")
        count = lambda t: (F.coalesce(f"{t}_n", zero) + F.coalesce(f"{t}_h", zero)).cast("long")
        return out.select("id", count("incoming").alias("in_degree"), count("outgoing").alias("out_degree"))

    def edges_with_endpoints(self) -> DataFrame:
        """Every edge with the rows of both ends, as ``Graph.edges_with_endpoints``: one joins within buckets, the other lies beside the edge."""
        bucketed, hubs = self._parts("incoming")
        few = F.broadcast(hubs.select("target").distinct())
        return _beside(bucketed, self.nodes(), "target", self.per_bucket).unionByName(_beside_hubs(hubs, self.nodes(), "target", few))
