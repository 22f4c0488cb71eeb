"""The graph as two DataFrames, nodes and edges, with the store's invariants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.schema import EDGE_COLUMNS, EDGES, GRAPH_JSON, NODE_COLUMNS, NODE_KINDS, NODES


def first_nodes(nodes: DataFrame, order: str = "seq") -> DataFrame:
    """One row per id: the first by ``order`` wins whole, attributes are never merged.

    A partial aggregate, so a much repeated id costs one row per task.
    """
    rest = [c for c in NODE_COLUMNS if c != "id"]
    keep = [*rest, order] if order in nodes.columns else rest
    by = F.struct(order, *rest) if order in nodes.columns else F.struct(*rest)
    best = nodes.groupBy("id").agg(F.min_by(F.struct(*keep), by).alias("n"))
    return best.select("id", *[F.col(f"n.{c}").alias(c) for c in keep])


def valid_edges(edges: DataFrame, nodes: DataFrame, literal_order: bool = False) -> DataFrame:
    """Distinct edges whose two ends are nodes.

    ``literal_order``: an end must come before the edge (both sides carry ``seq``), as in a store that is filled row by row.
    """
    if not literal_order:
        ids = nodes.select("id")
        kept = edges.select(*EDGE_COLUMNS).distinct()
        return kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*EDGE_COLUMNS)
    born = nodes.select("id", F.col("seq").alias("born"))
    for end in ("source", "target"):
        edges = edges.join(born.withColumnRenamed("id", end), end).filter(F.col("born") < F.col("seq")).drop("born")
    return edges.groupBy(*EDGE_COLUMNS).agg(F.min("seq").alias("seq"))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_frames(cls, nodes: DataFrame, edges: DataFrame, literal_order: bool = False) -> Graph:
        first = first_nodes(nodes)
        return cls(first, valid_edges(edges, first, literal_order))

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    # ---- store operators ----

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """Nodes whose ids are new are added; present ids keep their rows."""
        new = first_nodes(nodes).select(*NODE_COLUMNS).join(self.nodes.select("id"), "id", "left_anti")
        return Graph(self.nodes.select(*NODE_COLUMNS).unionByName(new.select(*NODE_COLUMNS)), self.edges)

    def add_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, valid_edges(self.edges.select(*EDGE_COLUMNS).unionByName(edges.select(*EDGE_COLUMNS)), self.nodes))

    def get_node(self, id_: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == id_).select(*NODE_COLUMNS).limit(1)

    def has_node(self, id_: str) -> bool:
        return not self.get_node(id_).isEmpty()

    def edges_with_endpoints(self) -> DataFrame:
        """Every edge with the rows of both ends, prefixed source_ and target_."""
        out = self.edges.select(*EDGE_COLUMNS)
        for end in ("source", "target"):
            side = self.nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in NODE_COLUMNS if c != "id"])
            out = out.join(side, end)
        return out

    def stats(self) -> DataFrame:
        """One row of ten counters, from one pass over each table."""
        count = lambda c, name: F.count_if(c).alias(name)
        n = self.nodes.agg(F.count(F.lit(1)).alias("node_count"), *[count(F.col("kind") == k, f"{k}_count") for k in NODE_KINDS], count(F.col("is_external"), "external_count"))
        return n.crossJoin(F.broadcast(self.edges.agg(F.count(F.lit(1)).alias("edge_count"))))  # one row each

    def induced(self, ids: DataFrame) -> Graph:
        """The sub-graph on a table of ids."""
        ids = ids.select("id").distinct()
        nodes = self.nodes.join(ids, "id", "left_semi")
        edges = self.edges
        for end in ("source", "target"):
            edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
        return Graph(nodes, edges.select(*EDGE_COLUMNS))

    # ---- interchange ----

    def to_serializable(self) -> DataFrame:
        """One nested row {stats, nodes, edges}, for graphs of a size that one document can hold."""
        stats = self.stats()
        pairs = [x for c in stats.columns for x in (F.lit(c), F.col(c))]
        one = stats.select(F.create_map(*pairs).alias("stats"))
        n = self.nodes.agg(F.sort_array(F.collect_list(F.struct(*NODE_COLUMNS))).alias("nodes"))
        e = self.edges.agg(F.sort_array(F.collect_list(F.struct(*EDGE_COLUMNS))).alias("edges"))
        return one.crossJoin(n).crossJoin(e)

    @classmethod
    def from_serializable(cls, docs: DataFrame) -> Graph:
        """The inverse; counters are counted anew, invariants are enforced."""
        nodes = docs.select(F.posexplode("nodes").alias("seq", "n")).select("n.*", F.col("seq").cast("long").alias("seq"))
        edges = docs.select(F.explode("edges").alias("e")).select("e.*")
        return cls.from_frames(nodes, edges)

    @classmethod
    def read_json(cls, spark: SparkSession, path: str) -> Graph:
        return cls.from_serializable(spark.read.schema(GRAPH_JSON).option("multiLine", True).json(path))
