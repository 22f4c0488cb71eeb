"""Graph analytics as DataFrame programs: degrees, coupling, inheritance depth, cycles, components, focus, diff."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.operators import contraction
from spandrel.operators.components import checkpoint, connected_roots, fitted, side
from spandrel.operators.graph import Graph
from spandrel.schema import EDGE_COLUMNS

#: Rows that a task groups where they hardly repeat.
GROUP_ROWS = 500_000

# ---- degrees, coupling, orphans --------------------------------------------------------------------------------------


def degrees(graph: Graph) -> DataFrame:
    """(id, in_degree, out_degree): edges, not neighbours; a self-loop counts once on each side.

    Both ends go through one aggregate, so that edges are shuffled once.
    """
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    counted = ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return graph.nodes.select("id").join(counted, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def coupling(graph: Graph) -> DataFrame:
    """Degrees with coupling_score = (in + out) / (2 (N - 1)), or / 1 for a single node. May exceed 1 with parallel edges."""
    total = F.broadcast(graph.nodes.agg(F.count(F.lit(1)).alias("n")))  # one row
    most = F.when(F.col("n") > 1, 2 * (F.col("n") - 1)).otherwise(1)
    return degrees(graph).crossJoin(total).select("id", "in_degree", "out_degree", ((F.col("in_degree") + F.col("out_degree")).cast("double") / most.cast("double")).alias("coupling_score"))


def top_coupled(graph: Graph, k: int = 10) -> DataFrame:
    return coupling(graph).orderBy(F.desc("coupling_score"), "id").limit(k)


def max_coupled(graph: Graph) -> DataFrame:
    """The most coupled node; ties go to the smallest id."""
    return top_coupled(graph, 1).select("id", "coupling_score")


def orphans(graph: Graph) -> DataFrame:
    """Nodes without any edge."""
    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return graph.nodes.select("id").join(ends, "id", "left_anti")


# ---- depth of inheritance --------------------------------------------------------------------------------------------


def inheritance_depth(graph: Graph) -> DataFrame:
    """(id, depth_of_inheritance): 0 without parents, else 1 + the deepest parent; external parents count.

    Rounds grow with the logarithm of the depth, with one or several parents alike. Inside a cycle (a strongly connected
    component, or a node that inherits from itself) a depth-first walk in the order of ids counts a parent that is on its own path as 0.
    """
    up = graph.edges.filter("kind = 'inherits'").select(F.col("source").alias("child"), F.col("target").alias("parent"))
    depth = contraction.merged(contraction.guarded_depth(up))
    return graph.nodes.select("id").join(depth, "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("depth_of_inheritance"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---- components and cycles -------------------------------------------------------------------------------------------


def components(graph: Graph) -> DataFrame:
    """(id, component_id): undirected, over all kinds; named by the smallest id; single nodes included."""
    roots = checkpoint(connected_roots(graph.edges, "source", "target"))
    names = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = roots.join(names, "root").select(F.col("node").alias("id"), "component_id")
    return graph.nodes.select("id").join(named, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))


def component_sizes(graph: Graph) -> DataFrame:
    return components(graph).groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))


def cycles(graph: Graph) -> DataFrame:
    """(id, cycle_id): strongly connected components of more than one node over all kinds, named by the smallest id."""
    return contraction.cycles(graph.edges)


def cycle_nodes(graph: Graph) -> DataFrame:
    return cycles(graph).select("id").distinct()


# ---- focus, diff -----------------------------------------------------------------------------------------------------


def within_hops(graph: Graph, start: str, depth: int) -> DataFrame:
    """(id, distance) of the nodes within ``depth`` undirected hops; empty if the id is unknown.

    Each hop starts from the last one's new nodes only, and is cut off by a checkpoint.
    """
    both = graph.edges.select("source", "target").unionByName(graph.edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    both = checkpoint(both) if depth > 1 else both
    seen = front = checkpoint(graph.nodes.filter(F.col("id") == start).select("id", F.lit(0).cast("long").alias("distance")).distinct())
    rows = 1
    for hop in range(1, depth + 1):
        near = side(front.select(F.col("id").alias("source")), rows)
        step = both.join(near, "source", "left_semi").select(F.col("target").alias("id")).distinct()
        front = checkpoint(step.join(side(seen.select("id"), seen.count()), "id", "left_anti").select("id", F.lit(hop).cast("long").alias("distance")))
        if not (rows := front.count()):
            break
        seen = checkpoint(fitted(seen.unionByName(front), seen.count() + rows))
    return seen


def focus(graph: Graph, start: str, depth: int = 2) -> Graph:
    """The sub-graph induced by the nodes within ``depth`` hops."""
    return graph.induced(within_hops(graph, start, depth))


def diff(old: Graph, new: Graph) -> dict[str, DataFrame]:
    """Added and removed nodes (by id) and edges (by source, target and kind); changed attributes do not show."""
    out = {}
    for name, a, b, key in (("nodes", old.nodes.select("id"), new.nodes.select("id"), ["id"]), ("edges", old.edges.select(*EDGE_COLUMNS), new.edges.select(*EDGE_COLUMNS), EDGE_COLUMNS)):
        out[f"added_{name}"] = b.join(a, key, "left_anti").distinct()
        out[f"removed_{name}"] = a.join(b, key, "left_anti").distinct()
    return out


def diff_summary(old: Graph, new: Graph) -> DataFrame:
    """(change, n) of the four lists. Either table of either graph is read once: a key says by one bit each on which side it is.

    Edges hardly repeat, so they are dealt by their counted rows before they are grouped: ids compress so well that one file
    holds more edges than a task's partial aggregate should.
    """
    rows = []
    parts = max(1, (old.edges.count() + new.edges.count()) // GROUP_ROWS)
    for name, a, b, key in (("nodes", old.nodes, new.nodes, ["id"]), ("edges", old.edges, new.edges, EDGE_COLUMNS)):
        both = a.select(*key, F.lit(1).alias("on")).unionByName(b.select(*key, F.lit(2).alias("on")))
        both = (both.repartition(parts, *key) if name == "edges" else both).groupBy(*key).agg(F.bit_or("on").alias("on"))
        counts = both.agg(F.count_if(F.col("on") == 2).alias("added"), F.count_if(F.col("on") == 1).alias("removed"))
        rows.append(counts.select(F.explode(F.array(*[F.struct(F.lit(f"{c}_{name}").alias("change"), F.col(c).alias("n")) for c in ("added", "removed")])).alias("r")).select("r.*"))
    return _union(rows)


def diff_view(old: Graph, new: Graph) -> DataFrame:
    """All nodes of both graphs with ``change``: added, removed or kept."""
    a, b = old.nodes.select("id", F.lit(True).alias("was")), new.nodes.select("id", F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("kept")
    return a.join(b, "id", "full").select("id", change.alias("change"))


# ---- the bundle ------------------------------------------------------------------------------------------------------


@dataclass
class Analysis:
    """All results of a graph, each worked out on first use."""

    graph: Graph

    @cached_property
    def metrics(self) -> DataFrame:
        score = coupling(self.graph).withColumn("coupling_score", F.col("coupling_score").cast("float"))
        return score.join(inheritance_depth(self.graph), "id")

    @cached_property
    def cycles(self) -> DataFrame:
        return checkpoint(cycles(self.graph))

    @cached_property
    def components(self) -> DataFrame:
        return checkpoint(components(self.graph))

    @cached_property
    def orphans(self) -> DataFrame:
        return orphans(self.graph)

    def summary(self) -> DataFrame:
        """The counters of the graph and the numbers of cycles, components and orphans, in one row."""
        one = lambda df, c, name: F.broadcast(df.agg(F.count_distinct(c).alias(name)))
        out = self.graph.stats()
        for df, c, name in ((self.cycles, "cycle_id", "cycle_count"), (self.components, "component_id", "component_count"), (self.orphans, "id", "orphan_count")):
            out = out.crossJoin(one(df, c, name))
        return out


def analyze(graph: Graph) -> Analysis:
    return Analysis(graph)
