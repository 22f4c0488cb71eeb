"""Connected components of an undirected edge table by randomised contraction.

In each round every node points at its neighbour of smallest pseudo-random rank (or itself), and edges are redrawn
between the nodes pointed at. Stars collapse in two rounds and paths shrink by a constant factor, so rounds grow with the
logarithm of the graph, never with its diameter. Nothing but a row count reaches the driver; each round is cut off by a
reliable checkpoint. A node with a very large degree only meets partial aggregates and joins that AQE can split.

The row count of a level sizes what follows: a level runs in as many tasks as its rows need, and a table of ``SMALL`` rows
at most is broadcast instead of shuffled.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of this many rows of two ids at most may be broadcast.
SMALL = 50_000
ROWS_PER_TASK = 100_000
#: Edges a node, of this many edges at least, from which a part of them is contracted first.
DENSE, LARGE = 4, 100_000


def checkpoint_folder(spark) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one beside the warehouse, or for a local master a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = sc.getConf().get("spark.checkpoint.dir")
        if not own:
            in_process = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            own = tempfile.mkdtemp(prefix="spandrel-") if in_process else f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints"
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder all executors share.

    A checkpoint hands on its plan's constraints and its estimated size, and an estimate for a join is a product: in a loop
    of joins its digits multiply with every round, until the driver does nothing else. So both are left behind.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    conf, name = spark.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        kept = df.checkpoint(eager=True)
    finally:
        conf.set(name, before)
    jvm, own, plan = spark._jvm, spark._jsparkSession, kept._jdf.queryExecution().analyzed()
    none = jvm.scala.Option.empty()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), own, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, bare), spark)


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many tasks as ``rows`` rows need."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as one side of a join: broadcast where its counted rows are few, and only there.

    Spark would go by the size of the files, and ids compress so well that a million of them look small.
    """
    return F.broadcast(df) if rows <= SMALL else df.hint("merge")


def connected_roots(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node that has an edge to another node; equal roots mark one component.

    Of a dense graph about two edges a node are contracted first. Then every edge is looked at by the roots of its ends: those
    within one component of that forest need no more work, all others are contracted in their turn.
    """
    from spandrel.operators.tables import written

    one = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter(F.col("u") != F.col("v")))
    rows = one.count()
    nodes = one.select(F.explode(F.array("u", "v")).alias("id")).agg(F.approx_count_distinct("id")).first()[0] if rows > LARGE else rows
    if rows <= DENSE * nodes:
        return _contracted(one)
    roots = _contracted(one.filter(F.pmod(F.xxhash64("u", "v"), F.lit(rows // (2 * nodes))) == 0))
    known = roots.count()
    apart = one
    for end in "uv":
        apart = apart.join(side(roots.select(F.col("node").alias(end), "root"), known), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    apart = written(apart.filter("u <> v").distinct())
    if apart.isEmpty():
        return roots
    more = checkpoint(_contracted(apart))
    some = more.count()
    moved = roots.join(side(more.select(F.col("node").alias("root"), F.col("root").alias("higher")), some), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return checkpoint(moved.unionByName(more.join(side(roots.select("node"), known), "node", "left_anti")))


def _contracted(one: DataFrame) -> DataFrame:
    """``connected_roots`` of stored edges (u, v) without loops, by rounds of contraction."""
    # Both directions are made as they are read; edges that are there twice go with the first round.
    level = one.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    steps: list[tuple[DataFrame, int]] = []
    while n := level.count():
        rank = lambda c, i=len(steps): F.xxhash64(F.col(c), F.lit(i))
        best = level.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), F.col("v").alias("v"))).alias("b"))
        parent = checkpoint(fitted(best.select("u", F.when(F.col("b.r") < rank("u"), F.col("b.v")).otherwise(F.col("u")).alias("p")), n))
        steps.append((parent, n))
        moved = level.join(side(parent, n), "u").select(F.col("p").alias("pu"), "v")
        moved = moved.join(side(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), n), "v")
        level = checkpoint(fitted(moved.filter(F.col("pu") != F.col("pv")).select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), n))
    if not steps:
        return one.select(F.col("u").alias("node"), F.col("u").alias("root")).limit(0)
    (last, below), upper = steps[-1], steps[:-1]
    roots = last.select(F.col("u").alias("node"), F.col("p").alias("root"))
    for parent, n in reversed(upper):
        up = side(roots.select(F.col("node").alias("p"), F.col("root")), below)
        roots, below = checkpoint(fitted(parent.join(up, "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root")), n)), n
    return roots
