"""What the interactive page asks of a graph, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spandrel.functions import scalars as S
from spandrel.operators.analytics import components, within_hops
from spandrel.operators.components import checkpoint, fitted, side
from spandrel.operators.graph import Graph
from spandrel.operators.tables import Scratch
from spandrel.schema import EDGE_COLUMNS, EDGE_KINDS

#: What ids of merged clusters start with.
CLUSTER = "cluster_"

VDIR = "__vdir__/"
# Fixed values of the treemap: padding, header, cell area at the slider's default, and the canvas's shape.
PAD, HEADER, BASE_CELL, SLIDER = 10, 24, 2000, 1400


# ---- filters ---------------------------------------------------------------------------------------------------------


def filter_nodes(graph: Graph, kinds: list[str] | None = None, externals: bool = True, search: str = "", path: str = "", metrics: DataFrame | None = None, coupling_from: float = 0.0) -> DataFrame:
    """All conditions hold: kind, externals, search in label or id, path prefix, coupling."""
    nodes = graph.nodes
    if kinds is not None:
        nodes = nodes.filter(F.col("kind").isin(kinds))
    if not externals:
        nodes = nodes.filter(~F.col("is_external"))
    if search:
        label = S.truncate_label(S.make_label(F.col("id"), F.col("kind"), F.col("name")))
        nodes = nodes.filter(F.contains(F.lower(label), F.lit(search.lower())) | F.contains(F.lower("id"), F.lit(search.lower())))
    if path:
        nodes = nodes.filter(F.startswith("file", F.lit(path)))
    if metrics is not None and coupling_from > 0:
        nodes = nodes.join(metrics.filter(F.col("coupling_score") >= coupling_from).select("id"), "id", "left_semi")
    return nodes


def filter_edges(graph: Graph, nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges of the kinds (all but contains by default) between visible nodes."""
    edges = graph.edges.filter(F.col("kind").isin(kinds if kinds is not None else [k for k in EDGE_KINDS if k != "contains"]))
    ids = nodes.select("id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges.select(*EDGE_COLUMNS)


def visible_subgraph(graph: Graph, edge_kinds: list[str] | None = None, **node_filter) -> Graph:
    nodes = filter_nodes(graph, **node_filter)
    return Graph(nodes, filter_edges(graph, nodes, edge_kinds))


def hide_node(graph: Graph, id_: str) -> Graph:
    return Graph(graph.nodes.filter(F.col("id") != id_), graph.edges.filter((F.col("source") != id_) & (F.col("target") != id_)))


# ---- drawing ---------------------------------------------------------------------------------------------------------


def display_degree(graph: Graph) -> DataFrame:
    """(id, degree, value, mass): undirected degree over all edges, 1 where there is none."""
    ends = graph.edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    most = F.broadcast(ends.agg(F.greatest(F.coalesce(F.max("degree"), F.lit(1)), F.lit(1)).alias("most")))  # one row
    rows = graph.nodes.select("id").join(ends, "id", "left").crossJoin(most).withColumn("degree", F.coalesce("degree", F.lit(1)).cast("long"))
    d = F.col("degree").cast("double")
    return rows.select("id", "degree", F.sqrt(d).alias("value"), (1 + 4 * F.sqrt(d / F.col("most").cast("double"))).alias("mass"))


def display_nodes(graph: Graph, cycle_ids: DataFrame | None = None, orphan_ids: DataFrame | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Label, shown kind, kind's name, shape, colours and border of every node; flags join in as small tables of ids."""
    kind = S.display_kind(F.col("kind"), F.col("file"), F.col("name"))
    rows = graph.nodes.select("id", S.truncate_label(S.make_label(F.col("id"), F.col("kind"), F.col("name"))).alias("label"), kind.alias("shown_kind"), S.kind_display(kind, F.col("file")).alias("kind_name"))
    for ids, flag in ((cycle_ids, "in_cycle"), (orphan_ids, "is_orphan")):
        rows = rows.withColumn(flag, F.lit(False)) if ids is None else rows.join(ids.select("id").distinct().withColumn(flag, F.lit(True)), "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("change", F.lit("kept")) if changes is None else rows.join(changes.select("id", "change"), "id", "left")
    fill = F.when(F.col("change") == "removed", S.REMOVED).when(F.col("change") == "added", S.ADDED).otherwise(S.lookup(F.col("shown_kind"), S.PAGE_COLORS, S.OTHER_NODE))
    rows = rows.withColumns({"shape": S.lookup(F.col("shown_kind"), S.SHAPES, "dot"), "background": fill})
    return rows.withColumns({"border": F.when(F.col("in_cycle"), S.CYCLE_BORDER).otherwise(S.darken(F.col("background"))), "border_width": F.when(F.col("in_cycle"), 3).when(F.col("is_orphan"), 2).otherwise(1).cast("long")})


def node_detail(graph: Graph, id_: str) -> dict[str, DataFrame]:
    """The row, and the edges in and out with the row of the other end."""
    full = graph.edges_with_endpoints()
    return {"node": graph.get_node(id_), "incoming": full.filter(F.col("target") == id_), "outgoing": full.filter(F.col("source") == id_)}


# ---- groups ----------------------------------------------------------------------------------------------------------


def show_component(graph: Graph, index: int, named: DataFrame | None = None) -> Graph:
    """The sub-graph of the component at ``index`` (largest first, then by name), clamped to what there is."""
    named = checkpoint(components(graph)) if named is None else named  # read three times
    sizes = named.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))
    at = max(0, min(index, sizes.count() - 1))
    pick = sizes.orderBy(F.desc("n"), "component_id").offset(at).limit(1)
    return graph.induced(named.join(pick, "component_id", "left_semi"))


def focus_ids(graph: Graph, id_: str, depth: int = 1) -> DataFrame:
    return within_hops(graph, id_, depth).select("id")


def clusters(graph: Graph, least: int = 2) -> DataFrame:
    """(cluster, n): nodes by the first segment of their ids."""
    return graph.nodes.groupBy(S.top_level(F.col("id")).alias("cluster")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def cluster_graph(graph: Graph, level: int = 1, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with clusters merged: nodes (id, is_cluster, n), edges (source, target, kind, n).

    A cluster is the first ``level`` segments of an id; one of fewer than ``least`` nodes stays apart, node by node. Edges are
    redrawn between what their ends went into; how many were merged is ``n``, and edges inside a cluster vanish.
    """
    own = graph.nodes.select("id", S.first_segments(F.col("id"), level).alias("cluster"))
    large = checkpoint(own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    few = large.count()
    within = lambda df, c: df.withColumn("cluster", S.first_segments(F.col(c), level)).join(side(large.select("cluster", F.lit(True).alias("is_cluster")), few), "cluster", "left")
    alone = within(own.select("id"), "id").filter("is_cluster is null").select("id", F.lit(False).alias("is_cluster"), F.lit(1).cast("long").alias("n"))
    edges = graph.edges.select(*EDGE_COLUMNS)
    for end in ("source", "target"):
        edges = within(edges, end).withColumn(end, F.when(F.col("is_cluster"), F.concat(F.lit(CLUSTER), "cluster")).otherwise(F.col(end))).select(*EDGE_COLUMNS)
    merged = edges.filter("source <> target").groupBy(*EDGE_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    return large.select(F.concat(F.lit(CLUSTER), "cluster").alias("id"), F.lit(True).alias("is_cluster"), "n").unionByName(alone), merged


def duplicate_names(graph: Graph, by: str = "name") -> DataFrame:
    """(name, n) of names or ids that several nodes have, the commonest first."""
    return graph.nodes.groupBy(F.col(by).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "name")


# ---- file tree -------------------------------------------------------------------------------------------------------


def _parts(file: Column) -> Column:
    return F.filter(F.split(F.translate(file, "\\", "/"), "/"), lambda p: p != "")


def fs_tree(graph: Graph) -> DataFrame:
    """(path, name, parent, is_dir, n): every prefix of every file, with the number of nodes below; a rollup by depth."""
    files = graph.nodes.filter(F.coalesce("file", F.lit("")) != "").groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("p", _parts(F.col("file")))
    rows = files.select("n", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k")).filter("size(p) > 0")
    join = lambda k: F.array_join(F.slice("p", F.lit(1), k), "/")
    rows = rows.select(join(F.col("k")).alias("path"), F.element_at("p", F.col("k")).alias("name"), F.when(F.col("k") > 1, join(F.col("k") - 1)).otherwise("").alias("parent"), (F.col("k") < F.size("p")).alias("d"), "n")
    return rows.groupBy("path", "name", "parent").agg(F.max("d").alias("is_dir"), F.sum("n").alias("n"))


def fs_children(graph: Graph, path: str = "") -> DataFrame:
    """What a folder holds: folders first, then by name."""
    return fs_tree(graph).filter(F.col("parent") == path).orderBy(F.desc("is_dir"), "name")


def descend(graph: Graph, path: str = "") -> str:
    """Follow a folder's chain of single sub-folders to where it ends."""
    tree = checkpoint(fs_tree(graph))
    while True:
        kids = tree.filter(F.col("parent") == path).select("path", "is_dir").take(2)
        if len(kids) != 1 or not kids[0]["is_dir"]:
            return path
        path = kids[0]["path"]


def filter_fs(graph: Graph, path: str) -> DataFrame:
    return filter_nodes(graph, path=path)


# ---- containment, virtual folders, weights, treemap ------------------------------------------------------------------


def containment(graph: Graph, externals: bool = True) -> DataFrame:
    """(parent, child) of contains edges with both ends visible."""
    visible = filter_nodes(graph, externals=externals).select("id").hint("merge")  # ids compress so well that millions look small enough to broadcast
    edges = graph.edges.filter("kind = 'contains'")
    for end in ("source", "target"):
        edges = edges.join(visible.withColumnRenamed("id", end), end, "left_semi")
    return edges.select(F.col("source").alias("parent"), F.col("target").alias("child")).distinct()


def containment_roots(graph: Graph, externals: bool = True) -> DataFrame:
    """Nodes that nothing contains."""
    held = containment(graph, externals).select(F.col("child").alias("id")).hint("merge")
    return graph.nodes.join(held, "id", "left_anti").select("id", "name", "file", "is_external")


def virtual_folders(graph: Graph, externals: bool = True) -> DataFrame:
    """(parent, child, child_name, is_virtual) of the folders above the roots' files, and of the roots put into them."""
    roots = containment_roots(graph, externals)
    if not externals:
        roots = roots.filter(~F.col("is_external"))
    rows = roots.withColumn("p", _parts(F.coalesce("file", F.lit("")))).filter("size(p) >= 2")
    vid = lambda k: F.concat(F.lit(VDIR), F.array_join(F.slice("p", F.lit(1), k), "/"))
    own = rows.select(vid(F.size("p") - 1).alias("parent"), F.col("id").alias("child"), F.col("name").alias("child_name"), F.lit(False).alias("is_virtual"))
    steps = rows.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    dirs = steps.select(F.when(F.col("k") > 1, vid(F.col("k") - 1)).alias("parent"), vid(F.col("k")).alias("child"), F.element_at("p", F.col("k")).alias("child_name"), F.lit(True).alias("is_virtual"))
    return own.unionByName(dirs).distinct()


def collapse_chains(folders: DataFrame) -> DataFrame:
    """A folder whose only child is a folder takes that child's place: names join by ``/``, children move up.

    Every folder of a chain is told its top by pointer doubling, so the rounds are the logarithm of the deepest chain.
    """
    folders = checkpoint(folders)
    virtual = folders.filter("is_virtual")
    single = folders.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.max("child").alias("child"), F.bool_and("is_virtual").alias("v")).filter("n = 1 and v")
    link = checkpoint(single.select("child", F.col("parent").alias("top")))  # child is merged into top
    while True:
        up = link.select(F.col("child").alias("top"), F.col("top").alias("higher"))
        far = checkpoint(link.join(up, "top", "left").select("child", F.coalesce("higher", "top").alias("top"), F.col("higher").isNotNull().alias("moved")))
        link = far.select("child", "top")
        if far.filter("moved").isEmpty():
            break
    names = virtual.select(F.col("child").alias("id"), "child_name").join(link.withColumnRenamed("child", "id"), "id", "left").withColumn("top", F.coalesce("top", "id"))
    names = names.groupBy("top").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.length("id").alias("k"), "child_name"))), lambda x: x["child_name"]), "/").alias("joined"))
    rows = folders.join(link.select(F.col("child").alias("child"), F.lit(True).alias("gone")), "child", "left").filter("gone is null").drop("gone")
    rows = rows.join(link.select(F.col("child").alias("parent"), "top"), "parent", "left").withColumn("parent", F.coalesce("top", "parent")).drop("top")
    rows = rows.join(names.withColumnRenamed("top", "child"), "child", "left").withColumn("child_name", F.coalesce("joined", "child_name"))
    return rows.select("parent", "child", "child_name", "is_virtual")


def structure(graph: Graph, externals: bool = True, folders: bool = True) -> DataFrame:
    """The forest (parent, child, name, is_virtual) that the treemap shows; roots have no parent.

    Nodes and edges are written first: Spark pushes a semi-join into every branch of a union, so that joins of nodes and edges
    that are unions themselves would multiply, and all of them would run, and hold memory, in the tasks of one stage.
    """
    scratch = Scratch(graph.nodes.sparkSession)
    graph = Graph(scratch.keep(filter_nodes(graph, externals=externals)), scratch.keep(graph.edges.select(*EDGE_COLUMNS).filter("kind = 'contains'")))
    inside = scratch.keep(containment(graph, externals))
    graph = Graph(graph.nodes, inside.select(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit("contains").alias("kind")))
    names = graph.nodes.select(F.col("id").alias("child"), "name")
    real = inside.join(names.hint("merge"), "child").select("parent", "child", "name", F.lit(False).alias("is_virtual"))
    roots = names.join(inside.select("child").hint("merge"), "child", "left_anti")
    if folders:
        dirs = collapse_chains(virtual_folders(graph, externals)).withColumnRenamed("child_name", "name")
        roots = roots.join(dirs.select("child"), "child", "left_anti")
        real = real.unionByName(dirs)
    return scratch.close(real.unionByName(roots.select(F.lit(None).cast("string").alias("parent"), "child", "name", F.lit(False).alias("is_virtual"))))


def subtree_weights(forest: DataFrame, slider: int = SLIDER) -> DataFrame:
    """(id, weight): leaves at least 1, containers at least their children's sum, both at least what their name needs.

    Rounds of two steps, as many as the logarithm of the depth: containers whose children are all weighed are weighed; then
    containers with one open child are taken out of their chains, no two neighbours at once, and the child hangs on their parents by the
    two containers' rules in one (a rule max(x + a, b) after another is such a rule again). In the end they are weighed by their child.
    Nodes on a cycle, and what holds them, are left out.
    """
    scratch = Scratch(forest.sparkSession)
    forest = scratch.keep(forest.dropDuplicates(["parent", "child"]))
    cell = BASE_CELL * (slider / SLIDER)
    kids = forest.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    names = forest.groupBy(F.col("child").alias("id")).agg(F.first("name").alias("name")).join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    width = F.greatest(F.lit(72), F.length("name") * F.when(F.col("kids") == 0, 8).otherwise(9) + 24).cast("double")
    least = F.when(F.col("kids") == 0, F.greatest(F.lit(1.0), width * width / F.lit(cell))).otherwise(width * (HEADER + 30) / F.lit(cell))
    nodes = scratch.keep(names.select("id", F.col("kids").cast("long").alias("open"), F.lit(0.0).alias("a"), least.alias("b")))
    edges = scratch.keep(forest.filter("parent is not null").select("child", "parent", F.lit(0.0).alias("ea"), F.lit(float("-inf")).alias("eb")))
    n = nodes.count()
    known: DataFrame | None = None
    steps: list[DataFrame] = []
    while True:
        ready = scratch.keep(nodes.filter("open = 0").select("id", F.greatest("a", "b").alias("weight")))
        done = ready.count()
        known = ready if known is None else known.unionByName(ready)
        told = edges.join(side(ready.withColumnRenamed("id", "child"), done), "child").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("weight") + F.col("ea"), "eb")).alias("s"))
        nodes = nodes.filter("open > 0").join(side(told, done), "id", "left").select("id", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), (F.col("a") + F.coalesce("s", F.lit(0.0))).alias("a"), "b")
        nodes, edges = scratch.keep(fitted(nodes, n)), scratch.keep(fitted(edges.join(side(ready.select(F.col("id").alias("child")), done), "child", "left_anti"), n))
        went = 0
        single = nodes.filter("open = 1").select("id")
        if few := single.count():
            rank = lambda c, i=len(steps): F.struct(F.xxhash64(c, F.lit(i)).alias("h"), F.col(c).alias("k"))
            inner = edges.join(side(single.withColumnRenamed("id", "child"), few), "child", "left_semi").join(side(single.withColumnRenamed("id", "parent"), few), "parent", "left_semi")
            near = inner.select(F.explode(F.array(F.struct(F.col("child").alias("id"), rank("parent").alias("r")), F.struct(F.col("parent").alias("id"), rank("child").alias("r")))).alias("e")).groupBy("e.id").agg(F.min("e.r").alias("least"))
            gone = scratch.keep(fitted(single.join(side(near, few), "id", "left").withColumn("own", rank("id")).filter("least is null or own < least").select("id"), few))
            went = gone.count()
            below = edges.join(side(gone.withColumnRenamed("id", "parent"), went), "parent", "left_semi").withColumnRenamed("parent", "id").join(nodes.select("id", "a", "b"), "id")
            step = scratch.keep(fitted(below.select("id", "child", (F.col("ea") + F.col("a")).alias("ka"), F.greatest(F.col("eb") + F.col("a"), "b").alias("kb")), went))
            steps.append(step)
            above = edges.join(side(gone.withColumnRenamed("id", "child"), went), "child", "left_semi").withColumnRenamed("child", "id")
            joined = above.join(side(step, went), "id").select("child", "parent", (F.col("ka") + F.col("ea")).alias("ea"), F.greatest(F.col("kb") + F.col("ea"), "eb").alias("eb"))
            rest = edges
            for end in ("child", "parent"):
                rest = rest.join(side(gone.withColumnRenamed("id", end), went), end, "left_anti")
            edges = scratch.keep(fitted(rest.select("child", "parent", "ea", "eb").unionByName(joined), n))
            nodes = scratch.keep(fitted(nodes.join(side(gone, went), "id", "left_anti"), n))
        if not done and not went:
            break
        known = scratch.keep(fitted(known, n))
    for step in reversed(steps):
        known = scratch.keep(fitted(known.unionByName(step.join(known.withColumnRenamed("id", "child"), "child").select("id", F.greatest(F.col("weight") + F.col("ka"), "kb").alias("weight"))), n))
    return scratch.close(known)


def ordinal(named: DataFrame) -> DataFrame:
    """(component_id, n, ordinal) in the order that the navigator walks.

    Sizes are sorted over range partitions; a component's place is its place within its partition after the counts of those before.
    """
    order = (F.desc("n"), "component_id")
    sizes = checkpoint(named.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"))).repartitionByRange(*order).sortWithinPartitions(*order)  # ranges are sampled first
    placed = checkpoint(sizes.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))  # a row for each partition
    before = counts.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select("component_id", "n", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("ordinal"))
