"""Directed graphs shrunk node by node: cycles and longest paths in few rounds, however deep the graph is.

A node is taken out, and every way through it, u -> node -> v, becomes an edge u -> v; of parallel edges the longest stays.
What can be reached from what, and how far it is at most, is the same for all nodes that remain. In one round a node goes
if it has few ways through it (no more than it has edges, or a few more as long as the graph has not grown) and comes
before all such neighbours in a pseudorandom order, so no two neighbours go at once. Nodes that nothing enters or nothing leaves
have no ways through them and go with the rest. Chains, ladders, trees, grids and their like shrink by a constant share a
round, from within and not from their ends. When the rest is solved the rounds are taken back, last first: a node's answer
follows from those of its neighbours at the time when it went.

The rest is empty for graphs without cycles; else it is a core whose nodes all have many ways through them, which colours
solve (``cycles``). A rest of ``CORE`` counted edges at most is solved at once in one task, larger ones never are.

All rounds are joins and partial aggregates over tables in the shared folder; only counts reach the driver, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators.components import fitted
from spandrel.operators.tables import Scratch

#: Ways through a node that may go even if it has fewer edges, as long as the graph is smaller than GROWN times its first size.
WAYS, GROWN = 16, 2
#: Counted edges that one task solves.
CORE = 50_000

Step = tuple[DataFrame, DataFrame, int]


def shrink(edges: DataFrame, scratch: Scratch, first: int | None = None) -> tuple[DataFrame, int, list[Step]]:
    """(rest, its edges, steps) of edges (u, v, w); v may be null: then w is a length at which u may end.

    A step holds the edges before it, the nodes (id) that went, and the number of edges.
    """
    steps: list[Step] = []
    n = edges.count()
    first = first or n
    while n > CORE:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(0).alias("i"), F.col("v").isNotNull().cast("int").alias("o")), F.struct(F.col("v").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
        degree = ends.filter("e.id is not null").groupBy("e.id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
        most = F.greatest(F.col("i") + F.col("o"), F.lit(WAYS if n < GROWN * first else 0))
        kind = F.when(F.col("o") == 0, 0).when(F.col("i") == 0, 1).otherwise(2)
        can = degree.filter(F.col("i") * F.col("o") <= most).select("id", F.struct(kind.alias("k"), F.xxhash64("id", F.lit(len(steps))).alias("h"), "id").alias("r"))
        can = scratch.keep(fitted(can, n))
        if not (few := can.count()):
            break
        inner = edges.filter("v is not null").join(merged(can.select(F.col("id").alias("u"), F.col("r").alias("ru"))), "u").join(merged(can.select(F.col("id").alias("v"), F.col("r").alias("rv"))), "v")
        near = inner.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("rv").alias("r")), F.struct(F.col("v").alias("id"), F.col("ru").alias("r")))).alias("e")).groupBy("e.id").agg(F.min("e.r").alias("least"))
        gone = can.join(merged(near), "id", "left").filter("least is null or r < least").select("id")
        gone = scratch.keep(fitted(gone, few))
        steps.append((edges, gone, n))
        rest, into, out = edges, _ends(edges, gone, "v"), _ends(edges, gone, "u")
        for end in "uv":
            rest = rest.join(merged(gone.withColumnRenamed("id", end)), end, "left_anti")
        ways = into.select("u", F.col("v").alias("id"), "w").join(merged(out.select(F.col("u").alias("id"), "v", F.col("w").alias("more"))), "id").filter("v is null or u <> v")
        every = rest.select("u", "v", "w").unionByName(ways.select("u", "v", (F.col("w") + F.col("more")).alias("w")))
        edges = scratch.keep(fitted(every.groupBy("u", "v").agg(F.max("w").alias("w")), n))
        n = edges.count()
    return edges, n, steps


def merged(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that is never a broadcast.

    A broadcast of however few rows takes a whole page of the driver's memory (up to 64 MB), and there would be some in every round.
    """
    return df.hint("merge")


def _ends(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """The edges that have one of ``nodes`` at ``end``."""
    return edges.join(merged(nodes.withColumnRenamed("id", end)), end, "left_semi")


def in_one_task(edges: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], shape: str) -> DataFrame:
    """``solve`` over a table whose counted rows are few."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if parts:
            yield solve(pd.concat(parts))

    return edges.coalesce(1).mapInPandas(run, shape)


# ---- longest paths ---------------------------------------------------------------------------------------------------


def longest(edges: DataFrame) -> DataFrame:
    """(id, d): the longest way from each node of an acyclic graph (u, v, w) to an end (v null)."""
    scratch = Scratch(edges.sparkSession)
    rest, n, steps = shrink(scratch.keep(edges.groupBy("u", "v").agg(F.max("w").cast("long").alias("w"))), scratch)
    known = in_one_task(rest, _longest, "id string, d long")
    for before, gone, n in reversed(steps):
        known = scratch.keep(fitted(known, n))
        out = _ends(before, gone, "u").join(merged(known.withColumnRenamed("id", "v")), "v", "left")
        known = known.unionByName(out.groupBy(F.col("u").alias("id")).agg(F.max(F.col("w") + F.when(F.col("v").isNull(), 0).otherwise(F.col("d"))).alias("d")))
    return scratch.close(known)


def _longest(edges: pd.DataFrame) -> pd.DataFrame:
    up: dict[str, list[tuple[str | None, int]]] = {}
    for u, v, w in edges[["u", "v", "w"]].itertuples(index=False):
        up.setdefault(u, []).append((v if isinstance(v, str) else None, int(w)))
    known: dict[str, int] = {}
    for start in up:
        todo = [start]
        while todo:
            u = todo[-1]
            open_ = [v for v, _ in up[u] if v is not None and v not in known] if u not in known else []
            if open_:
                todo += open_
                continue
            todo.pop()
            if u not in known:
                known[u] = max(w + (known[v] if v is not None else 0) for v, w in up[u])
    return pd.DataFrame(list(known.items()), columns=["id", "d"])


# ---- cycles ----------------------------------------------------------------------------------------------------------


def cycles(edges: DataFrame) -> DataFrame:
    """(id, cycle_id) of the nodes of edges (source, target) that lie on a cycle of several nodes; the id is the smallest of the strongly connected component.

    A node that went lies in the component of a node before it and a node behind it if these lie in one, or are the same.
    In a core every node takes the smallest id that reaches it; the nodes of one colour that reach the colour's own node
    within it form a component, and go; what remains is shrunk further.
    """
    scratch = Scratch(edges.sparkSession)
    rest = scratch.keep(edges.filter("source <> target").select(F.col("source").alias("u"), F.col("target").alias("v"), F.lit(0).cast("long").alias("w")).distinct())
    steps: list[Step] = []
    found: list[DataFrame] = []
    first = None
    while True:
        rest, n, more = shrink(rest, scratch, first)
        first, steps = first or (more[0][2] if more else n), steps + more
        if n <= CORE:
            break
        part = scratch.keep(fitted(_coloured(rest, n, scratch), n))
        found.append(part)
        for end in "uv":
            rest = rest.join(merged(part.select(F.col("id").alias(end))), end, "left_anti")
        rest = scratch.keep(fitted(rest.select("u", "v", "w"), n))
    known = in_one_task(rest, _components, "id string, c string")
    for part in found:
        known = known.unionByName(part)
    for before, gone, n in reversed(steps):
        known = scratch.keep(fitted(known, n))
        label = lambda df, end: df.join(merged(known.select(F.col("id").alias(end), "c")), end, "left").withColumn("c", F.coalesce("c", end))  # noqa: B023, E731
        into = label(_ends(before, gone, "v"), "u").select(F.col("v").alias("id"), "c").distinct()
        out = label(_ends(before, gone, "u"), "v").select(F.col("u").alias("id"), "c").distinct()
        known = known.unionByName(into.join(merged(out), ["id", "c"]))
    known = scratch.keep(known)
    # A component that came down to one node has no row for it.
    heads = known.select(F.col("c").alias("id"), "c").distinct().join(merged(known.select("id")), "id", "left_anti")
    every = known.unionByName(heads)
    names = every.groupBy("c").agg(F.min("id").alias("cycle_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return scratch.close(every.join(merged(names), "c").select("id", "cycle_id"))


def _components(edges: pd.DataFrame) -> pd.DataFrame:
    """Two depth-first searches: forward for the order in which nodes are left, backward in the reverse of it."""
    ahead: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for u, v in edges[["u", "v"]].itertuples(index=False):
        for there, a, b in ((ahead, u, v), (back, v, u)):
            there.setdefault(a, []).append(b)
            there.setdefault(b, [])
    left: list[str] = []
    seen: set[str] = set()
    for start in sorted(ahead):
        todo = [(start, False)]
        while todo:
            x, done = todo.pop()
            if done:
                left.append(x)
            elif x not in seen:
                seen.add(x)
                todo += [(x, True), *((y, False) for y in ahead[x] if y not in seen)]
    rows: list[tuple[str, str]] = []
    named: set[str] = set()
    for start in reversed(left):
        todo, own = [start], []
        while todo:
            x = todo.pop()
            if x not in named:
                named.add(x)
                own.append(x)
                todo += [y for y in back[x] if y not in named]
        if len(own) > 1:
            rows += [(x, start) for x in own]
    return pd.DataFrame(rows, columns=["id", "c"])


def _coloured(edges: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(id, c): a component of each colour of a core of ``n`` edges."""
    colour = wave = scratch.keep(fitted(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("c")), n))
    while not wave.isEmpty():
        offer = edges.join(merged(wave.select(F.col("id").alias("u"), F.col("c").alias("new"))), "u").groupBy(F.col("v").alias("id")).agg(F.min("new").alias("new"))
        colour = scratch.keep(fitted(colour.join(merged(offer), "id", "left").select("id", F.least("c", F.coalesce("new", "c")).alias("c"), (F.col("new") < F.col("c")).alias("moved")), n))
        wave, colour = colour.filter("moved").select("id", "c"), colour.select("id", "c")
    inner = edges
    for end in "uv":
        inner = inner.join(merged(colour.select(F.col("id").alias(end), F.col("c").alias(f"c{end}"))), end)
    inner = scratch.keep(fitted(inner.filter("cu = cv").select("u", "v", F.col("cu").alias("c")), n))
    reached = wave = scratch.keep(fitted(colour.filter("id = c"), n))
    while True:
        step = inner.join(merged(wave.select(F.col("id").alias("v"), "c")), ["v", "c"]).select(F.col("u").alias("id"), "c").distinct()
        wave = scratch.keep(fitted(step.join(merged(reached), ["id", "c"], "left_anti"), n))
        if wave.isEmpty():
            return reached
        reached = scratch.keep(fitted(reached.unionByName(wave), n))


# ---- guarded walks ---------------------------------------------------------------------------------------------------


def backward_edges(edges: DataFrame) -> DataFrame:
    """Of edges (u, v, c) within strongly connected components c, those at which a depth-first walk in the order of ids meets its own path."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        up: dict[str, list[str]] = {}
        for u, v in pdf[["u", "v"]].sort_values(["u", "v"]).itertuples(index=False):
            up.setdefault(u, []).append(v)
        met, seen, path = [], set(), set()
        for start in up:
            todo = [(start, iter(up[start]))] if start not in seen else []
            seen.add(start)
            path = {start}
            while todo:
                u, rest = todo[-1]
                for v in rest:
                    if v in path:
                        met.append((u, v))
                    elif v not in seen:
                        seen.add(v)
                        path.add(v)
                        todo.append((v, iter(up.get(v, []))))
                        break
                else:
                    path.discard(u)
                    todo.pop()
        return pd.DataFrame(met, columns=["u", "v"])

    return edges.select("u", "v", "c").groupBy("c").applyInPandas(walk, "u string, v string")


def guarded_depth(up: DataFrame) -> DataFrame:
    """(id, d) for all ends of (child, parent): 0 without parents, else 1 + the deepest parent; a parent that is on the walk's own path counts 0.

    The walk matters inside cycles only: it tells which edges to count as an end. Without them the graph is acyclic.
    """
    up = up.select(F.col("child").alias("u"), F.col("parent").alias("v")).distinct()
    scratch = Scratch(up.sparkSession)
    up = scratch.keep(up)
    on = scratch.keep(cycles(up.select(F.col("u").alias("source"), F.col("v").alias("target"))))
    loops = up.filter("u = v")
    inner = up.filter("u <> v").join(merged(on.select(F.col("id").alias("u"), F.col("cycle_id").alias("c"))), "u").join(merged(on.select(F.col("id").alias("v"), F.col("cycle_id").alias("cv"))), "v").filter("c = cv")
    cut = scratch.keep(backward_edges(inner).unionByName(loops))
    kept = up.join(merged(cut), ["u", "v"], "left_anti")
    end: Callable[[Column | str, int], list] = lambda c, w: [F.col(c).alias("u"), F.lit(None).cast("string").alias("v"), F.lit(w).cast("long").alias("w")]
    roots = up.select(F.col("v").alias("id")).distinct().join(merged(up.select(F.col("u").alias("id"))), "id", "left_anti")
    edges = kept.select("u", "v", F.lit(1).cast("long").alias("w")).unionByName(cut.select(*end("u", 1)).distinct()).unionByName(roots.select(*end("id", 0)))
    return scratch.close(longest(edges))
