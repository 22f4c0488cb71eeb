"""Every registered query of the graph engine, and its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import scalars as S
from spandrel.operators import analytics as A
from spandrel.operators import incremental, merkle
from spandrel.operators import resolve as R
from spandrel.operators import views as V
from spandrel.operators.components import checkpoint
from spandrel.operators.graph import Graph, first_nodes, valid_edges
from spandrel.operators.layout import Layout
from spandrel.operators.tables import written
from spandrel.operators.treemap import treemap
from spandrel.plans import fixtures as X
from spandrel.plans import golden, snippets
from spandrel.schema import EDGE_COLUMNS, NODE_COLUMNS
from spandrel.sources import cache, export, scan, tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GN, GE = f"gn as ({X.CATALOG_NODES})", f"ge as ({X.CATALOG_EDGES})"
FOCUS = "n3"
CLASS_NODE = "r0.n0"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def catalog_query(name: str, body: str) -> Callable:
    """A query over the catalogue graph, whose oracle may use gn (nodes) and ge (edges)."""
    return lambda f: query(name, f"with {GN}, {GE} {body}")(lambda spark, d: f(X.catalog(spark, d)))


# ---- store -----------------------------------------------------------------------------------------------------------


@query("nodes_dedup", f"with {GN} select * from gn")
def _nodes_dedup(spark: SparkSession, d: str) -> DataFrame:
    n = X.catalog(spark, d).nodes
    again = n.withColumns({"name": F.upper("name"), "line": F.col("line") + 7, "seq": F.lit(2)})
    return first_nodes(again.unionByName(n.withColumn("seq", F.lit(1)))).select(*NODE_COLUMNS)


@query("edges_dedup", f"with {GE} select source, target, kind from ge")
def _edges_dedup(spark: SparkSession, d: str) -> DataFrame:
    g = X.catalog(spark, d)
    g = Graph(written(g.nodes), written(g.edges))  # read four times
    dangling = g.edges.select("source", F.lit("nowhere").alias("target"), "kind").unionByName(g.edges.select(F.lit("nowhere").alias("source"), "target", "kind"))
    return valid_edges(g.edges.unionByName(g.edges).unionByName(dangling), g.nodes)


@query("transition_edges", f"select distinct source, target, kind from ({X.TRANSITIONS}) x")
def _transition_edges(spark: SparkSession, d: str) -> DataFrame:
    g = X.of_edges(spark, d, X.TRANSITIONS)
    return valid_edges(g.edges, g.nodes)


KIND_COUNTS = ", ".join(f"count(*) filter (where kind = '{k}') as {k}_count" for k in ("module", "class", "struct", "function", "method", "property", "constant"))
catalog_query("graph_stats", f"select count(*) as node_count, {KIND_COUNTS}, count(*) filter (where is_external) as external_count, (select count(*) from ge) as edge_count from gn")(lambda g: g.stats())

SIDES = ", ".join(f"{a}.{c} as {end}_{c}" for a, end in (("s", "source"), ("t", "target")) for c in NODE_COLUMNS if c != "id")
JOINED = f"select e.source, e.target, e.kind, {SIDES} from ge e join gn s on s.id = e.source join gn t on t.id = e.target"
catalog_query("edges_with_endpoints", JOINED)(lambda g: g.edges_with_endpoints())
catalog_query("node_lookup", f"select * from gn where id = '{CLASS_NODE}'")(lambda g: g.get_node(CLASS_NODE))
catalog_query("node_detail_in", f"{JOINED} where e.target = '{CLASS_NODE}'")(lambda g: V.node_detail(g, CLASS_NODE)["incoming"])
catalog_query("node_detail_out", f"{JOINED} where e.source = '{CLASS_NODE}'")(lambda g: V.node_detail(g, CLASS_NODE)["outgoing"])

# ---- degrees ---------------------------------------------------------------------------------------------------------

DEGREES = """d as (select id, (select count(*) from ge where target = id) as in_degree, (select count(*) from ge where source = id) as out_degree from gn),
c as (select *, cast(in_degree + out_degree as double) / cast((select case when count(*) > 1 then 2 * (count(*) - 1) else 1 end from gn) as double) as coupling_score from d)"""
catalog_query("degree_metrics", f", {DEGREES} select id, in_degree, out_degree from d")(lambda g: A.degrees(g))
catalog_query("coupling_score", f", {DEGREES} select * from c")(lambda g: A.coupling(g))
catalog_query("top_coupled", f", {DEGREES} select * from c order by coupling_score desc, id limit 10")(lambda g: A.top_coupled(g))
catalog_query("max_coupled", f", {DEGREES} select id, coupling_score from c order by coupling_score desc, id limit 1")(lambda g: A.max_coupled(g))


@query("trade_coupling", f"with gn as ({X.endpoints(X.TRADE)}), ge as ({X.TRADE}), {DEGREES} select * from c")
def _trade_coupling(spark: SparkSession, d: str) -> DataFrame:
    return A.coupling(X.trade(spark, d))


COPURCHASE_N = f"gn as ({X.endpoints(X.COPURCHASE)} union {X.ALL_CUSTOMERS}), ge as ({X.COPURCHASE})"


@query("orphans", f"with {COPURCHASE_N} select id from gn where not exists (select 1 from ge where source = id or target = id)")
def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return A.orphans(X.copurchase(spark, d))


# ---- recursion -------------------------------------------------------------------------------------------------------


@query(
    "dit_chain",
    f"""with recursive gn as ({X.endpoints(X.REPLIES)} union {X.TURNS}), ge as ({X.REPLIES}),
    w as (select id, cast(0 as bigint) as depth, id as pt from gn union all select w.id, w.depth + 1, ge.target from w join ge on ge.source = w.pt)
    select id, max(depth) as depth_of_inheritance from w group by id""",
)
def _dit(spark: SparkSession, d: str) -> DataFrame:
    return A.inheritance_depth(X.replies(spark, d))


def components_sql(nodes_and_edges: str) -> str:
    """c (id, component_id) and s (component_id, size): the smallest id moves along the edges until nothing changes."""
    return f"""with recursive {nodes_and_edges},
    b as (select source as x, target as y from ge union select target, source from ge),
    c(id, component_id) using key (id) as (select id, id from gn union select b.x, min(c.component_id) from c join b on b.y = c.id join recurring.c as r on r.id = b.x where c.component_id < r.component_id group by b.x),
    s as (select component_id, count(*) as size from c group by component_id)"""


REACH = components_sql(COPURCHASE_N)


@query("components", f"{REACH} select id, component_id from c")
def _components(spark: SparkSession, d: str) -> DataFrame:
    return A.components(X.copurchase(spark, d))


@query("component_sizes", f"{REACH} select component_id, size from s")
def _component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return A.component_sizes(X.copurchase(spark, d))


@query("component_nth", f"{REACH} select id from c where component_id = (select component_id from s order by size desc, component_id limit 1)")
def _component_nth(spark: SparkSession, d: str) -> DataFrame:
    return V.show_component(X.copurchase(spark, d), 0).nodes.select("id")


@query("component_order", f"{REACH} select component_id, size as n, row_number() over (order by size desc, component_id) - 1 as ordinal from s")
def _component_order(spark: SparkSession, d: str) -> DataFrame:
    return V.ordinal(A.components(X.copurchase(spark, d)))


REPLY_COMPONENTS = components_sql(f"gn as ({X.endpoints(X.REPLIES)} union {X.TURNS}), ge as ({X.REPLIES})")


@query("reply_components", f"{REPLY_COMPONENTS} select id, component_id from c")
def _reply_components(spark: SparkSession, d: str) -> DataFrame:
    return A.components(X.replies(spark, d))


@query("reply_component_order", f"{REPLY_COMPONENTS} select component_id, size as n, row_number() over (order by size desc, component_id) - 1 as ordinal from s")
def _reply_component_order(spark: SparkSession, d: str) -> DataFrame:
    return V.ordinal(A.components(X.replies(spark, d)))


def scc_sql(edges: str) -> str:
    """m (id, cycle_id), for graphs of a few nodes: nodes that reach each other."""
    return f"""with recursive ge as ({edges}),
    w as (select source as a, target as b from ge union select w.a, ge.target from w join ge on ge.source = w.b),
    m as (select p.a as id, least(p.a, min(p.b)) as cycle_id from w p join w q on p.a = q.b and p.b = q.a where p.a <> p.b group by p.a)"""


query("scc_cycles", f"{scc_sql(X.TRADE)} select id, cycle_id from m")(lambda spark, d: A.cycles(X.trade(spark, d)))
query("scc_transitions", f"{scc_sql(f'select distinct source, target from ({X.TRANSITIONS}) x')} select id, cycle_id from m")(lambda spark, d: A.cycles(X.of_edges(spark, d, X.TRANSITIONS)))
query("cycle_nodes", f"{scc_sql(X.TRADE)} select id from m")(lambda spark, d: A.cycle_nodes(X.trade(spark, d)))


query("scc_users", f"{scc_sql(X.USER_MOVES)} select id, cycle_id from m")(lambda spark, d: A.cycles(X.of_edges(spark, d, X.USER_MOVES)))

# A ring's walk starts at its smallest id, comes back after all n turns, and each turn is as deep as it has steps left to that start.
query(
    "dit_cyclic",
    """with t as (select conv_id, concat('c', conv_id, '.t', turn) as id, row_number() over (partition by conv_id order by turn) as k, count(*) over (partition by conv_id) as n from conversations),
    s as (select conv_id, k as first from (select *, row_number() over (partition by conv_id order by id) as o from t) x where o = 1),
    d as (select t.conv_id, id, case when t.conv_id % 2 = 0 then case when k = first then n else (k - first + n) % n end else k - 1 + case when t.conv_id % 6 = 1 then 1 else 0 end end as depth from t join s on s.conv_id = t.conv_id)
    select id, cast(depth as bigint) as depth_of_inheritance from d union all select concat('conv', conv_id), cast(1 + max(depth) as bigint) from d group by conv_id""",
)(lambda spark, d: A.inheritance_depth(X.of_edges(spark, d, X.CYCLIC_TURNS)))


def focus_oracle(edges: str, start: str, depth: int, result: str) -> str:
    return f"""with recursive ge as ({edges}), gn as ({X.endpoints(edges)}),
    b as (select source as x, target as y from ge union select target, source from ge),
    w as (select id, cast(0 as bigint) as distance from gn where id = '{start}' union select b.y, w.distance + 1 from w join b on b.x = w.id where w.distance < {depth}),
    f as (select id, min(distance) as distance from w group by id) {result}"""


for _k in (1, 2, 3):
    query(f"focus_{_k}", focus_oracle(X.TRADE, FOCUS, _k, "select id, distance from f"))(lambda spark, d, k=_k: A.within_hops(X.trade(spark, d), FOCUS, k))

    query(f"focus_replies_{_k}", focus_oracle(X.REPLIES, "c19.t4", _k, "select id, distance from f"))(lambda spark, d, k=_k: A.within_hops(X.of_edges(spark, d, X.REPLIES), "c19.t4", k))


@query(
    "focus_edges_2",
    focus_oracle(X.TRADE, FOCUS, 2, "select distinct source, target, kind from ge where source in (select id from f) and target in (select id from f)"),
)
def _focus_edges(spark: SparkSession, d: str) -> DataFrame:
    return A.focus(X.trade(spark, d), FOCUS, 2).edges


@query("focus_missing", focus_oracle(X.TRADE, "nowhere", 2, "select id from f"))
def _focus_missing(spark: SparkSession, d: str) -> DataFrame:
    return A.focus(X.trade(spark, d), "nowhere", 2).nodes.select("id")


# ---- stored graphs: the same answers from bucketed tables --------------------------------------------------------------

catalog_query("stored_lookup", f"select * from gn where id = '{CLASS_NODE}'")(lambda g: Layout.write(g).node(CLASS_NODE))
catalog_query("stored_detail_in", f"{JOINED} where e.target = '{CLASS_NODE}'")(lambda g: Layout.write(g).detail(CLASS_NODE)["incoming"])
catalog_query("stored_detail_out", f"{JOINED} where e.source = '{CLASS_NODE}'")(lambda g: Layout.write(g).detail(CLASS_NODE)["outgoing"])
catalog_query("stored_degrees", f", {DEGREES} select id, in_degree, out_degree from d")(lambda g: Layout.write(g).degrees())
catalog_query("stored_endpoints", JOINED)(lambda g: Layout.write(g).edges_with_endpoints())
query("stored_focus", focus_oracle(X.REPLIES, "c19.t4", 3, "select id, distance from f"))(lambda spark, d: Layout.write(X.of_edges(spark, d, X.REPLIES)).within_hops("c19.t4", 3))


# ---- diff ------------------------------------------------------------------------------------------------------------

DIFFS = {
    "added_nodes": f"({X.endpoints(X.SNAP_NEW)}) except ({X.endpoints(X.SNAP_OLD)})",
    "removed_nodes": f"({X.endpoints(X.SNAP_OLD)}) except ({X.endpoints(X.SNAP_NEW)})",
    "added_edges": f"(select source, target, kind from ({X.SNAP_NEW}) a) except (select source, target, kind from ({X.SNAP_OLD}) b)",
    "removed_edges": f"(select source, target, kind from ({X.SNAP_OLD}) a) except (select source, target, kind from ({X.SNAP_NEW}) b)",
}
for _name, _text in DIFFS.items():
    query(f"diff_{_name}", _text)(lambda spark, d, name=_name: A.diff(*X.snapshots(spark, d))[name])
query("diff_summary", " union all ".join(f"select '{k}' as change, count(*) as n from ({t}) {k}" for k, t in DIFFS.items()))(lambda spark, d: A.diff_summary(*X.snapshots(spark, d)))
query(
    "diff_view",
    f"""select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'kept' end as change
    from ({X.endpoints(X.SNAP_OLD)}) a full join ({X.endpoints(X.SNAP_NEW)}) b on a.id = b.id""",
)(lambda spark, d: A.diff_view(*X.snapshots(spark, d)))

# ---- views -----------------------------------------------------------------------------------------------------------

NODE_FILTER = {"kinds": ["class", "function", "method"], "externals": False, "search": "n1", "path": "geo/"}
FILTERED = "v as (select * from gn where kind in ('class', 'function', 'method') and not is_external and (lower(name) like '%n1%' or lower(id) like '%n1%') and file like 'geo/%')"
BETWEEN = "source in (select id from v) and target in (select id from v)"
catalog_query("filter_nodes", f", {FILTERED} select * from v")(lambda g: V.filter_nodes(g, **NODE_FILTER))
catalog_query("filter_nodes_coupling", f", {DEGREES} select gn.* from gn join c using (id) where coupling_score >= 0.002")(lambda g: V.filter_nodes(g, metrics=A.coupling(g), coupling_from=0.002))
catalog_query("filter_edges", ", v as (select * from gn where not (kind = 'function')) select * from ge where kind <> 'contains' and " + BETWEEN)(
    lambda g: V.filter_edges(g, V.filter_nodes(g, kinds=["module", "class", "struct", "method", "constant"]))
)
catalog_query("visible_subgraph", f", {FILTERED} select * from ge where kind = 'contains' and {BETWEEN}")(lambda g: V.visible_subgraph(g, ["contains"], **NODE_FILTER).edges)
catalog_query("hide_node", f"select * from ge where source <> '{CLASS_NODE}' and target <> '{CLASS_NODE}'")(lambda g: V.hide_node(g, CLASS_NODE).edges)

DEGREE = "d as (select id, count(*) as n from (select source as id from ge union all select target from ge) x group by id)"
catalog_query(
    "display_degree",
    f""", {DEGREE} select gn.id, coalesce(n, 1) as degree, sqrt(cast(coalesce(n, 1) as double)) as value,
    1 + 4 * sqrt(cast(coalesce(n, 1) as double) / cast((select greatest(max(n), 1) from d) as double)) as mass from gn left join d on d.id = gn.id""",
)(lambda g: V.display_degree(g))
catalog_query(
    "display_kind",
    """select id, case when kind = 'module' and file = '' then case when regexp_full_match(trim(name), '[A-Z_][A-Z0-9_]+') then 'constant' when regexp_matches(trim(name), '^[A-Z]') then 'class' else 'function' end
    else kind end as shown from (select id, case when kind in ('constant', 'module') then 'module' else kind end as kind, case when kind = 'module' then '' else file end as file, name from gn) x""",
)(lambda g: g.nodes.select("id", F.when(F.col("kind").isin("constant", "module"), "module").otherwise(F.col("kind")).alias("k"), F.when(F.col("kind") == "module", "").otherwise(F.col("file")).alias("f"), "name").select("id", S.display_kind(F.col("k"), F.col("f"), F.col("name")).alias("shown")))
catalog_query(
    "display_label",
    """, l as (select id, case when kind = 'method' and len(string_split(id, '.')) >= 2 then string_split(id, '.')[-2] || '::' || string_split(id, '.')[-1] else name end as label from gn)
    select id, case when length(label) > 12 then substring(label, 1, 11) || '…' else label end as label from l""",
)(lambda g: g.nodes.select("id", S.truncate_label(S.make_label(F.col("id"), F.col("kind"), F.col("name")), 12).alias("label")))
catalog_query(
    "display_nodes",
    """select id, case when kind = 'module' then 'hexagon' when kind = 'class' then 'square' when kind = 'struct' then 'diamond' when kind = 'constant' then 'triangleDown' else 'dot' end as shape,
    case kind when 'module' then '#3498DB' when 'class' then '#E74C3C' when 'struct' then '#F1C40F' when 'function' then '#2ECC71' when 'method' then '#9B59B6' when 'property' then '#1ABC9C' else '#E67E22' end as background,
    case kind when 'module' then 'fichier' when 'class' then 'class' when 'struct' then 'struct' when 'function' then 'fonction' when 'method' then 'méthode' else kind end as kind_name from gn""",
)(lambda g: V.display_nodes(g).select("id", "shape", "background", "kind_name"))

TOP = "case when contains(id, '::') then string_split(id, '::')[1] else string_split(id, '.')[1] end"
catalog_query("cluster_top_level", f"select {TOP} as cluster, count(*) as n from gn group by 1 having count(*) >= 2")(lambda g: V.clusters(g))
CLUSTERED = f"""c as (select id, {TOP} as c from gn), b as (select c, count(*) as n from c group by c having count(*) >= 2), w as (select id, case when b.c is null then c.id else 'cluster_' || b.c end as place from c left join b on b.c = c.c)"""
catalog_query("cluster_edges", f", {CLUSTERED} select s.place as source, t.place as target, kind, count(*) as n from ge join w s on s.id = ge.source join w t on t.id = ge.target where s.place <> t.place group by 1, 2, 3")(lambda g: V.cluster_graph(g)[1])
catalog_query("cluster_nodes", f", {CLUSTERED} select place as id, count(*) > 1 as is_cluster, count(*) as n from w group by place")(lambda g: V.cluster_graph(g)[0])
TWO = "array_to_string(string_split(id, '.')[1:2], '.')"
catalog_query("cluster_edges_2", f", {CLUSTERED.replace(TOP, TWO)} select s.place as source, t.place as target, kind, count(*) as n from ge join w s on s.id = ge.source join w t on t.id = ge.target where s.place <> t.place group by 1, 2, 3")(
    lambda g: V.cluster_graph(g, level=2)[1]
)
catalog_query("duplicate_names", "select name, count(*) as n from gn group by name having count(*) > 1")(lambda g: V.duplicate_names(g))
PREFIXES = """, p as (select string_split(file, '/') as a from gn where file <> ''), k as (select a, unnest(range(1, len(a) + 1)) as i from p),
    t as (select array_to_string(a[1:i], '/') as path, a[i] as name, array_to_string(a[1:i - 1], '/') as parent, i < len(a) as d from k)"""
catalog_query("fs_tree_rollup", f"{PREFIXES} select path, name, parent, bool_or(d) as is_dir, count(*) as n from t group by 1, 2, 3")(lambda g: V.fs_tree(g))
catalog_query("fs_children", f"{PREFIXES} select path, name, parent, bool_or(d) as is_dir, count(*) as n from t where parent = 'geo' group by 1, 2, 3")(lambda g: V.fs_children(g, "geo"))

ROOTS = "r as (select id, name, file from gn where id not in (select target from ge where kind = 'contains'))"
catalog_query("containment_roots", f", {ROOTS} select id, name, file from r")(lambda g: V.containment_roots(g).select("id", "name", "file"))
catalog_query(
    "virtual_folders",
    f""", {ROOTS}, p as (select id, name, string_split(file, '/') as a from r where len(string_split(file, '/')) >= 2), k as (select a, unnest(range(1, len(a))) as i from p)
    select distinct case when i > 1 then '__vdir__/' || array_to_string(a[1:i - 1], '/') end as parent, '__vdir__/' || array_to_string(a[1:i], '/') as child, a[i] as child_name, true as is_virtual from k
    union all select '__vdir__/' || array_to_string(a[1:len(a) - 1], '/'), id, name, false from p""",
)(lambda g: V.virtual_folders(g))
# Containment is three levels deep here, so the oracle weighs level by level.
catalog_query(
    "subtree_weight",
    """, h as (select source as parent, target as child from ge where kind = 'contains'), n as (select gn.id, (select count(*) from h where parent = gn.id) as kids, name from gn),
    m as (select id, kids, case when kids = 0 then power(greatest(72, length(name) * 8 + 24), 2) else greatest(72, length(name) * 9 + 24) * 54.0 end / 2000.0 as least_units from n),
    w0 as (select id, greatest(1.0, least_units) as weight from m where kids = 0),
    w1 as (select m.id, greatest(sum(w0.weight), max(least_units)) as weight from m join h on h.parent = m.id join w0 on w0.id = h.child group by m.id, m.kids having count(*) = max(m.kids)),
    w01 as (select * from w0 union all select * from w1),
    w2 as (select m.id, greatest(sum(w01.weight), max(least_units)) as weight from m join h on h.parent = m.id join w01 on w01.id = h.child where m.id not in (select id from w1) group by m.id)
    select id, round(weight, 6) as weight from (select * from w01 union all select * from w2) x""",
)(lambda g: V.subtree_weights(V.structure(g, folders=False)).select("id", F.round("weight", 6).alias("weight")))

# ---- resolution ------------------------------------------------------------------------------------------------------


def _registry_nodes(g: Graph) -> DataFrame:
    return g.nodes.withColumn("seq", F.format_string("%020d|%s", F.col("line"), F.col("id")))


REGISTRY = """reg as (select name as key, id, line from gn union all select string_split(id, '.')[-1], id, line from gn where string_split(id, '.')[-1] <> name)"""
catalog_query("registry", f", {REGISTRY} select key, id from reg")(lambda g: R.registry(_registry_nodes(g)).select("key", "id"))
KIND_SQL = """case when trim(string_split({c}, '::')[-1]) = '' then 'module' when strlen(trim(string_split({c}, '::')[-1])) > 1 and regexp_full_match(trim(string_split({c}, '::')[-1]), '[\\p{{Lu}}_0-9]+') then 'constant'
    when regexp_matches(trim(string_split({c}, '::')[-1]), '^\\p{{Lu}}') then 'class' when contains({c}, '::') or contains({c}, '.') then 'module' else 'function' end"""
RESOLVED = f"""with {GN}, {REGISTRY}, refs as ({X.REFS}), pairs as (select distinct module_id, name, string_split(name, '::')[-1] as short from refs),
    c as (select p.module_id, p.name, reg.id, row_number() over (partition by p.module_id, p.name order by case when starts_with(reg.id, p.module_id) and k.n > 1 then 0 else 1 end, reg.line, reg.id) as r
          from pairs p join reg on reg.key = p.name join (select key, count(*) as n from reg group by key) k on k.key = p.name),
    s as (select p.module_id, p.name, reg.id, row_number() over (partition by p.module_id, p.name order by reg.line, reg.id) as r
          from pairs p join reg on reg.key = p.short where p.short <> p.name and not starts_with(reg.id, '__ext__.')),
    t as (select p.module_id, p.name, coalesce(c.id, s.id, '__ext__.' || p.short) as target, case when c.id is null and s.id is null then {KIND_SQL.format(c="p.name")} end as kind
          from pairs p left join c on c.module_id = p.module_id and c.name = p.name and c.r = 1 left join s on s.module_id = p.module_id and s.name = p.name and s.r = 1)"""


def _resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = X.sql(spark, d, X.REFS)
    return refs, R.resolve_names(refs, checkpoint(_registry_nodes(X.catalog(spark, d))))


@query("resolve_refs", f"{RESOLVED} select ref_id, refs.module_id, refs.name, target from refs join t using (module_id, name)")
def _resolve_refs(spark: SparkSession, d: str) -> DataFrame:
    refs, found = _resolved(spark, d)
    return refs.join(found, ["module_id", "name"]).select("ref_id", "module_id", "name", "target")


@query("external_nodes", f"{RESOLVED} select target as id, substring(target, 9) as name, min_by(kind, ref_id) as kind, true as is_external from refs join t using (module_id, name) where kind is not null group by target")
def _external_nodes(spark: SparkSession, d: str) -> DataFrame:
    refs, found = _resolved(spark, d)
    rows = refs.join(found, ["module_id", "name"]).select("target", "kind", F.format_string("%020d", "ref_id").alias("seq"))
    return R.external_nodes(rows).select("id", "name", "kind", "is_external")


LINKS = """l as (select concat('page', page_id) as module_id, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '^/', '') as path from pages), u as (select distinct module_id, path from l)"""


@query("import_edges", f"with {LINKS} select module_id as source, '__ext__.' || string_split(path, '::')[-1] as target, 'external_dep' as kind from u")
def _import_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = checkpoint(_registry_nodes(X.catalog(spark, d)))
    return R.import_targets(X.links(spark, d), nodes).select(F.col("module_id").alias("source"), "target", F.col("edge").alias("kind"))


@query(
    "incremental_pages",
    r"""with p as (select page_id, concat('page', page_id) as m, coalesce(html, '') as html from pages),
    n as (select page_id, m, regexp_extract(html, '<title>([^ <]*)', 1) as name from p),
    keys as (select name as key, m, page_id from n union all select m, m, page_id from n where name <> m),
    first as (select key, arg_min(m, page_id) as m from keys group by key),
    u as (select distinct m, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '^/', '') as w from p),
    s as (select m, w, string_split(w, '::')[-1] as short from u),
    near as (select s.m, s.w, arg_min(k.m, k.page_id) as near from s join keys k on k.key = s.w and starts_with(k.m, s.m) group by s.m, s.w),
    hits as (select s.m, s.w, s.short, i.m as path, near.near as near, f.m as first, b.m as by_short from s left join p i on i.m = s.w left join near on near.m = s.m and near.w = s.w left join first f on f.key = s.w left join first b on b.key = s.short)
    select m as source, coalesce(path, by_short, '__ext__.' || short) as target, case when coalesce(path, by_short) is null then 'external_dep' else 'imports' end as kind from hits
    union select m, coalesce(path, near, first, by_short, '__ext__.' || short), 'calls' from hits""",
)
def _incremental_pages(spark: SparkSession, d: str) -> DataFrame:
    """The graph of all pages, from that of an older version and what changed since."""
    old, q = checkpoint(X.page_facts(spark, d, older=True)), R.questions(checkpoint(X.page_facts(spark, d)))
    found, _ = incremental.update(old, q, R.answers(R.questions(old)))
    return R.assemble(q, found).edges.select(*EDGE_COLUMNS)


@query("external_dep_kinds", f"with {LINKS} select path, {KIND_SQL.format(c='path')} as kind from (select distinct path from u) x")
def _external_kinds(spark: SparkSession, d: str) -> DataFrame:
    return X.links(spark, d).select("path", S.infer_external_kind(F.col("path")).alias("kind")).distinct()


# ---- source trees ----------------------------------------------------------------------------------------------------


@query(
    "tree_files",
    f"""with f as ({X.TEXT_FILES}) select rel, case right(rel, 3) when '.py' then 'python' when '.rs' then 'rust' when '.ts' then 'typescript' else 'cpp' end as lang, sha256(content) as hash, cast(octet_length(encode(content)) as bigint) as size from f where not ends_with(rel, '.txt')""",
)
def _tree_files(spark: SparkSession, d: str) -> DataFrame:
    root = X.file_tree(spark, d, X.TEXT_FILES)
    tree.register(spark)
    return spark.read.format("sourcetree").option("languages", ",".join(scan.LANGUAGES)).option("content", "true").option("path", root).load().select("rel", "lang", "hash", "size")


CLASSES = f"l as ({X.LINKED}), c as (select d, s, p, k, concat(s, '.d', d) as m, concat(s, '.d', d, '.C', d) as id, concat(s, '.d', p, '.C', p) as up from l)"


@query(
    "tree_edges",
    f"""with {CLASSES} select m as source, id as target, 'contains' as kind from c union all select id, concat(id, '.m', d), 'contains' from c
    union all select m, up, 'imports' from c where p is not null union all select id, up, 'inherits' from c where p is not null""",
)
def _tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """From files on disk to the edges of the graph."""
    return cache.analyze(spark, X.file_tree(spark, d, X.MODULE_FILES), ("python",), use_cache=False).edges.select(*EDGE_COLUMNS)


@query("tree_depth", f"with {CLASSES} select m as id, cast(0 as bigint) as depth_of_inheritance from c union all select id, k - 1 from c union all select concat(id, '.m', d), 0 from c")
def _tree_depth(spark: SparkSession, d: str) -> DataFrame:
    """From files on disk to a metric, the second run with the cache of the first."""
    root = X.file_tree(spark, d, X.MODULE_FILES)
    cache.analyze(spark, root)
    return A.inheritance_depth(cache.analyze(spark, root))


VERSIONS = f"o as ({X.OLDER_FILES}), n as ({X.TEXT_FILES})"


def _digests(spark: SparkSession, d: str) -> tuple[merkle.Digests, merkle.Digests]:
    old, new = (merkle.Digests.of(X.sql(spark, d, f).select("rel", F.sha2("content", 256).alias("hash"))) for f in (X.OLDER_FILES, X.TEXT_FILES))
    return old, new


@query(
    "tree_changes",
    f"""with {VERSIONS} select coalesce(o.rel, n.rel) as rel, case when o.rel is null then 'added' when n.rel is null then 'removed' else 'changed' end as change, sha256(o.content) as old_hash, sha256(n.content) as new_hash
    from o full join n on o.rel = n.rel where o.content is distinct from n.content""",
)
def _tree_changes(spark: SparkSession, d: str) -> DataFrame:
    """Files that differ between two versions, from the digests of their folders down."""
    return merkle.compare(*_digests(spark, d))[0]


@query(
    "folder_changes",
    f"""with {VERSIONS}, b as (select coalesce(o.rel, n.rel) as rel, o.rel is not null as was, n.rel is not null as now, o.content is not distinct from n.content as same from o full join n on o.rel = n.rel),
    s as (select string_split(rel, '/') as a, * from b), e as (select unnest(range(0, len(a))) as i, * from s)
    select array_to_string(a[1:i], '/') as path, count(*) filter (was) as old_files, count(*) filter (now) as new_files, bool_and(same) as same from e group by 1""",
)
def _folder_changes(spark: SparkSession, d: str) -> DataFrame:
    return merkle.folder_changes(*_digests(spark, d))


# ---- scalars ---------------------------------------------------------------------------------------------------------


def _values(rows: list[tuple], names: list[str]) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(golden.literal(v) for v in r) + ')' for r in rows)}) t({', '.join(names)})"


for _name, (_function, _rows) in golden.SCALARS.items():

    def _scalar(spark: SparkSession, d: str, function=_function, rows=_rows) -> DataFrame:
        return spark.createDataFrame([(r[0],) for r in rows], "input string").select("input", getattr(S, function)(F.col("input")).alias("output"))

    query(_name, _values(_rows, ["input", "output"]))(_scalar)
catalog_query("dot_ids", "select id, 'n_' || regexp_replace(id, '[^\\p{L}\\p{N}]', '_', 'g') as dot_id from gn")(lambda g: g.nodes.select("id", S.safe_dot_id(F.col("id")).alias("dot_id")))
catalog_query("edge_colors", "select distinct kind, case kind when 'contains' then '#BDC3C7' when 'uses_type' then '#1ABC9C' when 'external_dep' then '#E67E22' end as color from ge")(
    lambda g: g.edges.select("kind", S.edge_color(F.col("kind")).alias("color")).distinct()
)

# ---- extraction ------------------------------------------------------------------------------------------------------

for _lang, _sources in snippets.ALL.items():

    def _facts(spark: SparkSession, d: str, sources=_sources) -> DataFrame:
        return scan.extract_facts(scan.sources_frame(spark, sources))

    query(f"extract_{_lang}_nodes", _values(golden.NODES[_lang], ["id", "name", "kind", "line"]))(
        lambda spark, d, f=_facts: f(spark, d).filter("fact = 'node'").select(F.col("a").alias("id"), F.col("b").alias("name"), F.col("c").alias("kind"), "line")
    )
    query(f"extract_{_lang}_references", _values(golden.REFERENCES[_lang], ["fact", "a", "b", "c"]))(
        lambda spark, d, f=_facts: f(spark, d).filter("fact not in ('node', 'edge', 'error')").select("fact", "a", "b", "c").distinct()
    )
    query(f"resolve_{_lang}_edges", _values(golden.EDGES[_lang], EDGE_COLUMNS))(lambda spark, d, f=_facts: R.build_graph(checkpoint(f(spark, d))).edges.select(*EDGE_COLUMNS))

# ---- sinks -----------------------------------------------------------------------------------------------------------

NODE_COLOR = "case kind when 'module' then '#4A90D9' when 'class' then '#E74C3C' when 'struct' then '#1ABC9C' when 'function' then '#2ECC71' when 'method' then '#F39C12' when 'property' then '#9B59B6' else '#E67E22' end"
LIGHT = "case kind when 'module' then '#AED0F0' when 'class' then '#F7B7B2' when 'struct' then '#A2DDD6' when 'function' then '#A3E9C5' when 'method' then '#FAD7A0' when 'property' then '#D2B4DE' else '#FAD3A2' end"
catalog_query(
    "export_dot_lines",
    f"""select 1 as part, '    n_' || regexp_replace(id, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || ' [label="' || replace(name || ' [' || kind || ']', '"', '\\"') || '", color="' || {NODE_COLOR} || '", style=filled, fillcolor="' || {LIGHT} || '"];' as line from gn
    union all select 2, '    n_' || regexp_replace(source, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || ' -> n_' || regexp_replace(target, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || ' [label="' || kind || '", color="' ||
    case kind when 'contains' then '#BDC3C7' when 'uses_type' then '#1ABC9C' else '#E67E22' end || '"];' from ge""",
)(lambda g: export.dot_lines(g))
catalog_query("export_json_roundtrip", "select * from gn")(lambda g: Graph.from_serializable(g.to_serializable()).nodes.select(*NODE_COLUMNS))


@query(
    "analysis_summary",
    f"""{scc_sql(X.TRADE)}, gn as (select id, 'function' as kind, false as is_external from ({X.endpoints(X.TRADE)}) i),
    b as (select source as x, target as y from ge union select target, source from ge), r as (select id as a, id as b from gn union select r.a, b.y from r join b on b.x = r.b)
    select (select count(*) from gn) as node_count, {", ".join(f"(select count(*) from gn where kind = '{k}') as {k}_count" for k in ("module", "class", "struct", "function", "method", "property", "constant"))},
    (select count(*) from gn where is_external) as external_count, (select count(*) from ge) as edge_count, (select count(distinct cycle_id) from m) as cycle_count,
    (select count(distinct least_id) from (select a, min(b) as least_id from r group by a)) as component_count, (select count(*) from gn where id not in (select x from b)) as orphan_count""",
)
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return A.analyze(X.trade(spark, d)).summary()


@query("treemap")
def _treemap(spark: SparkSession, d: str) -> DataFrame:
    return treemap(V.structure(X.catalog(spark, d)))


FOLDERS = f"""roots as (select id, name, string_split(file, '/') as a from gn where id not in (select target from ge where kind = 'contains')),
    k as (select a, unnest(range(1, len(a))) as i from roots),
    f as (select distinct case when i > 1 then '__vdir__/' || array_to_string(a[1:i - 1], '/') end as parent, '__vdir__/' || array_to_string(a[1:i], '/') as child, a[i] as child_name, true as is_virtual from k
          union all select '__vdir__/' || array_to_string(a[1:len(a) - 1], '/'), id, name, false from roots where len(a) >= 2)"""


def collapsed_sql(nodes: str, edges: str) -> str:
    """Folders whose parent holds nothing else go into it, from the top of each chain down."""
    return f"""with recursive gn as ({nodes}), ge as ({edges}), {FOLDERS},
    lone as (select parent, min(child) as child from f where parent is not null group by parent having count(*) = 1 and bool_and(is_virtual)),
    chain as (select child as top, child as id, child_name as joined from f where is_virtual and child not in (select child from lone)
              union all select chain.top, lone.child, chain.joined || '/' || f.child_name from chain join lone on lone.parent = chain.id join f on f.child = lone.child),
    whole as (select top, arg_max(joined, length(joined)) as joined from chain group by top)
    select coalesce(c.top, f.parent) as parent, f.child, coalesce(w.joined, f.child_name) as child_name, f.is_virtual
    from f left join chain c on c.id = f.parent left join whole w on w.top = f.child where f.child not in (select child from lone)"""


@query("collapsed_folders", collapsed_sql(X.CATALOG_NODES, X.CATALOG_EDGES))
def _collapsed(spark: SparkSession, d: str) -> DataFrame:
    return V.collapse_chains(V.virtual_folders(X.catalog(spark, d)))


# Files of customers and nations below one folder each, so that chains do collapse.
DEEP_NODES = """select concat('c', c_custkey) as id, c_name as name, 'class' as kind, concat('all/of/n', c_nationkey, '/only/c.tbl') as file, c_custkey as line, false as is_external, cast(null as string) as docstring from customer
union all select concat('n', n_nationkey), n_name, 'class', 'all/of/nations.tbl', cast(1 as bigint), false, cast(null as string) from nation where n_nationkey < 0"""
NO_EDGES = "select id as source, id as target, 'contains' as kind from (select cast(null as string) as id) x where id is not null"


@query("collapsed_chains", collapsed_sql(DEEP_NODES, NO_EDGES))
def _collapsed_chains(spark: SparkSession, d: str) -> DataFrame:
    return V.collapse_chains(V.virtual_folders(Graph(X.sql(spark, d, DEEP_NODES), X.sql(spark, d, NO_EDGES))))


# V7 with every flag, V14, callees.
query("valid_callees", f"with {LINKS} select distinct path, path <> '' and octet_length(encode(path)) < 64 and not regexp_matches(path, '[()]') as valid from u")(
    lambda spark, d: X.links(spark, d).select("path").distinct().select("path", S.is_valid_callee(F.col("path")).alias("valid"))
)

# Kinds of events as changes: what a user viewed is new, what was bought is gone; borders of cycles, orphans and others.
MOVED_TO = "case when id like '%view%' then 'added' when id like '%purchase%' then 'removed' else 'kept' end"
query(
    "display_colors",
    f"""{scc_sql(X.USER_MOVES)}, gn as ({X.endpoints(X.USER_MOVES)} union select concat('u', c_custkey) from customer)
    select id, case {MOVED_TO} when 'added' then '{S.ADDED}' when 'removed' then '{S.REMOVED}' else '{S.PAGE_COLORS["function"]}' end as background,
    case when id in (select id from m) then '{S.CYCLE_BORDER}' else 'darker' end as border,
    cast(case when id in (select id from m) then 3 when id not in (select source from ge union select target from ge) then 2 else 1 end as bigint) as border_width from gn""",
)(lambda spark, d: _display_colors(X.of_edges(spark, d, X.USER_MOVES, "select concat('u', c_custkey) as id from customer")))


def _display_colors(g: Graph) -> DataFrame:
    shown = V.display_nodes(g, A.cycle_nodes(g), A.orphans(g), g.nodes.select("id", F.expr(MOVED_TO).alias("change")))
    return shown.select("id", "background", F.when(F.col("border") == S.CYCLE_BORDER, F.col("border")).when(F.col("border") != F.col("background"), "darker").alias("border"), "border_width")



FLAGGED = f"""{scc_sql(X.TRADE)}, gn as ({X.endpoints(X.TRADE)}),
    x as (select id, id in (select id from m) as in_cycle, id not in (select source from ge union select target from ge) as is_orphan, case when id in ('n1', 'n2') then 'added' when id = 'n3' then 'removed' else 'kept' end as change from gn)
    select id, in_cycle, is_orphan, change from x"""


@query("display_flags", FLAGGED)
def _flags(spark: SparkSession, d: str) -> DataFrame:
    g = X.trade(spark, d)
    change = F.when(F.col("id").isin("n1", "n2"), "added").when(F.col("id") == "n3", "removed").otherwise("kept")
    shown = V.display_nodes(g, A.cycle_nodes(g), A.orphans(g), g.nodes.select("id", change.alias("change")))
    return shown.select("id", "in_cycle", "is_orphan", "change")


catalog_query("filter_fs", "select * from gn where file like 'geo/r1%'")(lambda g: V.filter_fs(g, "geo/r1"))
