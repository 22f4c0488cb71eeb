"""Name resolution as a chain of ranked joins.

All references of all files go through the same joins at once: imports, aliases, the registry of node names, and the
registry again by the last ``::`` segment; what still has no target names an external node. Order matters only through
explicit columns: ``seq`` of the nodes ranks candidates, ``seq`` of the references decides which one names an external's
kind. References and candidates meet reduced to distinct (module, name) pairs, so a name that is used everywhere is looked
up once per module, and a registry entry with many candidates is first reduced to the best per (module, name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.scalars import infer_external_kind, last_segment
from spandrel.operators.components import checkpoint
from spandrel.operators.graph import Graph, first_nodes, valid_edges
from spandrel.schema import EDGE_COLUMNS, EXTERNAL, NODE_COLUMNS

#: The order in which a file's references are resolved.
PASSES = {"mod": 0, "inherits": 1, "uses_type": 2, "call": 3, "import": 4}


def registry(nodes: DataFrame) -> DataFrame:
    """(key, id, kind, is_external, seq): nodes by name, and by the last dotted segment of the id where it differs."""
    rows = nodes.select(F.col("name").alias("key"), "id", "kind", "is_external", "seq")
    tail = last_segment(F.col("id"), ".")
    return rows.unionByName(nodes.filter(tail != F.col("name")).select(tail.alias("key"), "id", "kind", "is_external", "seq"))


@dataclass
class Names:
    """What files know about names: imports (module_id, local, path), aliases (module_id, alias, real)."""

    imports: DataFrame
    aliases: DataFrame


def asked(refs: DataFrame, names: Names | None = None) -> DataFrame:
    """(module_id, name, path, real, short): what every distinct (module_id, name) is looked up by: the path of its import, its name behind the alias, and that name's last segment."""
    pairs = refs.select("module_id", "name").distinct()
    if names is None:
        pairs = pairs.withColumns({"path": F.lit(None).cast("string"), "real": F.col("name")})
    else:
        path = names.imports.select("module_id", F.col("local").alias("name"), "path")
        alias = names.aliases.select("module_id", F.col("alias").alias("name"), "real")
        pairs = pairs.join(path, ["module_id", "name"], "left").join(alias, ["module_id", "name"], "left").withColumn("real", F.coalesce("real", "name"))
    return pairs.select("module_id", "name", "path", "real", last_segment(F.col("real")).alias("short"))


def answered(pairs: DataFrame, nodes: DataFrame, reg: DataFrame) -> DataFrame:
    """``asked`` with target and kind (only where the target is external).

    In order: an import that names a node; the registry under the aliased name (a single candidate, else the first whose id
    starts with the module's id, else the first); the first internal candidate for the last segment; an external.
    """
    known = nodes.select(F.col("id").alias("path"), F.col("id").alias("hit1"))
    pairs = checkpoint(pairs.join(known, "path", "left").select("module_id", "name", "path", "real", "short", "hit1"))
    counts = reg.groupBy(F.col("key").alias("real")).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.struct("seq", "id")).alias("first"))
    wide = pairs.join(counts, "real", "left")
    # Only names with several candidates need to look at them all. A candidate's id is cut to the lengths that module ids
    # have (one row, as many as the longest id), so name and module meet by equality, and no name's users meet all its nodes.
    many = wide.filter("n > 1").select("real", "module_id").distinct()
    lengths = F.broadcast(many.agg(F.collect_set(F.length("module_id")).alias("lengths")))
    several = reg.select(F.col("key").alias("real"), "id", "seq").join(counts.filter("n > 1").select("real"), "real", "left_semi")
    cut = F.transform(F.filter("lengths", lambda n: n <= F.length("id")), lambda n: F.substr(F.col("id"), F.lit(1), n))
    near = several.crossJoin(lengths).select("real", F.explode(cut).alias("module_id"), "id", "seq")
    near = near.groupBy("real", "module_id").agg(F.min_by("id", F.struct("seq", "id")).alias("near")).join(many, ["real", "module_id"], "left_semi")
    inside = reg.filter(~F.startswith("id", F.lit(EXTERNAL))).groupBy(F.col("key").alias("short")).agg(F.min_by("id", F.struct("seq", "id")).alias("by_short"))
    out = wide.join(near, ["real", "module_id"], "left").join(inside, "short", "left")
    hit = F.coalesce("hit1", "near", "first", F.when(F.col("short") != F.col("real"), F.col("by_short")))
    target = F.coalesce(hit, F.concat(F.lit(EXTERNAL), "short"))
    return out.select("module_id", "name", "path", "real", "short", target.alias("target"), F.when(hit.isNull(), infer_external_kind(F.col("real"))).alias("kind"))


def resolve_names(refs: DataFrame, nodes: DataFrame, names: Names | None = None, reg: DataFrame | None = None) -> DataFrame:
    """(module_id, name, target, kind): a target for every distinct (module_id, name); ``kind`` only where it is external."""
    return answered(asked(refs, names), nodes, registry(nodes) if reg is None else reg).select("module_id", "name", "target", "kind")


def external_nodes(found: DataFrame) -> DataFrame:
    """Nodes for the externals among (target, kind, seq); the first reference decides the kind."""
    ext = found.filter(F.col("kind").isNotNull()).groupBy("target").agg(F.min_by("kind", "seq").alias("kind"), F.min("seq").alias("seq"))
    name = F.substring(F.col("target"), len(EXTERNAL) + 1, 1 << 30)
    return ext.select(
        F.col("target").alias("id"), name.alias("name"), "kind", F.lit("").alias("file"), F.lit(0).cast("long").alias("line"), F.lit(True).alias("is_external"), F.lit(None).cast("string").alias("docstring"), "seq"
    )


def typed_callee(calls: DataFrame, fields: DataFrame, local_types: DataFrame) -> DataFrame:
    """Calls (module_id, caller, callee, object, in_class, seq) with ``name``: ``Type.callee`` if the receiver has a type.

    The class's field comes before the caller's variable.
    """
    f = fields.select("module_id", F.col("scope").alias("in_class"), F.col("variable").alias("object"), F.col("type").alias("field_type"))
    v = local_types.select("module_id", F.col("scope").alias("caller"), F.col("variable").alias("object"), F.col("type").alias("var_type"))
    rows = calls.withColumn("in_class", F.coalesce("in_class", F.lit(""))).join(f, ["module_id", "in_class", "object"], "left").join(v, ["module_id", "caller", "object"], "left")
    kind = F.coalesce("field_type", "var_type")
    return rows.withColumn("name", F.when(kind.isNotNull(), F.concat_ws(".", kind, "callee")).otherwise(F.col("callee")))


def import_targets(imports: DataFrame, nodes: DataFrame, reg: DataFrame | None = None) -> DataFrame:
    """(module_id, path, short, target, edge, kind, seq) of the distinct imported paths of each file.

    A path that is a node is imported; else the first internal node that the last segment names; else it is external.
    """
    reg = registry(nodes) if reg is None else reg
    paths = imports.groupBy("module_id", "path").agg(F.min("seq").alias("seq")).withColumn("short", last_segment(F.col("path")))
    exact = nodes.select(F.col("id").alias("path"), F.lit(True).alias("exact"))
    inside = reg.filter(~F.startswith("id", F.lit(EXTERNAL))).groupBy(F.col("key").alias("short")).agg(F.min_by("id", F.struct("seq", "id")).alias("inside"))
    rows = paths.join(exact, "path", "left").join(inside, "short", "left")
    external = F.col("exact").isNull() & F.col("inside").isNull()
    target = F.when(F.col("exact"), F.col("path")).otherwise(F.coalesce("inside", F.concat(F.lit(EXTERNAL), "short")))
    return rows.select("module_id", "path", "short", target.alias("target"), F.when(external, "external_dep").otherwise("imports").alias("edge"), F.when(external, infer_external_kind(F.col("path"))).alias("kind"), "seq")


def module_targets(mods: DataFrame, nodes: DataFrame, reg: DataFrame | None = None) -> DataFrame:
    """(parent, name, target) of declared modules: the first internal module of that name, else the first node."""
    reg = registry(nodes) if reg is None else reg
    rank = F.struct((~((F.col("kind") == "module") & ~F.col("is_external"))).alias("r"), "seq", "id")
    best = reg.groupBy(F.col("key").alias("name")).agg(F.min_by("id", rank).alias("target"))
    return mods.join(best, "name")


def _facts(facts: DataFrame, fact: str, *names: str) -> DataFrame:
    cols = [F.col(c).alias(n) for c, n in zip("abcd", names, strict=False)]
    return facts.filter(F.col("fact") == fact).select("module_id", *cols, order(facts, fact).alias("seq"))


def order(facts: DataFrame, fact: str) -> Column:
    """Sorts facts as they are taken up: nodes and edges of all files first, then file by file and pass by pass."""
    late = fact in PASSES
    return F.format_string("%d|%020d|%d|%020d", F.lit(int(late)), F.col("file_seq"), F.lit(PASSES.get(fact, 0)), F.col("seq"))


def _last(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """A map's entry is the one written last."""
    return rows.groupBy(*key).agg(F.max_by(value, "seq").alias(value), F.min("seq").alias("seq"))


@dataclass
class Questions:
    """What a set of facts asks: its nodes and their registry, imports and aliases, all references, declared modules."""

    facts: DataFrame
    nodes: DataFrame
    reg: DataFrame
    names: Names
    refs: DataFrame
    mods: DataFrame


@dataclass
class Answers:
    """names: ``answered``; imports: (module_id, path, short, target, edge, kind); mods: (name, target), null where there is no node of that name."""

    names: DataFrame
    imports: DataFrame
    mods: DataFrame


def node_facts(facts: DataFrame) -> DataFrame:
    line = F.col("line").cast("long")
    return facts.filter("fact = 'node'").select(
        F.col("a").alias("id"), F.col("b").alias("name"), F.col("c").alias("kind"), "file", F.coalesce(line, F.lit(0)).alias("line"), F.lit(False).alias("is_external"), F.col("d").alias("docstring"), order(facts, "node").alias("seq")
    )


def questions(facts: DataFrame, resolve_typed_receivers: bool = False) -> Questions:
    """``resolve_typed_receivers``: also look for a method of that class before a typed call goes to an external."""
    nodes = checkpoint(first_nodes(node_facts(facts)))
    imports = _last(_facts(facts, "import", "local", "path"), ["module_id", "local"], "path")
    aliases = _last(_facts(facts, "alias", "alias", "real"), ["module_id", "alias"], "real")
    fields = _last(_facts(facts, "field", "scope", "variable", "type"), ["module_id", "scope", "variable"], "type")
    variables = _last(_facts(facts, "local", "scope", "variable", "type"), ["module_id", "scope", "variable"], "type")
    calls = typed_callee(_facts(facts, "call", "caller", "callee", "object", "in_class"), fields, variables)
    if resolve_typed_receivers:
        methods = nodes.filter("kind in ('method', 'property')").select(F.regexp_replace("id", r"^.*?([^.:/]+)(?:::|\.)([^.:/]+)$", "$1.$2").alias("name"), F.col("id").alias("direct"), "seq")
        methods = methods.groupBy("name").agg(F.min_by("direct", "seq").alias("direct"))
        calls = calls.join(methods, "name", "left")
    else:
        calls = calls.withColumn("direct", F.lit(None).cast("string"))
    pick = lambda df, source, name, kind, direct: df.select("module_id", F.col(source).alias("source"), F.col(name).alias("name"), F.lit(kind).alias("edge"), "seq", direct.alias("direct"))
    none = F.lit(None).cast("string")
    refs = (
        pick(_facts(facts, "inherits", "child", "parent"), "child", "parent", "inherits", none)
        .unionByName(pick(_facts(facts, "uses_type", "user", "type"), "user", "type", "uses_type", none))
        .unionByName(pick(calls, "caller", "name", "calls", F.col("direct")))
    )
    return Questions(facts, nodes, checkpoint(registry(nodes)), Names(imports, aliases), checkpoint(refs), _facts(facts, "mod", "source", "name"))


def named_modules(wanted: DataFrame, nodes: DataFrame, reg: DataFrame) -> DataFrame:
    """(name, target) of wanted names (name)."""
    return wanted.join(module_targets(wanted, nodes, reg), "name", "left")


def answers(q: Questions) -> Answers:
    """Everything resolved."""
    return Answers(checkpoint(answered(asked(q.refs, q.names), q.nodes, q.reg)), checkpoint(import_targets(q.names.imports, q.nodes, q.reg).drop("seq")), checkpoint(named_modules(q.mods.select("name").distinct(), q.nodes, q.reg)))


def assemble(q: Questions, a: Answers) -> Graph:
    """The graph: nodes and edges as found, and an edge for every reference to its answer."""
    found_edges = q.facts.filter("fact = 'edge'").select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("c").alias("kind"), order(q.facts, "edge").alias("seq"))
    edges = valid_edges(found_edges, q.nodes, literal_order=True).select(*EDGE_COLUMNS)
    found = q.refs.join(a.names.select("module_id", "name", "target", "kind"), ["module_id", "name"])
    found = found.select("source", F.coalesce("direct", "target").alias("target"), "edge", F.when(F.col("direct").isNull(), F.col("kind")).alias("kind"), "seq")
    paths = q.names.imports.groupBy("module_id", "path").agg(F.min("seq").alias("seq"))
    brought = paths.join(a.imports, ["module_id", "path"]).select(F.col("module_id").alias("source"), "target", "edge", "kind", "seq")
    mods = q.mods.join(a.mods.filter("target is not null"), "name").select("source", "target", F.lit("contains").alias("kind"))
    every = checkpoint(found.unionByName(brought))
    new = every.select("source", "target", F.col("edge").alias("kind")).unionByName(mods)
    all_nodes = checkpoint(first_nodes(q.nodes.unionByName(external_nodes(every))))
    return Graph(all_nodes.select(*NODE_COLUMNS, "seq"), checkpoint(valid_edges(edges.unionByName(new), all_nodes)))


def build_graph(facts: DataFrame, resolve_typed_receivers: bool = False) -> Graph:
    """The graph of all facts: nodes and edges as found, then every reference resolved."""
    q = questions(facts, resolve_typed_receivers)
    return assemble(q, answers(q))
