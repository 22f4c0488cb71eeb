"""Schemas and closed vocabularies of the dependency graph."""

from __future__ import annotations

from pyspark.sql import types as T

# The kinds of nodes and edges, and the languages.
NODE_KINDS = ("module", "class", "struct", "function", "method", "property", "constant")
EDGE_KINDS = ("contains", "imports", "inherits", "calls", "uses_type", "external_dep", "field_type")
LANGUAGES = ("python", "rust", "cpp", "typescript", "javascript")
EXTERNAL = "__ext__."

_s, _l, _b = T.StringType(), T.LongType(), T.BooleanType()

NODES = T.StructType(
    [
        T.StructField("id", _s, False), T.StructField("name", _s, False), T.StructField("kind", _s, False), T.StructField("file", _s, False),
        T.StructField("line", _l, False), T.StructField("is_external", _b, False), T.StructField("docstring", _s, True),
    ]
)
EDGES = T.StructType([T.StructField("source", _s, False), T.StructField("target", _s, False), T.StructField("kind", _s, False)])
STATS = ("node_count", "edge_count", *(f"{k}_count" for k in NODE_KINDS), "external_count")
GRAPH_JSON = T.StructType([T.StructField("stats", T.MapType(_s, _l)), T.StructField("nodes", T.ArrayType(NODES)), T.StructField("edges", T.ArrayType(EDGES))])

#: What an extractor says about a file: one row per fact, in order. ``a``, ``b``, ``c``, ``d`` depend on ``fact``:
#: node (id, name, kind, docstring; line), edge (source, target, kind), mod (parent, name), inherits (child, parent),
#: uses_type (user, type), call (caller, callee, object, class), import (local, path), alias (alias, real),
#: local (scope, variable, type), field (class, attribute, type), error (message).
FACTS = T.StructType(
    [
        T.StructField("file_seq", _l, False), T.StructField("seq", _l, False), T.StructField("module_id", _s, False), T.StructField("file", _s, False), T.StructField("lang", _s, False),
        T.StructField("hash", _s, True), T.StructField("fact", _s, False), T.StructField("a", _s, True), T.StructField("b", _s, True), T.StructField("c", _s, True), T.StructField("d", _s, True), T.StructField("line", _l, True),
    ]
)
NODE_COLUMNS = [f.name for f in NODES]
EDGE_COLUMNS = [f.name for f in EDGES]
