"""Column functions: module ids, names, kinds of external symbols, labels and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of nodes and edges in exported drawings, the lighter fills, and the palette of the page.
NODE_COLORS = {"module": "#4A90D9", "class": "#E74C3C", "struct": "#1ABC9C", "function": "#2ECC71", "method": "#F39C12", "property": "#9B59B6", "constant": "#E67E22"}
LIGHT_COLORS = {"#4A90D9": "#AED0F0", "#E74C3C": "#F7B7B2", "#1ABC9C": "#A2DDD6", "#2ECC71": "#A3E9C5", "#F39C12": "#FAD7A0", "#9B59B6": "#D2B4DE", "#E67E22": "#FAD3A2"}
EDGE_COLORS = {"contains": "#BDC3C7", "imports": "#7F8C8D", "inherits": "#9B59B6", "calls": "#3498DB", "uses_type": "#1ABC9C", "external_dep": "#E67E22", "field_type": "#F39C12"}
PAGE_COLORS = {"module": "#3498DB", "class": "#E74C3C", "struct": "#F1C40F", "function": "#2ECC71", "method": "#9B59B6", "property": "#1ABC9C", "constant": "#E67E22"}
SHAPES = {"module": "hexagon", "class": "square", "struct": "diamond", "constant": "triangleDown"}
OTHER_LIGHT, OTHER_NODE, ADDED, REMOVED, CYCLE_BORDER = "#EEEEEE", "#aaa", "#2ECC71", "#E74C3C", "#ff4444"
# How a kind is called, by the language of its file.
KIND_NAMES = {
    "class": {"rs": "trait / enum", "py": "class", "ts": "class / interface", "": "class"},
    "struct": {"rs": "struct / enum", "ts": "enum", "": "struct"},
    "function": {"rs": "fn (libre)", "": "fonction"},
    "method": {"rs": "fn (impl)", "": "méthode"},
    "module": {"rs": "module", "py": "module", "ts": "module TS/JS", "": "fichier"},
}


def lookup(c: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(other))


def last_segment(c: Column, sep: str = "::") -> Column:
    return F.substring_index(c, sep, -1)


# ---- module ids ------------------------------------------------------------------------------------------------------


def module_id_python(path: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"\.py$", ""), "/\\", ".."), r"^\.+", "")


def module_id_rust(path: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(path, r"\.rs$", ""), r"[/\\]", "::")
    p = F.replace(p, F.lit("src::"), F.lit(""))
    for end in ("mod", "lib", "main"):
        p = F.regexp_replace(p, f"::{end}$", "")
    return p


def module_id_typescript(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    for end in ("tsx", "ts", "jsx", "js"):
        p = F.regexp_replace(p, rf"\.{end}$", "")
    return p


def module_id_cpp(path: Column) -> Column:
    return F.translate(path, "\\", "/")


# ---- names and kinds -------------------------------------------------------------------------------------------------


def infer_external_kind(name: Column) -> Column:
    last = F.trim(last_segment(name))
    return (
        F.when(last == "", "module")
        .when((F.octet_length(last) > 1) & last.rlike(r"^[\p{Lu}_0-9]+$"), "constant")
        .when(last.rlike(r"^\p{Lu}"), "class")
        .when(F.contains(name, F.lit("::")) | F.contains(name, F.lit(".")), "module")
        .otherwise("function")
    )


def clean_docstring(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[\"'\s]+", ""), r"[\"'\s]+$", ""))


def is_valid_callee(c: Column) -> Column:
    return (c != "") & (F.octet_length(c) < 64) & ~c.rlike(r"[()]")


def display_kind(kind: Column, file: Column, name: Column) -> Column:
    """A module without a file is shown as what its name looks like."""
    last = F.trim(F.coalesce(name, F.lit("")))
    guess = F.when(last.rlike(r"^[A-Z_][A-Z0-9_]+$"), "constant").when(last.rlike(r"^[A-Z]"), "class").otherwise("function")
    return F.when((kind == "module") & (F.coalesce(file, F.lit("")) == ""), guess).otherwise(kind)


def make_label(id_: Column, kind: Column, name: Column) -> Column:
    """Methods are called by their last two segments."""
    two = lambda sep, rx: F.when(F.size(F.split(id_, rx)) >= 2, F.array_join(F.slice(F.split(id_, rx), -2, 2), "::"))
    parts = F.when(F.contains(id_, F.lit("::")), two("::", "::")).otherwise(two(".", r"\."))
    return F.when(kind == "method", F.coalesce(parts, name)).otherwise(name)


def truncate_label(c: Column, most: int = 30) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def kind_display(kind: Column, file: Column) -> Column:
    ext = F.lower(F.substring_index(F.coalesce(file, F.lit("")), ".", -1))
    lang = F.when(ext.isin("ts", "tsx"), "ts").otherwise(ext)
    out = kind
    for k, names in KIND_NAMES.items():
        out = F.when(kind == k, lookup(lang, {a: b for a, b in names.items() if a}, names[""])).otherwise(out)
    return out


def top_level(id_: Column) -> Column:
    return F.when(F.contains(id_, F.lit("::")), F.substring_index(id_, "::", 1)).otherwise(F.substring_index(id_, ".", 1))


def first_segments(id_: Column, level: int) -> Column:
    """The first ``level`` segments: by ``::`` where the id has any, else by ``.``."""
    return F.when(F.contains(id_, F.lit("::")), F.substring_index(id_, "::", level)).otherwise(F.substring_index(id_, ".", level))


def short_id(id_: Column) -> Column:
    return F.element_at(F.split(id_, r"[.:/\\]+"), -1)


# ---- drawing ---------------------------------------------------------------------------------------------------------


def safe_dot_id(id_: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(id_, r"[^\p{IsAlphabetic}\p{N}]", "_"))


def escape_dot(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit('\\"'))


def node_color(kind: Column) -> Column:
    return lookup(kind, NODE_COLORS, OTHER_NODE)


def lighten(color: Column) -> Column:
    return lookup(color, LIGHT_COLORS, OTHER_LIGHT)


def edge_color(kind: Column) -> Column:
    return lookup(kind, EDGE_COLORS, OTHER_NODE)


def darken(color: Column, by: int = 40) -> Column:
    """Each channel of ``#rrggbb`` less by ``by``, not below 0."""
    channel = lambda at: F.lpad(F.lower(F.hex(F.greatest(F.conv(F.substring(color, at, 2), 16, 10).cast("int") - by, F.lit(0)))), 2, "0")
    return F.concat(F.lit("#"), channel(2), channel(4), channel(6))
