"""Sinks: JSON, DOT and a self-contained page."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions import scalars as S
from spandrel.operators.analytics import Analysis, top_coupled
from spandrel.operators.graph import Graph
from spandrel.schema import EDGE_COLUMNS, NODE_COLUMNS
from spandrel.sources.scan import OUTPUTS


def output_dir(root: str, chosen: str = "") -> str:
    """The chosen folder, or the project's if that is blank; made if missing."""
    path = chosen.strip() or root
    os.makedirs(path, exist_ok=True)
    return path


def clean_outputs(folder: str) -> list[str]:
    """Delete what the sinks wrote; the cache stays."""
    gone = []
    for name in sorted(OUTPUTS):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            os.unlink(path)
            gone.append(name)
    return gone


def graph_document(graph: Graph) -> dict:
    row = graph.to_serializable().first().asDict(recursive=True)
    return {"stats": row["stats"], "nodes": row["nodes"] or [], "edges": row["edges"] or []}


def export_json(graph: Graph, out: str) -> None:
    """One pretty document, for graphs of a size that one process holds; see :func:`export_json_lines` for others."""
    with open(out, "w", encoding="utf-8") as f:
        json.dump(graph_document(graph), f, indent=2, ensure_ascii=False)


def export_json_lines(graph: Graph, folder: str) -> None:
    """Nodes and edges as JSON lines, written in parallel."""
    graph.nodes.select(*NODE_COLUMNS).write.mode("overwrite").json(f"{folder}/nodes")
    graph.edges.select(*EDGE_COLUMNS).write.mode("overwrite").json(f"{folder}/edges")


def dot_lines(graph: Graph) -> DataFrame:
    """(part, line): a line per node (part 1) and per edge (part 2)."""
    color = S.node_color(F.col("kind"))
    label = S.escape_dot(F.concat("name", F.lit(" ["), "kind", F.lit("]")))
    node = F.concat(F.lit("    "), S.safe_dot_id(F.col("id")), F.lit(' [label="'), label, F.lit('", color="'), color, F.lit('", style=filled, fillcolor="'), S.lighten(color), F.lit('"];'))
    edge = F.concat(F.lit("    "), S.safe_dot_id(F.col("source")), F.lit(" -> "), S.safe_dot_id(F.col("target")), F.lit(' [label="'), F.col("kind"), F.lit('", color="'), S.edge_color(F.col("kind")), F.lit('"];'))
    return graph.nodes.select(F.lit(1).alias("part"), node.alias("line")).unionByName(graph.edges.select(F.lit(2).alias("part"), edge.alias("line")))


def export_dot(graph: Graph, out: str) -> None:
    head = ["digraph dependencies {", "    rankdir=LR;", '    node [shape=box, fontname="Helvetica"];', '    edge [fontname="Helvetica", fontsize=10];', ""]
    with open(out, "w", encoding="utf-8") as f:
        f.write("\n".join(head) + "\n")
        part = 1
        for r in dot_lines(graph).orderBy("part", "line").toLocalIterator():
            if r["part"] != part:
                f.write("\n")
                part = r["part"]
            f.write(r["line"] + "\n")
        f.write("}\n")


PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Dependency graph</title><style>
body{font:14px sans-serif;margin:0;display:flex;height:100vh}#list{width:26em;overflow:auto;padding:1em;border-right:1px solid #ccc}#main{flex:1;overflow:auto;padding:1em}
li{cursor:pointer}.k{color:#888}.cycle{color:#c00}.orphan{font-style:italic}.added{color:#080}.removed{color:#c00;text-decoration:line-through}
</style></head><body><div id="list"><input id="q" placeholder="search"> <label><input type="checkbox" id="ext" checked> externals</label><ul id="nodes"></ul></div><div id="main"></div>
<script type="application/json" id="data">@DATA@</script>
<script>
const D = JSON.parse(document.getElementById('data').textContent), by = new Map(D.nodes.map(n => [n.id, n]));
const cyc = new Set(D.cycles.flat()), orp = new Set(D.orphans), add = new Set(D.diff.added_nodes), rem = new Set(D.diff.removed_nodes);
const el = (t, s, c) => { const e = document.createElement(t); e.textContent = s; if (c) e.className = c; return e; };
function list() {
  const q = document.getElementById('q').value.toLowerCase(), ext = document.getElementById('ext').checked, ul = document.getElementById('nodes');
  ul.replaceChildren(...D.nodes.filter(n => (ext || !n.is_external) && (n.id + n.name).toLowerCase().includes(q)).slice(0, 2000).map(n => {
    const li = el('li', n.name, [cyc.has(n.id) && 'cycle', orp.has(n.id) && 'orphan', add.has(n.id) && 'added', rem.has(n.id) && 'removed'].filter(Boolean).join(' '));
    li.append(el('span', ' ' + n.kind, 'k')); li.onclick = () => show(n.id); return li; }));
}
function show(id) {
  const n = by.get(id), m = document.getElementById('main'); if (!n) return;
  m.replaceChildren(el('h2', n.id), el('p', n.kind + ' ' + n.file + ':' + n.line), el('pre', n.docstring || ''), el('pre', JSON.stringify(D.metrics[id] || {}, null, 1)));
  for (const [t, a, b] of [['out', 'source', 'target'], ['in', 'target', 'source']]) {
    m.append(el('h3', t)); const ul = el('ul', '');
    D.edges.filter(e => e[a] === id).forEach(e => { const li = el('li', e.kind + ' ' + e[b]); li.onclick = () => show(e[b]); ul.append(li); }); m.append(ul); }
}
document.getElementById('q').oninput = list; document.getElementById('ext').onchange = list; list();
document.getElementById('main').append(el('h2', D.root), el('pre', JSON.stringify(D.stats, null, 1)), el('pre', JSON.stringify(D.top, null, 1)));
</script></body></html>
"""


def _groups(rows: list, key: str) -> list[list[str]]:
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r[key], []).append(r["id"])
    return sorted((sorted(v) for v in out.values()), key=lambda v: (-len(v), v))


def page_data(graph: Graph, analysis: Analysis | None = None, changes: dict[str, DataFrame] | None = None, root: str = "") -> dict:
    """Everything that the page shows."""
    ids = lambda df: sorted(r["id"] for r in df.collect())
    data = graph_document(graph) | {"root": root, "cycles": [], "components": [], "orphans": [], "metrics": {}, "top": [], "diff": {"added_nodes": [], "removed_nodes": [], "added_edges": [], "removed_edges": []}}
    if analysis:
        data["cycles"] = _groups(analysis.cycles.collect(), "cycle_id")
        data["components"] = _groups(analysis.components.collect(), "component_id")
        data["orphans"] = ids(analysis.orphans)
        data["metrics"] = {r["id"]: {"score": r["coupling_score"], "in_degree": r["in_degree"], "out_degree": r["out_degree"], "dit": r["depth_of_inheritance"]} for r in analysis.metrics.collect()}
        data["top"] = [[r["id"], r["coupling_score"]] for r in top_coupled(graph).collect()]
    if changes:
        data["diff"] = {f"{k}_nodes": ids(changes[f"{k}_nodes"]) for k in ("added", "removed")} | {f"{k}_edges": sorted([r["source"], r["target"], r["kind"]] for r in changes[f"{k}_edges"].collect()) for k in ("added", "removed")}
    return data


def export_html(graph: Graph, out: str, analysis: Analysis | None = None, changes: dict[str, DataFrame] | None = None, root: str = "") -> None:
    """A page with its data inside; ``</`` is escaped, so no value can end the script."""
    text = json.dumps(page_data(graph, analysis, changes, root), ensure_ascii=False, sort_keys=True).replace("</", "<\\/").replace("<!--", "<\\u0021--")
    with open(out, "w", encoding="utf-8") as f:
        f.write(PAGE.replace("@DATA@", text))
