import json
import subprocess

import pytest

from spandrel.operators import analytics as A
from spandrel.operators.resolve import build_graph
from spandrel.plans import golden, snippets
from spandrel.sources import cache, export, scan
from spandrel.sources.extract import extract
from spandrel.streaming import watch


@pytest.fixture
def tree(tmp_path):
    for rel, text in {
        "main.py": "import helper\n\nclass Dog:\n    def bark(self):\n        helper.go()\n", "helper.py": "def go():\n    pass\n", "pkg/__init__.py": "", "pkg/_x.py": "A_B = 1\n", ".hidden/h.py": "x = 1\n",
        "target/t.rs": "fn t() {}\n", "node_modules/n.js": "function n() {}\n", ".eslintrc.js": "run();\n", "web/a.ts": "export class Cat {}\nexport function greet() {}\n", "graph.json": "{}", "bad.py": "def (:\n",
    }.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "latin.py").write_bytes(b"def caf\xe9():\n    pass\n")
    return tmp_path


def test_many_files_share_a_frame():
    """Before, every file's facts were a frame of their own, which took most of the time of small files."""
    import pandas as pd

    from spandrel.schema import FACTS

    files = [pd.DataFrame([(f"d{i}.py", "python", i, "h", f"class C{i}:\n    pass\n".encode())], columns=["rel", "lang", "file_seq", "hash", "content"]) for i in range(300)]
    frames = list(scan.facts_of(iter(files)))
    assert len(frames) == 1 and list(frames[0].columns) == [f.name for f in FACTS] and frames[0]["file_seq"].nunique() == 300
    assert list(scan.facts_of(iter([]))) == []


def test_listing(tree):
    rels = [r[1] for r in scan.list_files(str(tree), scan.LANGUAGES)]
    assert rels == [".eslintrc.js", "bad.py", "helper.py", "latin.py", "main.py", "pkg/__init__.py", "pkg/_x.py", "web/a.ts"]
    assert [r[1] for r in scan.list_files(str(tree), ("typescript",))] == ["web/a.ts"]
    assert scan.select_languages() == ("python", "rust")


def test_analyze_and_cache(spark, tree):
    cold = cache.analyze(spark, str(tree), scan.LANGUAGES, use_cache=False)
    ids = {r["id"] for r in cold.nodes.collect()}
    assert {"main", "main.Dog", "main.Dog.bark", "helper.go", "pkg.__init__", "pkg._x.A_B", "bad", "web/a/Cat", "web/a/greet"} <= ids
    edges = {tuple(r) for r in cold.edges.select("source", "target", "kind").collect()}
    assert ("main.Dog.bark", "helper.go", "calls") in edges and ("main", "helper", "imports") in edges
    first = cache.analyze(spark, str(tree), scan.LANGUAGES)
    files = scan.scan(spark, str(tree), scan.LANGUAGES)
    assert cache.incremental_facts(files, cache.Cache(str(tree)).load(spark))[1].count() == 0
    (tree / "helper.py").write_text("def gone():\n    pass\n")
    assert cache.incremental_facts(scan.scan(spark, str(tree), scan.LANGUAGES), cache.Cache(str(tree)).load(spark))[1].count() == 1
    warm = cache.analyze(spark, str(tree), scan.LANGUAGES)
    again = cache.analyze(spark, str(tree), scan.LANGUAGES, use_cache=False)
    for a, b in ((warm.nodes.drop("seq"), again.nodes.drop("seq")), (warm.edges, again.edges)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {tuple(r) for r in first.edges.collect()} == {tuple(r) for r in cold.edges.collect()}


def test_git_diff(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=x", "-c", "user.email=x@example.org", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tree / "helper.py").write_text("def go():\n    pass\n\n\ndef fresh():\n    pass\n")
    _, _, d = cache.git_diff(spark, str(tree), "main", ("python",))
    assert [r["id"] for r in d["added_nodes"].collect()] == ["helper.fresh"] and d["removed_nodes"].count() == 0
    with pytest.raises(subprocess.CalledProcessError):
        scan.list_git(str(tree), "nowhere")


def test_watch_sees_sources_only(tree):
    before = watch.snapshot(str(tree), scan.LANGUAGES)
    (tree / "graph.html").write_text("x")
    assert watch.snapshot(str(tree), scan.LANGUAGES) == before
    (tree / "new.py").write_text("x = 1\n")
    assert len(watch.snapshot(str(tree), scan.LANGUAGES)) == len(before) + 1
    assert list(watch.changes(str(tree), every=0.01, rounds=2)) == []


def test_exports(spark, tree, tmp_path):
    g = cache.analyze(spark, str(tree), use_cache=False)
    out = export.output_dir(str(tree), str(tmp_path / "out"))
    export.export_html(g, f"{out}/graph.html", A.analyze(g), A.diff(g, g), "</script><b>")
    page = (tmp_path / "out/graph.html").read_text()
    data = page.split('id="data">')[1].split("</script>")[0]
    assert json.loads(data.replace("<\\/", "</"))["root"] == "</script><b>"
    export.export_dot(g, f"{out}/g.dot")
    assert (tmp_path / "out/g.dot").read_text().count("->") == g.edges.count()
    export.export_json(g, f"{out}/graph.json")
    assert export.clean_outputs(out) == ["graph.html", "graph.json"]


ONE_LINERS = [
    ("a.ts", "class Foo {}", ("a/Foo", "class")), ("a.ts", "class Foo { bar() {} }", ("a/Foo::bar", "method")), ("a.ts", "interface I { x: number }", ("a/I", "class")), ("a.ts", "enum E { A }", ("a/E", "struct")),
    ("a.ts", "function f() {}", ("a/f", "function")), ("a.ts", "const g = (x: number) => { h(); };", ("a/g", "function")), ("a.js", "function j() {}", ("a/j", "function")), ("a.ts", "type T = string;", ("a/T", "class")),
    ("m/a.py", "X_Y = 1", ("m.a.X_Y", "constant")), ("a.rs", "impl<T> Foo<T> { fn go(&self) {} }", ("a::Foo::go", "method")), ("a.cpp", "int f(int x) { return g(x); }", ("a.cpp/f", "function")),
    ("a.h", "#ifndef A\n#define A\nclass B { void m(); };\n#endif", ("a.h/B::m", "method")),
]


@pytest.mark.parametrize("rel, text, expected", ONE_LINERS)
def test_one_liners(rel, text, expected):
    assert extract(scan.language_of(rel), text, rel).nodes.get(expected[0]) == expected[1]


def test_script_imports_and_bases():
    f = extract("typescript", "import D, { A, B as C } from './x';\nclass K extends L {}\n", "d/a.ts")
    assert f.of("import") == [("D", "d/x/D", None, None), ("A", "d/x/A", None, None), ("C", "d/x/B", None, None)]
    assert ("d/a/K", "L", None, None) in f.of("inherits")


@pytest.mark.parametrize("text", ["", "}}}((", "'", '"', "/*", "`${", "#", "fn", "impl", "class", "import", "template<", "a<b<c", "\0", "use ;", "mod", "export", "x" * 10_000, "(" * 3000])
@pytest.mark.parametrize("lang, rel", [("rust", "a.rs"), ("cpp", "a.cpp"), ("typescript", "a.ts"), ("javascript", "a.js"), ("python", "a.py")])
def test_extractors_survive_anything(text, lang, rel):
    assert extract(lang, text, rel).nodes


def brute_resolve(files):
    """The resolution rules, one reference after the other."""
    nodes, edges = {}, []

    def node(id_, name, kind, ext):
        nodes.setdefault(id_, (name, kind, ext))

    def edge(*e):
        if e[0] in nodes and e[1] in nodes and e not in edges:
            edges.append(e)

    for f in files:
        for r in f.rows:
            if r[0] == "node":
                node(r[1], r[2], r[3], False)
            elif r[0] == "edge":
                edge(r[1], r[2], r[3])
    reg = {}
    for id_, (name, _, _) in nodes.items():
        reg.setdefault(name, []).append(id_)
        if id_.split(".")[-1] != name:
            reg.setdefault(id_.split(".")[-1], []).append(id_)

    def kind_of(name):
        last = name.split("::")[-1].strip()
        if not last:
            return "module"
        if len(last) > 1 and all(c.isupper() or c == "_" or c in "0123456789" for c in last):
            return "constant"
        return "class" if last[0].isupper() else "module" if "::" in name or "." in name else "function"

    def external(short, name):
        node(f"__ext__.{short}", short, kind_of(name), True)
        return f"__ext__.{short}"

    for f in files:
        imports, alias = dict((a, b) for a, b, _, _ in f.of("import")), dict((a, b) for a, b, _, _ in f.of("alias"))
        fields, local = {(a, b): c for a, b, c, _ in f.of("field")}, {(a, b): c for a, b, c, _ in f.of("local")}

        def resolve(name, f=f, imports=imports, alias=alias):
            if imports.get(name) in nodes:
                return imports[name]
            real = alias.get(name, name)
            if c := reg.get(real):
                return c[0] if len(c) == 1 else next((x for x in c if x.startswith(f.module_id)), c[0])
            short = real.split("::")[-1]
            if short != real and (c := [x for x in reg.get(short, []) if not x.startswith("__ext__.")]):
                return c[0]
            return external(short, real)

        for parent, name, _, _ in f.of("mod"):
            if c := reg.get(name):
                edge(parent, next((x for x in c if nodes[x][1] == "module" and not nodes[x][2]), c[0]), "contains")
        for kind in ("inherits", "uses_type"):
            for a, b, _, _ in f.of(kind):
                edge(a, resolve(b), kind)
        for caller, callee, obj, cls in f.of("call"):
            t = fields.get((cls or "", obj)) or local.get((caller, obj)) if obj else None
            edge(caller, resolve(f"{t}.{callee}" if t else callee), "calls")
        for path in dict.fromkeys(imports.values()):
            short = path.split("::")[-1]
            inside = [x for x in reg.get(short, []) if not x.startswith("__ext__.")]
            if path in nodes:
                edge(f.module_id, path, "imports")
            elif inside:
                edge(f.module_id, inside[0], "imports")
            else:
                edge(f.module_id, external(short, path), "external_dep")
    return nodes, edges


@pytest.mark.parametrize("lang", sorted(snippets.ALL))
def test_resolution(spark, lang):
    files = [extract(scan.language_of(r), t, r) for r, t in sorted(snippets.ALL[lang])]
    nodes, edges = brute_resolve(files)
    g = build_graph(scan.extract_facts(scan.sources_frame(spark, snippets.ALL[lang])))
    assert {(r["id"], r["kind"], r["is_external"]) for r in g.nodes.collect()} == {(i, k, x) for i, (_, k, x) in nodes.items()}
    assert {tuple(r) for r in g.edges.collect()} == set(edges) == set(golden.EDGES[lang])
