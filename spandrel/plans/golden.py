"""What the snippets contain. Nodes and references were listed by the extractors and reviewed against the rules by eye; the
edges come from the plain resolver in the tests, which shares no code with the joins."""

from __future__ import annotations


def literal(v) -> str:
    """A value as SQL."""
    if v is None:
        return "cast(null as varchar)"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


#: query -> (function, [(input, output)])
SCALARS = {
    "infer_external_kind": ("infer_external_kind", [("", "module"), ("os", "function"), ("os.path", "module"), ("react/useState", "function"), ("typing.List", "module"), ("std::io", "module"), ("std::HashMap", "class"), ("SOME_CONSTANT", "constant"), ("MyClass", "class"), ("some_function", "function"), ("A", "class"), ("a::B2", "constant"), ("É", "constant"), ("École", "class"), ("9", "function"), ("_X", "constant")]),
    "module_id_python": ("module_id_python", [("app.py", "app"), ("pkg/mod.py", "pkg.mod"), ("pkg/__init__.py", "pkg.__init__"), ("a\\b.py", "a.b"), ("./x.py", "x"), (".hidden/y.py", "hidden.y")]),
    "module_id_rust": ("module_id_rust", [("src/lib.rs", "lib"), ("src/a/mod.rs", "a"), ("crates/x/src/y.rs", "crates::x::y"), ("main.rs", "main"), ("a/main.rs", "a"), ("mysrc/a.rs", "mya")]),
    "module_id_ts": ("module_id_typescript", [("index.ts", "index"), ("src/App.tsx", "src/App"), ("a.js.ts", "a"), ("b.mjs", "b.mjs"), ("c.cjs", "c.cjs"), ("d\\e.jsx", "d/e")]),
    "module_id_cpp": ("module_id_cpp", [("a.h", "a.h"), ("src\\b.cpp", "src/b.cpp")]),
    "top_level": ("top_level", [("a::b.c", "a"), ("a.b::c", "a.b"), ("a.b", "a"), ("x", "x")]),
    "short_id": ("short_id", [("a::b", "b"), ("a.b/c", "c"), ("x", "x")]),
    "darken": ("darken", [("#3498DB", "#0c70b3"), ("#000000", "#000000"), ("#ffffff", "#d7d7d7")]),
    "clean_docstring": ("clean_docstring", [("\"\"\" Hi. \"\"\"", "Hi."), ("x", "x")]),
}
NODES = {
    "python": [
        ("pkg.app", "app", "module", 1),
        ("pkg.app.LIMIT", "LIMIT", "constant", 6),
        ("pkg.app.Point", "Point", "class", 9),
        ("pkg.app.Dog", "Dog", "class", 13),
        ("pkg.app.Dog.name", "name", "property", 15),
        ("pkg.app.Dog.bark", "bark", "method", 17),
        ("pkg.app.Dog.nested", "nested", "method", 22),
        ("pkg.app.main", "main", "function", 25),
        ("pkg.util", "util", "module", 1),
        ("pkg.util.helper", "helper", "function", 1),
        ("pkg.broken", "broken", "module", 1),
    ],
    "ts": [
        ("src/index", "index", "module", 1),
        ("src/index/Dog", "Dog", "class", 5),
        ("src/index/Dog::age", "age", "method", 6),
        ("src/index/Dog::bark", "bark", "method", 8),
        ("src/index/Shape", "Shape", "class", 10),
        ("src/index/Id", "Id", "class", 11),
        ("src/index/Color", "Color", "struct", 12),
        ("src/index/add", "add", "function", 13),
        ("src/index/greet", "greet", "function", 14),
        ("src/old", "old", "module", 1),
        ("src/old/Old", "Old", "function", 1),
        ("src/old/f", "f", "function", 2),
    ],
    "rust": [
        ("lib", "lib", "module", 1),
        ("lib::Point", "Point", "struct", 7),
        ("lib::Kind", "Kind", "struct", 8),
        ("lib::Draw", "Draw", "class", 9),
        ("lib::Draw::draw", "draw", "method", 9),
        ("lib::Point::draw", "draw", "method", 11),
        ("lib::inner", "inner", "module", 13),
        ("lib::inner::go", "go", "function", 13),
    ],
    "cpp": [
        ("src/shape.cpp", "shape.cpp", "module", 1),
        ("src/shape.cpp/Circle", "Circle", "class", 4),
        ("src/shape.cpp/Circle::Circle", "Circle", "method", 6),
        ("src/shape.cpp/Circle::area", "area", "method", 7),
        ("src/shape.cpp/Point", "Point", "struct", 9),
        ("src/shape.cpp/Box", "Box", "class", 10),
        ("src/shape.cpp/Box::put", "put", "method", 10),
        ("src/shape.cpp/scale", "scale", "function", 11),
        ("src/shape.cpp/proto", "proto", "function", 12),
    ],
}
REFERENCES = {
    "python": [
        ("import", "os.path", "os.path", None),
        ("alias", "np", "numpy", None),
        ("import", "np", "numpy", None),
        ("import", "h", "pkg.util.helper", None),
        ("import", "Base", "pkg.models.Base", None),
        ("inherits", "pkg.app.Point", "Base", None),
        ("field", "pkg.app.Point", "x", "Coord"),
        ("uses_type", "pkg.app.Point", "Coord", None),
        ("inherits", "pkg.app.Dog", "Base", None),
        ("uses_type", "pkg.app.Dog.name", "str", None),
        ("local", "pkg.app.Dog.bark", "loud", "Volume"),
        ("uses_type", "pkg.app.Dog.bark", "Volume", None),
        ("field", "pkg.app.Dog", "voice", "Voice"),
        ("uses_type", "pkg.app.Dog", "Voice", None),
        ("call", "pkg.app.Dog.bark", "play", "self.voice"),
        ("call", "pkg.app.Dog.bark", "helper", None),
        ("call", "pkg.app.Dog.nested", "other", None),
        ("local", "pkg.app.main", "d", "Dog"),
        ("uses_type", "pkg.app.main", "Dog", None),
        ("call", "pkg.app.main", "bark", "d"),
        ("call", "pkg.app.main", "h", None),
    ],
    "ts": [
        ("import", "React", "react/React", None),
        ("import", "us", "react/useState", None),
        ("import", "path", "path", None),
        ("import", "src/side", "src/side", None),
        ("import", "Cat", "src/animals/Cat", None),
        ("inherits", "src/index/Dog", "Animal", None),
        ("call", "src/index/Dog", "init", None),
        ("call", "src/index/Dog::bark", "say", None),
        ("call", "src/index/Dog::bark", "info", "log"),
        ("inherits", "src/index/Shape", "Base", None),
        ("inherits", "src/index/Shape", "Other", None),
        ("call", "src/index/add", "sum", None),
        ("call", "src/index/greet", "fetchIt", None),
        ("call", "src/index/greet", "log", "console"),
        ("call", "src/index", "run", None),
        ("call", "src/old/Old", "helper", None),
        ("call", "src/old/f", "go", None),
    ],
    "rust": [
        ("import", "Node", "model::Node", None),
        ("import", "model::Node", "model::Node", None),
        ("import", "Edge", "model::Edge", None),
        ("import", "model::Edge", "model::Edge", None),
        ("import", "HashMap", "std::collections::HashMap", None),
        ("import", "std::collections::HashMap", "std::collections::HashMap", None),
        ("mod", "lib", "model", None),
        ("uses_type", "lib::Point", "Owner", None),
        ("uses_type", "lib::Point", "Vec<Tag>", None),
        ("uses_type", "lib::Draw::draw", "Canvas", None),
        ("inherits", "lib::Point", "Draw", None),
        ("uses_type", "lib::Point::draw", "Canvas", None),
        ("call", "lib::Point::draw", "prepare", None),
        ("call", "lib::Point::draw", "new", None),
        ("uses_type", "lib::inner::go", "Result<Node>", None),
        ("call", "lib::inner::go", "ready", None),
        ("call", "lib::inner::go", "step", None),
        ("call", "lib::inner::go", "run", "helper"),
    ],
    "cpp": [
        ("import", "vector", "__ext__.vector", None),
        ("import", "shape.h", "src/shape.h", None),
        ("inherits", "src/shape.cpp/Circle", "Shape", None),
        ("inherits", "src/shape.cpp/Circle", "Base", None),
        ("call", "src/shape.cpp/Circle::area", "compute", None),
        ("call", "src/shape.cpp/scale", "grow", "helper"),
        ("call", "src/shape.cpp/scale", "std::move", None),
        ("call", "src/shape.cpp/scale", "area", None),
    ],
}
#: Edges after resolution.
EDGES = {
    "python": [
        ("pkg.app", "__ext__.numpy", "external_dep"),
        ("pkg.app", "__ext__.os.path", "external_dep"),
        ("pkg.app", "__ext__.pkg.models.Base", "external_dep"),
        ("pkg.app", "pkg.app.Dog", "contains"),
        ("pkg.app", "pkg.app.LIMIT", "contains"),
        ("pkg.app", "pkg.app.Point", "contains"),
        ("pkg.app", "pkg.app.main", "contains"),
        ("pkg.app", "pkg.util.helper", "imports"),
        ("pkg.app.Dog", "__ext__.Base", "inherits"),
        ("pkg.app.Dog", "__ext__.Voice", "uses_type"),
        ("pkg.app.Dog", "pkg.app.Dog.bark", "contains"),
        ("pkg.app.Dog", "pkg.app.Dog.name", "contains"),
        ("pkg.app.Dog", "pkg.app.Dog.nested", "contains"),
        ("pkg.app.Dog.bark", "__ext__.Volume", "uses_type"),
        ("pkg.app.Dog.bark", "__ext__.play", "calls"),
        ("pkg.app.Dog.bark", "pkg.util.helper", "calls"),
        ("pkg.app.Dog.name", "__ext__.str", "uses_type"),
        ("pkg.app.Dog.nested", "__ext__.other", "calls"),
        ("pkg.app.Point", "__ext__.Base", "inherits"),
        ("pkg.app.Point", "__ext__.Coord", "uses_type"),
        ("pkg.app.main", "__ext__.Dog.bark", "calls"),
        ("pkg.app.main", "pkg.app.Dog", "uses_type"),
        ("pkg.app.main", "pkg.util.helper", "calls"),
        ("pkg.util", "pkg.util.helper", "contains"),
    ],
    "ts": [
        ("src/index", "__ext__.path", "external_dep"),
        ("src/index", "__ext__.react/React", "external_dep"),
        ("src/index", "__ext__.react/useState", "external_dep"),
        ("src/index", "__ext__.run", "calls"),
        ("src/index", "__ext__.src/animals/Cat", "external_dep"),
        ("src/index", "__ext__.src/side", "external_dep"),
        ("src/index", "src/index/Color", "contains"),
        ("src/index", "src/index/Dog", "contains"),
        ("src/index", "src/index/Id", "contains"),
        ("src/index", "src/index/Shape", "contains"),
        ("src/index", "src/index/add", "contains"),
        ("src/index", "src/index/greet", "contains"),
        ("src/index/Dog", "__ext__.Animal", "inherits"),
        ("src/index/Dog", "__ext__.init", "calls"),
        ("src/index/Dog", "src/index/Dog::age", "contains"),
        ("src/index/Dog", "src/index/Dog::bark", "contains"),
        ("src/index/Dog::bark", "__ext__.info", "calls"),
        ("src/index/Dog::bark", "__ext__.say", "calls"),
        ("src/index/Shape", "__ext__.Base", "inherits"),
        ("src/index/Shape", "__ext__.Other", "inherits"),
        ("src/index/add", "__ext__.sum", "calls"),
        ("src/index/greet", "__ext__.fetchIt", "calls"),
        ("src/index/greet", "__ext__.log", "calls"),
        ("src/old", "src/old/Old", "contains"),
        ("src/old", "src/old/f", "contains"),
        ("src/old/Old", "__ext__.helper", "calls"),
        ("src/old/f", "__ext__.go", "calls"),
    ],
    "rust": [
        ("lib", "__ext__.Edge", "external_dep"),
        ("lib", "__ext__.HashMap", "external_dep"),
        ("lib", "__ext__.Node", "external_dep"),
        ("lib", "lib::Draw", "contains"),
        ("lib", "lib::Kind", "contains"),
        ("lib", "lib::Point", "contains"),
        ("lib", "lib::inner", "contains"),
        ("lib::Draw", "lib::Draw::draw", "contains"),
        ("lib::Draw::draw", "__ext__.Canvas", "uses_type"),
        ("lib::Point", "__ext__.Owner", "uses_type"),
        ("lib::Point", "__ext__.Vec<Tag>", "uses_type"),
        ("lib::Point", "lib::Draw", "inherits"),
        ("lib::Point", "lib::Point::draw", "contains"),
        ("lib::Point::draw", "__ext__.Canvas", "uses_type"),
        ("lib::Point::draw", "__ext__.new", "calls"),
        ("lib::Point::draw", "__ext__.prepare", "calls"),
        ("lib::inner", "lib::inner::go", "contains"),
        ("lib::inner::go", "__ext__.Result<Node>", "uses_type"),
        ("lib::inner::go", "__ext__.ready", "calls"),
        ("lib::inner::go", "__ext__.run", "calls"),
        ("lib::inner::go", "__ext__.step", "calls"),
    ],
    "cpp": [
        ("src/shape.cpp", "__ext__.__ext__.vector", "external_dep"),
        ("src/shape.cpp", "__ext__.src/shape.h", "external_dep"),
        ("src/shape.cpp", "src/shape.cpp/Box", "contains"),
        ("src/shape.cpp", "src/shape.cpp/Circle", "contains"),
        ("src/shape.cpp", "src/shape.cpp/Point", "contains"),
        ("src/shape.cpp", "src/shape.cpp/proto", "contains"),
        ("src/shape.cpp", "src/shape.cpp/scale", "contains"),
        ("src/shape.cpp/Box", "src/shape.cpp/Box::put", "contains"),
        ("src/shape.cpp/Circle", "__ext__.Base", "inherits"),
        ("src/shape.cpp/Circle", "__ext__.Shape", "inherits"),
        ("src/shape.cpp/Circle", "src/shape.cpp/Circle::Circle", "contains"),
        ("src/shape.cpp/Circle", "src/shape.cpp/Circle::area", "contains"),
        ("src/shape.cpp/Circle::area", "__ext__.compute", "calls"),
        ("src/shape.cpp/scale", "__ext__.grow", "calls"),
        ("src/shape.cpp/scale", "__ext__.move", "calls"),
        ("src/shape.cpp/scale", "src/shape.cpp/Circle::area", "calls"),
    ],
}
