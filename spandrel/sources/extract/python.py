"""Python: the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

from .base import Facts

_QUOTES = "\"' \t\r\n"


def module_id(rel: str) -> str:
    return rel.removesuffix(".py").replace("/", ".").replace("\\", ".").lstrip(".")


def _text(node: ast.AST, source: str) -> str:
    return ast.get_source_segment(source, node) or ast.unparse(node)


def _string(stmts: list[ast.stmt]) -> str | None:
    for s in stmts:
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            return s.value.value.strip(_QUOTES)
    return None


class _Walker:
    def __init__(self, source: str, facts: Facts):
        self.source, self.f = source, facts

    # ---- module level ----

    def module(self, tree: ast.Module) -> None:
        m = self.f.module_id
        for s in tree.body:
            if isinstance(s, ast.Import):
                for a in s.names:
                    if a.asname:
                        self.f.add("alias", a.asname, a.name)
                        self.f.add("import", a.asname, a.name)
                    else:
                        self.f.add("import", a.name, a.name)
            elif isinstance(s, ast.ImportFrom):
                self.import_from(s)
            elif isinstance(s, ast.ClassDef):
                self.class_(s)
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                self.function(s, None, None)
            elif isinstance(s, ast.Assign | ast.AnnAssign):
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if isinstance(t, ast.Name) and len(t.id.encode()) > 1 and all(c.isupper() or c == "_" for c in t.id):
                        self.f.node(f"{m}.{t.id}", t.id, "constant", s.lineno, None, m)

    def import_from(self, s: ast.ImportFrom) -> None:
        base = s.module or ""
        if s.level:
            parts = self.f.module_id.split(".")
            up = ".".join(parts[: max(0, len(parts) - s.level)])
            base = f"{up}.{base}" if base else up
        names = [a for a in s.names if a.name != "*"]
        if not names:
            self.f.add("import", base, base)
        for a in names:
            self.f.add("import", a.asname or a.name, f"{base}.{a.name}")

    # ---- classes ----

    def class_(self, s: ast.ClassDef) -> None:
        m = self.f.module_id
        id_ = self.f.node(f"{m}.{s.name}", s.name, "class", s.lineno, _string(s.body), m)
        for b in s.bases:
            if isinstance(b, ast.Name | ast.Attribute):
                self.f.add("inherits", id_, _text(b, self.source))
        data = any("dataclass" in d for d in self.decorators(s))
        for x in s.body:
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                self.function(x, id_, None)
            elif data and isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                kind = _text(x.annotation, self.source)
                self.f.add("field", id_, x.target.id, kind)
                self.f.add("uses_type", id_, kind)

    def decorators(self, s) -> list[str]:
        return [_text(d, self.source).strip() for d in s.decorator_list]

    # ---- functions ----

    def function(self, s, cls: str | None, outer: str | None) -> None:
        m = self.f.module_id
        id_ = f"{cls or outer or m}.{s.name}"
        marks = self.decorators(s)
        kind = "property" if any(d == "property" or d.endswith((".getter", ".setter")) for d in marks) else "method" if cls else "function"
        self.f.node(id_, s.name, kind, s.lineno, _string(s.body[:1]), cls or outer or m)
        if s.returns is not None and (text := _text(s.returns, self.source)) != "None":
            self.f.add("uses_type", id_, text)
        for a in [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs]:
            if a.annotation is not None and a.arg not in ("self", "cls"):
                text = _text(a.annotation, self.source)
                self.f.add("local", id_, a.arg, text)
                self.f.add("uses_type", id_, text)
        self.body(s.body, id_, cls)

    def body(self, stmts: list[ast.stmt], id_: str, cls: str | None) -> None:
        for s in stmts:
            if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                self.function(s, cls, id_)
            elif isinstance(s, ast.Expr):
                value = s.value.value if isinstance(s.value, ast.Await) else s.value
                if isinstance(value, ast.Call):
                    self.call(value, id_, cls)
            elif isinstance(s, ast.Assign):
                for t in s.targets:
                    if isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Name | ast.Attribute):
                        self.typed(t, _text(s.value.func, self.source), id_, cls)
            elif isinstance(s, ast.AnnAssign):
                self.typed(s.target, _text(s.annotation, self.source), id_, cls)
            elif isinstance(s, ast.If | ast.For | ast.AsyncFor | ast.While | ast.With | ast.AsyncWith | ast.Try | ast.TryStar):
                for part in ("body", "orelse", "finalbody"):
                    self.body(getattr(s, part, []), id_, cls)
                for h in getattr(s, "handlers", []):
                    self.body(h.body, id_, cls)

    def call(self, c: ast.Call, id_: str, cls: str | None) -> None:
        if isinstance(c.func, ast.Name):
            self.f.add("call", id_, c.func.id, None, cls)
        elif isinstance(c.func, ast.Attribute):
            self.f.add("call", id_, c.func.attr, _text(c.func.value, self.source), cls)

    def typed(self, target: ast.expr, kind: str, id_: str, cls: str | None) -> None:
        if isinstance(target, ast.Name):
            self.f.add("local", id_, target.id, kind)
            self.f.add("uses_type", id_, kind)
        elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and cls:
            self.f.add("field", cls, target.attr, kind)
            self.f.add("uses_type", cls, kind)


def parse(source: str, rel: str) -> Facts:
    m = module_id(rel)
    f = Facts(m, rel, "python")
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        f.node(m, m.split(".")[-1], "module", 1)
        f.add("error", re.sub(r"\s+", " ", str(e)))
        return f
    f.node(m, m.split(".")[-1], "module", 1, _string(tree.body[:1]))
    _Walker(source, f).module(tree)
    return f
