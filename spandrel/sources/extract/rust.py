"""Rust: items recognised on a bracket tree."""

from __future__ import annotations

import re

from .base import Facts, Token, lex, nest, skip_angles

# Built-in types, which are no names, and words that look like callees but are none.
PRIMITIVES = {"u8", "u16", "u32", "u64", "u128", "usize", "i8", "i16", "i32", "i64", "i128", "isize", "f32", "f64", "bool", "char", "str"}
NOT_CALLED = {"if", "while", "for", "match", "return", "in", "let", "loop", "else", "move", "as", "break", "await", "unsafe", "fn", "mut", "ref", "where"}
QUALIFIERS = {"pub", "const", "async", "unsafe", "extern", "default"}


def module_id(rel: str) -> str:
    m = rel.removesuffix(".rs").replace("/", "::").replace("\\", "::").replace("src::", "")
    for end in ("::mod", "::lib", "::main"):
        m = m.removesuffix(end)
    return m


class _Parser:
    def __init__(self, source: str, facts: Facts, docs: dict[int, str]):
        self.s, self.f, self.docs = source, facts, docs

    def doc(self, line: int) -> str | None:
        found, at = [], line - 1
        while at in self.docs:
            found.append(self.docs[at])
            at -= 1
        return "\n".join(reversed(found)) or None

    def items(self, ts: list[Token], module: str, owner: str | None) -> None:
        i = 0
        while i < len(ts):
            start = i
            while i < len(ts) and (ts[i].text in QUALIFIERS or ts[i].kind == "string" or (ts[i].is_group("(") and i > start and ts[i - 1].text == "pub")):
                if ts[i].text == "const" and not (i + 1 < len(ts) and ts[i + 1].text in ("fn", "unsafe", "async", "extern")):
                    break
                i += 1
            word = ts[i].text if i < len(ts) and ts[i].kind == "word" else ""
            line = ts[start].line if start < len(ts) else 0
            end = self._end(ts, i)
            item = ts[i:end]
            if word in ("struct", "enum", "union", "trait") and len(item) > 1:
                self.type_(word, item, line, module)
            elif word == "impl":
                self.impl(item, module)
            elif word == "fn" and len(item) > 1:
                self.function(item, line, module, owner)
            elif word == "use":
                self.use(self.s[ts[i].start : item[-1].end])
            elif word == "mod" and len(item) > 1:
                name = item[1].text
                if item[-1].is_group("{"):
                    child = self.f.node(f"{module}::{name}", name, "module", line, self.doc(line), module)
                    self.items(item[-1].inside, child, None)
                else:
                    self.f.add("mod", module, name)
            i = max(end, i + 1)

    @staticmethod
    def _end(ts: list[Token], i: int) -> int:
        """Behind the item that starts at ``i``: its ``;``, or its braces where no ``=`` came before."""
        value = False
        use = i < len(ts) and ts[i].text == "use"
        while i < len(ts):
            if ts[i].text == ";":
                return i + 1
            value = value or ts[i].text == "="
            if ts[i].is_group("{") and not value and not use:
                return i + 1
            if ts[i].is_group("[") and i and ts[i - 1].text in ("#", "!") and not value:
                return i + 1
            i += 1
        return i

    def type_(self, word: str, item: list[Token], line: int, module: str) -> None:
        name = item[1].text
        id_ = self.f.node(f"{module}::{name}", name, "class" if word == "trait" else "struct", line, self.doc(line), module)
        body = next((t for t in item if t.is_group("{")), None)
        if body is None:
            return
        if word == "trait":
            self.items(body.inside, module, id_)
        elif word == "struct":
            ts, i = body.inside, 0
            while i < len(ts):
                if ts[i].kind == "word" and i + 1 < len(ts) and ts[i + 1].text == ":":
                    end, depth = i + 2, 0
                    while end < len(ts) and not (ts[end].text == "," and depth <= 0):
                        depth += {"<": 1, ">": -1}.get(ts[end].text, 0)
                        end += 1
                    if kind := self.named_type(ts[i + 2 : end]):
                        self.f.add("uses_type", id_, kind)
                    i = end
                i += 1

    def named_type(self, ts: list[Token]) -> str | None:
        """The text of a plain, scoped or generic type; None for references, tuples, slices and built-in ones."""
        if not ts or ts[0].kind != "word" or ts[0].text in ("dyn", "impl", "fn", "unsafe", "extern", "for"):
            return None
        if len(ts) == 1 and ts[0].text in PRIMITIVES:
            return None
        return self.s[ts[0].start : ts[-1].end].strip()

    def impl(self, item: list[Token], module: str) -> None:
        i = skip_angles(item, 1)
        head = [t for t in item[i:] if not t.is_group("{")]
        stop = next((k for k, t in enumerate(head) if t.text == "where"), len(head))
        head = head[:stop]
        at = next((k for k, t in enumerate(head) if t.text == "for"), None)
        kind = head[at + 1 :] if at is not None else head
        base = self.base_name(kind)
        if not base:
            return
        id_ = f"{module}::{base}"
        if at is not None and (trait := self.base_name(head[:at])):
            self.f.add("inherits", id_, trait)
        if item[-1].is_group("{"):
            self.items(item[-1].inside, module, id_)

    @staticmethod
    def base_name(ts: list[Token]) -> str:
        """The last word of a path before its type arguments."""
        name = ""
        for t in ts:
            if t.kind == "word" and t.text not in ("dyn", "mut"):
                name = t.text
            elif t.text == "<":
                break
        return name

    def function(self, item: list[Token], line: int, module: str, owner: str | None) -> None:
        name = item[1].text
        parent = owner or module
        id_ = self.f.node(f"{parent}::{name}", name, "method" if owner else "function", line, self.doc(line), parent)
        body = item[-1] if item[-1].is_group("{") else None
        at = next((k for k, t in enumerate(item) if t.text == "->"), None)
        if at is not None:
            end = next((k for k in range(at, len(item)) if item[k].text in ("where", ";") or item[k].is_group("{")), len(item))
            if kind := self.named_type(item[at + 1 : end]):
                self.f.add("uses_type", id_, kind)
        if body:
            self.calls(body.inside, id_, owner)

    def calls(self, ts: list[Token], id_: str, owner: str | None) -> None:
        for i, t in enumerate(ts):
            if t.is_group("{"):
                self.calls(t.inside, id_, owner)
            if not t.is_group("(") or i == 0 or ts[i - 1].kind != "word":
                j = i - 1
                if not (t.is_group("(") and j >= 0 and ts[j].text == ">"):
                    continue
                depth = 0
                while j >= 0:  # a turbofish
                    depth += {">": 1, "<": -1}.get(ts[j].text, 0)
                    if depth == 0:
                        break
                    j -= 1
                if j < 2 or ts[j - 1].text != "::":
                    continue
                at = j - 2
            else:
                at = i - 1
            name = ts[at].text
            if ts[at].kind != "word" or name in NOT_CALLED or len(name.encode()) >= 64 or (at and ts[at - 1].text == "fn"):
                continue
            if at and ts[at - 1].text == ".":
                plain = at >= 2 and ts[at - 2].kind == "word" and (at < 3 or ts[at - 3].text not in (".", "::"))
                self.f.add("call", id_, name, ts[at - 2].text if plain and ts[at - 2].text != "self" else None, owner)
            else:
                self.f.add("call", id_, name, None, owner)

    def use(self, text: str) -> None:
        path = re.sub(r"^(?:pub\s*(?:\([^)]*\))?\s+)?use\s+", "", text).rstrip().rstrip(";").strip()
        for head in ("crate::", "self::"):
            if path.startswith(head):
                path = path.removeprefix(head)
                break
        if "{" in path:
            head, _, rest = path.partition("{")
            head = head.removesuffix("::")
            for item in rest.split("}")[0].split(","):
                item = item.strip()
                if item and item != "..":
                    self.f.add("import", item, f"{head}::{item}")
                    self.f.add("import", f"{head}::{item}", f"{head}::{item}")
        elif path.endswith("::*"):
            self.f.add("import", path[:-3], path[:-3])
        else:
            self.f.add("import", path.split("::")[-1], path)
            self.f.add("import", path, path)


def parse(source: str, rel: str) -> Facts:
    m = module_id(rel)
    f = Facts(m, rel, "rust")
    f.node(m, m.split("::")[-1], "module", 1)
    tokens, docs = lex(source, "rust")
    _Parser(source, f, docs).items(nest(tokens), m, None)
    return f
