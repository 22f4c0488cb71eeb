"""C++: declarations recognised on a bracket tree."""

from __future__ import annotations

import re

from .base import Facts, Token, lex, nest, skip_angles

# Words before parentheses that are no callees, and words that start what is skipped.
NOT_CALLED = {"if", "for", "while", "switch", "return", "sizeof", "catch", "alignof", "decltype", "noexcept", "throw", "new", "delete", "static_assert", "alignas", "requires", "co_return", "co_await"}
SKIPPED = {"using", "typedef", "friend", "enum", "union", "static_assert", "concept", "extern"}
ACCESS = {"public", "private", "protected"}
_INCLUDE = re.compile(r'#\s*include\s*(?:<([^>]+)>|"([^"]+)")')


def module_id(rel: str) -> str:
    return rel.replace("\\", "/")


class _Parser:
    def __init__(self, facts: Facts):
        self.f = facts
        self.seen: set[str] = set()

    def scope(self, ts: list[Token], parent: str, cls: str | None) -> None:
        i = 0
        while i < len(ts):
            t = ts[i]
            if t.kind == "directive":
                self.include(t.text)
                i += 1
            elif t.text in ACCESS and i + 1 < len(ts) and ts[i + 1].text == ":":
                i += 2
            elif t.text == "template":
                i = skip_angles(ts, i + 1)
            elif t.text == "inline" and i + 1 < len(ts) and ts[i + 1].text == "namespace":
                i += 1
            elif t.text == "namespace" or (t.text == "extern" and i + 1 < len(ts) and ts[i + 1].kind == "string"):
                k = i + 1
                while k < len(ts) and not ts[k].is_group("{") and ts[k].text != ";":
                    k += 1
                if k < len(ts) and ts[k].is_group("{"):
                    self.scope(ts[k].inside, parent, cls)
                i = k + 1
            else:
                end = self._end(ts, i)
                self.declaration(ts[i:end], parent, cls)
                i = max(end, i + 1)

    @staticmethod
    def _end(ts: list[Token], i: int) -> int:
        """Behind the declaration: its ``;``, or a function's braces."""
        called = type_ = False
        while i < len(ts):
            t = ts[i]
            if t.kind == "directive":
                return i
            if t.text == ";":
                return i + 1
            called = called or t.is_group("(")
            type_ = type_ or (t.text in ("class", "struct", "enum", "union") and not called)
            if t.is_group("{"):
                if called and not type_:
                    following = ts[i + 1].text if i + 1 < len(ts) else ""
                    if following not in (",", "{") or ts[i + 1].kind == "word":
                        return i + 1
                elif not type_ and i + 1 < len(ts) and ts[i + 1].text != ";" and not ts[i + 1].text == ",":
                    return i + 1
            i += 1
        return i

    def declaration(self, ts: list[Token], parent: str, cls: str | None) -> None:
        if not ts or ts[0].text in SKIPPED and not (ts[0].text == "extern" and any(t.is_group("(") for t in ts)):
            return
        if ts[0].text in ("class", "struct"):
            body = next((t for t in ts if t.is_group("{")), None)
            paren = next((k for k, t in enumerate(ts) if t.is_group("(")), None)
            if body is not None and (paren is None or ts[paren].start > body.start):
                self.class_(ts, body, parent)
                return
            if paren is None:
                return
        paren = next((k for k, t in enumerate(ts) if t.is_group("(") and k and (ts[k - 1].kind == "word" or ts[k - 1].text in (">", "=", "+", "-", "*", "<", "==", "!="))), None)
        if paren is None or any(t.text == "=" for t in ts[:paren]) and not any(t.text == "operator" for t in ts[:paren]):
            return
        k = paren - 1
        if any(t.text == "operator" for t in ts[:paren]) or ts[k].kind != "word" or ts[k].text in NOT_CALLED:
            return
        name = ("~" if k and ts[k - 1].text == "~" else "") + ts[k].text
        body = ts[-1] if ts[-1].is_group("{") else None
        owner = cls or parent
        id_ = f"{owner}::{name}" if cls else f"{parent}/{name}"
        if body is None and id_ in self.seen:
            return
        self.seen.add(id_)
        self.f.node(id_, name, "method" if cls else "function", ts[0].line, None, owner)
        if body is not None:
            self.calls(body.inside, id_, cls)

    def class_(self, ts: list[Token], body: Token, parent: str) -> None:
        at = next((k for k in range(1, len(ts)) if ts[k].kind == "word" and not ts[k + 1 : k + 2][0].is_group("(") and ts[k].text not in ("final", "alignas")), None)
        if at is None or ts[at].start > body.start:
            return
        name, is_class = ts[at].text, ts[0].text == "class"
        id_ = f"{parent}/{name}"
        self.seen.add(id_)
        self.f.node(id_, name, "class" if is_class else "struct", ts[0].line, None, parent)
        colon = next((k for k, t in enumerate(ts) if t.text == ":" and t.start < body.start), None)
        if is_class and colon is not None:
            part: list[Token] = []
            k = colon + 1
            while k < len(ts):
                if ts[k].text == "," or ts[k] is body:
                    words = [t.text for t in part if t.kind == "word" and t.text not in ACCESS | {"virtual"}]
                    if len(words) == 1:  # qualified bases are not plain names
                        self.f.add("inherits", id_, words[0])
                    part = []
                    if ts[k] is body:
                        break
                    k += 1
                elif ts[k].text == "<":
                    k = skip_angles(ts, k)
                else:
                    part.append(ts[k])
                    k += 1
        self.scope(body.inside, parent, id_)

    def calls(self, ts: list[Token], id_: str, cls: str | None) -> None:
        """Calls that are statements or stand behind ``return``; arguments are not looked into."""
        start = 0
        for i, t in enumerate([*ts, Token("sign", ";", 0, 0, 0)]):
            if t.is_group("{"):
                self.calls(t.inside, id_, cls)
                start = i + 1
            elif t.text == ";" and t.kind == "sign":
                st = ts[start:i]
                while st and (st[0].text in ("return", "else", "do") or (len(st) > 1 and st[0].text in ("if", "for", "while", "switch") and st[1].is_group("("))):
                    st = st[2:] if st[0].text in ("if", "for", "while", "switch") else st[1:]
                self.call(st, id_, cls)
                start = i + 1

    def call(self, st: list[Token], id_: str, cls: str | None) -> None:
        if len(st) < 2 or not st[-1].is_group("("):
            return
        callee = st[:-1]
        if callee[-1].text == ">":
            at = next((k for k in range(len(callee) - 1, -1, -1) if callee[k].text == "<"), 0)
            callee = callee[:at]
        if not callee or callee[-1].kind != "word" or callee[-1].text in NOT_CALLED:
            return
        signs = [t.text for t in callee if t.kind == "sign"]
        if len(callee) == 1:
            self.f.add("call", id_, callee[0].text, None, cls)
        elif signs and all(s == "::" for s in signs) and len(callee) == 2 * len(signs) + 1:
            self.f.add("call", id_, "".join(t.text for t in callee), None, cls)
        elif callee[-2].text in (".", "->") and all(s in (".", "->") for s in signs):
            plain = len(callee) == 3 and callee[0].kind == "word" and callee[0].text != "this"
            self.f.add("call", id_, callee[-1].text, callee[0].text if plain else None, cls)

    def include(self, text: str) -> None:
        if m := _INCLUDE.match(text):
            if m[1]:
                self.f.add("import", m[1], f"__ext__.{m[1]}")
            else:
                self.f.add("import", m[2], f"{self.f.module_id.rpartition('/')[0]}/{m[2]}")


def parse(source: str, rel: str) -> Facts:
    m = module_id(rel)
    f = Facts(m, rel, "cpp")
    f.node(m, m.split("/")[-1], "module", 1)
    _Parser(f).scope(nest(lex(source, "cpp")[0]), m, None)
    return f
