"""Facts, tokens and bracket trees that the extractors share."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Facts:
    module_id: str
    file: str
    lang: str
    #: (fact, a, b, c, d, line), in order
    rows: list[tuple] = field(default_factory=list)

    def add(self, fact: str, a=None, b=None, c=None, d=None, line=None) -> None:
        self.rows.append((fact, a, b, c, d, line))

    def node(self, id_: str, name: str, kind: str, line: int, doc: str | None = None, parent: str | None = None) -> str:
        self.add("node", id_, name, kind, doc, line)
        if parent is not None:
            self.add("edge", parent, id_, "contains")
        return id_

    def of(self, fact: str) -> list[tuple]:
        return [r[1:5] for r in self.rows if r[0] == fact]

    @property
    def nodes(self) -> dict[str, str]:
        """id -> kind, the first of each id."""
        out: dict[str, str] = {}
        for id_, _, kind, _ in self.of("node"):
            out.setdefault(id_, kind)
        return out


@dataclass
class Token:
    kind: str  # word, number, string, sign, group, directive
    text: str
    line: int
    start: int
    end: int
    inside: list[Token] = field(default_factory=list)

    def is_group(self, opener: str) -> bool:
        return self.kind == "group" and self.text == opener


CLOSERS = {"(": ")", "[": "]", "{": "}"}
_WORD = re.compile(r"[^\W\d]\w*|\$[\w$]*|#(?=[^\W\d])[^\W\d]\w*", re.UNICODE)
_NUMBER = re.compile(r"\d(?:[\w']|\.(?=\d))*")
_SIGNS = ("::", "->", "=>", "?.", "...", "..=", "..", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "++", "--")
_RAW = re.compile(r'(?:br|r|cr)(#*)"')
_RAW_CPP = re.compile(r'(?:u8|u|U|L)?R"([^(\s]{0,16})\(')


def _string_end(s: str, at: int, quote: str) -> int:
    at += 1
    while at < len(s):
        if s[at] == "\\":
            at += 2
        elif s[at] == quote:
            return at + 1
        elif s[at] == "\n" and quote != "`" and quote == "'":
            return at
        elif quote == "`" and s.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(s) and depth:
                if s[at] in "\"'`":
                    at = _string_end(s, at, s[at])
                    continue
                depth += {"{": 1, "}": -1}.get(s[at], 0)
                at += 1
        else:
            at += 1
    return len(s)


def lex(s: str, lang: str) -> tuple[list[Token], dict[int, str]]:
    """Tokens, and the ``///`` comments by line."""
    out: list[Token] = []
    docs: dict[int, str] = {}
    at, line, n = 0, 1, len(s)

    def push(kind: str, end: int) -> None:
        nonlocal at, line
        out.append(Token(kind, s[at:end], line, at, end))
        line += s.count("\n", at, end)
        at = end

    def skip(end: int) -> None:
        nonlocal at, line
        line += s.count("\n", at, end)
        at = end

    while at < n:
        c = s[at]
        if c.isspace():
            skip(at + 1)
        elif s.startswith("//", at):
            end = s.find("\n", at)
            end = n if end < 0 else end
            text = s[at:end]
            if text.startswith("///") and not text.startswith("////"):
                docs[line] = text[3:].strip()
            skip(end)
        elif s.startswith("/*", at):
            depth, end = 1, at + 2
            while end < n and depth:
                if lang == "rust" and s.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                elif s.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
            skip(end)
        elif lang == "cpp" and c == "#" and (not out or out[-1].line < line or out[-1].kind == "directive"):
            end = at
            while True:
                end = s.find("\n", end)
                if end < 0:
                    end = n
                    break
                if s[end - 1] != "\\":
                    break
                end += 1
            push("directive", end)
        elif lang == "rust" and (m := _RAW.match(s, at)):
            end = s.find('"' + m[1], m.end())
            push("string", n if end < 0 else end + 1 + len(m[1]))
        elif lang == "cpp" and (m := _RAW_CPP.match(s, at)):
            end = s.find(f'){m[1]}"', m.end())
            push("string", n if end < 0 else end + 2 + len(m[1]))
        elif c == '"' or (c == "`" and lang == "script"):
            push("string", _string_end(s, at, c))
        elif c == "'":
            if lang == "rust" and not re.match(r"'(?:\\.[^']*|[^\\'])'", s[at : at + 16]):
                at += 1  # a lifetime: its name is of no use here
                if m := _WORD.match(s, at):
                    at = m.end()
            else:
                push("string", _string_end(s, at, c))
        elif lang == "script" and c == "/" and (not out or out[-1].text in ("(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "return", "=>")):
            end, in_set = at + 1, False
            while end < n and s[end] != "\n" and (s[end] != "/" or in_set):
                in_set = {"[": True, "]": False}.get(s[end], in_set)
                end += 2 if s[end] == "\\" else 1
            push("string", min(n, end + 1))
        elif m := _WORD.match(s, at):
            push("word", m.end())
        elif m := _NUMBER.match(s, at):
            push("number", m.end())
        else:
            sign = next((x for x in _SIGNS if s.startswith(x, at)), c)
            push("sign", at + len(sign))
    return out, docs


def nest(tokens: list[Token]) -> list[Token]:
    """Brackets become groups; what does not match is closed where its outer bracket ends."""
    root: list[Token] = []
    stack: list[Token] = []
    level = root
    for t in tokens:
        if t.kind == "sign" and t.text in CLOSERS:
            g = Token("group", t.text, t.line, t.start, t.end)
            level.append(g)
            stack.append(g)
            level = g.inside
        elif t.kind == "sign" and t.text in CLOSERS.values():
            if any(CLOSERS[g.text] == t.text for g in stack):
                while CLOSERS[stack[-1].text] != t.text:
                    stack.pop().end = t.start
                stack.pop().end = t.end
                level = stack[-1].inside if stack else root
        else:
            level.append(t)
    return root


def skip_angles(ts: list[Token], i: int) -> int:
    """The place behind ``<...>`` at ``i``; ``i`` if there is none."""
    if i >= len(ts) or ts[i].text != "<":
        return i
    depth = 0
    while i < len(ts):
        depth += {"<": 1, ">": -1}.get(ts[i].text, 0)
        i += 1
        if depth == 0:
            break
    return i
