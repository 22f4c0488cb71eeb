"""TypeScript and JavaScript: statements recognised on a bracket tree."""

from __future__ import annotations

from .base import Facts, Token, lex, nest, skip_angles

# Modifiers, words that open a statement, and signs after or before which a statement goes on.
MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "get", "set", "accessor"}
CONTROL = {"if", "for", "while", "do", "try", "catch", "finally", "else", "switch", "with"}
GOES_ON_AFTER = {"=", ",", ".", "?.", "+", "-", "*", "/", "&&", "||", "?", ":", "=>", "(", "<", "&", "|", "==", "!=", "+=", "-=", "extends", "implements", "await", "return", "new", "of", "in", "typeof", "from", "import", "as"}
GOES_ON_BEFORE = {"=", ",", ".", "?.", "+", "*", "/", "&&", "||", "?", ":", "=>", "<", ">", "&", "|", "==", "!=", "+=", "-=", "extends", "implements", "of", "in", "instanceof", "as", "from"}


def module_id(rel: str) -> str:
    m = rel.replace("\\", "/")
    for end in (".tsx", ".ts", ".jsx", ".js"):
        m = m.removesuffix(end)
    return m


def statements(ts: list[Token]) -> list[list[Token]]:
    """Split by ``;`` and by line ends where the next line cannot go on."""
    out: list[list[Token]] = []
    cur: list[Token] = []
    for t in ts:
        if t.text == ";" and t.kind == "sign":
            out.append(cur)
            cur = []
            continue
        if cur:
            last = cur[-1]
            end_line = last.line + (0 if last.kind != "group" and last.kind != "string" else _lines(last))
            done = last.is_group("{") and _closes(cur, t)
            fresh = t.line > end_line and last.text not in GOES_ON_AFTER and t.text not in GOES_ON_BEFORE and not t.is_group("{")
            if done or (fresh and not (t.kind == "group" and t.text in "([" and last.kind != "group")):
                out.append(cur)
                cur = []
        cur.append(t)
    out.append(cur)
    return [s for s in out if s]


def _lines(t: Token) -> int:
    return t.inside[-1].line - t.line + (_lines(t.inside[-1]) if t.inside and t.inside[-1].kind == "group" else 0) if t.inside else t.text.count("\n")


def _closes(cur: list[Token], following: Token) -> bool:
    """Whether the braces that end ``cur`` end a statement."""
    words = [t.text for t in cur if t.kind == "word" and t.text not in MODIFIERS]
    if words and words[0] in ("class", "interface", "enum", "function", "namespace", "module"):
        return True
    return bool(words) and words[0] in CONTROL


class _Parser:
    def __init__(self, source: str, facts: Facts):
        self.s, self.f = source, facts

    def module(self, ts: list[Token]) -> None:
        m = self.f.module_id
        for st in statements(ts):
            line, i = st[0].line, 0
            while i < len(st) and st[i].text in MODIFIERS and st[i].kind == "word":
                i += 1
            if i >= len(st):
                continue
            rest, word = st[i:], st[i].text
            if word == "class" and len(rest) > 1:
                self.class_(rest, line)
            elif word == "interface" and len(rest) > 1:
                id_ = self.f.node(f"{m}/{rest[1].text}", rest[1].text, "class", line, None, m)
                self.extends(id_, rest, commas=True)
            elif word == "type" and len(rest) > 2 and rest[1].kind == "word":
                self.f.node(f"{m}/{rest[1].text}", rest[1].text, "class", line, None, m)
            elif word == "enum" or (word == "const" and len(rest) > 1 and rest[1].text == "enum"):
                name = rest[1 if word == "enum" else 2].text
                self.f.node(f"{m}/{name}", name, "struct", line, None, m)
            elif word == "function":
                name = next((t.text for t in rest[1:] if t.kind == "word"), None)
                body = next((t for t in reversed(rest) if t.is_group("{")), None)
                if name and not (rest[1].kind == "group"):
                    id_ = self.f.node(f"{m}/{name}", name, "function", line, None, m)
                    if body:
                        self.calls(body.inside, id_, None)
            elif word in ("const", "let", "var"):
                self.variables(rest, line)
            elif word == "import":
                self.import_(rest)
            elif word not in CONTROL and word not in ("return", "throw") and i == 0:
                self.call(rest, m, None)

    def extends(self, id_: str, ts: list[Token], commas: bool = False) -> None:
        at = next((k for k, t in enumerate(ts) if t.text == "extends"), None)
        if at is None:
            return
        k = at + 1
        while k < len(ts) and not ts[k].is_group("{") and ts[k].text != "implements":
            if ts[k].kind == "word" and (ts[k - 1].text in ("extends", ",")):
                if not (k + 1 < len(ts) and ts[k + 1].text == "."):
                    self.f.add("inherits", id_, ts[k].text)
                if not commas:
                    return
            k = max(k + 1, skip_angles(ts, k))

    def class_(self, ts: list[Token], line: int) -> None:
        m, name = self.f.module_id, ts[1].text
        id_ = self.f.node(f"{m}/{name}", name, "class", line, None, m)
        self.extends(id_, ts)
        body = next((t for t in ts if t.is_group("{")), None)
        if body:
            self.members(body.inside, id_)

    def members(self, ts: list[Token], cls: str) -> None:
        i = 0
        while i < len(ts):
            if ts[i].text in (";", ","):
                i += 1
                continue
            while ts[i].text == "@" and i + 2 < len(ts):
                i += 2
                if i < len(ts) and ts[i].is_group("("):
                    i += 1
            line = ts[i].line
            while i + 1 < len(ts) and ts[i].text in MODIFIERS | {"*"} and (ts[i + 1].kind in ("word", "string") or ts[i + 1].text in ("*", "[")):
                i += 1
            name = ts[i] if ts[i].kind == "word" else None
            i = skip_angles(ts, i + 1)
            while i < len(ts) and ts[i].text in ("?", "!"):
                i += 1
            body = None
            if i < len(ts) and ts[i].is_group("("):
                i += 1
                while i < len(ts) and not ts[i].is_group("{") and ts[i].text != ";" and not (ts[i].line > ts[i - 1].line and ts[i - 1].text not in GOES_ON_AFTER and ts[i].text not in GOES_ON_BEFORE):
                    i += 1
                if i < len(ts) and ts[i].is_group("{"):
                    body = ts[i]
                    i += 1
            else:
                while i < len(ts) and ts[i].text != ";" and not (ts[i].line > ts[i - 1].line + _lines(ts[i - 1]) and ts[i - 1].text not in GOES_ON_AFTER and ts[i].text not in GOES_ON_BEFORE):
                    i += 1
            if name is None:
                i = max(i, 1)
                continue
            if name.text == "constructor":
                if body:
                    self.calls(body.inside, cls, cls)
                continue
            id_ = self.f.node(f"{cls}::{name.text}", name.text, "method", line, None, cls)
            if body:
                self.calls(body.inside, id_, cls)

    def variables(self, ts: list[Token], line: int) -> None:
        m = self.f.module_id
        at = next((k for k, t in enumerate(ts) if t.text == "="), None)
        if at is None or ts[1].kind != "word":
            return
        value = ts[at + 1 :]
        arrow = next((k for k, t in enumerate(value) if t.text == "=>"), None)
        head = [t.text for t in value[:2]]
        if arrow is not None or "function" in head:
            id_ = self.f.node(f"{m}/{ts[1].text}", ts[1].text, "function", line, None, m)
            body = next((t for t in (value[arrow + 1 :] if arrow is not None else value) if t.is_group("{")), None)
            if body:
                self.calls(body.inside, id_, None)

    def import_(self, ts: list[Token]) -> None:
        source = next((t.text.strip("\"'") for t in reversed(ts) if t.kind == "string"), "")
        if not source:
            return
        path = source
        if source.startswith("."):
            parent, tail = self.f.module_id.rpartition("/")[0], source
            while tail.startswith("./"):
                tail = tail[2:]
            path = f"{parent}/{tail}" if parent else tail
        names: list[tuple[str, str]] = []
        k = 1
        while k < len(ts) and ts[k].text != "from" and ts[k].kind != "string":
            if ts[k].is_group("{"):
                part: list[str] = []
                for t in [*ts[k].inside, Token("sign", ",", 0, 0, 0)]:
                    if t.text == ",":
                        part = [p for p in part if p not in ("type", "as")] or part
                        if part:
                            names.append((part[-1], part[0]))
                        part = []
                    elif t.kind == "word":
                        part.append(t.text)
            elif ts[k].text == "*" and k + 2 < len(ts):
                names.append((ts[k + 2].text, "*"))
                k += 2
            elif ts[k].kind == "word" and ts[k].text != "type":
                names.append((ts[k].text, ts[k].text))
            k += 1
        if not names:
            self.f.add("import", path, path)
        for local, name in names:
            self.f.add("import", local, path if name == "*" else f"{path}/{name}")

    # ---- calls ----

    def calls(self, ts: list[Token], id_: str, cls: str | None) -> None:
        for st in statements(ts):
            self.statement(st, id_, cls)

    def statement(self, st: list[Token], id_: str, cls: str | None) -> None:
        word = st[0].text if st[0].kind == "word" else ""
        if word in CONTROL:
            k = 1
            while k < len(st) and (st[k].is_group("(") or st[k].text in ("await", *CONTROL) and st[k].kind == "word"):
                k += 1
            rest = st[k:]
            if rest and rest[0].is_group("{"):
                self.calls(rest[0].inside, id_, cls)
                if rest[1:]:
                    self.statement(rest[1:], id_, cls)
            elif rest:
                self.statement(rest, id_, cls)
        elif st[0].is_group("{"):
            self.calls(st[0].inside, id_, cls)
            if st[1:]:
                self.statement(st[1:], id_, cls)
        elif word in ("const", "let", "var"):
            at = next((k for k, t in enumerate(st) if t.text == "="), None)
            if at is not None:
                self.expression(st[at + 1 :], id_, cls)
        elif word == "return":
            self.expression(st[1:], id_, cls)
        else:
            self.expression(st, id_, cls)

    def expression(self, ts: list[Token], id_: str, cls: str | None) -> None:
        arrow = next((k for k, t in enumerate(ts) if t.text == "=>"), None)
        if arrow is not None and arrow + 1 < len(ts):
            body = ts[arrow + 1]
            if body.is_group("{"):
                self.calls(body.inside, id_, cls)
            else:
                self.expression(ts[arrow + 1 :], id_, cls)
        else:
            self.call(ts, id_, cls)

    def call(self, ts: list[Token], id_: str, cls: str | None) -> None:
        """A call, if the whole expression is one; its arguments are not looked into."""
        while ts and ts[0].text == "await":
            ts = ts[1:]
        if len(ts) < 2 or not ts[-1].is_group("(") or ts[0].text == "new" or any(t.kind == "sign" and t.text not in (".", "?.", "<", ">", ",", "!") for t in ts):
            return
        callee = ts[:-1]
        if callee[-1].text == ">":
            at = next((k for k, t in enumerate(callee) if t.text == "<"), 0)
            callee = callee[:at]
        if len(callee) == 1 and callee[0].kind == "word" and callee[0].text not in ("super", "this", "import", "function"):
            self.f.add("call", id_, callee[0].text, None, cls)
        elif len(callee) >= 3 and callee[-2].text in (".", "?.") and callee[-1].kind == "word":
            plain = len(callee) == 3 and callee[0].kind == "word" and callee[0].text not in ("this", "super")
            self.f.add("call", id_, callee[-1].text, callee[0].text if plain else None, cls)


def _parse(source: str, rel: str, lang: str) -> Facts:
    m = module_id(rel)
    f = Facts(m, rel, lang)
    f.node(m, m.split("/")[-1], "module", 1)
    _Parser(source, f).module(nest(lex(source, "script")[0]))
    return f


def parse_typescript(source: str, rel: str) -> Facts:
    return _parse(source, rel, "typescript")


def parse_javascript(source: str, rel: str) -> Facts:
    return _parse(source, rel, "javascript")
