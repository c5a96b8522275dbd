"""A small Java front end: tokens, declarations and statements of one compilation unit, in plain Python.

It reads what the extractors need and keeps expressions as token lists. What it cannot read raises SyntaxProblem.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "transient", "volatile", "default", "strictfp", "sealed", "non-sealed"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
BINARY = {"||", "&&", "|", "^", "&", "==", "!=", "<", ">", "<=", ">=", "<<", "+", "-", "*", "/", "%", "?", ":", *ASSIGN}

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<doc>/\*\*(?!/).*?\*/)|(?P<block>/\*.*?\*/)|(?P<line>//[^\n]*)|(?P<string>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<number>\d[\w.]*|\.\d[\w.]*)|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<op>->|::|\.\.\.|\+\+|--|&&|\|\||==|!=|<=|>=|<<=|<<|[-+*/%&|^]=|[-+*/%&|^!~?:=<>.,;(){}\[\]@])""",
    re.S,
)


class SyntaxProblem(Exception):
    """The text is not what this front end can read."""


@dataclass
class Token:
    kind: str
    text: str
    line: int
    at: int
    end: int


@dataclass
class Statement:
    kind: str
    line: int
    end_line: int
    tokens: list[Token] = field(default_factory=list)  # condition or expression
    parts: list[Statement] = field(default_factory=list)
    other: Statement | None = None  # else, finally
    catches: list[tuple[str, str, Statement]] = field(default_factory=list)  # type, name, body
    cases: list[tuple[str, int, list[Statement]]] = field(default_factory=list)  # label, line, statements
    names: list[tuple[str, str, list[Token]]] = field(default_factory=list)  # declared: type, name, value
    text: str = ""


@dataclass
class Callable:
    name: str
    kind: str  # method or constructor
    returns: str
    params: list[tuple[str, str]]
    annotations: list[tuple[str, list[Token]]]
    doc: str | None
    line: int
    end_line: int
    text: str
    body: Statement | None
    tokens: list[Token]
    comments: list[tuple[str, str]]


@dataclass
class Type:
    name: str
    kind: str  # class, interface, enum, record, annotation
    modifiers: set[str]
    annotations: list[tuple[str, list[Token]]]
    extends: list[str]
    implements: list[str]
    fields: list[str]
    members: list[Callable]
    constants: list[str]
    components: list[tuple[str, str]]
    doc: str | None
    line: int
    end_line: int


@dataclass
class Unit:
    package: str
    imports: dict[str, str]
    types: list[Type]


def render(tokens: list[Token]) -> str:
    """Tokens as text, with one space where there was any between them."""
    out, last = [], None
    for t in tokens:
        if last is not None and t.at > last.end:
            out.append(" ")
        out.append(t.text)
        last = t
    return "".join(out)


class Reader:
    def __init__(self, text: str) -> None:
        self.text, self.all, line, at = text, [], 1, 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxProblem(f"character at line {line}")
            if m.lastgroup != "space":
                self.all.append(Token(m.lastgroup, m[0], line, at, m.end()))
            line += m[0].count("\n")
            at = m.end()
        self.t = [x for x in self.all if x.kind not in ("doc", "block", "line")]
        self.docs = {}  # a token's doc comment, where one ends right before it
        last = None
        for x in self.all:
            if x.kind == "doc":
                last = x
            elif x.kind not in ("block", "line"):
                if last is not None:
                    self.docs[x.at] = last.text
                last = None
        self.i = 0

    # -- tokens

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def take(self, want: str | None = None) -> Token:
        if self.i >= len(self.t) or want is not None and self.t[self.i].text != want:
            raise SyntaxProblem(f"{want or 'more'} expected" + (f" at line {self.t[self.i].line}" if self.i < len(self.t) else " at the end"))
        self.i += 1
        return self.t[self.i - 1]

    def skip(self, text: str) -> bool:
        if self.peek() == text:
            self.i += 1
            return True
        return False

    def nested(self, left: str, right: str) -> list[Token]:
        """The tokens between a pair of brackets, which are taken too."""
        self.take(left)
        begin, depth = self.i, 1
        while depth:
            x = self.take().text
            depth += (x == left) - (x == right)
        return self.t[begin : self.i - 1]

    def until(self, *ends: str) -> list[Token]:
        """Tokens up to one of these outside of brackets; it is not taken."""
        begin, depth = self.i, 0
        while depth or self.peek() not in ends:
            x = self.take().text
            depth += (x in "([{" and x != "") - (x in ")]}" and x != "")
            if depth < 0:
                raise SyntaxProblem("bracket")
        return self.t[begin : self.i]

    def dotted(self) -> str:
        name = self.take().text
        while self.peek() == "." and self.peek(1) and self.peek(1) != "*":
            self.i += 1
            name += "." + self.take().text
        return name

    def type_name(self) -> str:
        """A type as text, generics and brackets included."""
        begin = self.i
        while self.peek() == "@":
            self.annotation()
            begin = self.i
        if self.skip("?"):
            if self.peek() in ("extends", "super"):
                self.i += 1
                self.type_name()
            return render(self.t[begin : self.i])
        if self.take().kind != "name":
            raise SyntaxProblem("type")
        while True:
            if self.peek() == "<":
                self.generics()
            elif self.peek() == "." and self.i + 1 < len(self.t) and self.t[self.i + 1].kind == "name":
                self.i += 2
            elif self.peek() == "[" and self.peek(1) == "]":
                self.i += 2
            else:
                break
        return render(self.t[begin : self.i])

    def generics(self) -> None:
        depth = 0
        while True:
            x = self.take().text
            depth += (x == "<") - (x == ">")
            if x in (";", "{", "(", ")", ""):
                raise SyntaxProblem("generics")
            if not depth:
                return

    def annotation(self) -> tuple[str, list[Token]]:
        self.take("@")
        name = self.dotted()
        return name.rsplit(".", 1)[-1], self.nested("(", ")") if self.peek() == "(" else []

    # -- declarations

    def unit(self) -> Unit:
        package, imports, types = "", {}, []
        while self.peek() == "@" and self.peek(1) != "interface" and self._after_annotations() == "package":
            self.annotation()
        if self.skip("package"):
            package = self.dotted()
            self.take(";")
        while self.skip("import"):
            self.skip("static")
            name = self.dotted()
            if self.skip("."):
                self.take("*")
            self.take(";")
            imports[name.rsplit(".", 1)[-1]] = name
        while self.i < len(self.t):
            if not self.skip(";"):
                self.type_declaration(types)
        return Unit(package, imports, types)

    def _after_annotations(self) -> str:
        back = self.i
        while self.peek() == "@" and self.peek(1) != "interface":
            self.annotation()
        text, self.i = self.peek(), back
        return text

    def modifiers(self) -> tuple[set[str], list[tuple[str, list[Token]]], Token, str | None]:
        first, mods, notes = self.t[self.i] if self.i < len(self.t) else None, set(), []
        if first is None:
            raise SyntaxProblem("declaration expected")
        doc = self.docs.get(first.at)
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                notes.append(self.annotation())
            elif self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")):
                mods.add(self.take().text)
            elif self.peek() == "non" and self.peek(1) == "-":
                self.i += 3
            else:
                return mods, notes, first, doc

    def type_declaration(self, out: list[Type], head=None) -> None:
        mods, notes, first, doc = head or self.modifiers()
        word = self.take().text
        kind = {"class": "class", "interface": "interface", "enum": "enum", "record": "record", "@": "annotation"}.get(word)
        if kind is None:
            raise SyntaxProblem(f"type expected at line {first.line}")
        if kind == "annotation":
            self.take("interface")
        t = Type(self.take().text, kind, mods, notes, [], [], [], [], [], [], doc, first.line, first.line)
        if self.peek() == "<":
            self.generics()
        if kind == "record":
            t.components = self.parameters()
        while self.peek() in ("extends", "implements", "permits"):
            where = {"extends": t.extends, "implements": t.implements, "permits": []}[self.take().text]
            where.append(self.type_name())
            while self.skip(","):
                where.append(self.type_name())
        out.append(t)
        self.take("{")
        if kind == "enum":
            while self.peek() not in (";", "}"):
                self.modifiers()
                t.constants.append(self.take().text)
                if self.peek() == "(":
                    self.nested("(", ")")
                if self.peek() == "{":
                    self.nested("{", "}")
                if not self.skip(","):
                    break
            self.skip(";")
        while self.peek() != "}":
            self.member(t, out)
        t.end_line = self.take("}").line

    def parameters(self) -> list[tuple[str, str]]:
        self.take("(")
        out = []
        while self.peek() != ")":
            self.modifiers()
            kind = self.type_name()
            if self.skip("..."):
                pass
            name = self.dotted()
            while self.skip("["):
                self.take("]")
                kind += "[]"
            if name != "this":
                out.append((kind, name))
            if not self.skip(","):
                break
        self.take(")")
        return out

    def member(self, t: Type, out: list[Type]) -> None:
        if self.skip(";"):
            return
        if self.peek() == "{" or self.peek() == "static" and self.peek(1) == "{":
            self.skip("static")
            self.nested("{", "}")
            return
        head = self.modifiers()
        mods, notes, first, doc = head
        if self.peek() in ("class", "interface", "enum", "@") or self.peek() == "record" and self.peek(2) in ("(", "<"):
            self.type_declaration(out, head)
            return
        if self.peek() == "<":
            self.generics()
        begin = self.i
        if self.peek() == t.name and self.peek(1) in ("(", "{"):  # a constructor, maybe a record's compact one
            name, kind, returns = self.take().text, "constructor", "void"
        else:
            returns = self.type_name()
            name, kind = self.take().text, "method"
            if self.peek() != "(":
                t.fields.append(self._field(returns, begin))
                return
        params = self.parameters() if self.peek() == "(" else t.components
        while self.skip("["):
            self.take("]")
            returns += "[]"
        if self.skip("throws"):
            self.type_name()
            while self.skip(","):
                self.type_name()
        if self.skip("default"):
            self.until(";")
        body, inner, start = None, [], self.i
        if self.peek() == "{":
            body = self.block()
            inner = self.t[start : self.i]
        else:
            self.take(";")
        last = self.t[self.i - 1]
        comments = [(c.kind, c.text) for c in self.all if c.kind in ("line", "block", "doc") and first.at < c.at < last.at]
        t.members.append(Callable(name, kind, returns, params, notes, doc, first.line, last.line, self.text[first.at : last.end], body, inner, comments))

    def _field(self, kind: str, begin: int) -> str:
        """The type of the first variable of a field."""
        first = kind
        while self.skip("["):
            self.take("]")
            first += "[]"
        self.until(";")
        self.take(";")
        return first

    # -- statements

    def block(self) -> Statement:
        first = self.take("{")
        s = Statement("block", first.line, first.line)
        while self.peek() != "}":
            s.parts.append(self.statement())
        s.end_line = self.take("}").line
        return s

    def _close(self, s: Statement, begin: int) -> Statement:
        last = self.t[self.i - 1]
        s.end_line, s.text = last.line, self.text[self.t[begin].at : last.end]
        return s

    def statement(self) -> Statement:
        if self.i >= len(self.t):
            raise SyntaxProblem("statement expected at the end")
        begin, word, line = self.i, self.peek(), self.t[self.i].line
        s = Statement("other", line, line)
        if word == "{":
            return self._close(self.block(), begin)
        if word == "if":
            self.i += 1
            s.kind, s.tokens = "if", self.nested("(", ")")
            s.parts = [self.statement()]
            if self.skip("else"):
                s.other = self.statement()
        elif word == "while":
            self.i += 1
            s.kind, s.tokens, s.parts = "while", self.nested("(", ")"), []
            s.parts = [self.statement()]
        elif word == "do":
            self.i += 1
            s.kind, s.parts = "do", [self.statement()]
            self.take("while")
            s.tokens = self.nested("(", ")")
            self.take(";")
        elif word == "for":
            self.i += 1
            self._for(s)
        elif word == "try":
            self.i += 1
            self._try(s)
        elif word in ("return", "throw") or word == "yield" and self.peek(1) not in ("=", ".", "("):
            self.i += 1
            s.kind, s.tokens = {"yield": "other"}.get(word, word), self.until(";")
            self.take(";")
        elif word == "switch":
            self.i += 1
            s.kind, s.tokens = "switch", self.nested("(", ")")
            self._cases(s)
        elif word == "synchronized" and self.peek(1) == "(":
            self.i += 1
            s.kind, s.tokens = "synchronized", self.nested("(", ")")
            s.parts = [self.block()]
        elif word in ("class", "interface", "enum") or word in ("final", "abstract", "static") and self.peek(1) in ("class", "interface") or word == "record" and self.peek(2) in ("(", "<"):
            s.kind = "local_type"
            self.type_declaration([])
        elif word == ";":
            self.i += 1
            s.kind = "empty"
        elif self.peek(1) == ":" and self.t[self.i].kind == "name" and word not in ("default", "case"):
            self.i += 2
            s.kind, s.parts = "label", [self.statement()]
        elif word in ("break", "continue", "assert"):
            self.until(";")
            self.take(";")
        elif not self._declaration(s):
            s.kind, s.tokens = "expression", self.until(";")
            self.take(";")
        return self._close(s, begin)

    def _declaration(self, s: Statement) -> bool:
        """A local variable statement, if one stands here."""
        back = self.i
        try:
            self.modifiers()
            kind = self.type_name()
            if self.i >= len(self.t) or self.t[self.i].kind != "name" or self.peek() == "instanceof" or self.peek(1) not in ("=", ";", ",", "[", ":"):
                raise SyntaxProblem("no declaration")
            while True:
                name, own = self.take().text, kind
                while self.skip("["):
                    self.take("]")
                    own += "[]"
                value = []
                if self.skip("="):
                    value = self.until(",", ";", ")")
                s.names.append((own, name, value))
                if not self.skip(","):
                    break
            if self.peek() == ":":
                raise SyntaxProblem("a for each")
            self.take(";")
        except SyntaxProblem:
            self.i, s.names = back, []
            return False
        s.kind = "local"
        return True

    def _for(self, s: Statement) -> None:
        inner = self.nested("(", ")")
        depth, semi, colon = 0, [], None
        for k, x in enumerate(inner):
            depth += (x.text in ("(", "[", "{")) - (x.text in (")", "]", "}"))
            if not depth and x.text == ";":
                semi.append(k)
            if not depth and x.text == ":" and colon is None and not semi:
                colon = k
        if not semi and colon is not None:
            s.kind, s.tokens = "foreach", inner[colon + 1 :]
            head = inner[:colon]
            if len(head) < 2:
                raise SyntaxProblem("for each without a variable")
            s.names = [(render(head[:-1]).removeprefix("final "), head[-1].text, [])]
        elif len(semi) == 2:
            s.kind, s.tokens = "for", inner[semi[0] + 1 : semi[1]]
        else:
            raise SyntaxProblem("for")
        s.parts = [self.statement()]

    def _try(self, s: Statement) -> None:
        s.kind = "try"
        if self.peek() == "(":
            self.nested("(", ")")
        s.parts = [self.block()]
        while self.skip("catch"):
            head = [x for x in self.nested("(", ")") if x.text != "final"]
            if len(head) < 2:
                raise SyntaxProblem("catch without a variable")
            s.catches.append((render(head[:-1]), head[-1].text, self.block()))
        if self.skip("finally"):
            s.other = self.block()

    def _cases(self, s: Statement) -> None:
        self.take("{")
        while self.peek() != "}":
            if self.i >= len(self.t):
                raise SyntaxProblem("case expected at the end")
            line = self.t[self.i].line
            if self.skip("default"):
                label = "default"
            else:
                self.take("case")
                label = render(self.until(",", ":", "->"))
                while self.skip(","):
                    self.until(",", ":", "->")
            body: list[Statement] = []
            if self.skip("->"):
                body.append(self.statement())
            else:
                self.take(":")
                while self.peek() not in ("case", "default", "}"):
                    body.append(self.statement())
            s.cases.append((label, line, body))
        self.take("}")


def parse(text: str) -> Unit:
    return Reader(text).unit()


# ---------------------------------------------------------------- expressions


def split_top(tokens: list[Token], at: set[str]) -> list[list[Token]]:
    """Operands between operators outside of brackets; a sign or bracketed generic is no operator."""
    out, depth, last = [[]], 0, None
    for x in tokens:
        if x.text in ("(", "[", "{"):
            depth += 1
        elif x.text in (")", "]", "}"):
            depth -= 1
        if not depth and x.text in at and x.kind == "op" and out[-1] and not (last is not None and last.kind == "op" and last.text not in (")", "]", "}", "++", "--")):
            out.append([])
        else:
            out[-1].append(x)
        last = x
    return [x for x in out if x]


def close_of(tokens: list[Token], i: int) -> int:
    """The index of the bracket that closes the one at i."""
    depth = 0
    for k in range(i, len(tokens)):
        depth += (tokens[k].text in ("(", "[", "{")) - (tokens[k].text in (")", "]", "}"))
        if not depth:
            return k
    return len(tokens) - 1


@dataclass
class Call:
    name: str
    scope: list[Token]
    args: list[list[Token]]
    line: int


def call_of(tokens: list[Token]) -> Call | None:
    """The call that an operand is, or None: [scope .] name ( arguments )."""
    if len(tokens) < 3 or tokens[-1].text != ")":
        return None
    i = 0
    while i < len(tokens):  # the bracket that the last one closes
        if tokens[i].text in ("(", "[", "{"):
            j = close_of(tokens, i)
            if j == len(tokens) - 1:
                break
            i = j
        i += 1
    if i < 1 or i >= len(tokens) or tokens[i - 1].kind != "name" or (i > 1 and tokens[i - 2].text not in (".", ">")) or tokens[0].text == "new" and all(x.text != ")" for x in tokens[:i]):
        return None
    scope = tokens[: i - 1]
    if scope and scope[-1].text == ".":
        scope = scope[:-1]
    return Call(tokens[i - 1].text, scope, split_top(tokens[i + 1 : -1], {","}), tokens[0].line)


def calls(tokens: list[Token]) -> list[Call]:
    """Every call in some tokens, outer ones first."""
    out = []
    for i, x in enumerate(tokens):
        if x.kind == "name" and i + 1 < len(tokens) and tokens[i + 1].text == "(" and x.text not in ("if", "while", "for", "switch", "catch", "synchronized", "return", "throw", "new", "super", "this", "try", "else", "assert"):
            start = i
            while start >= 2 and tokens[start - 1].text == ".":
                k = start - 2
                if tokens[k].text in (")", "]"):
                    depth = 0
                    while k >= 0:
                        depth += (tokens[k].text in (")", "]")) - (tokens[k].text in ("(", "["))
                        if not depth:
                            break
                        k -= 1
                    if k >= 1 and tokens[k - 1].kind == "name":
                        k -= 1
                    if k >= 1 and tokens[k - 1].text == "new":
                        k -= 1
                start = k
            if start >= 1 and tokens[start - 1].text == "new" and start == i:
                continue
            j = close_of(tokens, i + 1)
            scope = tokens[start : i - 1] if start < i else []
            out.append(Call(x.text, scope, split_top(tokens[i + 2 : j], {","}), tokens[start].line))
    return out
