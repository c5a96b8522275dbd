"""Control-flow and data-flow facts of one method, as flat rows.

Control flow is laid out by a cursor, the open end of what has been read: a Way from a node, with the name that its edge will
have. Whatever makes a node draws the Way into it, so an edge is named when it is made. A branch starts with a named Way, a
statement ends with a plain one, and a return or throw ends with Way(EXIT): no merge or loop takes that one up, but a statement
that follows hangs from the exit.

What the rows say in odd cases, each tested by itself:
* a branch that makes no node reaches its merge by an unconditional edge, an empty loop body by its LOOP_BACK edge alone;
* an `else` that makes no node gives its FALSE to the edge that left the condition last;
* an `else` that starts with a `try` gives its FALSE to the edge of the last handler, which keeps its exception type.

Data flow is a stream of definitions and uses, in the order in which the statements give them; the numbers are their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from codeloom.sources import java_syntax as J

EXIT = -1
STATEMENT_CHARS = 80


class Way(NamedTuple):
    """An edge that has left a node and has not met another."""

    src: int
    kind: str = "UNCONDITIONAL"
    condition: str | None = None
    exception: str | None = None


class ControlFlow:
    """Nodes in the order in which they are met, and edges between their numbers; the exit comes last."""

    def __init__(self, method: J.Callable) -> None:
        self.nodes: list[dict] = []
        self._edges: list[tuple[Way, int]] = []
        end = self._statements(method.body.parts if method.body else [], self._node(None, "ENTRY", f"METHOD_ENTRY: {method.name}", method.line))
        self._meet(end, EXIT)
        last = self._node(None, "EXIT", f"METHOD_EXIT: {method.name}", method.end_line).src
        number = lambda n: last if n == EXIT else n
        self.edges = [
            {"ord": k, "src": number(w.src), "dst": number(dst), "edge_type": w.kind, "condition_text": w.condition, "exception_type": w.exception}
            for k, (w, dst) in enumerate(self._edges)
        ]

    # -- laying out

    def _node(self, way: Way | None, kind: str, code: str, line: int, end: int | None = None, **facts) -> Way:
        """A new node at the end of a way; what leaves it plainly."""
        blank = {"condition": None, "called_method": None, "exception_type": None}
        self.nodes.append({"ord": len(self.nodes), "node_type": kind, "code": code, "start_line": line, "end_line": end or line, **blank, **facts})
        here = Way(len(self.nodes) - 1)
        if way is not None:
            self._edges.append((way, here.src))
        return here

    def _meet(self, way: Way, node: int) -> None:
        """Draw a way to a node that exists, unless it has left the method."""
        if way.src != EXIT:
            self._edges.append((way, node))

    def _statements(self, parts: list[J.Statement], way: Way) -> Way:
        for s in parts:
            way = self.LAYOUT.get(s.kind, ControlFlow._other)(self, s, way)
        return way

    def _branch(self, parts: list[J.Statement], start: Way) -> tuple[Way, bool]:
        """(where a branch ends, whether it made a node)."""
        before = len(self.nodes)
        end = self._statements(parts, start)
        made = len(self.nodes) > before
        return (end if made else Way(start.src)), made

    # -- statements

    def _block(self, s: J.Statement, way: Way) -> Way:
        return self._statements(s.parts, way)

    def _choice(self, s: J.Statement, way: Way) -> Way:
        test = J.render(s.tokens)
        head = self._node(way, "CONDITION", f"if ({test})", s.line, condition=test).src
        yes, no = Way(head, "TRUE", test), Way(head, "FALSE", f"!({test})")
        end, _ = self._branch(s.parts, yes)
        merge = self._node(end if end.src != EXIT else None, "STATEMENT", "merge", s.end_line)
        if s.other is not None:
            no, made = self._branch([s.other], no)
            if not made:  # the odd case of an else without a node
                self._name_last(head, "FALSE", f"!({test})")
        self._meet(no, merge.src)
        return merge

    def _name_last(self, src: int, kind: str, condition: str) -> None:
        for k in range(len(self._edges) - 1, -1, -1):
            way, dst = self._edges[k]
            if way.src == src:
                self._edges[k] = (way._replace(kind=kind, condition=condition), dst)
                return

    def _loop(self, s: J.Statement, way: Way) -> Way:
        test, shown, word = J.render(s.tokens), None, s.kind
        if s.kind == "foreach":
            shown, test = f"for ({' '.join(s.names[0][:2])} : {test})", f"hasNext({test})"
        elif s.kind == "for":
            test = test or "true"
        head = self._node(way, "LOOP_HEADER", shown or f"{word} ({test})", s.line, condition=test).src
        end, _ = self._branch(s.parts, Way(head, "TRUE", test))
        self._meet(end._replace(kind="LOOP_BACK", condition=None, exception=None), head)
        return self._node(Way(head, "FALSE", f"!({test})"), "STATEMENT", f"after_{word}", s.end_line)

    def _try(self, s: J.Statement, way: Way) -> Way:
        thrown = [Way(way.src, "EXCEPTION", None, kind) for kind, _, _ in s.catches]
        if thrown and way.kind == "FALSE":  # the odd case of an else that starts with a try
            thrown[-1] = thrown[-1]._replace(kind=way.kind, condition=way.condition)
            way = Way(way.src)
        end = self._statements(s.parts, way)
        merge = self._node(end if end.src != EXIT else None, "STATEMENT", "try_merge", s.end_line)
        for out, (kind, name, body) in zip(thrown, s.catches):
            handler = self._node(out, "EXCEPTION_HANDLER", f"catch ({kind} {name})", body.line, exception_type=kind)
            self._meet(self._statements(body.parts, handler), merge.src)
        if s.other is None:
            return merge
        final = self._statements(s.other.parts, self._node(merge, "FINALLY_BLOCK", "finally", s.other.line, s.other.end_line))
        return self._node(final if final.src != EXIT else None, "STATEMENT", "after_finally", s.end_line)

    def _leave(self, s: J.Statement, way: Way) -> Way:
        value = J.render(s.tokens)
        if s.kind == "throw":
            out = self._node(way, "EXCEPTION_THROW", f"throw {value}", s.line)._replace(kind="EXCEPTION", exception=value)
        else:
            out = self._node(way, "STATEMENT", f"return {value or 'void'}", s.line)
        self._meet(out, EXIT)
        return Way(EXIT)

    def _switch(self, s: J.Statement, way: Way) -> Way:
        test = J.render(s.tokens)
        head = self._node(way, "CONDITION", f"switch ({test})", s.line, condition=test)
        merge = self._node(None, "STATEMENT", "switch_merge", s.end_line)
        for label, line, body in s.cases:
            case = self._node(Way(head.src, "FALL_THROUGH", f"{test} == {label}"), "STATEMENT", f"case {label}", line, body[-1].end_line if body else line)
            self._meet(self._statements(body, case), merge.src)
        return merge

    def _other(self, s: J.Statement, way: Way) -> Way:
        text, called = s.text.strip(), _first_call(s)
        if called is not None:
            return self._node(way, "METHOD_CALL", text, s.line, s.end_line, called_method=called)
        if len(text) < 2:
            return way
        return self._node(way, "STATEMENT", text if len(text) <= STATEMENT_CHARS else text[:STATEMENT_CHARS] + "...", s.line, s.end_line)

    LAYOUT = {"block": _block, "if": _choice, "while": _loop, "for": _loop, "foreach": _loop, "try": _try, "return": _leave, "throw": _leave, "switch": _switch}


def _first_call(s: J.Statement) -> str | None:
    """The call that encloses the first part of a statement: of chained calls the last link."""
    found = J.calls(_tokens(s))
    if not found:
        return None
    first = found[0]
    for c in found[1:]:  # a longer call that starts where this one does
        if c.scope and c.scope[0].at <= (first.scope[0].at if first.scope else 1 << 60) and c.line <= first.line:
            first = c
    return first.name


def _tokens(s: J.Statement) -> list[J.Token]:
    out = list(s.tokens)
    for _, _, value in s.names:
        out += value
    for p in [*s.parts, *([s.other] if s.other else []), *(c[2] for c in s.catches), *(x for c in s.cases for x in c[2])]:
        out += _tokens(p)
    return out


# ---------------------------------------------------------------- data flow


class Def(NamedTuple):
    var: str
    var_type: str | None
    def_type: str
    source_expr: str | None
    line: int


class Use(NamedTuple):
    var: str
    use_type: str
    context: str
    line: int


Fact = Def | Use

# fixed values: how the tokens of a statement are used; statements of other kinds are not read
USED_AS = {"if": "CONDITION", "while": "CONDITION", "for": "CONDITION", "foreach": "CONDITION", "return": "RETURN_VALUE", "throw": "THROWN_VALUE"}
ENTERED = {"if", "while", "for", "foreach", "block", "try"}


class DataFlow:
    """Definitions and uses of variables, numbered in the order in which they are met."""

    def __init__(self, method: J.Callable) -> None:
        facts = [Def(name, kind, "PARAMETER", None, method.line) for kind, name in method.params]
        facts += method_facts(method.body.parts) if method.body else []
        numbered = lambda kind: [{"ord": k, **f._asdict()} for k, f in enumerate(f for f in facts if isinstance(f, kind))]
        self.defs, self.uses = numbered(Def), numbered(Use)


def method_facts(parts: list[J.Statement]) -> Iterator[Fact]:
    """The facts of some statements, without recursion: what is inside of a statement is read before what follows it."""
    waiting: list[J.Statement | Def] = parts[::-1]
    while waiting:
        s = waiting.pop()
        if isinstance(s, Def):
            yield s
            continue
        yield from _own_facts(s)
        if s.kind in ENTERED:
            inside: list[J.Statement | Def] = list(s.parts)
            for kind, name, body in s.catches:
                inside += [Def(name, kind, "CAUGHT_EXCEPTION", None, body.line), body]
            waiting += [*inside, *([s.other] if s.other else [])][::-1]


def _own_facts(s: J.Statement) -> Iterator[Fact]:
    """What a statement says itself, without what it holds."""
    if s.kind == "foreach":
        kind, name, _ = s.names[0]
        yield Def(name, kind, "LOOP_VAR", None, s.line)
    if s.kind in USED_AS:
        yield from uses_in(s.tokens, USED_AS[s.kind], s.line)
    if s.kind == "local":
        for kind, name, value in s.names:
            yield from uses_in(value, "ASSIGNMENT_RHS", s.line)
            yield Def(name, kind, "LOCAL_DECL", J.render(value) or None, s.line)
    if s.kind == "expression":
        target, value = assignment(s.tokens)
        if value is not None:
            if target:
                yield from uses_in(value, "ASSIGNMENT_RHS", s.line)
                yield Def(target, None, "ASSIGNMENT", J.render(value), s.line)
        elif (call := J.call_of(s.tokens)) is not None:
            for part in [*call.args, call.scope]:
                yield from uses_in(part, "METHOD_ARG", s.line)


def assignment(tokens: list[J.Token]) -> tuple[str | None, list[J.Token] | None]:
    """(the variable that is assigned to, its value); the value is None where nothing is assigned, the variable where it has no name.
    A field's name is its whole text, an element's that of its array."""
    at = next((k for k, x in _top_level(tokens) if x.text in J.ASSIGN), None)
    if at is None:
        return None, None
    left, value = tokens[:at], tokens[at + 1 :]
    if left and left[-1].text == "]":
        left = left[: next(i for i, t in enumerate(left) if t.text == "[")]
        return J.render(left) or None, value
    return (J.render(left) or None if all(t.kind == "name" or t.text == "." for t in left) else None), value


def _top_level(tokens: list[J.Token]) -> Iterator[tuple[int, J.Token]]:
    """(place, token) of tokens outside of all brackets."""
    depth = 0
    for k, t in enumerate(tokens):
        depth -= t.text in (")", "]", "}")
        if not depth:
            yield k, t
        depth += t.text in ("(", "[", "{")


def uses_in(tokens: list[J.Token], how: str, line: int) -> Iterator[Use]:
    """Uses in names, field accesses, calls, operators, choices and casts; other forms are not entered."""
    top = list(_top_level(tokens))
    if not tokens or any(t.text == "->" for _, t in top):
        return
    mark = next((k for k, t in top if t.text == "?"), None)
    if mark is not None and (colon := _colon_of(tokens, mark)) is not None:
        yield from uses_in(tokens[:mark], "CONDITION", line)
        yield from uses_in(tokens[mark + 1 : colon], how, line)
        yield from uses_in(tokens[colon + 1 :], how, line)
        return
    for level in ({"||"}, {"&&"}, {"|"}, {"^"}, {"&"}, {"==", "!="}):
        parts = J.split_top(tokens, level)
        if len(parts) > 1:
            for p in parts:
                yield from uses_in(p, how, line)
            return
    if any(t.text == "instanceof" for _, t in top) or tokens[0].text == "new" and J.call_of(tokens) is None:
        return
    parts = J.split_top(tokens, {"<", ">", "<=", ">=", "<<", "+", "-", "*", "/", "%"})
    if len(parts) > 1:
        for p in parts:
            yield from uses_in(p, how, line)
    elif tokens[0].text in ("!", "-", "+", "~", "++", "--"):
        yield from uses_in(tokens[1:], how, line)
    elif tokens[-1].text in ("++", "--"):
        yield from uses_in(tokens[:-1], how, line)
    elif tokens[0].text == "(" and (cast := _after_cast(tokens)) is not None:
        yield from uses_in(cast, how, line)
    elif len(tokens) == 1:
        t = tokens[0]
        if t.kind == "name" and t.text not in ("true", "false", "null", "this", "super") and t.text[0].islower():
            yield Use(t.text, how, t.text, line)
    elif (call := J.call_of(tokens)) is not None:
        yield from uses_in(call.scope, how, line)
        for a in call.args:
            yield from uses_in(a, "METHOD_ARG", line)
    elif tokens[0].text != "(" and tokens[-1].kind == "name" and tokens[-2].text == "." and tokens[-1].text != "class":
        text = J.render(tokens)
        yield Use(text, how, text, line)


def _colon_of(tokens: list[J.Token], mark: int) -> int | None:
    """The place of the colon that belongs to a question mark."""
    depth = 0
    for k in range(mark + 1, len(tokens)):
        x = tokens[k].text
        if x == ":" and not depth:
            return k
        depth += (x in ("(", "[", "{", "?")) - (x in (")", "]", "}", ":"))
    return None


def _after_cast(tokens: list[J.Token]) -> list[J.Token] | None:
    """The operand of a cast, if the tokens are one."""
    close = J.close_of(tokens, 0)
    rest = tokens[close + 1 :]
    is_cast = rest and rest[0].text not in (".", "[") and all(t.kind == "name" or t.text in ".<>,[]?&" for t in tokens[1:close])
    return rest if is_cast else None
