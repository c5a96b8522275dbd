"""Java files as tables: classes, methods, edges, chunks, control flow and data flow.

One pass over the files in Arrow batches gives tagged rows (tag, path, JSON); each table is a filter and a typed view of them.
A file that cannot be read gives one row with tag `unread` and the reason, and does not stop the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import LIBRARY_PACKAGES, TRIVIAL_METHODS
from codeloom.sources import java_syntax as J
from codeloom.sources.java_flow import ControlFlow, DataFlow

# fixed values
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH", "RequestMapping": "ANY"}
STEREOTYPES = {"RestController": "REST_CONTROLLER", "Controller": "CONTROLLER", "Service": "SERVICE", "Repository": "REPOSITORY", "Component": "COMPONENT", "Configuration": "CONFIGURATION"}
NODE_TYPES = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD", "annotation": "ANNOTATION_TYPE"}
NOTE_WORDS = ["TODO", "FIXME", "HACK", "NOTE"]
OTHER_TAGS = ["see", "since", "deprecated", "author"]
CONTEXT_CHARS, COMMENT_CHARS, NOTE_CHARS, MOST_COMMENTS = 150, 10, 30, 5
# fixed values: sections of a method's text in order (part, label, one line of several), and lines of a documentation chunk
TEXT_SECTIONS = [
    ("context", "CLASS CONTEXT", None), ("description", "PURPOSE", None), ("params", "PARAMETERS", "  {}: {}"), ("returns", "RETURNS", None), ("throws", "THROWS", "  {}: {}"),
    ("others", None, "{}"), ("notes", "KNOWN ISSUES / NOTES", "  {}"), ("long", "INLINE NOTES", "  // {}"),
]
DOC_LINES = [("description", None), ("params", "@param {}: {}"), ("returns", "@return {}"), ("throws", "@throws {}: {}"), ("notes", "NOTE: {}"), ("long", "// {}")]

SCHEMAS = {
    "class": "qualified_name string, simple_name string, package_name string, file_path string, service_name string, is_abstract boolean, is_public boolean, is_interface boolean, node_type string, annotations array<string>, spring_stereotype string, javadoc_summary string",
    "method": "qualified_name string, simple_name string, class_name string, package_name string, file_path string, service_name string, return_type string, parameter_signature string, start_line int, end_line int, content string, annotations array<string>, is_endpoint boolean, http_method string, endpoint_path string, is_transactional boolean, is_scheduled boolean, schedule_expression string, is_event_handler boolean, is_test_method boolean, javadoc_summary string, cfg_node_count int, cyclomatic_complexity int, external_references array<string>",
    "edge": "kind string, src string, dst string, call_line int, call_type string",
    "chunk": "service_name string, path string, element_name string, class_name string, start_line int, end_line int, content string, chunk_type string, extra map<string,string>",
    "cfg_node": "method_qn string, service_name string, ord int, node_type string, code string, start_line int, end_line int, condition string, called_method string, exception_type string",
    "cfg_edge": "method_qn string, ord int, src int, dst int, edge_type string, condition_text string, exception_type string",
    "def": "method_qn string, service_name string, ord int, var string, var_type string, def_type string, source_expr string, line int",
    "use": "method_qn string, service_name string, ord int, var string, use_type string, context string, line int",
    "unread": "reason string",
}


def javadoc(comment: str | None) -> tuple[str, list[tuple[str, str]]]:
    """(description, block tags) of a documentation comment."""
    if not comment:
        return "", []
    lines = [re.sub(r"^\s*\*? ?", "", x) for x in comment[3:-2].split("\n")]
    blocks: list[list[str]] = [[]]
    for x in lines:
        if x.lstrip().startswith("@"):
            blocks.append([])
        blocks[-1].append(x)
    tags = []
    for b in blocks[1:]:
        word, _, rest = "\n".join(b).strip()[1:].partition(" ")
        tags.append((word, rest.strip()))
    return "\n".join(blocks[0]).strip(), tags


class MethodDoc:
    def __init__(self, m: J.Callable) -> None:
        self.description, tags = javadoc(m.doc)
        named = lambda words: dict((t.split(None, 1) + [""])[:2] for w, t in tags if w in words and t)
        self.params, self.throws = named(["param"]), named(["throws", "exception"])
        self.returns = next((t for w, t in tags if w == "return"), None)
        self.others = [f"{w.upper()}: {t}" for w, t in tags if w in OTHER_TAGS]
        self.comments, self.notes = [], []
        for kind, text in m.comments:
            body = text[2:].strip() if kind == "line" else text[2:-2].strip()
            if len(body) < COMMENT_CHARS or kind == "doc":
                continue
            (self.notes if kind == "line" and body.upper().startswith(tuple(NOTE_WORDS)) else self.comments).append(body)
        self.long = [c for c in self.comments if len(c) > NOTE_CHARS][:MOST_COMMENTS]

    def exists(self) -> bool:
        return bool(self.description or self.params or self.throws or self.notes)

    def enriched(self, owner: str, about: str, code: str) -> str:
        """The method's text behind what is written about it."""
        context = f"{owner} — {about if len(about) <= CONTEXT_CHARS else about[:CONTEXT_CHARS] + '...'}" if about else ""
        have = {"context": context, "description": self.description, "params": self.params, "returns": self.returns or "", "throws": self.throws, "others": self.others, "notes": self.notes, "long": self.long}
        out = [line for part, label, each in TEXT_SECTIONS if have[part] for line in _section(have[part], label, each)]
        return "\n".join([*out, "", "CODE:", code]) if out else code

    def chunk(self, name: str) -> str:
        have = {"description": self.description, "params": self.params, "returns": self.returns if self.returns is None else [self.returns], "throws": self.throws, "notes": self.notes, "long": self.long}
        lines = [line for part, each in DOC_LINES if have[part] for line in ([have[part], ""] if each is None else _items(have[part], each))]
        return "\n".join([f"Documentation for: {name}", "", *lines]) + "\n"


def _items(values, each: str) -> list[str]:
    """A line for each entry of a mapping or value of a list."""
    return [each.format(*v) for v in values.items()] if isinstance(values, dict) else [each.format(v) for v in values]


def _section(value, label: str | None, each: str | None) -> list[str]:
    if each is None:
        return [f"{label}: {value}", *([""] if label == "CLASS CONTEXT" else [])]
    return [*([f"{label}:"] if label else []), *_items(value, each)]


def annotation_value(tokens: list[J.Token]) -> str:
    """The value (or path) that an annotation is given, without quotes."""
    pairs = J.split_top(tokens, {","})
    named = [p for p in pairs if len(p) > 2 and p[1].text == "="]
    if not named:
        return J.render(tokens).replace('"', "")
    return next((J.render(p[2:]).replace('"', "") for p in named if p[0].text in ("value", "path")), "")


class FileFacts:
    """All rows of one file."""

    def __init__(self, path: str, text: str, service: str) -> None:
        self.path, self.service, self.rows = path, service, []
        self.unit = J.parse(text)
        self.test = "/test/" in path or path.endswith(("Test.java", "Tests.java", "Spec.java"))
        for t in self.unit.types:
            self.type(t)

    def add(self, tag: str, **row) -> None:
        self.rows.append((tag, self.path, json.dumps(row)))

    def qualified(self, name: str) -> str:
        return f"{self.unit.package}.{name}" if self.unit.package else name

    def resolved(self, name: str) -> str:
        return name if "." in name else self.unit.imports.get(name) or self.qualified(name)

    def type(self, t: J.Type) -> None:
        qn, notes = self.qualified(t.name), [n for n, _ in t.annotations]
        about = javadoc(t.doc)[0] if t.kind in ("class", "interface") else ""
        bare = lambda n: re.sub(r"<.*", "", n)
        plain = t.kind in ("class", "interface")
        self.add("class", qualified_name=qn, simple_name=t.name, package_name=self.unit.package, file_path=self.path, service_name=self.service, is_abstract="abstract" in t.modifiers, is_public="public" in t.modifiers,
                 is_interface=t.kind == "interface", node_type=NODE_TYPES[t.kind], annotations=notes if plain else [], spring_stereotype=next((STEREOTYPES[n] for n in notes if n in STEREOTYPES), None) if t.kind == "class" else None, javadoc_summary=about or None)
        if t.kind == "class":
            for x in t.extends[:1]:
                self.edge("INHERITS", qn, self.resolved(bare(x)))
        for x in (t.implements if t.kind == "class" else t.extends if t.kind == "interface" else []):
            self.edge("IMPLEMENTS", qn, self.resolved(bare(x)))
        if t.kind == "class":
            for dep in dict.fromkeys(self.resolved(f) for f in t.fields):
                if "." in dep and not dep.startswith(tuple(p + "." for p in LIBRARY_PACKAGES)):
                    self.edge("DEPENDS_ON", qn, dep)
        if t.kind in ("enum", "record"):
            inside = ", ".join(t.constants) if t.kind == "enum" else ", ".join(f"{k} {n}" for k, n in t.components)
            text = f"enum {t.name} {{ {inside} }}" if t.kind == "enum" else f"record {t.name}({inside})"
            self.chunk(t.name, t.name, t.line, t.end_line, text, "CODE", {"enum_constants" if t.kind == "enum" else "record_components": inside})
        if not plain:
            return
        base = next((annotation_value(v) for n, v in t.annotations if n == "RequestMapping"), "") if t.kind == "class" else ""
        for m in t.members:
            if m.kind == "constructor":
                self.constructor(t, qn, m)
            else:
                self.method(t, qn, m, base, about)

    def edge(self, kind: str, src: str, dst: str, line: int | None = None, call: str | None = None) -> None:
        self.add("edge", kind=kind, src=src, dst=dst, call_line=line, call_type=call)

    def chunk(self, element: str, cls: str | None, start: int, end: int, text: str, kind: str, extra: dict[str, str]) -> None:
        self.add("chunk", service_name=self.service, path=self.path, element_name=element, class_name=cls, start_line=start, end_line=end, content=text, chunk_type=kind, extra=extra)

    def constructor(self, t: J.Type, owner: str, m: J.Callable) -> None:
        sig = ",".join(k for k, _ in m.params)
        self.add("method", qualified_name=f"{owner}.<init>({sig})", simple_name="<init>", class_name=m.name, package_name=self.unit.package, file_path=self.path, service_name=self.service, return_type="void", parameter_signature=sig,
                 start_line=m.line, end_line=m.end_line, content=m.text, annotations=[], is_endpoint=False, is_transactional=False, is_scheduled=False, is_event_handler=False, is_test_method=False, cfg_node_count=0, cyclomatic_complexity=0, external_references=[])
        if m.end_line - m.line > 3:
            self.chunk(f"{m.name} constructor", m.name, m.line, m.end_line, m.text, "CODE", {"is_constructor": "true"})

    def method(self, t: J.Type, owner: str, m: J.Callable, base: str, about: str) -> None:
        sig = ",".join(k for k, _ in m.params)
        qn, doc, extra = f"{owner}.{m.name}({sig})", MethodDoc(m), {}
        row = {"is_endpoint": False, "is_transactional": False, "is_scheduled": False, "is_event_handler": False, "http_method": None, "endpoint_path": None, "schedule_expression": None}
        for name, value in m.annotations:
            given = annotation_value(value)
            if name in VERBS:
                row.update(is_endpoint=True, http_method=VERBS[name], endpoint_path=base + given)
                extra.update(http_method=VERBS[name], endpoint=base + given, is_endpoint="true")
            elif name == "Transactional":
                row["is_transactional"] = True
                extra["is_transactional"] = "true"
            elif name == "Scheduled":
                row.update(is_scheduled=True, schedule_expression=given)
                extra.update(is_scheduled="true", schedule=given)
            elif name in ("EventListener", "KafkaListener"):
                row["is_event_handler"] = True
                extra["is_event_handler"] = "true"
        nodes, branches, outside = 0, -1, []
        if m.body is not None and not self.test:
            flow = ControlFlow(m)
            nodes, branches = len(flow.nodes), sum(n["node_type"] in ("CONDITION", "LOOP_HEADER") for n in flow.nodes)
            for n in flow.nodes:
                self.add("cfg_node", method_qn=qn, service_name=self.service, **n)
            for e in flow.edges:
                self.add("cfg_edge", method_qn=qn, **e)
        if m.body is not None:
            data = DataFlow(m)
            defined = {d["var"] for d in data.defs}
            outside = sorted({u["var"] for u in data.uses} - defined - {"this"})
            for d in data.defs:
                self.add("def", method_qn=qn, service_name=self.service, **d)
            for u in data.uses:
                self.add("use", method_qn=qn, service_name=self.service, **u)
            for c in J.calls(m.tokens):
                self.edge("CALLS", qn, self.callee(c, owner), c.line, "DIRECT")
        self.edge("DEFINES", owner, qn)
        self.add("method", qualified_name=qn, simple_name=m.name, class_name=t.name, package_name=self.unit.package, file_path=self.path, service_name=self.service, return_type=m.returns, parameter_signature=sig, start_line=m.line, end_line=m.end_line,
                 content=m.text, annotations=[n for n, _ in m.annotations], is_test_method=self.test, javadoc_summary=doc.description or None, cfg_node_count=nodes, cyclomatic_complexity=branches + 1, external_references=outside, **row)
        if m.end_line - m.line < 3 or m.name in TRIVIAL_METHODS:
            return
        extra.update(return_type=m.returns, class_name=t.name, param_signature=sig, cyclomatic_complexity=str(branches + 1))
        if doc.exists():
            extra["has_javadoc"] = "true"
        self.chunk(m.name, t.name, m.line, m.end_line, doc.enriched(t.name, about, m.text), "TEST" if self.test else "CODE", extra)
        if doc.exists():
            flags = {"is_doc_chunk": "true", "has_throws_doc": str(bool(doc.throws)).lower(), "has_todos": str(bool(doc.notes)).lower()}
            self.chunk(qn.rsplit(".", 1)[-1], None, m.line, m.end_line, doc.chunk(qn), "DOCUMENTATION", flags)

    def callee(self, c: J.Call, owner: str) -> str:
        scope = J.render(c.scope)
        if scope in ("", "this"):
            return f"{owner}.{c.name}(?)"
        if scope[0].isupper():
            return f"{self.resolved(scope)}.{c.name}(?)"
        return f"{self.unit.package}.{scope}.{c.name}(?)"


def facts(files: DataFrame, service: str, path: str = "path", content: str = "content") -> DataFrame:
    """(tag, path, row) of all Java files; cache or write it before several tables are read from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, text in zip(b["path"], b["content"]):
                try:
                    rows += FileFacts(p, text or "", service).rows
                except Exception as e:  # noqa: BLE001  whatever is odd in one file, the others are read
                    rows.append(("unread", p, json.dumps({"reason": f"{type(e).__name__}: {e}"})))
            yield pd.DataFrame(rows, columns=["tag", "path", "row"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "tag string, path string, row string")


def table(rows: DataFrame, tag: str) -> DataFrame:
    """One of SCHEMAS from tagged rows."""
    return rows.filter(F.col("tag") == tag).select(F.from_json("row", SCHEMAS[tag]).alias("r")).select("r.*")


def linked_calls(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """CALLS edges whose targets, which name no parameter types, are joined to the methods of that owner and name."""
    calls = edges.filter("kind = 'CALLS'").withColumn("stub", F.regexp_replace("dst", r"\(\?\)$", ""))
    known = methods.select(F.col("qualified_name").alias("real"), F.regexp_replace("qualified_name", r"\([^()]*\)$", "").alias("stub"))
    return calls.join(known, "stub").select("kind", "src", F.col("real").alias("dst"), "call_line", "call_type")


def flow_summary(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(method_qn, var, defs, uses): facts of each variable in order; variables in the order in which they are first defined, then used."""
    d = defs.groupBy("method_qn", "var").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("def_type").alias("type"), "line", F.col("source_expr").alias("from"), "var_type"))).alias("defs"), F.min("ord").alias("d"))
    u = uses.groupBy("method_qn", "var").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("use_type").alias("type"), "line", "context"))).alias("uses"), F.min("ord").alias("u"))
    return d.join(u, ["method_qn", "var"], "full_outer").select("method_qn", "var", F.struct(F.col("d").isNull().alias("only_used"), F.coalesce("d", "u").alias("at")).alias("place"), "defs", "uses")


def null_checked_before_use(uses: DataFrame) -> DataFrame:
    """(method_qn, var, check_line, use_line): a condition on a variable with `null` stands before another use of it."""
    checks = uses.filter("use_type = 'CONDITION'").select("method_qn", "var", F.col("line").alias("check_line"))
    later = uses.filter("use_type <> 'CONDITION'").select("method_qn", "var", F.col("line").alias("use_line"))
    return checks.join(later, ["method_qn", "var"]).filter("check_line < use_line").distinct()
