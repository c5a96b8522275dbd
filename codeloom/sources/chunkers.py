"""Chunks of Markdown, SQL, YAML and OpenAPI files as DataFrame expressions; one row a chunk."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T

try:
    import yaml
except ImportError:
    yaml = None

# fixed values
CONTEXT_NAMES, INTRODUCTION, HEADING = ["context", "business"], "Introduction", "## "
METHODS = ["get", "post", "put", "delete"]
API_MARKERS = ["openapi:", "swagger:", '"openapi"', '"swagger"']


def sections(files: DataFrame, path: str = "path", content: str = "content", heading: Callable[[Column], Column] | None = None, blank: bool = False) -> DataFrame:
    """(path, section, header, body, start_line, end_line): lines grouped under headings, without blank sections unless asked for.

    `heading` is a condition on a line. Each file is cut inside its row: the places of headings give the sections, so no text is
    shuffled.
    """
    is_heading = (lambda x: x.startswith(HEADING)) if heading is None else heading
    rows = files.select(F.col(path).alias("path"), F.split(F.col(content), "\n").alias("lines")).filter("lines IS NOT NULL")
    heads = F.filter(F.transform("lines", lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())
    rows = rows.select("path", "lines", heads.alias("heads"))
    # what stands before the first heading is section 0; without lines there, it has none
    begins = F.when(F.get("heads", F.lit(0)) == 0, F.col("heads")).otherwise(F.concat(F.array(F.lit(0)), "heads"))
    rows = rows.select("path", "lines", "heads", begins.alias("begins"))
    spans = F.transform("begins", lambda b, i: F.struct(b.alias("b"), F.coalesce(F.get("begins", i + 1), F.size("lines")).alias("e")))
    rows = rows.select("path", "lines", "heads", F.explode(spans).alias("s")).select("path", "lines", F.array_contains("heads", F.col("s.b")).alias("headed"), F.size(F.filter("heads", lambda h: h <= F.col("s.b"))).cast("long").alias("section"), "s.b", "s.e")
    from_ = F.col("b") + F.when(F.col("headed"), 1).otherwise(0)
    body = F.array_join(F.slice("lines", from_ + 1, F.col("e") - from_), "\n")
    out = rows.select("path", "section", F.when(F.col("headed"), F.get("lines", F.col("b"))).otherwise(INTRODUCTION).alias("header"), F.regexp_replace(body, r"\s+$" if blank else r"^\s+|\s+$", "").alias("body"), (F.col("b") + 1).alias("start_line"), F.col("e").alias("end_line"))
    return out if blank else out.filter(F.col("body") != "")


def markdown(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Chunks of Markdown files by second-level headings."""
    name = F.lower(T.basename(F.col("path")))
    kind = F.when(name.contains(CONTEXT_NAMES[0]) | name.contains(CONTEXT_NAMES[1]), "BUSINESS_CONTEXT").otherwise("DOCUMENTATION")
    title = F.when(F.col("header").startswith(HEADING), F.trim(F.expr(f"substring(header, {len(HEADING) + 1})"))).otherwise(F.col("header"))
    s = sections(files, path, content).withColumn("title", title)
    return s.select("path", F.col("title").alias("element_name"), F.concat(F.lit(HEADING), "title", F.lit("\n"), "body").alias("content"), kind.alias("chunk_type"), "start_line", "end_line")


def sql_statements(files: DataFrame, path: str = "path", content: str = "content", pattern: str = T.SQL_STATEMENT) -> DataFrame:
    """(path, pos, content, element_name, statement_type, start_line, end_line) of every statement.

    What stands before a statement is the text less all from it on: the pieces between matches are found by splitting, and their
    line feeds are summed up once a file.
    """
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    rows = files.select(F.col(path).alias("path"), F.regexp_extract_all(F.col(content), F.lit(pattern), F.lit(0)).alias("_all"), F.split(F.col(content), pattern).alias("_between"))
    feeds = F.zip_with("_between", "_all", lambda b, a: F.struct(F.coalesce(count(b), F.lit(0)).alias("before"), F.coalesce(count(a), F.lit(0)).alias("inside")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(feeds, start, lambda acc, f: F.struct((acc["at"] + f["before"] + f["inside"]).alias("at"), F.array_append(acc["starts"], acc["at"] + f["before"]).alias("starts")), lambda acc: acc["starts"])
    one = rows.select("path", "_all", starts.alias("_starts")).select("path", "_starts", F.posexplode("_all").alias("pos", "content"))
    line = (F.get("_starts", F.col("pos")) + 1).cast("int")
    return one.select("path", "pos", "content", T.sql_element(F.col("content")).alias("element_name"), T.sql_kind(F.col("content")).alias("statement_type"), line.alias("start_line"), (line + count(F.col("content"))).cast("int").alias("end_line"))


def yaml_keys(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A CONFIG chunk for each top-level key of every document of YAML files, its value rendered with two spaces a level; a file that
    cannot be parsed gives none. Without a YAML library, block style is read by lines."""
    if yaml is None:
        return _yaml_blocks(files, path, content)
    parsed = F.pandas_udf(lambda s: pd.Series([_yaml_entries(x) for x in s], dtype=object), "array<struct<key:string,text:string>>")
    rows = files.select(F.col(path).alias("path"), F.explode(parsed(F.col(content))).alias("e"))
    return rows.select("path", F.col("e.key").alias("element_name"), F.col("e.text").alias("content"), F.lit("CONFIG").alias("chunk_type"))


def _yaml_blocks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    s = sections(files, path, content, heading=lambda x: x.rlike(r"^[^\s#\-][^:]*:(\s|$)"), blank=True)
    key = F.trim(F.regexp_extract("header", r"^([^:]+):", 1))
    value = F.trim(F.regexp_extract("header", r"^[^:]+:(.*)$", 1))
    keyed = s.filter(F.col("header") != INTRODUCTION)
    return keyed.select("path", key.alias("element_name"), F.concat(key, F.lit(":\n"), F.when(value != "", F.concat(value, F.lit("\n"))).otherwise(""), "body").alias("content"), F.lit("CONFIG").alias("chunk_type"))


def shown(value) -> str:
    """A scalar, or a list or mapping in one line: [a, b] and {k=v}."""
    if isinstance(value, dict):
        return "{" + ", ".join(f"{shown(k)}={shown(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ", ".join(map(shown, value)) + "]"
    return {None: "null", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else str(value)


def rendered(value, level: int = 1) -> str:
    """A YAML value as lines: entries of mappings at two spaces a level, lists in one line."""
    if not isinstance(value, dict):
        return shown(value) + "\n"
    nested = lambda v: "\n" + rendered(v, level + 1) if isinstance(v, (dict, list)) else shown(v) + "\n"
    return "".join(f"{'  ' * level}{shown(k)}: {nested(v)}" for k, v in value.items())


def _yaml_entries(content: str | None) -> list[dict]:
    try:
        docs = [d for d in yaml.load_all(content or "", _Typed) if isinstance(d, dict)]
        return [{"key": shown(k), "text": f"{shown(k)}:\n{rendered(v)}"} for d in docs for k, v in d.items()]
    except (yaml.YAMLError, ValueError, TypeError, RecursionError):
        return []


def is_api(content: Column, first: int | None = None) -> Column:
    """Whether a file is an API description; with `first` only so many characters are looked at."""
    low = F.lower(content if first is None else F.substring(content, 1, first))
    out = F.lit(False)
    for m in API_MARKERS if first is None else API_MARKERS[:2]:
        out = out | low.contains(m)
    return out


OPERATION = "summary string, description string, operationId string"


if yaml is not None:

    class _Loader(yaml.SafeLoader):
        """YAML whose plain values are strings, null but for `null`."""

        yaml_implicit_resolvers = {k: [x for x in v if x[0].endswith((":null", ":merge"))] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    class _Typed(yaml.SafeLoader):
        """YAML with dates as strings."""

        yaml_implicit_resolvers = {k: [x for x in v if not x[0].endswith(":timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def _yaml_paths(content: str | None) -> str | None:
    """The operations of a YAML description as JSON; null for what is no description, and without a YAML library."""
    if yaml is None:
        return None
    try:
        doc = next(yaml.load_all(content, _Loader), None) if content else None
        fields = [x.split()[0] for x in OPERATION.split(", ")]
        one = lambda op: {f: str(op[f]) for f in fields if op.get(f) is not None}
        return json.dumps({"paths": {str(p): {m: one(item[m]) for m in METHODS if isinstance(item.get(m), dict)} for p, item in doc["paths"].items() if isinstance(item, dict)}})
    except (yaml.YAMLError, AttributeError, KeyError, TypeError, ValueError):
        return None


def yaml_paths(content: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([_yaml_paths(x) for x in s], dtype=object), "string")(content)


def api_operations(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """An API_SPEC chunk for each GET, POST, PUT and DELETE operation of JSON and YAML descriptions that says what it does."""
    verbs = ", ".join(f"{m}: struct<{OPERATION.replace(' string', ': string')}>" for m in METHODS)
    is_json = F.ltrim(F.col(content)).startswith("{")
    text = F.when(is_json, F.col(content)).otherwise(yaml_paths(F.when(~is_json, F.col(content))))
    doc = F.from_json(text, f"paths map<string, struct<{verbs}>>")
    paths = files.select(F.col(path).alias("path"), F.explode(F.map_entries(doc["paths"])).alias("e"))
    each = F.explode(F.array(*[F.struct(F.lit(m.upper()).alias("method"), F.col(f"e.value.{m}").alias("op")) for m in METHODS])).alias("m")
    ops = paths.select("path", F.col("e.key").alias("api_path"), each).select("path", "api_path", "m.method", "m.op.*").filter("summary IS NOT NULL OR description IS NOT NULL OR operationId IS NOT NULL")
    line = lambda name, c: F.concat(F.lit(name + ": "), F.col(c))
    body = F.array_join(F.array(F.concat_ws(" ", "method", "api_path"), line("Summary", "summary"), line("Description", "description"), line("OperationId", "operationId")), "\n")
    return ops.select("path", F.concat_ws(" ", "method", "api_path").alias("element_name"), F.concat(body, F.lit("\n")).alias("content"), F.lit("API_SPEC").alias("chunk_type"), F.col("method").alias("http_method"), "api_path")
