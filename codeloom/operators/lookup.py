"""Named reads of the engine's tables: equality filters that reach the scan, one-pass projections, small top-k lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import CONTROLLERS
from codeloom.operators import graph

# fixed values: how many nodes of a call chain, callers and so on a result shows are in the handlers; these are kinds of nodes
BRANCHES, THROWS, CALLED = ["CONDITION", "LOOP_HEADER"], "EXCEPTION_THROW", "METHOD_CALL"


def by_service(df: DataFrame, service: str) -> DataFrame:
    return df.filter(F.col("service_name") == service)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """At most one row."""
    return df.filter(F.col(key) == value).limit(1)


def flagged(methods: DataFrame, service: str, flag: str) -> DataFrame:
    """Methods of a service with is_endpoint, is_transactional, is_scheduled or is_event_handler."""
    return methods.filter((F.col("service_name") == service) & F.col(flag))


def of_class(methods: DataFrame, cls: str, service: str) -> DataFrame:
    return methods.filter((F.col("class_name") == cls) & (F.col("service_name") == service))


def complex_methods(methods: DataFrame, service: str, least: int) -> DataFrame:
    return methods.filter((F.col("service_name") == service) & (F.col("cyclomatic_complexity") >= least)).orderBy(F.col("cyclomatic_complexity").desc(), "qualified_name")


def beans(classes: DataFrame, service: str) -> DataFrame:
    return classes.filter((F.col("service_name") == service) & F.col("spring_stereotype").isNotNull())


def controllers(classes: DataFrame, service: str) -> DataFrame:
    """Distinct classes of either controller stereotype; one scan, as a name has one row."""
    return classes.filter((F.col("service_name") == service) & F.col("spring_stereotype").isin(CONTROLLERS)).dropDuplicates(["qualified_name"])


def flow_nodes(cfg: DataFrame, method: str, kind: str | None = None) -> DataFrame:
    """Nodes of a method's control flow, of one kind if asked."""
    rows = cfg.filter(F.col("method_qn") == method)
    return (rows if kind is None else rows.filter(F.col("node_type") == kind)).orderBy("ord")


def most_branches(cfg: DataFrame, service: str, n: int) -> DataFrame:
    """(method_qn, branches) of the n methods with most conditions and loops."""
    return graph.branch_counts(by_service(cfg, service), "method_qn", "node_type", BRANCHES).orderBy(F.col("branches").desc(), "method_qn").limit(n)


def of_variable(facts: DataFrame, method: str, var: str) -> DataFrame:
    """Definitions or uses of one variable in order."""
    return facts.filter((F.col("method_qn") == method) & (F.col("var") == var)).orderBy("ord")


def subclasses(classes: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    return graph.one_hop(classes, edges, "INHERITS", F.col("m.qualified_name").contains(part), "qualified_name")


def implementors(classes: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    return graph.one_hop(classes, edges, "IMPLEMENTS", F.col("m.qualified_name").contains(part), "qualified_name")


def dependents(classes: DataFrame, edges: DataFrame, part: str, service: str) -> DataFrame:
    return by_service(graph.one_hop(classes, edges, "DEPENDS_ON", F.col("m.qualified_name").contains(part), "qualified_name"), service)


def overriding(methods: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    return graph.one_hop(methods, edges, "OVERRIDES", F.col("m.qualified_name").contains(part), "qualified_name")


def callers(methods: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    """A row a call site, in no service in particular, the first by name."""
    return graph.one_hop(methods, edges, "CALLS", F.col("m.qualified_name").contains(part), "qualified_name").orderBy("qualified_name", "edge_id").limit(graph.CALLERS_LIMIT)


def call_chain(methods: DataFrame, edges: DataFrame, part: str, service: str, most: int = graph.CHAIN_LIMIT) -> DataFrame:
    """A row a path of up to five calls that ends in the service, the shortest first. No deeper step is made than the limit asks for."""
    roots = methods.filter(F.col("qualified_name").contains(part)).select(F.col("qualified_name").alias("root"))
    ends, found, parts = by_service(methods, service).select(F.col("qualified_name").alias("node")), 0, []
    for step in graph.steps(edges.filter("kind = 'CALLS'"), roots, graph.CHAIN_DEPTH):
        parts.append(graph.kept(step.join(ends, "node").orderBy("depth", "node", "root", "path").limit(most)))
        found += parts[-1].count()
        if found >= most:
            break
    if not parts:
        return roots.select(F.col("root").alias("node"), "root", F.lit(0).alias("depth"), F.array().cast("array<long>").alias("path")).limit(0)
    return reduce(DataFrame.unionByName, parts).orderBy("depth", "node", "root", "path").limit(most)


def ancestors(edges: DataFrame, name: str) -> DataFrame:
    return _from(edges, name, "INHERITS", graph.ANCESTOR_DEPTH)


def transitive_dependencies(edges: DataFrame, name: str) -> DataFrame:
    return _from(edges, name, "DEPENDS_ON", graph.DEPENDENCY_DEPTH)


def _from(edges: DataFrame, name: str, kind: str, most: int) -> DataFrame:
    seeds = edges.sparkSession.createDataFrame([(name,)], "root string")
    return graph.trails(edges.filter(F.col("kind") == kind), seeds, most).select(F.col("node").alias("qualified_name"), "depth")


def chunk_view(chunks: DataFrame) -> DataFrame:
    return chunks.select("content", "chunk_type", "element_name", "class_name", "service_name")


def method_view(methods: DataFrame) -> DataFrame:
    return methods.select("simple_name", "qualified_name", "class_name", "is_endpoint", "http_method", "endpoint_path", "is_transactional")


def class_view(classes: DataFrame) -> DataFrame:
    return classes.select("simple_name", "qualified_name", "package_name", "node_type")


def query_view(question: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """The row of question(intent, confidence) with the number of rows of all parts, and each part (column rank) as an array."""
    out = question.select("intent", "confidence")
    for name, df in parts.items():  # retrieval limits bound every part to a few dozen rows
        one = df.agg(F.array_sort(F.collect_list(F.struct("rank", F.struct([c for c in df.columns if c != "rank"]).alias("row")))).alias("_rows"))
        out = out.crossJoin(F.broadcast(one.select(F.transform("_rows", lambda r: r["row"]).alias(name))))
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.size(k) for k in parts]))


def ask_view(answers: DataFrame) -> DataFrame:
    return answers.select("answer", "synthesized", "intent", "confidence", "total", "session_id")


def context_size(*parts: DataFrame) -> Column:
    """The number of rows of some result tables, as a literal."""
    return F.lit(sum(p.count() for p in parts))
