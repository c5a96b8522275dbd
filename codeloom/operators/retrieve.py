"""Intent handlers: each a plan over chunks, vertices and edges; nothing runs before the caller asks for rows.

Tables: chunks(vec_id, embedding, service_name, chunk_type, class_name, element_name, content), methods(qualified_name, service_name,
is_endpoint, ...), classes(qualified_name, simple_name, service_name, ...), edges(edge_id, kind, src, dst).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import graph, intent, rerank, vector


@dataclass
class Store:
    chunks: DataFrame
    methods: DataFrame
    classes: DataFrame
    edges: DataFrame


def _ranked(df: DataFrame) -> DataFrame:
    """A top-k result with rank and distance; it has a few rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "vec_id"))).withColumn("distance", 1 - F.col("similarity"))


def search(store: Store, q: Sequence[float], service: str, k: int, kind: str | None = None, threshold: float = vector.BY_TYPE) -> DataFrame:
    where = F.col("service_name") == service
    return _ranked(vector.topk(store.chunks, q, k, threshold, where if kind is None else where & (F.col("chunk_type") == kind)))


def raw(store: Store, q: Sequence[float], service: str, k: int = 8) -> DataFrame:
    """The contents of the chunks most like a question, of any type and above no threshold but zero."""
    return search(store, q, service, k, threshold=0.0).select("rank", "vec_id", "content", "chunk_type", "element_name")


def _seeds(hits: DataFrame) -> DataFrame:
    return hits.select("rank", T.approximate_name(F.col("service_name"), F.col("class_name"), F.col("element_name")).alias("seed")).filter("seed IS NOT NULL")


def _matches(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(rank, node) for nodes whose name contains a seed; seeds are the rows of a top-k, so this is a broadcast nested loop."""
    return nodes.select(F.col("qualified_name").alias("node")).join(F.broadcast(seeds), F.contains(F.col("node"), F.col("seed"))).select("rank", "node")


def callers_of(store: Store, hits: DataFrame, most: int | None) -> DataFrame:
    at = _matches(store.methods, _seeds(hits))
    calls = store.edges.filter("kind = 'CALLS'").join(at, F.col("dst") == F.col("node")).select("rank", F.col("src").alias("qualified_name"))
    each = graph.limit_per_seed(calls, "rank", [F.col("qualified_name")], graph.CALLERS_LIMIT)
    out = graph.keep_first(each, ["qualified_name"], [F.col("rank")]).orderBy("rank", "qualified_name")
    return out if most is None else out.limit(most)


def chain_of(store: Store, hits: DataFrame, service: str, most: int | None) -> DataFrame:
    at = _matches(store.methods, _seeds(hits))
    found = graph.trails(store.edges.filter("kind = 'CALLS'"), at.select(F.col("node").alias("root")).distinct(), graph.CHAIN_DEPTH)
    here = store.methods.filter(F.col("service_name") == service).select(F.col("qualified_name").alias("node"))
    rows = found.join(here, "node").join(at.select("rank", F.col("node").alias("root")), "root")
    each = graph.limit_per_seed(rows, "rank", [F.col("depth"), F.col("node")], graph.CHAIN_LIMIT)
    out = graph.keep_first(each, ["node"], [F.col("rank"), F.col("depth")]).orderBy("rank", "depth", "node")
    return (out if most is None else out.limit(most)).select("rank", "depth", F.col("node").alias("qualified_name"))


def related_classes(store: Store, hits: DataFrame, kinds: list[str], most: int, service: str | None = None) -> DataFrame:
    """Classes with an edge of these kinds to a class whose name contains a hit's class, kind by kind."""
    names = hits.filter("class_name IS NOT NULL").select("rank", F.col("class_name").alias("seed"))
    at = _matches(store.classes, names)
    order = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    rows = store.edges.filter(F.col("kind").isin(kinds)).join(at, F.col("dst") == F.col("node")).select("rank", order.alias("part"), F.col("src").alias("qualified_name"))
    if service is not None:
        rows = rows.join(store.classes.filter(F.col("service_name") == service).select("qualified_name"), "qualified_name")
    return graph.keep_first(rows, ["qualified_name"], [F.col("rank"), F.col("part")]).orderBy("rank", "part", "qualified_name").limit(most)


def find_implementation(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    return {"chunks": rerank.rerank(search(s, q, service, 20, "CODE"), F.lit(question), 8)}


def trace_call_chain(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    hits = search(s, q, service, 3, "CODE")
    return {"chunks": hits, "call_chain": chain_of(s, hits, service, 15)}


def trace_callers(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    hits = search(s, q, service, 3, "CODE")
    return {"chunks": hits, "callers": callers_of(s, hits, 15)}


def impact_analysis(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    hits = search(s, q, service, 3, "CODE")
    return {"chunks": hits, "impacted": related_classes(s, hits, ["DEPENDS_ON"], 20, service)}


def find_configuration(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    return {"chunks": rerank.config_matches(search(s, q, service, 20, threshold=vector.ANY_TYPE))}


def understand_contract(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    hits = search(s, q, service, 3, "CODE")
    return {"chunks": hits, "contract": related_classes(s, hits, ["IMPLEMENTS", "INHERITS"], 10)}


def hybrid(s: Store, q: Sequence[float], service: str, k: int) -> dict[str, DataFrame]:
    """Vector hits, and callers then chain of each, once a method."""
    hits = search(s, q, service, k, threshold=vector.ANY_TYPE)
    named = hits.filter("class_name IS NOT NULL")
    both = rerank.bag_union([callers_of(s, named, None).select("rank", "qualified_name"), chain_of(s, named, service, None).select("rank", "qualified_name")])
    return {"chunks": hits, "graph": graph.keep_first(both, ["qualified_name"], [F.col("rank"), F.col("part_no")])}


def debug_error(s: Store, question: str, q: Sequence[float], service: str, judge: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    found = hybrid(s, q, service, 15)
    text = F.lit(question)
    best = rerank.full_rerank(found["chunks"], text, judge, 8) if judge else rerank.rerank(found["chunks"], text, 8)
    top = best.limit(3).withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "rank")))
    return {"chunks": best, "callers": callers_of(s, top, 10), "call_chain": found["graph"]}


def null_safety(s: Store, question: str, q: Sequence[float], service: str, most: int = 8, few: int = 5) -> dict[str, DataFrame]:
    """Chunks that speak of nulls; others fill up only where there are fewer than `few`."""
    return {"chunks": null_fill(search(s, q, service, 15, "CODE"), most, few)}


def null_fill(hits: DataFrame, most: int = 8, few: int = 5, content: str = "content") -> DataFrame:
    rows = hits.withColumn("relevant", T.mentions_null(F.col(content)))
    n = F.count_if("relevant").over(Window.partitionBy())  # over the few rows of a top-k
    return rows.withColumn("_n", n).filter(F.col("relevant") | (F.col("_n") < few)).orderBy(F.col("relevant").desc(), "rank").limit(most).drop("_n")


def business_rule(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    found = search(s, q, service, 8, "BUSINESS_CONTEXT", vector.CONTEXT_ONLY)
    return {"chunks": found if not found.isEmpty() else search(s, q, service, 5, "DOCUMENTATION")}


def find_endpoints(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    ends = s.methods.filter((F.col("service_name") == service) & F.col("is_endpoint"))
    return {"endpoints": ends, "chunks": search(s, q, service, 20, "API_SPEC")}


def find_tests(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    return {"chunks": search(s, q, service, 10, "TEST")}


def general_understanding(s: Store, question: str, q: Sequence[float], service: str) -> dict[str, DataFrame]:
    return {"chunks": rerank.rerank(search(s, q, service, 20, threshold=vector.ANY_TYPE), F.lit(question), 10)}


HANDLERS = {
    "FIND_IMPLEMENTATION": find_implementation, "TRACE_CALL_CHAIN": trace_call_chain, "TRACE_CALLERS": trace_callers, "IMPACT_ANALYSIS": impact_analysis,
    "FIND_CONFIGURATION": find_configuration, "UNDERSTAND_CONTRACT": understand_contract, "DEBUG_ERROR": debug_error, "NULL_SAFETY": null_safety,
    "UNDERSTAND_BUSINESS_RULE": business_rule, "FIND_ENDPOINTS": find_endpoints, "FIND_TESTS": find_tests, "GENERAL_UNDERSTANDING": general_understanding,
}


def answer(s: Store, question: str, embed: Callable[[str], Sequence[float]], service: str) -> tuple[str, dict[str, DataFrame]]:
    """(what was answered, its result tables) for one question: classified, routed and planned."""
    spark = s.chunks.sparkSession
    row = intent.classify(spark.createDataFrame([(question,)], "question string"), "question").first()
    text = "REST API endpoints" if row["routed"] == "FIND_ENDPOINTS" else question
    return row["routed"], HANDLERS[row["routed"]](s, question, embed(text), service)
