"""Questions about control flow and data flow, over the tables of nodes, edges, definitions and uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators import graph

PATH_NODES = 12


def flow_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a stable node_id, and edges between them; edges to nodes that are not in the batch are dropped."""
    node_id = lambda ord_: F.sha2(F.concat_ws("#", "method_qn", F.col(ord_).cast("string")), 256)
    n = nodes.withColumn("node_id", node_id("ord"))
    ids = n.select("method_qn", "ord")
    e = edges.join(ids.withColumnRenamed("ord", "src"), ["method_qn", "src"], "left_semi").join(ids.withColumnRenamed("ord", "dst"), ["method_qn", "dst"], "left_semi")
    return n, e.select(node_id("src").alias("src"), node_id("dst").alias("dst"), "edge_type", "condition_text", "exception_type")


def conditions_before(nodes: DataFrame, edges: DataFrame, target: Column, most: int = PATH_NODES) -> DataFrame:
    """(node_id, condition_text) of edges with a condition on some path of at most `most` edges to nodes that fulfil `target`."""
    forward = edges.filter("edge_type <> 'LOOP_BACK'").withColumn("edge_id", F.sha2(F.concat_ws(">", "src", "dst", "edge_type"), 256))
    paths = graph.trails(forward, nodes.filter(target).select(F.col("node_id").alias("root")), most, reverse=True)
    used = paths.select("root", F.explode("path").alias("edge_id")).distinct()
    return used.join(forward.filter("condition_text IS NOT NULL"), "edge_id").select(F.col("root").alias("node_id"), "condition_text").distinct()


def escaping(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method_qn, exception_type) of exceptions that leave by the exit."""
    exits = nodes.filter("node_type = 'EXIT'").select(F.col("node_id").alias("dst"), "method_qn")
    return edges.filter("edge_type = 'EXCEPTION'").join(exits, "dst").select("method_qn", "exception_type").distinct()


def longest_path(nodes: DataFrame, edges: DataFrame, most: int = PATH_NODES) -> DataFrame:
    """(method_qn, longest): edges of the longest way from the entry without going back in a loop, up to `most`."""
    forward = edges.filter("edge_type <> 'LOOP_BACK'").withColumn("edge_id", F.sha2(F.concat_ws(">", "src", "dst", "edge_type"), 256))
    entries = nodes.filter("node_type = 'ENTRY'").select(F.col("node_id").alias("root"), "method_qn")
    found = graph.trails(forward, entries.select("root"), most).groupBy("root").agg(F.max("depth").alias("longest"))
    return entries.join(found, "root", "left").select("method_qn", F.coalesce("longest", F.lit(0)).alias("longest"))


def origins(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """(method_qn, var, line, def_line): for every use the last definition that stands before it or on its line."""
    d = defs.select("method_qn", "var", F.col("line").alias("def_line"))
    pairs = uses.select("method_qn", "var", "line").join(d, ["method_qn", "var"]).filter("def_line <= line")
    return pairs.groupBy("method_qn", "var", "line").agg(F.max("def_line").alias("def_line"))


def tainted(defs: DataFrame, uses: DataFrame, sinks: Column) -> DataFrame:
    """Uses that fulfil `sinks` of variables that are parameters of their method."""
    params = defs.filter("def_type = 'PARAMETER'").select("method_qn", "var").distinct()
    return uses.filter(sinks).join(params, ["method_qn", "var"], "left_semi")
