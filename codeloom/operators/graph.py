"""Property-graph patterns as joins over vertices and an edge table (kind, src, dst, ...)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
CALLERS_LIMIT, CHAIN_LIMIT, CHAIN_DEPTH, ANCESTOR_DEPTH, DEPENDENCY_DEPTH = 20, 30, 5, 10, 3


def one_hop(nodes: DataFrame, edges: DataFrame, kind: str | None, match: Column, key: str, reverse: bool = True) -> DataFrame:
    """The nodes one edge away from those that `match` (a condition on `m.`), a row an edge: with reverse, sources of edges that
    end at a match, else targets of edges that start at one."""
    e = edges if kind is None else edges.filter(F.col("kind") == kind)
    near, far = ("dst", "src") if reverse else ("src", "dst")
    found = nodes.alias("m").filter(match).select(F.col(f"m.{key}").alias("_at"))
    hop = e.join(found, e[near] == found["_at"]).select(F.col(far).alias("_to"), *[c for c in e.columns if c not in ("src", "dst", "kind")])
    return nodes.join(hop, nodes[key] == hop["_to"]).drop("_to")


def steps(edges: DataFrame, seeds: DataFrame, most: int, edge_id: str = "edge_id", reverse: bool = False) -> Iterator[DataFrame]:
    """The rows of `trails` depth by depth, until there are none. Each frontier is kept, so no step is computed twice."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to"), F.col(edge_id).alias("_edge"))
    step = seeds.select("root", F.col("root").alias("node"), F.array().cast(f"array<{dict(e.dtypes)['_edge']}>").alias("path"))
    for depth in range(1, most + 1):
        step = step.join(e, step.node == e["_from"]).filter(~F.array_contains("path", F.col("_edge")))
        step = kept(step.select("root", F.col("_to").alias("node"), F.array_append("path", F.col("_edge")).alias("path")))
        if step.isEmpty():
            return
        yield step.select("root", "node", F.lit(depth).alias("depth"), "path")


def trails(edges: DataFrame, seeds: DataFrame, most: int, edge_id: str = "edge_id", reverse: bool = False) -> DataFrame:
    """(root, node, depth, path): one row for each trail of 1 to `most` edges from seeds(root); an edge occurs once in a trail, a
    node may recur. Each step is a join of the frontier with the edge table."""
    parts = list(steps(edges, seeds, most, edge_id, reverse))
    if not parts:
        root, edge = dict(seeds.dtypes)["root"], dict(edges.dtypes)[edge_id]
        return seeds.sparkSession.createDataFrame([], f"root {root}, node {root}, depth int, path array<{edge}>")
    return reduce(DataFrame.unionByName, parts)


def kept(df: DataFrame) -> DataFrame:
    """A table that several plans read: a checkpoint where the cluster names a folder for them, else in the executors' memory."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def limit_per_seed(df: DataFrame, seed: str, order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each seed; the limit is applied before the shuffle too."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(seed).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of gone(key) and the edges at them."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    left = nodes.join(ids, nodes[key] == ids["_gone"], "left_anti")
    rest = edges.join(ids, edges.src == ids["_gone"], "left_anti")
    return left, rest.join(ids, rest.dst == ids["_gone"], "left_anti")


def branch_counts(nodes: DataFrame, method: str, kind: str, kinds: list[str]) -> DataFrame:
    """(method, branches): nodes of some kinds for each method that has any."""
    return nodes.filter(F.col(kind).isin(kinds)).groupBy(method).agg(F.count("*").alias("branches"))


def complexity(nodes: DataFrame, method: str, kind: str, kinds: list[str]) -> DataFrame:
    """(method, node_count, complexity): branches and one."""
    return nodes.groupBy(method).agg(F.count("*").alias("node_count"), (F.count_if(F.col(kind).isin(kinds)) + 1).alias("complexity"))


def unreachable(nodes: DataFrame, edges: DataFrame, key: str, entry: Column) -> DataFrame:
    """Nodes that no edge enters, other than entries."""
    return nodes.join(edges.select(F.col("dst").alias(key)).distinct(), key, "left_anti").filter(~entry)


def external_references(uses: DataFrame, defs: DataFrame, by: list[str], var: str) -> DataFrame:
    """Distinct used variables that are not defined, without `this`."""
    return uses.select(*by, var).distinct().join(defs.select(*by, var).distinct(), [*by, var], "left_anti").filter(F.col(var) != "this")
