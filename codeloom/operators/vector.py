"""Filtered vector top-k, exact: the filter reaches the scan, the similarity is one codegen stage, the top-k keeps k rows a task.

For very many vectors an inverted file prunes the scan: every row goes to the list of its nearest centroid, and a search reads the
lists nearest to the query and is exact within them. Centroids come from a bounded sample, the index holds all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import vectors

# fixed values: least similarity of each kind of search
ANY_TYPE, CODE_ONLY, CONTEXT_ONLY, BY_TYPE = 0.5, 0.35, 0.4, 0.35


def topk(df: DataFrame, query: Sequence[float] | Column, k: int, threshold: float | None = None, where: Column | None = None, vector: str = "embedding", key: str = "vec_id", digits: int = 6) -> DataFrame:
    """The k rows of df most like the query, with `similarity`; ties by key. Rows at or below the threshold never count."""
    rows = df if where is None else df.filter(where)
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    rows = rows.withColumn("similarity", vectors.cosine(F.col(vector), q))
    if threshold is not None:
        rows = rows.filter(F.col("similarity") > threshold)
    return rows.withColumn("similarity", F.round("similarity", digits)).orderBy(F.col("similarity").desc(), F.col(key)).limit(k)


def topk_in_group(df: DataFrame, queries: DataFrame, group: str, k: int, vector: str = "embedding", key: str = "vec_id", digits: int = 6) -> DataFrame:
    """For each row of queries(group, query, q_vector) the k rows of df of its group most like it. The rank limit is pushed below the
    shuffle (a group's rows are cut to k in every task first), so a hot group does not gather."""
    rows = df.join(queries, group).withColumn("similarity", F.round(vectors.cosine(F.col(vector), F.col("q_vector")), digits))
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Rows that centroids are fitted on at most, lists, and lists that a search reads.
SAMPLE_ROWS, LISTS, PROBES, ROUNDS = 20_000, 32, 22, 12


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def centroids(df: DataFrame, lists: int = LISTS, sample: int = SAMPLE_ROWS, vector: str = "embedding", key: str = "vec_id") -> np.ndarray:
    """Directions of `lists` groups of the rows with the least hashes of their keys, `sample` at most."""
    rows = df.filter(F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("_h"), key).orderBy("_h", key).limit(sample)
    got = [r[0] for r in rows.collect()]
    x = _unit(np.array(got, np.float64)) if got else np.zeros((0, 1))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else x
    for _ in range(ROUNDS if len(x) else 0):
        near = (x @ c.T).argmax(1)
        c = _unit(np.array([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))]))
    return c


def listed(df: DataFrame, c: np.ndarray, vector: str = "embedding", probes: int = 1, column: str = "list_no") -> DataFrame:
    """df with the number of the nearest list, or a row for each of the `probes` nearest. A row without a vector is in list -1."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{column}` int"
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.flatnonzero(b.column(at).is_valid().to_numpy(zero_copy_only=False))
            near = np.full((b.num_rows, probes), -1, np.int32)
            if len(some) and len(c):
                x = np.array(b.column(at).take(pa.array(some)).to_pylist(), np.float64)
                order = np.argsort(-(_unit(x) @ c.T), axis=1, kind="stable")[:, :probes]
                near[some, : order.shape[1]] = order
            row, k = np.nonzero((near >= 0) | (np.arange(probes) == 0))
            taken = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near[row, k], pa.int32())], names=[*b.schema.names, column])

    return df.mapInArrow(run, schema)


def topk_listed(index: DataFrame, queries: DataFrame, c: np.ndarray, k: int, probes: int = PROBES, vector: str = "embedding", key: str = "vec_id", digits: int = 6) -> DataFrame:
    """For each row of queries(query, q_vector) the k rows most like it of the lists nearest to it: an equi-join on the list."""
    asked = listed(queries, c, "q_vector", probes).filter("list_no >= 0")
    rows = index.join(asked, "list_no").withColumn("similarity", F.round(vectors.cosine(F.col(vector), F.col("q_vector")), digits))
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), F.col(key))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
