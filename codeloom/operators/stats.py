"""Counts in one pass a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPLEX_FROM = 10


def service_stats(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(service_name, class_count, method_count, endpoint_count, complex_count)."""
    c = classes.groupBy("service_name").agg(F.count("*").alias("class_count"))
    m = methods.groupBy("service_name").agg(F.count("*").alias("method_count"), F.count_if("is_endpoint").alias("endpoint_count"), F.count_if(F.col("cyclomatic_complexity") >= COMPLEX_FROM).alias("complex_count"))
    out = c.join(m, "service_name", "full_outer")
    return out.select("service_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("class_count", "method_count", "endpoint_count", "complex_count")])


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def most_complex(df: DataFrame, group: str, branches: list[str], kind: str, n: int) -> DataFrame:
    """The n groups with most rows of some kinds."""
    return df.filter(F.col(kind).isin(branches)).groupBy(group).agg(F.count("*").alias("branches")).orderBy(F.col("branches").desc(), F.col(group)).limit(n)
