"""Writes as whole-table rewrites: upserts, scoped deletes, the registry of services."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELETING = "DELETING"


def upsert(table: DataFrame, delta: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of both by key, those of delta where both have one; columns in `keep` keep the old value if there is one."""
    t, d = table.alias("t"), delta.alias("d")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    in_delta = F.col("d._in").isNotNull()

    def pick(c: str) -> Column:
        if c in keys or c in keep:
            return F.coalesce(F.col(f"t.{c}"), F.col(f"d.{c}")).alias(c)
        return F.when(in_delta, F.col(f"d.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return t.join(delta.withColumn("_in", F.lit(1)).alias("d"), cond, "full_outer").select([pick(c) for c in table.columns])


def merge_versions(parts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key; a real row beats a stub if `order` says so."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return parts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def delete_scope(table: DataFrame, column: str, value) -> DataFrame:
    """The table without rows of one scope; rows without a scope stay."""
    return table.filter(~F.col(column).eqNullSafe(F.lit(value)))


def delete_json_scope(table: DataFrame, column: str, field: str, value: str) -> DataFrame:
    """The table without rows whose JSON column has this value in a field; rows without it stay."""
    return table.filter(~F.get_json_object(F.col(column), f"$.{field}").eqNullSafe(F.lit(value)))


def latest(events: DataFrame, key: str, seq: str, gone: str | None = None) -> DataFrame:
    """The last event of every key of an append-only log, without keys whose last status is `gone`."""
    others = [c for c in events.columns if c != key]
    out = events.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(key, "_r.*")
    return out if gone is None else out.filter(~F.col("status").eqNullSafe(F.lit(gone)))


def deleted_counts(tables: dict[str, DataFrame], service: str, column: str = "service_name") -> DataFrame:
    """(table_name, deleted): the rows of a service that a purge takes from each table."""
    parts = [t.filter(F.col(column) == service).agg(F.count("*").alias("deleted")).select(F.lit(k).alias("table_name"), "deleted") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def register(registry: DataFrame, delta: DataFrame) -> DataFrame:
    """Registry upsert: everything new but the first time of ingestion."""
    return upsert(registry, delta, ["service_name"], keep=["ingested_at"])


def set_status(registry: DataFrame, service: str, status: str) -> DataFrame:
    return registry.withColumn("status", F.when(F.col("service_name") == service, status).otherwise(F.col("status")))


def purge(tables: dict[str, DataFrame], service: str, column: str = "service_name") -> dict[str, DataFrame]:
    """Every table without the rows of a service."""
    return {k: delete_scope(t, column, service) for k, t in tables.items()}


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that df has rows of; the commit of a partition is atomic."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
