"""Incremental change detection by content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRESH, FORCE_FULL, INCREMENTAL = "FRESH", "FORCE_FULL", "INCREMENTAL"


def fingerprints(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, sha256) of every file."""
    return files.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def change_set(current: DataFrame, stored: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(path, status) for every path of (path, sha256) tables: ADDED, MODIFIED, UNCHANGED or DELETED; with sha256 in `keep` the new hash
    too, which is null for what is deleted."""
    c, s = current.select("path", F.col("sha256").alias("now")), stored.select("path", F.col("sha256").alias("was"))
    status = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "DELETED").when(F.col("now") != F.col("was"), "MODIFIED").otherwise("UNCHANGED")
    return c.join(s, "path", "full_outer").select("path", status.alias("status"), *[F.col("now").alias(k) for k in keep])


def change_counts(changes: DataFrame) -> DataFrame:
    """One row: added, modified, deleted, unchanged, total_changed."""
    n = {k: F.count_if(F.col("status") == k.upper()).alias(k) for k in ("added", "modified", "deleted", "unchanged")}
    return changes.agg(*n.values()).withColumn("total_changed", F.expr("added + modified + deleted"))


def apply_changes(table: DataFrame, fresh: DataFrame, changes: DataFrame, path: str = "file_path") -> DataFrame:
    """The table without rows of changed or deleted files, with the fresh rows of added and modified ones."""
    touched = changes.filter("status <> 'UNCHANGED'").select(F.col("path").alias(path))
    renewed = changes.filter("status IN ('ADDED', 'MODIFIED')").select(F.col("path").alias(path))
    return table.join(touched, path, "left_anti").unionByName(fresh.join(renewed, path, "left_semi"))


def strategy(registered: Column, forced: Column) -> Column:
    """How a service is ingested: anew, all again, or only what changed."""
    return F.when(~registered, FRESH).when(forced, FORCE_FULL).otherwise(INCREMENTAL)
