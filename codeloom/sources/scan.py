"""File scans: a repository as a table of files with format and hash, dispatched to chunkers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.sources import chunkers


def repository(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size) of all files below root but those in folders that are never scanned; any file system that Spark reads.
    The filter is on the file's own metadata, so the reader drops a pruned file when it lists it and does not open it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getRawPath()
    path = F.col("_metadata.file_path")
    below = F.substring(path, F.locate(top, path) + len(top), F.length(path))  # folders above the root do not count
    return _files(spark, root, ~T.pruned(below))


def named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for some files by name."""
    return _files(spark, paths, F.lit(True)) if paths else spark.createDataFrame([], "path string, content string, size long")


def _files(spark: SparkSession, at: str | list[str], where: Column) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
    return files.filter(where).select("path", F.col("content").cast("string").alias("content"), F.col("length").alias("size"))


@dataclass(frozen=True)
class Format:
    """One kind of file: which it takes, by path and content, and its chunks as (path, element_name, content, chunk_type). Of those
    that take a file the one of the highest priority gets it, of equal ones the first."""

    name: str
    priority: int
    takes: Callable[[Column, Column], Column]
    chunks: Callable[[DataFrame], DataFrame]


def _ends(*ends: str) -> Callable[[Column, Column], Column]:
    return lambda path, content: path.rlike("(" + "|".join(e.replace(".", r"\.") for e in ends) + ")$")


CHUNK = ["path", "element_name", "content", "chunk_type"]
FORMATS = [
    Format("openapi", 10, lambda p, c: _ends(".yaml", ".yml", ".json")(p, c) & chunkers.is_api(c), lambda f: chunkers.api_operations(f).select(CHUNK)),
    Format("yaml", 5, _ends(".yaml", ".yml"), lambda f: chunkers.yaml_keys(f).select(CHUNK)),
    Format("markdown", 0, _ends(".md"), lambda f: chunkers.markdown(f).select(CHUNK)),
    Format("sql", 0, _ends(".sql"), lambda f: chunkers.sql_statements(f).withColumn("chunk_type", F.lit("SCHEMA")).select(CHUNK)),
]


def file_format(path: Column, content: Column, formats: Sequence[Format] = FORMATS) -> Column:
    """The format that takes a file, Java before all others; null for none."""
    out = F.when(path.endswith(".java"), "java")
    for f in sorted(formats, key=lambda f: -f.priority):
        out = out.when(f.takes(path, content), f.name)
    return out


def chunks(files: DataFrame, service: str, formats: Sequence[Format] = FORMATS) -> DataFrame:
    """(service_name, path, element_name, content, chunk_type) of all files but Java sources; more formats may be given."""
    tagged = files.withColumn("format", file_format(F.col("path"), F.col("content"), formats))
    out = None
    for f in formats:
        part = f.chunks(tagged.filter(F.col("format") == f.name))
        out = part if out is None else out.unionByName(part)
    return out.select(F.lit(service).alias("service_name"), "*")
