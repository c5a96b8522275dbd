"""Queries that run a stream over a table to its end and read what it has written; the SQL computes the same in one go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import incremental
from codeloom.plans.registry import ORACLES, QUERIES, SQL_CHANGES
from codeloom.streaming import changes


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one where all run here."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='codeloom-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. The table is one file or a folder of them: a stream's plain path must be a folder, a pattern
    that fits one name may be either."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _to_end(stream: DataFrame, mode: str, on_batch, at: str) -> None:
    stream.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


def _register(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@_register("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts)::VARCHAR AS start, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    _to_end(changes.session_windows(_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "complete", lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"), at)
    start = F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return spark.read.parquet(f"{at}/out").select("user_id", F.regexp_replace(start, r"\.?0+$", "").alias("start"), "n")


@_register("stream_history", """SELECT conv_id, least(row_number() OVER w - 1, 5) AS turn_index, sha256(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), '|')) AS history FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    _to_end(changes.capped_history(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")), "append", lambda df, _: df.write.mode("append").parquet(f"{at}/out"), at)
    return spark.read.parquet(f"{at}/out").select("conv_id", "turn_index", F.sha2(F.array_join("history", "|"), 256).alias("history"))


@_register("stream_changes", f"WITH {SQL_CHANGES} SELECT path, status FROM ch WHERE status <> 'DELETED'")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, name = _folder(spark), F.concat(F.lit("f"), "doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 10 <> 7")
    old = incremental.fingerprints(docs.withColumn("text", F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).withColumn("path", name), "path", "text")
    now = _table(spark, sf_dir, "documents").filter("doc_id % 10 <> 3").select(name.alias("path"), F.col("text").alias("content"))
    _to_end(now, "append", changes.apply_fingerprints(lambda: old, lambda found, stored, _: found.write.mode("append").parquet(f"{at}/out")), at)
    # what is not in a batch is not deleted: a stream says nothing of it
    return spark.read.parquet(f"{at}/out").filter("status <> 'DELETED'")
