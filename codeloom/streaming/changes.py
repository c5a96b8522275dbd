"""Streams: change sets of arriving files, sessions with late events, capped histories."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import incremental, maintain, memory

COLUMNS = ["conv_id", "turn_index", "history"]
#: Rows of histories that a task makes at once.
ROWS = 1000


def apply_fingerprints(read_stored: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on a stream of (path, content): `write` gets what changed (path, status), the stored table as it becomes, and
    the batch's number, by which a repeated batch is known. Within a batch the last row of a path counts."""

    def on_batch(files: DataFrame, batch: int) -> None:
        now = incremental.fingerprints(files).groupBy("path").agg(F.max("sha256").alias("sha256"))
        stored = read_stored()
        changes = incremental.change_set(now, stored).filter("status <> 'DELETED'")
        write(changes, maintain.upsert(stored, now, ["path"]), batch)

    return on_batch


def session_windows(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n) of sessions, open until the watermark has passed their gap."""
    w = F.session_window(ts, gap).alias("w")
    return events.withWatermark(ts, late).groupBy(user, w).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def capped_history(turns: DataFrame, cap: int = memory.HISTORY_CAP) -> DataFrame:
    """(conv_id, turn_index, history) after each arriving turn(conv_id, turn, text): the last `cap` texts, kept as state for each session.
    The turns that arrive together are taken in order; a session's may come in several batches."""

    def on_turns(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        history = list(state.get[0]) if state.exists else []
        rows = []
        turns = pd.concat([b[["turn", "text"]] for b in batches])
        for text in turns.sort_values("turn", kind="stable")["text"]:
            index = len(history)
            history = [*history, text][-cap:]
            rows.append((key[0], index, history))
            if len(rows) == ROWS:
                yield pd.DataFrame(rows, columns=COLUMNS)
                rows = []
        state.update((history,))
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)

    return turns.groupBy("conv_id").applyInPandasWithState(on_turns, "conv_id long, turn_index int, history array<string>", "history array<string>", "append", "NoTimeout")


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of (path, content) of files that arrive in a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.col("content").cast("string").alias("content"))
