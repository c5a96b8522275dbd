"""Conversation memory: capped histories, sliding windows, merged recall, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.rerank import bag_union

# fixed values
WINDOW_TURNS, HISTORY_CAP, RECALLED, SUMMARY_CHARS, IDLE = 2, 5, 3, 400, "30 minutes"


def last_turns(turns: DataFrame, n: int, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last n turns of every session."""
    w = Window.partitionBy(session).orderBy(F.col(turn).desc())
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def turn_index(turns: DataFrame, session: str = "conv_id", turn: str = "turn", cap: int = HISTORY_CAP) -> DataFrame:
    """turns with the size of the history before each; it stays at the cap once that is reached."""
    w = Window.partitionBy(session).orderBy(turn)
    return turns.withColumn("turn_index", F.least(F.row_number().over(w) - 1, F.lit(cap)))


def appended(history: Column, entry: Column, cap: int = HISTORY_CAP) -> Column:
    """A history array with one more entry, the last `cap` kept."""
    longer = F.concat(F.coalesce(history, F.array().cast("array<string>")), F.array(entry))
    return F.slice(longer, F.greatest(F.lit(-cap), -F.size(longer)), F.lit(cap))


def summary(answer: Column) -> Column:
    return F.substring(F.coalesce(answer, F.lit("")), 1, SUMMARY_CHARS)


def merged_memory(recalled: DataFrame, turns: DataFrame, session: str = "conv_id", turn: str = "turn", text: str = "text", n: int = WINDOW_TURNS) -> DataFrame:
    """Recalled turns whose text is not in the sliding window of their session, then the window in order."""
    window = last_turns(turns, n, session, turn)
    fresh = recalled.join(window.select(session, text).distinct(), [session, text], "left_anti")
    return bag_union([fresh.select(session, turn, text), window.select(session, turn, text)])


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", idle: str = IDLE) -> DataFrame:
    """events with session_no: a new one starts after more than `idle` without any."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    fresh = F.col(ts) > F.lag(ts).over(w) + F.expr(f"INTERVAL {idle}")
    return events.withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(1))).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def remembered(turns: DataFrame, session: str = "conv_id", index: str = "turn_index", seq: str = "turn") -> DataFrame:
    """One row a session and index, the last one written: at the cap each turn replaces the one before."""
    others = [c for c in turns.columns if c not in (session, index)]
    return turns.groupBy(session, index).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(session, index, "_r.*")


def resumed(found: Column, same_service: Column, last_active: Column, now: Column, idle: str = IDLE) -> Column:
    """Whether a session goes on."""
    return F.coalesce(found & same_service & (now - last_active <= F.expr(f"INTERVAL {idle}")), F.lit(False))
