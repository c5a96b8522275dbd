"""Rule-based scores and stable orders of retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.vectors import similarity

# fixed values: words of the query, and what a chunk gains if it has the property
RULES = [
    (["config", "configured", "timeout", "setting", "property", "value", "limit", "threshold", "port", "url"], [("chunk_type", "CONFIG", 0.18), ("language", "YAML", 0.10)]),
    (["endpoint", "api", "rest", "http", "request", "response", "controller", "path", "url", "route"], [("chunk_type", "API_SPEC", 0.18), ("is_endpoint", "true", 0.15)]),
    (["table", "column", "database", "schema", "sql", "query", "index", "primary key", "foreign key"], [("chunk_type", "SCHEMA", 0.20)]),
    (["why", "business rule", "policy", "should", "allowed", "requirement", "constraint", "sla"], [("chunk_type", "BUSINESS_CONTEXT", 0.25), ("chunk_type", "DOCUMENTATION", 0.15)]),
    (["exception", "error", "throw", "fail", "catch", "handle", "npe", "null"], [("has_throws_doc", "true", 0.12)]),
    (["transaction", "rollback", "commit", "atomic"], [("is_transactional", "true", 0.20)]),
    (["schedule", "cron", "job", "batch", "periodic"], [("is_scheduled", "true", 0.20)]),
    (["event", "listener", "kafka", "message", "queue"], [("is_event_handler", "true", 0.20)]),
    (["where is", "how is", "how does", "implement", "written", "defined"], [("chunk_type", "CODE", 0.08)]),
]
QUESTION_STARTS = ["why", "what is", "what does"]
QUESTION_GAINS = [("chunk_type", "DOCUMENTATION", 0.10), ("is_doc_chunk", "true", 0.08)]
TEST_WORDS, TEST_LOSS = ["test", "spec", "mock", "verify", "assert"], -0.12
ELEMENT_GAIN, CLASS_GAIN = 0.30, 0.15
CASCADE, PREVIEW_CHARS = 12, 400


def metadata_score(df: DataFrame, query: Column, distance: str = "distance") -> Column:
    """Similarity plus every gain that applies, 1 at most. Columns that df lacks count as null; flags are the string `true`."""
    q, have = F.lower(query), set(df.columns)
    has = lambda words: F.lit(False) if not words else _any(q.contains(w) for w in words)
    score = similarity(F.col(distance)) if distance in have else similarity(F.lit(None).cast("double"))

    def gain(when: Column, column: str, value: str, amount: float) -> Column:
        return F.when(when & (F.col(column) == value), amount).otherwise(0.0) if column in have else F.lit(0.0)

    for column, amount in (("element_name", ELEMENT_GAIN), ("class_name", CLASS_GAIN)):
        if column in have:
            score = score + F.when(q.contains(F.lower(column)), amount).otherwise(0.0)
    for words, gains in RULES:
        for g in gains:
            score = score + gain(has(words), *g)
    score = score + gain(~has(TEST_WORDS), "chunk_type", "TEST", TEST_LOSS)
    starts = _any(q.startswith(w) for w in QUESTION_STARTS)
    for g in QUESTION_GAINS:
        score = score + gain(starts, *g)
    return F.least(score, F.lit(1.0))


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def rerank(df: DataFrame, query: Column, k: int, rank: str = "rank") -> DataFrame:
    """The k best by metadata score; ties keep the order of `rank`."""
    return df.withColumn("score", F.round(metadata_score(df, query), 6)).orderBy(F.col("score").desc(), F.col(rank)).limit(k)


def boost_by_type(df: DataFrame, kind: str, k: int, column: str = "chunk_type", rank: str = "rank") -> DataFrame:
    """Rows of one type first, otherwise in the order of `rank`; k at most."""
    return df.withColumn("boosted", (F.col(column) == kind).cast("int")).orderBy(F.col("boosted").desc(), F.col(rank)).limit(k).drop("boosted")


def bag_union(parts: list[DataFrame], rank: str = "rank") -> DataFrame:
    """Rows of all parts in order, equal rows kept: part_no, then rank."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part_no", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def config_matches(df: DataFrame, kind: str = "CONFIG", boosted: int = 5, others: int = 3, column: str = "chunk_type", rank: str = "rank") -> DataFrame:
    """Boosted rows, padded with other types, and then rows of other types once more (so some may come twice)."""
    rest = df.filter(F.col(column) != kind).orderBy(rank).limit(others)
    return bag_union([boost_by_type(df, kind, boosted, column, rank), rest], rank)


def cross_encode(df: DataFrame, judge: Callable[[DataFrame], DataFrame], k: int, rank: str = "rank", distance: str = "distance") -> DataFrame:
    """Blend of a judge's score 0..10 (column `judged`, null where it failed) and similarity; a failed row keeps its similarity on its
    own scale. `judge` adds the column, for instance by a pandas UDF. A single candidate is not judged and has no score."""
    if df.limit(2).count() < 2:
        return df.withColumn("judged", F.lit(None).cast("double")).withColumn("score", F.lit(None).cast("double"))
    sim = similarity(F.col(distance))
    scored = judge(df).withColumn("score", F.when(F.col("judged").isNotNull(), 0.6 * F.col("judged") + 0.4 * sim * 10).otherwise(sim))
    return scored.orderBy(F.col("score").desc(), F.col(rank)).limit(k)


def score_prompt(query: Column, content: Column, kind: Column, path: Column) -> Column:
    """What a judge is asked about one chunk: its text is cut at PREVIEW_CHARS, its file named without folders."""
    return F.concat(F.lit("Rate from 0 to 10 how well this code answers the question.\nQuestion: "), query, F.lit("\nFile: "), T.basename(path), F.lit("\nType: "), F.coalesce(kind, F.lit("")), F.lit("\n\n"), T.preview(content, PREVIEW_CHARS), F.lit("\n\nScore:"))


def full_rerank(df: DataFrame, query: Column, judge: Callable[[DataFrame], DataFrame], k: int, rank: str = "rank") -> DataFrame:
    """Metadata rules alone for k rows or fewer, else the best CASCADE of them go to the judge."""
    n = df.limit(CASCADE + 1).count()
    if n <= k:
        return rerank(df, query, k, rank)
    best = rerank(df, query, min(n, CASCADE), rank)
    w = Window.orderBy(F.col("score").desc(), F.col(rank))  # CASCADE rows
    return cross_encode(best.withColumn(rank, F.row_number().over(w)).drop("score"), judge, k, rank)
