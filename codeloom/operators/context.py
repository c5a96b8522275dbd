"""Ordered, budgeted text from retrieved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS, MARK = 32000, "\n...[truncated]"
#: Parts in which a group is cut to the budget first.
SPLITS = 32

# fixed values: section headings
HISTORY, CHUNKS, CHAIN, CALLERS, IMPACTED, ENDPOINTS = "=== CONVERSATION HISTORY ===", "=== RELEVANT CODE CHUNKS ===", "=== CALL CHAIN ===", "=== CALLERS ===", "=== IMPACTED CLASSES ===", "=== HTTP ENDPOINTS ==="


def within_budget(df: DataFrame, group: list[str], order: list[Column], size: Column, most: int = MAX_CHARS) -> DataFrame:
    """df with ordinal and before, the size of the rows before it in its group; rows stay while that does not exceed the budget.

    Each group is cut to the budget in SPLITS parts first: a row that has more before it in its part has so in its group, and the
    rows of the part that stay before it are enough to show that. So a hot group does not come to one task.
    """
    part = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_size", size).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(SPLITS)))
    df = df.withColumn("_before", F.coalesce(F.sum("_size").over(part), F.lit(0))).filter(F.col("_before") <= most).drop("_part", "_before")
    w = Window.partitionBy(*group).orderBy(*order)
    before = F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("ordinal", F.row_number().over(w)).withColumn("before", before)
    return out.filter(F.col("before") <= most).drop("_size")


def chunk_header(cls: Column, element: Column, kind: Column) -> Column:
    both = F.concat(F.lit("["), cls, F.lit("."), element, F.lit(" / "), F.coalesce(kind, F.lit("null")), F.lit("]"))
    one = F.concat(F.lit("["), cls, F.lit(" / "), F.coalesce(kind, F.lit("null")), F.lit("]"))
    return F.coalesce(both, one, F.concat(F.lit("["), kind, F.lit("]")), F.lit(""))


def chunk_block(ordinal: Column, header: Column, content: Column) -> Column:
    return F.concat(F.lit("--- Chunk "), ordinal.cast("string"), F.lit(" "), header, F.lit(" ---\n"), content, F.lit("\n\n"))


def truncated(text: Column, most: int | None = MAX_CHARS) -> Column:
    """Trimmed text, cut with a mark if it is too long; None is no limit."""
    t = F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    if most is None:
        return t
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(MARK))).otherwise(t)


def assemble(history: DataFrame, chunks: DataFrame, chain: DataFrame, callers: DataFrame, impacted: DataFrame, endpoints: DataFrame, most: int | None = MAX_CHARS) -> DataFrame:
    """One row `context`. Inputs are ranked (column rank): history(query, answer), chunks(class_name, element_name, chunk_type, content),
    chain, callers, endpoints (class_name, simple_name, is_endpoint, http_method, endpoint_path), impacted(simple_name, node_type). A section
    starts, and a chunk is added, only while the text so far is not over the budget of `most` characters; with None all is kept."""
    name = F.concat("class_name", F.lit("."), "simple_name")
    call = F.concat(F.lit("["), F.coalesce("http_method", F.lit("null")), F.lit(" "), F.coalesce("endpoint_path", F.lit("null")), F.lit("]"))
    lines = [
        (HISTORY + "\n", history, F.concat(F.lit("Q: "), "query", F.lit("\nA: "), "answer", F.lit("\n\n")), "", False),
        (CHUNKS + "\n\n", chunks, chunk_block(F.row_number().over(Window.orderBy("rank")), chunk_header(F.col("class_name"), F.col("element_name"), F.col("chunk_type")), F.col("content")), "", True),
        (CHAIN + "\n", chain, F.concat(F.row_number().over(Window.orderBy("rank")).cast("string"), F.lit(". "), name, F.when(F.col("is_endpoint"), F.concat(F.lit(" "), call)).otherwise(""), F.lit("\n")), "\n", False),
        (CALLERS + "\n", callers, F.concat(F.lit("- "), name, F.lit("\n")), "\n", False),
        (IMPACTED + "\n", impacted, F.concat(F.lit("- "), "simple_name", F.lit(" ("), F.coalesce("node_type", F.lit("CLASS")), F.lit(")\n")), "\n", False),
        (ENDPOINTS + "\n", endpoints, F.concat(F.lit("- ["), F.coalesce("http_method", F.lit("null")), F.lit("] "), F.coalesce("endpoint_path", F.lit("null")), F.lit("  →  "), name, F.lit("\n")), "\n", False),
    ]
    rows = None
    for i, (head, df, text, tail, each) in enumerate(lines):
        part = df.select(F.lit(i).alias("section"), F.col("rank").cast("long").alias("rank"), text.alias("text"), F.lit(head).alias("head"), F.lit(tail).alias("tail"), F.lit(each).alias("each"))
        rows = part if rows is None else rows.unionByName(part)
    body = rows.groupBy("section", "head", "tail", "each").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("rows"))
    ordered = F.array_sort(F.collect_list(F.struct("section", "head", "tail", "each", "rows")))

    over = lambda t: F.lit(False) if most is None else F.length(t) > most

    def add(acc: Column, s: Column) -> Column:
        whole = F.concat(acc, s["head"], F.array_join(F.transform(s["rows"], lambda r: r["text"]), ""))  # at once: lists can be long
        joined = F.aggregate(s["rows"], F.concat(acc, s["head"]), lambda t, r: F.when(over(t), t).otherwise(F.concat(t, r["text"])))
        if most is not None:
            whole = F.when(s["each"], joined).otherwise(whole)
        return F.when((s["section"] > 1) & over(acc), acc).otherwise(F.concat(whole, s["tail"]))

    return body.agg(ordered.alias("s")).select(truncated(F.aggregate("s", F.lit(""), add), most).alias("context"))
