"""Mixing sources to target weights by hash-threshold histograms.

Every document has a size in words and a 60-bit hash of its id. A source's target fixes how often it is taken whole; the
budget left is met by a threshold: documents with hashes below it are taken once more. The threshold comes from histograms:
sizes are summed by source and hash bucket, the bucket is found where a source's running sum passes its budget, and only that
bucket is split further, until it is one hash. Nothing is sorted and no source is gathered: sums are combined before they are
shuffled, and a source's histogram has at most 2**BITS rows a level. Budgets are nested: a larger target takes all that a
smaller one takes. Then the gap that the boundary document leaves is met in the same way among the documents not taken that
are no longer than it, FILLS times; the last boundary document is taken if that brings the source nearer to its target.

Targets: sources in order of code points, null last, weigh WEIGHTS in turn and share PERCENT / 100 of all words; a target
stops at REPEATS times its source's words, and what is over goes to the others by weight until no target is above. The level
at which weights are paid is found by summing on the executors; the number of sums is at most that of sources, commonly a few.

Defined results: a null text has size 0; a null source is a source of its own; documents of size 0 are taken with taken 0.
Rows that repeat an id share its hash and so the decision. A null id has the hash of its text. No rows: no rows. A very long text
counts whole. Columns of the input pass through `mixed` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

WEIGHTS, PERCENT, REPEATS = (5, 2, 1), 150, 2
#: Bits of the hash, and bits that one level of histograms adds.
HASH_BITS, BITS, FILLS = 60, 10, 2

SIZE = r"regexp_count({}, '[^\\x20\\x09-\\x0D]+')"


def size_of(text: str) -> Column:
    """Words of a text between white space; a null text has none."""
    return F.coalesce(F.expr(SIZE.format(text)), F.lit(0)).cast("long")


def hash_of(col: str, text: str) -> Column:
    """60 bits of the MD5 of an id, or of the text without one; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.col(text), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def name_of(col: str) -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with their place k (from 0) in the order of code points, null last, without one task for all."""
    n = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    # strings order by their UTF-8 bytes here, which is the order of code points
    rows = sources.repartitionByRange(n, F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    rows = stash(rows.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    before, total = {}, 0
    for p, k in counts:
        before[p], total = total, total + k
    base = F.coalesce(*[F.when(part == p, F.lit(b)) for p, b in before.items()]) if before else F.lit(0)
    return rows.withColumn("k", (base + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("at")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS) -> DataFrame:
    """sources(source, source_size) with target."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))
    rows = stash(ranked(sources).withColumn("w", weight.cast("long")), "weights", True)
    # all in hundredths of words, so that sums are whole numbers
    cap = F.col("source_size") * F.lit(100 * repeats)
    total = (rows.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * percent
    paid, heavy = None, None
    while True:  # `paid` is what the full sources take; the others get left * w / heavy
        full = F.lit(False) if paid is None else F.col("w") * F.lit(float(total - paid)) >= cap * F.lit(float(heavy))
        got = rows.agg(F.sum(F.when(full, cap).otherwise(0)).alias("paid"), F.sum(F.when(full, 0).otherwise(F.col("w"))).alias("heavy")).first()
        now = (int(got["paid"] or 0), int(got["heavy"] or 0))
        if now == (paid, heavy) or not now[1]:
            paid, heavy = now
            break
        paid, heavy = now
    if not heavy:
        target = cap
    else:
        target = F.least(cap.cast("double"), F.col("w") * F.lit(float(total - paid)) / F.lit(float(heavy)))
    return rows.select("source", "source_size", (target / 100).cast("double").alias("target"))


def _threshold(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(s, cut, gap, edge) for each of budgets(s, budget): documents docs(s, h, size) with h < cut fit, gap is what is left of the
    budget, and edge the size of the documents with h = cut, which do not fit (null where all fit)."""
    shift = HASH_BITS - BITS
    level = docs.join(budgets.select("s", "budget", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix")), "s")
    state, fits = None, None
    while True:
        b = F.shiftright("h", shift)
        sums = level.filter(F.shiftright("h", shift + BITS) == F.col("prefix")).groupBy("s", "budget", "below", b.alias("b")).agg(F.sum("size").alias("m"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        running = sums.withColumn("upto", F.col("below") + F.sum("m").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
        over = F.when(F.col("upto") > F.col("budget"), F.struct("b", "m", "lo", "hi", "upto"))
        found = stash(running.groupBy("s", "budget").agg(F.min(over).alias("x"), F.max("upto").alias("all")), "threshold", True)
        if fits is None:
            fits = found.filter("x IS NULL").select("s", F.col("all").alias("below"))
        state = found.filter("x IS NOT NULL").select("s", "budget", (F.col("x.upto") - F.col("x.m")).alias("below"), F.col("x.b").alias("prefix"), "x.m", "x.lo", "x.hi")
        if shift == 0 or not state.filter("lo < hi").head(1):
            break
        shift -= BITS
        level = docs.join(state.select("s", "budget", "below", "prefix"), "s")
    cuts = state.select("s", F.col("lo").alias("cut"), "below", F.col("m").alias("edge")).unionByName(fits.select("s", F.lit(1 << HASH_BITS).alias("cut"), "below", F.lit(None).cast("long").alias("edge")))
    # a source without documents here keeps its budget
    return budgets.join(cuts, "s", "left").select("s", F.coalesce("cut", F.lit(1 << HASH_BITS)).alias("cut"), (F.col("budget") - F.coalesce("below", F.lit(0))).alias("gap"), "edge")


def _sizes(df: DataFrame, source: str, text: str, id_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), size_of(f"`{text}`").alias("size"), hash_of(f"`{id_col}`", f"`{text}`").alias("h"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS) -> DataFrame:
    """A row for each source of docs(id, source, size, h): target, how often it is taken whole, and the thresholds."""
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = targets(sums, weights, percent, repeats).withColumn("s", name_of("source"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = stash(rows.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "plan", True)
    left = docs.withColumn("s", name_of("source")).filter("size > 0").select("s", "h", "size")
    cuts, budget = None, rows.filter("source_size > 0").select("s", "budget")
    for step in range(FILLS + 1):
        t = stash(_threshold(left, budget), "cuts", True)
        t = t.select("s", *(F.col(c).alias(f"{c}{step}") for c in ("cut", "gap", "edge")))
        cuts = t if cuts is None else cuts.join(t, "s")
        if step < FILLS:  # documents longer than the gap of a step are not asked by the next
            left = left.join(t, "s").filter((F.col("h") >= F.col(f"cut{step}")) & (F.col("size") <= F.col(f"gap{step}"))).select("s", "h", "size")
            budget = t.select("s", F.col(f"gap{step}").alias("budget"))
    # the boundary document, of those that did not fit, that brings the source nearest to its target, if any does
    gap = F.col(f"gap{FILLS}")
    near = F.least(*[F.struct(F.abs(F.coalesce(F.col(f"edge{k}").cast("double"), F.lit(float("inf"))) - gap).alias("e"), F.lit(k).alias("k")) for k in range(FILLS + 1)])
    return stash(rows.join(cuts, "s", "left").withColumn("extra", F.when(near.e < gap, near.k)).drop("s", "budget"), "mix", True)


def _copies(p: str = "") -> Column:
    """How often a document is taken, from its row and its source's row of the plan; p stands before their names."""
    c = lambda name: F.col(f"`{p}{name}`")
    once, asked = F.lit(False), F.lit(True)
    for step in range(FILLS + 1):
        fits = c("h") < c(f"cut{step}")
        once = once | (asked & (fits | (c("extra").eqNullSafe(F.lit(step)) & (c("h") == c(f"cut{step}")))))
        asked = asked & ~fits & (c("size") <= c(f"gap{step}"))
    more = F.when(F.coalesce(once, F.lit(False)) & (c("target") > c("whole") * c("source_size")), 1).otherwise(0)
    return (c("whole") + more).cast("long")


def mix(df: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", **limits) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row of df."""
    docs = stash(_sizes(df, source, text, id_col), "sizes")
    every = plan(docs, **limits)
    out = docs.join(every, docs.source.eqNullSafe(every.source)).drop(every.source).withColumn("copies", _copies())
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(df: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id", **limits) -> DataFrame:
    """The rows of df as often as the mix takes them, with the columns of df; texts are not shuffled."""
    every = plan(stash(_sizes(df, source, text, id_col), "sizes"), **limits)
    p = "_mix_"
    while any(c.lower().startswith(p) for c in df.columns):
        p = "_" + p
    every, own = every.select([F.col(c).alias(p + c) for c in every.columns]), [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(*own, size_of(f"`{text}`").alias(p + "size"), hash_of(f"`{id_col}`", f"`{text}`").alias(p + "h"))
    rows = rows.join(every, F.col(f"`{source}`").eqNullSafe(F.col(p + "source"))).withColumn(p + "copies", _copies(p)).filter(F.col(p + "copies") > 0)
    return rows.select(*own, F.explode(F.sequence(F.lit(1), F.col(p + "copies"))).alias(p + "copy")).select(own)
