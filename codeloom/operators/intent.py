"""Intent of a question by a table of patterns, in one pass over the questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: intents by priority with their patterns; those with `.*` are matched against the whole line, others are substrings
PATTERNS = [
    ("IMPACT_ANALYSIS", ["what breaks", "what will break", "impact of", "depends on", "dependent", "if i change", "if i modify", "if i remove", "who uses", "what uses", "which classes use"]),
    ("TRACE_CALL_CHAIN", ["what happens", "what does.*call", "what does.*trigger", "what is triggered", "call chain", "call flow", "execution flow", "what is called by", "sequence of calls", "downstream", "what does.*invoke", "flow", "walk.*through.*(flow|process|chain|execution|steps)", "execution path"]),
    ("TRACE_CALLERS", ["who calls", "what calls", "which.*call", "callers of", "where is.*called", "where is.*invoked", "called from", "invoked from", "upstream callers", "where does.*call", "who invokes"]),
    ("FIND_CONFIGURATION", ["configured", "configuration", "config", "how is.*set", "what is the.*timeout", "what is the.*limit", "what is the.*value", "property", "properties", "setting", "application.yml", "application.properties", "what port", "what url", "what host"]),
    ("UNDERSTAND_CONTRACT", ["what interface", "implements", "override", "what contract", "interface contract", "extend", "abstract method", "inherited from", "what is the contract"]),
    ("DEBUG_ERROR", ["exception", "error", "failing", "broken", "stacktrace", "stack trace", "throws", "thrown", "nullpointer", "npe", "null pointer", "why is.*failing", "why does.*fail", "timeout error", "connection refused", "404", "500", "400", "503", "not working", "isn't working", "doesn't work"]),
    ("NULL_SAFETY", ["null check", "null safety", "nullpointer", "could.*be null", "can.*be null", "be null", "is.*null", "null before", "where is null checked", "missing null check"]),
    ("UNDERSTAND_BUSINESS_RULE", ["why does", "why is", "business rule", "business logic", "what is the rule", "the.*rule", "policy", "what should", "allowed to", "requirement", "constraint", "sla", "service level", "why.*retry", "why.*limit"]),
    ("FIND_TESTS", ["test", "unit test", "integration test", "test case", "mock", "spec", "coverage"]),
    ("FIND_ENDPOINTS", ["endpoint", "rest", "api endpoint", "controller", "http method", "get mapping", "post mapping", "what routes", "what urls", "what apis", "routes", "apis"]),
    ("FIND_IMPLEMENTATION", ["where is", "which class", "which method", "find.*method", "find.*class", "show me", "where.*defined", "where.*implemented", "how.*implemented", "how does.*work"]),
]
DEFAULT, WIDE = "FIND_IMPLEMENTATION", "GENERAL_UNDERSTANDING"
NO_HIT, FIRST_HIT, EACH_HIT = 0.30, 0.5, 0.15
HIGH_ABOVE, MEDIUM_FROM = 0.75, 0.5


def _hit(q: Column, pattern: str) -> Column:
    return q.rlike(rf"\A.*{pattern}.*\z") if ".*" in pattern else q.contains(pattern)


def _normal(question: Column) -> Column:
    return F.lower(F.trim(F.coalesce(question, F.lit(""))))


def found(question: Column) -> Column:
    """The hits of each intent's patterns, in their order: every pattern is tested once."""
    q = _normal(question)
    return F.array(*[sum((_hit(q, p).cast("int") for p in patterns[1:]), _hit(q, patterns[0]).cast("int")) for _, patterns in PATTERNS])


def first_found(counts: Column) -> Column:
    """The first intent by priority that has a hit, or the default."""
    at = F.array_position(F.transform(counts, lambda n: n > 0), F.lit(True)).cast("int")
    return F.coalesce(F.get(F.array(*[F.lit(name) for name, _ in PATTERNS]), at - 1), F.lit(DEFAULT))


def footer(text: Column, level: Column, name: Column, form: str) -> Column:
    """An answer of medium confidence ends with what it was taken for."""
    return F.when(level == "MEDIUM", F.concat(text, F.replace(F.lit(form), F.lit("{intent}"), F.lower(F.replace(name, F.lit("_"), F.lit(" ")))))).otherwise(text)


def confidence(n: Column) -> Column:
    return F.when(n == 0, NO_HIT).otherwise(F.round(F.least(F.lit(FIRST_HIT) + EACH_HIT * n, F.lit(1.0)), 2))


def tier(c: Column) -> Column:
    return F.when(c > HIGH_ABOVE, "HIGH").when(c >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")


def routed(name: Column, level: Column) -> Column:
    """What is answered: a question of low confidence is taken widely."""
    return F.when(level == "LOW", WIDE).otherwise(name)


def classify(df: DataFrame, question: str) -> DataFrame:
    """df with intent, hits, confidence, tier and routed."""
    rows = df.withColumn("_found", found(F.col(question)))
    total = F.aggregate("_found", F.lit(0), lambda a, n: a + n)
    out = rows.withColumn("intent", first_found(F.col("_found"))).withColumn("hits", total).drop("_found")
    out = out.withColumn("confidence", confidence(F.col("hits"))).withColumn("tier", tier(F.col("confidence")))
    return out.withColumn("routed", routed(F.col("intent"), F.col("tier")))
