"""URL filters: a temporal join of captures with dated list entries. DataFrame functions only.

A list is a table of dated entries (key, category, ts, action): from an `add` on an entry is active, until a `remove` or
another `add` of the same key and category, which makes it a validity interval [valid_from, valid_to). Keys name a host with
all below it (`h:example.org`) or a path with all below it (`p:example.org/a/b`, whole segments). A capture (url, fetched) has
one key for every parent domain of its host with two labels or more, and for every folder of its path. The
as-of join takes the intervals of those keys that hold at the time of fetching: an equi-join on the key with the interval as
a further condition, so a hot host is a skewed key of the captures, which adaptive execution splits, and equal (url, fetched)
are evaluated once and given back to every row that has them.

Defined results: a url that is null or has no host has no key, so no entry is active. Hosts compare in lower case, without
`www.`, port, user or final dots. Ties in time: a `remove` after an `add` at one time gives an empty interval. Rows that repeat
stay separate. Entries with a null key, time or action are ignored. Columns of captures with names of RESULT are replaced, others
stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_free_of, stash

RESULT = ("host", "n_active", "categories", "first_key", "blocked")


def host_of(url: str) -> Column:
    h = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    h = F.regexp_replace(F.regexp_replace(h, r"\.+$", ""), r"^www\.", "")
    return F.nullif(h, F.lit(""))


def keys_of(url: str, depth: int | None = None) -> Column:
    """The keys under which a list may hold a url, of the first `depth` folders if given; an empty array without a host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    path = F.regexp_extract(F.col(url), r"^[^:]+://[^/?#]*(/[^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    last = F.greatest(F.size(steps), F.lit(1)) if depth is None else F.lit(depth)
    folders = F.transform(F.sequence(F.lit(1), last), lambda i: F.when(i <= F.size(steps), F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.concat(domains, F.filter(folders, lambda x: x.isNotNull())))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) from dated entries; valid_to is null while an entry is active."""
    w = Window.partitionBy("key", "category").orderBy("ts", F.when(F.col("action") == "add", 0).otherwise(1))
    e = entries.filter("key IS NOT NULL AND ts IS NOT NULL AND action IS NOT NULL").withColumn("next", F.lead("ts").over(w))
    return e.filter("action = 'add' AND (next IS NULL OR next > ts)").select("key", "category", F.col("ts").alias("valid_from"), F.col("next").alias("valid_to"))


def active(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with RESULT: the host, entries active at the time of fetching, their categories in order, the least of their keys."""
    u, at, key = columns_free_of(captures, "u", "at", "key")
    each = captures.select(F.col(f"`{url}`").alias(u), F.col(f"`{fetched}`").alias(at)).distinct()
    asked = each.select(u, at, F.explode(keys_of(u)).alias(key))
    span = stash(intervals(entries), "intervals")  # the join alone stands above its shuffles, so a hot key can be split
    hits = asked.join(span, (asked[key] == span.key) & (asked[at] >= span.valid_from) & (span.valid_to.isNull() | (asked[at] < span.valid_to)))
    found = hits.groupBy(u, at).agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.min(span.key).alias("first_key"))
    rows = captures.drop(*RESULT)
    out = rows.join(found, rows[url].eqNullSafe(found[u]) & rows[fetched].eqNullSafe(found[at]), "left").drop(u, at)
    return out.withColumn("host", host_of(url)).withColumn("n_active", F.coalesce("n_active", F.lit(0)).cast("long")).withColumn("categories", F.coalesce("categories", F.lit(""))).withColumn("blocked", F.col("n_active") > 0)
