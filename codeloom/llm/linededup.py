"""Line dedup by a segment-partition edit join. DataFrame functions only.

Lines are the parts of a text between line feeds. Lines of MIN_CHARS characters and more are linked if their edit distance is
at most EDITS; shorter ones only if they are equal. Classes are the connected components of links; the first line of a class
(least id, then least line number) stays and the others go.

1. Equal lines are one: combined before they are shuffled, with their first place and count. They are known by 128 bits of
   hash, and numbered.
2. A line is cut into EDITS + 1 segments whose lengths differ by one at most. Within EDITS edits one of them stands unchanged,
   so each distinct line enters the index once a segment, under a hash of (its length, the segment's number, the segment),
   and probes for every length that is at most EDITS less the substrings at places where, segment by segment, no more edits
   can have come before or after than are left.
3. Only hashes under which two lines meet are kept; which ones is found by a first and last id for each, and a bitmap of fixed
   size spares the other rows, which are kept as a few numbers each, a second shuffle. The lines of a small bucket are joined
   in pairs; a large bucket is laid out in blocks of about BLOCK lines, and pairs are compared between blocks without becoming
   rows. Of two lines the shorter one (of equal length that with the lesser number) is the indexed one, and the pair is compared
   under its first segment that the other line holds in reach, so once.
4. Twice as many pieces as segments must stand in reach of their places, but for one an edit. Pairs that pass are verified by a
   banded bit-parallel distance: a column of the matrix inside the band is two bit vectors that one
   character changes by and, or, add and shift. What both lines begin or end with is left out of it, and it is given up once
   the distance can no longer come back to EDITS.

Defined results: a null text has no lines; an empty one has one empty line; empty lines are lines like any other. Rows that
repeat an id are one document with the lines of all; lines that stand at equal places of them are kept or go alike. The place
of a null id is before all others. Ids may be of any type that has an order; other columns are ignored, whatever their names. A
very long line is cut like any other; it costs its length once a probe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, filter_flag, filter_words, stash
from .components import components

EDITS, MIN_CHARS = 2, 30
#: Lines of a bucket up to which its pairs are rows of a join, and lines of a block of a larger one.
SMALL, BLOCK = 32, 256
#: Columns after which most pairs are known to be too far apart.
SCREEN = 24


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def _unlike(a: Column, b: Column) -> Column:
    """struct(x, y): two strings without the characters that both begin with (131,071 at most)."""
    shorter = F.least(F.char_length(a), F.char_length(b))
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(16, -1, -1))), lambda k: k <= shorter)
    same = F.aggregate(steps, F.lit(0), lambda p, k: F.when((p + k <= shorter) & (F.substring(a, p + 1, k) == F.substring(b, p + 1, k)), p + k).otherwise(p))
    return _let(same, lambda n: F.struct(F.substring(a, n + 1, F.char_length(a)).alias("x"), F.substring(b, n + 1, F.char_length(b)).alias("y")))


def bounded_distance(a: Column, b: Column, most: int = EDITS) -> Column:
    """The edit distance of two strings if it is at most `most`, else some larger number, by bit vectors along a band.

    Bit k of a vector stands for row i + most + 1 - width + k of column i. The distance is followed down the band's last
    diagonal, along which it never falls, until the last row, and then along that row, for as many columns as the second string
    has more than the first one less `most`; in each it falls by one at most. Beyond the sum of those columns and `most` there is
    nothing more to find out, which comes the sooner the longer the first string is. It must have `most` characters or more.
    """
    width = 2 * most + 2
    full, diagonal = (1 << width) - 1, 1 << (width - 1)
    lit = lambda x: F.lit(x).cast("long")

    def columns(s: Column, t: Column, rows: Column, bound: Column, upto: Column) -> Column:
        """The distance followed through so many columns, for a first string of so many characters."""

        def step(acc: Column, i: Column) -> Column:
            eq = lit(0)
            for k in range(width):
                eq = eq + F.when(F.get(s, i + (most + 1 - width + k)) == F.get(t, i), lit(1 << k)).otherwise(lit(0))

            def with_x(x: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(lit(full))

                def with_d0(d: Column) -> Column:
                    hp = vn.bitwiseOR(d.bitwiseOR(vp).bitwiseXOR(lit(full)))
                    hn = d.bitwiseAND(vp)
                    half = F.shiftright(d, 1)
                    down = F.when(d.bitwiseAND(lit(diagonal)) == 0, 1).otherwise(0)
                    along = F.when(hp.bitwiseAND(acc["row"]) != 0, 1).when(hn.bitwiseAND(acc["row"]) != 0, -1).otherwise(0)
                    on_diagonal = i < rows - most
                    return F.struct(
                        hn.bitwiseOR(half.bitwiseOR(hp).bitwiseXOR(lit(full))).alias("vp"),
                        half.bitwiseAND(hp).alias("vn"),
                        (acc["d"] + F.when(on_diagonal, down).otherwise(along)).cast("int").alias("d"),
                        F.when(on_diagonal, acc["row"]).otherwise(F.shiftright(acc["row"], 1)).alias("row"),
                    )

                return _let(d0, with_d0)

            return _let(eq, with_x)

        start = F.struct(lit(full & ~((1 << (width - most - 1)) - 1)).alias("vp"), lit(0).alias("vn"), F.lit(most).cast("int").alias("d"), lit(diagonal >> 1).alias("row"))
        steps = F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, lambda acc, i: F.when(acc["d"] > bound, acc).otherwise(step(acc, i)))["d"]

    def chars(x: Column, upto: int | None) -> Column:  # the same few characters before both, so that neither is too short
        return F.split(F.concat(F.lit("-" * most), x if upto is None else F.substring(x, 1, upto)), "")

    def through(x: Column, y: Column, upto: int | None) -> Column:
        rows, cols = F.char_length(x) + most, F.char_length(y) + most
        bound = cols - rows + 2 * most
        d = _let(chars(x, upto and upto + most), lambda s: _let(chars(y, upto), lambda t: columns(s, t, rows, bound, cols if upto is None else F.least(cols, F.lit(upto)))))
        return d if upto is None else F.when((cols <= upto) | (d > bound), d)  # null while it is open

    # what both begin with is left out, and for pairs that are open after SCREEN columns what both end with, too
    rest = lambda p: _let(_unlike(F.reverse(p["x"]), F.reverse(p["y"])), lambda q: through(q["x"], q["y"], None))
    near = _let(_unlike(a, b), lambda p: F.coalesce(through(p["x"], p["y"], SCREEN), rest(p)))
    return F.when(F.abs(F.char_length(a) - F.char_length(b)) > most, most + 1).otherwise(near)


def _probes(edits: int) -> Column:
    """struct(less, i, d) for every substring that a line stands for: as a line of `less` characters less than its own, segment i, at
    the segment's place moved by d. With less = d = 0 it is the line's own segment."""
    out = [(less, i, d) for less in range(edits + 1) for i in range(edits + 1) for d in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)]
    return F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(d).alias("d")) for less, i, d in out])


def _segment(n: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(place, length) of segment i of a line of n characters; the segments from the number parts - n % parts on are longer by one."""
    size, short = F.call_function("div", n, F.lit(parts)).cast("int"), F.lit(parts) - n % parts
    return (F.lit(1) + size * i + F.greatest(i - short, F.lit(0))).cast("int"), (size + F.when(i >= short, 1).otherwise(0)).cast("int")


def _bits(edits: int) -> int:
    """Low bits of a key that hold the segment's number."""
    return edits.bit_length()


def _keys(long: DataFrame, edits: int, shortest: int) -> DataFrame:
    """(id, len, key, own) of lines(id, line, len): a hash of (length, segment's number, segment) for every probe."""
    n, i, mask = F.col("n"), F.col("c.i"), (1 << _bits(edits)) - 1
    rows = long.select("id", "line", "len", F.explode(_probes(edits)).alias("c")).withColumn("n", F.col("len") - F.col("c.less"))
    at, size = _segment(n, i, edits + 1)
    rows = rows.withColumn("at", at + F.col("c.d")).withColumn("size", size).filter((n >= shortest) & (F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("len")))
    key = F.xxhash64(n, i, F.col("line").substr(F.col("at"), F.col("size"))).bitwiseAND(F.lit(~mask).cast("long")).bitwiseOR(i.cast("long"))
    return rows.select("id", "len", key.alias("key"), ((F.col("c.less") == 0) & (F.col("c.d") == 0)).alias("own"))


def _first_segment(s: Column, t: Column, key: Column, edits: int) -> Column:
    """Whether no segment of s before the key's stands in t where a probe of t would find it."""
    i = key.bitwiseAND(F.lit((1 << _bits(edits)) - 1).cast("long")).cast("int")
    n, less, out = F.char_length(s), F.char_length(t) - F.char_length(s), F.lit(True)
    for k in range(edits):
        at, size = _segment(n, F.lit(k), edits + 1)
        low = F.greatest(at + F.greatest(F.lit(-k), less - (edits - k)), F.lit(1))
        high = F.least(at + F.least(F.lit(k), less + (edits - k)), F.char_length(t) - size + 1)
        found = (low <= high) & F.contains(F.substring(t, low, size + high - low), F.substring(s, at, size))
        out = out & ((F.lit(k) >= i) | ~found)
    return out


def _pieces(s: Column, n: Column, edits: int) -> Column:
    """Twice as many pieces as segments of a line of n characters."""
    cut = [_segment(n, F.lit(k), 2 * (edits + 1)) for k in range(2 * (edits + 1))]
    return F.array(*[F.substring(s, at, size) for at, size in cut])


def _reaches(t: Column, n: Column, edits: int) -> Column:
    """For each piece of a line of n characters the part of t in which it must stand, unless an edit has spoiled it."""
    cut = [_segment(n, F.lit(k), 2 * (edits + 1)) for k in range(2 * (edits + 1))]
    low = [F.greatest(at - edits, F.lit(1)) for at, _ in cut]
    return F.array(*[F.substring(t, x, at + size + edits - x) for x, (at, size) in zip(low, cut)])


def _enough(pieces: Column, reaches: Column, edits: int) -> Column:
    """Whether all pieces but one an edit stand within reach of their places."""
    count = 2 * (edits + 1)
    return sum((F.contains(F.get(reaches, F.lit(k)), F.get(pieces, F.lit(k))).cast("int") for k in range(count)), F.lit(0)) >= count - edits


def _among(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id shares a bit with one of ids: a bitmap of FILTER_BITS bits is broadcast, 64 of them a row."""
    return filter_flag(df, col, filter_words(ids, id_col), "_in").filter("_in").drop("_in")


def distinct_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(places, lines): (doc, pos, h1, h2) of every line; (id, h1, h2, line, n, first, len) of every distinct one, id a number."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("pos", "line"))
    rows = rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))
    lines = rows.groupBy("h1", "h2").agg(F.min("line").alias("line"), F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first"))
    lines = lines.withColumn("len", F.char_length("line")).withColumn("id", F.monotonically_increasing_id())
    return rows.select("doc", "pos", "h1", "h2"), stash(lines, "lines")  # numbers stand once they are written


def _links_between(own: Column, every: Column, key: Column, edits: int) -> Column:
    """struct(a, b, distance) of the links between two arrays of lines struct(id, line, len), the first of indexed ones. What the screen
    needs of a line is made once a line, not once a pair."""
    cut = F.transform(own, lambda p: F.struct(p["id"], p["line"], p["len"], _pieces(p["line"], p["len"], edits).alias("pieces")))

    def links_of(q: Column, lines: Column) -> Column:
        indexed = lambda p: (p["len"] < q["len"]) | ((p["len"] == q["len"]) & (p["id"] < q["id"]))
        reaches = F.array(*[_reaches(q["line"], q["len"] - less, edits) for less in range(edits + 1)])
        near = lambda r: F.filter(lines, lambda p: indexed(p) & _enough(p["pieces"], F.get(r, q["len"] - p["len"]), edits) & _first_segment(p["line"], q["line"], key, edits))
        far = lambda p: F.struct(p["id"].alias("a"), q["id"].alias("b"), bounded_distance(q["line"], p["line"], edits).alias("distance"))
        return F.filter(F.transform(_let(reaches, near), far), lambda r: r["distance"] <= edits)

    return _let(cut, lambda lines: F.flatten(F.transform(every, lambda q: links_of(q, lines))))


def line_links(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b, distance) of distinct lines(id, line, len) within `edits` of each other, once a pair; a is the shorter one."""
    long = lines.filter(F.col("len") >= min_chars)
    rows = stash(_keys(long, edits, min_chars), "keys")
    met = stash(rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key"), "met")
    again = _among(rows, "key", met, "key").join(met, "key").groupBy("key", "id").agg(F.max("own").alias("own"), F.min("len").alias("len"))
    again = stash(again, "probes")
    drop_stash(rows)
    live = again.join(again.groupBy("key").agg(F.count("*").alias("s"), F.max("own").alias("any")).filter("any").drop("any"), "key")
    text = stash(_among(long.select("id", "line"), "id", live.select("id"), "id"), "texts")
    small, large = live.filter(F.col("s") <= SMALL), live.filter(F.col("s") > SMALL)

    n = 2 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = small.filter("own").select("key", F.col("id").alias("a"), F.col("len").alias("l_a")), small.select("key", F.col("id").alias("b"), F.col("len").alias("l_b"))
    pairs = x.join(y, "key").filter("l_a < l_b OR l_a = l_b AND a < b").select("key", "a", "b")
    pairs = pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("s")), "a").join(text.select(F.col("id").alias("b"), F.col("line").alias("t")), "b")
    n_s = F.char_length("s")
    pairs = pairs.filter(_enough(_pieces(F.col("s"), n_s, edits), _reaches(F.col("t"), n_s, edits), edits)).filter(_first_segment(F.col("s"), F.col("t"), F.col("key"), edits))
    # dealt out evenly, however few bytes they are; the planner does not take an exploded value before that, nor twice
    pairs = pairs.repartition(n).select("a", "b", F.explode_outer(F.array(bounded_distance(F.col("t"), F.col("s"), edits))).alias("distance"))

    placed = large.join(text, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("s") / BLOCK)))
    blocks = stash(placed.groupBy("key", "block").agg(F.collect_list(F.when(F.col("own"), F.struct("id", "line", "len"))).alias("own"), F.collect_list(F.struct("id", "line", "len")).alias("every")), "blocks")
    both = blocks.filter(F.size("own") > 0).select("key", "own").join(blocks.select("key", "every"), "key").repartition(n)
    inside = both.select(F.explode_outer(_links_between(F.col("own"), F.col("every"), F.col("key"), edits)).alias("p")).filter("p IS NOT NULL").select("p.*")
    return pairs.filter(F.col("distance") <= edits).unionByName(inside)


def near_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, pos, class, links, equal, near) of every line: the first place of its class, the links of its distinct line, and whether
    it goes because it is equal to an earlier line or because an earlier line of its class is near."""
    places, lines = distinct_lines(docs, id_col, text)
    links = stash(line_links(lines, edits, min_chars), "links")
    comp = stash(components(links.select("a", "b")), "comp", True)
    degree = links.select(F.explode(F.array("a", "b")).alias("d_id")).groupBy("d_id").agg(F.count("*").alias("links"))
    linked = lines.select("id", "h1", "h2", "n", "first").join(comp.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"), "left").join(degree, F.col("id") == F.col("d_id"), "left")
    head = linked.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("head"))
    named = linked.filter("n > 1 OR component IS NOT NULL").join(head, "component", "left")  # other lines stand alone
    named = stash(named.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first", F.coalesce("head", "first").alias("head"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    out = places.join(named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    here = F.struct("doc", "pos")
    other = lambda x: F.coalesce(~here.eqNullSafe(F.col(x)), F.lit(False)) & F.col(x).isNotNull()
    return out.select("doc", "pos", F.coalesce("head", here).alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), other("first").alias("equal"), (~other("first") & other("head")).alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each id: its lines, those that go because they are equal or near to an earlier one, the links of its lines,
    and the numbers (from 0) of the lines that go."""
    rows = near_lines(docs, id_col, text, edits, min_chars)
    got = rows.groupBy("doc").agg(
        F.count("*").alias("n_lines"), F.count_if("equal").alias("n_equal"), F.count_if("near").alias("n_near"), F.sum("links").alias("n_links"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("equal") | F.col("near"), F.col("pos")))), ",").alias("removed"),
    )
    ids = docs.select(F.col(f"`{id_col}`").alias(id_col)).distinct()
    out = ids.join(got, ids[id_col].eqNullSafe(got.doc), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(id_col, *map(zero, ("n_lines", "n_equal", "n_near", "n_links")), F.coalesce("removed", F.lit("")).alias("removed"))
