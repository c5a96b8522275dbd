"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct shingles of five words (fewer words: the whole sequence). Register j keeps the minimum
over the set of an exponential variate h_j, truncated on a scale of powers of BASE: floor(1 - log_BASE(RATE * min h_j)),
clipped to [0, TOP]. Registers of two sets merge by maximum, and are equal about as often as the sets' similarity.

1. One pass over the texts gives a 128-bit digest of each document's set and its registers. Documents of equal sets form
   one class, which has a number from here on.
2. Bands of ROWS registers are hashed; classes that share a band meet in a bucket. A bucket is not expanded into pairs: every
   class is compared with the bucket's least one, and those found linked become one component. Only pairs of different
   components are left, those of small buckets as rows, those of large ones inside blocks: rows that hold up to about BLOCK
   classes and BLOCK_SHINGLES shingles meet, and pairs are compared there, in the first bucket that they share, unless links
   just found connect them. So every pair that shares a bucket is compared or already in one component.
3. For a pair, the numbers of registers that are larger, smaller and equal give the likelihood of each similarity jointly
   with the two set sizes. A pair goes on unless similarities of 0.75 and more are e**20 times less likely than the best.
4. The rest is verified on the full sets, made again from the texts of classes that share a bucket as 64-bit hashes of
   shingles: 100 * intersection >= 75 * union in whole numbers. Inside blocks all intersections of a pair of blocks are one
   product of matrices over the shingles that both blocks have.

At 40 bands of 4 registers a pair of similarity 0.75 shares no band with probability 3e-7; at 0.8 with 1e-9.

Defined results: null or empty text, or no word, is an empty set: n_shingles 0, linked with nothing, its own component.
Rows that repeat a doc_id with equal sets are one member. A null id gets the component of its set, or null where only null ids
are in it. Ids must be whole numbers or texts of such; others raise an error when they are cast. A very long text is a slice of
its own; its set is kept whole. Extra columns are ignored by `near_duplicates` and kept by `distinct_documents`, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, columns_free_of, drop_stash, filter_flag, filter_place, filter_words, id_filter, map_arrow, mix, passes, slices, stash, text_bytes, window_hashes, word_hashes, word_spans
from .components import components

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 4
BASE, RATE, TOP = 1.02, 20.0, 4094
REGISTERS = BANDS * ROWS
#: Classes of a bucket up to which its remaining pairs are rows of a join, and classes and shingles of a block of a larger one.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 128, 60_000

_rng = np.random.Generator(np.random.PCG64(20240501))
_FLIP = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """REGISTERS columns for the non-empty sets values[first[i]:first[i + 1]] of 64-bit shingle hashes."""
    x = (mix(values.copy()) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(first) - 1, REGISTERS), np.uint32)
    step = max(1, 1 << 15)
    cuts = np.searchsorted(first[:-1], np.arange(0, len(x) + step, step))
    for i, j in zip(cuts, cuts[1:]):
        if i == j:
            continue
        part, at = x[first[i] : first[j]], first[i:j] - first[i]
        for r in range(REGISTERS):
            y = part ^ _FLIP[r]
            y *= _TIMES[r]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            least[i:j, r] = np.minimum.reduceat(y, at)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)  # the least exponential variate of the set
    return np.clip(np.floor(1 - np.log(RATE * h) / np.log(BASE)) + TOP // 2, 0, TOP + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    parts = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(_BAND, parts.shape[:2]).copy()
    for r in range(ROWS):
        h = mix((h ^ parts[:, :, r]) * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0, 1, 101)


def possible(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float = PERCENT / 100, nats: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """(may the similarity be `least` or more, its most likely value) for rows of registers and set sizes."""
    up, down = (regs_a > regs_b).sum(1)[:, None], (regs_a < regs_b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    top = np.minimum(u / (1 - u), (1 - u) / u)
    j = top * _GRID
    pu, pd = np.maximum(_p(np.maximum(u - (1 - u) * j, 0)), 1e-9), np.maximum(_p(np.maximum(1 - u - u * j, 0)), 1e-9)
    like = up * np.log(pu) + down * np.log(pd) + (regs_a.shape[1] - up - down) * np.log(np.maximum(1 - pu - pd, 1e-9))
    best = like.max(1)
    high = np.where(j >= least - 1e-9, like, -np.inf).max(1)
    return (top[:, 0] >= least - 1e-12) & (high >= best - nats), np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): the sorted distinct shingle hashes of each text."""
    buf, offs = text_bytes(texts)
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    h = word_hashes(buf, starts, ends)
    n = np.diff(first)
    runs = window_hashes(h, SHINGLE)
    owner = np.repeat(np.arange(len(n)), n)
    whole = np.arange(len(runs)) + SHINGLE <= first[1:][owner[: len(runs)]]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    values = np.concatenate([runs[whole], np.array([window_hashes(h[first[i] : first[i + 1]], int(n[i]))[0] for i in short], np.uint64)])
    who = np.concatenate([owner[: len(runs)][whole], short])
    by = np.lexsort((values, who))
    values, who = values[by], who[by]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (who[1:] != who[:-1])
    values, who = values[keep], who[keep]
    return values, np.searchsorted(who, np.arange(len(n) + 1))


def set_digests(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a digest of each set, a row a set."""
    return np.array([np.frombuffer(hashlib.blake2b(values[i:j].tobytes(), digest_size=16).digest(), "<i8") for i, j in zip(first, first[1:])]).reshape(-1, 2)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "t"):
        values, first = shingle_sets(b.column(1))
        n = np.diff(first)
        some = np.flatnonzero(n)
        regs = np.zeros((len(n), REGISTERS), np.uint16)
        if len(some):
            regs[some] = registers(values, np.append(first[:-1][some], len(values)))
        ids = set_digests(values, first)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary()), b.column(2), b.column(3)], names=["id", "n", "hi", "lo", "regs", "r1", "r2"])


def _row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of hash of all columns of a row. Of a map, the text counts."""
    cols = [F.col(f"`{c}`").cast("string") if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    return F.xxhash64(F.lit(1), nulls, *cols), F.xxhash64(F.lit(2), nulls, *cols)


def sketches(df: DataFrame, id_col: str, text: str, rows: bool = False) -> DataFrame:
    """(id, n, hi, lo, regs, r1, r2) for every row: set size, the set's digest and its registers, and if asked the row's hash."""
    r1, r2 = _row_hashes(df) if rows else (F.lit(0).cast("long"), F.lit(0).cast("long"))
    return map_arrow(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"), r1.alias("r1"), r2.alias("r2")), _sketch_rows, "id long, n long, hi long, lo long, regs binary, r1 long, r2 long")


SETS = "hi long, lo long, h long, shingles binary"


def full_sets(df: DataFrame, id_col: str, text: str, wanted: np.ndarray) -> DataFrame:
    """(hi, lo, h, shingles) of the rows whose id passes a filter: the set's digest, the digest's place in a filter, the sorted shingle
    hashes. Copies share a digest, so it does not matter which of them brings the set: others than the class's least id pass by chance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(passes(wanted, b.column(0).to_numpy())))
            for x in slices([b], "t"):
                values, first = shingle_sets(x.column(1))
                ids = set_digests(values, first)
                each = {}  # copies in a slice count once
                for i, (hi, lo) in enumerate(ids.tolist()):
                    each.setdefault((hi, lo), i)
                at = np.array(list(each.values()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at, 0]), pa.array(ids[at, 1]), pa.array([values[first[i] : first[i + 1]].astype("<u8").tobytes() for i in at], pa.binary())], names=["hi", "lo", "shingles"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("c"), F.col(f"`{text}`").alias("t"))
    sets = map_arrow(rows.select(filter_place("c").alias("p"), "t"), run, "hi long, lo long, shingles binary")
    return sets.select("hi", "lo", filter_place("hi").alias("h"), "shingles")


def _only(sets: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The sets whose digests pass a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(wanted, b.column(2).to_numpy())))

    return map_arrow(sets, run, SETS)


def _once(sets: DataFrame) -> DataFrame:
    """A stashed table of sets without repeats. Only sets that may repeat are shuffled, and the others reach a join as they are, so that
    a hot one can be split there."""
    again = filter_words(sets.groupBy("hi", "lo").agg(F.count("*").alias("k")).filter("k > 1").select("hi"), "hi")
    asked = filter_flag(sets, "hi", again, "again")
    some = asked.filter("again").groupBy("hi", "lo").agg(F.first("h").alias("h"), F.first("shingles").alias("shingles"))
    return asked.filter("NOT again").drop("again").unionByName(some)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = band_keys(regs)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], names=["c", "key"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
        ok, j = possible(x, y, b.column(2).to_numpy(), b.column(3).to_numpy())
        at = np.flatnonzero(ok)
        yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[at]), pa.array(b.column(1).to_numpy()[at]), pa.array(j[at])], names=["a", "b", "estimate"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep, both = [], []
        for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= PERCENT * (len(x) + len(y) - common):
                keep.append(i)
                both.append(common)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(both, pa.int64())], names=["a", "b", "common"])


def verify(pairs: DataFrame, regs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs(a, b) of class numbers: by likelihood, then on the full sets. A pair that comes twice is compared once."""
    side = lambda k: regs.select(F.col("c").alias(k), *(F.col(x).alias(f"{x}_{k}") for x in ("n", "regs")))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    likely = map_arrow(near.select("a", "b", "n_a", "n_b", "regs_a", "regs_b"), _likely, "a long, b long, estimate double").select("a", "b").distinct()
    named = lambda k: regs.select(F.col("c").alias(k), *(F.col(x).alias(f"{x}_{k}") for x in ("hi", "lo")))
    near = stash(likely.join(named("a"), "a").join(named("b"), "b"), "likely")
    some = _only(sets, id_filter(near.select(F.col("hi_a").alias("hi")).unionByName(near.select(F.col("hi_b").alias("hi"))), "hi"))
    of = lambda k: some.select(F.col("hi").alias(f"hi_{k}"), F.col("lo").alias(f"lo_{k}"), F.col("shingles").alias(f"s_{k}"))
    full = near.join(of("a"), ["hi_a", "lo_a"]).join(of("b"), ["hi_b", "lo_b"])
    return map_arrow(full.select("a", "b", "s_a", "s_b"), _linked, "a long, b long, common long")


def class_links(classes: DataFrame, sets_of) -> tuple[DataFrame, DataFrame]:
    """(links, component of each linked class) for classes(c, n, regs, hi, lo, id) of distinct non-empty sets; sets_of(id filter) gives
    (hi, lo, h, shingles) of some of them.

    Links suffice to connect whatever is connected: a pair in one component already is not compared again.
    """
    regs_of = classes.select("c", "n", "regs", "hi", "lo", "id")
    bands = stash(map_arrow(classes.select("c", "regs"), _bands, "c long, key long"), "bands")
    # a class that is alone in all of its buckets is linked with nothing
    shared = bands.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key")
    live = stash(bands.join(shared, "key"), "live")
    drop_stash(bands)
    sets = _once(stash(sets_of(id_filter(live.select("c").distinct().join(regs_of.select("c", "id"), "c"), "id")), "sets"))
    least = live.groupBy("key").agg(F.min("c").alias("p"))
    pairs = live.join(least, "key").filter("c <> p").select(F.col("p").alias("a"), F.col("c").alias("b")).distinct()
    links = stash(verify(pairs, regs_of, sets), "linked", True)
    comp = stash(components(links.select("a", "b")), "comp", True)
    # what is left: pairs of different components, other than those with the pivot
    at = live.join(least, "key").filter("c <> p").select("key", "c").join(comp, F.col("c") == F.col("id"), "left").select("key", "c", F.coalesce("component", "c").alias("g"))
    groups = at.groupBy("key", "g").agg(F.count("*").alias("s"))
    sizes = groups.groupBy("key").agg(F.sum("s").alias("s"), F.count("*").alias("groups"), F.max(F.struct("s", "g")).alias("top"))
    at = stash(at.join(sizes.filter("groups > 1").select("key", "s", F.col("top.g").alias("largest")), "key").withColumn("out", F.col("g") != F.col("largest")), "left")
    small, large = at.filter(F.col("s") <= SMALL), at.filter(F.col("s") > SMALL)
    few = small.filter("out").select("key", F.col("c").alias("x"), F.col("g").alias("g_x"))
    pairs = small.join(few, "key").filter("c <> x AND g <> g_x").select(F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b")).distinct()
    rest = verify(pairs, regs_of, sets)
    wide = large.join(regs_of, "c")
    total = wide.groupBy("key").agg(F.sum("n").alias("shingles_in"))
    wide = wide.join(total, "key").withColumn("block", F.pmod(F.xxhash64("c"), F.greatest(F.ceil(F.col("s") / BLOCK), F.ceil(F.col("shingles_in") / BLOCK_SHINGLES))))
    some = _only(sets, id_filter(large.select("c").distinct().join(regs_of.select("c", "hi"), "c"), "hi"))
    whole = wide.join(some, ["hi", "lo"])
    blocks = stash(whole.groupBy("key", "block").agg(F.max("out").alias("any_out"), F.collect_list(F.struct("c", "g", "out", "n", "regs", "shingles")).alias("m")), "blocks")
    one = blocks.filter("any_out").select("key", F.col("m").alias("m_a"))
    met = one.join(blocks.select("key", F.col("m").alias("m_b")), "key")
    rest = rest.unionByName(map_arrow(met.select("key", "m_a", "m_b"), _meet, "a long, b long, common long"))
    links = stash(links.unionByName(rest).groupBy("a", "b").agg(F.max("common").alias("common")), "links", True)
    return links, stash(components(links.select("a", "b")), "comp", True)


def _side(rows: list[dict]) -> tuple:
    c, g, out, n = (np.array([r[k] for r in rows]) for k in ("c", "g", "out", "n"))
    regs = np.frombuffer(b"".join(r["regs"] for r in rows), np.uint16).reshape(-1, REGISTERS)
    return c, g, out, n.astype(np.int64), regs, band_keys(regs), [np.frombuffer(r["shingles"], "<u8") for r in rows]


#: Shingles that are columns of the matrices at once.
_COLUMNS = 8192


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two lists of sorted sets, as products of 0/1 matrices over what both lists have."""
    out = np.zeros((len(a), len(b)), np.int64)
    flat = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (a, b)]
    both = np.intersect1d(*(f for f, _ in flat))
    if not len(both):
        return out
    places = []
    for values, owner in flat:
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        ok = both[at] == values
        by = np.argsort(at[ok], kind="stable")
        places.append((at[ok][by], owner[ok][by]))
    for begin in range(0, len(both), _COLUMNS):
        sides = []
        for (at, owner), n in zip(places, (len(a), len(b))):
            x, y = np.searchsorted(at, (begin, begin + _COLUMNS))
            m = np.zeros((n, _COLUMNS), np.float32)
            m[owner[x:y], at[x:y] - begin] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)  # at most _COLUMNS, exact in 32 bits
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the classes of two blocks of a bucket: classes outside the bucket's largest component against all of other
    components. A pair is compared in the first bucket that it shares; of the links found, those come out that connect."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            a, g_a, out_a, n_a, r_a, k_a, s_a = _side(row["m_a"])
            b, g_b, out_b, n_b, r_b, k_b, s_b = _side(row["m_b"])
            asked = np.zeros((len(a), len(b)), bool)
            for x in np.flatnonzero(out_a):
                y = np.flatnonzero((g_b != g_a[x]) & (~out_b | (b > a[x])))
                same = k_b[y] == k_a[x]
                y = y[k_a[x][same.argmax(1)] == row["key"]] if len(y) else y
                if len(y):
                    ok, _ = possible(np.broadcast_to(r_a[x], (len(y), REGISTERS)), r_b[y], np.full(len(y), n_a[x]), n_b[y])
                    asked[x, y[ok]] = True
            xs, ys = np.flatnonzero(asked.any(1)), np.flatnonzero(asked.any(0))
            made: list[tuple[int, int, int]] = []
            if len(xs):
                common = overlaps([s_a[x] for x in xs], [s_b[y] for y in ys])
                linked = asked[np.ix_(xs, ys)] & (100 * common >= PERCENT * (n_a[xs][:, None] + n_b[ys] - common))
                made = _connecting(a[xs], b[ys], g_a[xs], g_b[ys], linked, common)
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in range(3)], names=["a", "b", "common"])


def _connecting(a: np.ndarray, b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray, linked: np.ndarray, common: np.ndarray) -> list[tuple[int, int, int]]:
    """(lesser, greater, common) of links enough to connect the components that any link connects."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for x, y in np.argwhere(linked).tolist():
        u, v = find(int(g_a[x])), find(int(g_b[y]))
        if u != v:
            root[u] = v
            out.append((int(min(a[x], b[y])), int(max(a[x], b[y])), int(common[x, y])))
    return out


def _classes_of(docs: DataFrame, df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(hi, lo, g, component_id) of every non-empty set: a number and the least id of its component."""
    classes = docs.filter("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = stash(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbers stand once they are written
    _, comp = class_links(classes, lambda wanted: full_sets(df, id_col, text, wanted))
    comp = comp.select(F.col("id").alias("c"), F.col("component").alias("g"))
    heads = classes.select("c", "id").join(comp, "c").groupBy("g").agg(F.min("id").alias("head"))
    at = classes.select("hi", "lo", "c", "id").join(comp.join(heads, "g"), "c", "left")
    return stash(at.select("hi", "lo", F.coalesce("g", "c").alias("g"), F.when(F.col("g").isNull(), F.col("id")).otherwise(F.col("head")).alias("component_id")), "named")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the least id it reaches) and kept (it is that id), for every row of df."""
    docs = stash(sketches(df, id_col, text), "sketches")
    named = _classes_of(docs, df, id_col, text)
    out = docs.select("id", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, and every row without words: of the rows with the least id (a null one after all others) the one
    with the least hash of all its columns, so reruns keep the same. Rows are decided by themselves, also where they share an id:
    two texts of one id that are not linked both stay. Only rows that may have to go are shuffled."""
    docs = stash(sketches(df, id_col, text, rows=True), "sketches")
    named = _classes_of(docs, df, id_col, text)
    rows = docs.filter("n > 0").groupBy("hi", "lo", "id", "r1", "r2").agg(F.count("*").alias("times")).join(named.select("hi", "lo", "g"), ["hi", "lo"])
    best = rows.groupBy("g").agg(F.min(F.struct(F.col("id").isNull(), "id", "r1", "r2")).alias("best")).select("g", F.col("best.r1").alias("b1"), F.col("best.r2").alias("b2"))
    best = stash(best, "best")  # apart from the join, where a hot component can be split then
    rows = rows.join(best, "g").withColumn("goes", (F.col("r1") != F.col("b1")) | (F.col("r2") != F.col("b2")))
    rows = stash(rows.filter("goes OR times > 1").select(F.col("r1").alias("t1"), F.col("r2").alias("t2"), "goes").distinct(), "touched")
    r1, r2, t1, t2, goes, flag = columns_free_of(df, "r1", "r2", "t1", "t2", "goes", "flag")
    rows = rows.toDF(t1, t2, goes)
    own, (h1, h2) = [F.col(f"`{c}`") for c in df.columns], _row_hashes(df)
    asked = filter_flag(df.withColumn(r1, h1).withColumn(r2, h2), r1, filter_words(rows, t1), flag)
    rest = asked.filter(F.col(flag)).join(rows, (F.col(r1) == F.col(t1)) & (F.col(r2) == F.col(t2)), "left").filter(F.coalesce(~F.col(goes), F.lit(True)))
    alone, repeated = rest.filter(F.col(goes).isNull()), rest.filter(F.col(goes).isNotNull())
    once = repeated.dropDuplicates([r1, r2])  # equal in every column
    return asked.filter(~F.col(flag)).select(own).unionByName(alone.select(own)).unionByName(once.select(own))
