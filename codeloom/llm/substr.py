"""Exact substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words of one text; every word covered by a window whose words also start anywhere else goes.

1. Fingerprints. From each text's hashes of GRAM words, winnowing takes the least one under every window, so equal windows
   take equal fingerprints; about one word in fourteen gives one. A batch of texts becomes one immutable run of rows
   (fp, doc, key, times) in the shared folder, in buckets of fp and sorted in each.
2. Merge join. Bucket by bucket the new run is joined with the runs of history, which are not shuffled: fingerprints that
   occur twice or more, whether in a run or across runs, go back to the documents that hold them, old and new. LEVEL runs of
   one size are compacted into one sorted run of the next, so a row is written again once a level.
   An index keeps the texts of its batches beside the runs, and one opened on an existing path goes on with what lies there.
3. Verification. In documents with such fingerprints, the windows above them get 96-bit digests of all WINDOW words. Slices
   of texts send their distinct digests, sorted, in one block for each range of digests; each range is merged, and the
   digests that occur twice or more go back to their slices, where the covered words are removed. A slice or range is one task
   of bounded size. With history, old
   documents that share a fingerprint with the new batch are verified again and returned with their new values.

A window whose fingerprint is unique is unique, so no window is missed; each window removed agrees with another in 96 bits
over all of its words. A hot passage or group of copies is one row of a slice's block, or one fingerprint of a document,
and counts are combined before they are shuffled.

Defined results: null or empty texts, and texts of fewer than WINDOW words, lose nothing; the digest of no words is that of
the empty string. Rows that repeat a doc_id and text are copies like any others. Equal doc_ids with different texts are
kept apart by a digest of the text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stash, map_arrow, mix, new_path, remove_path, slices, stash, text_bytes, window_hashes, word_hashes, word_spans

WINDOW, GRAM = 35, 8
#: Runs that gather before they are compacted into one.
LEVEL = 4
#: Digests that one range holds on average, words of one slice of texts, and slices or ranges at most: a larger batch makes them
#: larger, so very many texts should come to an index in several batches.
RANGE_DIGESTS, SLICE_WORDS, MOST_PARTS = 500_000, 300_000, 50_000


def _sliding(x: np.ndarray, k: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) of every k consecutive values."""
    size = 1
    y = x
    while size * 2 <= k:
        y = pick(y[:-size], y[size:])
        size *= 2
    return pick(y[: len(x) - k + 1], y[k - size : k - size + len(x) - k + 1]) if size < k else y


def window_minima(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(the least hash of `gram` words in every window of one text's word hashes, the hash of every gram)."""
    g = window_hashes(h, gram)
    return _sliding(g, window - gram + 1), g


def fingerprints(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The winnowed fingerprints of one text, a value for every place that some window takes (sorted, with repeats)."""
    m, g = window_minima(h, window, gram)
    k = window - gram + 1
    # place p is taken by a window if the greatest minimum of the windows over it equals its hash
    wide = np.concatenate([np.zeros(k - 1, np.uint64), m, np.zeros(k - 1, np.uint64)])
    return np.sort(g[_sliding(wide, k, np.maximum) == g])


def _key(buf: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(buf.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(arr: pa.Array):
    buf, offs = text_bytes(arr)
    starts, ends, first = word_spans(buf, offs)
    return buf, offs, starts, ends, first, word_hashes(buf, starts, ends)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "t"):
        buf, offs, _, _, first, h = _texts(b.column(1))
        fps, docs, keys, times = [], [], [], []
        ids = b.column(0).to_pylist()
        for i, (a, z) in enumerate(zip(first, first[1:])):
            if z - a >= WINDOW:
                f, n = np.unique(fingerprints(h[a:z]), return_counts=True)
                fps.append(f)
                times.append(np.minimum(n, 2))
                docs.append(np.full(len(f), -1 if ids[i] is None else ids[i]))
                keys.append(np.full(len(f), _key(buf[offs[i] : offs[i + 1]])))
        if fps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(times).astype(np.int32))], names=["fp", "doc", "key", "times"])


RUN, TEXTS = "fp long, doc long, key long, times int", "i long, key long, t string, n_words long"


class FingerprintIndex:
    """Sorted immutable runs (fp, doc, key, times) in buckets of fp and the texts of their batches (i, key, t, n_words), in a folder
    that all executors share. What a path already holds is history, in as many buckets as it has. Without `keep` no texts are
    kept: for an index that takes one batch only."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: bool = True, buckets: int | None = None) -> None:
        self.spark, self.path, self.keep = spark, path or new_path(spark, "runs"), keep
        # run-A-B-N holds batches A to B in N buckets; runs within a compacted one are behind it
        spans = [tuple(map(int, n.split("-")[1:])) for n in self._stored() if n.startswith("run-")] if path else []
        self.runs = sorted((a, z) for a, z, _ in spans if not any((b, y) != (a, z) and b <= a and z <= y for b, y, _ in spans))
        self.buckets = spans[0][2] if spans else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made = max((z + 1 for _, z in self.runs), default=0)
        self._names: dict[tuple[int, int], str] = {}

    def _stored(self) -> list[str]:
        """The finished tables in the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return [n for n in names if fs.exists(path(f"{self.path}/{n}/_SUCCESS"))]

    def run(self, span: tuple[int, int]) -> DataFrame:
        """One run as a table whose buckets the planner knows."""
        if span not in self._names:
            name = f"codeloom_run_{uuid.uuid4().hex}"
            at = self._at(span).replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({RUN.replace('long', 'bigint')}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{at}'")
            self._names[span] = name
        return self.spark.table(self._names[span])

    def _at(self, span: tuple[int, int]) -> str:
        return f"{self.path}/run-{span[0]:05d}-{span[1]:05d}-{self.buckets}"

    def _write(self, rows: DataFrame, span: tuple[int, int]) -> None:
        name = f"codeloom_run_{uuid.uuid4().hex}"
        # an unfinished run of a lost driver is replaced
        rows.repartition(self.buckets, "fp").write.mode("overwrite").bucketBy(self.buckets, "fp").sortBy("fp").option("path", self._at(span)).saveAsTable(name)
        self._names[span] = name
        self.runs = sorted([r for r in self.runs if not span[0] <= r[0] <= r[1] <= span[1]] + [span])

    def read(self) -> DataFrame | None:
        """The rows of all runs."""
        return reduce(DataFrame.unionByName, map(self.run, self.runs)) if self.runs else None

    def texts(self, batches: int) -> DataFrame:
        """The texts of the first batches that are long enough for a window."""
        return self.spark.read.schema(TEXTS).parquet(*(f"{self.path}/texts-{k:05d}" for k in range(batches)))

    def _repeated(self, fps: DataFrame) -> DataFrame:
        """Those of some distinct fingerprints that occur twice or more in all runs; buckets are merged, no run is shuffled."""
        out, total = fps, F.lit(0)
        for k, span in enumerate(self.runs):
            out = out.join(self.run(span).groupBy("fp").agg(F.sum("times").alias(f"n{k}")), "fp", "left")
            total = total + F.coalesce(F.col(f"n{k}"), F.lit(0))
        return out.filter(total > 1).select("fp")

    def _held(self, fps: DataFrame) -> DataFrame:
        """(doc, key, fps) for each document of any run that holds some of these fingerprints."""
        rows = [self.run(span).join(fps, "fp", "left_semi") for span in self.runs]
        return reduce(DataFrame.unionByName, rows).groupBy("doc", "key").agg(F.array_distinct(F.collect_list("fp")).alias("fps"))

    def add_batch(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """Append a run for these texts; (doc, key, fps) for each document, old or new, that holds fingerprints of this batch
        which now occur twice or more."""
        given = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
        if self.keep:  # before the run: a batch counts once its run is whole
            map_arrow(given, _tag_rows, TEXTS).filter(F.col("n_words") >= WINDOW).write.mode("overwrite").parquet(f"{self.path}/texts-{self.made:05d}")
        span = (self.made, self.made)
        self._write(map_arrow(given, _fingerprint_rows, RUN), span)
        self.made += 1
        if len(self.runs) == 1:
            again = self.run(span).groupBy("fp").agg(F.sum("times").alias("n")).filter("n > 1").select("fp")
        else:
            again = stash(self._repeated(self.run(span).select("fp").distinct()), "again")
        out = stash(self._held(again), "found")
        self.compact()
        return out

    def close(self) -> None:
        """Forget the names under which the session knows the runs; the files stay, unless the index took one batch only."""
        while self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._names.popitem()[1]}")
        if not self.keep:
            remove_path(self.spark, self.path)

    def compact(self) -> None:
        """LEVEL neighbours of one size become one run, as long as there are any."""
        while len(last := self.runs[-LEVEL:]) == LEVEL and len({z - a for a, z in last}) == 1:
            self._write(reduce(DataFrame.unionByName, map(self.run, last)), (last[0][0], last[-1][1]))

    def shared(self, found: DataFrame) -> DataFrame:
        """(doc, key, fps, shown) for the documents of `found`, with every fingerprint that occurs twice or more in history, and
        (not shown) for all others that hold one of those: old repeats between old documents count in their new values too."""
        shown = found.select("doc", "key")
        theirs = reduce(DataFrame.unionByName, [self.run(span).join(shown, ["doc", "key"], "left_semi").select("fp") for span in self.runs]).distinct()
        again = stash(self._repeated(theirs), "again")
        return stash(self._held(again).join(shown.withColumn("shown", F.lit(True)), ["doc", "key"], "left").withColumn("shown", F.coalesce("shown", F.lit(False))), "shared")


def _sha(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _kept(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> list[bytes]:
    data = buf.tobytes()
    return [data[a:z] for a, z in zip(starts[keep].tolist(), ends[keep].tolist())]


def _candidates(h: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Which windows of one text have one of these fingerprints (sorted)."""
    m, _ = window_minima(h)
    at = np.searchsorted(fps, m)
    return fps[np.minimum(at, len(fps) - 1)] == m


def _digests(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = window_hashes(h, WINDOW)[at]
    two = (window_hashes(mix(h ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)[at] >> np.uint64(32)).astype(np.uint32)
    return one, two


def _tag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key, text as they are, with counts and digests of texts that lose nothing."""
    for b in slices(batches, "t"):
        buf, offs = text_bytes(b.column(1))
        starts, _, first = word_spans(buf, offs)
        keys = [_key(buf[i:j]) for i, j in zip(offs, offs[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), b.column(1), pa.array(np.diff(first))], names=["i", "key", "t", "n_words"])


def _blocks(ranges: int):
    width = np.uint64(min((1 << 64) // ranges + 1, (1 << 64) - 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = [], []
        for t, fps in zip(pdf["t"], pdf["fps"]):
            _, _, _, _, _, h = _texts(pa.array([t]))
            at = np.flatnonzero(_candidates(h, np.sort(np.asarray(fps, np.int64).view(np.uint64))))
            a, b = _digests(h, at)
            one.append(a)
            two.append(b)
        rec = np.empty(sum(map(len, one)), [("a", "<u8"), ("b", "<u4")])
        if not len(rec):
            return pd.DataFrame({"src": [], "r": [], "block": [], "twice": []}).astype({"src": "int32", "r": "int32"})
        rec["a"], rec["b"] = np.concatenate(one), np.concatenate(two)
        by = np.lexsort((rec["b"], rec["a"]))
        rec = rec[by]
        fresh = np.ones(len(rec), bool)
        fresh[1:] = rec[1:] != rec[:-1]
        heads = np.flatnonzero(fresh)
        twice = np.diff(np.append(heads, len(rec))) > 1
        rec = rec[heads]
        part = np.minimum((rec["a"] // width).astype(np.int64), ranges - 1)
        cuts = np.flatnonzero(np.diff(part)) + 1
        parts = [(int(p[0]), r.tobytes(), t.tobytes()) for p, r, t in zip(np.split(part, cuts), np.split(rec, cuts), np.split(twice, cuts))]
        return pd.DataFrame({"src": int(pdf["src"].iloc[0]), "r": [x[0] for x in parts], "block": [x[1] for x in parts], "twice": [x[2] for x in parts]})

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    recs = [np.frombuffer(x, [("a", "<u8"), ("b", "<u4")]) for x in pdf["block"]]
    twice = [np.frombuffer(x, bool) for x in pdf["twice"]]
    rec, many = np.concatenate(recs), np.concatenate(twice)
    who = np.repeat(np.arange(len(recs)), [len(x) for x in recs])
    by = np.lexsort((rec["b"], rec["a"]))
    rec, many, who = rec[by], many[by], who[by]
    same = np.zeros(len(rec), bool)
    same[1:] = rec[1:] == rec[:-1]
    again = many | same
    again[:-1] |= same[1:]
    # a digest that is repeated in one slice is so in every other
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(rec))))
    group = np.zeros(len(rec), bool)
    group[head[again]] = True
    hit = np.flatnonzero(group[head])
    hit = hit[np.argsort(who[hit], kind="stable")]
    w, cuts = who[hit], np.flatnonzero(np.diff(who[hit])) + 1
    src = pdf["src"].to_numpy()
    out = [(int(src[x[0]]), r.tobytes()) for x, r in zip(np.split(w, cuts), np.split(rec[hit], cuts)) if len(x)]
    return pd.DataFrame({"src": [x[0] for x in out], "block": [x[1] for x in out]}).astype({"src": "int32"})


def _remove(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    docs = docs[docs["shown"].astype(bool)]
    if not len(docs):
        return pd.DataFrame({"i": [], "n_words": [], "n_removed": [], "kept_sha256": []}, dtype=object).astype({"i": "int64", "n_words": "int64", "n_removed": "int64"})
    rec = np.concatenate([np.frombuffer(x, [("a", "<u8"), ("b", "<u4")]) for x in found["block"]] or [np.zeros(0, [("a", "<u8"), ("b", "<u4")])])
    rec = rec[np.lexsort((rec["b"], rec["a"]))]
    out = []
    for t, fps in zip(docs["t"], docs["fps"]):
        buf, _, starts, ends, _, h = _texts(pa.array([t]))
        at = np.flatnonzero(_candidates(h, np.sort(np.asarray(fps, np.int64).view(np.uint64))))
        a, b = _digests(h, at)
        gone = np.zeros(len(h) + 1, np.int64)
        if len(rec):
            # equal first halves are rare; compare both halves over the few places that share the first
            lo, hi = np.searchsorted(rec["a"], a, "left"), np.searchsorted(rec["a"], a, "right")
            hit = np.zeros(len(a), bool)
            for k in range(int((hi - lo).max(initial=0))):
                live = lo + k < hi
                hit[live] |= rec["b"][lo[live] + k] == b[live]
            w = at[hit]
            gone = np.bincount(w, minlength=len(h) + 1) - np.bincount(np.minimum(w + WINDOW, len(h)), minlength=len(h) + 1)
        keep = np.cumsum(gone)[: len(h)] == 0
        out.append((len(h), int((~keep).sum()), _sha(_kept(buf, starts, ends, keep))))
    return pd.DataFrame({"i": docs["i"], "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], "kept_sha256": [x[2] for x in out]})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", index: FingerprintIndex | None = None) -> DataFrame:
    """id_col, n_words, n_removed and kept_sha256 for every row of docs, which become one batch of `index` (a new one if not given),
    and anew for every row of its earlier batches that shares a fingerprint with this one: the last row of a document holds."""
    index = index or FingerprintIndex(docs.sparkSession, keep=False)
    if not index.keep and index.made:
        raise ValueError("an index without texts takes one batch")
    before = index.made
    found = index.add_batch(docs, id_col, text)
    rows = map_arrow(docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")), _tag_rows, TEXTS)
    if before:
        found = index.shared(found)
    index.close()  # all that is left to do reads stashed tables and texts
    held = (found if before else found.withColumn("shown", F.lit(True))).select("doc", F.col("key").alias("k"), "fps", "shown")
    same = lambda r: (F.coalesce(r.i, F.lit(-1)) == held.doc) & (r.key == held.k)
    old = index.texts(before) if before else None
    rows = rows.join(held, same(rows), "left")
    if old is not None:
        rows = rows.unionByName(old.join(held, same(old)))
    # the texts that hold repeated fingerprints are laid out in slices, the others are done
    base = stash(map_arrow(rows.select("i", "key", "n_words", F.when(F.col("fps").isNotNull(), F.col("t")).alias("t"), "fps", F.when(F.col("fps").isNull(), F.col("t")).alias("done"), "shown"), _settle, "i long, key long, n_words long, t string, fps array<long>, kept_sha256 string, place long, shown boolean"), "rows")
    drop_stash(found)
    done = base.filter("fps IS NULL").select("i", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    live = base.filter("fps IS NOT NULL")
    words = live.select(F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()["w"]
    ranges, groups = (max(1, min(MOST_PARTS, words // size)) for size in (RANGE_DIGESTS, SLICE_WORDS))
    # a slice and a range are a task each, whatever the number of either
    live = live.select("i", "t", "fps", "shown", F.pmod("place", F.lit(groups)).cast("int").alias("src")).repartitionById(groups, "src")
    blocks = live.groupBy("src").applyInPandas(_blocks(ranges), "src int, r int, block binary, twice binary").repartitionById(ranges, "r")
    hits = blocks.groupBy("r").applyInPandas(_merge, "src int, block binary").repartitionById(groups, "src")
    gone = live.groupBy("src").cogroup(hits.groupBy("src")).applyInPandas(_remove, "i long, n_words long, n_removed long, kept_sha256 string")
    return done.unionByName(gone).select(F.col("i").alias(id_col), "n_words", "n_removed", "kept_sha256")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of texts that lose nothing; for the others a number that spreads them, repeated rows too."""
    seen = 0
    for b in batches:
        live = b.column(4).is_valid().to_pylist()
        sha = [None if is_live else _sha([] if x is None else x.split()) for x, is_live in zip(pc.cast(b.column(5), pa.binary()).to_pylist(), live)]
        key = pc.fill_null(b.column(1), 0).to_numpy(zero_copy_only=False).view(np.uint64)
        place = mix(key ^ (np.arange(seen, seen + b.num_rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(1)
        seen += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sha, pa.string()), pa.array(place.view(np.int64)), b.column(6)], names=["i", "key", "n_words", "t", "fps", "kept_sha256", "place", "shown"])
