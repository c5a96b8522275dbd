"""What the corpus operators share: tables in the shared folder, Arrow slices of whole texts, word scanning and hashing.

Hashes are 64-bit and depend on bytes only, so every executor and every rerun gives the same values.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows and bytes of the batches in which rows come to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes that a writer or reader of a table between two steps holds at once.
ROW_GROUP = 16 << 20

_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None

WHITE = bytes([9, 10, 11, 12, 13, 32])

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run here."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="codeloom-")
    return f"file://{_own_dirs[app]}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    jvm = spark._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is temporary
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/codeloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def stash(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df in the shared folder and read it again: lineage ends here and survives the loss of executors. A narrow table (a few
    numbers for a small part of the rows) goes to an eighth as many files as there are shuffle partitions; what makes it keeps all
    of its tasks."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    if narrow:
        df = df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 8, 1))
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    del df
    gc.collect()
    if not narrow:
        spark._jvm.System.gc()  # shuffle files of finished steps are freed
    return spark.read.schema(schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        remove_path(df.sparkSession, f.rsplit("/", 1)[0])


def settle(spark: SparkSession) -> None:
    """Executors give heap that finished work has left back to the system, by a collection in each: a heap grows step by step and does
    not shrink by itself, while Python workers beside it need memory of their own. Nothing depends on it; one task a core reaches
    every executor that is idle."""
    n = spark.sparkContext.defaultParallelism
    try:
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
    except Exception:  # noqa: BLE001  where a platform forbids the call, memory stays as it is
        pass


def columns_free_of(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that do not clash with columns of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


# ---------------------------------------------------------------- slices of texts


#: What a worker remembers for an operator, such as the ids of words; tasks of other operators clear it.
remembered: list[dict] = []


def forget() -> None:
    for cache in remembered:
        cache.clear()


def map_arrow(df: DataFrame, run, schema: str, keep: bool = False) -> DataFrame:
    """df.mapInArrow with batches of bounded size: unless the session asks for less, BATCH_ROWS rows and BATCH_BYTES bytes, which a
    single longer row may exceed; `keep` lets the worker remember. The defaults of 10,000 rows and 64 MB take a multiple of that for every task on either side."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        yield from run(batches)
        trim()

    return df.mapInArrow(tidied, schema)


def trim() -> None:
    """Give memory that a finished kernel has freed back to the system: workers live on and serve other operators."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidy() -> None:
    """The same with what only Python's collector frees."""
    gc.collect()
    trim()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of text, or one longer text. Nothing is dropped."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        if n.sum() <= most:
            if b.num_rows:
                yield b
            continue
        group = np.cumsum(n) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)
        tidy()


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    arr = pc.fill_null(arr, "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def _lut(words: bool) -> np.ndarray:
    t = np.ones(256, bool)
    if words:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased
        t[0x00:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = False
    else:  # [^\x20\x09-\x0D]
        t[list(WHITE)] = False
    return t


#: Bytes of words between white space, and of words made of letters and digits.
SPACED, ALNUM = _lut(False), _lut(True)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offs: np.ndarray, lut: np.ndarray = SPACED, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words as byte spans of buf, and for each text the index of its first word, with the total last.
    At `breaks` a word ends and another begins."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = lut[buf]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    heads = offs[:-1][offs[:-1] < len(buf)]
    if breaks is not None:
        heads = np.concatenate([heads, breaks])
    before[heads] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[heads[heads > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


# ---------------------------------------------------------------- hashing

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit; works in place."""
    h ^= h >> np.uint64(30)
    h *= _C2
    h ^= h >> np.uint64(27)
    h *= _C3
    h ^= h >> np.uint64(31)
    return h


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes a step."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    view = np.ndarray((len(buf) + 1,), "<u8", buffer=padded.data, strides=(1,))
    lens = ends - starts
    h = mix((view[starts] & _MASK[np.minimum(lens, 8)]) ^ (lens.astype(np.uint64) * _C1))
    at, rest = 8, np.flatnonzero(lens > 8)
    while len(rest) and at < _LONG:
        more = view[starts[rest] + at] & _MASK[np.minimum(lens[rest] - at, 8)]
        h[rest] = mix((h[rest] * _C1) ^ more)
        at += 8
        rest = rest[lens[rest] > at]
    for i in rest:  # very long words
        h[i] = np.frombuffer(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _C1 + (b ^ _C3))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values, by doubling; empty if there are fewer than k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    part, size, out, have = h, 1, None, 0
    while k:
        if k & 1:
            if out is None:
                out, have = part, size
            else:
                n = min(len(out), len(part) - have)
                out, have = _join(out[:n], part[have : have + n]), have + size
        k >>= 1
        if k:
            part, size = _join(part[:-size], part[size:]), size * 2
    return out


def digest(values: np.ndarray) -> bytes:
    """16 bytes that stand for a sequence of 64-bit values."""
    return hashlib.blake2b(values.astype("<u8").tobytes(), digest_size=16).digest()


# ---------------------------------------------------------------- bounded id filters

#: Bits of an id filter; its size is fixed, so it may go to every executor whatever the number of ids. Ids that share a bit
#: with a wanted one pass too, and exact joins follow.
FILTER_BITS = 1 << 22


def filter_place(col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A bit for every place that an id of ids[col] takes, combined on the executors."""
    h = ids.select(filter_place(col).alias("h"))
    words = h.select(F.floor(F.col("h") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h % 64 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def filter_words(keys: DataFrame, col: str) -> DataFrame:
    """The filter of keys[col] as a table of FILTER_BITS / 64 rows at most."""
    h = keys.select(filter_place(f"`{col}`").alias("h"))
    bits = h.select(F.floor(F.col("h") / 64).cast("int").alias("_w"), F.expr("shiftleft(1L, cast(h % 64 AS int))").alias("b")).groupBy("_w").agg(F.bit_or("b").alias("_b"))
    return stash(bits, "bits", True)


def filter_flag(df: DataFrame, col: str, words: DataFrame, flag: str) -> DataFrame:
    """df with a column that tells whether the key in df[col] may be one of the filter's; the broadcast has a fixed size."""
    h, w, b = columns_free_of(df.withColumn(flag, F.lit(True)), "h", "w", "b")
    at = df.withColumn(h, filter_place(f"`{col}`")).withColumn(w, F.floor(F.col(h) / 64).cast("int"))
    hit = F.coalesce(F.expr(f"bit_get(`{b}`, cast(`{h}` % 64 AS int)) = 1"), F.lit(False))
    return at.join(F.broadcast(words.toDF(w, b)), w, "left").withColumn(flag, hit).drop(h, w, b)


def passes(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of these places have a bit."""
    return (bits.view(np.uint64)[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1) == 1
