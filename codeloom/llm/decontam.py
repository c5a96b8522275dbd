"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into segments. A segment is one row of a table in the shared folder: the terms of its words, for
each of them its postings, the places where it stands in the segment, and the documents' bounds. The index is made in one pass
and knows nothing of the tests, so any number of them can be looked up in it. A window of a test item (WINDOW consecutive
words, or the whole of a shorter item) is looked up in each segment from its rarest terms: the postings of the rarest, less its
offset in the window, are intersected with those of the next rarest, less its own offset, and so on; what is left when all
terms are used is where the window stands. Windows of equal words are looked up once, and windows that share their two rarest
terms and the distance between them share the first intersection. With slop > 0 a term may stand up to that many words from
its place: proximity matches.

Test items go to the executors in blocks of at most BLOCK_BYTES of text (a longer item is a block of its own), one after
another, so what is sent and what the driver holds is bounded whatever the size of the tests. Segments are independent: there
is no shuffle of texts or postings; where there are several blocks, their hits are merged by segment and place.

Defined results: null or empty texts have no words and are not contaminated; items without words have no windows. Item ids
are compared as strings and a repeated item counts once; a null id is the empty string. Rows of documents stay separate even
if they repeat an id; ids may be of any type and null. A text longer than a segment is one of its own, looked up in parts of
PART occurrences. Extra columns are ignored by `contamination` and kept by `clean`, whatever their names; words are known by 64
bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, columns_free_of, filter_flag, filter_words, map_arrow, new_path, slices, stash, text_bytes, window_hashes, word_hashes, word_spans

WINDOW = 13
#: Test text that is sent to the executors at once, occurrences that are followed up at once, and training text of a segment: its row
#: stays below what the JVM's collector has to place by itself.
BLOCK_BYTES, PART, SEGMENT_BYTES = 4 << 20, 1 << 20, 256 << 10


class Tests:
    """One block of test items: the hashes of their terms, and their distinct windows as numbers of terms, with the items that each
    stands in."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW) -> None:
        buf, offs = text_bytes(pa.array(texts, pa.string()))
        buf = LOWER[buf]
        starts, ends, first = word_spans(buf, offs, ALNUM)
        h = word_hashes(buf, starts, ends)
        self.terms, words = np.unique(h, return_inverse=True)
        self.ids, self.window = ids, window
        n = np.diff(first)
        short = np.flatnonzero((n > 0) & (n < window))
        full = window_hashes(h, window)
        owner = np.repeat(np.arange(len(n)), n)[: len(full)]
        begin = np.flatnonzero(np.arange(len(full)) + window <= first[1:][owner])
        item = np.concatenate([owner[begin], short])
        size = np.concatenate([np.full(len(begin), window), n[short]])
        begin = np.concatenate([begin, first[:-1][short]]).astype(np.int64)
        # windows of equal words are one; an item stands once in each
        inside = np.arange(window) < size[:, None]
        table = np.where(inside, words[np.where(inside, begin[:, None] + np.arange(window), begin[:, None])], -1).astype(np.int32).reshape(-1, window)
        self.table, which = np.unique(table, axis=0, return_inverse=True)
        self.size = (self.table >= 0).sum(1)
        # a window's term that the fewest windows have; where that is missing nothing else is asked
        often = np.append(np.bincount(self.table[self.table >= 0], minlength=len(self.terms)), np.iinfo(np.int64).max)
        self.probe = np.take_along_axis(self.table, often[self.table].argmin(1)[:, None], 1)[:, 0] if len(self.table) else np.zeros(0, np.int32)
        which = which.ravel()
        at = begin - first[:-1][item] if len(item) else begin
        by = np.lexsort((at, item, which))
        self.owner, self.owner_at, which = item[by], at[by], which[by]
        self.owners = np.searchsorted(which, np.arange(len(self.table) + 1))


def test_blocks(tests: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[Tests]:
    """The items in blocks of bounded size, drawn one at a time."""
    ids, texts, size = [], [], 0
    for r in tests.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).toLocalIterator():
        more = len((r["t"] or "").encode())
        if ids and size + more > BLOCK_BYTES:
            yield Tests(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r["i"] or "")
        texts.append(r["t"])
        size += more
    if ids:
        yield Tests(ids, texts, window)


PARTS = "shape array<int>, postings binary"
_CODEC = pa.Codec("zstd", 1)


def _packed(first: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray) -> tuple[list[int], bytes]:
    """(numbers of documents and terms, bytes) of a segment."""
    data = first.astype(np.int64).tobytes() + terms.tobytes() + counts.astype(np.int32).tobytes() + places.astype(np.int32).tobytes()
    return [len(first) - 1, len(terms), len(data)], _CODEC.compress(data, asbytes=True)


def index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments in the shared folder: seg, document ids, and packed: the place of each document's first word, terms, how often each
    stands in the segment, and its places."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", SEGMENT_BYTES):
            buf, offs = text_bytes(b.column(1))
            buf = LOWER[buf]
            starts, ends, first = word_spans(buf, offs, ALNUM)
            terms, t, counts = np.unique(word_hashes(buf, starts, ends), return_inverse=True, return_counts=True)
            shape, data = _packed(first, terms, counts, np.argsort(t, kind="stable"))
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([ids, pa.array([shape], pa.list_(pa.int32())), pa.array([data], pa.binary())], names=["ids", "shape", "postings"])

    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").alias("t"))
    # numbers of segments stand once they are written
    return stash(map_arrow(rows, run, f"ids array<{kind}>, {PARTS}").withColumn("seg", F.monotonically_increasing_id()), "segments")


class Segment:
    """One row of the index; `key` holds the postings as term * stride + place, which is their order too."""

    def __init__(self, row: dict) -> None:
        docs, terms, size = row["shape"]
        data = _CODEC.decompress(row["postings"], size, asbytes=True)
        self.bounds, self.terms = np.frombuffer(data, np.int64, docs + 1), np.frombuffer(data, np.uint64, terms, 8 * docs + 8)
        self.counts = np.frombuffer(data, np.int32, terms, 8 * (docs + 1 + terms))
        self.places = np.frombuffer(data, np.int32, -1, 8 * (docs + 1 + terms) + 4 * terms)
        self.n = int(self.bounds[-1])
        self.stride = self.n + 1
        self.lists = np.concatenate([[0], np.cumsum(self.counts, dtype=np.int64)])

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The segment's numbers of some terms, -1 for those that it lacks."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def stands(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term has a posting from one place to another."""
        found = self.next(term, low)
        return (found >= 0) & (found <= high)

    def next(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A term's first posting at a place or after it, -1 without one: a search in its sorted list."""
        if not hasattr(self, "key"):
            self.key = np.repeat(np.arange(len(self.counts)) * self.stride, self.counts) + self.places
        base = term * self.stride
        at = np.searchsorted(self.key, base + np.clip(place, 0, self.n))
        found = self.key[np.minimum(at, len(self.key) - 1)] - base
        return np.where((at < len(self.key)) & (found < self.stride), found, -1)


def _find(tests: Tests, seg: Segment, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, place of its first word) of every occurrence in one segment, in parts of bounded size."""
    if not len(tests.table) or not seg.n:
        return
    number = seg.numbers(tests.terms)
    have = np.append(np.where(number >= 0, seg.counts[np.maximum(number, 0)], 0), np.iinfo(np.int32).max)  # the last one is for -1
    live = np.flatnonzero(number[tests.probe] >= 0)
    often = have[tests.table[live]]
    some = often.min(1, initial=1) > 0
    live, often = live[some], often[some]
    if not len(live):
        return
    rare = np.argsort(often, axis=1, kind="stable")  # offsets, rarest first
    words, size = np.append(number, -1)[tests.table[live]], tests.size[live]
    first = rare[:, 0]
    second = np.where(size > 1, rare[:, min(1, tests.window - 1)], first)
    rows = np.arange(len(live))
    pairs, of = np.unique(np.stack([words[rows, first], words[rows, second], second - first]), axis=1, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    head = np.searchsorted(of.ravel()[order], np.arange(pairs.shape[1] + 1))
    k = seg.counts[pairs[0]].astype(np.int64)
    for which, step in _parts(k):  # occurrences of the rarest terms
        place = seg.places[seg.lists[pairs[0][which]] + step].astype(np.int64)
        if slop:  # the rarest term may stand off too; each place is taken from its first posting within reach
            which, posting = np.repeat(which, 2 * slop + 1), np.repeat(place, 2 * slop + 1)
            place = posting + np.tile(np.arange(-slop, slop + 1), len(place))
            ok = seg.next(pairs[0][which], place - slop) == posting
            which, place = which[ok], place[ok]
        other = place + pairs[2][which]
        ok = seg.stands(pairs[1][which], other - slop, other + slop)
        which, place = which[ok], place[ok]
        many = np.diff(head)[which]
        for at, step in _parts(many):  # each window of a pair
            w = order[head[which[at]] + step]
            start = place[at] - first[w]
            doc = np.searchsorted(seg.bounds, start, "right") - 1
            ok = (start >= 0) & (start + size[w] <= seg.n)
            ok[ok] = start[ok] + size[w[ok]] <= seg.bounds[doc[ok] + 1]
            w, start, doc = w[ok], start[ok], doc[ok]
            for j in range(0 if slop else 2, tests.window):  # places off by slop must be in the document too
                if not len(w):
                    break
                o = start + rare[w, j]
                low, high = np.maximum(o - slop, seg.bounds[doc]), np.minimum(o + slop, seg.bounds[doc + 1] - 1)
                ok = (j >= size[w]) | seg.stands(words[w, rare[w, j]], low, high)
                w, start, doc = w[ok], start[ok], doc[ok]
            if len(w):
                yield live[w], start


def _steps(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each of some numbers, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _parts(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, 0 to n - 1) for each of some numbers, PART of them at once."""
    ends = np.cumsum(n)
    for x in range(0, int(ends[-1]) if len(ends) else 0, PART):
        at = np.arange(x, min(x + PART, int(ends[-1])))
        which = np.searchsorted(ends, at, "right")
        yield which, at - (ends - n)[which]


def matches(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """A row for each occurrence of a test window: document, item, first word of the window in either, its words, exact or not. A
    window that stands in an item several times counts at each place."""
    segments, path = index(docs, id_col, text), new_path(docs.sparkSession, "matches")
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, item string, doc_word long, item_word long, words long, exact boolean"
    docs.sparkSession.createDataFrame([], schema).write.parquet(path)
    for block in test_blocks(tests, item_col, item_text, window):

        def run(batches: Iterator[pa.RecordBatch], block: Tests = block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, row in enumerate(b.select([x.split()[0] for x in PARTS.split(", ")]).to_pylist()):
                    seg, ids = Segment(row), b.column("ids")[i].values
                    for w, start in _find(block, seg, slop):
                        exact = np.ones(len(w), bool)
                        for j in range(window if slop else 0):
                            t = np.append(seg.numbers(block.terms), -1)[block.table[w, j]]
                            exact &= (j >= block.size[w]) | seg.stands(t, start + j, start + j)
                        many = np.diff(block.owners)[w]
                        at, doc = np.repeat(block.owners[w], many) + _steps(many), np.repeat(np.searchsorted(seg.bounds, start, "right") - 1, many)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(doc)), pa.array([block.ids[x] for x in block.owner[at]], pa.string()), pa.array(np.repeat(start, many) - seg.bounds[doc]), pa.array(block.owner_at[at]), pa.array(np.repeat(block.size[w], many)), pa.array(np.repeat(exact, many))],
                            names=[id_col, "item", "doc_word", "item_word", "words", "exact"],
                        )

        map_arrow(segments, run, schema).write.mode("append").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _covered(spans: np.ndarray) -> tuple[int, np.ndarray]:
    """How many places some spans (start, end) cover, and the spans of their union."""
    if not len(spans):
        return 0, spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    head = np.ones(len(spans), bool)
    head[1:] = spans[1:, 0] > end[:-1]
    at = np.flatnonzero(head)
    merged = np.stack([spans[at, 0], end[np.append(at[1:], len(spans)) - 1]], 1)
    return int((merged[:, 1] - merged[:, 0]).sum()), merged


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
HITS = "seg long, pos int, spans binary, items array<string>"


def _hits(block: Tests, seg: Segment) -> dict[int, tuple[np.ndarray, set[str]]]:
    """For each document of a segment that has any: (the union of the windows' spans, counted from its first word, its items)."""
    out: dict[int, tuple[np.ndarray, set[str]]] = {}
    for w, start in _find(block, seg, 0):
        doc = np.searchsorted(seg.bounds, start, "right") - 1
        by = np.argsort(doc, kind="stable")
        head = np.append(np.flatnonzero(np.diff(doc[by], prepend=-1)), len(by))
        for x, y in zip(head.tolist(), head[1:].tolist()):
            at, d = by[x:y], int(doc[by[x]])
            s, found = start[at] - seg.bounds[d], np.unique(w[at])
            many = np.diff(block.owners)[found]
            items = {block.ids[k] for k in np.unique(block.owner[np.repeat(block.owners[found], many) + _steps(many)]).tolist()}
            spans = np.stack([s, s + block.size[w[at]]], 1)
            if d in out:
                spans, items = np.concatenate([out[d][0], spans]), out[d][1] | items
            out[d] = _covered(spans)[1].astype(np.int64), items
    return out


def _result(ids: pa.Array, n: np.ndarray, hit: np.ndarray, items: list[list[str]], id_col: str) -> pa.RecordBatch:
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array((hit > 0) & (20 * hit >= n))], names=[id_col, *(x.split()[0] for x in RESULT.split(", "))])


def contamination(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col and RESULT for every row of docs: hit words, items found, and whether n_hit > 0 and 20 * n_hit >= n_words."""
    segments, kind = index(docs, id_col, text), dict(docs.dtypes)[id_col]
    schema, blocks = f"`{id_col}` {kind}, {RESULT}", test_blocks(tests, item_col, item_text, window)
    first, second = next(blocks, Tests([], [], window)), next(blocks, None)

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.select([x.split()[0] for x in PARTS.split(", ")]).to_pylist()):
                seg = Segment(row)
                found, n = _hits(first, seg), np.diff(seg.bounds)
                none = (np.zeros((0, 2), np.int64), set())
                each = [found.get(d, none) for d in range(len(n))]
                yield _result(b.column("ids")[i].values, n, np.array([int((s[:, 1] - s[:, 0]).sum()) for s, _ in each], np.int64), [list(x) for _, x in each], id_col)

    if second is None:
        return map_arrow(segments, all_rows, schema)
    path = new_path(docs.sparkSession, "hits")
    for block in chain([first, second], blocks):

        def some_rows(batches: Iterator[pa.RecordBatch], block: Tests = block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    found = _hits(block, Segment(row))
                    spans = [s.tobytes() for s, _ in found.values()]
                    yield pa.RecordBatch.from_arrays([pa.array([row["seg"]] * len(found), pa.int64()), pa.array(list(found), pa.int32()), pa.array(spans, pa.binary()), pa.array([sorted(x) for _, x in found.values()], pa.list_(pa.string()))], names=["seg", "pos", "spans", "items"])

        map_arrow(segments.drop("ids"), some_rows, HITS).write.mode("append").parquet(path)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.array([_covered(np.frombuffer(x or b"", np.int64).reshape(-1, 2))[0] for x in b.column(2).to_pylist()], np.int64)
            yield _result(b.column(0), b.column(1).to_numpy(), hit, [list(set(x or [])) for x in b.column(3).to_pylist()], id_col)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.select(["seg", "shape", "postings"]).to_pylist()):
                n = np.diff(Segment(row).bounds)
                yield pa.RecordBatch.from_arrays([pa.array([row["seg"]] * len(n), pa.int64()), pa.array(np.arange(len(n), dtype=np.int32)), b.column("ids")[i].values, pa.array(n)], names=["seg", "pos", "id", "n_words"])

    joined = F.expr("aggregate(collect_list(spans), cast('' AS binary), (a, x) -> concat(a, x))")
    found = docs.sparkSession.read.schema(HITS).parquet(path).groupBy("seg", "pos").agg(joined.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    rows = map_arrow(segments, listed, f"seg long, pos int, id {kind}, n_words long")
    return map_arrow(rows.join(found, ["seg", "pos"], "left").select("id", "n_words", "spans", "items"), settle, schema)


def clean(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The rows of docs that are not contaminated; rows that share an id go or stay together, null ids stay. Texts of rows whose id
    is surely clean are not shuffled."""
    bad, flag = columns_free_of(docs, "bad_id", "flag")
    gone = stash(contamination(docs, tests, id_col, **names).filter("contaminated").select(F.col(f"`{id_col}`").alias(bad)).filter(F.col(bad).isNotNull()).distinct(), "bad", True)
    asked, own = filter_flag(docs, id_col, filter_words(gone, bad), flag), [F.col(f"`{c}`") for c in docs.columns]
    rest = asked.filter(F.col(flag)).join(gone, F.col(f"`{id_col}`") == F.col(bad), "left_anti")
    return asked.filter(~F.col(flag)).select(own).unionByName(rest.select(own))
