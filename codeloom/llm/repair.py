"""Token-id output in Re-Pair compressed shards.

File format: Parquet tables in a folder, one row a shard; shards of one part stand in ascending document order, parts follow
one another. A shard holds whole documents, about SHARD_IDS ids, and
  part, seq     where it stands
  base          ids of its part before it
  docs          document ids (int64; NULL_ID for a null one)
  starts        for each document the index of its first symbol in `body` (uint32, one more at the end)
  sizes         ids of each document (uint32)
  rules         pairs of symbols (uint32); the k-th is symbol VOCAB + k
  lengths       ids that each rule expands to (uint32)
  body          symbols (uint16 if all fit, else uint32; `wide` says which)
with VOCAB the vocabulary's size. Re-Pair: pairs of symbols that are frequent in the shard become rules, again and again, until
no pair is frequent enough; pairs never hold the end id, so a document starts at a symbol and is decoded alone, and the stored
lengths tell how far any symbol reaches.

Texts are cut at ASCII white space into words that the tokenizer encodes independently (its normalizer, pre-tokenizer and
special strings never reach over white space), and a worker remembers the ids of words; for a tokenizer of which that is not
known to hold, whole texts go to the library. Documents are dealt to parts by ranges of their ids, so a part is bounded by its
range and written by one task in pieces; an id that many rows share is dealt on by ranges of a checksum of its token ids.

Defined results: a null or empty text is the end id alone; rows that repeat an id follow one another in the order of the CRC-32
of their token ids, then of these; null ids come first. Ids must be whole numbers or texts of such. A very long text is a slice
of its own, and may make a longer shard. Extra columns are not written, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, map_arrow, new_path, remembered, slices, text_bytes, word_hashes, word_spans

#: Ids of a shard; the pairs that one round replaces at most, and how often a pair must occur.
SHARD_IDS, ROUND_RULES, OFTEN = 400_000, 8192, 4
END, NULL_ID = 2, -(1 << 63)
REMEMBERED = 2_000_000

_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_LETTER[65:91] = _LETTER[97:123] = True

_encoders: dict[str, Encoder] = {}
remembered.append(_encoders)


class Encoder:
    """Token ids of texts by one tokenizers file, with a memory of words.

    Words end at ASCII white space, and at a full stop or the like after an ASCII letter, where the pre-tokenizer cuts too. The
    normalizer lower-cases, so ASCII capitals are lower-cased first, unless the slice may hold a special string. Words are
    known by 64 bits of hash.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self._forget()
        self.by_words = True
        self.by_words = all(self.encode(pa.array([t]))[0][:-1].tolist() == self.tok.encode(t, add_special_tokens=False).ids for t in self.PROBES)

    #: Texts that a tokenizer must encode as their words, else it gets whole texts: cases, cuts, spaces, signs, other scripts.
    PROBES = ["Ab aB. cd,Ef  gh\tij\r\nkl", "x.y z!? don't we've I'LL 3.14 1,000", " lead and trail ", "a\u00a0b\u3000c\u200bd", "ÀÉß ĳ İI Σς", "中文 字。あい", "#tag <b> a|b <|x|> _u_ --- ...", "é e\u0301 ﬁ ½"]

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.offs = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """One call for all words; a token belongs to the word that its first character lies in."""
        got = self.tok.encode(" ".join(words), add_special_tokens=False)
        begins = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        owner = np.searchsorted(begins, np.fromiter((o[0] for o in got.offsets), np.int64), "right") - 1
        n = np.bincount(owner, minlength=len(words))
        at = np.searchsorted(self.keys, keys)
        new = len(self.offs) - 1 + np.arange(len(words))
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, new)
        self.flat = np.concatenate([self.flat, np.array(got.ids, np.uint32)])
        self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(n)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with END, one after another; the end of each text)."""
        if not self.by_words:
            got = [[*self.tok.encode(t or "", add_special_tokens=False).ids, END] for t in texts.to_pylist()]
            return np.array([i for ids in got for i in ids], np.uint32), np.cumsum([len(x) for x in got])
        buf, offs = text_bytes(texts)
        if not ((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))).any():
            buf = LOWER[buf]
        starts, ends, first = word_spans(buf, offs, breaks=np.flatnonzero(_STOP[buf[1:]] & _LETTER[buf[:-1]]) + 1)
        keys, at, word = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            data = buf.tobytes()
            self._learn(keys[new], [data[x:y].decode() for x, y in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            place = np.searchsorted(self.keys, keys)
        slot = self.slot[place][word] if len(keys) else np.zeros(0, np.int64)
        begin, size = self.offs[slot], self.offs[slot + 1] - self.offs[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        stops = total[first[1:]]  # ids up to each text's end, without the end ids
        ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return np.insert(ids, stops, END), stops + np.arange(1, len(stops) + 1)


def encoder(path: str) -> Encoder:
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def _spread(keys: np.ndarray, shift: int = 47) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)


def compress(ids: np.ndarray, vocab: int, most: int = ROUND_RULES, often: int = OFTEN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, body): each round makes rules of the most frequent pairs and replaces them from left to right, until no pair
    occurs `often` times."""
    body, rules, size = ids.astype(np.uint64), [np.zeros((0, 2), np.uint32)], np.ones(vocab, np.int64)
    while len(body) > 1:
        keys = (body[:-1] << np.uint64(32)) | body[1:]
        inner = (body[:-1] != END) & (body[1:] != END)
        place = _spread(keys, 44)
        inner &= np.bincount(place[inner], minlength=1 << 20)[place] >= often  # pairs in a rarer place are too rare themselves
        s = np.sort(keys[inner])
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(s)))
        # the floor rises with the best, so that rare pairs wait for what the frequent ones become
        levels = np.cumsum(np.bincount(np.minimum(count, 4095))[::-1])[::-1]  # pairs that occur so often or more
        floor = max(often, int(np.searchsorted(-levels, -most)))
        pairs = s[head[count >= floor]]
        if not len(pairs):
            break
        table = np.zeros(1 << 17, np.int64)
        table[_spread(pairs)] = np.arange(len(pairs))  # of pairs that share a place one is replaced now
        some = np.flatnonzero(inner)
        found = table[_spread(keys[some])]
        hit = pairs[found] == keys[some]
        at, found = some[hit], found[hit]
        # of places that follow one another every second is replaced
        head = np.ones(len(at), bool)
        head[1:] = at[1:] != at[:-1] + 1
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        at, found = at[run % 2 == 0], found[run % 2 == 0]
        seen = np.bincount(found, minlength=len(pairs)) > 0
        used, found = np.flatnonzero(seen), (np.cumsum(seen) - 1)[found]
        new = np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        body[at] = np.uint64(len(size)) + found.astype(np.uint64)
        keep = np.ones(len(body), bool)
        keep[at + 1] = False
        body = body[keep]
        size = np.concatenate([size, size[new[:, 0]] + size[new[:, 1]]])
        rules.append(new)
    return np.concatenate(rules), size[vocab:].astype(np.uint32), body.astype(np.uint32)


def expand(body: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocab: int) -> np.ndarray:
    """The ids of some symbols."""
    if not len(rules):
        return body.astype(np.uint32)
    # every rule's expansion, shorter rules first: both halves are known when a rule is reached
    size = np.concatenate([np.ones(vocab, np.int64), lengths.astype(np.int64)])
    offs = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    flat = np.empty(offs[-1], np.uint32)
    todo = np.arange(len(rules))
    done = np.ones(vocab + len(rules), bool)
    done[vocab:] = False
    while len(todo):
        ready = todo[done[rules[todo]].all(1)]
        for side in (0, 1):
            sym = rules[ready, side].astype(np.int64)
            to = offs[ready] + (size[rules[ready, 0].astype(np.int64)] if side else 0)
            plain = sym < vocab
            flat[to[plain]] = sym[plain]
            src, dst, n = offs[sym[~plain] - vocab], to[~plain], size[sym[~plain]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(dst, n) + step] = flat[np.repeat(src, n) + step]
        done[vocab + ready] = True
        todo = todo[~done[vocab + todo]]
    sym = body.astype(np.int64)
    n = size[sym]
    out = np.empty(n.sum(), np.uint32)
    begin = np.cumsum(n) - n
    plain = sym < vocab
    out[begin[plain]] = sym[plain]
    src, dst, n = offs[sym[~plain] - vocab], begin[~plain], n[~plain]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(dst, n) + step] = flat[np.repeat(src, n) + step]
    return out


def part_of(bounds: np.ndarray, doc: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The part of each document. A bound that is repeated stands for an id that fills several parts; its rows are dealt to them by
    their checksums, and those of equal checksums, in any order, stay together."""
    low, high = (np.searchsorted(bounds, doc.astype(np.float64), side) for side in ("left", "right"))
    spread = low + ((high - low + 1) * crc >> 32)
    return np.where(high - low > 1, spread, high).astype(np.int32)


SHARD = "part int, seq int, base long, n_ids long, docs binary, starts binary, sizes binary, rules binary, lengths binary, body binary, wide boolean"


def write(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> None:
    """Encode every row's text and write the shards to a folder; `tokenizer` is the path of a tokenizers file on every machine."""
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t"))
    every = rows.select(F.coalesce("i", F.lit(NULL_ID)).alias("i"))
    bounds = np.array(sorted(every.approxQuantile("i", [k / parts for k in range(1, parts)], 1 / (4 * parts))), np.float64)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = np.uint16 if enc.vocab <= 1 << 16 else np.uint32
        for b in slices(batches, "t", 2 << 20):  # the memory of words is renewed once a slice
            ids, ends = enc.encode(b.column(1))
            cuts = np.concatenate([[0], ends])
            ids = ids.astype(kind)
            doc = b.column(0).fill_null(NULL_ID).to_numpy()
            each = [ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
            crc = np.array([zlib.crc32(x) for x in each], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(bounds, doc, crc)), pa.array(doc), pa.array(crc), pa.array(each, pa.binary())], names=["part", "i", "crc", "ids"])

    vocab = encoder(tokenizer).vocab

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint16 if vocab <= 1 << 16 else np.uint32
        part, seq, base, held, size = -1, 0, 0, [], 0

        def row() -> pa.RecordBatch:
            n = np.array([len(x) // kind().nbytes for _, x in held], np.uint32)
            rules, lengths, body = compress(np.frombuffer(b"".join(x for _, x in held), kind), vocab)
            last = np.flatnonzero(body == END)  # the end id is in no rule
            starts = np.concatenate([[0], last + 1]).astype(np.uint32)
            wide = vocab + len(rules) > 1 << 16
            values = [part, seq, base, int(n.sum()), np.array([i for i, _ in held], np.int64).tobytes(), starts.tobytes(), n.tobytes(), rules.tobytes(), lengths.tobytes(), body.astype(np.uint32 if wide else np.uint16).tobytes(), wide]
            names = [x.split()[0] for x in SHARD.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for b in batches:
            for p, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held and (p != part or size >= SHARD_IDS):
                    yield row()
                    seq, base, held, size = seq + 1, base + size, [], 0
                if p != part:
                    part, seq, base = p, 0, 0
                held.append((i, x))
                size += len(x) // kind().nbytes
        if held:
            yield row()

    dealt = map_arrow(rows, tokens, "part int, i long, crc long, ids binary", keep=True).repartition(parts, "part").sortWithinPartitions("part", "i", "crc", "ids").drop("crc")
    map_arrow(dealt, shards, SHARD).write.option("compression", "zstd").parquet(path)


def _shard(row: dict) -> tuple[np.ndarray, ...]:
    u32 = lambda k: np.frombuffer(row[k], np.uint32)
    return np.frombuffer(row["docs"], np.int64), u32("starts"), u32("sizes"), u32("rules").reshape(-1, 2), u32("lengths"), np.frombuffer(row["body"], np.uint32 if row["wide"] else np.uint16)


def read(spark: SparkSession, path: str, vocab: int, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id_col, start, n_tokens and ids_crc32 (and ids) of every document in the files."""
    files = spark.read.parquet(path)
    before, total = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"]):  # a row a part
        before[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                docs, _, sizes, rules, lengths, body = _shard(row)
                ids = expand(body, rules, lengths, vocab)
                ends = np.cumsum(sizes, dtype=np.int64)
                begins = ends - sizes
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(begins, ends)]
                out = [pa.array([None if i == NULL_ID else i for i in docs.tolist()], pa.int64()), pa.array(begins + before[row["part"]] + row["base"]), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([ids[x:y].tolist() for x, y in zip(begins, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return map_arrow(files, run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def document(row: dict, k: int, vocab: int) -> np.ndarray:
    """The ids of the k-th document of a shard, from its own symbols only."""
    _, starts, _, rules, lengths, body = _shard(row)
    return expand(body[starts[k] : starts[k + 1]], rules, lengths, vocab)


def token_ids(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write df's texts as shards in the shared folder and return what `read` finds there."""
    path = new_path(df.sparkSession, "shards")
    write(df, tokenizer, path, id_col, text)
    return read(df.sparkSession, path, encoder(tokenizer).vocab, id_col)
