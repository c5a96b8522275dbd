"""Token counts of whole texts: batches balanced by bytes, long texts split where no token can cross, only lengths returned.

A text may be split at a single space between two characters that are neither a space nor U+2581: the model writes a space
as U+2581, puts one before the text, and none of its pieces holds U+2581 after another character (checked when the model is
loaded), so each side gives the tokens that it gives within the whole. Sides that recur are counted once for each worker.

Defined results: a null text is empty and has no tokens; over_limit is n_tokens > limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import map_arrow, slices

LIMIT = 4096
#: Bytes of text that one call of the library gets, and texts that a worker remembers.
CALL_BYTES, REMEMBERED = 256 << 10, 400_000

_SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


class Counter:
    """Counts tokens of one sentencepiece model."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.splits = all("▁" not in self.sp.id_to_piece(i).lstrip("▁") for i in range(self.sp.get_piece_size()))
        self.known: dict[str, int] = {}

    def _learn(self, parts: list[str]) -> None:
        size, call = 0, []
        for p in parts:
            call.append(p)
            size += 4 * len(p)
            if size >= CALL_BYTES:
                self._call(call)
                size, call = 0, []
        if call:
            self._call(call)

    def _call(self, parts: list[str]) -> None:
        self.known.update(zip(parts, map(len, self.sp.encode(parts, num_threads=1))))

    def counts(self, texts: list[str]) -> np.ndarray:
        if not self.splits:  # no safe boundary in this model
            return np.array([len(x) for x in self.sp.encode(texts, num_threads=1)], np.int64)
        cut = [t.split(" ") if "  " not in t and "▁" not in t and t[:1] != " " and t[-1:] != " " else _SAFE.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        self._learn(list({p for c in cut for p in c if p not in known}))
        return np.array([sum(map(known.__getitem__, c)) for c in cut], np.int64)


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, model: str, text: str = "text", id_col: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit for every row; `model` is the path of a sentencepiece file on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(model) or _counters.setdefault(model, Counter(model))
        for b in slices(batches, "t"):
            t = pc.fill_null(b.column(1), "")
            n = counter.counts(t.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(t), pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(df.dtypes)[id_col]
    return map_arrow(df.selectExpr(f"`{id_col}` AS i", f"`{text}` AS t"), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
