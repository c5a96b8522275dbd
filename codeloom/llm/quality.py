"""Quality rules by repetition: a suffix array over the words of each text, its longest-common-prefix values, and the union
of the spans that repeat.

The suffix array is built by prefix doubling for a slice of texts at once: the text's number stands in the highest part of
every rank, so suffixes meet only suffixes of their own text, and after the first rounds only the suffixes still tied are
sorted again. From the groups of each round follow the longest common prefixes of neighbours (in texts that repeat so much that
the groups would take more than LEVEL_WORDS times their words, from the text, word by word); an interval of suffixes that
share a prefix of k words is a repeated substring, the maximal one where neither side can be extended. The longest repeat
at a position is the larger of its two neighbouring LCP values, and the union of all spans [i, i + longest(i)) with
longest(i) >= min_repeat is the text's repeated part.

Defined results: a null or empty text has no words, zero counts, base_failed true. Repeated rows give repeated results.
A very long text is a slice of its own; memory is about a dozen numbers a word. Columns of the input pass through
`quality_filter` unchanged whatever their names; `with_facts` replaces those that have the names of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, SPACED, text_bytes, word_hashes, word_spans

#: Words from which a repeated substring counts as a repeat; the share of words in such repeats, and the words of the
#: longest one, beyond which a text is rejected.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.2, 100

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, base_failed boolean, kept boolean"


def longest_repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every word, how many words the longest substring has that starts there and starts elsewhere in its text too.

    h: a hash a word; first: index of each text's first word, with the total last.
    """
    n = len(h)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    kind = np.int32 if n < 1 << 31 else np.int64
    counts = np.diff(first)
    owner, end = np.repeat(np.arange(len(counts), dtype=kind), counts), np.repeat(first[1:], counts).astype(kind)
    words, code = np.unique(h, return_inverse=True)
    # rank: the place in the suffix array where the group of suffixes begins that share the first k words
    tied, rank, k = np.arange(n, dtype=kind), np.zeros(n, kind), 1
    tied = _split(tied, rank, owner.astype(np.int64) * len(words) + code, np.zeros(n, kind))
    levels: list[tuple[int, np.ndarray, np.ndarray]] | None = [(1, tied, rank[tied])]
    held = len(tied)
    while len(tied):
        then = tied + kind(k)
        second = np.where(then < end[tied], rank[np.minimum(then, n - 1)] + 1, 0)
        tied = _split(tied, rank, rank[tied].astype(np.int64) * (n + 1) + second, rank[tied])
        k, held = 2 * k, held + len(tied)
        if levels is not None and held > LEVEL_WORDS * n:
            levels = None
        if levels is not None:
            levels.append((k, tied, rank[tied]))
    # rank is a permutation now
    sa = np.empty(n, kind)
    sa[rank] = np.arange(n, dtype=kind)
    same = owner[sa[:-1]] == owner[sa[1:]]
    del owner
    lcp = _by_levels(sa, same, end, levels) if levels is not None else _one_by_one(sa, rank, same, end, code.astype(kind))
    best = np.zeros(n, kind)
    best[:-1] = lcp
    best[1:] = np.maximum(best[1:], lcp)
    out[sa] = best
    return out


#: Words, in multiples of a slice's, whose groups are kept for the longest common prefixes; texts that repeat more are read word by word.
LEVEL_WORDS = 4


def _split(tied: np.ndarray, rank: np.ndarray, key: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sort suffixes by key and give them their new ranks; those that are still tied. `begins`: where the group of each begins."""
    by = np.argsort(key, kind="stable")
    tied, key, begins = tied[by], key[by], begins[by]
    del by
    here = np.arange(len(tied), dtype=rank.dtype)
    fresh = np.ones(len(tied), bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.ones(len(tied), bool)
    group[1:] = begins[1:] != begins[:-1]
    place = begins + here - np.maximum.accumulate(np.where(group, here, 0))
    rank[tied] = place[np.maximum.accumulate(np.where(fresh, here, 0))]
    sizes = np.diff(np.append(np.flatnonzero(fresh), len(tied)))
    return tied[np.repeat(sizes > 1, sizes)]


def _by_levels(sa: np.ndarray, same: np.ndarray, end: np.ndarray, levels: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Longest common prefixes of neighbours: the sum of the levels at which both still agree."""
    at_ = np.flatnonzero(same)
    a, b = sa[at_].copy(), sa[at_ + 1].copy()
    lcp, group = np.zeros(len(sa) - 1, sa.dtype), np.full(len(sa), -1, sa.dtype)
    end_a, end_b = end[a], end[b]
    for k, tied, rank in reversed(levels):
        group[tied] = rank
        at = np.flatnonzero((a + k <= end_a) & (b + k <= end_b))
        at = at[(group[a[at]] >= 0) & (group[a[at]] == group[b[at]])]
        lcp[at_[at]] += k
        a[at] += k
        b[at] += k
        group[tied] = -1
    return lcp


def _one_by_one(sa: np.ndarray, rank: np.ndarray, same: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The same in the order of the text: the prefix shared with the next suffix of the array shrinks by one word a step at most."""
    lcp = np.zeros(len(sa) - 1, sa.dtype)
    s, r, ok, e, c, out, have = memoryview(sa), memoryview(rank), memoryview(same), memoryview(end), memoryview(code), memoryview(lcp), 0
    for i in range(len(sa)):
        at = r[i]
        if at + 1 == len(sa) or not ok[at]:
            have = 0
            continue
        j = s[at + 1]
        most = min(e[i] - i, e[j] - j)
        while have < most and c[i + have] == c[j + have]:
            have += 1
        out[at] = have
        have = max(have - 1, 0)
    return lcp


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set from each index of `at` to the next."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[at])


def _union(starts: np.ndarray, lens: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lens, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def facts(texts: pa.Array, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> dict[str, np.ndarray]:
    """The columns of FACTS for some texts."""
    buf, offs = text_bytes(texts)
    starts, ends, first = word_spans(buf, offs)
    n_words = np.diff(first)
    longest = longest_repeats(word_hashes(buf, starts, ends), first)
    three, far = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= min_repeat)
    n_repeat = _per_text(_union(three, np.full(len(three), 3), len(longest)), first)
    covered = _per_text(_union(far, longest[far], len(longest)), first)
    most = np.zeros(len(n_words), np.int64)
    some = np.flatnonzero(n_words)
    if len(some):
        most[some] = np.maximum.reduceat(longest, first[:-1][some])
    lut = np.ones(256, bool)
    lut[10] = False
    line, stop, line_first = word_spans(buf, offs, lut)
    with_word = np.searchsorted(starts, line) < np.searchsorted(starts, stop)
    owner = np.repeat(np.arange(len(n_words)), np.diff(line_first))[with_word]
    h = word_hashes(buf, line[with_word], stop[with_word])
    by = np.lexsort((h, owner))
    again = (h[by][1:] == h[by][:-1]) & (owner[by][1:] == owner[by][:-1])
    dup = np.bincount(owner[by][1:][again], minlength=len(n_words))
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words, "word_chars": _per_text(SPACED[buf] & ((buf & 0xC0) != 0x80), offs), "n_symbols": _per_text(SYMBOLS[buf], offs), "n_dup_lines": dup, "n_repeat_words": n_repeat,
        "n_covered": covered, "longest_repeat": most, "base_failed": failed, "kept": ~failed & (covered <= max_covered * n_words) & (most <= max_longest),
    }


def with_facts(df: DataFrame, text: str = "text", prefix: str = "", **limits) -> DataFrame:
    """df with the columns of FACTS, their names after `prefix`, in place of any that df has; one pass over the rows, no shuffle."""
    own = {(prefix + x.split()[0]).lower() for x in FACTS.split(", ")}
    df = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in own or c == text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            got = facts(b.column(b.schema.get_field_index(text)), **limits)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v) for v in got.values())], names=[*b.schema.names, *(prefix + k for k in got)])

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + ", ".join(f"`{prefix}{x.split()[0]}` {x.split()[1]}" for x in FACTS.split(", "))
    return map_arrow(df, run, kinds)


def quality_filter(df: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows that the rules keep, with the columns of df."""
    prefix = "quality_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return with_facts(df, text, prefix, **limits).filter(F.col(f"{prefix}kept")).select([F.col(f"`{c}`") for c in df.columns])
