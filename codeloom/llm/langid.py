"""Language identification by hierarchical discrimination.

A linear classifier predicts the language family; within a family one-versus-one linear support vector machines separate its
languages, and the language that wins the most duels (ties: the larger sum of margins, then the lesser name) is predicted.
Features are hashed byte trigrams of the lower-cased text, as square roots of their shares, over whole texts. Weights are
learned by dual coordinate descent on at most SAMPLE_ROWS labelled rows, shared out evenly among the languages (one row at least;
with more languages than rows, the most frequent ones); the rows are those with the least hashes of id and text, their features
are made on the executors, and only those come to the driver.

Defined results: `und` with score 0 for a null text, a text without any letter, and where nothing could be learned. A null id
is not held out. Rows that repeat are predicted alike. A very long text is read whole, as a slice of its own. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, map_arrow, slices, text_bytes

#: Rows that are learned from at most, and trigram buckets.
SAMPLE_ROWS, BUCKETS = 3000, 4096

# fixed values: language families by ISO 639-1 code; a language not listed is a family of its own
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg mi ms su tl",
    "sino-tibetan": "bo my zh",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each bucket of trigrams that have a letter in the middle, a row a text."""
    n = len(offs) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if len(buf) < 3:
        return out
    low = LOWER[buf]
    low = np.where(_LETTER[low], low, np.uint8(32))
    at = np.flatnonzero(_LETTER[low[1:-1]])
    owner = np.searchsorted(offs, at, "right") - 1
    ok = at + 2 < offs[owner + 1]
    at, owner = at[ok], owner[ok]
    code = (low[at].astype(np.uint32) << 16) | (low[at + 1].astype(np.uint32) << 8) | low[at + 2]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    counts = np.bincount(owner * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return np.sqrt(counts / total, dtype=np.float32, casting="unsafe")


def support_vector(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights, the last one of a constant, for y of -1 and 1: squared hinge loss by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1) + 0.5 / cost
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + a[i] * 0.5 / cost
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """Families with their weights, and for each pair of languages of a family the weights of their duel."""

    families: list[list[str]]
    family_w: np.ndarray
    duels: dict[int, list[tuple[int, int]]]
    duel_w: dict[int, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        lang, margin = np.empty(len(x), object), np.full(len(x), np.inf)
        if len(self.families) > 1:
            s = x @ self.family_w.T
            family = s.argmax(1)
            top = np.partition(s, -2, axis=1)
            margin = np.minimum(margin, (top[:, -1] - top[:, -2]) / 2)
        else:
            family = np.zeros(len(x), int)
        for f, names in enumerate(self.families):
            at = np.flatnonzero(family == f)
            if not len(at):
                continue
            if len(names) == 1:
                lang[at] = names[0]
                continue
            d = x[at] @ self.duel_w[f].T
            wins, sums = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
            for k, (i, j) in enumerate(self.duels[f]):
                wins[:, i] += d[:, k] >= 0
                wins[:, j] += d[:, k] < 0
                sums[:, i] += d[:, k]
                sums[:, j] -= d[:, k]
            best = (wins * (2 * np.abs(sums).max(1, keepdims=True) + 1) + sums).argmax(1)
            own = np.array([[abs(d[r, k]) for k, p in enumerate(self.duels[f]) if b in p] for r, b in enumerate(best)]).min(1)
            margin[at] = np.minimum(margin[at], own)
            lang[at] = np.array(names, object)[best]
        return lang.tolist(), np.where(np.isinf(margin), 1.0, 1 / (1 + np.exp(-3 * np.minimum(margin, 50))))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "t"):
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            x = features(*text_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the languages of rows that are not held out, from a sample of `rows` of them; None without any."""
    known = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out("i"))
    counts = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(rows).collect()
    if not counts:
        return None
    each = max(rows // len(counts), 1)
    place = F.pmod(F.xxhash64("i", "t", F.lit("sample")), F.lit(1 << 30))
    # about twice as many as are wanted, then exactly those with the least hashes
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1 << 30, int((1 << 30) * 2 * (each + 20) / r["count"]) + 1))) for r in counts])
    some = known.select("lang", "t", "i", place.alias("place")).filter(F.col("place") < share)
    order = Window.partitionBy("lang").orderBy("place", "i", "t")
    some = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each)
    got = map_arrow(some.select("lang", "t"), _feature_rows, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, BUCKETS)
    y = np.array(got["lang"].to_pylist(), object)
    by = np.lexsort((x @ np.random.Generator(np.random.PCG64(3)).random(BUCKETS), y.astype(str)))  # the order of rows must not matter
    x, y = x[by], y[by]
    names = sorted(set(y.tolist()))
    if not names:
        return None
    families: dict[str, list[str]] = {}
    for n in names:
        families.setdefault(family_of(n), []).append(n)
    groups = [families[k] for k in sorted(families)]
    where = np.array([next(i for i, g in enumerate(groups) if n in g) for n in y])
    family_w = np.array([support_vector(x, np.where(where == f, 1.0, -1.0)) for f in range(len(groups))]) if len(groups) > 1 else np.zeros((1, BUCKETS + 1))
    duels = {f: list(combinations(range(len(g)), 2)) for f, g in enumerate(groups)}
    duel_w = {f: np.array([support_vector(x[m], np.where(y[m] == g[i], 1.0, -1.0)) for i, j in duels[f] for m in [(y == g[i]) | (y == g[j])]]) for f, g in enumerate(groups) if len(g) > 1}
    return Model(groups, family_w, duels, duel_w)


def _has_letter(texts: pa.Array, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    plain = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((LOWER[buf] >= 97) & (LOWER[buf] <= 122), out=plain[1:])
    got = np.diff(plain[offs]) > 0
    for i in np.flatnonzero(~got):
        got[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return got


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred and score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                t = pc.fill_null(part.column(2), "")
                buf, offs = text_bytes(t)
                ok = _has_letter(t, buf, offs)
                lang, score = model.predict(features(buf, offs)) if model else (["und"] * part.num_rows, np.zeros(part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x if k else "und" for x, k in zip(lang, ok)], pa.string()), pa.array(np.where(ok, score, 0.0))], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("i"), held_out(id_col).alias("h"), F.col(f"`{text}`").alias("t"))
    return map_arrow(rows, run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")
