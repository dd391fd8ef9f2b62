"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, a shallow tree of one feature after another is fitted to the log-loss gradient and
added, damped, to that feature's lookup table over its bins; then four-leaf trees of the best pairs of features, likewise.
A score is the sum of table entries at the feature's bins, for a whole batch at once.

The fit takes at most SAMPLE labelled rows (those of the smallest hash of the key, so it is the same each time); features
of these, a few MB, reach the driver. Scoring covers every row and keeps partitions as they are. Null texts count as
empty; without rows of both labels the score is the constant (n1 + 1) / (n + 2).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.llm.common import append_columns

SAMPLE, BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, CUT = 20_000, 48, 150, 6, 60, 0.15, 0.7

FEATURES = ("words", "word_length", "distinct_words", "top_word", "distinct_lines", "line_length", "upper", "digit", "stop", "symbol", "other_mark", "white", "beyond_ascii", "entropy", "odd_ends")
_KIND = np.full(256, 6)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 0, 1, 2, 7
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 3
_KIND[[ord(c) for c in "#$%&*@|<>=/\\^~_+[]{}!"]] = 4
_KIND[[32, 9, 10, 11, 12, 13]] = 5


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=count, minlength=8)
    words = raw.split()
    tally, lines = Counter(words), [x for x in raw.split(b"\n") if x.strip()]
    w = max(1, len(words))
    share = count[count > 0] / n
    odd = sum(v for k, v in tally.items() if k[-1] in b"#$%&*@|<>=/\\^~_+[]{}!")
    letters = max(1.0, kind[0] + kind[1] + kind[7])
    return [np.log1p(len(words)), (n - kind[5]) / w, len(tally) / w, max(tally.values(), default=0) / w, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), kind[0] / letters, kind[2] / n, kind[3] / n, kind[4] / n, kind[6] / n, kind[5] / n, kind[7] / n, float(-(share * np.log(share)).sum()), odd / w]


@dataclass
class Model:
    """cuts: edges of each feature's bins; tables: entry of each bin; pairs: features, their edges and the entries of both bins."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], "right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    distinct = np.unique(x)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a tree over ordered bins with gradients g and curvatures h."""
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            return np.concatenate([_step(g[:at], h[:at], depth - 1), _step(g[at:], h[at:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1))


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best four-leaf tree over two ordered axes: gain and values."""
    best, out = 0.0, np.zeros_like(g)
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return best, out
    a, b = G[:-1, :-1], H[:-1, :-1]
    right, low, all_g = G[:-1, -1:] - a, G[-1:, :-1] - a, G[-1, -1]
    right_h, low_h, all_h = H[:-1, -1:] - b, H[-1:, :-1] - b, H[-1, -1]
    rest, rest_h = all_g - a - right - low, all_h - b - right_h - low_h
    gain = a**2 / (b + 1) + right**2 / (right_h + 1) + low**2 / (low_h + 1) + rest**2 / (rest_h + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    for rows, cols, s, t in ((slice(0, i + 1), slice(0, j + 1), a, b), (slice(0, i + 1), slice(j + 1, None), right, right_h), (slice(i + 1, None), slice(0, j + 1), low, low_h), (slice(i + 1, None), slice(j + 1, None), rest, rest_h)):
        out[rows, cols] = s[i, j] / (t[i, j] + 1)
    return float(gain[i, j] - all_g**2 / (all_h + 1)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> Model:
    """The model of features x (rows by FEATURES) and labels y (0 or 1)."""
    p = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return model
    model.cuts = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slope()
            step = rate * _step(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)))
            table += step
            total += step[at[j]]
    coarse = [_edges(x[:, j], 12) for j in range(x.shape[1])]
    near = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(near[i] * shape[1] + near[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slope()
    ranked = sorted(((_cross(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in ranked if gain > 0]
    for _ in range(pair_rounds):
        for i, j, _, _, table in model.pairs:
            g, h = slope()
            step = rate * _cross(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[near[i], near[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows of ``docs``; rows with a null key or label take no part."""
    told = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"))
    some = told.orderBy(F.xxhash64("key"), "key", "y").limit(sample)  # at most `sample` ids and labels: small enough to send to all
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(some), "key").select("key", "text", "y")

    def make():
        return lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

    got = append_columns(rows, "text", [T.StructField("x", T.ArrayType(T.DoubleType()))], make).select("key", "x", "y")
    got = got.orderBy(F.xxhash64("key"), "key", "y", "x").limit(sample).select("x", "y").toPandas()  # rows that repeat a key count towards the bound
    if not len(got):
        return Model()
    order = np.lexsort([got["y"].to_numpy(), *np.array(got["x"].tolist()).T])  # the order of rows never changes the model
    return fit(np.array(got["x"].tolist())[order], got["y"].to_numpy()[order])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1."""

    def make():
        def run(texts: list) -> list[pa.Array]:
            x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            return [pa.array(model.score(x), pa.float64())]

        return run

    return append_columns(docs, text, [T.StructField(out, T.DoubleType())], make)
