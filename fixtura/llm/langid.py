"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes, each of which takes WIDEST - 1 bytes of the next along; bytes are looked up in a
learned embedding, convolved with filters of several widths, max-pooled over the window, and a softmax layer gives the
language. A text's probabilities are the mean over its windows, weighted by their letters; all its windows count. The
network is trained in numpy (Adam on the cross-entropy) on the driver; tasks apply it to many windows at once.

The fit takes at most SAMPLE documents, those of the smallest hash of the key, and of each at most two pieces of at most PIECE
code points, one at the start and one at a place that the key's hash names; so a few MB reach the driver, whatever the size
of the table. Prediction reads every text whole and keeps partitions as they are.

Filters are applied by tables: what a filter of width w says at a byte is the sum of w entries, one for each of its bytes, and
entries of two neighbouring bytes are added up beforehand, so a width of 4 takes two look-ups. Letter cases and digits are
folded, other ASCII is three kinds of separators, and the bytes beyond are taken as they are.

Odd rows. A text that is null or has no letter (Unicode category L) is `und`, with score 0. Rows without a language teach nothing;
if no row teaches, all predictions are `und` with score 0; with one language all are that one, with score 1. Ties of the
probability go to the language that sorts first. Repeated rows are predicted as often as they stand there. A column of ``docs``
that has the name of an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.llm.common import append_columns

SAMPLE, PIECE, WINDOW, WIDTHS, FILTERS, EMBED, STEPS, BATCH, RATE = 6_000, 400, 128, (2, 3, 4), 16, 8, 350, 96, 0.015
WIDEST, UND = max(WIDTHS), "und"

_SYMBOL = np.full(256, 1)  #: 0: padding, 1: white space and punctuation, 2: other ASCII, 3: digits, then letters, then bytes beyond ASCII
_SYMBOL[[ord(c) for c in "#$%&*@|<>=/\\^~_+[]{}`"]] = 2
_SYMBOL[48:58] = 3
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(4, 30)
_SYMBOL[128:] = np.arange(30, 158)
_SYMBOL = _SYMBOL.astype(np.int32)
SYMBOLS = 158


@dataclass
class Model:
    """embed: symbols x EMBED; filters: for each width, (width x EMBED) x FILTERS; bias; out: (widths x FILTERS) x languages, and its bias."""

    langs: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def tables(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """For each width, look-ups (offset, 1 or 2 bytes, table) whose sum is the filters' answer."""
        embed, n, out = self.weights[0], len(WIDTHS), []
        for i, w in enumerate(WIDTHS):
            kernel = self.weights[1 + i].reshape(w, EMBED, FILTERS)
            own = [embed @ kernel[j] for j in range(w)]
            own[0] = own[0] + self.weights[1 + n + i]
            pairs = [(j, 2, (own[j][:, None, :] + own[j + 1][None, :, :]).reshape(-1, FILTERS).astype(np.float32)) for j in range(0, w - 1, 2)]
            out.append(pairs + ([(w - 1, 1, own[-1].astype(np.float32))] if w % 2 else []))
        return out


def symbols(texts: list[bytes], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts as symbols (windows x WINDOW + WIDEST - 1), and the text of each. ``most``: windows of a text."""
    counts = [max(1, -(-len(t) // WINDOW)) if most is None else 1 for t in texts]
    flat = np.zeros(sum(counts) * WINDOW + WIDEST - 1, np.int32)
    at = 0
    rows = np.repeat(np.arange(len(texts)), counts)
    for t, n in zip(texts, counts, strict=True):
        raw = np.frombuffer(t[: n * WINDOW], np.uint8)
        flat[at : at + len(raw)] = _SYMBOL[raw]
        at += n * WINDOW
    wide = np.lib.stride_tricks.sliding_window_view(flat, WINDOW + WIDEST - 1)[::WINDOW].copy()
    last = np.flatnonzero(np.diff(rows, append=-1))
    wide[last, WINDOW:] = 0  # the next window is another text's
    return wide, rows


def probabilities(model: Model, wide: np.ndarray, tables: list, rows: int = 48) -> np.ndarray:
    """Softmax for each window; ``rows`` windows at a time, so that what is looked up stays in the processor's cache."""
    n, parts = len(WIDTHS), []
    pair = wide[:, :-1] * SYMBOLS + wide[:, 1:]
    for i in range(0, len(wide), rows):
        pooled = []
        for lookups in tables:
            total = None
            for at, kind, table in lookups:
                got = np.take(table, (pair if kind == 2 else wide)[i : i + rows, at : at + WINDOW], 0)
                total = got if total is None else np.add(total, got, out=total)
            pooled.append(total.max(1))
        parts.append(np.concatenate(pooled, 1))
    h = np.maximum(np.concatenate(parts), 0) if parts else np.zeros((0, n * FILTERS))
    z = h @ model.weights[1 + 2 * n] + model.weights[2 + 2 * n]
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """The network trained on texts cut at places and to lengths drawn anew each step, so that short texts are learned as well."""
    langs = sorted(set(labels))
    if len(langs) < 2:
        return Model(langs)
    draw = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    groups = [np.flatnonzero(y == k) for k in range(len(langs))]  # each language as often as any other
    n, k = len(WIDTHS), len(langs)
    w = [draw.normal(0, 0.3, (SYMBOLS, EMBED))] + [draw.normal(0, 1 / np.sqrt(x * EMBED), (x * EMBED, FILTERS)) for x in WIDTHS]
    w += [np.zeros(FILTERS) for _ in WIDTHS] + [draw.normal(0, 0.1, (n * FILTERS, k)), np.zeros(k)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        chosen = np.array([draw.choice(groups[j % k]) for j in range(BATCH)])
        cuts = []
        for i in chosen:
            t = texts[i]
            size = int(draw.choice((12, 24, 48, WINDOW)))
            at = int(draw.integers(0, max(1, len(t) - size + 1)))
            cuts.append(t[at : at + size])
        wide, _ = symbols(cuts, 1)
        x = w[0][wide]
        pooled, where = [], []
        for i, width in enumerate(WIDTHS):
            seen = np.lib.stride_tricks.sliding_window_view(x, width, 1)[:, :WINDOW].transpose(0, 1, 3, 2).reshape(BATCH, WINDOW, -1)
            answer = seen @ w[1 + i] + w[1 + n + i]
            top = answer.argmax(1)
            where.append(top)
            pooled.append(np.take_along_axis(answer, top[:, None, :], 1)[:, 0])
        h = np.maximum(np.concatenate(pooled, 1), 0)
        z = h @ w[1 + 2 * n] + w[2 + 2 * n]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(BATCH), y[chosen]] -= 1
        p /= BATCH
        g = [np.zeros_like(a) for a in w]
        g[1 + 2 * n], g[2 + 2 * n] = h.T @ p, p.sum(0)
        back = (p @ w[1 + 2 * n].T) * (h > 0)
        for i, width in enumerate(WIDTHS):
            own, top = back[:, i * FILTERS : (i + 1) * FILTERS], where[i]
            for j in range(width):  # only the place of the maximum learns
                taken = np.take_along_axis(wide, top + j, 1)
                e = w[0][taken]
                rows = slice(j * EMBED, (j + 1) * EMBED)
                g[1 + i][rows] = np.einsum("bf,bfe->ef", own, e)
                np.add.at(g[0], taken, own[:, :, None] * w[1 + i][rows].T[None])
            g[1 + n + i] = own.sum(0)
        g[0][0] = 0
        rate = RATE * (1 - 0.9 * step / steps)
        for i, a in enumerate(w):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
            a -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(langs, w)


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents with a language and a letter in the text.

    Only keys whose hash is below a share of some 4 * ``sample`` rows are sorted, so what reaches the driver doesn't grow with the table.
    """
    h = F.xxhash64(F.col(key))
    rows = docs.where(F.col(lang).isNotNull()).count()
    some = docs.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, 4 * sample / max(1, rows))))
    far = F.pmod(h, F.greatest(F.length(text) - PIECE + 1, F.lit(1))).cast("int") + 1
    own = some.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.substring(text, 1, PIECE).alias("a"), F.substring(F.col(text), far, F.lit(PIECE)).alias("b"), F.col(lang).cast("string").alias("lang"), h.alias("h"))
    got = own.orderBy("h", "lang", "a", "b").limit(sample).collect()  # bounded: sample rows of 2 * PIECE code points
    pairs = [(x.encode("utf-8", "surrogatepass"), r["lang"]) for r in got for x in ((r["a"], r["b"]) if r["a"] != r["b"] else (r["a"],))]
    return fit([t for t, _ in pairs], [y for _, y in pairs])


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score", group: int = 1 << 17) -> DataFrame:
    """``docs`` with the predicted language and its probability; ``group``: bytes of text that one numpy pass works on."""

    def make():
        tables = model.tables() if model.weights else None

        def run(texts: list) -> list[pa.Array]:
            total, weight = np.zeros((len(texts), max(1, len(model.langs)))), np.zeros(len(texts))
            if tables is None:
                total[:] = weight[:] = 1

            def passed(parts: list[bytes], owner: list[int]) -> None:
                wide, row = symbols(parts)
                row = np.array(owner)[row]
                p = probabilities(model, wide, tables)
                letters = (wide[:, :WINDOW] >= 4).sum(1)
                np.add.at(total, row, p * letters[:, None])
                np.add.at(weight, row, letters)

            parts, owner, size = [], [], 0
            for i, t in enumerate(texts if tables is not None else []):
                raw = (t or "").encode("utf-8", "surrogatepass")
                for at in range(0, len(raw), group - group % WINDOW):
                    parts.append(raw[at : at + group - group % WINDOW])
                    owner.append(i)
                    size += len(parts[-1])
                    if size >= group:
                        passed(parts, owner)
                        parts, owner, size = [], [], 0
            if parts:
                passed(parts, owner)
            p = total / np.maximum(weight, 1e-9)[:, None]
            best = p.argmax(1)
            known = [bool(model.langs) and w > 0 for w in weight]
            return [pa.array([model.langs[b] if k else UND for b, k in zip(best, known, strict=True)], pa.string()), pa.array([min(1.0, float(p[i, b])) if known[i] else 0.0 for i, b in enumerate(best)], pa.float64())]

        return run

    told = append_columns(docs, text, [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())], make)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return told.withColumns({out: F.when(lettered, F.col(out)).otherwise(UND), score: F.when(lettered, F.col(score)).otherwise(0.0)})
