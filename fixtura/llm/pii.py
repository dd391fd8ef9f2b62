"""Personal data: exact base patterns, and a skip-chain conditional random field that adds spans.

Base spans are fixed patterns with checks (KINDS). The field runs over the tokens of a document that carry a digit or an at
sign. Its labels are `none`, the kinds and `secret` (a credential's value). Potentials: weights of shape features for each token,
a table for neighbouring tokens, and one weight each for two sorts of skip edges, however far apart the tokens are: equal core
(letters and digits, lower case), and similar core (one character more, less or other; the same digits with other separators or without
the first ones; the local part of an address alone). Values of 9 to 40 letters and digits are similar at one edit; shorter ones would meet by
chance, longer ones meet only if equal, by their digits or by an address's local part; cores of under 5 or without a digit have no skip edges. A token's
shape sees the last word of the 24 code points before it. Loopy sum-product messages give beliefs. Base spans' tokens are told their
kind; any other token is added if its belief in one label passes SURE, wherever it stands and whether the document
has base spans or not. Neighbouring added tokens of one phone or card are one span. Base spans never change.

Training maximises the joint pseudo-likelihood: each token's label given its features and the labels of its neighbours by
chain and skip edges, for all weights at once; each token counts once more without its edges, so that shapes are learned where edges
alone would explain the labels. Labels are base spans and, for secrets, values after a keyword (SEED). A text with a card, a phone
or an email is taken a second time with two more tokens far from it: a damaged copy of the value (one digit changed, separators or
domain left out), labelled as the value is, and a stranger of the same form, labelled `none`: shape alone can't tell
these two apart, so skip edges have to. Features leave the patterns' own tests out.

The fit takes at most SAMPLE texts with base spans or seeds (those of the smallest hash of the text, of any length), and of each the
surroundings of its spans, at most WINDOW code points; a scan keeps no more in a task, and a few thousand rows reach the driver.
Null texts count as empty. A document is worked on alone, so partitions stay as they are. Rows repeat as they come.
"""

from __future__ import annotations

import heapq
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.llm.common import append_columns, fresh, pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret")
SAMPLE, WINDOW, ROUNDS, SURE = 2_000, 2_000, 12, 0.9

# The patterns are the contract's; possessive repeats and looks behind only spare useless retries inside a run.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"[^\W\d_]|@")
_CORE = re.compile(r"[^\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign needs a local part on its left that no earlier match has taken."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _AT.match(text, at)):
            yield start, m.end()
            taken = m.end()
        at = text.find("@", max(at + 1, taken))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Words that name a credential, for the labels of the fit.
SEED = re.compile(r"(?i)\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?([A-Za-z0-9+/_-]{16,128})(?![A-Za-z0-9+/_-])")


def core(token: str) -> str:
    return "".join(_CORE.findall(token)).lower()


def seeds(text: str) -> list[tuple[str, int, int]]:
    """Values after a keyword that hold a digit: the fit's labels of `secret`."""
    return [("secret", *m.span(1)) for m in SEED.finditer(text) if _DIGIT.search(m[1])] if "=" in text or ":" in text else []


FEATURES = 17


def shape(token: str, before: str) -> list[float]:
    """Shape of a token, without the marks of a sentence around it, and of the one before; no pattern test."""
    token = token.strip(".,;:!?'\"") or token
    n, c, d, letters = len(token), core(token), len(_digits(token)), sum(x.isalpha() for x in token)
    mixed = len(c) >= 16 and letters > 0 and d > 0 and "@" not in token
    return [1.0, min(d, 20) / 10, d / n, letters / n, "@" in token, min(token.count("."), 4) / 2, "-" in token, token[0] == "+", "(" in token, min(n, 40) / 20, d >= 13, 9 <= d <= 12, 3 <= d <= 4, d == 1, mixed, before[-1:] in ("=", ":"), bool(_DIGIT.search(before))]


@dataclass
class Field:
    """Weights: shape features by label, neighbours' labels, and the bonus for equal labels of equal and of similar tokens."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities by loopy message passing; told labels are held."""
        n, k = len(g.x), len(LABELS) + 1
        local = g.x @ self.unary * g.share[:, None]
        local = np.where(g.told[:, None] < 0, local, np.where(np.arange(k) == g.told[:, None], 0, -30.0))
        edges = [(a, b, self.chain) for a, b in g.near] + [(a, b, self.skip[sort] * np.eye(k)) for a, b, sort in g.far]
        if not edges:
            return _softmax(local)
        src = np.array([e[0] for e in edges] + [e[1] for e in edges])
        dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
        table = np.array([e[2] for e in edges] + [e[2].T for e in edges])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(src), k))
        for _ in range(rounds):
            into = np.zeros((n, k))
            np.add.at(into, dst, message)
            out = (local + into)[src] - message[back]
            new = np.logaddexp.reduce(out[:, :, None] + table, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        into = np.zeros((n, k))
        np.add.at(into, dst, message)
        return _softmax(local + into)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Graph:
    """Tokens of the field: bounds, features, labels told by base spans (else -1), chain edges, skip edges with their sort (0 equal, 1 similar), and each token's
    share of its shape's potential: tokens of equal core have one between them, as a value that is repeated is no more likely to be personal."""

    bounds: list[tuple[int, int]]
    x: np.ndarray
    told: np.ndarray
    near: list[tuple[int, int]]
    far: list[tuple[int, int, int]]
    share: np.ndarray


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of the runs without white space that hold a digit or an at sign."""
    end = 0
    for m in _MARK.finditer(text):
        if m.start() >= end:
            start = m.start()
            while start > end and not text[start - 1].isspace():
                start -= 1
            stop = _SPACE.search(text, m.end())
            end = stop.start() if stop else len(text)
            yield start, end


def _before(text: str, start: int) -> str:
    """The end of the word before ``start``."""
    return (text[max(0, start - 24) : start].split() or [""])[-1]


def aliases(token: str) -> tuple[str | None, set[str]]:
    """The core of a token that may have skip edges, and what similar tokens have in common with it."""
    c, d = core(token), _digits(token)
    if len(c) < 5 or not d:
        return None, set()
    out = {c}
    if len(d) >= 9:
        out |= {d, "~" + d[-9:]}
    if 0 < (at := token.find("@")) and len(own := core(token[:at])) >= 5 and _DIGIT.search(own):
        out.add(own)
    for v in {c, d}:
        if 9 <= len(v) <= 40:
            out |= {v[:i] + v[i + 1 :] for i in range(len(v))}
    return c, out


def _runs(text: str, bounds: list[tuple[int, int]], near: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Runs of two or more neighbouring tokens without letters or at signs."""
    run: list[int] = []
    for a, b in near:
        if not run or run[-1] != a:
            if len(run) > 1:
                yield run
            run = [a] if not _WORD.search(text[slice(*bounds[a])]) else []
        if run and not _WORD.search(text[slice(*bounds[b])]):
            run.append(b)
        elif len(run) > 1:
            yield run
            run = []
        else:
            run = []
    if len(run) > 1:
        yield run


def graph(text: str, spans: list[tuple[str, int, int]]) -> Graph:
    """The field's graph of a text with these spans told."""
    bounds, x, told, equal, similar = [], [], [], defaultdict(list), defaultdict(list)
    spans, at = sorted(spans, key=lambda s: s[1]), 0
    for start, end in _tokens(text):
        i, token = len(bounds), text[start:end]
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        inside = at < len(spans) and spans[at][1] < end
        bounds.append((start, end))
        x.append(shape(token, _before(text, start)))
        told.append(1 + LABELS.index(spans[at][0]) if inside else -1)
        c, common = aliases(token)
        if inside and not (start <= spans[at][1] and spans[at][2] <= end) and spans[at][1] >= start:
            common = common | aliases(text[spans[at][1] : spans[at][2]])[1]  # a value of several tokens stands for itself at its first
        if c:
            equal[c].append(i)
        for v in common:
            similar[v].append(i)
    near = [(i, i + 1) for i in range(len(bounds) - 1) if text[bounds[i][1] : bounds[i + 1][0]].isspace()]
    for run in _runs(text, bounds, near):  # numbers in groups: a run of tokens without letters is alike as a whole
        if all(told[i] < 0 for i in run) and 9 <= len(d := _digits(text[bounds[run[0]][0] : bounds[run[-1]][1]])) <= 19:
            for v in aliases(d)[1]:
                similar[v] += run
    far: dict[tuple[int, int], int] = {}
    for sort, by in ((0, equal), (1, similar)):
        for members in map(sorted, map(set, by.values())):  # a star around the first told one: links reach all that are alike, without loops
            if len(members) > 1:
                centre = next((i for i in members if told[i] >= 0), members[0])
                for j in members:
                    if j != centre:
                        far.setdefault((min(centre, j), max(centre, j)), sort)
    chained, share = set(near), np.ones(len(bounds))
    for members in equal.values():
        share[members] = 1 / len(members)
    return Graph(bounds, np.array(x, float).reshape(len(x), FEATURES), np.array(told, int), near, sorted((a, b, sort) for (a, b), sort in far.items() if (a, b) not in chained), share)


def near_miss(text: str, spans: list[tuple[str, int, int]], seed: int) -> tuple[str, list[tuple[str, int, int]]] | None:
    """The text with a damaged copy of one of its values and a stranger of the copy's form after it, and the spans with the copy's."""
    rng = random.Random(seed)
    fit_for = [s for s in spans if s[0] in ("card", "phone") or s[0] == "email" and _DIGIT.search(text[s[1] : s[2]].split("@")[0]) and len(core(text[s[1] : s[2]].split("@")[0])) >= 5]
    if not fit_for:
        return None
    kind, a, b = fit_for[rng.randrange(len(fit_for))]
    value = text[a:b]
    if kind == "card":
        value = _digits(value)
        i = rng.randrange(len(value))
        value = value[:i] + str((int(value[i]) + rng.randint(1, 9)) % 10) + value[i + 1 :]
    else:
        value = _digits(value) if kind == "phone" else value.split("@")[0]
    stranger = "".join(rng.choice("0123456789") if x.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if x.isalpha() else x for x in value)
    words = " word and more words in between "
    longer = f"{text}{words}{value}{words}{stranger}{words}"
    if any(e > len(text) for _, _, e in base_spans(longer)):
        return None  # a pattern finds the damaged value, or the stranger, itself
    at = len(text) + len(words)
    return longer, [*spans, (kind, at, at + len(value))]


def unsure(text: str) -> list[tuple[int, int]]:
    """Matches of the phone pattern with too many digits: a phone next to another number, perhaps, so the fit takes their labels as unknown."""
    return [m.span() for m in _PHONE.finditer(text) if len(_digits(m[0])) > 15] if "+" in text else []


def fit(texts: list[str], steps: int = 400) -> Field:
    """Joint pseudo-likelihood of the labels of these texts; texts in any order give the same weights."""
    k = len(LABELS) + 1
    cases = []
    for n, text in enumerate(sorted(set(texts))):
        spans = base_spans(text)
        own = [s for s in seeds(text) if not any(a < s[2] and s[1] < b for _, a, b in spans)]
        cases.append((text, spans + own))
        if more := near_miss(text, spans + own, n):
            cases.append(more)
    xs, ys, open_, near, far, first = [], [], [], [], [], 0
    for text, spans in cases:
        g, out = graph(text, spans), unsure(text)
        open_ += [t < 0 and any(a < e and s < b for a, b in out) for (s, e), t in zip(g.bounds, g.told, strict=True)]
        xs.append(g.x)
        ys.append(np.maximum(g.told, 0))
        near += [(a + first, b + first) for a, b in g.near]
        far += [(a + first, b + first, sort) for a, b, sort in g.far]
        first += len(g.x)
    unary, chain, skip = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(2)
    if not first:
        return Field(unary, chain, skip)
    x, y = np.concatenate(xs), np.concatenate(ys)
    known = ~np.array(open_, bool)
    target, left, right = np.eye(k)[y], np.array(near, int).reshape(-1, 2).T, np.array(far, int).reshape(-1, 3).T
    left, right = left[:, known[left].all(axis=0)], right[:, known[right[:2]].all(axis=0)]
    votes = np.zeros((2, len(x), k))  # labels of each token's neighbours by skip edges of either sort
    for sort in (0, 1):
        a, b = right[:2, right[2] == sort]
        np.add.at(votes[sort], a, target[b])
        np.add.at(votes[sort], b, target[a])
    theta = [unary, chain, skip]
    mean, square = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        local = x @ unary + np.tensordot(skip, votes, 1)
        np.add.at(local, left[0], chain[:, y[left[1]]].T)
        np.add.at(local, left[1], chain[y[left[0]]])
        gap = (target - _softmax(local)) * known[:, None]
        slope = np.zeros((k, k))
        np.add.at(slope.T, y[left[1]], gap[left[0]])
        np.add.at(slope, y[left[0]], gap[left[1]])
        alone = (target - _softmax(x @ unary)) * known[:, None]
        slopes = [x.T @ (gap + alone) / len(x) - 1e-4 * unary, slope / len(x) - 1e-4 * chain, (votes * gap).sum(axis=(1, 2)) / len(x) - 1e-5 * skip]
        for t, g, m, v in zip(theta, slopes, mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            t += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(unary, chain, skip)


def surroundings(text: str, spans: list[tuple[str, int, int]], most: int = WINDOW) -> str:
    """A text of at most ``most`` code points, or as much of what stands around its spans, cut between words."""
    if len(text) <= most:
        return text
    out, size, end = [], 0, 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        start, stop = max(end, a - 80), min(len(text), b + 80)
        while start > end and start > a - 160 and not text[start - 1].isspace():
            start -= 1
        while stop < len(text) and stop < b + 160 and not text[stop].isspace():
            stop += 1
        if stop <= end:
            continue
        if size + stop - start > most:
            break
        out.append(text[start:stop])
        size, end = size + stop - start, stop
    return "\n".join(out)


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` texts that have base spans or seeds, in one scan."""

    def least(rows: Iterator[tuple[int, str]]) -> pa.RecordBatch:
        held: list[tuple[int, str]] = []  # a heap with the largest hash in front
        kept: set[int] = set()
        for h, t in rows:
            if h in kept or len(held) >= sample and -h <= held[0][0]:
                continue
            kept.add(h)
            gone = heapq.heappushpop(held, (-h, t)) if len(held) >= sample else heapq.heappush(held, (-h, t))
            if gone:
                kept.discard(-gone[0])
        return pa.RecordBatch.from_arrays([pa.array([-h for h, _ in held], pa.int64()), pa.array([t for _, t in held], pa.string())], names=["h", "text"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for batch in pieces(whole, 0):
                for t in batch.column(0).to_pylist():
                    if t and _MARK.search(t) and (spans := base_spans(t) + seeds(t)):
                        yield xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1, surroundings(t, spans)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield least((h, t) for batch in batches for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    found = docs.select(F.col(text).alias("text")).mapInArrow(lambda batches: iter([least(marked(batches))]), "h long, text string")
    rows = sorted((r["h"], r["text"]) for r in found.repartition(4, "h").mapInArrow(again, "h long, text string").collect())
    return fit([t for _, t in rows[:sample]])


def added_spans(text: str, spans: list[tuple[str, int, int]], model: Field) -> list[tuple[str, int, int]]:
    """What the field adds to the base spans of a document."""
    g = graph(text, spans)
    if not len(g.x) or (g.told >= 0).all():
        return []
    p, chained, out, last = model.beliefs(g), {b for _, b in g.near}, [], -2
    for i in np.flatnonzero((g.told < 0) & (p[:, 1:].max(axis=1) >= SURE)).tolist():
        kind = LABELS[int(p[i, 1:].argmax())]
        start, end = g.bounds[i]
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
            end -= 1
        if start == end:
            continue
        if last == i - 1 and i in chained and kind == out[-1][0] and kind in ("phone", "card") and len(_digits(text[out[-1][1] : end])) <= (15 if kind == "phone" else 19):
            out[-1] = (kind, out[-1][1], end)
        else:
            out.append((kind, start, end))
        last = i
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _ordered(text: str | None, model: Field) -> list[tuple[str, int, int, bool]]:
    if not text or not _MARK.search(text):
        return []
    base = base_spans(text)
    both = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, base, model)]
    return sorted(both, key=lambda s: (LABELS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, model: Field, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``, all spans by kind as listed, then start."""

    def make():
        names = ("kind", "start", "end", "base")
        return lambda texts: [pa.array([[dict(zip(names, s, strict=True)) for s in _ordered(t, model)] for t in texts], _ARROW)]

    return append_columns(docs, text, [T.StructField(out, SPAN)], make)


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one in brackets."""
    out, at, spans = [], 0, sorted(spans, key=lambda s: (s[1], -s[2]))
    end = 0
    for kind, a, b, _ in spans:
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Field, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text`` masked, and ``length`` the new text's code points; null texts stay null."""
    new = fresh(docs.columns, "masked")

    def make():
        return lambda texts: [pa.array([None if t is None else masked(t, s) if (s := _ordered(t, model)) else t for t in texts], pa.string())]

    done = append_columns(docs, text, [T.StructField(new, T.StringType())], make).withColumn(text, F.col(new))
    if length in docs.columns:
        done = done.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return done.select(*docs.columns)
