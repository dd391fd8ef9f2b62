"""Benchmark decontamination: size-partitioned MinHash containment search.

Words are lower-cased runs without ASCII white space, shingles are WORDS of them (a shorter item is one shingle). Items
are dealt into classes by their number of distinct shingles, from 2**c to 2**(c + 1) - 1. For each class a document is
seen as windows of three blocks of 2**c shingles, one from each block on, so that a passage of an item's size lies within
one and short items stay comparable with parts of long documents. A window's MinHash signature holds the least value of
each of PERMUTATIONS hash functions; blocks of the smallest class serve all, as larger blocks' values are the least of
smaller ones'. Many documents' blocks are hashed at once. An item is a candidate for a document if one of its values equals the window's at the same
place. Candidates are verified over the whole document: at least THRESHOLD of the item's distinct shingles, as words,
are among the document's.

Items are broadcast in parts of about PART_BYTES of text: more items mean more passes, never a larger broadcast or index.
Documents are not shuffled while one part holds all items. An item whose shingles lie scattered over a long text shares less with each window, but has
more windows to agree in. Item ids keep their type. Null texts and items without words match nothing; repeated items match alike.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fixtura.llm.common import Words, append_columns, fresh, groups, materialise

WORDS, THRESHOLD, PERMUTATIONS, PART_BYTES = 5, 0.8, 64, 8 << 20
TABLE = 1 << 16


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def shingles(words: list[bytes], k: int = WORDS) -> set[tuple[bytes, ...]]:
    """Distinct shingles, as words."""
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) > k else {tuple(words)} if words else set()


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_607)
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


class Index:
    """Signatures of one part of the items."""

    def __init__(self, items: list[tuple[int, str]], k: int = WORDS, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS):
        self.k, self.threshold = k, threshold
        self.a, self.b = _functions(permutations)
        self.items = {}
        by_class: dict[int, list[int]] = defaultdict(list)
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))  #: items of fewer than k words, by their number
        for n, (item, text) in enumerate(items):
            words = normal(text).split()
            own = shingles(words, k)
            if not own:
                continue
            self.items[n] = (item, own)
            if len(words) < k:
                self.short[len(words)][tuple(words)].append(n)
            else:
                by_class[len(own).bit_length() - 1].append(n)
        self.classes = {}
        for c, members in sorted(by_class.items()):
            known: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(permutations)]
            table = np.zeros((permutations, TABLE), bool)
            for n in members:
                seen = Words([b" ".join(x) for x in self.items[n][1]])  # each shingle as a text of its own
                h = (seen.rolled(k)[seen.bounds[:-1]] >> np.uint64(32)).astype(np.uint32)
                values = (h[None, :] * self.a[:, None] + self.b[:, None]).min(axis=1)
                for i, v in enumerate(values.tolist()):
                    known[i][v].append(n)
                    table[i, v & (TABLE - 1)] = True
            self.classes[c] = known, table

    def candidates(self, h: np.ndarray, first: np.ndarray, count: np.ndarray) -> dict[int, set[int]]:
        """Items that share a signature value with a window, by document: their shingle hashes are count[i] from first[i] on in h."""
        found: dict[int, set[int]] = defaultdict(set)
        own = np.flatnonzero(count > 0)
        if not len(own) or not self.classes:
            return found
        level = min(self.classes)
        n = -(-count[own] >> level)  #: blocks of each document
        doc = np.repeat(np.arange(len(own)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start, last = first[own][doc] + (place << level), (first[own] + count[own] - 1)[doc]
        blocks = np.empty((len(self.a), len(doc)), np.uint32)
        for s in range(0, len(doc), step := max(1, (1 << 16) >> level)):
            some = h[np.minimum(start[s : s + step] + np.arange(1 << level)[:, None], last[s : s + step])]
            for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                blocks[i, s : s + step] = (some * a + b).min(axis=0)
        for c in range(level, max(self.classes) + 1):
            if c > level:  # blocks of twice the size: each document's in pairs, an odd last one alone
                half = -(-n >> 1)
                left = np.repeat(np.cumsum(n) - n, half) + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
                right = np.minimum(left + 1, np.repeat(np.cumsum(n) - 1, half))
                blocks = np.minimum(blocks[:, left], blocks[:, right])
                n = half
                doc = np.repeat(np.arange(len(own)), n)
            if c not in self.classes:
                continue
            known, table = self.classes[c]
            window = blocks
            if len(doc) > 1:
                next_ = np.minimum(np.arange(len(doc)) + 1, np.repeat(np.cumsum(n) - 1, n))  # the block after, or the last one itself
                for _ in range(2):
                    window = np.minimum(window, window[:, next_])
            hit = np.take_along_axis(table, (window & np.uint32(TABLE - 1)).astype(np.intp), axis=1)
            for i, w in zip(*np.nonzero(hit), strict=True):
                if members := known[i].get(int(window[i, w])):
                    found[int(own[doc[w]])].update(members)
        return found

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """For each text the items found in it, with their containment."""
        raw, out = [normal(t) for t in texts], []
        for _, some in groups(raw):
            words = Words(some)
            h = (words.rolled(self.k) >> np.uint64(32)).astype(np.uint32)
            count = np.diff(words.bounds) - self.k + 1
            found = self.candidates(h, words.bounds[:-1], count)
            out += [self.verified(text, found.get(i, set())) for i, text in enumerate(some)]
        return out

    def verified(self, text: bytes, found: set[int]) -> list[tuple[int, float]]:
        out = []
        if not found and not self.short:
            return out
        words = text.split()
        if found:
            own = shingles(words, self.k)
            for n in found:
                item, want = self.items[n]
                if (share := len(want & own) / len(want)) >= self.threshold:
                    out.append((item, share))
        for size, known in self.short.items():
            for seen in known.keys() & set(zip(*(words[i:] for i in range(size)), strict=False)):
                out += [(self.items[n][0], 1.0) for n in known[seen]]
        return sorted(out, key=lambda x: (x[0] is not None, x[0]) if x[0] is not None else (False,))


def _parts(items: DataFrame, item: str, text: str, most: int) -> list[DataFrame]:
    """The items in parts of about ``most`` bytes of text each, dealt by row, so that repeats of an item are dealt as well."""
    own = materialise(items.select(F.col(item).alias("item"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "items")
    size = own.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    n = -(-2 * size // most) if size > most else 1
    return [own.where(F.pmod(F.xxhash64("row"), F.lit(n)) == i) for i in range(n)] if size else []


def find(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "leaks", k: int = WORDS, threshold: float = THRESHOLD, most: int = PART_BYTES) -> DataFrame:
    """``docs`` with ``out``, an array of structs (item, containment) of the items found in each text.

    One part of items is one pass. With more, ``docs`` is written once with a row number, and the parts are passes over the texts one after another: the
    driver and the tasks hold one part at a time, what it finds is written, and what all have found is joined back by row.
    """
    kind = T.ArrayType(T.StructType([T.StructField("item", items.schema[item].dataType), T.StructField("containment", T.DoubleType())]))
    arrow = to_arrow_type(kind)
    parts = _parts(items, item, item_text, most)
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out.lower()])

    def sent(part: DataFrame) -> Broadcast:
        return docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()])  # at most about `most` bytes

    def search(rows: DataFrame, held: Broadcast) -> DataFrame:

        def make():
            index = Index(held.value, k, threshold)
            return lambda texts: [pa.array([[{"item": i, "containment": s} for i, s in x] for x in index.matches(texts)], arrow)]

        return append_columns(rows, text, [T.StructField(out, kind)], make)

    if len(parts) < 2:
        return search(docs, sent(parts[0])) if parts else docs.withColumn(out, F.array().cast(kind))
    row = fresh([*docs.columns, out], "row")
    own = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    passes = []
    for part in parts:
        held = sent(part)
        passes.append(materialise(search(own.select(row, text), held).where(F.size(out) > 0).select(row, out), "found"))
        held.destroy()
    found = reduce(DataFrame.unionByName, passes)
    joined = own.join(found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(out))).alias(out)), row, "left")
    return joined.select(*docs.columns, F.coalesce(out, F.array().cast(kind)).alias(out))


def pairs(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item found in it: key, item_id, containment."""
    found = find(docs.select(key, text), items, text)
    return found.select(key, F.explode("leaks").alias("x")).select(key, F.col("x.item").alias("item_id"), F.col("x.containment").alias("containment"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item."""
    new = fresh(docs.columns, "leaks")
    return find(docs, items, text, out=new).where(F.size(new) == 0).drop(new)
