"""SimHash near-duplicates with pigeonring filtering.

Words are runs without ASCII white space, after A-Z became a-z; shingles are WORDS words joined by a space, repeats
included (a shorter text is one shingle, a text without words none: fingerprint zero, linked like any other). A bit of
the 64-bit fingerprint is set if more than half of the shingles' XXH64 values (seed 42) have it set. Two fingerprints
are linked at BITS differing bits or fewer; a component is what links reach.

Pigeonring: the bits form a ring of SEGMENTS segments. If two fingerprints differ in at most BITS bits, some segment
starts a chain in which every prefix of l segments differs in at most floor(l * BITS / SEGMENTS) bits. In the first CHAIN
segments these budgets force certain sets of segments to be equal; each such set is an equi-join key. Pairs that share a
key go through the budgets of all prefixes, the last of which is the full Hamming check.

Scale and skew: copies share a fingerprint and are one node from the start (partial aggregation). A key's fingerprints
are compared in one task if there are at most BLOCK of them, and as pairs of blocks otherwise; in a block each reached
fingerprint is compared only with those not yet reached, so dense groups cost little more than their size and give a
spanning forest instead of all pairs. Links meet as tables: nothing is collected to the driver.

Null texts count as empty. Rows repeat as they come; a null doc_id is never a component's name unless all its rows' are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.llm.common import append_columns, fresh, materialise

WORDS, BITS, SEGMENTS, CHAIN, BLOCK = 4, 4, 9, 6, 1 << 16
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, k: int = WORDS) -> int:
    """The fingerprint of one text, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= k:
        return xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-k].tolist()]
    hashes = np.fromiter([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", k: int = WORDS) -> DataFrame:
    """``docs`` with ``out``, each text's fingerprint as a signed long."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, k) for t in texts], np.uint64).astype(np.int64), pa.int64())]

    return append_columns(docs, text, [T.StructField(out, T.LongType())], make)


def ring(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """Bounds of the segments: 64 bits in ``segments`` parts as even as can be."""
    at = [64 * i // segments for i in range(segments + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def budgets(bits: int = BITS, segments: int = SEGMENTS) -> list[int]:
    return [length * bits // segments for length in range(1, segments + 1)]


def equal_sets(bits: int = BITS, segments: int = SEGMENTS, chain: int = CHAIN) -> list[tuple[int, ...]]:
    """Sets of places in a chain, at least one of which is equal whenever the chain keeps its budgets."""
    b = budgets(bits, segments)
    free = b[chain - 1]
    fits = [odd for odd in combinations(range(chain), free) if all(sum(p <= at for p in odd) <= b[at] for at in range(chain))]
    return [tuple(p for p in range(chain) if p not in odd) for odd in fits]


def keys(fp: Column, bits: int = BITS, segments: int = SEGMENTS, chain: int = CHAIN) -> Column:
    """Array of structs (start, key), one for each start and equal set."""
    parts = ring(segments)
    out = []
    for start in range(segments):
        for n, places in enumerate(equal_sets(bits, segments, chain)):
            key = F.lit(start * 64 + n).cast("long")
            for p in places:
                a, b = parts[(start + p) % segments]
                key = F.shiftleft(key, b - a).bitwiseOR(F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")))
            out.append(F.struct(F.lit(start).alias("start"), key.alias("key")))
    return F.array(*out)


class Ring:
    """The chains' budgets as masks."""

    def __init__(self, bits: int = BITS, segments: int = SEGMENTS):
        parts, self.most = ring(segments), budgets(bits, segments)
        masks = np.zeros((segments, segments), np.uint64)
        for start in range(segments):
            m = 0
            for length in range(segments):
                a, b = parts[(start + length) % segments]
                m |= ((1 << (b - a)) - 1) << a
                masks[start, length] = m
        self.masks = masks

    def linked(self, x: np.ndarray, start) -> np.ndarray:
        """Which differences ``x`` keep the budgets of every prefix of the chain from ``start`` (one for all, or one each)."""
        left, one = np.arange(len(x)), np.isscalar(start)
        for length, most in enumerate(self.most):
            m = self.masks[start, length] if one else self.masks[start[left], length]
            left = left[np.bitwise_count(x[left] & m) <= most]
            if not len(left):
                break
        out = np.zeros(len(x), bool)
        out[left] = True
        return out


def _forest(fps: np.ndarray, start: int, rule: Ring) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one key's fingerprints: each reached one meets only those not yet reached."""
    out, waiting = [], fps
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            x = front.pop()
            near = rule.linked(waiting ^ x, start)
            if near.any():
                new = waiting[near]
                out.append((np.full(len(new), x, np.uint64), new))
                front.extend(new)
                waiting = waiting[~near]
    return out


class Union:
    """Components of the links of one task, so that a task emits one link for each node at most."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, a: int, b: int) -> bool:
        """Whether the link joined two components."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))
        return a != b


def links(nodes: DataFrame, bits: int = BITS, segments: int = SEGMENTS, chain: int = CHAIN, block: int = BLOCK, direct: bool = False) -> DataFrame:
    """Links (a, b) between different fingerprints ``fp`` of ``nodes`` (distinct) that have the components of all links.

    direct: only pairs that are themselves within ``bits``, for callers that check each pair; else a task names each node's least one.
    """
    rows = nodes.select("fp", F.explode(keys(F.col("fp"), bits, segments, chain)).alias("k")).select("fp", F.col("k.start").alias("start"), F.col("k.key").alias("key"))
    rows = materialise(rows, "keys")  # counted, then met
    # Keys of more than `block` fingerprints: there are at most rows / block of them, and they are met block by block.
    large = materialise(rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / (block // 2)).cast("int").alias("n")), "large")
    n_large = large.count()
    if n_large:
        held = F.broadcast(large) if n_large <= 100_000 else large
        mine, n = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"), F.col("n")
        spread = rows.join(held, "key", "left").withColumn("mine", F.when(n.isNotNull(), mine).otherwise(F.lit(0)))
        spread = spread.withColumn("other", F.explode(F.when(n.isNotNull(), F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))))
    else:
        spread = rows.withColumns({"mine": F.lit(0), "other": F.lit(0)})
    pairs = spread.select("fp", "start", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    dealt = pairs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, found, kept = Ring(bits, segments), Union(), None
        own: list[tuple[int, int]] = []  # direct: those that joined two components

        def meet(fp: np.ndarray, start: np.ndarray, cut: np.ndarray) -> None:
            """cut: first rows of the runs of one key and block pair."""
            size = np.diff(np.concatenate([cut, [len(fp)]]))
            run_of = np.repeat(np.arange(len(cut)), size)
            small = size[run_of] <= 24
            for d in range(1, 24):
                same = np.flatnonzero(small[d:] & (run_of[d:] == run_of[:-d]))
                if not len(same):
                    break
                near = same[rule.linked(fp[same] ^ fp[same + d], start[same])]
                own.extend(x for x in zip(fp[near].tolist(), fp[near + d].tolist(), strict=True) if found.add(*x) and direct)
            for k in np.flatnonzero(size > 24):
                for a, b in _forest(np.unique(fp[cut[k] : cut[k] + size[k]]), int(start[cut[k]]), rule):
                    own.extend(x for x in zip(a.tolist(), b.tolist(), strict=True) if found.add(*x) and direct)

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            new = np.ones(len(now[0]), bool)
            new[1:] = (np.diff(now[2]) != 0) | (np.diff(now[3]) != 0) | (np.diff(now[4]) != 0)
            cut = np.flatnonzero(new)
            last = cut[-1]  # the last run may go on in the next batch
            kept = [x[last:] for x in now]
            if last:
                meet(now[0][:last].astype(np.uint64), now[1][:last], cut[:-1])
        if kept is not None:
            meet(kept[0].astype(np.uint64), kept[1], np.zeros(1, np.int64))
        both = own if direct else [(a, r) for a in found.up if (r := found.root(a)) != a]
        for i in range(0, len(both), 50_000):
            a, b = (np.array(x, np.uint64).astype(np.int64) for x in zip(*both[i : i + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b), the label being the component's smallest node.

    Large-star and small-star steps in turn: each node's neighbours move to its smallest one, until no link moves; links only ever
    move to smaller nodes, so that ends. Every step is a table in the shared folder: the least neighbours are written before they are joined
    back, so that a node with a large part of all links is split over tasks. Only counts reach the driver.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = materialise(large.distinct(), "large")
        own = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(own, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialise(small, "links")
        if new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("label"))
        now = new


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, segments: int = SEGMENTS, chain: int = CHAIN, block: int = BLOCK) -> DataFrame:
    """Per row: key, fp (signed long) and component_id (smallest key reachable)."""
    fps = materialise(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).drop("text"), "fingerprints")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a node becomes many keys, so the few bytes of nodes are spread first
    nodes = materialise(fps.groupBy("fp").agg(F.min("key").alias("least")).repartition(parts), "nodes")
    found = components(links(nodes, bits, segments, chain, block))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    moved = named.join(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "label").select("fp", "component_id")
    return fps.join(moved, "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", find=near_duplicates) -> DataFrame:
    """``docs`` with one row of each component: the one that names it; of rows that repeat its key, the first by content hash.

    ``find`` (docs, key, text) gives the components. Rows with a null key can't be told apart by it and all stay.
    """
    names = docs.columns
    hit, rank = fresh(names, "hit"), fresh(names, "rank")
    found = find(docs, key, text).where(F.col(key) == F.col("component_id")).select(key).distinct().withColumn(hit, F.lit(True))
    order = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    own = docs.join(found, key, "left").where(F.col(hit).isNotNull() | F.col(key).isNull()).withColumn(rank, F.row_number().over(order))
    return own.where((F.col(rank) == 1) | F.col(key).isNull()).select(*names)
