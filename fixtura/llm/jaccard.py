"""Near-duplicates by SimHash with pigeonring filtering, at an exact Jaccard similarity of word shingles.

Words are runs without ASCII white space, after A-Z became a-z; a text's set holds its distinct shingles of WORDS words as
64-bit hashes (a shorter text is one shingle; texts without words are alike). Two sets are linked if they have at least
SIMILARITY (tenths) of their union in common; a component is what links reach. Equal sets (128 bits of hashes and the size) are one
node, named by its least row.

First ``simhash`` links the nodes' fingerprints (shingles of WORDS words, repeats included) at BITS differing bits or fewer, by
pigeonring keys and budgets; each linked pair is verified on its whole sets, so no pair below the similarity is linked. Pairs at this
similarity differ in 7 of 64 bits at the median, and keys stay selective up to 6 (README has the figures), so fingerprints alone would
lose links.

Then the rest: pairs further apart in bits share one of BANDS hashes of ROWS MinHash values each; at similarity 0.8 a pair misses all of
them with a chance of 7 in a million, less above it. A bucket's nodes that are in other components than its least one meet that; then those
still in different components meet: as pairs in a bucket of up to SMALL nodes; in a larger one each reached node meets the nodes not yet
reached, in one task or, by blocks of about ELEMENTS shingles, in several, and a pair only in the first bucket that it shares. So no
bucket's pairs are ever rows, and nothing is collected to the driver.

Null texts count as empty; rows repeat as they come; keys keep their type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.llm.common import Words, append_columns, groups, materialise, mix
from fixtura.llm.simhash import UPPER, components, fingerprint
from fixtura.llm.simhash import links as reached

WORDS, SIMILARITY, BANDS, ROWS, SMALL, ELEMENTS = 5, 8, 30, 5, 8, 1 << 21
#: Of the fingerprints: differing bits, ring segments and chain. Four of 13 segments are a key of 19 bits or more.
BITS, SEGMENTS, CHAIN = 6, 13, 6


def shingle_sets(texts: list[str | None], k: int = WORDS) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, by groups of texts."""
    for _, some in groups([(t or "").encode("utf-8", "surrogatepass").translate(UPPER) for t in texts]):
        words = Words(some)
        rolled, out = words.rolled(k), []
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            if 0 < b - a < k:
                short = np.full(1, b - a, np.uint64)
                for h in words.hash[a:b]:
                    short = mix(short * np.uint64(0xD6E8FEB86659FD93) + h)
                out.append(short)
            else:
                out.append(np.unique(rolled[a : max(a, b - k + 1)]))
        yield out


def sets(docs: DataFrame, text: str = "text", k: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with h1 and h2 (hashes of the set), size, bands (hashes of MinHash values) and fp (the text's SimHash of ``k`` words)."""
    fields = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]

    def make():
        rng = np.random.default_rng(42)
        times, plus = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, bands * rows, np.uint64)

        def work(texts: list) -> list[pa.Array]:
            first, second, size, found = [], [], [], []
            for some in shingle_sets(texts, k):
                full = [s for s in some if len(s)]
                if full:
                    cat = np.concatenate(full)
                    start = np.cumsum([0, *map(len, full)])[:-1]
                    sums = [np.add.reduceat(mix(cat * times[i] + np.uint64(1)), start).astype(np.int64).tolist() for i in range(2)]
                    least = np.empty((bands, len(full)), np.uint64)
                    for i in range(bands):
                        key = np.full(len(full), i + 1, np.uint64)
                        for j in range(i * rows, (i + 1) * rows):
                            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(cat * times[j] + plus[j], start))
                        least[i] = key
                    each = iter(zip(*sums, least.T.astype(np.int64).tolist(), strict=True))
                for s in some:
                    a, b, keys = next(each) if len(s) else (0, 0, [])
                    first.append(a)
                    second.append(b)
                    found.append(keys)
                    size.append(len(s))
            fps = np.array([fingerprint(t, k) for t in texts], np.uint64).astype(np.int64)
            return [pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(size, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(fps, pa.int64())]

        return work

    return append_columns(docs, text, fields, make)


def shingled(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text): the set's bytes."""

    def make():
        return lambda texts: [pa.array([s.tobytes() for some in shingle_sets(texts, k) for s in some], pa.binary())]

    return append_columns(texts, "text", [T.StructField("shingles", T.BinaryType())], make).drop("text")


def verified(pairs: DataFrame, own: DataFrame, least: int = SIMILARITY) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets, in ``own`` (node, shingles), have ``least`` tenths of their union in common."""
    both = pairs.join(own.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(own.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(10 * same >= least * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def forest(band: int, node: np.ndarray, label: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], least: int = SIMILARITY) -> list[tuple[int, int]]:
    """Links that, with the labels, span the components of one bucket's nodes, as far as pairs have ``band`` as the first that they share."""
    size, ids = np.array([len(x) for x in sets]), np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mark, waiting, out = np.zeros(ids.max(initial=0) + 1, bool), np.ones(len(node), bool), []
    by_label: dict[int, list[int]] = {}
    for i, x in enumerate(label.tolist()):
        by_label.setdefault(x, []).append(i)
    for x in sorted(by_label, key=lambda x: len(by_label[x])):
        front = [i for i in by_label[x] if waiting[i]]
        waiting[by_label[x]] = False
        while front and waiting.any():
            i = front.pop()
            near = np.flatnonzero(waiting & (10 * np.minimum(size, size[i]) >= least * np.maximum(size, size[i])))
            near = near[(bands[near] == bands[i]).argmax(axis=1) == np.flatnonzero(bands[i] == band)[0]]
            if not len(near):
                continue
            mark[ids[start[i] : start[i] + size[i]]] = True
            if 4 * len(near) > len(node):
                same = np.add.reduceat(mark[ids], start, dtype=np.int64)[near]
            else:
                same = np.array([np.count_nonzero(mark[ids[start[j] : start[j] + size[j]]]) for j in near])
            mark[ids[start[i] : start[i] + size[i]]] = False
            for j in near[10 * same >= least * (size[i] + size[near] - same)].tolist():
                if waiting[j]:
                    out.append((int(node[i]), int(node[j])))
                    front += by_label[int(label[j])]
                    waiting[by_label[int(label[j])]] = False
    return out


def spanned(members: DataFrame, least: int = SIMILARITY) -> DataFrame:
    """Links (a, b) of the large buckets' ``members`` (band, node, label, total, bands, shingles); total: shingles of the bucket."""
    n, mine = F.ceil(F.col("total") / ELEMENTS).cast("int"), F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    spread = members.withColumn("n", n).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    own = spread.select("band", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "label", "bands", "shingles")
    dealt = own.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def meet() -> pa.RecordBatch:
            node, label = (np.array([r[i] for r in held], np.int64) for i in (3, 4))
            found = forest(held[0][0], node, label, np.array([r[5] for r in held], np.int64), [np.frombuffer(r[6], np.uint64) for r in held], least)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield meet()
                    held.clear()
                held.append(row)
        if held:
            yield meet()

    return dealt.mapInArrow(run, "a long, b long")


def alike(size: str, other: str, least: int = SIMILARITY) -> Column:
    """Whether two sets' sizes allow the similarity."""
    return 10 * F.least(size, other) >= least * F.greatest(size, other)


def candidates(nodes: DataFrame, least: int = SIMILARITY, bits: int = BITS, segments: int = SEGMENTS, chain: int = CHAIN) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, size, fp) by SimHash: those of one fingerprint with its least node, and the least nodes of fingerprints within ``bits``."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # spread, as a fingerprint becomes many keys
    first = materialise(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first")).repartition(parts), "fingerprints")
    same = nodes.join(first, "fp").select(F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.size").alias("size"), F.col("size").alias("other")).where("a <> b")
    found = materialise(reached(first.select("fp"), bits, segments, chain, direct=True).distinct(), "reached")
    ends = [first.select(F.col("fp").alias(x), F.col("first.node").alias(f"{x}_node"), F.col("first.size").alias(f"{x}_size")) for x in ("a", "b")]
    near = found.join(ends[0], "a").join(ends[1], "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"), F.col("a_size").alias("size"), F.col("b_size").alias("other"))
    return same.unionByName(near).where(alike("size", "other", least)).select("a", "b").distinct()


def links(nodes: DataFrame, texts: DataFrame, k: int = WORDS, least: int = SIMILARITY) -> DataFrame:
    """Verified links (a, b) of ``nodes`` (node, at, size, bands, fp) that have the components of all candidates. ``texts`` has their place ``at`` and text."""
    told = materialise(candidates(nodes, least), "told")
    each = nodes.select("node", "size", F.explode("bands").alias("band"))
    center = F.min(F.struct("node", "size")).alias("center")
    shared = each.groupBy("band").agg(center, F.max("node").alias("last")).where("center.node < last").select("band", "center")
    met = materialise(each.join(shared, "band"), "buckets")
    near = alike("size", "other", least)
    star = met.select(F.col("center.node").alias("a"), F.col("node").alias("b"), "size", F.col("center.size").alias("other")).where("a <> b").where(near)
    ends = told.select(F.explode(F.array("a", "b")).alias("node"))
    # a table of its own, so that Spark knows its size: texts are shuffled only where it is too large to broadcast
    wanted = materialise(nodes.join(met.select("node").unionByName(ends).distinct(), "node", "left_semi").select("node", "at"), "wanted")
    held = texts.join(wanted, "at").groupBy("node").agg(F.first("text").alias("text"))
    own = materialise(shingled(held, k), "sets")
    first = materialise(verified(told, own, least), "links")
    # what the fingerprints linked meets no more: the buckets' pairs are those of different components
    found = components(first)
    named = star.select("a", "b").distinct().join(found.select(F.col("node").alias("a"), F.col("label").alias("x")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left")
    star = materialise(named.where("coalesce(x, a) <> coalesce(y, b)").select("a", "b"), "pairs")
    first = materialise(first.unionByName(verified(star, own, least)), "links")
    found = components(first)
    named = met.select("band", "node", "size").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = named.groupBy("band").agg(F.min("label").alias("m"), F.max("label").alias("n"), F.count(F.lit(1)).alias("count"), F.sum("size").alias("total")).where("m < n")
    left = materialise(named.join(open_.select("band", "count", "total"), "band"), "open")
    few = left.where(F.col("count") <= SMALL)
    right = few.select("band", F.col("node").alias("b"), F.col("size").alias("other"), F.col("label").alias("into"))
    rest = few.withColumnRenamed("node", "a").join(right, "band").where("label <> into and a < b").where(near).select("a", "b").distinct()
    rest = materialise(rest.join(star, ["a", "b"], "left_anti"), "pairs")
    many = left.where(F.col("count") > SMALL).join(nodes.select("node", "bands"), "node").join(own, "node")
    return first.unionByName(verified(rest, own, least)).unionByName(spanned(many, least))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, least: int = SIMILARITY) -> DataFrame:
    """Per row: key and component_id (smallest key reachable), by fingerprints first and bands for the rest."""
    # the key is part of a text's place, so only texts of one key could be taken for each other
    texts = docs.select(F.col(key).alias("key"), F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash")).alias("at"), F.col(text).alias("text"))
    rows = materialise(sets(texts, k=k).drop("text").withColumn("row", F.monotonically_increasing_id()), "rows")
    same = ["h1", "h2", "size"]
    nodes = materialise(rows.groupBy(*same).agg(F.min("row").alias("node"), F.min("key").alias("least"), F.min_by("at", "row").alias("at"), F.first("bands").alias("bands"), F.min_by("fp", "row").alias("fp")), "nodes")
    found = components(links(nodes, texts.select("at", "text"), k, least))
    named = nodes.select("node", "least", *same).join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    moved = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select(*same, "component_id")
    return rows.select("key", *same).join(moved, same).select(F.col("key").alias(key), "component_id")
