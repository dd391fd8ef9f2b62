"""Exact top-k search by inner product, pruned with segment statistics at several resolutions.

For a segment of L components with means m and deviations s, the squared distance of two vectors is at least
L * ((m - m')**2 + (s - s')**2), so their inner product is at most L * (m * m' + s * s'), summed over segments. Bounds go from
coarse to fine segments; pairs whose bound falls below the query's k-th best known score drop out, the rest are scored
exactly. Ties with that score stay, so results are exact.

Rows are sorted along the Hilbert curve of their coarsest means and cut into blocks of about CANDIDATES rows. In a first job the queries of
each block meet their own block, where their nearest rows are likely to be: that gives each query a k-th best score once. In a second one
queries, in blocks of QUERIES rows, carry it to all other blocks, one task a pair of blocks with bounded memory. In a task candidates
are taken in tiles of TILE rows along the curve: a tile whose envelope (ranges of means, greatest deviations) bounds a query
below its score is skipped, then pairs drop out level by level. Where at most a tenth of a tile's pairs is left, the
rest is bounded and scored pair by pair; a tile that its levels leave denser is one matrix product. Each block yields at most k
rows a query, which a last pass over the query's rows merges.

A row's own vector is left out by row, so a repeated row is a candidate of its twin. Vectors of unequal length are taken as if
zeros followed. Null vectors, and those with null or non-finite components, take no part; null ids do, and lose ties. Ids
keep their type.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.llm.common import materialise
from fixtura.llm.sharding import hilbert

CANDIDATES, QUERIES, TILE, LEVELS, DENSE = 4_096, 16_384, 1_024, (4, 8, 16, 32), 0.1


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for vectors that take no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & F.coalesce(good, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def parts(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, times the root of the segments' length."""
    length = -(-x.shape[1] // segments)
    full = np.zeros((len(x), segments * length))
    full[:, : x.shape[1]] = x
    cut = full.reshape(len(x), segments, length)
    return cut.mean(axis=2) * np.sqrt(length), cut.std(axis=2) * np.sqrt(length)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations side by side: their dot product is the bound."""
    return np.concatenate(parts(x, segments), axis=1)


def place(x: np.ndarray, segments: int = LEVELS[0], bits: int = 4) -> np.ndarray:
    """Where each row's coarsest means, relative to its length, stand on a Hilbert curve."""
    mean, norm = parts(x, segments)[0], np.sqrt((x * x).sum(axis=1, keepdims=True))
    cells = ((mean / np.where(norm > 0, norm, 1) + 1) * (1 << (bits - 1))).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << bits) - 1), bits)


def best(q: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_row: np.ndarray, c_order: np.ndarray, k: int, known: np.ndarray | None = None, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, candidate places and scores of each query's k best, ties to the smaller ``c_order``.

    known: a score of each query that k of its candidates, here or elsewhere, are known to reach; -inf where there is none.
    tally: counts what the levels leave, if given (pairs by level name).
    """
    whole = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]) < 2**52  # floats are exact then, else Python integers are
    own_q, own_c = (q, c) if whole else (q.astype(np.int64).astype(object), c.astype(np.int64).astype(object))
    fine = [n for n in LEVELS if 2 * n < q.shape[1]]  # finer statistics cost as much as the score
    q_stats, c_stats = [statistics(q, n) for n in fine], [statistics(c, n) for n in fine]
    mean_q, dev_q = parts(q, min(LEVELS[0], max(1, q.shape[1])))
    mean_c, dev_c = parts(c, min(LEVELS[0], max(1, q.shape[1])))
    edges = np.arange(0, len(c), TILE)
    above, below = np.maximum(mean_q, 0), np.minimum(mean_q, 0)
    envelope = above @ np.maximum.reduceat(mean_c, edges).T + below @ np.minimum.reduceat(mean_c, edges).T + dev_q @ np.maximum.reduceat(dev_c, edges).T if len(c) else np.zeros((len(q), 0))
    known = np.full(len(q), -np.inf) if known is None else known.astype(float)
    tally = {} if tally is None else tally
    out = []

    def seen(name: str, pairs: int) -> None:
        tally[name] = tally.get(name, 0) + int(pairs)

    for a in range(0, len(q), TILE):
        b, held = min(a + TILE, len(q)), [np.zeros(0, np.int64)] * 3
        for t in np.argsort(-envelope[a:b].max(axis=0)):  # the most promising tiles first
            slack = 1e-9 * np.abs(known[a:b]) + 1e-3
            least = np.where(np.isfinite(known[a:b]), known[a:b] - slack, -np.inf)
            rows = a + np.flatnonzero(envelope[a:b, t] >= least)
            cols = np.arange(edges[t], min(edges[t] + TILE, len(c)))
            seen("all", (b - a) * len(cols))
            seen("envelope", len(rows) * len(cols))
            i = j = None
            for n, sq, sc in zip(fine, q_stats, c_stats, strict=True):
                if i is None:
                    ok = sq[rows] @ sc[cols].T >= least[rows - a, None]
                    n_ok = int(np.count_nonzero(ok))
                    if n_ok <= DENSE * ok.size:
                        i, j = np.nonzero(ok)
                        i, j = rows[i], cols[j]
                    else:
                        rows, cols = rows[ok.any(axis=1)], cols[ok.any(axis=0)]
                elif len(i):
                    keep = np.einsum("pd,pd->p", sq[i], sc[j]) >= least[i - a]
                    i, j = i[keep], j[keep]
                seen(f"level {n}", n_ok if i is None else len(i))
            if i is None:
                if not len(rows):
                    continue
                score = q[rows] @ c[cols].T
                score[q_row[rows, None] == c_row[None, cols]] = -np.inf
                if len(cols) > k:  # k candidates of this tile reach its k-th best
                    kth = np.partition(score, len(cols) - k, axis=1)[:, len(cols) - k]
                    least[rows - a] = np.maximum(least[rows - a], kth - (1e-9 * np.abs(kth) + 1e-3 if not whole else 0))
                i, j = np.nonzero((score >= least[rows - a, None]) & (score > -np.inf))
                value = score[i, j] if whole else None
                i, j = rows[i], cols[j]
            else:
                keep = q_row[i] != c_row[j]
                i, j, value = i[keep], j[keep], None
            seen("scored", len(i))
            if value is None:
                value = np.concatenate([(own_q[i[s : s + 65_536]] * own_c[j[s : s + 65_536]]).sum(axis=1) for s in range(0, len(i), 65_536)] or [np.zeros(0)])
            i, j, value = (np.concatenate(x) for x in zip(held, (i, j, value.astype(np.int64)), strict=True))
            order = np.lexsort((c_order[j], -value, i))
            i, j, value = i[order], j[order], value[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            held = [i[rank < k], j[rank < k], value[rank < k]]
            full = rank == k - 1
            known[i[full]] = np.maximum(known[i[full]], value[full])
        out.append(held)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of numbers as rows, zeros after the shorter ones."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max(1, size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def search(table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, the neighbour's key and its score, for every row that ``is_query`` holds for, against all other rows."""
    kind = table.schema[key].dataType.simpleString()

    @F.pandas_udf("long")
    def code(v: pd.Series) -> pd.Series:
        return pd.Series(place(_matrix(pa.array(v, pa.list_(pa.int64()))))) if len(v) else pd.Series([], dtype="int64")

    rows = table.select(F.col(key).alias("id"), quantised(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("v is not null")
    rows = materialise(rows.withColumns({"row": F.monotonically_increasing_id(), "code": code("v")}), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    dealt = rows.repartitionByRange(max(1, -(-n["n"] // CANDIDATES)), "code", "row").withColumn("block", F.spark_partition_id())
    dealt = materialise(dealt, "blocks")  # equal places are cut by row, so a block stays a block when a third of all rows are alike
    blocks, q_blocks = (dealt.agg(F.max("block")).first()[0] or 0) + 1, max(1, -(-n["q"] // QUERIES))

    def meet(queries: pa.Table, candidates: pa.Table, known: np.ndarray | None) -> pa.Table:
        width = [_matrix(x["v"]) for x in (queries, candidates)]
        most = max(x.shape[1] for x in width)
        q, c = (np.pad(x, ((0, 0), (0, most - x.shape[1]))) for x in width)
        order = np.empty(len(c), np.int64)
        order[pc.sort_indices(candidates, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(c))
        i, j, score = best(q, queries["row"].to_numpy(), c, candidates["row"].to_numpy(), order, k, known)
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        return pa.table({"query_row": queries["row"].take(i), "query_id": queries["id"].take(i), "id": candidates["id"].take(j), "row": candidates["row"].take(j), "score": pa.array(score)})

    def home(block: pa.Table) -> pa.Table:
        block = block.sort_by("code")
        return meet(block.filter(block["asks"]), block, None)

    def away(block: pa.Table) -> pa.Table:
        block = block.sort_by("code")
        asks = block.filter(block["asks"])
        return meet(asks, block.filter(pc.invert(block["asks"])), asks["known"].to_numpy())

    result = f"query_row long, query_id {kind}, id {kind}, row long, score long"
    found = materialise(dealt.repartition(blocks, "block").groupBy("block").applyInArrow(home, result), "home")
    if blocks > 1:
        own = found.groupBy("query_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("known")).withColumnRenamed("query_row", "row")
        asking = dealt.where("asks").join(own, "row", "left").withColumn("known", F.coalesce(F.col("known").cast("double"), F.lit(float("-inf"))))
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        candidates = dealt.select("id", "v", "row", "code", F.lit(False).alias("asks"), F.lit(0.0).alias("known"), F.col("block").alias("c"), every(q_blocks).alias("q"))
        queries = asking.select("id", "v", "row", "code", "asks", "known", every(blocks).alias("c"), F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int").alias("q"), "block").where("c <> block").drop("block")
        met = candidates.unionByName(queries).repartition(blocks * q_blocks, "c", "q").groupBy("c", "q")
        found = found.unionByName(met.applyInArrow(away, result))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
