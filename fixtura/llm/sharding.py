"""Shards along a Hilbert curve, for file pruning by several columns at once.

Each dimension is quantised to 2**BITS cells at equal-depth cut points of the whole table (nulls have the first cell to
themselves); text columns are compared by the bytes that follow their common prefix, so cells keep the order of values.
Rows are sorted by the index of their cell on the Hilbert curve, ties by key, and cut into runs whose counts differ by
one at most (law `rows`). Values of every dimension are then close together inside a shard, whose least and greatest
values prune it.

The sort is one range partitioning of narrow rows, written to the shared folder; ranks are each partition's offset plus
the place in it. Ties are broken by key and content, so that equal cells, of any number of rows, are split as well.
Nulls: a null text has size 16 and CRC 0. Repeated rows are rows like any other. An empty table gives no rows.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.llm.common import materialise

BITS = 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of ``cells`` (rows by dimensions, values below 2**bits): Gray code, undone level by level."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(dims):
            set_ = (x[:, i] & level) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(set_, below, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[:, dims - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def _numbers(df: DataFrame, dims: list[str]) -> dict[str, Column]:
    """Each dimension as a double in the order of its values."""
    texts = [c for c in dims if isinstance(df.schema[c].dataType, T.StringType)]
    ends = df.agg(*[f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(texts) for n, f in (("lo", F.min), ("hi", F.max))]).first() if texts else None
    out = {}
    for c in dims:
        if c in texts:
            lo, hi = (ends[f"{n}{texts.index(c)}"] or "" for n in ("lo", "hi"))
            common = len(os.path.commonprefix([lo.encode(), hi.encode()]))
            rest = F.substring(F.encode(F.col(c), "utf-8"), common + 1, 6)
            out[c] = F.conv(F.rpad(F.hex(rest), 12, "0"), 16, 10).cast("double")
        else:
            out[c] = F.col(c).cast("double")
    return out


def curve(df: DataFrame, dims: list[str], bits: int = BITS) -> Column:
    """The Hilbert index of each row of ``df`` as a column."""
    numbers = _numbers(df, dims)
    share = F.array(*[F.lit(i / ((1 << bits) - 1)) for i in range(1, (1 << bits) - 1)])
    cuts = df.agg(*[F.percentile_approx(numbers[c], share, 10_000).alias(f"d{i}") for i, c in enumerate(dims)]).first()

    def cell(i: int, c: str) -> Column:
        own = F.array(*[F.lit(float(x)) for x in sorted(set(cuts[f"d{i}"] or []))]).cast("array<double>")
        return F.when(numbers[c].isNull(), F.lit(0)).otherwise(F.size(F.filter(own, lambda x: x <= numbers[c])) + 1)

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    return index(*[cell(i, c) for i, c in enumerate(dims)])


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (narrow) with `rank`, from 0 in the order of columns, and `total`, the count of rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = materialise(dealt.withColumns({"__part": F.spark_partition_id(), "__at": place}), "ranked")
    counts = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    every = Window.orderBy("__part")
    before = counts.select("__part", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    return fixed.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def shards(docs: DataFrame, dims: list[str], count: int = 40, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """Per row: key, size, text_crc32, hilbert, shard (0 to count - 1) and slot (from 0 in each shard)."""
    if count < 1 or not dims:
        raise ValueError("shards need a positive count and a dimension")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), curve(docs, dims, bits).alias("hilbert"))
    rows = materialise(rows, "curve")  # narrow, and read twice: for the ranges' sample and for the sort
    placed = ranked(rows, ["hilbert", "key", "size", "text_crc32"])
    shard = F.expr(f"cast(rank * {count} div total as int)")
    done = placed.withColumn("shard", shard).withColumn("slot", F.expr(f"rank - (cast(shard as long) * total + {count - 1}) div {count}"))
    return done.select(F.col("key").alias(key), "size", "text_crc32", "hilbert", "shard", "slot")
