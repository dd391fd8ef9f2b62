"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes that one numpy pass works on; a longer text is a pass of its own.
GROUP_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Unset, it is a fresh local folder on a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. Lost executors then cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or the first of name_1, name_2 ... that no column has (names differ without regard to case)."""
    used, n, out = {x.lower() for x in taken}, 0, name
    while out.lower() in used:
        n += 1
        out = f"{name}_{n}"
    return out


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """``df`` with more columns that Python makes from the column ``text``, batch by batch, without a shuffle.

    ``make`` runs once a task and returns the function of a list of texts; every other column passes through as Arrow data. A
    column of ``df`` that has the name of a new one is replaced, as by ``withColumn``; only ``text`` itself can't be.
    """
    new = {f.name.lower() for f in fields}
    if text.lower() in new:
        raise ValueError(f"the result can't replace the text column {text}")
    df = df.drop(*[c for c in df.columns if c.lower() in new])
    schema = T.StructType([*df.schema.fields, *fields])
    at = [f.name for f in df.schema.fields].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in pieces(whole, at):
                made = work(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(f.name for f in fields)])
        pa.default_memory_pool().release_unused()  # the worker lives on for other stages

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, at: int, most: int = 8 * GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least, so that memory follows the longest text only."""
    if not batch.num_rows:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes together, each with the number of its first text."""
    first, held, size = 0, [], 0
    for i, x in enumerate(texts):
        if held and size + len(x) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(x)
        size += len(x)
    if held:
        yield first, held


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """Words (runs without ASCII white space) of several texts at once: a 64-bit hash, byte start, byte end and text number of each."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = (buf == 32) | ((buf >= 9) & (buf <= 13))
        word = np.zeros(len(buf) + 1, np.int8)
        word[1:] = ~space
        edge = np.diff(word)
        self.start = np.flatnonzero(edge == 1)
        end = np.flatnonzero(edge == -1)
        self.end = end
        p, inverse = _powers(len(buf))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        ends = np.cumsum([len(t) + 1 for t in texts])  #: byte after each text
        self.offset = ends - [len(t) + 1 for t in texts]
        self.bounds = np.searchsorted(self.start, np.concatenate([[0], ends]))  #: words of text i: bounds[i] to bounds[i + 1]
        self.buf = buf

    def rolled(self, k: int) -> np.ndarray:
        """A hash of the ``k`` words from each word on, across text ends too; only the first ``len - k + 1`` make sense."""
        out = np.zeros(max(0, len(self.hash) - k + 1), np.uint64)
        for j in range(k):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += self.hash[j : j + len(out)]
        return mix(out)
