"""Repeated passages by sparse suffix arrays.

Words are runs without ASCII white space. Of each text's suffixes only those at minimiser positions are kept: where the
hash of the next SEED words is the least (leftmost first) of some LEAST - SEED + 1 neighbouring ones. Equal runs of LEAST words
keep the same suffixes, so none is missed. A kept suffix carries its seed and the hash of its context, all words that any run of
LEAST words around the seed can hold.

Kept suffixes are sorted by seed, context and place: range partitions, sorted inside, so that a seed of a third of all rows is cut into
many tasks. Each suffix is compared with its neighbours in that order; groups that reach over a partition's edge are
completed by a table of the edges, two groups a partition at most:

* neighbours with the same context match to both ends of it;
* neighbours with the same seed only are extended left and right: of each context one suffix (and all of a context that one text alone holds)
  gives its runs of LEAST words, each under its own minimiser; runs are sorted and compared with their neighbours likewise.

Spans are the unions of all repeated runs, so they are maximal, and every part of one lies in a run of LEAST words or more that
occurs elsewhere (in another text, or again in the same one). ``extra`` leaves out each run's first occurrence by key and place.
Runs are equal if 128 bits of two hashes of their words are. Texts are shuffled once, by row, and only meet rows of their own.

Texts of fewer than LEAST words and null texts have no spans. Rows that repeat as a whole count as separate texts, whose text repeats; not with
``across``. Keys keep their type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.llm.common import _BASE, Words, _powers, groups, materialise, mix, pieces

LEAST, SEED = 50, 12
#: Rows that a task compares at once, and rows of a partition.
PIECE, PART = 1 << 18, 1 << 21


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` hashes the place of the least, leftmost first."""
    out = np.empty(max(0, len(h) - window + 1), np.int64)
    for i in range(0, len(out), 65_536):
        part = h[i : i + 65_536 + window - 1]
        out[i : i + 65_536] = np.lib.stride_tricks.sliding_window_view(part, window).argmin(axis=1) + np.arange(i, i + len(part) - window + 1)
    return out


class Text:
    """One text's words inside a group: hashes of any run of words, and code point offsets."""

    def __init__(self, words: Words, points: np.ndarray, total: np.ndarray, twin: np.ndarray, i: int):
        self.a, self.b = int(words.bounds[i]), int(words.bounds[i + 1])
        self.words, self.total, self.twin = words, total, twin
        self.points, self.first = points, int(points[words.offset[i]])

    def run(self, start: np.ndarray, end: np.ndarray, twin: bool = False) -> np.ndarray:
        """Hashes of the words from start to before end; ``twin``: second hashes, of other word hashes."""
        inverse, total = _powers(len(self.total))[1], self.twin if twin else self.total
        x = (total[self.a + end] - total[self.a + start]) * inverse[self.a + start]
        return mix(x + (end - start).astype(np.uint64) * np.uint64(_BASE))

    def chars(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.points[self.words.start[self.a + start]] - self.first, self.points[self.words.end[self.a + end - 1]] - self.first


def texts_of(raw: list[bytes]) -> Iterator[tuple[int, Text]]:
    for first, some in groups(raw):
        words = Words(some)
        points = np.concatenate([[0], np.cumsum((words.buf & 0xC0) != 0x80)])
        total, twin = np.zeros((2, len(words.hash) + 1), np.uint64)
        power = _powers(len(words.hash) + 1)[0][: len(words.hash)]
        np.cumsum(words.hash * power, out=total[1:])
        np.cumsum(mix(words.hash ^ np.uint64(_BASE)) * power, out=twin[1:])
        for i in range(len(some)):
            yield first + i, Text(words, points, total, twin, i)


def _seeds(t: Text, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes at every word, and the minimiser of each run of ``least`` words."""
    n = t.b - t.a
    at = np.arange(n - seed + 1)
    h = t.run(at, at + seed)
    return h, minimisers(h, least - seed + 1)


def suffixes(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """The kept suffixes of ``docs`` (key, uid, text): place, seed, context hash and the context's code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2):
                raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()]
                row, parts = [], []
                for i, t in texts_of(raw):
                    if t.b - t.a < least:
                        continue
                    h, own = _seeds(t, least, seed)
                    pos = np.unique(own)
                    start, end = np.maximum(pos - (least - seed), 0), np.minimum(pos + least, t.b - t.a)
                    a, b = t.chars(start, end)
                    row.append(np.full(len(pos), i))
                    parts.append((pos.astype(np.int32), h[pos].astype(np.int64), (t.run(start, end) ^ mix((pos - start).astype(np.uint64) + np.uint64(1))).astype(np.int64), a.astype(np.int32), b.astype(np.int32)))
                if parts:
                    at = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))], names=["key", "uid", "pos", "seed", "context", "a", "b"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, uid long, pos int, seed long, context long, a int, b int")


def runs(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """Runs of ``least`` words of ``docs`` (key, uid, text, wanted) whose minimiser is a wanted place: (key, uid, run, twin, pos, a, b, held).

    wanted: twice the place, plus one where another text has the same context; held tells that of the run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2):
                raw, wanted = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(2).to_pylist()], batch.column(3)
                row, parts = [], []
                for i, t in texts_of(raw):
                    own = _seeds(t, least, seed)[1]
                    code = wanted[i].values.to_numpy(zero_copy_only=False)
                    start = np.flatnonzero(np.isin(own, code >> 1))
                    a, b = t.chars(start, start + least)
                    row.append(np.full(len(start), i))
                    parts.append((t.run(start, start + least).astype(np.int64), t.run(start, start + least, True).astype(np.int64), start.astype(np.int32), a.astype(np.int32), b.astype(np.int32), np.isin(own[start], code[code & 1 == 1] >> 1)))
                if parts:
                    at = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))], names=["key", "uid", "run", "twin", "pos", "a", "b", "held"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, uid long, run long, twin long, pos int, a int, b int, held boolean")


def compared(rows: DataFrame, levels: list[list[str]], across: bool, held: bool = False, piece: int = PIECE, part: int = PART) -> DataFrame:
    """Rows (key, uid, pos, ...) that have others like them, sorted and compared with their neighbours.

    Rows are alike at a level if they have the same values in its columns and in those of the levels before it. Added for each level n: shared_n (another
    row is alike; ``across``: one of another text; ``held``: or a row alike has that flag), first_n (the first of those alike, by key and place)
    and, but for the last, mixed_n (those alike differ at the next level).

    Sorted rows stream in pieces of about ``piece`` rows that end between groups of the first level; a group that goes on beyond a piece or a partition
    is an edge, and edges are settled by an aggregate. Partitions have about ``part`` rows, so their number follows the table.
    """
    columns = [c for level in levels for c in level]
    order = [*columns, "key", "uid", "pos"]
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-rows.count() // part)  # rows are a stored table
    dealt = (rows.repartitionByRange(wanted, *order) if wanted > most else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    flags = [f"{name}_{n}" for n in range(len(levels)) for name in ("shared", "first", "mixed", "edge")]

    def told(table: pa.Table, opens: bool, closes: bool) -> Iterator[pa.RecordBatch]:
        """One piece; ``opens``, ``closes``: its first or last group may go on outside it."""
        uid, made, new = table["uid"].to_numpy(), [], np.arange(table.num_rows) == 0
        starts = []
        for level in levels:
            for c in level:
                new[1:] |= np.diff(table[c].to_numpy()) != 0
            starts.append(new.copy())
        for n, begins in enumerate(starts):
            at = np.flatnonzero(begins)
            size = np.diff([*at, len(uid)])
            shared = np.minimum.reduceat(uid, at) != np.maximum.reduceat(uid, at) if across else size > 1
            if held:
                shared |= np.logical_or.reduceat(table["held"].to_numpy(zero_copy_only=False), at)
            mixed = np.add.reduceat(starts[n + 1].astype(int), at) > 1 if n + 1 < len(starts) else np.zeros(len(at), bool)
            edge = np.zeros(len(at), bool)
            edge[0] |= opens
            edge[-1] |= closes
            made += [np.repeat(shared, size), begins, np.repeat(mixed, size), np.repeat(edge, size)]
        keep = pa.array(made[0] | made[3])
        for name, x in zip(flags, made, strict=True):
            table = table.append_column(name, pa.array(x))
        yield from table.filter(keep).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, opens, look = [], 0, True, piece
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            size += batch.num_rows
            if size >= look:
                table = pa.Table.from_batches(waiting)
                new = np.zeros(size, bool)
                for c in levels[0]:
                    new[1:] |= np.diff(table[c].to_numpy()) != 0
                last = int(np.flatnonzero(new)[-1]) if new.any() else 0  # where the last group begins
                if last:
                    yield from told(table.slice(0, last), opens, False)
                    waiting, size, opens = table.slice(last).to_batches(), size - last, False
                    look = max(piece, 2 * size)
                elif size >= 4 * piece:  # one group: what follows of it is an edge as well
                    yield from told(table, True, True)
                    waiting, size, opens, look = [], 0, True, piece
                else:
                    look = 2 * size
        if size:
            yield from told(pa.Table.from_batches(waiting), opens, True)

    found = materialise(dealt.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(f, T.BooleanType()) for f in flags)])), "sorted")
    place, names = F.struct("key", "uid", "pos"), rows.columns
    for n in range(len(levels)):
        own = [c for level in levels[: n + 1] for c in level]
        after = F.struct(*levels[n + 1]) if n + 1 < len(levels) else F.lit(0)
        shared = F.min("uid") != F.max("uid") if across else F.count(F.lit(1)) > 1
        whole = found.where(f"edge_{n}").groupBy(*own).agg((shared | F.max("held") if held else shared).alias("s"), F.min(place).alias("least"), (F.min(after) != F.max(after)).alias("m"))
        found = found.join(F.broadcast(whole), own, "left")  # at most two groups a partition, and those of over `piece` rows
        say = lambda name, new: F.when(F.col(f"edge_{n}"), new).otherwise(F.col(name)).alias(name)  # noqa: E731, B023
        fixed = {f"shared_{n}": F.col("s"), f"first_{n}": place.eqNullSafe(F.col("least")), f"mixed_{n}": F.col("m")}
        found = found.select(*names, *[say(f, fixed[f]) if f in fixed else F.col(f) for f in flags])
    return found.where("shared_0").select(*names, *[f for f in flags if not f.startswith("edge")])


def merged(pairs: DataFrame) -> DataFrame:
    """One row for each uid with the unions of its (a, b) spans, all and extra: gaps and islands over the uid's own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for column in (2, 3):
                made = []
                for spans in batch.column(column).to_pylist():
                    done = []
                    for s in sorted(spans, key=lambda s: (s["a"], s["b"])):
                        if done and s["a"] <= done[-1]["end"]:
                            done[-1]["end"] = max(done[-1]["end"], s["b"])
                        else:
                            done.append({"start": s["a"], "end": s["b"]})
                    made.append(done)
                out.append(pa.array(made, kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=["key", "uid", "spans", "extra"])

    span = F.struct("a", "b")
    grouped = pairs.groupBy("key", "uid").agg(F.collect_set(span).alias("all"), F.collect_set(F.when(~F.col("first"), span)).alias("extra"))
    kind = "array<struct<start:int,end:int>>"
    return grouped.mapInArrow(run, f"key {pairs.schema['key'].dataType.simpleString()}, uid long, spans {kind}, extra {kind}")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, seed: int = SEED, across: bool = False, piece: int = PIECE, part: int = PART) -> DataFrame:
    """Rows of ``docs`` with repeated passages: key, spans and extra, arrays of (start, end) code points.

    ``across``: only what another text (another key or other content) holds too; else repeats within one text count as well.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("uid"), F.col(text).alias("text"))
    kept = materialise(suffixes(rows, least, seed), "suffixes")
    met = materialise(compared(kept, [["seed"], ["context"]], across, piece=piece, part=part), "met")
    # same context: repeated from end to end of it
    whole = met.where("shared_1").select("key", "uid", "a", "b", F.col("first_1").alias("first"))
    # same seed, other context: one of each context is extended, and all of a context that one text alone holds
    wanted = met.where("mixed_0 and (first_1 or not shared_1)").select("key", "uid", (F.col("pos").cast("long") * 2 + (F.col("shared_1") & F.lit(across)).cast("long")).alias("wanted"))
    wanted = materialise(wanted.groupBy("key", "uid").agg(F.collect_set("wanted").alias("wanted")), "wanted")
    own = wanted.select(F.col("key").alias("of"), F.col("uid").alias("in"), "wanted")
    texts = rows.join(own, (F.col("uid") == F.col("in")) & F.col("key").eqNullSafe(F.col("of"))).select("key", "uid", "text", "wanted")
    extended = materialise(runs(texts, least, seed), "runs")
    # a context of two texts is extended for one of them, so its runs are shared even where no other row has them
    inner = compared(extended, [["run", "twin"]], across, held=True, piece=piece, part=part).select("key", "uid", "a", "b", F.col("first_0").alias("first"))
    return merged(whole.unionByName(inner)).select(F.col("key").alias(key), "spans", "extra")
