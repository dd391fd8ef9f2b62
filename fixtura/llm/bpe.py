"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts of up to CHUNK code points are one chunk. Longer ones are cut into chunks of CHUNK code points that also see the
OVERLAP code points after their end. Chunk rows are dealt to tasks by (text, chunk), so one long text is worked on by many
tasks at once. Each chunk is pre-tokenised on its own and encodes its pieces where it lies; it notes the boundaries inside both overlaps, with
the ids before each. Two pre-tokenisations that share a boundary agree from there on, so neighbours are stitched at the first
boundary that both have: each chunk gives the ids between its two cuts. Ids and boundaries are gathered by text, once;
texts are not. Where neighbours share no boundary (a word longer than the overlap), that text is encoded whole, in one
task. Decoding joins the raw bytes of the ids.

Only texts of several chunks are shuffled, compressed; a text's ids are one row in any case, so that is the bound.
Nulls count as empty texts, which have no ids. Rows repeat as they come; other columns stay.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.llm.common import append_columns, fresh, materialise, pieces

CHUNK, OVERLAP = 8_192, 1_024
#: Entries of a task's memory of encoded pieces; it starts anew beyond that.
MEMORY = 100_000


def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Encoder(dict):
    """Ids of each piece met so far, as the bytes of 32-bit integers: a text's ids are the pieces' bytes joined."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.split, self.find = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.piece = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary(path), special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", self.piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) < 64:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, texts: list[str | None]) -> pa.Array:
        """Ids of each text, as an array of lists; nulls as empty texts."""
        found = [b"".join(map(self.__getitem__, self.split(t))) if t else b"" for t in texts]
        ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))


class Decoder:
    """Bytes of each id."""

    def __init__(self, path: str):
        known = vocabulary(path)
        self.tokens = np.full(max(known.values()) + 1, None, object)
        self.tokens[list(known.values())] = list(known)

    def decode(self, lists: pa.Array) -> pa.Array:
        """Raw bytes of each list of ids, joined; a null list is null."""
        flat, ends, empty = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
        return pa.array([None if empty[i] else b"".join(self.tokens[flat[ends[i] : ends[i + 1]]].tolist()) for i in range(len(lists))], pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP, keep: bool = True, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``out``, the ids of each text (array<int>); without ``keep`` the text column goes. ``decoded``: also that column, the ids' bytes, as ``decode`` gives them; made in the same pass, it spares a second Python worker a task."""
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must be positive and at most chunk")
    fields = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.BinaryType())] if decoded else [])]

    def make():
        known, back = Encoder(path, pattern), Decoder(path) if decoded else None

        def run(texts: list) -> list[pa.Array]:
            ids = known.encode(texts)
            return [ids, back.decode(ids)] if back else [ids]

        return run

    short = F.coalesce(F.length(text), F.lit(0)) <= chunk
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (out.lower(), (decoded or out).lower())])
    single = append_columns(docs.where(short), text, fields, make)
    single = single if keep else single.drop(text)
    long = _long(docs.where(~short), path, pattern, text, out, chunk, overlap, keep)
    return single.unionByName(decode(long, path, out, decoded) if decoded else long)


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """key, key2 (128 bits of the whole row), row (all other columns) and text. Equal rows have equal keys: their chunks are equal too, and are counted."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("none"))
    return docs.select(F.xxhash64(row, F.col(text)).alias("key"), F.xxhash64(F.lit(1), row, F.col(text)).alias("key2"), row.alias("row"), F.col(text).alias("text"))


def zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unzipped(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def dealt(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunk rows of the texts of ``keyed``, dealt by text and chunk: key, key2, row (of the first chunk), n, at, part (compressed)."""
    spark = rows.sparkSession
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("n", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("part", T.BinaryType())])
    schema["row"].nullable = True

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 3):
                for i, t in enumerate(batch.column(3).to_pylist()):
                    n = -(-len(t) // chunk)
                    for first in range(0, n, 64):
                        places = range(first, min(n, first + 64))
                        parts = [zipped(t[at * chunk : (at + 1) * chunk + overlap].encode("utf-8", "surrogatepass")) for at in places]
                        own = batch.select([0, 1, 2]).take(pa.array([i] * len(parts)))
                        kept = batch.column(2).take(pa.array([None if at else i for at in places], pa.int64()))
                        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), kept, pa.array([n] * len(parts), pa.int32()), pa.array(places, pa.int32()), pa.array(parts, pa.binary())], names=schema.names)

    return rows.mapInArrow(cut, schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "key2", "at")


def _long(docs: DataFrame, path: str, pattern: str, text: str, out: str, chunk: int, overlap: int, keep: bool) -> DataFrame:
    """The same for texts of several chunks."""
    rows, keys, ints = keyed(docs, text), ["key", "key2"], pa.list_(pa.int32())
    chunks = dealt(rows, chunk, overlap)
    schema = T.StructType([*chunks.schema.fields[:5], *T.StructType.fromDDL("ids binary, head binary, tail binary").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Encoder(path, pattern)
        for whole in batches:
            for s in range(0, whole.num_rows, 64):
                batch, made = whole.slice(s, 64), []
                for n, at, raw in zip(*(batch.column(c).to_pylist() for c in ("n", "at", "part")), strict=True):
                    part = unzipped(raw).decode("utf-8", "surrogatepass")
                    ids, ends, before = [], [], 0
                    for m in known.find(part):
                        ids.append(known[m[0]])
                        before += len(ids[-1]) // 4
                        ends.append((m.end(), before))
                    # a piece that ends with the visible text could go on: such an end is no boundary unless the text ends there
                    safe = [x for x in ends if x[0] < len(part) - 1]
                    head = [x for x in safe if x[0] <= overlap] if at else []
                    tail = [(e - chunk, c) for e, c in safe if e > chunk] if at < n - 1 else []
                    # boundaries and the ids before each, as steps
                    made.append((zipped(b"".join(ids)), *(zipped(np.diff(np.array(x, np.int32).reshape(-1, 2), axis=0, prepend=0).T.astype(np.int32).tobytes()) for x in (head, tail))))
                columns = list(zip(*made, strict=True)) if made else [()] * 3
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(c, pa.binary()) for c in columns)], names=schema.names)

    encoded = chunks.mapInArrow(work, schema)
    part = F.struct("at", "ids", "head", "tail")
    gathered = encoded.groupBy(*keys).agg(F.first("row", ignorenulls=True).alias("row"), (F.count(F.lit(1)) / F.first("n")).cast("int").alias("times"), F.array_sort(F.collect_set(part)).alias("p"))
    told = T.StructType([*gathered.schema.fields[:4], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 16):
                batch, made = whole.slice(s, 16), []
                for r in range(batch.num_rows):
                    p, start, own = batch.column("p")[r].as_py(), 0, []
                    for i, x in enumerate(p):
                        ids = np.frombuffer(unzipped(x["ids"]), np.int32)
                        stop, after = len(ids), 0
                        if i + 1 < len(p):
                            (tail, stops), (head, starts) = (np.cumsum(np.frombuffer(unzipped(y), np.int32).reshape(2, -1), axis=1) for y in (x["tail"], p[i + 1]["head"]))
                            both, left, right = np.intersect1d(tail, head, assume_unique=True, return_indices=True)
                            if not len(both):
                                own = None
                                break
                            stop, after = int(stops[left[0]]), int(starts[right[0]])  # the first boundary of both
                        own.append(ids[start:stop])
                        start = after
                    made.append(None if own is None else np.concatenate(own))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, ints)], names=told.names)

    done = materialise(gathered.mapInArrow(stitch, told), "ids")
    found = done.where("ids is not null").withColumnRenamed("ids", "__ids")
    if keep:  # the texts come back to their ids
        back = rows.join(found.select(*keys, "__ids"), keys)
    else:
        back = found.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
    shown = lambda df: df.select(*[F.col("text").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if keep or c != text], F.col("__ids").alias(out))
    if not done.where("ids is null").limit(1).count():
        return shown(back)

    def make():
        known = Encoder(path, pattern)
        return lambda texts: [known.encode(texts)]

    open_ = rows.join(done.where("ids is null").select(*keys), keys, "left_semi")
    return shown(back).unionByName(shown(append_columns(open_, "text", [T.StructField("__ids", T.ArrayType(T.IntegerType()))], make)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the raw bytes of the ids joined (binary; null ids: null). An id outside the vocabulary is an error (IndexError, or TypeError for a gap or a null id)."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(path)
        for whole in batches:
            for k in range(0, max(1, whole.num_rows), 500):
                batch = whole.slice(k, 500)
                yield pa.RecordBatch.from_arrays([*batch.columns, back.decode(batch.column(at))], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 and decoded_sha256, after a round trip through the ids."""
    ids = fresh([key, text], "ids")
    raw = fresh([key, text, ids], "decoded")
    done = encode(docs.select(key, text), path, pattern, text, ids, keep=False, decoded=raw)
    return done.select(key, F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col(ids), " "), 256).alias("ids_sha256"), F.sha2(F.col(raw), 256).alias("decoded_sha256"))
