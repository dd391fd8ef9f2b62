"""Phrase collocations by set-oriented relational mining.

R(k) is the relation of occurrences of phrases of k words, sorted by piece and position: the start of each, and which phrase it
is. R(k + 1) is R(k) merge-joined with itself at the adjacent position of the same piece, grouped by phrase and counted; only
occurrences of frequent groups are kept (semi-join) before the next length. Each R is persisted in the shared folder.

The relations are stored by block: some BLOCK bytes of text of one language, as sorted arrays of positions and of word
numbers within the block (compressed), so the merge-join is one pass over two sorted arrays of the same block and moves
nothing. A position is counted up by one within a piece and skips one between pieces. What Spark shuffles are groups that each block has counted
already, one row a phrase and block, so the commonest word has no more rows than there are blocks; frequent groups go back
to the blocks that hold them. Words are told apart by their bytes, phrases by the numbers of their frequent words (numbers
from 1, 32 bits), never by hashes alone.

Scores, cuts and inclusion are joins over the frequent phrases, keyed by (`a`, `b`): two words a number. Products are decimals
of 38 digits.

Odd rows. A null text is empty, a null language `und`. Repeated rows count as often as they stand there; ids and other columns
aren't looked at. A text longer than a block is cut between pieces; a piece is never cut. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixtura.llm.common import materialise

BLOCK, LEAST, LONGEST, FIRST, INSIDE = 1 << 21, 30, 4, 2000, 80
_LOWER = bytearray(range(256))
_LOWER[65:91] = range(97, 123)
for _c in b".,;:!?\n\x0b\x0c\r":
    _LOWER[_c] = 0xFF  #: ends a piece; no byte of UTF-8
_LOWER = bytes(_LOWER)
_LONGS, _LOW = pa.list_(pa.int64()), (1 << 32) - 1


def packed(a: np.ndarray) -> bytes:
    """An array of whole numbers as compressed bytes: Spark moves them without looking at each."""
    raw = a.astype(np.int32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), np.int32)


def _gaps(pos: np.ndarray) -> bytes:
    return packed(np.diff(pos, prepend=0))


def _places(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b))


def cut(text: bytes, most: int) -> Iterator[bytes]:
    """A lower-cased text in parts of about ``most`` bytes, cut between pieces only."""
    at = 0
    while len(text) - at > most:
        end = text.rfind(b"\xff", at, at + most)
        end = text.find(b"\xff", at + most) if end < 0 else end
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """R(1) of a block: positions, word numbers, the distinct words, and how often each occurs."""
    raw = b"\xff".join(texts).replace(b"\xff", b" \xff ")
    whole = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(raw)], np.int32)), pa.py_buffer(raw))  # bytes: what splits them is ASCII
    told = pc.ascii_split_whitespace(whole).values.dictionary_encode()
    words = told.dictionary.cast(pa.binary())
    at = told.indices.to_numpy(zero_copy_only=False)
    real = np.array([w not in (b"", b"\xff") for w in words.to_pylist()], bool)
    pos = np.flatnonzero(real[at]) if len(real) else np.zeros(0, np.int64)
    number = np.cumsum(real) - 1
    local = number[at[pos]] if len(pos) else np.zeros(0, np.int64)
    return pos.astype(np.int32), local.astype(np.int32), words.filter(pa.array(real, pa.bool_())), np.bincount(local, minlength=int(real.sum()))


def _blocks(docs: DataFrame, text: str, lang: str, block: int) -> DataFrame:
    """R(1) with all words: block, lang, pos, local, words, counts."""
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, held, size = TaskContext.get().partitionId() << 32, 0, {}, {}

        def flush(name: str) -> pa.RecordBatch:
            nonlocal seq
            pos, local, words, counts = occurrences(held.pop(name))
            del size[name]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([name], pa.string()), pa.array([_gaps(pos)], pa.binary()), pa.array([packed(local)], pa.binary()), pa.array([words.cast(pa.string())], pa.list_(pa.string())), pa.array([counts], _LONGS)], names=["block", "lang", "pos", "local", "words", "counts"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for name, raw in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    for part in cut((raw or b"").translate(_LOWER), block):
                        if name in held and size[name] + len(part) > block:
                            yield flush(name)
                        held.setdefault(name, []).append(part)
                        size[name] = size.get(name, 0) + len(part) + 1
                        if sum(size.values()) > 8 * block:  # many languages at once
                            yield flush(max(size, key=size.get))
        for name in list(held):
            yield flush(name)

    return materialise(own.mapInArrow(run, "block long, lang string, pos binary, local binary, words array<string>, counts array<bigint>"), "r0")


def _numbered(df: DataFrame) -> DataFrame:
    """``df``, written, with `id` from 1 without gaps."""
    own = materialise(df.withColumn("__m", F.monotonically_increasing_id()), "terms")
    told = sorted(own.groupBy(F.shiftright("__m", 33).alias("p")).agg(F.max("__m").alias("m")).collect())  # one row a partition
    rows, at = [], 1
    for p, m in told:
        rows.append((p, at))
        at += m - (p << 33) + 1
    if at > 1 << 32:
        raise ValueError("more than 2**32 frequent words")
    base = own.sparkSession.createDataFrame(rows, "p long, base long")
    return own.withColumn("p", F.shiftright("__m", 33)).join(F.broadcast(base), "p").withColumn("id", F.col("base") + F.col("__m") - F.shiftleft("p", 33)).drop("__m", "p", "base")  # one row a partition


def extended(k: int, pos: np.ndarray, local: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """R(k) merge-joined with itself at the adjacent position: where phrases of k + 1 words start, and their codes in the block.

    ``group`` holds the number of the frequent phrase of k words that starts at each row, or -1; ``n`` is the number of words.
    """
    if len(pos) <= k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    meets = (group[:-1] >= 0) & (group[1:] >= 0) & (pos[1:] == pos[:-1] + 1)
    at = np.flatnonzero(meets)
    return at, group[at].astype(np.int64) * n + local[at + k]


def _row(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """pos, local, group and ids of one block."""
    get = lambda c: batch.column(c)[r].as_py()
    return _places(get("pos")), unpacked(get("local")), unpacked(get("group")), batch.column("ids")[r].values.to_numpy(zero_copy_only=False)


_PACKED = "block long, pos binary, local binary, group binary, ids array<bigint>"


def _stored(block, pos: np.ndarray, local: np.ndarray, group: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (_gaps(pos), packed(local), packed(group))), pa.array([ids], _LONGS)], names=["block", "pos", "local", "group", "ids"])


def _relation(df: DataFrame, k: int) -> DataFrame:
    """Groups of k + 1 words that each block counts in its R(k): a, block, n, and beyond two words also b and code."""
    names = ["a", "block", "n"] if k == 1 else ["a", "block", "n", "b", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                pos, local, group, ids = _row(whole, r)
                at, code = extended(k, pos, local, group, len(ids))
                code, first, n = np.unique(code, return_index=True, return_counts=True)
                start = at[first]
                word = [ids[local[start + j]] for j in range(k + 1)] + [np.zeros(len(start), np.int64)] * (3 - k)
                columns = [(word[0] << 32) | word[1], np.full(len(start), whole.column("block")[r].as_py()), n, (word[2] << 32) | word[3], code][: len(names)]
                for i in range(0, len(start), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 14)], pa.int64()) for c in columns], names=names)

    return df.select("block", "pos", "local", "group", "ids").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _frequent(df: DataFrame, k: int, least: int) -> DataFrame:
    """The groups of k + 1 words that occur ``least`` times in all blocks, with the blocks that hold them: a, b, block, code, f.

    One shuffle serves the count and the semi-join: a window over a group has one row a block.
    """
    rows = _relation(df, k)
    keys = ["a"] if k == 1 else ["a", "b"]
    found = rows.withColumn("f", F.sum("n").over(Window.partitionBy(*keys))).where(F.col("f") >= least).drop("n")
    return materialise(found if k > 1 else found.withColumns({"b": F.lit(0).cast("long"), "code": F.col("a")}), f"f{k + 1}")


def _kept(df: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """R(k + 1), persisted: rows of R(k) in a frequent phrase of k + 1 words, `group` telling which one starts there."""
    codes = found.groupBy("block").agg(F.sort_array(F.collect_list("code")).alias("codes"))  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                pos, local, group, ids = _row(whole, r)
                codes = whole.column("codes")[r].values.to_numpy(zero_copy_only=False)
                if k == 1:  # pairs came back by the words' ids, which are in order
                    codes = np.searchsorted(ids, codes >> 32) * len(ids) + np.searchsorted(ids, codes & _LOW)
                at, code = extended(k, pos, local, group, len(ids))
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                here = codes[place] == code
                now = np.full(len(pos), -1, np.int32)
                now[at[here]] = place[here]
                inside = np.zeros(len(pos), bool)
                for j in range(k + 1):
                    inside[at[here] + j] = True
                yield _stored(whole.column("block")[r].as_py(), pos[inside], local[inside], now[inside], ids)

    return materialise(df.join(codes, "block").select("block", "pos", "local", "group", "ids", "codes").mapInArrow(run, _PACKED), f"r{k + 1}")


def _words(raw: DataFrame, back: DataFrame) -> DataFrame:
    """R(1), persisted: occurrences of frequent words only; a block's words are numbered anew in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                pos, local = _places(whole.column("pos")[r].as_py()), unpacked(whole.column("local")[r].as_py())
                terms = whole.column("terms")[r].values
                ids, at = (terms.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                number = np.full(int(max(local.max(initial=0), at.max(initial=0))) + 1, -1, np.int32)
                number[at] = np.arange(len(at))
                local = number[local]
                pos, local = pos[local >= 0], local[local >= 0]
                yield _stored(whole.column("block")[r].as_py(), pos, local, local, ids)

    return materialise(raw.select("block", "pos", "local").join(back, "block").select("block", "pos", "local", "terms").mapInArrow(run, _PACKED), "r1")


def _key(words: str, a: str, b: str) -> list:
    """Columns a and b of an array of 1 to 4 ids."""
    w = lambda i: f"coalesce(get({words}, {i}), 0)"
    return [F.expr(f"shiftleft({w(0)}, 32) | {w(1)}").alias(a), F.expr(f"shiftleft({w(2)}, 32) | {w(3)}").alias(b)]


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, f, id), frequent phrases of 2 to ``longest`` (4 at most) words (k, a, b, f), and the words of each language (lang, n)."""
    raw = _blocks(docs, text, lang, block)
    sizes = raw.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda t, x: t + x)).alias("n"))
    each = raw.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select("block", "lang", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    terms = _numbered(each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    back = each.join(terms.select("lang", "word", "id").hint("shuffle_hash"), ["lang", "word"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "local"))).alias("terms"))  # of one block
    now, out = _words(raw, back), None
    for k in range(1, longest):
        found = _frequent(now, k, least)
        own = found.groupBy("a", "b").agg(F.first("f").alias("f")).select(F.lit(k + 1).alias("k"), "a", "b", "f")
        out = own if out is None else out.unionByName(own)
        if k + 1 < longest:
            now = _kept(now, found, k)
    return terms, materialise(out, "phrases"), sizes


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, first: int = FIRST, inside: int = INSIDE, block: int = BLOCK) -> DataFrame:
    """Each language's ``first`` phrases by score: lang, rank, phrase, a, l, r, n, score.

    Candidates occur ``least`` times (a). The score of a cut after k words is floor(2000000 * a / (l + r)), l and r the occurrences of
    both parts; the lowest counts, ties to the smallest k. A candidate inside a longer one with ``inside`` percent of its
    occurrences or more is dropped. Order: score and a descending, phrase ascending by its bytes.
    """
    terms, own, sizes = counted(docs, text, lang, least, longest, block)
    low = "4294967295L"
    own = own.withColumn("w", F.expr(f"slice(array(shiftrightunsigned(a, 32), a & {low}, shiftrightunsigned(b, 32), b & {low}), 1, k)"))
    every = own.select("a", "b", "f").unionByName(terms.select(F.shiftleft("id", 32).alias("a"), F.lit(0).cast("long").alias("b"), "f"))
    cuts = own.select("a", "b", F.col("f"), "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"), "k").withColumns({"head": F.expr("slice(w, 1, cut)"), "rest": F.expr("slice(w, cut + 1, k - cut)")})
    cuts = cuts.select("a", "b", "f", "cut", *_key("head", "la", "lb"), *_key("rest", "ra", "rb"))
    part = lambda s: every.select(F.col("a").alias(f"{s}a"), F.col("b").alias(f"{s}b"), F.col("f").alias(s))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(f as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    scored = cuts.join(part("l"), ["la", "lb"]).join(part("r"), ["ra", "rb"]).groupBy("a", "b").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s"), F.first("f").alias("f"))
    spans = F.expr("filter(flatten(transform(sequence(2, greatest(k - 1, 2)), n -> transform(sequence(1, k - n + 1), i -> slice(w, i, n)))), x -> size(x) < k)")
    held = own.where("k > 2").select("f", F.explode(spans).alias("x")).select("f", *_key("x", "a", "b")).groupBy("a", "b").agg(F.max("f").alias("held"))
    wide = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(3,0)")
    kept = scored.join(held, ["a", "b"], "left").where(~F.coalesce(wide("held", 100) >= wide("f", inside), F.lit(False)))
    said = kept.join(own.select("a", "b", "w"), ["a", "b"]).select("a", "b", "f", "s", F.posexplode("w").alias("i", "id")).join(terms.select("id", "word", "lang"), "id")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    named = said.groupBy("a", "b").agg(F.first("lang").alias("lang"), phrase.alias("phrase"), F.first("f").alias("f"), F.first("s").alias("s")).withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(64)))
    order = [F.desc("s.score"), F.desc("f"), F.asc("phrase")]
    some = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)  # each 64th of a language first
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return top.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"))
