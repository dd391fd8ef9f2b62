"""Conversation structure repair by rank-convergence parallel Viterbi.

Rows of a conversation, ordered by turn (nulls first), are edited at least cost so that the initials of their roles read
``(s?(ua)+)?``. Keep costs 0, Rerole to user or assistant 1, Delete 2 (a must for blank and duplicate rows), Insert of an
empty user or assistant turn 5; a truncated row that stays adds 5. Of the cheapest edits the audit, their initials in
order, is ASCII-least. The audit alone fixes the repaired roles: an odd number of kept turns begins with s.

How it is made parallel. Rows are range-sorted by (conversation, turn, role, hash of the text), so a long conversation is
spread over tasks; each task cuts its rows into chunks of at most CHUNK rows that may stay (and CHUNK_BYTES of text, one
row at least). A chunk's backward step maps the vector of costs after it (one for each of the states start, s, u, a) to the
vector before it. Every chunk starts from a speculative vector; fix-up passes rerun the chunks whose successor's vector has
turned out other than assumed, until vectors differ only by constants, which are added up apart. Chunks that pass their
successor's vector on for ever (a run of user turns only) do not converge in few passes: what is left after PASSES passes
is settled exactly, by min-plus products over a tree of FAN chunks a node. From the stitched vectors each chunk traces
the ASCII-least edits from its entry state, which follows from the chunks before it by composing their maps of states,
over the same tree. Most conversations are one chunk and need none of this: no pass, no further shuffle.

Only chunk numbers by partition (a row a partition) reach the driver. The digest of a conversation of several chunks is
sequential by its nature: its kept texts stream through one task, one chunk in memory at a time.

Odd rows. Null roles and texts count as one space (so such a row is blank, or must be reroled); a null turn comes first; a
null conversation key is a conversation. Rows of equal turn are ordered by role, then by SHA-256 of the text; of rows equal
in all four, all but the first are duplicates. Texts are compared by SHA-256. Other columns are not looked at. A
conversation without rows does not exist, but ``damage`` marks conversations that lost all rows, and those come out with zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.llm.common import materialise

CHUNK, CHUNK_BYTES, PASSES, FAN = 256, 1 << 20, 4, 256
BLANK_FREE, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: States: nothing yet, after s, after u, after a. NEXT: the state after an inserted or reroled turn.
START, NEXT, ACCEPT = 0, np.array([2, 2, 3, 2]), np.array([0, 10, 5, 0])
#: STATE[c][q]: state after keeping a turn of class c (s, u, a, other) in state q; -1: not allowed.
STATE = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
KEEP, REROLE, DELETE, INSERT, TRUNCATED, FAR = 0, 1, 2, 5, 5, 1 << 20
OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with planted faults, as (conv, turn, role, text, copies); a conversation's rows all dropped leave one of no copies.

    By crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``[.!?]`` away, 3 repeats it, 4
    makes it the user's. Nulls are one space there and in roles and texts.
    """
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(say(conv), F.lit(":"), say(turn)), "utf-8")) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(say(text), "[.!?]", "")).otherwise(say(text))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(say(role)).alias("role"), body.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Undamaged rows in the form that ``repair`` takes."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), say(role).alias("role"), say(text).alias("text"), F.lit(1).cast("long").alias("copies"))


def _sorted(rows: DataFrame) -> DataFrame:
    """One row for equal rows, in order; before them a head a conversation (kind 0, its gaps) and a mark at the first place of each (role, text) (kind 1).

    All three kinds are counted before they are shuffled, so neither a hot conversation nor a hot row fills a task; the order is by range.
    """
    own = rows.withColumn("hash", F.unhex(F.sha2("text", 256)))
    live = own.where("copies > 0")
    each = live.groupBy("conv", "turn", "role", "hash").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    seen = F.when(F.col("copies") > 0, F.col("turn"))
    by_turn = own.groupBy("conv", seen.alias("turn")).agg(F.lit(1).alias("one"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    head = by_turn.groupBy("conv").agg(gaps.alias("copies"))
    first = live.groupBy("conv", "role", "hash").agg(F.min(F.struct("turn")).alias("at"))
    kind = rows.schema["turn"].dataType
    out = each.select("conv", "turn", "role", "hash", F.lit(2).alias("kind"), "text", "copies")
    out = out.unionByName(head.select("conv", F.lit(None).cast(kind).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("hash"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "copies"))
    out = out.unionByName(first.select("conv", "at.turn", "role", "hash", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies")))
    order = ["conv", "turn", "role", "hash"]
    text = F.col("text")
    out = out.withColumns({"blank": ~F.coalesce(text.rlike(BLANK_FREE), F.lit(False)), "cut": ~F.coalesce(text.rlike(ENDED), F.lit(False)), "initial": F.left("role", F.lit(1))})
    return out.repartitionByRange(*order).sortWithinPartitions(*order, "kind")


_CHUNK = [
    ("part", pa.int64()), ("seq", pa.int64()), ("first", pa.bool_()), ("open", pa.bool_()), ("closed", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("begins", pa.string()), ("ends", pa.string()), ("codes", pa.binary()), ("drops", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
]
_CHUNK_SQL = "part long, seq long, first boolean, open boolean, closed boolean, gaps long, blank long, duplicate long, truncated long, illegal long, begins string, ends string, codes binary, drops array<long>, roles array<string>, texts array<string>"
LEGAL = {"su", "ua", "au"}
CLASS = {"s": 0, "u": 1, "a": 2}


class _Chunk:
    """Rows of one chunk: of those that may stay the class (plus 4 if truncated), role, text, and how many rows are deleted before each and after the last."""

    def __init__(self, conv, first: bool, open_: bool, gaps: int):
        self.conv, self.first, self.open, self.gaps = conv, first, open_, gaps  # open: the turn before it lies in another task
        self.blank = self.duplicate = self.truncated = self.illegal = self.bytes = 0
        self.begins = self.ends = None
        self.codes, self.drops, self.roles, self.texts = bytearray(), [0], [], []

    def row(self, closed: bool, part: int, seq: int) -> tuple:
        return (self.conv, part, seq, self.first, self.open, closed, self.gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.begins, self.ends, bytes(self.codes), self.drops, self.roles, self.texts)


def _chunks(rows: DataFrame, chunk: int, chunk_bytes: int) -> DataFrame:
    """Chunks of the sorted rows, partition by partition, written to the shared folder."""
    ordered = _sorted(rows).select("conv", "turn", "role", "hash", "kind", "text", "copies", "blank", "cut", "initial")
    kind = ordered.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, marked, before, done, size = TaskContext.get().partitionId(), 0, None, None, None, [], 0
        type_ = None

        def flush():
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type_), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], _CHUNK, strict=True))], names=["conv", *(n for n, _ in _CHUNK)])

        for whole in batches:
            type_ = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 512):
                for conv, turn, role, hash_, kind_, text, copies, blank, cut, initial in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns), strict=True):
                    if kind_ == 0 or now is None:
                        if now is not None:
                            done.append(now.row(True, part, seq))
                            seq, size = seq + 1, size + now.bytes
                        now, marked, before = _Chunk(conv, kind_ == 0, kind_ != 0, copies if kind_ == 0 else 0), None, None
                        if kind_ == 0:
                            continue
                    if kind_ == 1:
                        marked = (turn, role, hash_)
                        continue
                    if now.begins is None:
                        now.begins = initial
                    now.illegal += (before is not None and before + initial not in LEGAL) + copies - 1
                    before = now.ends = initial
                    if blank:
                        now.blank += copies
                        now.drops[-1] += copies
                        continue
                    fresh = marked == (turn, role, hash_)
                    now.duplicate += copies - fresh
                    if fresh:
                        if len(now.codes) >= chunk or (now.codes and now.bytes + len(text) > chunk_bytes):
                            # the new row's own figures stay with the chunk that it came to; only sums of them count
                            done.append(now.row(False, part, seq))
                            seq, size = seq + 1, size + now.bytes
                            now = _Chunk(conv, False, False, 0)
                            now.begins = now.ends = initial
                        now.truncated += cut
                        now.codes.append(CLASS.get(initial, 3) + 4 * cut)
                        now.roles.append(role)
                        now.texts.append(text)
                        now.bytes += len(text)
                        now.drops.append(0)
                    now.drops[-1] += copies - fresh
                if done and (len(done) >= 256 or size > 4 * chunk_bytes):
                    yield flush()
                    done, size = [], 0
        if now is not None:
            done.append(now.row(False, part, seq))
        if done:
            yield flush()

    return materialise(ordered.mapInArrow(run, f"conv {kind}, {_CHUNK_SQL}"), "chunks")


def _numbered(chunks: DataFrame) -> DataFrame:
    """The chunks with `n`, their number in order (neighbours differ by one), and `last`, whether the conversation ends there."""
    spark = chunks.sparkSession
    told = chunks.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("seq") == 0, F.col("first"))).alias("first")).collect()  # one row a partition
    told = sorted((r["part"], r["n"], r["first"]) for r in told)
    rows, at = [], 0
    for k, (part, n, _) in enumerate(told):
        rows.append((part, at, n - 1, k + 1 == len(told) or told[k + 1][2]))
        at += n
    places = spark.createDataFrame(rows, "part long, base long, final long, ended boolean")
    out = chunks.join(F.broadcast(places), "part")  # one row a partition
    return out.withColumns({"n": F.col("base") + F.col("seq"), "last": F.when(F.col("seq") == F.col("final"), F.col("ended")).otherwise(F.col("closed"))}).drop("part", "seq", "closed", "base", "final", "ended")


def _step(code: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs before a row of each code, given those after it (rows x 4): with the row edited at once, and with inserts before it too."""
    kind, stay = code % 4, TRUNCATED * (code // 4)
    to = STATE[kind]
    kept = np.where(to >= 0, np.take_along_axis(v, np.maximum(to, 0), 1) + KEEP, FAR)
    base = np.minimum(DELETE + v, stay[:, None] + np.minimum(kept, REROLE + v[:, NEXT]))
    return base, np.minimum(base, np.minimum(INSERT + base[:, NEXT], 2 * INSERT + base[:, NEXT[NEXT]]))


def backward(codes: list[bytes], after: np.ndarray) -> list[np.ndarray]:
    """For each chunk the cost vectors before each of its rows and after the last, from the vector after it; all chunks at once, row by row."""
    n = np.array([len(c) for c in codes])
    out = [np.zeros((len(c) + 1, 4), np.int64) for c in codes]
    width = int(n.max(initial=0))
    grid = np.zeros((len(codes), width), np.int64)  # right-aligned: all end at the same column
    for i, c in enumerate(codes):
        grid[i, width - len(c) :] = np.frombuffer(c, np.uint8)
        out[i][-1] = after[i]
    v = after.astype(np.int64)
    for k in range(width):
        on = np.flatnonzero(n > k)
        v[on] = _step(grid[on, width - 1 - k], v[on])[1]
        for i in on:
            out[i][n[i] - 1 - k] = v[i]
    return out


def trace(codes: bytes, costs: np.ndarray, state: int, last: bool) -> tuple[int, list[str]]:
    """From an entry state: the exit state and the ASCII-least edits of each row, with what is inserted before it (and after the last row, at the end)."""
    out = []
    for i, code in enumerate(codes):
        said, after = "", costs[i + 1]
        while True:
            here = costs[i][state]
            if DELETE + after[state] == here:
                said += "D"
                break
            if INSERT + costs[i][NEXT[state]] == here:
                said, state = said + "I", int(NEXT[state])
                continue
            to, stay = int(STATE[code % 4][state]), TRUNCATED * (code // 4)
            if to >= 0 and stay + after[to] == here:
                said, state = said + "K", to
            else:
                said, state = said + "R", int(NEXT[state])
            break
        out.append(said)
    tail = ""
    while last and state not in (0, 3):
        tail, state = tail + "I", int(NEXT[state])
    return state, [*out, tail]


_NAMES = {2: "user", 3: "assistant"}


def edited(codes: bytes, drops: list[int], roles: list[str], texts: list[str], costs: np.ndarray, state: int, last: bool) -> tuple[str, list[str]]:
    """A chunk's audit, and its repaired turns as role:text."""
    audit, out = [], []
    edits = trace(codes, costs, state, last)[1]
    for i, said in enumerate(edits):
        audit.append("D" * drops[i] + said)
        for c in said:
            if c == "I":
                state = int(NEXT[state])
                out.append(f"{_NAMES[state]}:")
            elif c == "K":
                state = int(STATE[codes[i] % 4][state])
                out.append(f"{roles[i]}:{texts[i]}")
            elif c == "R":
                state = int(NEXT[state])
                out.append(f"{_NAMES[state]}:{texts[i]}")
    return "".join(audit), out


def _mapped(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], list[pa.Array]], size: int = 64) -> DataFrame:
    """``df`` through ``work``, slices of ``size`` chunks at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                yield pa.RecordBatch.from_arrays(work(whole.slice(at, size)), names=names)

    return df.mapInArrow(run, schema)


def _vectors(df: DataFrame) -> DataFrame:
    """n, conv, last, codes, after -> also `before`, the normalised vector before the chunk."""

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        after = np.array(b.column("after").to_pylist(), np.int64).reshape(-1, 4)
        v = np.array([c[0] for c in backward(b.column("codes").to_pylist(), after)]).reshape(-1, 4)
        return [*(b.column(c) for c in ("n", "conv", "last", "codes", "after")), pa.array((v - v.min(1, keepdims=True)).tolist(), pa.list_(pa.int64()))]

    kind = df.schema["conv"].dataType.simpleString()
    return _mapped(df.select("n", "conv", "last", "codes", "after"), f"n long, conv {kind}, last boolean, codes binary, after array<bigint>, before array<bigint>", work)


def _fold(df: DataFrame, by: str, start: str | None, way: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Within each (conv, by), a group of FAN rows at most: without ``start`` the product of all `m`; with it each row's incoming value, from the side ``way`` (1: left, -1: right)."""
    import pandas as pd

    def product(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n", ascending=way > 0)
        m = np.array(g["m"].iloc[0])
        for x in g["m"].iloc[1:]:
            m = join(m, np.array(x))
        return pd.DataFrame({"n": [g[by].iloc[0]], "conv": [g["conv"].iloc[0]], "m": [m.tolist()]})

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n", ascending=way > 0)
        v, out = np.array(g[start].iloc[0]), []
        for x in g["m"]:
            out.append(v.tolist())
            v = join(v, np.array(x))
        return pd.DataFrame({"n": g["n"], "conv": g["conv"], "came": out})

    kind = df.schema["conv"].dataType.simpleString()
    run, schema = (product, f"n long, conv {kind}, m array<bigint>") if start is None else (spread, f"n long, conv {kind}, came array<bigint>")
    return df.groupBy("conv", by).applyInPandas(run, schema)


def scanned(df: DataFrame, first: list[int], way: int, join: Callable[[np.ndarray, np.ndarray], np.ndarray], fan: int = FAN) -> DataFrame:
    """For rows (n, conv, m), neighbours numbered by one within a conversation: `came`, what ``first`` has become when it enters each row.

    A tree: products of ``fan`` neighbours, level over level until every conversation is one node, and back. No task holds more than ``fan`` rows of a conversation.
    """
    levels = [materialise(df.select("n", "conv", "m"), "scan")]
    while True:
        up = levels[-1].withColumn("up", F.floor(F.col("n") / fan).cast("long"))
        if not up.groupBy("conv").agg((F.min("up") < F.max("up")).alias("more")).where("more").limit(1).count():
            break
        levels.append(materialise(_fold(up, "up", None, way, join), "scan"))
    came = up.select("conv", "up").distinct().withColumn("came", F.array(*[F.lit(x).cast("long") for x in first]))
    for level in reversed(levels):
        own = level.withColumn("up", F.floor(F.col("n") / fan).cast("long")).alias("a").join(came.alias("b"), F.expr("a.up = b.up and a.conv <=> b.conv")).select("a.n", "a.conv", "a.m", "a.up", F.col("came").alias("start"))
        came = _fold(own, "up", "start", way, join).withColumnRenamed("n", "up")
    return came.withColumnRenamed("up", "n")


def _chunk_matrix(codes: list[bytes]) -> list[list[int]]:
    """The min-plus matrix of each chunk: cost from each state before it to each state after it."""
    out = []
    for j in range(4):
        after = np.full((len(codes), 4), FAR, np.int64)
        after[:, j] = 0
        out.append(np.minimum(np.array([c[0] for c in backward(codes, after)]).reshape(-1, 4), FAR))
    return np.stack(out, 2).reshape(len(codes), 16).tolist()


def _joined(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """From the right: a vector (4) or matrix (16) so far, and the matrix of the chunk to its left."""
    left = m.reshape(4, 4)
    if v.size == 4:
        out = (left + v[None, :]).min(1)
    else:
        out = (left[:, :, None] + v.reshape(4, 4)[None, :, :]).min(1)
    return np.minimum(out - out.min(), FAR).ravel()


def _composed(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """From the left: a state (1) or map of states (4) so far, and the map of the chunk to its right."""
    return m[v]


def converged(parts: DataFrame, passes: int = PASSES, fan: int = FAN) -> DataFrame:
    """n, conv, after: the normalised vector after each chunk (n, conv, last, codes) of the conversations of several chunks."""
    told = F.array(*[F.lit(int(x)).cast("long") for x in ACCEPT])
    now = materialise(_vectors(parts.withColumn("after", told)), "vectors")
    for _ in range(passes):
        follow = now.select((F.col("n") - 1).alias("n"), F.col("before").alias("want"))
        own = now.join(follow, "n", "left").withColumn("want", F.when(F.col("last"), told).otherwise(F.col("want"))).withColumn("open", F.col("want") != F.col("after"))
        own = materialise(own, "fix")
        if not own.where("open").limit(1).count():
            return now.select("n", "conv", "after")
        redone = _vectors(own.where("open").select("n", "conv", "last", "codes", F.col("want").alias("after")))
        now = materialise(own.where("not open").select(*now.columns).unionByName(redone), "vectors")
    follow = now.select((F.col("n") - 1).alias("n"), F.col("before").alias("want"))
    own = now.join(follow, "n", "left").where(~F.col("last") & (F.col("want") != F.col("after")))
    left = materialise(own.select(F.col("conv").alias("c")).distinct(), "open")
    settled = now.join(left, F.col("conv").eqNullSafe(F.col("c")), "left_anti").select("n", "conv", "after")
    rest = now.join(left, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    if not left.limit(1).count():
        return settled
    kind = now.schema["conv"].dataType.simpleString()
    maps = _mapped(rest.select("n", "conv", "codes"), f"n long, conv {kind}, m array<bigint>", lambda b: [b.column("n"), b.column("conv"), pa.array(_chunk_matrix(b.column("codes").to_pylist()), pa.list_(pa.int64()))])
    return settled.unionByName(scanned(maps, [int(x) for x in ACCEPT], -1, _joined, fan).select("n", "conv", F.col("came").alias("after")))


_PIECE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, begins string, ends string, first boolean, open boolean, n long"


def _edited(b: pa.RecordBatch) -> tuple[list[list], list[list[str]]]:
    """Of each chunk, its columns of _PIECE, and its repaired turns."""
    get = {c: b.column(c).to_pylist() for c in b.schema.names if c != "conv"}
    after = np.array(get["after"], np.int64).reshape(-1, 4)
    rows, kept = [], []
    for i, costs in enumerate(backward(get["codes"], after)):
        audit, turns_ = edited(get["codes"][i], get["drops"][i], get["roles"][i], get["texts"][i], costs, get["entry"][i], get["last"][i])
        cost = DELETE * sum(get["drops"][i]) + int(costs[0][START] if get["first"][i] else costs[0].min())
        rows.append([get["gaps"][i], get["blank"][i], get["duplicate"][i], get["truncated"][i], get["illegal"][i], cost, audit, get["begins"][i], get["ends"][i], get["first"][i], get["open"][i], get["n"][i]])
        kept.append(turns_)
    return rows, kept


def repair(rows: DataFrame, conv: str = "conv_id", chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES, passes: int = PASSES, fan: int = FAN, texts: bool = False) -> DataFrame:
    """One row a conversation: ``conv``, the counts of faults, cost, audit and digest; with ``texts`` also `repaired`, its turns as an array of role:text.

    ``rows`` as ``damage`` or ``turns`` makes them.
    """
    chunks = _numbered(_chunks(rows, chunk, chunk_bytes))
    kind = chunks.schema["conv"].dataType.simpleString()
    accept = F.array(*[F.lit(int(x)).cast("long") for x in ACCEPT])
    more = ", repaired array<string>" if texts else ""
    sha = lambda turns_: hashlib.sha256("\n".join(turns_).encode("utf-8", "surrogatepass")).hexdigest()
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def alone(b: pa.RecordBatch) -> list[pa.Array]:
        made, kept = _edited(b)
        columns = list(zip(*made, strict=True))[:7] if made else [[]] * 7
        out = [b.column("conv"), *(pa.array(c, types[f.split()[1]]) for c, f in zip(columns, OUT.split(", "), strict=False)), pa.array([sha(k) for k in kept], pa.string())]
        return [*out, pa.array(kept, pa.list_(pa.string()))] if texts else out

    single = _mapped(chunks.where("first and last").withColumns({"after": accept, "entry": F.lit(START)}), f"conv {kind}, {OUT}{more}", alone)
    many = chunks.where("not (first and last)")
    if not many.limit(1).count():
        return single.withColumnRenamed("conv", conv)
    parts = materialise(many.select("n", "conv", "last", "codes"), "parts")
    ends = materialise(converged(parts, passes, fan), "ends")

    def exits(b: pa.RecordBatch) -> list[pa.Array]:
        after = np.array(b.column("after").to_pylist(), np.int64).reshape(-1, 4)
        codes = b.column("codes").to_pylist()
        made = [[trace(c, costs, q, False)[0] for q in range(4)] for c, costs in zip(codes, backward(codes, after), strict=True)]
        return [b.column("n"), b.column("conv"), pa.array(made, pa.list_(pa.int64()))]

    maps = _mapped(parts.join(ends.select("n", "after"), "n").select("n", "conv", "codes", "after"), f"n long, conv {kind}, m array<bigint>", exits)
    entries = scanned(maps, [START], 1, _composed, fan).select("n", F.col("came")[0].cast("int").alias("entry"))

    def pieces(b: pa.RecordBatch) -> list[pa.Array]:
        made, kept = _edited(b)
        columns = list(zip(*made, strict=True)) if made else [[]] * 12
        return [b.column("conv"), *(pa.array(c, types[f.split()[1]]) for c, f in zip(columns, _PIECE.split(", "), strict=True)), pa.array(kept, pa.list_(pa.string()))]

    traced = _mapped(many.join(ends.select("n", "after"), "n").join(entries, "n"), f"conv {kind}, {_PIECE}, kept array<string>", pieces, 8)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of whole conversations in order: sums, audits joined, texts hashed as they pass."""
        now, type_ = None, None

        def told(x: dict) -> pa.RecordBatch:
            out = [pa.array([x["conv"]], type_), *(pa.array([x["sums"][k]], pa.int64()) for k in range(6)), pa.array(["".join(x["audit"])]), pa.array([x["sha"].hexdigest()])]
            return pa.RecordBatch.from_arrays([*out, pa.array([x["kept"]], pa.list_(pa.string()))] if texts else out, names=["conv", *(f.split()[0] for f in (OUT + more).split(", "))])

        for whole in batches:
            type_ = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 8):
                for r in whole.slice(at, 8).to_pylist():
                    if r["first"]:
                        if now is not None:
                            yield told(now)
                        now = {"conv": r["conv"], "sums": [0] * 6, "audit": [], "sha": hashlib.sha256(), "kept": [], "any": False, "ends": None}
                    for k, c in enumerate(("gaps", "blank", "duplicate", "truncated", "illegal", "cost")):
                        now["sums"][k] += r[c]
                    if r["begins"] is not None:
                        now["sums"][4] += now["ends"] is not None and r["open"] and now["ends"] + r["begins"] not in LEGAL
                        now["ends"] = r["ends"]
                    now["audit"].append(r["audit"])
                    if r["kept"]:
                        now["sha"].update((("\n" if now["any"] else "") + "\n".join(r["kept"])).encode("utf-8", "surrogatepass"))
                        now["any"] = True
                        if texts:
                            now["kept"] += r["kept"]
        if now is not None:
            yield told(now)

    whole = traced.repartition("conv").sortWithinPartitions("conv", "n").mapInArrow(stitch, f"conv {kind}, {OUT}{more}")
    return single.unionByName(whole).withColumnRenamed("conv", conv)
