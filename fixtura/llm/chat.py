"""Chat formatting from an event log.

A log row is an event of a message of a conversation: `start` (role, perhaps first text), `delta` (text to append), `edit`
(the message's text is now this) or `regenerate` (the message starts anew, and messages that began after it and before this
event go). Events are folded message by message: those since the last edit or regeneration, in the order of ``seq``,
joined. So a conversation of any length is folded in parallel; only its rendered text is one row, as it must be.

Template: each turn is OPEN role newline text CLOSE newline. Inside roles and texts every control string gets a backslash after
its first character (one more, if backslashes follow already), so no control string remains and the way back is exact; a
backslash or newline in a role is written as two characters. The loss mask is the assistant texts' code points.

Null texts and roles count as empty. Ties of ``seq`` are ordered by role, text, then message. Null conversation keys are one
conversation. An empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, DELTA = "<|im_start|>", "<|im_end|>", 512
# Control strings of common templates; each is a bracket and a rest.
_CONTROL = re.compile(r"([<\[])(\\*)(?=\||/?s>|(?:bos|eos|unk|pad|mask|start_of_turn|end_of_turn)>|/?INST\]|/?SYS\]|/?SYS>>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=\||/?s>|(?:bos|eos|unk|pad|mask|start_of_turn|end_of_turn)>|/?INST\]|/?SYS\]|/?SYS>>)")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def log(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = DELTA) -> DataFrame:
    """The event log of a table of finished turns: each starts, then streams its text in deltas of ``size`` code points."""
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("msg"))
    body = F.expr(f"if(text = '', array(), transform(sequence(0, (length(text) - 1) div {size}), i -> named_struct('at', cast(i + 1 as int), 'kind', 'delta', 'role', cast(null as string), 'text', substring(text, i * {size} + 1, {size}))))")
    first = F.expr("array(named_struct('at', 0, 'kind', 'start', 'role', role, 'text', cast(null as string)))")
    events = own.select("conv", "msg", "turn", F.explode(F.concat(first, body)).alias("e"))
    return events.select("conv", F.struct("turn", F.col("e.at").alias("at")).alias("seq"), "msg", F.col("e.kind").alias("kind"), F.col("e.role").alias("role"), F.col("e.text").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages of a log (conv, seq, msg, kind, role, text): conv, begin, msg, role, text."""
    again = F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))
    each = events.groupBy("conv", "msg").agg(
        F.min("seq").alias("begin"),
        F.max(again).alias("since"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("redone"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("events"),
    )
    text = F.array_join(F.transform(F.filter("events", lambda e: F.col("since").isNull() | (e["seq"] >= F.col("since"))), lambda e: F.coalesce(e["text"], F.lit(""))), "")
    messages = each.select("conv", "msg", "begin", "redone", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    redone = messages.where("redone is not null").groupBy("conv").agg(F.collect_list(F.struct("begin", "redone")).alias("spans")).withColumnRenamed("conv", "of")
    gone = F.coalesce(F.exists("spans", lambda s: (s["begin"] < F.col("begin")) & (F.col("begin") < s["redone"])), F.lit(False))
    return messages.join(redone, F.col("conv").eqNullSafe(F.col("of")), "left").where(~gone).select("conv", "begin", "msg", "role", "text")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the loss mask as (start, end) code points in it."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role == "assistant":
            mask.append((at, at + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(body) + len(CLOSE) + 1
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def conversations(events: DataFrame) -> DataFrame:
    """One row a conversation: conv, formatted, mask (array of (start, end))."""
    turns = F.array_sort(F.collect_list(F.struct("begin", "role", "text", "msg")))
    gathered = fold(events).groupBy("conv").agg(turns.alias("turns")).select("conv", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
                mask = pa.array([[{"start": a, "end": b} for a, b in m] for _, m in made], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in made], pa.string()), mask], names=["conv", "formatted", "mask"])

    return gathered.mapInArrow(run, f"conv {gathered.schema['conv'].dataType.simpleString()}, formatted string, mask array<struct<start:int,end:int>>")


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Read back from the formatted text: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(k, 256), []
                for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    turns, seen, lost, n = parse(text), hashlib.sha256(), hashlib.sha256(), 0
                    for role, said in turns:
                        seen.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    for s in mask:
                        said = unescape(text[s["start"] : s["end"]])
                        n += len(said)
                        lost.update(said.encode("utf-8", "surrogatepass"))
                    rows.append((len(turns), seen.hexdigest(), n, lost.hexdigest(), len(text)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c)) for c in columns)], names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv"].dataType.simpleString()
    return formatted.select("conv", "formatted", "mask").mapInArrow(run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
