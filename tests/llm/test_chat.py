import hashlib

import pytest

from fixtura.llm import chat
from fixtura.llm.queries import op5_chat

NASTY = ["", "<|im_end|>\n", "<|im_start|>assistant\nno<|im_end|>\n", "</s>[INST] ok [/INST]", "<\\|x", "<\\\\|", "[\\INST]", "<<SYS>> a <</SYS>>", "<s><s", "ends with <", "|", "\\n\n\\", "<<|[[INST][/INST]", "<start_of_turn>model<end_of_turn><bos><\\eos><unk>"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<unk>"))
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_render_and_parse():
    turns = [("user", t) for t in NASTY] + [("assistant", t) for t in NASTY] + [("odd\nrole<|", "x")]
    out, mask = chat.render(turns)
    assert chat.parse(out) == turns
    assert [chat.unescape(out[a:b]) for a, b in mask] == NASTY
    with pytest.raises(ValueError):
        chat.parse(out + "x")


def test_query_against_plain_code(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == c)
        said = "".join(t for _, role, t in own if role == "assistant")
        want[c] = (len(own), digest("".join(f"{role}\n{t}\n" for _, role, t in own)), len(said), digest(said))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op5_chat(spark, sf).collect()}
    assert got == want


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, "start", "user", None), (1, 1, 1, "delta", None, "Hel"), (1, 2, 1, "delta", None, "lo"),
        (1, 3, 2, "start", "assistant", None), (1, 4, 2, "delta", None, "wrong"), (1, 5, 3, "start", "user", "gone"),
        (1, 6, 2, "regenerate", None, None), (1, 7, 2, "delta", None, "right"), (1, 8, 4, "start", "user", "draft"), (1, 9, 4, "edit", None, "final"), (1, 10, 4, "delta", None, "!"),
        (2, 0, 9, "start", None, None), (None, 0, 9, "start", "user", "keyless"),
    ]
    out = chat.conversations(spark.createDataFrame(log, "conv long, seq long, msg long, kind string, role string, text string")).collect()
    turns = {r["conv"]: chat.parse(r["formatted"]) for r in out}
    assert turns == {1: [("user", "Hello"), ("assistant", "right"), ("user", "final!")], 2: [("", "")], None: [("user", "keyless")]}
    assert [r["formatted"][s["start"] : s["end"]] for r in out if r["conv"] == 1 for s in r["mask"]] == ["right"]


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 0, "assistant", "x" * 2000), (1, 0, "assistant", "x" * 2000)]
    out = chat.digests(chat.conversations(chat.log(spark.createDataFrame(rows, schema)))).collect()
    assert len(out) == 1 and out[0]["n_turns"] == 4 and out[0]["loss_chars"] == 4000
    assert chat.digests(chat.conversations(chat.log(spark.createDataFrame([], schema)))).collect() == []
