import random
import re
from collections import Counter

import pytest

from fixtura.llm import suffix
from fixtura.llm.queries import op7_suffix_array

from .helpers import ODD, clashing, docs


def brute(texts, least=50, across=False):
    """Unions of the runs of ``least`` words that occur more than once, or in two texts, by place in the list."""
    words = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    runs = [[tuple(texts[i][a:b] for a, b in w[j : j + least]) for j in range(len(w) - least + 1)] for i, w in enumerate(words)]
    seen = Counter(r for own in runs for r in (set(own) if across else own))
    out = []
    for i, own in enumerate(runs):
        spans = []
        for j, r in enumerate(own):
            if seen[r] > 1:
                a, b = words[i][j][0], words[i][j + least - 1][1]
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
        out.append([tuple(s) for s in spans])
    return out


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: ",".join(f"{a}:{b}" for a, b in s) for r, s in zip(rows, brute([r["text"] for r in rows], across=True)) if s}
    got = {r["doc_id"]: r["spans"] for r in op7_suffix_array(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_between_different_neighbours(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    words = lambda n: [word() for _ in range(n)]
    shared = [words(n) for n in (49, 50, 51, 60, 90, 200)]
    texts = []
    for _ in range(60):
        parts = [words(rng.randint(0, 80)), rng.choice(shared), words(rng.randint(0, 40)), rng.choice(shared)[rng.randint(0, 30) :], words(rng.randint(0, 20))]
        texts.append(rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p))
    texts += ["x " * 300, texts[0]]
    texts.append(" ".join((alone := words(70)) + words(5) + alone + words(9) + alone[:60] + shared[3]))
    for across in (False, True):
        got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix.repeats(docs(spark, list(enumerate(texts))), across=across).collect()}
        assert got == {i: s for i, s in enumerate(brute(texts, across=across)) if s}


def test_first_occurrence_stays(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = {r["doc_id"]: r for r in suffix.repeats(docs(spark, [(3, text), (1, text), (2, "before " + text)])).collect()}
    assert set(rows) == {1, 2, 3} and rows[1]["extra"] == [] and len(rows[3]["extra"]) == 1 == len(rows[2]["extra"])


def test_odd_rows(spark):
    assert suffix.repeats(clashing(docs(spark, ODD))).collect() == []
    assert suffix.repeats(docs(spark, [])).collect() == []
    text = " ".join(str(i) for i in range(120))
    got = suffix.repeats(clashing(docs(spark, [(1, text), (1, text), (None, text)]))).collect()
    assert {r["doc_id"] for r in got} == {1, None} and all([(s["start"], s["end"]) for s in r["spans"]] == [(0, len(text))] for r in got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passage_again_in_a_text_whose_context_another_shares(spark, seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    around, passage = (words(80), words(80)), words(60)
    texts = [" ".join([*around[0], *passage, *around[1], *words(70), *passage, *words(70)]), " ".join([*around[0], *passage, *around[1]])]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix.repeats(docs(spark, list(enumerate(texts))), across=True).collect()}
    assert got == dict(enumerate(brute(texts, across=True))) and len(got[0]) == 2


@pytest.mark.parametrize("across,sizes", [(False, {}), (True, {}), (True, {"piece": 5, "part": 400}), (False, {"piece": 2, "part": 50})])
def test_groups_that_reach_over_partitions(spark, across, sizes):
    """Many partitions and pieces for few rows: a hot passage is cut into several, so its groups are completed from the edges."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    hot, warm = words(56), words(70)
    texts = [" ".join([*words(rng.randint(0, 9)), *hot, *(words(12) if i % 3 else []), *(warm if i % 2 else [])]) for i in range(80)] + [" ".join(hot)] * 40 + [" ".join([*hot, *words(3), *hot])]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "29")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["doc_id"]: r for r in suffix.repeats(docs(spark, list(enumerate(texts))), across=across, **sizes).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {i: [(s["start"], s["end"]) for s in r["spans"]] for i, r in got.items()} == {i: s for i, s in enumerate(brute(texts, across=across)) if s}
    assert sum(r["extra"] == [] for r in got.values()) == 1


def test_text_keys(spark):
    text = " ".join(f"w{i}" for i in range(80))
    table = spark.createDataFrame([("b", text), ("a", text), (None, "x")], "doc_id string, text string")
    assert {r["doc_id"]: len(r["extra"]) for r in suffix.repeats(table, across=True).collect()} == {"a": 0, "b": 1}
