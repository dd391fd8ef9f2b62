import random

import pytest

from fixtura.llm import decontam
from fixtura.llm.queries import op10_decontamination

from .helpers import ODD, clashing, docs


def brute(texts, items, k=5):
    cut = lambda t: (lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) > k else {tuple(w)} if w else set())((t or "").lower().encode().split())
    want = {i: cut(t) for i, t in items}
    own = {d: cut(t) for d, t in texts}
    return {(d, i): round(len(w & s) / len(w), 6) for d, s in own.items() for i, w in want.items() if w and len(w & s) >= 0.8 * len(w)}


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, name):
    sf = f"/root/testdata/{name}"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in op10_decontamination(spark, sf).collect()}
    assert got == brute(texts, items)


def test_recall_of_edited_items_in_long_documents(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 8, 12, 20, 33, 64, 65, 130, 300] * 4)]
    texts = []
    for d in range(160):
        i, text = items[d % len(items)]
        words = text.split()
        if len(words) >= 30:
            for at in rng.sample(range(len(words)), len(words) // 40 + 1):
                words[at] = word().upper()
        texts.append((d, " ".join([word() for _ in range(rng.randint(0, 3000))] + words + [word() for _ in range(rng.randint(0, 2000))])))
    want = brute(texts, items)
    table, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["containment"], 6) for r in decontam.pairs(table, bench).collect()}
    assert got == want and len(want) > 100
    parts = {(r["doc_id"], r["item_id"]) for d in [decontam.find(table, bench, most=4000)] for r in d.selectExpr("doc_id", "explode(leaks.item) as item_id").collect()}
    assert parts == set(want)  # items in several parts


def test_odd_rows(spark):
    table = clashing(docs(spark, [*ODD, (40, "Plain WORDS in a row that say nothing much at all"), (41, "two words"), (42, "more than two words of it")]))
    bench = spark.createDataFrame([(1, "plain words in a row that say nothing much at all"), (2, None), (3, ""), (4, "two words"), (None, "plain words in a row that say nothing much at all"), (1, "plain words in a row that say nothing much at all")], "item_id long, text string")
    found = decontam.find(table, bench, out="hits")
    by = {r["doc_id"]: sorted((h["item"] or -1) for h in r["hits"]) for r in found.collect()}
    assert by[6] == by[40] == [-1, 1, 1] and by[41] == by[42] == [4] and not by[1] and not by[2]
    kept = decontam.clean(table, bench)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, None}
    assert decontam.clean(table, bench.limit(0)).count() == table.count()
    assert decontam.pairs(docs(spark, []), bench).collect() == []
