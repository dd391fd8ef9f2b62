import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtura.llm import topk
from fixtura.llm.queries import op4_topk


def brute(rows, asks, k=5):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, qv) in enumerate(own):
        if asks(q):
            found = sorted((-sum(a * b for a, b in zip(qv, cv)), c) for m, (c, cv) in enumerate(own) if m != n)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def test_query_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op4_topk(spark, sf).collect())
    assert got == brute(rows, lambda i: i % 50 == 0)


def test_ties_repeats_nulls_and_lengths(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) for _ in range(rng.choice([6, 8, 8]))]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [None] * 8), (203, [float("nan")] * 8), (204, [float("inf")] + [0.0] * 7), (5, rows[5][1]), (5, rows[5][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "row", "asks", "score", "rank")})
    padded = [(i, v if v is None else v + [0.0] * (8 - len(v))) for i, v in rows]
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(table, F.col("vec_id") % 5 == 0).collect())
    assert got == brute(padded, lambda i: i % 5 == 0)


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    assert topk.search(spark.createDataFrame([(1, [1.0])], schema), F.lit(True)).collect() == []
    got = topk.search(spark.createDataFrame([(1, [1.0]), (2, [0.5])], schema), F.lit(True)).collect()
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 256 * 128), (2, 1, 256 * 128)]


@pytest.mark.parametrize("clustered", [False, True])
def test_best_prunes_and_stays_exact(clustered):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 64))
    if clustered:  # steps of 8 components, little else: coarse statistics tell rows apart
        x = np.repeat(rng.normal(size=(5000, 8)), 8, axis=1) + 0.02 * x
    x = np.floor(64 * x)[np.argsort(topk.place(np.floor(64 * x)))]
    q, rows, tally = x[::50], np.arange(5000), {}
    i, j, score = topk.best(q, rows[::50], x, rows, rows, 5, tally=tally)
    want = q @ x.T
    want[np.arange(100), rows[::50]] = -np.inf
    for n in range(100):
        order = np.lexsort((rows, -want[n]))[:5]
        assert j[i == n].tolist() == order.tolist() and score[i == n].tolist() == want[n][order].tolist()
    assert tally["all"] == 500_000 >= tally["envelope"] >= tally["scored"]
    if clustered:
        assert tally["scored"] < 0.02 * tally["all"]


def test_text_keys_and_large_values(spark):
    rows = [(c, [float(n), 2.0**28 * n]) for n, c in enumerate("abcde")] + [(None, [9.0, 0.0]), ("f", [3.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = topk.search(table, F.col("vec_id") == "a", k=2, scale=1).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [("a", "b", 0), ("a", "c", 0)]
    got = topk.search(table, F.col("vec_id") == "b", k=2, scale=1).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, "e", 4 + 4 * 2**56), (2, "d", 3 + 3 * 2**56)]
