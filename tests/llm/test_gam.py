import zlib

import numpy as np

from fixtura.llm import gam
from fixtura.llm.queries import op6_quality_gam

from .helpers import ODD, clashing, docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op6_quality_gam(spark, sf).collect()}
    assert len(rows) == 1000
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    told = [(r["quality"], rows[r["doc_id"]]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(y, r) for y, r in told if r["held_out"]]
    assert np.mean([y == r["predicted"] for y, r in held]) >= 0.95
    kept = [r["predicted"] for y, r in held if y]
    assert np.mean(kept) >= 0.97


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert np.mean((model.score(x) > 0.5) == y) > 0.97
    alone = gam.fit(x, y, pairs=0)
    assert np.mean((alone.score(x) > 0.5) == y) < 0.7


def test_tables_are_the_score():
    rng = np.random.default_rng(2)
    x = rng.random((500, 2))
    model = gam.fit(x, (x[:, 0] > 0.3).astype(float))
    for row in x[:20]:
        total = model.base + sum(t[int((c <= v).sum())] for c, t, v in zip(model.cuts, model.tables, row)) + sum(t[int((a <= row[i]).sum()), int((b <= row[j]).sum())] for i, j, a, b, t in model.pairs)
        assert abs(model.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_odd_rows_and_labels(spark):
    table = clashing(docs(spark, ODD))
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (99, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = gam.train(table, labels)
    got = gam.score(table, model, out="p").collect()
    assert len(got) == len(ODD) and all(0 <= r["p"] <= 1 and r["score"] == 7 for r in got)
    none = gam.train(table, labels.limit(0))
    assert {r["p"] for r in gam.score(table, none, out="p").collect()} == {0.5}
    one = gam.train(table, labels.where("quality = 1"))
    assert len({r["p"] for r in gam.score(table, one, out="p").collect()}) == 1
    assert gam.score(docs(spark, []), model).collect() == []


def test_query_scores_by_plain_sums(spark, sf):
    """Each document's score is the sum of the learned tables' entries at its features' bins."""
    from fixtura.llm.queries import quality_model

    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_model(spark, docs_, sf)
    got = {r["doc_id"]: r["score"] for r in op6_quality_gam(spark, sf).collect()}
    for r in docs_.collect():
        x = gam.features(r["text"])
        total = model.base + sum(t[sum(c <= v for c in cut)] for cut, t, v in zip(model.cuts, model.tables, x)) + sum(t[sum(c <= x[i] for c in a), sum(c <= x[j] for c in b)] for i, j, a, b, t in model.pairs)
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9
