import zlib

import numpy as np
import pytest

from fixtura.llm import langid
from fixtura.llm.queries import op13_language_id


@pytest.fixture(scope="module")
def model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return langid.train(docs, sample=150)


def test_held_out_accuracy(spark, sf):
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_language_id(spark, sf).collect()
    assert len(got) == len(want) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == want[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_tables_answer_as_convolution_does(model):
    """The look-ups give what the filters give on the embedded bytes."""
    wide, _ = langid.symbols(["Où est la gare, s'il vous plaît? 12".encode() * 9])
    x = model.weights[0][wide]
    n, pooled = len(langid.WIDTHS), []
    for i, w in enumerate(langid.WIDTHS):
        seen = np.stack([np.concatenate([x[:, p + j] for j in range(w)], 1) @ model.weights[1 + i] + model.weights[1 + n + i] for p in range(langid.WINDOW)], 1)
        pooled.append(np.maximum(seen.max(1), 0))
    z = np.concatenate(pooled, 1) @ model.weights[1 + 2 * n] + model.weights[2 + 2 * n]
    e = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(langid.probabilities(model, wide, model.tables()), e / e.sum(1, keepdims=True), atol=1e-5)


def test_whole_text_counts(spark, model):
    """The language of the larger part wins, wherever it stands, also beyond one numpy pass; prediction doesn't depend on the pass's size."""
    texts = {lang: " ".join(t for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"lang = '{lang}' and length(text) > 400").select("text").limit(6).collect()) for lang in ("en", "de")}
    rows = [(1, texts["de"][:600] + texts["en"] * 9), (2, texts["en"][:600] + texts["de"] * 9), (3, texts["en"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 4)) for r in langid.predict(docs, model, group=g).collect()} for g in (1 << 12, 1 << 20))
    assert {k: v[0] for k, v in a.items()} == {1: "en", 2: "de", 3: "en"}
    assert all(abs(a[k][1] - b[k][1]) < 0.02 for k in a)


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "12345 67 !?"), (5, "漢字"), (6, "a"), (6, "a"), (None, "the words of the text are here"), (7, "½ ² §")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS lang_pred", "7 AS score", "8 AS letters")
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) and all(r["letters"] == 8 for r in got)
    assert {r["doc_id"]: r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"]} == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: True}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = langid.train(empty)
    assert langid.predict(empty, model).collect() == [] and {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    one = langid.train(spark.createDataFrame([(1, "just one", "fr"), (2, "no label", None)], "doc_id long, text string, lang string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs.where("doc_id = 6"), one).collect()} == {("fr", 1.0)}
