import hashlib
import re

import pytest

from .test_decontam import brute
from .test_jaccard import brute as components
from .test_pii import plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def table(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_each_stage_against_brute_force(spark):
    from fixtura.llm.common import materialise, read

    docs, kept = read(spark, SF, "documents"), {}
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminated", "private", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table(docs)
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = after = table(docs)
        assert docs.count() == len(after)
        if name == "quality":
            told = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
            assert sum(i in after for i, q in told.items() if q) >= 0.97 * sum(told.values())
            assert sum(i in after for i, q in told.items() if not q) <= 0.1 * sum(not q for q in told.values())
        if name == "near_duplicates":
            assert set(after) == set(components({i: r["text"] for i, r in before.items()}).values())
        if name == "decontaminated":
            items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
            bad = {d for d, _ in brute([(i, r["text"]) for i, r in before.items()], items)}
            assert bad and set(after) == set(before) - bad
        if name == "private":
            assert set(after) == set(before)
            for i, r in after.items():
                assert not plain(r["text"]) and r["n_chars"] == len(r["text"])
                if not plain(before[i]["text"]):  # then nothing but credentials goes
                    text = re.sub('(?i)(token = ")[0-9a-f]{40}(?=")', r"\1[SECRET]", before[i]["text"])
                    assert r == before[i] | {"text": text, "n_chars": len(text)}
    import public_tokenizers as P
    import tiktoken

    from fixtura.llm import bpe

    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = table(corpus_pipeline.STAGES[-1][1](spark, docs, SF))
    for i, r in kept["private"].items():
        ids = whole.encode_ordinary(r["text"])
        assert (last[i]["n_tokens"], last[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(r["text"].encode()).hexdigest())
    assert table(corpus_pipeline.run(spark, SF)) == last


def test_columns_pass_and_odd_rows_survive(spark, tmp_path):
    from .helpers import ODD, clashing, docs

    clashing(docs(spark, ODD)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, str(tmp_path))
        assert out.columns == own.columns
        assert stage(spark, own.limit(0), str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 7  # one of the texts without words, one of the repeated rows
