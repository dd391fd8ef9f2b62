import hashlib

import pytest
from pyspark.sql import functions as F

from fixtura.llm import bpe
from fixtura.llm.queries import op1_byte_bpe, vocabulary

from .helpers import ODD, clashing, docs


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_ids_are_the_library_s_for_any_chunking(spark, whole):
    long = [(20 + i, t) for i, t in enumerate(["word " * 300 + "x" * 700 + " end's  \n\n  of it", "y" * 900, "a b  c   d    e" * 60, "漢字 und ß 🙂 " * 90, "   " * 400 + "z", "''s 'll've " * 80])]
    table = clashing(docs(spark, ODD + long + long[:1]))
    for chunk, overlap in ((65_536, 1024), (100, 40), (64, 64), (128, 3)):
        out = bpe.encode(table, *vocabulary(), out="ids_", chunk=chunk, overlap=overlap)
        rows = out.select("doc_id", "text", "ids_", "rank").collect()
        assert len(rows) == len(ODD) + len(long) + 1
        for r in rows:
            assert r["ids_"] == whole.encode_ordinary(r["text"] or ""), (chunk, r["doc_id"])
            assert r["rank"] == 7


def test_round_trip_and_unknown_ids(spark):
    table = docs(spark, ODD)
    path, pattern = vocabulary()
    back = bpe.decode(bpe.encode(table, path, pattern), path).select("text", "decoded").collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
    assert bpe.decode(table.limit(1).select(F.lit(None).cast("array<int>").alias("ids")), path).first()["decoded"] is None
    with pytest.raises(Exception, match="60000|out of bounds"):
        bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), path).collect()


def test_query_against_the_library(spark, sf, whole):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = whole.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op1_byte_bpe(spark, sf).collect()}
    assert got == want


def test_empty_table(spark):
    assert bpe.digests(docs(spark, []), *vocabulary()).collect() == []


def test_one_long_text_is_worked_on_by_as_many_tasks_as_cores(spark, whole):
    """A text of 10 MB: its chunks lie in all partitions, and its ids are the library's."""
    text = "".join(f"line {i} of a long text, with words and numbers like {i * 37}; " for i in range(160_000))
    table = docs(spark, [(1, text)])
    chunks = bpe.dealt(bpe.keyed(table, "text"), bpe.CHUNK, bpe.OVERLAP)
    assert len(text) > 9_000_000 and chunks.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
    ids = bpe.encode(table, *vocabulary(), keep=False).first()["ids"]
    assert ids == whole.encode_ordinary(text)
