"""A corpus from raw documents to token ids: each stage works on all rows that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.llm import bpe, decontam, gam, jaccard, pii, simhash
from fixtura.llm.common import fresh, materialise, read
from fixtura.llm.queries import quality_model, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, trained on the labelled ones among them, does not reject. Without labels of both kinds, all."""
    model = quality_model(spark, docs, sf_dir)
    if not model.tables:
        return docs
    score = fresh(docs.columns, "score")
    return gam.score(docs, model, out=score).where(F.col(score) >= gam.CUT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash of five-word shingles, then MinHash for the rest, each link verified at a Jaccard similarity of 0.8."""
    return simhash.keep_one(docs, find=jaccard.near_duplicates)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redact(docs, pii.train(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, *vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("private", private), ("tokens", tokens)]

#: SQL can't express the stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
