import random

import duckdb
import pytest

from fixtura.llm import phrases
from fixtura.llm.queries import op12_collocations, oracle_sql

COLUMNS = "doc_id long, text string, lang string"


def plain(rows, least, first):
    """All phrases counted one by one."""
    import re
    from collections import Counter

    told, n = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        f = told.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in told.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:first])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "d", "é", "É", "x\x00y", "naïve", " ", "z"]
    out = [(i, "".join(draw.choice(words) + draw.choice([" ", " ", "\t ", ". ", ", ", "\n", "\x0b"]) for _ in range(draw.randrange(60))), draw.choice(["a", "b", None, "und"])) for i in range(120)]
    return out + [(1, None, "a"), (2, "", "c"), (3, "?!.,;:\r\n", "c"), (None, "d d d d d d", None), (4, "no break " * 4000, "long")] + [(5, "one and the same text", "a")] * 40


@pytest.mark.parametrize("block", [1 << 21, 200])
def test_against_plain_counting(spark, rows, block):
    got = phrases.collocations(spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS block", "'q' AS a").repartition(6), least=7, first=30, block=block)
    assert sorted(map(tuple, got.collect())) == plain(rows, 7, 30)


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = op12_collocations(spark, sf)
    want = con.sql(oracle_sql()["op12_collocations"])
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("k", [1, 2])
def test_one_shuffle_serves_the_count_and_the_semi_join(spark, rows, monkeypatch, k):
    """A level's groups are made once, shuffled once and counted where they lie."""
    level = spark.createDataFrame([], phrases._PACKED)
    monkeypatch.setattr(phrases, "materialise", lambda df, name: df)
    plan = phrases._frequent(level, k, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], COLUMNS)).collect() == []
