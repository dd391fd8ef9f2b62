import functools
import hashlib
import random
import re

import duckdb
import pytest

from fixtura.llm import repair
from fixtura.llm.queries import oracle_sql, op11_structure_repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired")
NEXT, NAME = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def plain(rows):
    """A conversation's result by trying every edit; the least (cost, audit) wins."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    told, seen = [], set()
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        told.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))

    @functools.lru_cache(None)
    def best(i, q, inserted):
        options = []
        if i == len(rows):
            options += [(0, "", ())] * (q in (0, 3))
        else:
            _, role, text = rows[i]
            c, a, o = best(i + 1, q, 0)
            options.append((c + 2, "D" + a, o))
            if told[i] in ("", "t"):
                more, to = 5 * (told[i] == "t"), KEPT.get(role[:1], {}).get(q)
                if to is not None:
                    c, a, o = best(i + 1, to, 0)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                c, a, o = best(i + 1, NEXT[q], 0)
                options.append((c + more + 1, "R" + a, (f"{NAME[NEXT[q]]}:{text}", *o)))
        if inserted < 3:
            c, a, o = best(i, NEXT[q], inserted + 1)
            options.append((c + 5, "I" + a, (f"{NAME[NEXT[q]]}:", *o)))
        return min(options) if options else (10**9, "~", ())

    cost, audit, out = best(0, 0, 0)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, told.count("b"), told.count("d"), told.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), list(out))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    out = []
    for c in range(25):
        n = draw.choice([1, 2, 3, 5, 9, 25])
        for t in range(n):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            out.append((c, draw.choice([t, t, t, draw.randrange(n), None]), role, draw.choice(["a.", "b", "c?", " ", None, f"x{t}.", f"y{t}!\n", f"z{t}", f"w{t}. "])))
    out += [(100, t, "user", f"only {t}.") for t in range(60)]  # does not converge: each chunk passes on what follows it
    out += [(101, t, draw.choice(["user", "assistant"]), f"any {t}.") for t in range(60)]
    out += [(102, 5, "user", "same.")] * 12 + [(None, 1, "user", "hi."), (None, 2, "assistant", "ho.")]
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3, "fan": 3, "passes": 1}])
def test_against_every_edit(spark, rows, sizes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(repair.turns(df), texts=True, **sizes).collect()}
    assert got == {c: plain([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_vectors_converge_in_chunks_of_mixed_rows(spark):
    """Two vectors behind the same rows become equal but for a constant; behind user rows only they need not."""
    import numpy as np

    mixed, after = bytes([1, 2] * 20), np.array([[0, 10, 5, 0], [9, 3, 0, 7]])
    a, b = (v[0] for v in repair.backward([mixed, mixed], after))
    assert len(set(a - b)) == 1


def test_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    df = op11_structure_repair(spark, sf)
    want = con.sql(oracle_sql()["op11_structure_repair"])
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damage(empty)).collect() == []
    # every turn of a conversation dropped: the conversation stays, with zeros
    dropped = next(t for t in range(1000) if __import__("zlib").crc32(f"7:{t}".encode()) % 20 == 0)
    gone = repair.repair(repair.damage(spark.createDataFrame([(7, dropped, "user", "x.")], SCHEMA).selectExpr("*", "7 AS hash", "'z' AS copies"))).first()
    assert tuple(gone) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long = repair.repair(repair.turns(spark.createDataFrame([(1, 0, "user", "w " * 400_000 + "."), (1, 1, "assistant", "v" * 1_500_000 + "!")], SCHEMA))).first()
    assert long["audit"] == "KK" and long["cost"] == 0
