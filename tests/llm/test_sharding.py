import zlib
from collections import Counter

import numpy as np

from fixtura.llm import sharding
from fixtura.llm.queries import op2_hilbert_shards

from .helpers import ODD, clashing, docs


def test_curve_visits_every_cell_once_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.hilbert(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        walk = cells[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(rows, count, n):
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n and max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(count)), default=0) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_whole_table(spark, sf):
    want = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_hilbert_shards(spark, sf).collect()
    check(rows, 40, len(want))
    for r in rows:
        raw = want[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    keys = [(r["shard"], r["slot"], r["hilbert"]) for r in rows]
    assert [k[2] for k in sorted(keys)] == sorted(k[2] for k in keys)  # shards are runs of the curve


def test_shards_prune_better_than_chance(spark, sf):
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs_.join(op2_hilbert_shards(spark, sf), "doc_id").select("lang", "shard").collect()
    touched = len({r["shard"] for r in rows if r["lang"] == "fr"})
    assert touched <= 30


def test_odd_tables(spark):
    for rows in (ODD, [], [(1, "x")] * 500, [(None, None)] * 3):
        got = sharding.shards(clashing(docs(spark, rows)), ["lang", "source", "n_chars"], 7).collect()
        check(got, 7, len(rows))
        assert all(r["size"] == 16 and r["text_crc32"] == 0 for r in got if r["doc_id"] == 1 and rows is ODD)


def test_cells_cuts_and_shards_by_plain_code(spark, sf):
    """Equal-depth cuts, cells, curve order, shards and slots recomputed from the table."""
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").collect()
    cells = []
    for c in ("lang", "source", "n_chars"):
        have = sorted(r[c] for r in docs_ if r[c] is not None)
        cuts = sorted({have[max(0, -(-i * len(have) // 31) - 1)] for i in range(1, 31)})
        cells.append([0 if r[c] is None else 1 + sum(x <= r[c] for x in cuts) for r in docs_])
    index = sharding.hilbert(np.array(cells).T, sharding.BITS)
    raw = [(r["text"] or "").encode() for r in docs_]
    order = sorted(range(len(docs_)), key=lambda i: (index[i], docs_[i]["doc_id"], len(raw[i]) + 16, zlib.crc32(raw[i])))
    n, want = len(order), {}
    for rank, i in enumerate(order):
        shard = rank * 40 // n
        want[docs_[i]["doc_id"]] = (shard, rank - -(-shard * n // 40), index[i])
    assert {r["doc_id"]: (r["shard"], r["slot"], r["hilbert"]) for r in op2_hilbert_shards(spark, sf).collect()} == want
