import random
import re

import pytest
from xxhash import xxh64_intdigest

from fixtura.llm import simhash
from fixtura.llm.queries import op3_simhash

from .helpers import ODD, clashing, docs


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(fps, bits=4):
    """Brute force: fps by key; the smallest key of each component."""
    keys = list(fps)
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in keys}


def test_query_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {k: plain(t) for k, t in texts.items()}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in op3_simhash(spark, sf).collect()}
    want = groups(fps)
    assert got == {k: (fps[k], want[k]) for k in fps}


@pytest.mark.parametrize("chain", [1, 2, 4, 6, 9])
def test_every_pair_within_the_bits_shares_a_key_and_keeps_the_budgets(chain):
    rng, rule = random.Random(chain), simhash.Ring()
    parts, sets = simhash.ring(), simhash.equal_sets(chain=chain)
    import numpy as np

    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        seg = [(x >> a) & ((1 << (b - a)) - 1) for a, b in parts]
        starts = [s for s in range(9) if any(all(seg[(s + p) % 9] == 0 for p in places) for places in sets)]
        assert any(rule.linked(np.array([x], np.uint64), s)[0] for s in starts)
        y = sum(1 << b for b in rng.sample(range(64), 5))
        assert not any(rule.linked(np.array([y], np.uint64), s)[0] for s in range(9))


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_dense_and_chained_fingerprints(spark, block):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(260)}
    x = rng.getrandbits(64)
    for _ in range(40):  # a chain whose ends are far apart
        fps.add(x)
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = {r["node"]: r["label"] for r in simhash.components(simhash.links(nodes, block=block)).collect()}
    want = groups({s: f for f, s in signed.items()})
    assert {s: got.get(s, s) for s in signed.values()} == want


def test_odd_rows(spark):
    rows = ODD + [(9, "A" * 10 + " " + "b"), (10, "a" * 10 + " B")]
    got = simhash.near_duplicates(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fp"] == by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 1
    assert by[10]["component_id"] == by[9]["component_id"] or by[9]["fp"] != by[10]["fp"]
    assert by[None]["component_id"] is None or by[None]["component_id"] in by
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_keep_one(spark):
    rows = ODD + [(20, "same text for two rows of words"), (11, "same text for two rows of words"), (None, "same text for two rows of words")]
    table = clashing(docs(spark, rows))
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    ids = sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None))
    assert ids == [1, 4, 5, 6, 7, 8, 11] and kept.where("doc_id is null").count() == 2


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_direct_links_are_within_the_bits(spark, block):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for _ in range(200)} | {rng.getrandbits(64) for _ in range(100)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    found = simhash.links(nodes, 6, 13, block=block, direct=True).cache()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 6 for r in found.collect())
    got = {r["node"]: r["label"] for r in simhash.components(found).collect()}
    assert {s: got.get(s, s) for s in signed.values()} == groups({s: f for f, s in signed.items()}, 6)
