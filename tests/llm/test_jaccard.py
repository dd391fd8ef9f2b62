import random

import pytest

from fixtura.llm import jaccard

from .helpers import ODD, docs

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text, k=5):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute(texts):
    """The least key of each key's component, by all pairs."""
    own, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in own:
        for j in own:
            if i < j and 10 * min(len(own[i]), len(own[j])) >= 8 * max(len(own[i]), len(own[j])) and 10 * len(own[i] & own[j]) >= 8 * len(own[i] | own[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in texts}


def family(seed):
    rng = random.Random(seed)
    texts = {}
    for base in range(25):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([20, 60, 120, 300]))]
        for _ in range(6):
            texts[len(texts)] = " ".join(words)
            for _ in range(rng.choice([1, 1, 2, 3])):
                words = [*words]
                words[rng.randrange(len(words))] = f"W{rng.randint(0, 10**6)}"
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    texts = family(seed)
    want = brute(texts)
    assert len(texts) > len(set(want.values())) > 25
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs(spark, list(texts.items()))).collect()}
    assert got == want


def test_stage_drops_near_copies_many_bits_apart(spark, tmp_path):
    from .test_simhash import plain

    texts = family(3)
    want = brute(texts)
    assert any(want[i] != i and bin(plain(texts[i]) ^ plain(texts[want[i]])).count("1") > 4 for i in texts)
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, list(texts.items())), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_odd_rows(spark):
    got = jaccard.near_duplicates(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, None: None, 7: 7, 8: 8}
    assert jaccard.near_duplicates(docs(spark, [])).collect() == []


def test_large_buckets_are_spanned_in_one_task_or_in_blocks(spark, monkeypatch):
    """Copies of one text, edited so that most are alike to the text, but not to each other."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = {0: " ".join(base)}
    for i in range(1, 70):
        words = list(base)
        for at in rng.sample(range(200), rng.randint(2, 6)):
            words[at] = f"x{rng.randint(0, 10**6)}"
        texts[1000 - i] = " ".join(words)
    want = brute(texts)
    assert 1 < len(set(want.values())) < 40
    for elements in (1 << 21, 2_000):
        monkeypatch.setattr(jaccard, "ELEMENTS", elements)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs(spark, list(texts.items()))).collect()}
        assert got == want


def bits_apart(a, b):
    """Differing bits of two texts' 64-bit fingerprints of five-word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    out = 0
    for text in (a, b):
        words = text.encode().lower().split()
        hashes = [xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)]
        out ^= sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))
    return out.bit_count()


def test_simhash_links_near_copies_that_share_no_bucket(spark):
    """Without MinHash values all links are those of fingerprints within BITS, and each is verified."""
    from pyspark.sql import functions as F

    texts = family(4)
    pairs = {(i, j): bits_apart(texts[i], texts[j]) for i in texts for j in range(i) if i // 6 == j // 6}
    own = docs(spark, list(texts.items())).select(F.col("doc_id").alias("node"), F.col("doc_id").alias("at"), "text")
    nodes = jaccard.sets(own).drop("text").withColumn("bands", F.array().cast("array<bigint>"))
    told = {(max(r), min(r)) for r in jaccard.candidates(nodes).collect()}
    assert all(pairs[p] <= jaccard.BITS for p in told) and any(pairs[p] > 4 for p in told)
    alike = {p for p in told if 10 * len(shingles(texts[p[0]]) & shingles(texts[p[1]])) >= 8 * len(shingles(texts[p[0]]) | shingles(texts[p[1]]))}
    assert alike and alike != told
    assert {(max(r), min(r)) for r in jaccard.links(nodes, own.select("at", "text")).collect()} == alike
    # a pair within the bits is a candidate or joined by candidates
    reach = {i: {i} for i in texts}
    for a, b in told:
        both = reach[a] | reach[b]
        for i in both:
            reach[i] = both
    assert all(j in reach[i] for (i, j), apart in pairs.items() if apart <= jaccard.BITS)
