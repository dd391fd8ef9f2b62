import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from fixtura.llm import pii
from fixtura.llm.queries import op8_pii

from .helpers import ODD, clashing, docs

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= sum(c.isdigit() for c in s) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c.isdigit() for c in s) <= 15),
}


def plain(text):
    return [(k, m.start(), m.end()) for k, (p, good) in PLAIN.items() for m in re.finditer(p, text) if good(m[0])]


CASES = ["", "a@b.co", "x@@y.z@b.co.uk.", "a@b a@b.c@d.e@f.g", ".@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 1", "4111111111111111 4111111111111111", "+1 (269) 555-3296", "+1+22 333 44 55 66.", "+123456789012345678", "tel +49 30 1234567) and a%b@c.d-", "1111 2222  3333", "00000000000000"]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_stay_linear():
    for text in ("9" * 200_000, "9." * 100_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "@" * 200_000, "+9" * 100_000, "a.b" * 60_000 + "@x"):
        pii.base_spans(text)


def test_query_against_the_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = secrets = 0
    for r in op8_pii(spark, sf).collect():
        text = texts[r["doc_id"]]
        want = plain(text)
        said = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
        all_ = r["spans"].split(",") if r["spans"] else []
        assert set(said) <= set(all_)  # base spans stay
        for k, a, b in (s.split(":") for s in all_ if s not in said):  # of clean documents nothing but credentials is taken
            assert k == "secret" and re.search(r'(?i)token = "$', text[: int(a)]) and re.fullmatch("[0-9a-fA-F]{40}", text[int(a) : int(b)])
            secrets += 1
        found += len(want)
    assert found > 50 and secrets == sum(len(re.findall('(?i)token = "[0-9a-f]{40}"', t)) for t in texts.values()) > 5


@pytest.fixture(scope="module")
def model(spark):
    """The field of the table of 10,000 documents."""
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def planted(kind, rng):
    """A text with a value, a near miss of it far away, and a stranger of the near miss's form."""
    words = lambda n: " ".join(rng.choice("the of and stand then other words more line house tree".split()) for _ in range(n))
    d = "".join(rng.choice("0123456789") for _ in range(16))
    if kind == "typo":
        value = next(v for x in range(10) if pii.luhn(v := d[:15] + str(x)))
        at = rng.randrange(16)
        miss, stranger, label = value[:at] + str((int(value[at]) + 1) % 10) + value[at + 1 :], "".join(rng.sample(d, 16)), "card"
        stranger = stranger if not pii.luhn(stranger) else stranger[:15] + str((int(stranger[15]) + 1) % 10)
    elif kind == "digits":
        value = f"+1 ({d[:3]}) {d[3:6]}-{d[6:10]}"
        miss, stranger, label = rng.choice([d[:10], "1" + d[:10], f"({d[:3]}) {d[3:6]}-{d[6:10]}", f"{d[:3]}-{d[3:6]}-{d[6:10]}"]), d[5:15], "phone"
    elif kind == "local":
        value, miss, stranger, label = f"user.{d[:3]}@mail.example.com", f"user.{d[:3]}", f"abcd.{d[3:6]}", "email"
    else:  # no base span at all: the shapes of a chain
        value, miss, stranger, label = "word", f"+1 ({d[:3]}) 555-{d[:4]} 190.137.22.1{d[:2]}", d[:2], "phone"
    return f"{words(20)} {value} {words(40)} {miss}. {words(15)} {stranger} {words(5)}", miss, label


@pytest.mark.parametrize("kind", ["typo", "digits", "local", "chain"])
def test_recall_and_precision_on_near_misses(model, kind):
    rng, hit, wrong, n = random.Random(9), 0, 0, 100
    for _ in range(n):
        text, miss, label = planted(kind, rng)
        at = text.index(miss + ".")
        added = pii.added_spans(text, pii.base_spans(text), model)
        good = [a for a in added if a[0] == label and at <= a[1] and a[2] <= at + len(miss)]
        hit += bool(good)
        wrong += len(added) - len(good)
    assert hit >= 0.9 * n and wrong <= 0.02 * n


def test_every_part_of_the_field_finds_something(model):
    rng, none = random.Random(3), pii.Field(model.unary * 0, model.chain * 0, model.skip)
    cases = [planted(kind, rng)[0] for kind in ("typo", "digits", "local", "chain") for _ in range(30)]
    total = lambda m: sum(len(pii.added_spans(t, pii.base_spans(t), m)) for t in cases)
    no_skip = pii.Field(model.unary, model.chain, model.skip * 0)
    assert total(model) > 100 and total(none) < 0.9 * total(model) and total(no_skip) < 0.5 * total(model)
    number = " 5927243074273352 of words"
    assert pii.added_spans("in" + number * 9, [], model) == []  # a repeated number is no likelier to be a card
    assert pii.added_spans("nothing here 12 12 12 anna.k77 anna.k77", [], model) == []


def test_fit_is_the_same_in_any_order():
    texts = [f"write to user{i}.name{i}@mail{i % 7}.example.com or +1 (269) 555-{1000 + i} about order {i} of {2000 + i % 20}" for i in range(40)]
    a, b = pii.fit(texts), pii.fit(texts[::-1] + texts[:3])
    assert (a.unary == b.unary).all() and (a.chain == b.chain).all() and (a.skip == b.skip).all()
    assert pii.added_spans("a 12345 b@", [], pii.fit([])) == []


def test_long_texts_teach_too(spark):
    long = "plain words " * 4000
    rows = [(i, f"{long} mail user{i}.n@mail{i}.example.com or +1 (269) 555-{1000 + i} {long}") for i in range(12)]
    model = pii.train(docs(spark, rows + rows[:3]))
    assert np.abs(model.unary).max() > 1
    assert all(len(pii.surroundings(t, pii.base_spans(t))) <= pii.WINDOW and "user" in pii.surroundings(t, pii.base_spans(t)) for _, t in rows)


@pytest.mark.parametrize("edges", [([(0, 1)], [(1, 2, 0)]), ([(0, 1), (1, 2)], []), ([], [(0, 1, 1), (0, 2, 0)])])
def test_field_agrees_with_enumeration_on_small_trees(edges):
    rng, k = np.random.default_rng(0), len(pii.LABELS) + 1
    field = pii.Field(rng.normal(size=(pii.FEATURES, k)) * 0.3, rng.normal(size=(k, k)) * 0.3, np.array([0.8, 0.5]))
    g = pii.Graph([(0, 1)] * 3, rng.normal(size=(3, pii.FEATURES)), np.array([-1, 2, -1]), *edges, np.array([1, 1, 0.5]))
    local = g.x @ field.unary * g.share[:, None]
    local[1] = np.where(np.arange(k) == 2, 0, -30.0)
    total = np.zeros((3, k))
    for y in itertools.product(range(k), repeat=3):
        p = np.exp(sum(local[i, y[i]] for i in range(3)) + sum(field.chain[y[a], y[b]] for a, b in g.near) + sum(field.skip[s] * (y[a] == y[b]) for a, b, s in g.far))
        for i in range(3):
            total[i, y[i]] += p
    assert np.allclose(field.beliefs(g, rounds=60), total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_redact_and_odd_rows(spark):
    table = clashing(docs(spark, [*ODD, (30, "a@b.co and 10.0.0.1, again a@b.co"), (31, "+1 (269) 555-3296x")]))
    model = pii.train(table)
    out = pii.redact(table, model)
    assert out.columns == table.columns
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[30]["text"] == "[EMAIL] and [IP], again [EMAIL]" and by[30]["n_chars"] == len(by[30]["text"])
    assert by[31]["text"] == "[PHONE]x" and by[1]["text"] is None and by[2]["text"] == ""
    assert pii.find(table, model, out="s").count() == len(ODD) + 2
    assert pii.redact(docs(spark, []), pii.train(docs(spark, []))).collect() == []


def test_credentials_that_no_keyword_names(spark):
    """The keyword hidden, the shape still tells; said again without any mark, only the skip edge does."""
    import numpy as np

    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").collect()]
    known = [t for t in texts if pii.base_spans(t) + pii.seeds(t)]
    model = pii.fit([pii.surroundings(t, pii.base_spans(t) + pii.seeds(t)) for t in known])
    bare = pii.Field(model.unary, model.chain, np.zeros(2))
    hidden = again = alone = n = 0
    for t in known:
        m = next((m for m in pii.SEED.finditer(t) if pii._DIGIT.search(m[1])), None)
        if m is None or len(t) > 6000:
            continue
        n += 1
        masked = f"{t[: m.start()]}item = {t[m.start(1) :]}"
        at = m.start() + len("item = ")
        hidden += any(k == "secret" and a <= at < b for k, a, b in pii.added_spans(masked, pii.base_spans(masked), model))
        longer = f"{t}\nlater on the same one {m[1]} was seen again by them"
        for field, told in ((model, 1), (bare, 0)):
            got = any(k == "secret" and a >= len(t) for k, a, b in pii.added_spans(longer, pii.base_spans(longer), field))
            again, alone = again + got * told, alone + got * (1 - told)
    assert n >= 8 and hidden >= 0.9 * n and again >= 0.9 * n and alone <= 0.1 * n
