from collections import Counter

import numpy as np
import pytest

from matchloom.llm import bag_minhash as bm
from matchloom.llm import shingles as sh
from matchloom.llm.components import connected_components
from matchloom.llm.registry import table
from tests.llm.helpers import awkward, empty

SF = "/root/testdata/sf0.001"


def bag_of(text):
    words = (text or "").lower().encode().split()
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows, least=0.8):
    """(doc_id, text) rows to {doc_id: class_id}."""
    texts = sorted({t for _, t in rows if t is not None})
    bags = [bag_of(t) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = {}
    for i, b in enumerate(bags):
        for s in b:
            holders.setdefault(s, set()).add(i)
    met = {(i, j) for group in holders.values() for i in group for j in group if i < j}
    for i, j in met:
        if similarity(bags[i], bags[j]) >= least:
            top[find(i)] = find(j)
    classes = {}
    for doc, t in rows:
        if t is not None:
            classes.setdefault(find(texts.index(t)), []).append(doc)
    named = {doc: min(group) for group in classes.values() for doc in group}
    return named | {doc: doc for doc, t in rows if t is None}


def test_bags_are_those_of_brute_force():
    texts = ["", "a", "a b", "A b c d", "a b c d e", "a b c d e a b c d e a b c d e", "x\t y\n\x0bz  w v u é É ß"]
    text, hashes, counts = sh.bags([sh.normalise(t) for t in texts])
    for i, t in enumerate(texts):
        assert sorted(counts[text == i]) == sorted(bag_of(t).values())
        again, n = sh.bag(sh.normalise(t))
        assert (again == hashes[text == i]).all() and (n == counts[text == i]).all()
    a, b = (sh.bag(sh.normalise(t)) for t in texts[4:6])
    assert abs(sh.overlap(a, b) - similarity(bag_of(texts[4]), bag_of(texts[5]))) < 1e-12


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(7)
    m, errors = 256, []
    for _ in range(40):
        names = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        b[:40] = np.where(rng.random(40) < 0.7, a[:40], b[:40])
        text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        values = bm.signatures(
            text, np.concatenate([names[a > 0], names[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m
        )
        assert (values != 0).all()
        errors.append((values[0] == values[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 4 * 0.5 / np.sqrt(m * 40)  # unbiased
    assert np.sqrt(np.mean(np.square(errors))) < 0.05


def test_signatures_do_not_depend_on_the_batch():
    texts = [sh.normalise(f"one two three four five six seven {i} eight nine ten") for i in range(20)] + [b""]
    together = bm.signatures(*sh.bags(texts), len(texts), 40)
    for i, t in enumerate(texts):
        assert (bm.signatures(*sh.bags([t]), 1, 40)[0] == together[i]).all()
    assert not together[-1].any()


def test_classes_of_given_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in bm.near_classes(docs).collect()}
    assert got == brute_classes(rows)


def chained(n):
    """Texts that each differ from the one before in a few words, so that the ends of the chain are unlike."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(n):
        rows.append((1000 + k, " ".join(words)))
        words = words.copy()
        words[(k * 2) % 100] = f"new{k}"
    return rows


def test_large_buckets_lose_no_link(spark):
    base = " ".join(f"b{i}" for i in range(150))
    rows = [(1, base)] + [(2 + k, base + " " + " ".join(f"x{k}_{j}" for j in range(1 + k % 40))) for k in range(120)]
    rows += chained(30) + [(5000 + k, base) for k in range(200)] + [(9000, "quite another text of some words")]
    got = {r["doc_id"]: r["class_id"] for r in bm.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = bm.near_classes(docs).collect()
    assert len(rows) == 11
    by = {(r["doc_id"], r["key"]): r["class_id"] for r in rows}
    assert {v for (d, _), v in by.items() if d in (1, 2)} == {1}
    assert {v for (d, _), v in by.items() if d in (3, 4, 5, 8)} == {3, 4, 5, 8}
    kept = bm.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == ["1", "3", "4", "5", "7", "8", "9", "None", "None"]
    assert bm.near_classes(empty(spark)).count() == 0 and bm.keep_one(empty(spark)).count() == 0


def test_one_row_stays_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g")] * 3 + [(4, "a b c d e f g")] + [(4, "other words here")] * 2
    kept = bm.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a b c d e f g"), (4, "other words here")]


@pytest.mark.parametrize("shape", ["path", "star", "two"])
def test_components(spark, shape):
    edges = {
        "path": [(i, i + 1) for i in range(40)],
        "star": [(0, i) for i in range(1, 60)],
        "two": [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (3, 3)],
    }[shape]
    got = {r["node"]: r["part"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {"path": {i: 0 for i in range(41)}, "star": {i: 0 for i in range(60)}, "two": {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}}
    assert got == want[shape]
