"""Ranked search over the length-stratified index against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from matchloom.llm import lexical
from tests.llm.helpers import DOC_SCHEMA, awkward, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k=10):
    """{item: [(doc, score)]} of (id, text) rows."""
    held = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(fold(t)))
    out = {}
    for item, terms in asked.items():
        rows = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms
                if c[t]
            )
            if score > 0:
                rows.append((doc, score))
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        if rows:
            out[item] = rows[:k]
    return out


def found(spark, docs, items, k=10, only=False):
    terms = lexical.query_terms(items, "item_id", "text")
    index = lexical.build(docs, only=lexical.vocabulary(terms) if only else None)
    out = {}
    for r in sorted(lexical.search(index, terms, k).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["asked"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["asked"]])
    return out


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_terms():
    for text in ("", " \t\n", "Aé-b_9 x'y[z] \x7f~ 漢字 🙂ok ÀB", "12.5kg\x00Z"):
        assert [t.decode() for t in lexical.terms_of(text.encode())] == TERM.findall(fold(text))
    assert lexical.terms_of(None) == []


@pytest.mark.parametrize("only", [False, True])
def test_awkward_rows(spark, only):
    df = awkward(spark)
    asked = [(1, "The cat SAT"), (1, "haus"), (2, None), (3, ""), (4, "nothing there"), (None, "hund"), (5, "word5 word6 of"), (1, "haus")]
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], asked)
    assert set(want) == {1, None, 5}
    assert found(spark, df, items_of(spark, asked), only=only) == want


def test_many_documents_of_few_lengths(spark, monkeypatch):
    """Strata of several blocks, ties beyond k, more queries than a pass takes."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 50)
    monkeypatch.setattr(lexical, "PASS_QUERIES", 7)
    rnd = random.Random(5)
    names = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(names, weights=range(1, 61), k=rnd.choice([3, 8, 8, 8, 40]))), None, None, None) for i in range(1_200)]
    rows += [(2_000 + i, "same text for t1 t2", None, None, None) for i in range(100)]
    asked = [(i, " ".join(rnd.choices(names, k=rnd.randint(1, 12)))) for i in range(20)] + [(99, "same text")]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    assert found(spark, docs, items_of(spark, asked), k=5) == brute([r[:2] for r in rows], asked, 5)


def test_large_weights_stay_whole_numbers():
    own = lexical._Pass(lexical.pa.array(["a"]), lexical.np.array([[3_000_000_001]], lexical.np.int64), 1)
    _, row, impact = own.impacts(lexical.pa.array(["a", "b"]), lexical.np.array([1, 1]), 10)
    assert list(row) == [0] and int((impact @ own.weights[row])[0]) == 10**9 // 1080 * 3_000_000_001


def test_empty_tables(spark):
    some = items_of(spark, [(1, "cat")])
    assert found(spark, empty(spark), some) == {}
    assert found(spark, awkward(spark), some.limit(0)) == {}
    index = lexical.build(empty(spark))
    assert lexical.search(index, lexical.query_terms(some, "item_id", "text")).columns == ["asked", "rank", "id", "score"]
