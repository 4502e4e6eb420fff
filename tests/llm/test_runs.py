"""Periodic runs against brute force."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import runs
from tests.llm.helpers import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    """Every maximal stretch of every period, with its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                out.setdefault((i, length), q)  # the smallest q comes first
            i = j
    return sorted(((s, n_, q) for (s, n_), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(texts, least=12):
    found = runs.find_runs([[w.encode() for w in t] for t in texts], least)
    for t, f in zip(texts, found):
        assert f == brute_runs(t, least), t
        assert runs.collapse([w.encode() for w in t], f).decode() == brute_collapsed(t, f)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=1).flatmap(lambda c: st.just(c)), max_size=60), st.integers(2, 14))
def test_two_letters(words, least):
    check([words], least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 9), st.integers(0, 3)), max_size=5), st.randoms())
def test_blocks_that_repeat(blocks, rnd):
    words = []
    for size, times, noise in blocks:
        block = [rnd.choice("abc") for _ in range(size)]
        words += block * times + [rnd.choice("abcd") for _ in range(noise)]
    check([words, words[::-1], [], ["a"]])


def test_words_of_fibonacci_and_of_one_kind():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    check([list(b), ["x"] * 500, list("ab" * 200), list("abcab" * 60) + list("cab" * 90)])


def test_texts_do_not_meet():
    check([list("abcdef"), list("abcdef"), list("abcdefabcdef"), list("fabcdefabcde")])


def test_a_long_text_takes_words_times_a_logarithm():
    rnd = random.Random(1)
    phrase = [f"w{i}" for i in range(9)]
    words = []
    for i in range(20_000):  # a passage of nine words between words of its own
        words += [*phrase, f"x{rnd.random()}"]
    found = runs.find_runs([[w.encode() for w in words], [b"z"] * 100_000])
    assert found == [[], [(0, 100_000, 1)]]


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = runs.with_runs(df, keep=("doc_id", "score", "lang")).collect()
    assert len(rows) == df.count()
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    for r, (i, text) in zip(sorted(rows, key=lambda r: (str(r["doc_id"]), r["collapsed"])), texts):
        assert str(r["doc_id"]) == i and r["score"] == "x"
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for d in df.collect():
        if d["doc_id"] is not None and d["doc_id"] != 7:
            words = WORD.findall(d["text"] or "")
            assert by[d["doc_id"]]["n_words"] == len(words)
            assert [tuple(x) for x in by[d["doc_id"]]["runs"]] == brute_runs(words)
    assert [tuple(x) for x in by[7]["runs"]] == [(0, 120_000, 977 * 4)]


def test_empty(spark):
    out = runs.with_runs(empty(spark))
    assert out.collect() == [] and out.columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_least_length():
    with pytest.raises(ValueError):
        runs.find_runs([[b"a"]], 1)
