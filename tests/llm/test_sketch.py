"""Threshold-scaled sketches against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from matchloom.llm import scaled_sketch as ss
from tests.llm.helpers import DOC_SCHEMA, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_hashes(text):
    words = WORD.findall(text or "")
    shingles = [words[i : i + 5] for i in range(max(len(words) - 4, min(len(words), 1)))]
    return {int(hashlib.md5(" ".join(s).encode()).hexdigest()[:15], 16) for s in shingles}


def brute_sketch(text, fraction=ss.FRACTION):
    hashes = sorted(brute_hashes(text))
    return [h for h in hashes if h < fraction * 16**15] or hashes[:1]


def brute_edited(rows):
    """(id, edited text, next text) of (id, text) rows, null the lowest id."""
    order = sorted({r[0] for r in rows}, key=lambda i: (i is not None, i or 0), reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t or "")
    out = []
    for i, t in rows:
        t, half = t or "", len(t or "") // 2
        assert len(texts[after[i]]) == 1 or i is not None  # several texts: any of them, checked apart
        out.append([(i, t[: len(t) - half] + n[:half], n) for n in texts[after[i]]])
    return out


def test_sketches_of_awkward_texts(spark):
    rows = awkward(spark).select("text", ss.sketch(F.col("text")).alias("s"), ss.sketch(F.col("text"), 0.5).alias("h")).collect()
    for r in rows:
        assert list(r["s"]) == brute_sketch(r["text"]) and list(r["h"]) == brute_sketch(r["text"], 0.5)


def test_containment_of_unequal_texts_and_merging(spark):
    words = [f"w{i}" for i in range(20_000)]
    whole, part, other = " ".join(words), " ".join(words[3_000:5_000]), " ".join(f"x{i}" for i in range(4_000))
    df = spark.createDataFrame([(whole, part, other)], "a string, b string, c string").select(
        *[ss.sketch(F.col(x)).alias(x) for x in "abc"]
    )
    r = df.select(
        ss.containment(F.col("b"), F.col("a")).alias("b_in_a"),
        ss.containment(F.col("a"), F.col("b")).alias("a_in_b"),
        ss.likeness(F.col("a"), F.col("c")).alias("unlike"),
        ss.merge(F.col("b"), F.col("c")).alias("merged"),
        ss.containment(F.col("c"), ss.merge(F.col("b"), F.col("c"))).alias("in_merged"),
    ).first()
    assert r["b_in_a"] == 1 and abs(r["a_in_b"] - 0.1) < 0.03 and r["unlike"] == 0 and r["in_merged"] == 1
    assert list(r["merged"]) == sorted(set(brute_sketch(part)) | set(brute_sketch(other)))


def test_merging_drops_a_least_hash_that_is_not_below(spark):
    limit = int(16**14)
    one = spark.range(1).select(F.array(F.lit(limit + 5)).alias("a"), F.array(F.lit(7)).alias("b"), F.array().cast("array<bigint>").alias("e"))
    r = one.select(
        ss.merge(F.col("a"), F.col("b")).alias("ab"),
        ss.merge(F.col("a"), F.col("e")).alias("ae"),
        ss.merge(F.col("e"), F.col("e")).alias("ee"),
        ss.likeness(F.col("e"), F.col("e")).alias("both"),
        ss.likeness(F.col("a"), F.col("e")).alias("one"),
    ).first()
    assert (list(r["ab"]), list(r["ae"]), list(r["ee"]), r["both"], r["one"]) == ([7], [limit + 5], [], 1.0, 0.0)


def test_edited_texts_of_awkward_rows(spark):
    df = awkward(spark)
    want = brute_edited([(r["doc_id"], r["text"]) for r in df.collect()])
    found = sorted((str(r["doc_id"]), r["n_chars"], r["edited"], list(r["sketch"])) for r in ss.edited(df).collect())
    assert len(found) == len(want)
    choices = [[(str(i), e) for i, e, _ in options] for options in want]
    for i, n, edited, _ in found:
        match = next(c for c in choices if (i, edited) in c)
        choices.remove(match)
    for r in ss.edited(df).collect():
        assert list(r["edited_sketch"]) == brute_sketch(r["edited"])


@pytest.mark.parametrize("hot", [5, None])
def test_an_id_that_most_rows_have(spark, hot):
    rows = [(i, f"text number {i} of a few more words", None, None, None) for i in range(1, 10) if i != hot]
    rows += [(hot, f"copy {k % 3} under one and the same id", None, None, None) for k in range(1_500)]
    found = ss.edited(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows) and {len(r["next_sketch"]) > 0 for r in found} == {True}
    below = 4 if hot == 5 else 9
    for r in found:
        if r["doc_id"] == hot:
            assert r["edited"].endswith(f"text number {below} of a few more words"[: r["n_chars"] // 2])
        elif r["doc_id"] == (6 if hot == 5 else 1):
            assert r["edited"].split("copy ")[1].startswith(tuple("012"))


def test_a_lone_document_and_none(spark):
    lone = spark.createDataFrame([(3, "one two three four", None, None, None)], DOC_SCHEMA)
    r = ss.edited(lone).first()
    assert (r["edited"], r["n_chars"]) == ("one two thone two t"[:9] + "one two t", 18)
    assert ss.edited(empty(spark)).collect() == []
    assert ss.edited(empty(spark)).columns == ["doc_id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch"]


def test_fraction_must_lie_inside(spark):
    with pytest.raises(ValueError):
        ss.sketch(F.lit("a"), 0)
