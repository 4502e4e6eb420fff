import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import lang_id as li
from matchloom.llm.registry import table
from tests.llm.helpers import awkward, empty

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = li.fit(docs.where(~held))
    rows = li.predict(docs.where(held), model, keep=("doc_id", "lang")).collect()
    assert len(rows) > 40
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def tiny_model():
    rows = [("w", "the", {"en": 8}), ("w", "der", {"de": 8}), ("w", "in", {"de": 2, "en": 2})]
    grams = [("^th", {"en": 8}), ("sch", {"de": 5}), ("h", {"en": 8, "de": 4}), ("z", {"de": 3, "en": 1})]
    named = lambda pairs: [{"item": i, "by": b} for i, b in pairs]
    return li._model(named([(w, b) for _, w, b in rows]), named(grams), {"de": 1, "en": 1}, li.LanguageSettings())


def mean_row(model, word):
    rows = li.backed_off(model, word)
    return model.table[rows].astype(float).mean(axis=0) if rows else np.zeros(len(model.languages))


def test_backoff_takes_the_longest_known_grams():
    model = tiny_model()
    assert li.backed_off(model, "thick") == [model.grams["^th"]]  # no 4-gram, one 3-gram
    assert li.backed_off(model, "hz") == [model.grams["h"], model.grams["z"]]  # single letters
    assert li.backed_off(model, "漢") == []
    # a known word is not backed off
    assert np.allclose(li.sums_of(model, ["the"], {}), model.table[model.words["the"]])
    both = model.table[model.words["the"]] + mean_row(model, "thick")
    assert np.allclose(li.sums_of(model, ["the", "thick", "漢"], {}), both)


def test_scores_of_brute_force(spark):
    model = tiny_model()
    texts = ["The der in thick", "in in", "schön THE", "漢字", "", None, "12 34"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r["doc_id"]: r for r in li.predict(df, model).collect()}
    for i, text in enumerate(texts):
        words = li.words_of(text or "")
        if not words:
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
            continue
        total = sum(
            (model.table[model.words[w]] if w in model.words else mean_row(model, w)).astype(float) for w in words
        )
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        if total.any():
            assert rows[i]["lang_pred"] == model.languages[int(total.argmax())]
            assert abs(rows[i]["score"] - share.max()) < 1e-6
        else:
            assert rows[i]["score"] == 0.5


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(li, "_ROOM", 10)
    model, unseen = tiny_model(), {}
    words = [f"thz{i}" for i in range(100)] * 2
    plain = sum(mean_row(model, w) for w in words)
    assert np.allclose(li.sums_of(model, words, unseen), plain) and len(unseen) <= 10


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = li.fit(docs, settings=li.LanguageSettings(min_count=1))
    rows = li.predict(docs, model).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert by[3] == by[4] == by[5] == by[8] == ["und"] and by[1] == ["en"] and by[2] == ["en", "en"]
    clear = li.reject_unclear(docs, model)
    assert clear.columns == docs.columns
    assert {r["doc_id"] for r in clear.collect()} >= {1, 2, 7}
    assert clear.where("doc_id IN (3, 4, 5, 8)").count() == 0


def test_nothing_to_learn_from(spark):
    model = li.fit(empty(spark))
    assert {r["lang_pred"] for r in li.predict(awkward(spark), model).collect()} == {"und"}
    assert li.predict(empty(spark), model).count() == 0
    assert li.reject_unclear(awkward(spark), model).count() == awkward(spark).count()


def test_a_small_language_stays_in_the_model(spark):
    large = [(i, f"the house number {i % 50} of the street and the sea", "en") for i in range(400)]
    small = [(1_000, "kala ja vesi", "fi"), (1_001, "metsä järvi", "fi")]
    docs = spark.createDataFrame(large + small, "doc_id long, text string, lang string")
    model = li.fit(docs, settings=li.LanguageSettings(max_words=12, max_grams=200))
    asked = spark.createDataFrame([(1, "vesi ja metsä"), (2, "the sea")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in li.predict(asked, model).collect()} == {1: "fi", 2: "en"}
    names = spark.createDataFrame([(3, "the sea", "en"), (4, "12 34", "xx")], docs.schema)
    assert li.fit(names).languages == ["en", "xx"]
