"""Language identification: word frequencies first, ever shorter character n-grams for unseen words.

A word of the model adds its log frequency in each language. For another word the longest n-grams (from `max_gram`
down to single letters) of which the model knows any take its place, by their mean log frequency. The answer is the
language with the greatest sum; its score is the posterior share, the evidence counted as that of `evidence_words`
words at most so that long texts keep a readable score.

Words are runs of letters, in lower case. A null text, or one without letters, gets `und` and score 0. A text whose
words share no letter with the model gets the most frequent language of the training rows with its even share.
Ties go to the language that sorts first. Rows with a null language are not learned from; without any labelled row
every text gets `und`. Rows are scored one by one: repeated rows get equal answers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.frequent import frequent
from matchloom.sources.staging import stage

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LanguageSettings:
    """`rows_per_language` bounds the labelled rows that are learned from (those of lowest hash, about so many);
    `max_words` and `max_grams` bound the model, which every task holds: those stay that are the largest part of some
    language's words or n-grams, so that a language with few rows keeps its own. What is seen less than `min_count` times
    and is less than a `rare_part` of each language is left out. `shared` is the part of a frequency that comes from all
    languages alike, so that no word is impossible in any. A longer text than `evidence_words` counts as much as one of
    that length: its words are not independent of each other, and the score would always be 0 or 1."""

    rows_per_language: int = 5_000
    max_words: int = 100_000
    max_grams: int = 60_000
    min_count: int = 2
    rare_part: float = 1e-4
    max_gram: int = 4
    evidence_words: int = 32
    shared: float = 0.01


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]  # row of `table`
    grams: dict[str, int]
    table: np.ndarray  # log frequencies, one row per word or n-gram, one column per language
    prior: np.ndarray
    settings: LanguageSettings


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of a word between its borders, `^` and `$`; single letters without the borders."""
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _training_rows(labelled: DataFrame, key: Column, lang: str, per_language: int) -> DataFrame:
    """About `per_language` rows of each language: those whose key's hash lies below the language's share."""
    counts = labelled.groupBy(F.col(lang).alias("lang")).count().collect()  # one row per language
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col(lang) == row["lang"], F.lit(min(1.0, per_language / row["count"]))).otherwise(share)
    place = F.pmod(F.xxhash64(key, F.lit("language sample")), F.lit(1 << 30)) / (1 << 30)
    return labelled.where(place < share)


def _counter(max_gram: int):
    """Partition of (lang, text) to (lang, kind, item, n): counts of words, and of n-grams by the words they are in."""
    kept = 200_000  # rows of a partition's table before it is passed on

    def rows(words: Counter) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for (lang, word), n in words.items():
            out[lang, "w", word] += n
            for size in range(1, max_gram + 1):
                for gram in grams_of(word, size):
                    out[lang, "g", gram] += n
        items = list(out.items())
        yield pa.record_batch(
            {
                "lang": pa.array([k[0] for k, _ in items], pa.string()),
                "kind": pa.array([k[1] for k, _ in items], pa.string()),
                "item": pa.array([k[2] for k, _ in items], pa.string()),
                "n": pa.array([n for _, n in items], pa.int64()),
            }
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = text.as_py()
                if found:
                    words.update((lang, w) for w in words_of(found))
                if len(words) > kept:
                    yield from rows(words)
                    words.clear()
        yield from rows(words)

    return count


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    settings: LanguageSettings = LanguageSettings(),
) -> LanguageModel:
    """Learn from a bounded sample of the labelled rows. The key only decides which rows are taken."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sample = _training_rows(rows, F.col(key), lang, settings.rows_per_language)
    counted = stage(
        sample.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        .mapInArrow(_counter(settings.max_gram), "lang string, kind string, item string, n bigint")
        .groupBy("kind", "item", "lang")
        .agg(F.sum("n").alias("n"))
        .groupBy("kind", "item")
        .agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")),
        "language-counts",
    )

    labels = {r["lang"]: r["count"] for r in sample.groupBy(F.col(lang).alias("lang")).count().collect()}  # a row per language

    def most(kind: str, top: int) -> list:
        rows = counted.where(F.col("kind") == kind)
        sums = rows.select(F.explode("by").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("sum"))
        of = F.create_map(*[F.lit(x) for r in sums.collect() for x in (r["lang"], float(r["sum"]))] or [F.lit(""), F.lit(1.0)])
        parts = F.transform(F.map_entries("by"), lambda e: e["value"] / F.try_element_at(of, e["key"]))
        ranked = rows.withColumn("part", (F.array_max(parts) * 10**9).cast("long"))
        known = (F.col("total") >= settings.min_count) | (F.col("part") >= int(settings.rare_part * 10**9))
        found = frequent(ranked.where(known), "part", top)
        return sorted(found.select("item", "by").collect(), key=lambda r: r["item"])  # `top` rows at most

    words, grams = most("w", settings.max_words), most("g", settings.max_grams)
    return _model(words, grams, labels, settings)


def _model(words: list, grams: list, labels: dict[str, int], settings: LanguageSettings) -> LanguageModel:
    """labels: the languages that were learned from, with their rows."""
    languages = sorted(labels)
    place = {name: i for i, name in enumerate(languages)}

    def table(rows: list, group) -> np.ndarray:
        """Log frequencies within each group of rows, a share of them that of all languages."""
        counts = np.zeros((len(rows), len(languages)))
        for i, row in enumerate(rows):
            for name, n in row["by"].items():
                if name in place:
                    counts[i, place[name]] = n
        groups = np.array([group(row) for row in rows], dtype=int)
        for g in np.unique(groups):
            own = counts[groups == g] / np.maximum(counts[groups == g].sum(axis=0), 1)
            counts[groups == g] = np.log((1 - settings.shared) * own + settings.shared * own.mean(axis=1, keepdims=True))
        return counts.astype(np.float32)

    totals = np.array([labels[name] for name in languages], dtype=float)
    return LanguageModel(
        languages,
        {row["item"]: i for i, row in enumerate(words)},
        {row["item"]: len(words) + i for i, row in enumerate(grams)},
        np.concatenate([table(words, lambda r: 0), table(grams, lambda r: len(r["item"]))]),
        np.log((totals + 1) / (totals + 1).sum()),
        settings,
    )


def backed_off(model: LanguageModel, word: str) -> list[int]:
    """Rows of the longest n-grams of a word that the model knows, none if it knows none of its letters."""
    marked, grams = f"^{word}$", model.grams
    for n in range(model.settings.max_gram, 1, -1):
        rows = [grams[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in grams]
        if rows:
            return rows
    return [grams[g] for g in word if g in grams]


def sums_of(model: LanguageModel, found: list[str], unseen: dict[str, list[int]]) -> np.ndarray:
    """The languages' sums over a text's words. `unseen` keeps the rows of unseen words between texts."""
    known = model.words
    rows = [known[w] for w in found if w in known]
    sums = model.table[rows].sum(axis=0, dtype=np.float64)
    if len(rows) < len(found):
        grams, shares = [], []
        for word in found:
            if word not in known:
                own = unseen.get(word)
                if own is None:
                    if len(unseen) >= _ROOM:
                        unseen.clear()
                    own = unseen[word] = backed_off(model, word)
                grams += own
                shares += [1.0 / len(own)] * len(own) if own else ()
        sums += np.asarray(shares) @ model.table[grams] if grams else 0.0
    return sums


_ROOM = 50_000  # unseen words that a task remembers


def _answer(model: LanguageModel, sums: np.ndarray, n: int) -> tuple[str, float]:
    if not sums.any():
        return model.languages[int(np.argmax(model.prior))], 1.0 / len(model.languages)
    best = int(np.argmax(sums))
    evidence = (sums - sums[best]) * min(1.0, model.settings.evidence_words / n)
    return model.languages[best], float(1.0 / np.exp(evidence).sum())


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with `lang_pred` and `score`."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        unseen: dict[str, list[int]] = {}
        for batch in batches:
            names, values = [], []
            for cell in batch.column(batch.num_columns - 1):
                found = words_of(cell.as_py() or "")
                if not found or not learned.languages:
                    names.append(UNKNOWN)
                    values.append(0.0)
                    continue
                name, value = _answer(learned, sums_of(learned, found, unseen), len(found))
                names.append(name)
                values.append(value)
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score"])

    held_columns = df.select(*keep, F.col(text).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in held_columns.schema.fields[:-1]]
    return held_columns.mapInArrow(score, ", ".join([*kinds, "lang_pred string", "score double"]))


def reject_unclear(
    df: DataFrame, model: LanguageModel, text: str = "text", min_score: float = 0.5
) -> DataFrame:
    """The rows whose language is clear: not `und`, and a score of `min_score` at least. Own columns stay. Where no
    language was learned nothing can be told, and all rows stay."""
    if not model.languages:
        return df
    own = {f"__own_{i}": c for i, c in enumerate(df.columns)}
    held = df.select(*[F.col(f"`{c}`").alias(k) for k, c in own.items()])
    where = next(k for k, c in own.items() if c == text)
    judged = predict(held, model, where, tuple(own))
    clear = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return clear.select(*[F.col(k).alias(c) for k, c in own.items()])

