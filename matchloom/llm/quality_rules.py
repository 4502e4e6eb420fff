"""Quality rules: a threshold table compiled into one projection, without user functions.

Words are runs of `[^\\x20\\x09-\\x0D]`. A null text has no words. Nulls, empty texts and texts of blanks get zero
measures and fail the length rule. Equal rows are judged alike. `judge` adds one struct column; `keep` returns the
rows that pass with their own columns, whatever these are called.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

# Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by this from or an not have which at but they his "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les de des et en un une du que est pour qui dans sur pas plus par au avec ce il sont son "
    "el los las del y una por con no su para al lo como más o pero sus se"
).split()

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_exclamations",
    "n_stop_words",
)


@dataclass(frozen=True)
class Threshold:
    """`low <= measure / per <= high`, for texts of at least `from_words` words; nothing is asked where `per` is 0."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    from_words: int = 0


# The table.
RULES = (
    Threshold("too_short", "n_words", low=10),
    Threshold("repeated_words", "n_repeat_words", per="n_words", high=0.2),
    Threshold("mean_word_length", "word_chars", per="n_words", low=2, high=14),
    Threshold("symbols_per_word", "n_symbols", per="n_words", high=0.1),
    Threshold("exclamations_per_word", "n_exclamations", per="n_words", high=0.3),
    Threshold("duplicate_lines", "n_dup_lines", per="n_lines", high=0.5),
    Threshold("stop_word_ratio", "n_stop_words", per="n_words", low=0.02, from_words=100),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is worked out once.

    A lambda's argument stays one value wherever the optimizer moves the expression; a column named in a lambda would
    be worked out again for each element once a filter is pushed below its projection.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; the empty array for null and blank texts."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN)
    )


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def _window_hashes(words: Column) -> Column:
    return F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)])
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_starts(hashes: Column) -> Column:
    """Sorted places of the hashes that occur twice or more: those equal to a neighbour in (hash, place) order."""

    def equal(order: Column) -> Column:
        def same(x, k):
            return F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))

        found = F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(order, equal)


def _covered(starts: Column) -> Column:
    """Words under windows at sorted places: up to the next start, five words at most."""
    steps = F.transform(
        starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)))
    )
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text, the first ones included.

    Windows are compared by 64-bit hashes; only a text that has equal ones is sorted.
    """
    return _let(
        _window_hashes(words),
        lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            _let(_repeated_starts(hashes), _covered)
        ),
    )


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """A struct of counts over the whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))

    def over(words: Column, lines: Column) -> Column:
        counts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_lines": F.size(lines),
            "n_exclamations": F.regexp_count(text, F.lit("!")),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*stop_words))),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in counts.items()])

    return _let(words_of(text), lambda words: _let(lines, lambda found: over(words, found)))


def _passes(rule: Threshold, m: Column) -> Column:
    value = m[rule.measure] if rule.per is None else F.try_divide(m[rule.measure].cast("double"), m[rule.per])
    ok = m["n_words"] < rule.from_words
    tests = [value >= rule.low] if rule.low is not None else []
    tests += [value <= rule.high] if rule.high is not None else []
    return ok | F.coalesce(reduce(and_, tests), F.lit(True))


def judge(text: Column, rules: Sequence[Threshold] = RULES) -> Column:
    """The table as one expression: a struct of the measures, `failed_rules`, `base_failed` and `kept`."""

    def over(m: Column) -> Column:
        failed = F.array_compact(F.array(*[F.when(~_passes(r, m), F.lit(r.name)) for r in rules]))
        base = (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)
        return F.struct(
            *[m[c].alias(c) for c in MEASURES],
            failed.alias("failed_rules"),
            base.alias("base_failed"),
            (~base & (F.size(failed) == 0)).alias("kept"),
        )

    return _let(measures(text), over)


def keep(df: DataFrame, text: str = "text", rules: Sequence[Threshold] = RULES) -> DataFrame:
    """The rows that pass every rule."""
    return df.where(judge(F.col(text), rules)["kept"])
