"""Threshold-scaled sketches: every shingle hash below a fixed fraction of all hashes, without user functions.

A shingle is five words in a row (all words of a shorter text), hashed to 60 bits. A sketch keeps the hashes below
`FRACTION` of that range, in order; where none lies there, it keeps the least one, so only texts without words have an
empty sketch. Whether a hash is kept depends on the hash alone: sketches of any two texts, however unequal in length,
keep the same part of what they share. The share of one sketch's hashes that another one has therefore estimates
containment, and `merge` gives the sketch of two texts' shingles together.

A null text is an empty one. Blank texts have no shingles; their sketch is empty, equal to other empty ones and unlike
all others. Equal texts have equal sketches. Rows are not told apart by anything but id and text; other columns, whatever
their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.quality_rules import _let, words_of
from matchloom.sources.staging import stage

SHINGLE = 5
FRACTION = 1 / 16
HEX_DIGITS = 15  # of a hash that is kept, 60 bits
PARTS = 64  # of an id that very many rows have


def _hashes(words: Column) -> Column:
    """Hexadecimal hashes of the shingles in order; none without words."""

    def shingle(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE)])  # words beyond the end are null

    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))
    hashed = F.transform(starts, lambda i: F.md5(shingle(i).cast("binary")))
    return F.when(F.size(words) > 0, hashed).otherwise(F.array().cast("array<string>"))


def _limit(fraction: float) -> str:
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    return format(int(fraction * 16**HEX_DIGITS), f"0{HEX_DIGITS}x")


def sketch(text: Column, fraction: float = FRACTION) -> Column:
    """The sketch of a text: an ordered array of its distinct hashes below the fraction."""

    def kept(hashes: Column) -> Column:
        below = F.filter(hashes, lambda h: h < F.lit(_limit(fraction)))
        least = F.array_compact(F.array(F.array_min(hashes)))
        return _let(below, lambda low: F.when(F.size(low) > 0, low).otherwise(least))

    numbers = F.transform(
        _let(_let(words_of(text), _hashes), kept), lambda h: F.conv(F.left(h, F.lit(HEX_DIGITS)), 16, 10).cast("long")
    )
    return F.array_sort(F.array_distinct(numbers))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the shingles of two sketched texts together."""
    limit = int(_limit(fraction), 16)
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda h: h < limit)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second one has; 1 for a text without words."""
    return F.when(F.size(a) > 0, shared(a, b) / F.size(a)).otherwise(F.lit(1.0))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger one: 1 for two empty sketches, 0 for one of them."""
    fewer = F.least(F.size(a), F.size(b))
    return F.when(fewer > 0, shared(a, b) / fewer).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def printed(sketch: Column) -> Column:
    """The sketch as a string: its numbers in order, with commas."""
    return F.array_join(F.transform(sketch, lambda h: h.cast("string")), ",")


def _links(rows: DataFrame, hot: list) -> DataFrame:
    """(id, stands, other, salt): the digest of the text that stands for an id, and the next larger id (after the
    largest: the least), with the half of its longest text; once per part of the id."""
    key = F.col("id")
    parts = F.when(_is_hot(hot), F.lit(PARTS)).otherwise(F.lit(1))
    ids = rows.groupBy("id").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"), F.min(_digest()).alias("stands"))
    # Ids alone are sorted, in ranges; each range ends at the first id of the next one.
    ranged = stage(
        ids.withColumn("parts", parts).repartitionByRange(key.asc_nulls_first()).withColumn("range", F.spark_partition_id()),
        "sketch-ids",
    )
    own = F.struct("id", "half", "parts")
    firsts = ranged.groupBy("range").agg(F.min(own).alias("first"))  # one row per range
    order = Window.orderBy("range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = firsts.select("range", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("end"))
    after = F.lead(own).over(Window.partitionBy("range").orderBy(key.asc_nulls_first()))
    linked = ranged.withColumn("after", after).join(F.broadcast(ends), "range")
    return linked.select(
        "id", "stands", F.coalesce("after", "end").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    )


def _is_hot(hot: list) -> Column:
    values = [v for v in hot if v is not None]
    found = F.coalesce(F.col("id").isin(values), F.lit(False)) if values else F.lit(False)
    return (found | F.col("id").isNull()) if None in hot else found


def _digest() -> Column:
    return F.xxhash64("text")


def _key(of: Column) -> list[Column]:
    return [F.coalesce(of.cast("string"), F.lit("")).alias("k"), of.isNull().alias("no_id")]


def edited(docs: DataFrame, id: str = "doc_id", text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """(id, n_chars, edited, sketch, edited_sketch, next_sketch), one row per row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's: the one of the next lower id, after the lowest the highest; null is the lowest id. Of several
    rows of one id the text of least hash is the next document for the id above. A lone document is its own next one.

    Texts are sent by id once, with their sketches, and heads meet tails in a second join. Ids that more than a
    thousandth of all rows have (a thousand at most) are sent in parts.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    counts = stage(rows.groupBy("id").count(), "sketch-counts")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = [r["id"] for r in counts.where(F.col("count") > max(1_000, total // 1_000)).select("id").collect()]
    salt = F.when(_is_hot(hot), F.monotonically_increasing_id() % PARTS).otherwise(F.lit(0)).cast("int")
    join = ["k", "no_id", *(["salt"] if hot else [])]
    links = _links(rows, hot).select(*_key(F.col("id")), "*")
    links = links if hot else links.drop("salt")
    # Both uses of `met` need the same columns of the texts and no further key, so that these are hashed and sent once.
    parts = [salt.alias("salt")] if hot else []
    sent = rows.select(*_key(F.col("id")), *parts, "text", sketch(F.col("text"), fraction).alias("sketch"))
    met = sent.join(links.hint("merge"), join)
    tails = (
        met.where(_digest().bitwiseXOR(F.col("stands")) == 0)
        .select(
            *_key(F.col("other.id")),
            F.explode(F.sequence(F.lit(0), F.col("other.parts") - 1)).alias("salt"),
            F.left("text", F.col("other.half")).alias("tail"),
            F.col("sketch").alias("next_sketch"),
        )
        .dropDuplicates(join)
    )
    half = F.floor(F.length("text") / 2).cast("int")
    changed = F.concat(F.left("text", F.length("text") - half), F.left("tail", half))
    return met.join(tails.hint("merge"), join).select(
        F.col("id").alias(id),
        F.length("text").cast("long").alias("n_chars"),
        changed.alias("edited"),
        "sketch",
        sketch(changed, fraction).alias("edited_sketch"),
        "next_sketch",
    )
