"""Mixing sources to target weights: hash-random order within each source, prefix sums, a cut at the exact budget.

Every document gets a random key from its id. Within a source the documents stand in order of (key, id); whole passes
over them (epochs) are taken while the budget allows, and then the documents before the cut. The cut is found without
sorting a source: its keys are split into ranges, the ranges' sizes are summed, and only the range that holds the cut
is sorted. What is left of the budget at the cut is taken from that one document's start, so a source gives its
budget exactly, in whole words.

Sources rank by code point, a null source last. Documents without words take no part (taken 0). Rows that repeat an
id, size and source count each; of such rows at the cut as many as needed are taken. With null ids all such rows of
one size share a key, and are counted rather than sorted. An empty table gives an empty plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.staging import stage


@dataclass(frozen=True)
class MixSettings:
    """Weights repeat over the ranked sources; `share` of all sizes is given out, at most `most` times a source."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0


KEY_BITS = 60


def random_key(doc_id: Column) -> Column:
    """60 hash bits of the id; the top ones name the key's range."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/mix")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size).

    A source at its limit passes the excess on by weight until none is above: so the targets are
    min(limit, weight x level) with one level for all. Sources are ordered by the level at which they reach their
    limit; the first ones whose limit lies below the level that the rest would get are at it. The windows run over
    one row per source.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    place = F.row_number().over(everything) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in settings.weights]), (place % len(settings.weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(settings.most))
    filled = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(settings.share)
    # The level if exactly the sources before this one were at their limit.
    before = F.coalesce(F.sum("limit").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (total - before) / rest)
    fits = F.col("limit") / F.col("weight") >= F.col("level")
    level = F.max(F.when(fits, F.col("level"))).over(Window.partitionBy())  # levels fall after the first that fits
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * level, F.col("limit")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(docs: DataFrame, settings: MixSettings = MixSettings()) -> tuple[DataFrame, DataFrame]:
    """(documents, plan) of (doc_id, source, size).

    documents: the rows with their key. plan, one row per source: source_size, target, epochs, and the cut: documents
    before (cut_key, cut_id, cut_size) are taken once more, and of the `cut_rows`-th row there the first `cut_words`.
    """
    rows = stage(docs.select("doc_id", "source", "size", random_key(F.col("doc_id")).alias("key")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = stage(sizes, "mix-sources")
    budget = (
        source_targets(sizes.select("source", "source_size"), settings)
        .join(sizes.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("epochs", F.expr("if(source_size = 0, 0, words div source_size)"))
        .withColumn("left", F.col("words") - F.col("epochs") * F.col("source_size"))
        # as many key ranges, a power of two, as a range has documents
        .withColumn("bits", F.ceil(F.log2(F.col("n").cast("double")) / 2).cast("int"))
        .drop("n", "words")
    )
    budget = stage(budget, "mix-budget")
    same = F.col("source").eqNullSafe(F.col("s"))
    renamed = budget.select(F.col("source").alias("s"), "bits", "left")
    ranged = rows.join(renamed, same).drop("s").where("left > 0").withColumn("range", F.expr(f"shiftright(key, {KEY_BITS} - bits)"))
    sums = ranged.groupBy("source", "left", "range").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("range"))
    cut_range = (
        sums.withColumn("upto", upto)
        .where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("size") < F.col("left")))
        .select(F.col("source").alias("s"), F.col("range").alias("r"), (F.col("left") - F.col("upto") + F.col("size")).alias("inside"))
    )
    in_range = ranged.join(cut_range, same & (F.col("range") == F.col("r"))).groupBy("source", "inside", "key", "doc_id", "size")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    cut = (
        in_range.agg(F.count("*").alias("copies"))
        .withColumn("upto", F.sum(F.col("size") * F.col("copies")).over(order))
        .withColumn("ahead", F.col("upto") - F.col("size") * F.col("copies"))
        .where((F.col("upto") >= F.col("inside")) & (F.col("ahead") < F.col("inside")))
        .select(
            F.col("source").alias("s"),
            F.col("key").alias("cut_key"),
            F.col("doc_id").alias("cut_id"),
            F.col("size").alias("cut_size"),
            # whole copies at the cut, and the words of the one that is cut
            F.expr("(inside - ahead) div size").alias("cut_copies"),
            ((F.col("inside") - F.col("ahead")) % F.col("size")).alias("cut_words"),
            F.col("copies").alias("cut_of"),
        )
    )
    plan = budget.drop("bits", "left").join(cut, same, "left").drop("s")
    return rows, stage(plan, "mix-plan")


def _before_cut() -> Column:
    """Whether a document stands before its source's cut, in order of key, id (null first) and size."""
    place = F.struct(F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("z"))
    cut = F.struct(F.col("cut_key").alias("k"), F.col("cut_id").alias("d"), F.col("cut_size").alias("z"))
    return F.coalesce((place < cut) & F.col("cut_key").isNotNull(), F.lit(False))


def _at_cut() -> Column:
    return F.coalesce(
        (F.col("key") == F.col("cut_key"))
        & F.col("doc_id").eqNullSafe(F.col("cut_id"))
        & (F.col("size") == F.col("cut_size")),
        F.lit(False),
    )


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of (doc_id, source, size, key, ...) with source_size, target, `whole` (times taken whole) and `part`
    (words taken of one more copy). Equal rows at the cut are numbered, so that as many as needed are taken."""
    spread = plan.withColumnRenamed("source", "s")
    joined = rows.join(spread, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sure = joined.where(~_at_cut()).withColumns(
        {"whole": F.col("epochs") + _before_cut().cast("long"), "part": F.lit(0).cast("long")}
    )
    at = joined.where(_at_cut())
    turn = Window.partitionBy("source").orderBy("key")  # copies of one document per source
    numbered = at.withColumn("turn", F.row_number().over(turn))
    edge = numbered.withColumns(
        {
            "whole": F.col("epochs") + (F.col("turn") <= F.col("cut_copies")).cast("long"),
            "part": F.when(F.col("turn") == F.col("cut_copies") + 1, F.col("cut_words")).otherwise(F.lit(0)).cast("long"),
        }
    ).drop("turn")
    dropped = ["epochs", "cut_key", "cut_id", "cut_size", "cut_copies", "cut_words", "cut_of", "weight"]
    return sure.drop(*dropped).unionByName(edge.drop(*dropped))


def mixed(docs: DataFrame, sizes: Column, settings: MixSettings = MixSettings()) -> DataFrame:
    """The mixture itself, with the documents' columns: a row per copy taken. Texts stay whole: the copy at a source's
    budget is taken if half of its words or more fit, so a source comes within half a document of its target.

    sizes: the word count of a row. The texts are not shuffled, but for copies of the one at a cut: rows meet the plan
    of their source, which has one row per source.
    """
    own = {f"__own_{i}": c for i, c in enumerate(docs.columns)}
    held = docs.select(
        F.col("doc_id"),
        F.col("source"),
        sizes.alias("size"),
        *[F.col(f"`{c}`").alias(k) for k, c in own.items()],
    )
    _, plan = mix_plan(held.select("doc_id", "source", "size"), settings)
    chosen = taken(held.withColumn("key", random_key(F.col("doc_id"))), plan)
    copies = F.col("whole") + ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")
    rows = chosen.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
    return rows.select(*[F.col(k).alias(c) for k, c in own.items()])
