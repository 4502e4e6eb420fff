"""Packing into length buckets of least padding, and batches of a token budget inside each bucket.

Bucket boundaries are lengths that occur. Of all choices of `buckets` boundaries, dynamic programming over the global
histogram of lengths finds one of least total padding: with prefix sums the cost of ending a bucket at a length is a
minimum of lines over the earlier ends, so a layer takes one pass over the distinct lengths. Their number is at most
the square root of twice all tokens, since so many different lengths need so many tokens.

A batch holds as many documents of one bucket, in random order of their ids, as fit its token budget at the bucket's
boundary, and at least one. Documents of length 0 (null texts, too) are packed like others. Rows that repeat id and
length are packed each. An empty table gives no boundaries and no batches.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.numbering import KEY_BITS, numbered
from matchloom.sources.staging import stage


@dataclass(frozen=True)
class PackSettings:
    buckets: int = 16
    batch_tokens: int = 32_768


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The boundaries of least padding for sorted (length, count) pairs; the last one is the greatest length."""
    if not histogram:
        return []
    lengths = [length for length, _ in histogram]
    counts, tokens = [0], [0]
    for length, n in histogram:
        counts.append(counts[-1] + n)
        tokens.append(tokens[-1] + n * length)
    size = len(lengths)
    # cost[j]: least padding of the first j lengths in the buckets so far; the first layer is one bucket
    cost = [0] + [lengths[j - 1] * counts[j] - tokens[j] for j in range(1, size + 1)]
    chosen = []
    for _ in range(1, min(buckets, size)):
        lines: deque[int] = deque()  # earlier ends whose line -counts[i] * x + cost[i] + tokens[i] is lowest somewhere

        def value(i: int, x: int) -> int:
            return cost[i] + tokens[i] - counts[i] * x

        def useless(a: int, b: int, c: int) -> bool:
            """Whether the line of b is nowhere below both those of a and c."""
            return (cost[c] + tokens[c] - cost[a] - tokens[a]) * (counts[b] - counts[a]) <= (
                cost[b] + tokens[b] - cost[a] - tokens[a]
            ) * (counts[c] - counts[a])

        after, cut = [0] * (size + 1), [0] * (size + 1)
        for j in range(1, size + 1):
            i = j - 1
            while len(lines) > 1 and useless(lines[-2], lines[-1], i):
                lines.pop()
            lines.append(i)
            x = lengths[j - 1]
            while len(lines) > 1 and value(lines[1], x) < value(lines[0], x):
                lines.popleft()
            cut[j] = lines[0]
            after[j] = value(lines[0], x) + x * counts[j] - tokens[j]
        chosen.append(cut)
        cost = after
    ends, j = [], size
    for cut in reversed(chosen):
        ends.append(j)
        j = cut[j]
    ends.append(j)
    return sorted({lengths[j - 1] for j in ends if j > 0})


def pack_texts(docs: DataFrame, length: Column, settings: PackSettings = PackSettings()) -> DataFrame:
    """(doc_id, row, text, length, bucket, padded, batch, slot): the packed rows themselves. `row` tells copies of one
    document apart; the places are found without the texts, which are joined once."""
    rows = stage(docs.select("doc_id", "text", length.alias("length")).withColumn("row", F.monotonically_increasing_id()), "pack-texts")
    places = pack(rows.select(F.col("row").alias("doc_id"), "length"), F.col("length"), settings)
    return rows.drop("length").join(places.withColumnRenamed("doc_id", "row"), "row").select("doc_id", "row", "text", *places.columns[1:])


def pack(docs: DataFrame, length: Column, settings: PackSettings = PackSettings()) -> DataFrame:
    """(doc_id, length, bucket, padded, batch, slot): the documents of a batch share (bucket, batch)."""
    key = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("pack")), 64 - KEY_BITS)
    rows = stage(docs.select("doc_id", length.cast("long").alias("length"), key.alias("key")), "pack-rows")
    histogram = rows.groupBy("length").agg(F.count("*").alias("n")).orderBy("length")
    ends = boundaries([(r["length"], r["n"]) for r in histogram.collect()], settings.buckets)
    names = F.array(*[F.lit(e).cast("long") for e in ends]).cast("array<bigint>")
    below = F.size(F.filter(names, lambda end: end < F.col("length")))
    placed = numbered(rows.withColumn("bucket", below), "bucket", "key")
    padded = F.get(names, F.col("bucket"))
    room = F.greatest(F.lit(1).cast("long"), F.expr(f"{settings.batch_tokens} div greatest(padded, 1)"))
    return (
        placed.withColumn("padded", padded)
        .withColumn("__room", room)
        .select(
            "doc_id",
            "length",
            "bucket",
            "padded",
            F.expr("place div __room").alias("batch"),
            (F.col("place") % F.col("__room")).alias("slot"),
        )
    )
