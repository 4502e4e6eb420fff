"""Periodic runs of words by enumeration of maximal pairs.

A run is a stretch of words with smallest period q, at least two periods and `min_length` words long, that no
neighbouring word extends. Its first word and the word one period later begin a maximal pair: equal stretches, as long
as the run without one period, with different words before and after. So the maximal pairs whose distance is not above
their length, and whose distance and length together reach `min_length`, are exactly the runs, and nothing is extended
or verified; of several pairs of one stretch the smallest distance is the period.

Such a pair has at least half of `min_length` words. Only suffixes that share so many words with another suffix of
their text can be in one: they are found by hashes, ordered by doubling of ranks, and their common prefixes measured in
text order. A stack walks the LCP-interval tree bottom-up. Each interval holds the places of its suffixes, in order and
by left-word class; where two lists meet, the smaller one's places look for partners of another class within reach.
Places within reach of each other are of one periodic stretch, in which all but the first have the same left word, so
one look at either side tells whether there are any: no pair is visited that is not output.

Words are runs of `[^\\x20\\x09-\\x0D]`; the work of a text is its words times a logarithm, and no more than one slice of
texts is held at once. A null, empty or blank text has no words and no runs. Equal rows get equal runs; other columns
are passed on as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.shingles import mix

MIN_LENGTH = 12
SLICE_BYTES = 2_000_000
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _ranked(codes: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes that share `width` words with another one of their text, in lexicographic order within equal texts;
    rank of every place needed). Codes are positive; `width` zeros stand behind each text."""
    n = len(codes) - width
    key = mix(text[:n].astype(np.uint64))
    full = np.ones(max(n, 0), bool)
    for k in range(width):
        key = mix(key + codes[k : n + k].astype(np.uint64))
        full &= codes[k : n + k] > 0
    at = np.flatnonzero(full)
    order = at[np.argsort(key[at])]
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(codes), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    active = np.flatnonzero(shared)
    if not len(active):
        return active, active
    # Ranks by the first words, for the shared suffixes and those right behind them.
    shared[active + width] = True
    known = np.flatnonzero(shared)
    padded = np.append(codes, np.zeros(width, codes.dtype))
    known = known[np.lexsort([*[padded[known + k] for k in range(width - 1, -1, -1)], text[known]])]
    new = np.ones(len(known), bool)
    new[1:] = text[known[1:]] != text[known[:-1]]
    for k in range(width):
        new[1:] |= padded[known[1:] + k] != padded[known[:-1] + k]
    rank = np.zeros(len(padded), np.int64)
    rank[known] = np.maximum.accumulate(np.where(new, np.arange(len(known)), 0)) + 1
    shared[active + width] = False
    shared[active] = True
    # Double the number of words that ranks tell apart, for the suffixes that still have an equal one.
    order, size = known[shared[known]], width
    first = rank.copy()
    open_ = order
    while True:
        equal = rank[open_][1:] == rank[open_][:-1]
        tied = np.zeros(len(open_), bool)
        tied[1:] |= equal
        tied[:-1] |= equal
        open_ = open_[tied]
        if not len(open_):
            break
        behind = rank[open_ + size]
        sort = np.lexsort([behind, rank[open_]])
        open_, behind = open_[sort], behind[sort]
        old = rank[open_]
        group = np.ones(len(open_), bool)
        group[1:] = old[1:] != old[:-1]
        step = group.copy()
        step[1:] |= behind[1:] != behind[:-1]
        place = np.arange(len(open_))
        begin = np.maximum.accumulate(np.where(group, place, 0))
        rank[open_] = old + np.maximum.accumulate(np.where(step, place, 0)) - begin
        size *= 2
    return order[np.argsort(rank[order])], first


def _prefixes(order: np.ndarray, codes: list[int], first: np.ndarray, width: int) -> list[int]:
    """Common words of each suffix and the one before it; 0 where they share less than `width`.

    Measured in text order: a suffix shares at least what the one to its left shares, less one.
    """
    out = [0] * len(order)
    linked = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1
    before = dict(zip(order[linked].tolist(), order[linked - 1].tolist()))
    at = dict(zip(order[linked].tolist(), linked.tolist()))
    last, shared = -2, 0
    for here in sorted(before):
        there = before[here]
        shared = max(width, shared - 1) if here == last + 1 else width
        while codes[here + shared] == codes[there + shared] and codes[here + shared]:
            shared += 1
        out[at[here]] = shared
        last = here
    return out


def _join(few: list[int], many: list[int], depth: int, left: list[int], pairs: list[tuple[int, int, int]]) -> list[int]:
    """Merge two ordered lists of places below an interval; append (place, distance, depth) of its maximal pairs whose
    distance is at most its depth."""
    if len(few) > len(many):
        few, many = many, few
    for x in few:
        k = bisect_left(many, x)
        # behind x: all within reach are of one class
        if k < len(many) and many[k] - x <= depth and left[many[k]] != left[x]:
            j = k
            while j < len(many) and many[j] - x <= depth:
                pairs.append((x, many[j] - x, depth))
                j += 1
        # before x: all within reach are of its own class, but for the first
        if k and x - many[k - 1] <= depth:
            j = bisect_left(many, x - depth, 0, k)
            if left[many[j]] != left[x]:
                pairs.append((many[j], x - many[j], depth))
    if len(few) == 1:
        many.insert(bisect_left(many, few[0]), few[0])
    else:
        many += few
        many.sort()
    return many


def _maximal_pairs(order: list[int], prefixes: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """Bottom-up over the LCP-interval tree, whose open intervals are on the stack."""
    pairs: list[tuple[int, int, int]] = []
    depths: list[int] = []
    lists: list[list[int]] = []
    below: list[int] = []
    for place, depth in zip([*order, -1], [*prefixes, 0]):
        while depths and depths[-1] > depth:
            below = _join(below, lists.pop(), depths.pop(), left, pairs)
        if depth:
            if depths and depths[-1] == depth:
                lists[-1] = _join(below, lists[-1], depth, left, pairs)
            else:
                depths.append(depth)
                lists.append(below)
        below = [place]
    return pairs


def find_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words as (start, length, period), in order of start, then period."""
    if min_length < 2:
        raise ValueError("a run has two words at least")
    width = (min_length + 1) // 2
    names: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in texts], np.int64)
    codes = np.zeros(int(sizes.sum()) + width * (len(texts) + 1), np.int64)
    starts = np.cumsum(sizes + width) - sizes - width
    for begin, words in zip(starts.tolist(), texts):
        codes[begin : begin + len(words)] = [names.setdefault(w, len(names) + 1) for w in words]
    text = np.append(np.repeat(np.arange(len(texts)), sizes + width), np.full(width, len(texts)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order, first = _ranked(codes, text, width)
    if not len(order):
        return found
    plain = codes.tolist()
    prefixes = _prefixes(order, plain, first, width)
    left = [0, *plain[:-1]]  # the word before; 0 where a text begins, which differs from all words
    periods: dict[tuple[int, int], int] = {}
    for start, distance, depth in _maximal_pairs(order.tolist(), prefixes, left):
        if distance + depth >= min_length:
            stretch = (start, distance + depth)
            periods[stretch] = min(distance, periods.get(stretch, distance))
    for (start, length), period in periods.items():
        number = int(text[start])
        found[number].append((start - int(starts[number]), length, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, with blanks between, that no run contains after its first period."""
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        words = [w for w, n in zip(words, np.cumsum(dropped)) if not n]
    return b" ".join(words)


def _slices(cells: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of texts, in runs of texts of bounded size."""
    held, size = [], 0
    for cell in cells.cast(pa.binary()):
        text = cell.as_py() or b""
        held.append(text.split())
        size += len(text)
        if size > SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def with_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_length: int = MIN_LENGTH) -> DataFrame:
    """The kept columns with n_words, runs (start, length, period; ordered by start, then period) and collapsed, the
    text without the words that repeat a run's first period. Texts are worked on where they are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ends, rows, collapsed = [], [0], [], []
            for texts in _slices(batch.column(batch.num_columns - 1)):
                for words, runs in zip(texts, find_runs(texts, min_length)):
                    counts.append(len(words))
                    rows += runs
                    ends.append(len(rows))
                    collapsed.append(collapse(words, runs))
            columns = np.array(rows, np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], ["start", "length", "period"])
            own = [
                pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    held = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]]
    return held.mapInArrow(work, ", ".join([*kinds, "n_words bigint", f"runs {RUN_TYPE}", "collapsed string"]))
