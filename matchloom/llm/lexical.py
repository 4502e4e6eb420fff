"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, with A to Z in lower case. A term adds
`weight * ((10**9 * tf) div (1000 * tf + 8 * m))` to the score of a document that has it tf times, where the normaliser
m grows with the document's share of the mean length.

Documents of equal m are one stratum; large strata are dealt into blocks of bounded size. A block is one row: its
documents, and for each term and tf the documents that have the term so often. Within a stratum the impact of a term
depends on tf alone, so it is worked out once per tf, and the impacts of the greatest tf of each term bound the score
that a query can reach there. A search visits the blocks of the best bounds first, takes the k-th score found so far as
the query's threshold, and then visits those blocks whose bound is not below it. Bounds are true bounds and equal scores
are visited, so the result is that of scoring every document.

Queries are worked on in passes of bounded size, each sent to all tasks. Nothing else is: the index is read where it is
stored, and a task holds one block and its best k documents per query.

Null, empty and blank texts have no terms; they are in no stratum and do not count as documents. Every row is a document
of its own: repeated rows and ids get ranks of their own, a null id the last of equal scores. Rows of one query id,
null among them, are one query; a query without terms that occur has no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.sizes import MAX_BROADCAST_ROWS, broadcast_if_small, is_small
from matchloom.sources.staging import stage

BLOCK_DOCS = 512
BLOCK_POSTINGS = 500_000
PASS_TERMS = 100_000  # terms of the queries of one pass
PASS_QUERIES = 1_000
FIRST_DOCS = 64  # documents of the blocks that a query visits first

_OTHER = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes.maketrans(_OTHER, b" " * len(_OTHER))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TABLE = _FOLD.translate(_LOWER)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return (text or b"").translate(_TABLE).split()


def _counted(docs: DataFrame, id: str, text: str, only: frozenset[bytes] | None) -> DataFrame:
    """(id, n, terms, tfs) of the rows with a term. only: the terms that are kept; n counts all."""
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            at, sizes, names, times, ends = [], [], [], [], [0]
            for i, cell in enumerate(batch.column(1).cast(pa.binary())):
                found = terms_of(cell.as_py())
                if found:
                    held = Counter(found if asked is None else filter(asked.__contains__, found))
                    at.append(i)
                    sizes.append(len(found))
                    names += held.keys()
                    times += held.values()
                    ends.append(len(names))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(names, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                ["id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n bigint, terms array<string>, tfs array<bigint>")


@dataclass(frozen=True)
class LexicalIndex:
    """blocks: (m, block, ids, terms, tfs, sizes, places, tops, top_tfs), one row per block. Postings i of a block are
    the documents that have terms[i] tfs[i] times: the next sizes[i] of places. tops: its terms, with their greatest tf.
    frequencies: (term, df). n_docs: documents with a term. n_terms: all their terms, repeats too."""

    blocks: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, id: str = "doc_id", text: str = "text", only: frozenset[bytes] | None = None) -> LexicalIndex:
    """The index of all rows; with `only`, of those terms alone (lengths and numbers of documents count all terms)."""
    counted = _counted(docs, id, text, only).withColumn("__row", F.monotonically_increasing_id())
    rows = stage(counted, "lexical-rows")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    normaliser = F.expr(f"10 + ((90 * n * {n_docs}L) div {max(n_terms, 1)}L)")
    placed = rows.where(F.size("terms") > 0).withColumn("m", normaliser)
    strata = placed.groupBy("m").agg(F.count("*").alias("docs"), F.sum(F.size("terms")).alias("postings"))
    parts = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("postings") / BLOCK_POSTINGS))
    strata = stage(strata.select("m", parts.alias("parts")), "lexical-strata")
    dealt = placed.join(broadcast_if_small(strata), "m").withColumn("block", F.pmod(F.xxhash64("__row"), F.col("parts")))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = dealt.select("m", "block", "id", "terms", "tfs").groupBy("m", "block").applyInArrow(
        _block,
        f"m bigint, block bigint, ids array<{kind}>, terms array<string>, tfs array<bigint>, sizes array<bigint>, "
        "places array<int>, tops array<string>, top_tfs array<bigint>",
    )
    return LexicalIndex(stage(blocks, "lexical-blocks"), stage(frequencies, "lexical-terms"), n_docs, n_terms)


def _block(rows: pa.Table) -> pa.Table:
    """One block's row from its documents (m, block, id, terms, tfs)."""
    rows = rows.combine_chunks()
    lengths = pc.list_value_length(rows["terms"]).to_numpy()
    words = pc.list_flatten(rows["terms"]).combine_chunks().dictionary_encode()
    term, tf = words.indices.to_numpy(), pc.list_flatten(rows["tfs"]).to_numpy()
    place = np.repeat(np.arange(len(rows)), lengths)
    order = np.lexsort([place, tf, term])
    term, tf, place = term[order], tf[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    last = np.append(term[begin][1:] != term[begin][:-1], True)  # the greatest tf of a term
    names = words.dictionary.take(pa.array(term[begin]))

    def cell(values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.table(
        {
            "m": rows["m"].slice(0, 1),
            "block": rows["block"].slice(0, 1),
            "ids": cell(rows["id"].combine_chunks()),
            "terms": cell(names),
            "tfs": cell(pa.array(tf[begin])),
            "sizes": cell(pa.array(np.diff(np.append(begin, len(term))))),
            "places": cell(pa.array(place.astype(np.int32))),
            "tops": cell(names.filter(pa.array(last))),
            "top_tfs": cell(pa.array(tf[begin][last])),
        }
    )


@dataclass(frozen=True)
class _Pass:
    """Some queries: their terms, and the weight of each term (row) in each query (column), 0 where it lacks it."""

    terms: pa.Array
    weights: np.ndarray
    k: int

    def impacts(self, names: pa.Array, tfs: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(postings of asked terms, the terms' rows, their impacts)."""
        row = pc.fill_null(pc.index_in(names, self.terms), -1).to_numpy()
        at = np.flatnonzero(row >= 0)
        return at, row[at], (10**9 * tfs[at]) // (1000 * tfs[at] + 8 * m)

    def bounds(self, batch: pa.RecordBatch, i: int) -> np.ndarray:
        """The score that no document of a block exceeds, per query."""
        names, tfs = batch["tops"][i].values, batch["top_tfs"][i].values.to_numpy()
        _, row, impact = self.impacts(names, tfs, batch["m"][i].as_py())
        return impact.astype(self.weights.dtype) @ self.weights[row]

    def scores(self, batch: pa.RecordBatch, i: int, queries: np.ndarray) -> np.ndarray:
        """Scores of all documents of a block (rows) for some queries (columns); impacts are worked out per posting
        list, that is once per term and tf."""
        at, row, impact = self.impacts(batch["terms"][i].values, batch["tfs"][i].values.to_numpy(), batch["m"][i].as_py())
        sizes = batch["sizes"][i].values.to_numpy()
        starts = np.cumsum(sizes) - sizes
        used, column = np.unique(row, return_inverse=True)
        count = sizes[at]
        ends = np.cumsum(count)
        flat = np.repeat(starts[at] - (ends - count), count) + np.arange(count.sum())
        table = np.zeros((len(batch["ids"][i].values), len(used)), self.weights.dtype)
        table[batch["places"][i].values.to_numpy()[flat], np.repeat(column, count)] = np.repeat(impact, count)
        return table @ self.weights[np.ix_(used, queries)]


class _Best:
    """The best k (score, id) of each query among those offered."""

    ROOM = 50_000  # rows that are held before they are sorted out

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held = 0

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        doc, at = np.nonzero((scores > 0) & (scores >= self.floor[queries]))
        if len(doc):
            self.parts.append((queries[at], scores[doc, at].astype(np.int64), ids.take(pa.array(doc))))
            self.held += len(doc)
        if self.held > self.ROOM:
            self.settle()

    def settle(self) -> pa.Table | None:
        if not self.parts:
            return None
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        rows = pa.table({"query": query, "id": pa.chunked_array([p[2] for p in self.parts]), "score": score})
        rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("score", "descending"), ("id", "ascending")]))
        query = rows["query"].to_numpy()
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        full = place == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], rows["score"].to_numpy()[full])
        rows = rows.filter(pa.array(place < self.k))
        self.parts = [(rows["query"].to_numpy(), rows["score"].to_numpy(), rows["id"].combine_chunks())]
        self.held = len(rows)
        return rows


def _first_visits(index: LexicalIndex, shared, k: int) -> dict[tuple[int, int], list[int]]:
    """(m, block) to the queries that visit it first: the blocks of a query's best bounds, until they hold
    FIRST_DOCS documents (k at least). As many rows as a pass has queries, times so many documents at most."""
    enough = max(k, FIRST_DOCS)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, found = shared.value, []
        for batch in batches:
            for i in range(len(batch)):
                bounds = asked.bounds(batch, i)
                queries = np.flatnonzero(bounds > 0)
                where = [np.full(len(queries), x) for x in (batch["m"][i].as_py(), batch["block"][i].as_py(), batch["docs"][i].as_py())]
                found.append((queries, bounds[queries].astype(np.int64), *where))
            if sum(len(f[0]) for f in found) > 100_000:
                found = [best(found)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(found)], ["query", "bound", "m", "block", "docs"])

    def best(found: list[tuple]) -> tuple:
        query, bounds, m, block, docs = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort([block, m, -bounds, query])
        query, docs = query[order], docs[order]
        before = np.cumsum(docs) - docs
        keep = before - before[np.searchsorted(query, query)] < enough
        return tuple(x[keep] for x in (query, bounds[order], m[order], block[order], docs))

    read = index.blocks.select("m", "block", F.size("ids").cast("long").alias("docs"), "tops", "top_tfs")
    bounded = read.mapInArrow(bound, "query bigint, bound bigint, m bigint, block bigint, docs bigint")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "m", "block")
    before = F.sum("docs").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("docs")
    visits: dict[tuple[int, int], list[int]] = {}
    for r in bounded.withColumn("before", before).where(F.col("before") < enough).collect():
        visits.setdefault((r["m"], r["block"]), []).append(r["query"])
    return visits


def _visit(index: LexicalIndex, shared, first: dict, floor: np.ndarray | None) -> DataFrame:
    """(query, id, score): each task's best of the first visits, or (with thresholds) of all others that can matter."""
    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    told = index.blocks.sparkSession.sparkContext.broadcast((first, floor))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, (first, floor) = shared.value, told.value
        best = _Best(asked.k, np.zeros(asked.weights.shape[1]) if floor is None else floor)
        for batch in batches:
            for i in range(len(batch)):
                visitors = np.array(first.get((batch["m"][i].as_py(), batch["block"][i].as_py()), []), np.int64)
                if floor is not None:
                    bounds = asked.bounds(batch, i)
                    reach = (bounds > 0) & (bounds >= best.floor)
                    reach[visitors] = False
                    visitors = np.flatnonzero(reach)
                if len(visitors):
                    best.offer(visitors, asked.scores(batch, i, visitors), batch["ids"][i].values)
        rows = best.settle()
        if rows is not None:
            yield from rows.to_batches()

    blocks = index.blocks
    if floor is None:
        ms = sorted({m for m, _ in first})
        blocks = blocks.where(F.col("m").isin(ms)) if len(ms) <= 500 else blocks  # fewer rows are read; `work` tells them apart
    return blocks.mapInArrow(work, f"query bigint, id {kind}, score bigint")


def _best_rows(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, id: str, text: str) -> DataFrame:
    """(query id as `asked`, term), each once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(cell.as_py()))) for cell in batch.column(1).cast(pa.binary())]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            names = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), names], ["asked", "term"])

    rows = queries.select(F.col(id).alias("asked"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["asked"].dataType.simpleString()
    return rows.mapInArrow(cut, f"asked {kind}, term string").distinct()


def vocabulary(terms: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> frozenset[bytes] | None:
    """The distinct terms of queries if they are few enough to be sent to all tasks."""
    distinct = terms.select("term").distinct()
    return frozenset(r["term"].encode() for r in distinct.collect()) if is_small(distinct, max_rows) else None


def _passes(weighted: DataFrame) -> Iterator[tuple[list, _Pass]]:
    """Queries with their terms and weights (asked, term, weight) in passes of bounded size; a query is in one pass."""
    sizes = weighted.groupBy("asked").agg(F.count("*").alias("n"))
    # one row per query of few numbers; a pass's terms are read when it is its turn
    held: list = []
    count = 0
    for r in sizes.orderBy("asked").toLocalIterator():
        if held and (count + r["n"] > PASS_TERMS or len(held) >= PASS_QUERIES):
            yield held, _pass_of(weighted, held)
            held, count = [], 0
        held.append(r["asked"])
        count += r["n"]
    if held:
        yield held, _pass_of(weighted, held)


def _pass_of(weighted: DataFrame, asked: list) -> _Pass:
    own = F.col("asked").isin([a for a in asked if a is not None])
    rows = weighted.where(F.coalesce(own, F.lit(False)) | (F.col("asked").isNull() if None in asked else F.lit(False))).collect()
    number = {a: i for i, a in enumerate(asked)}
    terms = sorted({r["term"] for r in rows})
    row = {t: i for i, t in enumerate(terms)}
    weights = np.zeros((len(terms), len(asked)), np.int64)
    for r in rows:
        weights[row[r["term"]], number[r["asked"]]] = r["weight"]
    # An impact is below 10**6: as doubles, sums stay exact up to 2**53.
    exact = weights.sum(axis=0).max(initial=0) * 10**6 < 2**53
    return _Pass(pa.array(terms, pa.string()), weights.astype(np.float64) if exact else weights, 0)


def search(index: LexicalIndex, terms: DataFrame, k: int = 10) -> DataFrame:
    """(asked, rank, id, score): each query's k documents of the highest scores above 0, equal scores by id.

    terms: (asked, term), each once. Weights are floor(1000 * ln((2 N + 2) / (2 df + 1))).
    """
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = stage(terms.join(index.frequencies, "term").select("asked", "term", weight.alias("weight")), "lexical-asked")
    context = weighted.sparkSession.sparkContext
    kind = terms.schema["asked"].dataType
    out = None
    for asked, own in _passes(weighted):
        shared = context.broadcast(_Pass(own.terms, own.weights, k))
        first = _first_visits(index, shared, k)
        found = stage(_best_rows(_visit(index, shared, first, None), k).drop("rank"), "lexical-first")
        floor = np.zeros(len(asked))
        for r in found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).collect():
            floor[r["query"]] = r["s"]
        rows = _best_rows(found.unionByName(_visit(index, shared, first, floor)), k)
        names = F.array(*[F.lit(a).cast(kind) for a in asked])
        rows = stage(rows.select(names[F.col("query")].alias("asked"), F.col("rank").cast("int"), "id", "score"), "lexical-found")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        none = index.blocks.select(F.explode("ids").alias("id")).limit(0)
        out = none.select(F.lit(None).cast(kind).alias("asked"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    return out
