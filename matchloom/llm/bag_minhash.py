"""Near-duplicate documents by BagMinHash over bags of five-word shingles.

Signatures. A shingle of count w owns the interval [0, w) of weights, cut into [0, 1), [1, 2), [2, 4), [4, 8) ...
Each piece carries a Poisson process of points in time, at a rate of its length per component, seeded by the shingle
and the piece; a point names a component and a unit cell of its piece, and counts if its cell lies below w. The first
point of a component is its signature value: two bags agree there with the probability of their weighted Jaccard
similarity. Only points up to a time by which all components are likely filled are made (later for the few bags that
need it), so the work is about one draw per shingle and m log m per document, not m per shingle.

Pairs. Equal texts are one node. Nodes that agree on all rows of a band meet in its bucket. Buckets are not paired
off: each member is compared with its bucket's centre, and buckets whose members are then connected are done. The
members of the others are joined on their rarest shingles, by a bound that loses no pair of the similarity. Compared
pairs are verified by the exact overlap of their bags. Classes are the connected components of links of at least the
similarity.

Null texts and texts without words have no shingles: a null text is in a class of its own with its `doc_id`, blank
texts are equal only to themselves. Repeated rows are equal texts. `class_id` is the least `doc_id` of the class (null
if it has only null ids), `class_key` an id of the class that is never null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.components import connected_components, merged_components
from matchloom.llm.shingles import bag, bags, mix, normalise, overlap
from matchloom.operators.sizes import only_keys_of
from matchloom.sources.staging import stage


@dataclass(frozen=True)
class NearSettings:
    """At a similarity of 0.8 the chance to share no band of 32 with 5 rows is 3 in a million."""

    similarity: float = 0.8
    shingle: int = 5
    bands: int = 32
    rows: int = 5

    @property
    def components(self) -> int:
        return self.bands * self.rows


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _multiple(k: int) -> np.uint64:
    return np.uint64(k * int(_GOLD) % (1 << 64))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def _pieces(text: np.ndarray, shingle: np.ndarray, count: np.ndarray):
    """(text, seed, length of the piece, count) of each piece of weight that a shingle's count reaches into."""
    texts, seeds, lengths, counts = [text], [mix(shingle)], [np.ones(len(text))], [count]
    low, level = 1, 1
    while (reach := count > low).any():
        texts.append(text[reach])
        seeds.append(mix(shingle[reach] + _multiple(level)))
        lengths.append(np.full(int(reach.sum()), float(low)))
        counts.append(count[reach])
        low, level = 2 * low, level + 1
    return tuple(np.concatenate(x) for x in (texts, seeds, lengths, counts))


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """(n_texts, m) signature values; zeros for texts without shingles."""
    weight = np.bincount(text, weights=count, minlength=n_texts)
    values = np.zeros((n_texts, m), np.uint64)
    owner, seed, length, most = _pieces(text, shingle, count)
    open_texts = weight > 0
    horizon = np.where(open_texts, (np.log(m) + 3.6) / np.maximum(weight, 1), 0.0)
    while open_texts.any():
        first = np.full(n_texts * m, np.inf)
        made = []
        at = np.flatnonzero(open_texts[owner])
        when, turn = np.zeros(len(at)), 0
        while len(at):
            turn += 1
            bits = mix(seed[at] + _multiple(turn))
            when = when - np.log(_uniform(bits)) / (m * length[at])
            due = when < horizon[owner[at]]
            at, when, bits = at[due], when[due], bits[due]
            more = mix(bits + _GOLD)
            component = (more % np.uint64(m)).astype(np.int64)
            cell = length[at] * (1 + _uniform(mix(more)))  # in (low, 2 low]; pieces after the first start at low
            counts = (length[at] == 1) | (np.ceil(cell) <= most[at])
            slot = owner[at] * m + component
            slot, point = slot[counts], (when[counts], more[counts])
            np.minimum.at(first, slot, point[0])
            made.append((slot, *point))
        for slot, time, name in made:
            hit = time == first[slot]
            values.reshape(-1)[slot[hit]] = name[hit]
        unfilled = np.isinf(first.reshape(n_texts, m)).any(axis=1)
        open_texts &= unfilled
        horizon *= 2.0
    return values


def bands_of(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) bucket names, different for each band."""
    parts = values.reshape(len(values), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, parts.shape[:2])
    for k in range(rows):
        total = mix(total + parts[:, :, k]) * np.uint64(0xD1342543DE82EF95)
    return mix(total).view(np.int64)


SLICE_BYTES, SLICE_TEXTS = 500_000, 256


def slices(cells: pa.Array) -> Iterator[list[bytes]]:
    """Normalised texts in runs of bounded size."""
    held, size = [], 0
    for cell in cells:
        text = normalise(cell.as_py())
        held.append(text)
        size += len(text)
        if size > SLICE_BYTES or len(held) >= SLICE_TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def signed(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """(doc_id, key, weight, bands) of (doc_id, key, text): one pass over the texts, which are not shuffled."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, names = [], []
            for texts in slices(batch.column(2)):
                text, shingle, count = bags(texts, settings.shingle)
                values = signatures(text, shingle, count, len(texts), settings.components)
                weight = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
                weights.append(weight)
                found = bands_of(values, settings.bands, settings.rows)
                ends = np.cumsum(np.where(weight > 0, settings.bands, 0))
                names.append((ends, found[weight > 0].reshape(-1)))
            offsets, shift = [np.zeros(1, np.int64)], 0
            for ends, _ in names:
                offsets.append(ends + shift)
                shift += int(ends[-1]) if len(ends) else 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(offsets), pa.int32()),
                pa.array(np.concatenate([x for _, x in names] or [np.zeros(0, np.int64)]), pa.int64()),
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(weights or [[]]), pa.int64()), lists],
                ["doc_id", "key", "weight", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key", "text").mapInArrow(
        sign, f"doc_id {kind}, key string, weight bigint, bands array<bigint>"
    )


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, settings: NearSettings) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the similarity.

    pairs: (a, b) nodes, a the one that more pairs share. nodes: (node, key). texts: (key, text), some row per key.
    """
    held = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), texts)
    both = (
        pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, tuple] = {}  # the bags of this batch's centres
            found = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if a not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[a] = bag(normalise(x.as_py()), settings.shingle)
                found.append(overlap(known[a], bag(normalise(y.as_py()), settings.shingle)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"]
            )

    return both.mapInArrow(compare, "a bigint, b bigint, similarity double").where(
        F.col("similarity") >= settings.similarity
    )


def _fits(left: str, right: str, similarity: float):
    """The overlap of bags is at most the ratio of their weights."""
    return F.least(left, right) >= F.lit(similarity) * F.greatest(left, right)


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of (node, key), from some row with that key each."""
    wanted = stage(nodes, "near-wanted")
    found = only_keys_of(texts, wanted, ["key"]).groupBy("key").agg(F.first("text").alias("text"))
    return stage(found.join(wanted, "key").select("node", "text"), "near-texts")


def _tokens(texts: DataFrame, settings: NearSettings) -> DataFrame:
    """(node, token, n): a shingle of count w as w tokens of its own; n tokens in all."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for slice_ in slices(batch.column(1)):
                text, shingle, count = bags(slice_, settings.shingle)
                owner, token = np.repeat(text, count), np.repeat(shingle, count)
                turn = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                token = mix(token + turn.astype(np.uint64) * _GOLD).view(np.int64)
                n = np.bincount(owner, minlength=len(slice_))[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + at)), pa.array(token), pa.array(n)], ["node", "token", "n"]
                )
                at += len(slice_)

    return texts.select("node", "text").mapInArrow(cut, "node bigint, token bigint, n bigint")


def _possible_pairs(parts: DataFrame, texts: DataFrame, settings: NearSettings) -> DataFrame:
    """(a, b): a superset of the pairs of different parts that reach the similarity, without pairing groups off.

    Tokens are ordered from rare to frequent. Bags that reach the similarity t have t / (1 + t) of their tokens, both
    counted, in common; so at the first common token neither may have fewer tokens left. This leaves the first fifth
    of a bag's tokens, at most, and near copies whose own rare tokens fill it meet nobody.
    parts: (node, part).
    """
    t = settings.similarity
    tokens = stage(_tokens(texts, settings), "near-tokens")
    held = tokens.groupBy("token").agg(F.count("*").alias("times"))
    order = Window.partitionBy("node").orderBy("times", "token")
    placed = tokens.join(held.where("times > 1"), "token", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    placed = placed.withColumn("left", F.col("n") - F.row_number().over(order) + 1)  # tokens from this one on
    first = placed.where((F.col("times") > 1) & (F.col("left") >= t * F.col("n"))).join(parts, "node")
    first = stage(first.select("node", "part", "token", "n", "left"), "near-first")
    several = first.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    first = first.join(several.select("token"), "token")
    right = first.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "part", "n", "left")])
    enough = (1 + t) * F.least("left", "left_b") >= t * (F.col("n") + F.col("n_b")) - 1e-6
    met = first.join(right, "token").where((F.col("node") < F.col("node_b")) & (F.col("part") != F.col("part_b")) & enough)
    return met.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def near_classes(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """(doc_id, class_id, class_key, key, weight), one row per row of (doc_id, text)."""
    texts = docs.select("doc_id", "text").withColumn("key", F.md5("text"))
    signs = stage(signed(texts, settings), "near-signatures")
    nodes = stage(
        signs.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc_id").alias("least"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "near-nodes",
    )
    met = nodes.select("node", "weight", F.explode("bands").alias("bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(met.join(sizes, "bucket"), "near-members")
    named, bodies = nodes.select("node", "key"), texts.where("key IS NOT NULL").select("key", "text")

    # The centre of a bucket: the member that meets most others, as the text that copies were made from does.
    meets = members.groupBy("node").agg(F.sum("size").alias("meets"))
    ranked = members.join(meets, "node").select("bucket", "node", "weight", "meets")
    centre = F.max(F.struct("meets", (-F.col("node")).alias("first"), "weight")).alias("c")
    centres = ranked.groupBy("bucket").agg(centre).select(
        "bucket", (-F.col("c.first")).alias("a"), F.col("c.weight").alias("weight_a")
    )
    stars = members.join(centres, "bucket").where("node <> a").where(_fits("weight_a", "weight", settings.similarity))
    pairs = stage(stars.select("a", F.col("node").alias("b")).distinct(), "near-pairs")
    links = stage(verified(pairs, named, bodies, settings), "near-links")
    labels = connected_components(links.select("a", "b"))

    # The rest: members of buckets that hold more than one component.
    parts = members.join(labels, "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = parts.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    open_nodes = stage(parts.join(several.select("bucket"), "bucket").select("node", "part").distinct(), "near-open")
    open_texts = _texts_of(open_nodes.select("node").join(named, "node"), bodies)
    rest = stage(_untested(_possible_pairs(open_nodes, open_texts, settings), pairs), "near-pairs")
    labels = merged_components(labels, stage(verified(rest, named, bodies, settings), "near-links"))

    parts = nodes.join(labels, "node", "left").withColumn("part", F.coalesce("part", "node"))
    heads = parts.groupBy("part").agg(F.min("least").alias("class_id"), F.min("key").alias("class_key"))
    classes = parts.join(heads, "part").select("key", "class_id", "class_key")
    lonely = F.concat(F.lit("null "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    alone = signs.where("key IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), lonely.alias("class_key"), "key", "weight"
    )
    several = signs.where("key IS NOT NULL").join(classes, "key")
    return several.select("doc_id", "class_id", "class_key", "key", "weight").unionByName(alone)


def _untested(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs that were not compared yet, in either order."""
    both = done.select("a", "b").unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def keep_one(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """One document of each class, with all its columns: the one of least id (null ids last), then of least text key.

    Rows that repeat that document's id and text are one document. Null texts are no copies of each other and stay.
    """
    own = {f"__own_{i}": c for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in own.items()])
    at = {c: k for k, c in own.items()}
    rows = stage(near_classes(docs, settings), "near-classes")
    chosen = (
        rows.where("key IS NOT NULL")
        .groupBy("class_key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("c"),
            F.count("*").alias("n"),
        )
        .select(F.col("c.doc_id").alias("__id"), F.col("c.key").alias("__key"))
    )
    repeats = rows.where("key IS NOT NULL").groupBy("doc_id", "key").count().where("count > 1")
    chosen = chosen.join(
        repeats.select(F.col("doc_id").alias("__rid"), F.col("key").alias("__rkey"), F.lit(True).alias("__repeated")),
        F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__key") == F.col("__rkey")),
        "left",
    ).select("__id", "__key", F.coalesce("__repeated", F.lit(False)).alias("__repeated"))
    kept = stage(
        held.withColumn("__text_key", F.md5(at["text"])).join(
            stage(chosen, "near-chosen"),
            F.col(at["doc_id"]).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")),
        ),
        "near-kept",
    )
    once = kept.where("NOT __repeated").select(*own)
    repeated = kept.where("__repeated").select(*own).dropDuplicates([at["doc_id"], at["text"]])
    without = held.where(F.col(at["text"]).isNull())
    return once.unionByName(repeated).unionByName(without).select(*[F.col(k).alias(c) for k, c in own.items()])
