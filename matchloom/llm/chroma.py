"""Chroma fingerprints of audio columns, and the alignment of recordings by them.

Audio is a column of 8-bit unsigned mono samples. Short spectra are folded into twelve pitch classes, smoothed over
time and brought to length one. Sixteen filters compare areas of the resulting picture (time by pitch class), each
from a few values of its integral image; a filter's value falls into one of four ranges, written as a two-bit Gray
code, and the sixteen codes make one 32-bit integer per frame.

Two recordings are aligned by the offset histogram of integers that differ in one bit at most, and judged by the share
of equal bits over their overlap. Every offset that has a vote is verified bit by bit over its whole overlap, and the
one of least error is the pair's. So an alignment is found if any of its frames has one wrong bit or none; among frames
of which a seventh of the bits may be wrong on average, few alignments have no such frame (recall is tested).

Equal fingerprints are one recording. Queries are the rows the caller marks. They are looked up in blocks of bounded
size, each sent to all tasks, while recordings stay where they are stored: nothing of them is shuffled, and a task
passes on one row per recording and block. A stretch of equal integers, as in silence, votes by its first and its last
frame, so long stretches cost no more than short ones.

Null and short audio has no frames and an empty fingerprint: it aligns with nothing. Silence has the fingerprint of
equal pitch classes. Repeated rows are equal fingerprints and each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.sources.staging import new_path, stage


@dataclass(frozen=True)
class ChromaSettings:
    """`max_error` is the share of wrong bits up to which an overlap of `min_overlap` frames or more is a match."""

    rate: int = 8_000
    frame: int = 256
    hop: int = 64
    low_hz: float = 250.0
    high_hz: float = 4_000.0
    max_error: float = 0.15
    min_overlap: int = 16


# Weights of five neighbouring frames.
SMOOTHING = (0.25, 0.75, 1.0, 0.75, 0.25)

# Filters: (kind, first pitch class, pitch classes, frames). Kinds: "low_high" halves of the pitch classes,
# "early_late" halves of the time, "corners" both, "middle" the middle third of the time against the outer ones.
FILTERS = tuple(
    (kind, first, height, width)
    for kind, sizes in (
        ("low_high", ((0, 4, 8), (4, 4, 8), (8, 4, 8), (0, 12, 8))),
        ("early_late", ((0, 3, 8), (3, 3, 8), (6, 3, 8), (9, 3, 8))),
        ("corners", ((0, 6, 8), (6, 6, 8), (0, 12, 4), (3, 6, 4))),
        ("middle", ((0, 4, 6), (4, 4, 6), (8, 4, 6), (0, 12, 6))),
    )
    for first, height, width in sizes
)
WIDTH = 8  # frames that a fingerprint integer looks at
# The outer borders of a filter's four ranges, by kind; the middle one is 0.
BORDERS = {"low_high": 0.25, "early_late": 0.04, "corners": 0.04, "middle": 0.03}
GRAY = (0, 1, 3, 2)


def pitch_classes(settings: ChromaSettings) -> np.ndarray:
    """(spectrum lines, 12): each line's share in the two pitch classes next to its frequency."""
    hz = np.fft.rfftfreq(settings.frame, 1 / settings.rate)
    out = np.zeros((len(hz), 12))
    used = np.flatnonzero((hz >= settings.low_hz) & (hz < settings.high_hz))
    note = 12 * np.log2(hz[used] / 440.0)
    below = np.floor(note).astype(int)
    out[used, below % 12] += 1 - (note - below)
    out[used, (below + 1) % 12] += note - below
    return out


@dataclass
class _Piece:
    """Frames first to last of a recording, and the integers begin to end that are cut from them."""

    recording: int
    samples: np.ndarray
    first: int
    last: int
    begin: int
    end: int


_PAD = len(SMOOTHING) // 2
_PIECE = 8_192  # frames of a piece, and of what is worked on at once


def _pieces(recordings: list[bytes], settings: ChromaSettings) -> Iterator[_Piece]:
    """Recordings in pieces that overlap by what smoothing and filters look at."""
    for number, audio in enumerate(recordings):
        samples = np.frombuffer(audio, np.uint8)
        frames = (len(samples) - settings.frame) // settings.hop + 1
        for begin in range(0, frames - WIDTH + 1, _PIECE):
            end = min(begin + _PIECE, frames - WIDTH + 1)
            yield _Piece(number, samples, max(0, begin - _PAD), min(frames, end + WIDTH - 1 + _PAD), begin, end)


def _chroma(pieces: list[_Piece], settings: ChromaSettings, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pitch classes by frame in 1/4096, first row of each piece): pieces stand apart by silent rows."""
    rows, starts, at, cuts = 0, [], [], []
    for piece in pieces:
        starts.append(rows + _PAD)
        at.append(rows + _PAD + np.arange(piece.last - piece.first))
        whole = np.lib.stride_tricks.sliding_window_view(piece.samples, settings.frame)
        cuts.append(whole[piece.first * settings.hop : (piece.last - 1) * settings.hop + 1 : settings.hop])
        rows += piece.last - piece.first + _PAD
    framed = np.concatenate(cuts).astype(np.float64) - 128.0
    power = np.abs(np.fft.rfft(framed * np.hamming(settings.frame), axis=1)) ** 2
    bare = np.zeros((rows + 2 * _PAD, 12))
    bare[np.concatenate(at)] = power @ classes
    wide = np.pad(bare, ((_PAD, _PAD), (0, 0)))
    smooth = sum(w * wide[k : k + len(bare)] for k, w in enumerate(SMOOTHING))
    size = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    even = np.where(size > 1e-6, smooth / np.maximum(size, 1e-6), 12**-0.5)
    return np.rint(even * 4096).astype(np.int64), np.array(starts)


def _filtered(picture: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The integers that begin at the given rows."""
    image = np.zeros((len(picture) + 1, 13), np.int64)
    np.cumsum(np.cumsum(picture, axis=0), axis=1, out=image[1:, 1:])

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        band = image[:, p1] - image[:, p0]
        return band[at + t1] - band[at + t0]

    out = np.zeros(len(at), np.uint32)
    for kind, first, height, width in FILTERS:
        p0, p1, pm = first, first + height, first + height // 2
        t1, tm, third = width, width // 2, width // 3
        if kind == "low_high":
            a, b = area(0, t1, p0, pm), area(0, t1, pm, p1)
        elif kind == "early_late":
            a, b = area(0, tm, p0, p1), area(tm, t1, p0, p1)
        elif kind == "corners":
            a = area(0, tm, p0, pm) + area(tm, t1, pm, p1)
            b = area(0, tm, pm, p1) + area(tm, t1, p0, pm)
        else:
            a, b = 2 * area(third, 2 * third, p0, p1), area(0, third, p0, p1) + area(2 * third, 3 * third, p0, p1)
        value = np.log((4096 + a) / (4096 + b))
        border = BORDERS[kind]
        out = (out << np.uint32(2)) | np.asarray(GRAY, np.uint32)[np.searchsorted((-border, 0.0, border), value)]
    return out


def fingerprints_of(recordings: list[bytes], settings: ChromaSettings = ChromaSettings()) -> list[np.ndarray]:
    """The fingerprint of each recording, whatever else stands in the list."""
    classes = pitch_classes(settings)
    found: list[list[np.ndarray]] = [[] for _ in recordings]

    def work(pieces: list[_Piece]) -> None:
        picture, starts = _chroma(pieces, settings, classes)
        sizes = np.array([p.end - p.begin for p in pieces])
        skip = starts + np.array([p.begin - p.first for p in pieces])
        ends = np.cumsum(sizes)
        at = np.repeat(skip - (ends - sizes), sizes) + np.arange(ends[-1])
        for piece, part in zip(pieces, np.split(_filtered(picture, at), ends[:-1])):
            found[piece.recording].append(part)

    held, size = [], 0
    for piece in _pieces(recordings, settings):
        held.append(piece)
        size += piece.last - piece.first
        if size >= _PIECE:
            work(held)
            held, size = [], 0
    if held:
        work(held)
    return [np.concatenate(parts) if parts else np.zeros(0, np.uint32) for parts in found]


def fingerprints(df: DataFrame, audio: str, keep: tuple[str, ...], settings: ChromaSettings = ChromaSettings()) -> DataFrame:
    """The kept columns with `fingerprint`, an array of integers."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audio = [cell or b"" for cell in batch.column(batch.num_columns - 1).to_pylist()]
            found = [f.view(np.int32) for f in fingerprints_of(audio, settings)]
            ends = np.cumsum([0] + [len(f) for f in found])
            lists = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate(found or [np.zeros(0, np.int32)]), pa.int32())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "fingerprint"])

    held = df.select(*keep, F.col(audio).cast("binary").alias("__audio"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]]
    return held.mapInArrow(mark, ", ".join([*kinds, "fingerprint array<int>"]))


BLOCK_FRAMES = 50_000  # of the queries that are sent to the tasks at once
_HITS = 1_000_000  # pairs of frames worked on at once
_FRAMES = 4_000_000  # compared at once
_FILTER_BITS = 24


def landmarks(prints: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the first and the last integer of every stretch of equal ones; recordings begin at `starts`."""
    edge = np.ones(len(prints) + 1, bool)
    edge[1:-1] = prints[1:] != prints[:-1]
    edge[starts] = True
    return np.flatnonzero(edge[:-1] | edge[1:])


class _Recordings:
    """Fingerprints one behind the other."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, prints: np.ndarray):
        self.nodes, self.sizes, self.prints = nodes, sizes.astype(np.int64), prints
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = landmarks(prints, self.starts[self.sizes > 0]) if len(prints) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(nodes), dtype=np.int32), self.sizes)


def _recordings(nodes: pa.Array, cells: pa.ListArray) -> _Recordings:
    sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
    return _Recordings(nodes.to_numpy(), sizes, cells.flatten().to_numpy().view(np.uint32))


class _Block:
    """Queries, and the integers that are at most one bit from theirs, in order."""

    def __init__(self, queries: _Recordings):
        self.queries = queries
        flips = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint32)
        near = (queries.prints[queries.at][:, None] ^ flips).reshape(-1)
        order = np.argsort(near)
        self.near, self.places = near[order], queries.at[order // len(flips)]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.near)] = True

    @staticmethod
    def _slot(prints: np.ndarray) -> np.ndarray:
        return (prints * np.uint32(0x9E3779B1)) >> np.uint32(32 - _FILTER_BITS)

    def matches(self, found: _Recordings, settings: ChromaSettings) -> dict[str, np.ndarray]:
        """Of each pair of a recording and another query that match: recording, query, offset, votes, overlap, error;
        ordered by recording."""
        at = found.at[self.filter[self._slot(found.prints[found.at])]]
        low, high = (np.searchsorted(self.near, found.prints[at], side) for side in ("left", "right"))
        hits = high - low
        at, low, hits = at[hits > 0], low[hits > 0], hits[hits > 0]
        group = np.cumsum(hits) // _HITS
        parts = [self._judged(found, at[own], low[own], hits[own], settings) for own in (group == g for g in np.unique(group))]
        row = np.concatenate(parts or [np.zeros((0, 6))])
        # An offset that was met in two portions has the votes of both.
        row = row[np.lexsort([row[:, 2], row[:, 1], row[:, 0]])]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:, :3] != row[:-1, :3]).any(axis=1)
        votes = np.add.reduceat(row[:, 3], np.flatnonzero(new)) if len(row) else row[:, 3]
        row = row[new]
        row[:, 3] = votes
        # the best offset of a pair: least error, longest overlap, nearest
        row = row[np.lexsort([row[:, 2], np.abs(row[:, 2]), -row[:, 4], row[:, 5], row[:, 1], row[:, 0]])]
        best = np.ones(len(row), bool)
        best[1:] = (row[1:, :2] != row[:-1, :2]).any(axis=1)
        row = row[best]
        names = ("recording", "query", "offset", "votes", "overlap")
        return {n: row[:, i].astype(np.int64) for i, n in enumerate(names)} | {"error": row[:, 5]}

    def _judged(self, found: _Recordings, at, low, hits, settings: ChromaSettings) -> np.ndarray:
        """The offset histogram of some frames' hits, and the error at each of its offsets."""
        own = self.queries
        ends = np.cumsum(hits)
        there = self.places[np.repeat(low - (ends - hits), hits) + np.arange(hits.sum())]
        here = np.repeat(at, hits)
        query, recording = own.owner[there].astype(np.int64), found.owner[here].astype(np.int64)
        offset = (there - own.starts[query]) - (here - found.starts[recording])
        overlap = np.minimum(own.sizes[query], found.sizes[recording] + offset) - np.maximum(offset, 0)
        other = (own.nodes[query] != found.nodes[recording]) & (overlap >= settings.min_overlap)
        least, span = found.sizes.max(), found.sizes.max() + own.sizes.max() + 1
        key = (recording[other] * len(own.nodes) + query[other]) * span + offset[other] + least
        key, votes = np.unique(key, return_counts=True)
        pair, offset = key // span, key % span - least
        recording, query = pair // len(own.nodes), pair % len(own.nodes)
        overlap = np.minimum(own.sizes[query], found.sizes[recording] + offset) - np.maximum(offset, 0)
        first = own.starts[query] + np.maximum(offset, 0)
        second = found.starts[recording] + np.maximum(-offset, 0)
        error = np.zeros(len(key))
        group = np.cumsum(overlap) // _FRAMES
        for g in np.unique(group):
            part = np.flatnonzero(group == g)
            n = overlap[part]
            ends = np.cumsum(n)
            step = np.arange(ends[-1]) - np.repeat(ends - n, n)
            wrong = own.prints[np.repeat(first[part], n) + step] ^ found.prints[np.repeat(second[part], n) + step]
            error[part] = np.add.reduceat(np.bitwise_count(wrong), ends - n, dtype=np.int64) / (32 * n)
        good = error <= settings.max_error
        return np.stack([recording, query, offset, votes, overlap, error], axis=1)[good]


def _looked_up(nodes: DataFrame, block: pa.Table, settings: ChromaSettings) -> DataFrame:
    """(node, found) of the recordings that match queries of a block (node, fingerprint): one row per recording."""
    shared = nodes.sparkSession.sparkContext.broadcast(
        _recordings(block["node"].combine_chunks(), block["fingerprint"].combine_chunks())
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None
        for batch in batches:
            asked = asked or _Block(shared.value)
            rows = asked.matches(_recordings(batch.column(0), batch.column(1)), settings)
            met, counts = np.unique(rows["recording"], return_counts=True)
            kinds = {"offset": pa.int32(), "votes": pa.int32(), "overlap": pa.int32(), "error": pa.float64()}
            cells = [pa.array(asked.queries.nodes[rows["query"]])] + [pa.array(rows[n], k) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(met)),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                        pa.StructArray.from_arrays(cells, ["query", *kinds]),
                    ),
                ],
                ["node", "found"],
            )

    return nodes.select("node", "fingerprint").mapInArrow(look_up, f"node bigint, {_FOUND}")


_FOUND = "found array<struct<query:bigint,offset:int,votes:int,overlap:int,error:double>>"


def _aligned(prints: DataFrame, settings: ChromaSettings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, found): the rows' recordings, the recordings, and the queries that each one matches."""
    prints = stage(prints.withColumn("key", F.md5(F.array_join("fingerprint", ",").cast("binary"))), "chroma-prints")
    nodes = stage(
        prints.where(F.size("fingerprint") > 0)
        .groupBy("key")
        .agg(F.max("is_query").alias("is_query"), F.first("fingerprint").alias("fingerprint"), F.min("doc_id").alias("class_id"))
        .withColumn("node", F.monotonically_increasing_id()),
        "chroma-nodes",
    )
    members = prints.join(nodes.select("key", "node"), "key", "left").select(
        "doc_id", "node", F.size("fingerprint").alias("frames")
    )
    asked = nodes.where(F.col("is_query") & (F.size("fingerprint") >= settings.min_overlap)).select("node", "fingerprint")
    frames = asked.agg(F.coalesce(F.sum(F.size("fingerprint")), F.lit(0))).first()[0]
    blocks = -(-frames // BLOCK_FRAMES)
    dealt = stage(asked.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(max(blocks, 1)))), "chroma-queries")
    session, path = nodes.sparkSession, new_path(nodes.sparkSession, "chroma-found")
    session.createDataFrame([], f"node bigint, {_FOUND}").write.parquet(path)
    for number in range(blocks):
        block = dealt.where(F.col("block") == number).select("node", "fingerprint").toArrow()
        if block.num_rows:
            _looked_up(nodes, block, settings).write.mode("append").parquet(path)
    return members, nodes, session.read.schema(f"node bigint, {_FOUND}").parquet(path)


def align(prints: DataFrame, settings: ChromaSettings = ChromaSettings()) -> tuple[DataFrame, DataFrame]:
    """(members, matches) of (doc_id, is_query, fingerprint).

    members: (doc_id, node, frames). matches: (query, node, offset, votes, overlap, error), one row per pair of a query
    and another recording that lies `offset` frames later on the query's time; nodes are recordings of different
    fingerprints.
    """
    members, _, found = _aligned(prints, settings)
    return members, found.select("node", F.inline("found"))


def best_matches(prints: DataFrame, settings: ChromaSettings = ChromaSettings()) -> DataFrame:
    """(doc_id, frames, class_id, n_matches, match_id, offset, overlap, error), one row per row.

    class_id: the least id of the equal fingerprints. n_matches: other recordings among the queries that align with
    the row's; match_id: the class_id of the best of them (least error, then the longest overlap, then the first node),
    with its offset on that one's time.
    """
    members, nodes, found = _aligned(prints, settings)
    members = stage(members, "chroma-members")
    order = F.transform("found", lambda m: F.struct(m["error"].alias("error"), (-m["overlap"]).alias("o"), m["query"], m["offset"]))
    per_node = found.groupBy("node").agg(F.sum(F.size("found")).alias("n_matches"), F.min(F.array_min(order)).alias("m"))
    names = nodes.where("is_query").select(F.col("node").alias("query"), F.col("class_id").alias("match_id"))
    named = per_node.withColumn("query", F.col("m.query")).join(names, "query").drop("query")
    facts = nodes.select("node", "class_id").join(named, "node", "left")
    # Rows without a fingerprint meet nothing; as a key, null would bring them all to one task.
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != "node"]
    alone = members.where("node IS NULL").select("*", *none)
    return members.join(facts, "node").unionByName(alone).select(
        "doc_id",
        "frames",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        "match_id",
        F.col("m.offset").alias("offset"),
        (-F.col("m.o")).alias("overlap"),
        F.round("m.error", 6).alias("error"),
    )
