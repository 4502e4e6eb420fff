"""Scoring by prediction by partial matching over bytes, trained on a corpus.

Training counts every run of `order` bytes and the byte after it, over all training texts; shorter contexts are sums
of longer ones. A byte is predicted in the longest context of the training texts, with the escape estimate of method
C; an escape passes to the next shorter context without the bytes that the longer one knows (symbol exclusion), at
last to an even share of the unknown bytes. As training is over when scoring starts, the code length of each byte in
each frequent context is worked out once, into a table.

The frequent contexts, of bounded number, form a trie that every scoring task holds: those of the greatest counts,
each with its shorter contexts. All other contexts stay a stored table that grows with the training texts. Where a
text leaves the trie at a context that is not in it, the task passes on the run; the distinct ones are joined with
the stored contexts, and what that changes in their code length is joined with the rows.

Texts are scored in UTF-8 with A to Z in lower case, between start marks and an end mark that is predicted, too.
A null text is an empty one: its score is that of the end mark. Without training texts every byte has an even share.

`base_rows` adds add-one unigram sums over words, with counts from a join; only the most frequent words, of bounded
number, are looked up in the task. Rows are scored one by one; repeated rows and null ids stay rows of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.frequent import frequent, least_count
from matchloom.sources.staging import stage

END, START = 256, 257  # marks next to the bytes
SYMBOLS = 257  # what can be predicted
BITS = 9  # of a symbol in a packed run


def _context() -> Column:
    return F.shiftright("run", BITS).alias("context")


def _symbol() -> Column:
    return F.col("run").bitwiseAND(F.lit((1 << BITS) - 1)).alias("symbol")


@dataclass(frozen=True)
class PpmSettings:
    order: int = 5
    max_contexts: int = 131_072
    max_words: int = 150_000  # words looked up in the task; the others are joined


SLICE_BYTES = 500_000


def _texts(cells: pa.Array) -> Iterator[list[bytes]]:
    """Lower-case texts in runs of bounded size."""
    held, size = [], 0
    for text in cells.cast(pa.binary()).to_pylist():
        text = (text or b"").lower()
        held.append(text)
        size += len(text) + 5
        if size > SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts with their marks, places of the predicted ones)."""
    mark = b"\0" * order
    data = np.frombuffer(b"".join(mark + t + b"\0" for t in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64) + order + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    heads = (starts[:, None] + np.arange(order)).reshape(-1)
    data[heads] = START
    data[ends] = END
    predicted = np.ones(len(data), bool)
    predicted[heads] = False
    return data, np.flatnonzero(predicted)


def runs(texts: list[bytes], order: int) -> np.ndarray:
    """Packed runs of `order` symbols and the predicted one."""
    data, at = symbols(texts, order)
    packed = np.zeros(len(at), np.int64)
    for back in range(order, -1, -1):
        packed = (packed << BITS) | data[at - back]
    return packed


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return names, np.bincount(which, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def count_runs(texts: DataFrame, order: int) -> DataFrame:
    """(run, n) over one text column."""
    room = 2_000_000  # counted runs a task holds before it merges them

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for slice_ in _texts(batch.column(0)):
                parts.append(np.unique(runs(slice_, order), return_counts=True))
                held += len(parts[-1][0])
                if held > room:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > room // 2:
                        yield _rows(*parts[0])
                        parts, held = [], 0
        if parts:
            yield _rows(*_merged(parts))

    def _rows(names: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(n.astype(np.int64))], ["run", "n"])

    return texts.mapInArrow(count, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


class _Links:
    """From a node and the column of the next earlier symbol to the longer context's node, as an open hash table."""

    def __init__(self, node: np.ndarray, column: np.ndarray, child: np.ndarray, width: int):
        self.width, self.bits = width, max(4, int(4 * len(child)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.children = np.full(1 << self.bits, -1, np.int32)
        key, child = node.astype(np.int64) * width + column, child.astype(np.int32)
        slot = self._slot(key)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] < 0]  # one key for each free slot
            self.keys[slot[first]], self.children[slot[first]] = key[first], child[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, child, slot = key[rest], child[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, node: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The longer context's node, or -1."""
        key = node.astype(np.int64) * self.width + column
        out, at, slot = np.full(len(key), -1, np.int32), np.arange(len(key)), self._slot(key)
        while len(at):
            held = self.keys[slot]
            hit = held == key
            out[at[hit]] = self.children[slot[hit]]
            on = ~hit & (held >= 0)
            at, key, slot = at[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


@dataclass
class PpmModel:
    order: int
    child: _Links
    column: np.ndarray  # symbol to its column of `logs`
    logs: np.ndarray  # log10 probability, one row per node, one column per known symbol and one for any other
    total: np.ndarray  # per node: how often its context was seen
    kinds: np.ndarray  # per node: symbols that follow it
    follows: np.ndarray  # per node: whether each column's symbol follows it, as packed bits


def fit(texts: DataFrame, settings: PpmSettings = PpmSettings()) -> PpmModel:
    """The trie of the frequent contexts of a one-column table of texts."""
    return learn(texts, settings)[0]


def learn(texts: DataFrame, settings: PpmSettings = PpmSettings()) -> tuple[PpmModel, DataFrame | None]:
    """Learn from all rows of a one-column table of texts: the trie, and the contexts that are not in it (None if all
    are), as `Counted.rare` gives them."""
    counted = count_contexts(texts, settings)
    return counted.trie(), counted.rare()


@dataclass(frozen=True)
class Counted:
    """The runs and contexts of the training texts, stored. Contexts seen `least` times are in the trie."""

    grams: DataFrame
    totals: DataFrame
    least: int
    order: int

    def _held(self) -> Column:
        return (F.col("total") >= self.least) | (F.col("k") == 0)

    def trie(self) -> PpmModel:
        kept = self.totals.where(self._held()).select("k", "context")
        rows = self.grams.withColumn("context", _context()).join(kept, ["k", "context"])
        # bounded by max_contexts times the symbols
        found = rows.select("k", "context", _symbol(), "n").toArrow()
        return model_of(*(found.column(c).to_numpy() for c in ("k", "context", "symbol", "n")), self.order)

    def rare(self) -> DataFrame | None:
        """The contexts that are not in the trie: (k, context, total, kinds, above, follow). follow: symbols to their
        counts; above: the sum of the counts that these symbols have in the next shorter context."""
        if self.least <= 1:
            return None
        # The runs of a level meet those of the next shorter one by the run without its first symbol.
        rare = self.grams.withColumn("context", _context()).join(self.totals.where(~self._held()), ["k", "context"])
        shorter = self.grams.select((F.col("k") + 1).alias("k"), F.col("run").alias("__run"), F.col("n").alias("__n"))
        rare = rare.withColumn("__run", F.expr(f"run & (shiftleft(1L, {BITS} * k) - 1)")).join(shorter, ["k", "__run"])
        follow = F.map_from_entries(F.collect_list(F.struct(_symbol(), "n"))).alias("follow")  # as many as symbols at most
        return stage(
            rare.groupBy("k", "context", "total").agg(F.count("*").alias("kinds"), F.sum("__n").alias("above"), follow),
            "ppm-rare",
        )


def count_contexts(texts: DataFrame, settings: PpmSettings = PpmSettings()) -> Counted:
    """Count all runs and contexts of a one-column table of texts."""
    longest = stage(count_runs(texts, settings.order), "ppm-runs")
    by_order = [longest.withColumn("k", F.lit(settings.order))]
    for k in range(settings.order - 1, -1, -1):
        shorter = F.col("run").bitwiseAND(F.lit((1 << (BITS * (k + 1))) - 1))
        sums = by_order[-1].groupBy(shorter.alias("run")).agg(F.sum("n").alias("n"))
        by_order.append(stage(sums, "ppm-runs").withColumn("k", F.lit(k)))
    grams = by_order[0]
    for more in by_order[1:]:
        grams = grams.unionByName(more)
    totals = stage(
        grams.groupBy("k", _context()).agg(F.sum("n").alias("total")), "ppm-contexts"
    )
    return Counted(grams, totals, least_count(totals, "total", settings.max_contexts), settings.order)


def model_of(k: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, order: int) -> PpmModel:
    """The trie and its table of code lengths, from the counts of symbols per context; each context's shorter ones
    must be there."""
    known = np.unique(symbol)
    width = len(known) + 1
    column = np.full(START + 1, len(known))
    column[known] = np.arange(len(known))
    # Level by level: nodes of an order follow those of shorter ones. The tail of a node is the share of each symbol
    # after an escape from it. Nodes are worked on in chunks and written to their place in the tables; of counts and
    # tails only those that the next level reads are held.
    nodes = [np.zeros(1, np.int64), *(np.unique(context[k == level]) for level in range(1, order + 1))]
    size = sum(map(len, nodes))
    logs = np.empty((size, width), np.float32)
    total, kinds = np.empty(size), np.empty(size, np.int64)
    follows = np.empty((size, -(-width // 8)), np.uint8)
    links = [np.zeros((3, 0), np.int64)]  # node, column, longer context's node
    base, above, above_tail = 0, np.zeros((0, width), np.float32), np.zeros((0, width), np.float32)
    for level, names in enumerate(nodes):
        own = np.flatnonzero(k == level)
        at_node = np.searchsorted(names, context[own])
        total[base : base + len(names)] = np.bincount(at_node, weights=n[own], minlength=len(names))
        own = own[np.argsort(at_node, kind="stable")]
        at_node = np.sort(at_node)
        if level:
            up = np.searchsorted(nodes[level - 1], names & ((1 << (BITS * (level - 1))) - 1))
            # the earliest symbol of a context leads from its shorter one to it
            own_column = _context_column(column, names >> (BITS * (level - 1)))
            links.append(np.stack([base - len(nodes[level - 1]) + up, own_column, base + np.arange(len(names))]))
        last = level == order
        counts, tails = (np.zeros((0 if last else len(names), width), np.float32) for _ in range(2))
        for at in range(0, len(names), _CHUNK):
            part = slice(at, min(at + _CHUNK, len(names)))
            held = slice(*np.searchsorted(at_node, [part.start, part.stop]))
            count = np.zeros((part.stop - part.start, width), np.float32)
            count[at_node[held] - at, column[symbol[own[held]]]] = n[own[held]]
            if level:
                tail = _tail(count, above[up[part]], above_tail[up[part]]).astype(np.float32)
            else:
                unknown = SYMBOLS - (count > 0).sum()
                tail = np.full_like(count, 1.0 / unknown if unknown else 0.0)
            place = slice(base + part.start, base + part.stop)
            with np.errstate(divide="ignore"):
                np.log10(_share(count, tail).astype(np.float32), out=logs[place])
            kinds[place] = (count > 0).sum(axis=1)
            follows[place] = np.packbits(count > 0, axis=1)
            if not last:
                counts[part], tails[part] = count, tail
        base, above, above_tail = base + len(names), counts, tails
    return PpmModel(order, _Links(*np.concatenate(links, axis=1), width + 1), column, logs, total, kinds, follows)


_CHUNK = 1_024


def _tail(counts: np.ndarray, above: np.ndarray, above_tail: np.ndarray) -> np.ndarray:
    """Shares after an escape: those of the shorter context without the symbols that the longer one knows, and of its
    own tail."""
    new = np.where(counts > 0, 0.0, above.astype(np.float64))
    total, distinct = new.sum(axis=1, keepdims=True), (new > 0).sum(axis=1, keepdims=True)
    size = np.maximum(total + distinct, 1)
    passed = np.where(distinct > 0, distinct / size, 1.0)
    return np.where(new > 0, new / size, passed * above_tail)


def _share(counts: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The probability of each symbol by method C."""
    exact = counts.astype(np.float64)
    total, distinct = exact.sum(axis=1, keepdims=True), (exact > 0).sum(axis=1, keepdims=True)
    size = np.maximum(total + distinct, 1)
    escape = np.where(total > 0, distinct / size, 1.0)
    return np.where(exact > 0, exact / size, escape * tail)


def _context_column(column: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Columns of `child`: those of the known symbols, one of all others (never linked), the start mark's last."""
    last = int(column.max()) + 1
    return np.where(symbol == START, last, column[symbol])


def _walk(model: PpmModel, at: np.ndarray, earlier: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, its order, whether a longer context may be among the ones that are not in the trie) of each place.
    earlier(places, b) gives the column of the symbol b before them."""
    node = np.zeros(len(at), np.int32)
    depth = np.full(len(at), model.order, np.int8)
    open_ = np.zeros(len(at), bool)
    alive = np.arange(len(at))
    other = int(model.column.max())  # symbols that the training texts do not have
    for back in range(1, model.order + 1):
        columns = earlier(at[alive], back)
        found = model.child(node[alive], columns)
        there = found >= 0
        ended = alive[~there]
        depth[ended] = back - 1
        open_[ended] = columns[~there] != other
        alive = alive[there]
        node[alive] = found[there]
    return node, depth, open_


def score_texts(model: PpmModel, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each lower-case text and its end, by the contexts of the trie."""
    return _scored_texts(model, texts)[0]


def _scored_texts(model: PpmModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores, text, run, times): the scores by the trie, and per text the runs that leave it at a context that is
    not in it."""
    data, at = symbols(texts, model.order)
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    ends = np.cumsum(sizes)
    logs, found = np.empty(len(at), np.float32), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for begin in range(0, len(at), _PLACES):
        places = at[begin : begin + _PLACES]
        first = places[0] - model.order
        own = data[first : places[-1] + 1]
        columns = _context_column(model.column, own)
        node, _, open_ = _walk(model, places - first, lambda places, back: columns[places - back])
        logs[begin : begin + len(places)] = model.logs[node, model.column[own[places - first]]]
        left = np.flatnonzero(open_)
        packed = np.zeros(len(left), np.int64)
        for back in range(model.order, -1, -1):
            packed = (packed << BITS) | data[places[left] - back]
        found.append((np.searchsorted(ends, begin + left, "right"), packed))
    which, packed = (np.concatenate(x) for x in zip(*found))
    sort = np.lexsort((packed, which))
    which, packed = which[sort], packed[sort]
    new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (packed[1:] != packed[:-1])])[: len(which)])
    times = np.diff(np.append(new, len(which)))
    return np.add.reduceat(logs, ends - sizes, dtype=np.float64), which[new], packed[new], times


_PLACES = 65_536  # looked up at once


def corrections(runs: DataFrame, shared, rare: DataFrame, order: int) -> DataFrame:
    """(run, change) of distinct runs that leave the trie: what the contexts that are not in it change in their code
    length. shared: a broadcast of the trie."""
    mask = (1 << BITS) - 1

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            run = batch.column(0).to_numpy()
            symbol = run & mask
            columns = [_context_column(model.column, (run >> (BITS * back)) & mask) for back in range(order + 1)]
            node, depth, _ = _walk(model, np.arange(len(run)), lambda places, back: columns[back][places])
            place = model.column[symbol]
            follows = (model.follows[node, place // 8] >> (7 - place % 8)) & 1 > 0
            total, kinds, log = model.total[node], model.kinds[node], model.logs[node, place].astype(np.float64)
            # known symbols: their count; others: their share after an escape from the node
            value = 10.0**log * (total + kinds) / np.where(follows, 1, kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (run, depth.astype(np.int32), total, kinds.astype(np.int64), follows, value, log)],
                ["run", "depth", "total", "kinds", "follows", "value", "log"],
            )

    left = runs.mapInArrow(
        leave, "run bigint, depth int, total double, kinds bigint, follows boolean, value double, log double"
    )
    # One row per longer context. The shorter ones of a context that was seen were seen, too.
    longer = left.withColumn("k", F.explode(F.sequence(F.col("depth") + 1, F.lit(order)))).withColumn(
        "context", F.expr(f"shiftright(run, {BITS}) & (shiftleft(1L, {BITS} * k) - 1)")
    )
    stats = rare.select("k", "context", F.col("total").alias("t"), F.col("kinds").alias("d"), "above", "follow")
    symbol = F.col("run").bitwiseAND(F.lit(mask))
    level = F.struct(
        (-F.col("k")).alias("k"),
        F.col("t").cast("double").alias("total"),
        F.col("d").alias("kinds"),
        F.col("above").cast("double").alias("above"),
        F.coalesce(F.try_element_at("follow", symbol), F.lit(0)).cast("double").alias("n"),
    )
    own = ["run", "total", "kinds", "follows", "value", "log"]
    met = longer.join(stats, ["k", "context"]).groupBy(*own).agg(F.sort_array(F.collect_list(level)).alias("levels"))
    # The longest context first; `above` and `kinds` are what the next shorter one leaves out.
    start = F.struct(
        F.lit(1.0).alias("p"), F.lit(0.0).alias("above"), F.lit(0).cast("long").alias("kinds"), F.lit(False).alias("done")
    )

    def pass_on(state, x):
        rest, new = x["total"] - state["above"], x["kinds"] - state["kinds"]
        part = F.when(x["n"] > 0, x["n"] / (rest + new)).when(new > 0, new / (rest + new)).otherwise(F.lit(1.0))
        after = F.struct(
            (state["p"] * part).alias("p"), x["above"].alias("above"), x["kinds"].alias("kinds"), (x["n"] > 0).alias("done")
        )
        return F.when(state["done"], state).otherwise(after)

    state = met.withColumn("s", F.aggregate("levels", start, pass_on))
    rest, new = F.col("total") - F.col("s.above"), F.col("kinds") - F.col("s.kinds")
    escaped = F.when(new > 0, new / (rest + new)).otherwise(F.lit(1.0))
    base = F.when(F.col("s.done"), F.lit(1.0)).otherwise(
        F.when(F.col("follows"), F.col("value") / (rest + new)).otherwise(escaped * F.col("value"))
    )
    return state.select("run", (F.log10(F.col("s.p") * base) - F.col("log")).alias("change"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over one text column; words are runs of `[^\\x20\\x09-\\x0D]` in UTF-8, A to Z in lower case."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            for slice_ in _texts(batch.column(0)):
                for text in slice_:
                    words.update(text.split())
                if len(words) > 200_000:
                    yield _rows(words)
                    words.clear()
        yield _rows(words)

    def _rows(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"]
        )

    return texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def scored(
    docs: DataFrame,
    training: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    settings: PpmSettings = PpmSettings(),
) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score. training: one text column.
    All contexts of the training texts count, whatever the trie holds.

    Tokens are the words and one end of each text; base_score sums log10((c + 1) / (N + V + 1)) over them.
    """
    context = docs.sparkSession.sparkContext
    counted = count_contexts(training, settings)
    # The driver holds the trie, and below the words, only until they are written to the broadcast.
    shared = context.broadcast(counted.trie())
    rare_contexts = counted.rare()
    cut = rare_contexts is not None
    words = stage(count_words(training), "ppm-words")
    ends = training.count()  # the end is a token, too
    count, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_tokens, types = count + ends, distinct + (ends > 0)
    shared_words = context.broadcast(frequent(words, "n", settings.max_words).toArrow())  # max_words rows at most
    end_known, end_log = int(ends > 0), float(np.log10(ends + 1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common = shared.value, shared_words.value
        known_logs = np.log10(common.column("n").to_numpy() + 1.0)
        known = dict(zip(common.column("word").to_pylist(), known_logs.tolist()))
        for batch in batches:
            done = 0
            for slice_ in _texts(batch.column(batch.num_columns - 1)):
                # a slice is passed on as soon as it is scored: its runs and words are all that is held
                own = score_slice(model, known, slice_)
                part = batch.slice(done, len(slice_))
                done += len(slice_)
                names = ["score", "n_tokens", "hits", "sums", "others", "left"]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *own], [*batch.schema.names[:-1], *names])

    def score_slice(model: PpmModel, known: dict[bytes, float], texts: list[bytes]) -> list[pa.Array]:
        scores, which, run, times = _scored_texts(model, texts)
        if not cut:
            which, run, times = which[:0], run[:0], times[:0]
        tokens, hits, sums, others, others_times, others_ends = [], [], [], [], [], [0]
        for one in texts:
            found = one.split()
            held = [known[w] for w in found if w in known]
            rest = Counter(w for w in found if w not in known) if len(held) < len(found) else {}
            tokens.append(len(found) + 1)
            hits.append(len(held) + end_known)
            sums.append(sum(held) + end_log)
            others += rest.keys()
            others_times += rest.values()
            others_ends.append(len(others))
        ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(texts)))])
        words = [pa.array(others, pa.binary()), pa.array(others_times, pa.int64())]
        return [
            pa.array(scores, pa.float64()),
            pa.array(tokens, pa.int64()),
            pa.array(hits, pa.int64()),
            pa.array(sums, pa.float64()),
            pa.ListArray.from_arrays(pa.array(others_ends, pa.int32()), pa.StructArray.from_arrays(words, ["word", "times"])),
            pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(run), pa.array(times)], ["run", "times"])
            ),
        ]

    held = docs.select(*keep, F.col(text).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]]
    more = "score double, n_tokens bigint, hits bigint, sums double, others array<struct<word:binary,times:bigint>>"
    more += ", left array<struct<run:bigint,times:bigint>>"
    rows = stage(
        held.mapInArrow(score, ", ".join([*kinds, more])).withColumn("__row", F.monotonically_increasing_id()),
        "ppm-rows",
    )
    # The words that tasks do not hold, rare each: none of them is a hot key.
    rare = rows.select(F.col("__row").alias("__r"), F.inline("others")).join(words, "word")
    rare = rare.groupBy("__r").agg(
        F.sum("times").alias("rare_hits"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_sums")
    )
    if cut:
        # A run that leaves the trie holds a context of small count, so none of them is a hot key.
        left = rows.select(F.col("__row").alias("__c"), F.inline("left"))
        changes = corrections(left.select("run").distinct(), shared, rare_contexts, settings.order)
        changes = left.join(changes, "run").groupBy("__c").agg(F.sum(F.col("times") * F.col("change")).alias("change"))
        rows = rows.join(changes, F.col("__row") == F.col("__c"), "left").drop("__c")
        rows = rows.withColumn("score", F.col("score") + F.coalesce("change", F.lit(0.0)))
    per_token = F.log10(F.lit(float(train_tokens + types + 1)))
    known_tokens = F.col("hits") + F.coalesce("rare_hits", F.lit(0))
    return rows.join(rare, F.col("__row") == F.col("__r"), "left").select(
        *keep,
        "n_tokens",
        known_tokens.alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("rare_sums", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )
