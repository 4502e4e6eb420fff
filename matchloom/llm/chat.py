"""Reply trees to conversations: root-to-leaf paths by iterative self-joins, ranked by score, one text per path.

Messages are rows (conv_id, id, parent_id, role, text, score). A message without a parent in its conversation is a
root. Paths are found by joining the table with itself on ever longer steps: after k joins a message knows the
ancestor 2**k replies above it, the number of replies to its root and the sum of the scores on the way, so trees of
depth d take log2(d) joins and no path is carried along. Leaves are ranked by the mean score of their path (then the
longer path, then the smaller id); the messages of the chosen paths come from the same steps, taken down again.

A turn is written `<|im_start|>role`, a newline, the text, `<|im_end|>` and a newline. In texts and roles a backslash
goes into every `<|` (and one more where backslashes stand there), so control strings inside texts are no control
strings, and taking one backslash away gives the text back. Line ends and backslashes in roles are written `\\n` and
`\\s`. The output is cut into segments, each in the loss or not: the texts of the loss roles are.

Null texts, roles and scores are empty, empty and 0. Repeated ids within a conversation are one message: the first in
the order of all its columns. Messages whose parents run in a circle have no root and are on no path. Null conversation ids are one
conversation. Extra columns are left out. A conversation's text is one row, however the messages were dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.staging import stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def chain(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Plain conversations as trees without branches: each turn answers the one before it.

    Turns are numbered anew in order of turn, role and text, so equal turn numbers and repeated rows keep a place each.
    """
    order = Window.partitionBy(conv).orderBy(turn, "role", "text")
    numbered = turns.withColumn("id", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.col(conv).alias("conv_id"),
        "id",
        F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _steps(messages: DataFrame) -> list[DataFrame]:
    """[(conv_id, id, up, hops, total), ...]: per step size 2**k the ancestor that far above (null beyond the root),
    the replies counted on the way there, and the scores of the messages below it. The last step reaches all roots."""
    known = messages.select(F.col("conv_id").alias("c"), F.col("id").alias("p"))
    first = (
        messages.join(known, _same("conv_id", "c") & (F.col("parent_id") == F.col("p")), "left")
        .select(
            "conv_id",
            "id",
            F.col("p").alias("up"),
            F.lit(1).cast("long").alias("hops"),
            F.coalesce("score", F.lit(0.0)).alias("total"),
        )
    )
    steps = [stage(first, "reply-steps")]
    total = steps[0].count()
    while steps[-1].where("up IS NOT NULL").limit(1).count() and (1 << len(steps)) <= 2 * total:
        now = steps[-1]
        above = now.select(
            F.col("conv_id").alias("c"), F.col("id").alias("i"), F.col("up").alias("u"), F.col("hops").alias("h"), F.col("total").alias("t")
        )
        further = now.join(above, _same("conv_id", "c") & (F.col("up") == F.col("i")), "left").select(
            "conv_id",
            "id",
            F.col("u").alias("up"),
            (F.col("hops") + F.coalesce("h", F.lit(0))).alias("hops"),
            (F.col("total") + F.coalesce("t", F.lit(0.0))).alias("total"),
        )
        steps.append(stage(further, "reply-steps"))
    return steps


def ranked_leaves(messages: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(conv_id, leaf, length, mean_score, rank) of every root-to-leaf path."""
    replied = messages.select(F.col("conv_id").alias("c"), F.col("parent_id").alias("i")).where("i IS NOT NULL").distinct()
    rooted = steps[-1].where("up IS NULL")  # the others run in a circle
    leaves = rooted.join(replied, _same("conv_id", "c") & (F.col("id") == F.col("i")), "left_anti").select(
        "conv_id", F.col("id").alias("leaf"), F.col("hops").alias("length"), (F.col("total") / F.col("hops")).alias("mean_score")
    )
    order = Window.partitionBy("conv_id").orderBy(F.desc("mean_score"), F.desc("length"), "leaf")
    return leaves.withColumn("rank", F.row_number().over(order))


def path_messages(leaves: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(conv_id, leaf, rank, length, id, below): every message of the chosen paths, `below` replies above its leaf.

    From the longest step to the shortest, each message found so far also gives the one that far above it: every
    number of replies is a sum of different powers of two, so each message of a path comes exactly once.
    """
    found = leaves.select("conv_id", "leaf", "rank", "length", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("below"))
    for k in range(len(steps) - 1, -1, -1):
        jump = steps[k].where("up IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("id").alias("i"), "up")
        higher = found.join(jump, _same("conv_id", "c") & (F.col("id") == F.col("i"))).select(
            "conv_id", "leaf", "rank", "length", F.col("up").alias("id"), (F.col("below") + (1 << k)).alias("below")
        )
        found = stage(found.unionByName(higher), "reply-paths")
    return found


def format_paths(paths: DataFrame, messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, leaf, rank, segments, formatted): one row per path.

    segments: array of (text, in_loss) whose texts, put together, are `formatted`.
    """
    said = messages.select(
        F.col("conv_id").alias("c"),
        F.col("id").alias("i"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    met = paths.join(said, _same("conv_id", "c") & (F.col("id") == F.col("i")))
    piece = F.struct(
        (F.col("length") - F.col("below")).alias("place"),
        F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        F.col("role").isin(*loss_roles).alias("in_loss"),
    )
    grouped = met.groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), F.lit(False).alias("in_loss")),
                F.struct(t["body"].alias("text"), t["in_loss"].alias("in_loss")),
                F.struct(F.lit(CLOSE + "\n").alias("text"), F.lit(False).alias("in_loss")),
            ),
        )
    )
    cut = grouped.select("conv_id", "leaf", "rank", segments.alias("segments"))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def conversations(messages: DataFrame, best: int | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted root-to-leaf paths: all of them, or the `best` ones of each conversation by rank."""
    names = ("conv_id", "id", "parent_id", "role", "text", "score")
    row = F.struct("parent_id", "role", "text", "score")
    unique = messages.groupBy("conv_id", "id").agg(F.min(row).alias("m")).select("conv_id", "id", "m.*").select(*names)
    unique = stage(unique.where("id IS NOT NULL"), "replies")
    steps = _steps(unique)
    leaves = ranked_leaves(unique, steps)
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    return format_paths(path_messages(stage(leaves, "reply-leaves"), steps), unique, loss_roles)


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.size(F.split(formatted, r"<\|im_start\|>")))
    return F.transform(
        blocks,
        lambda b: F.struct(
            _unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(
                F.substr(
                    b,
                    F.locate("\n", b) + 1,
                    F.length(b) - F.locate("\n", b) - len(CLOSE) - 1,
                )
            ).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["in_loss"]), lambda s: unescape(s["text"])), "")
