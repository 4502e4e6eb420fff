"""Panel discussion: turns, convergence, transcript facts.

Two rounds at most, so rounds are unrolled into joins; a pair stops taking turns once it has converged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import fixed
from matchloom.functions.rules import strings
from matchloom.functions.text import clamp, one_of
from matchloom.operators.panel import PAIR
from matchloom.settings import DEFAULTS, ScreenSettings
from matchloom.sources.staging import stage

_SEAT = [*PAIR, "agent"]
_TURN = T.StructType(
    [
        T.StructField("stance", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("dimension_scores", T.MapType(T.StringType(), T.StringType())),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("reasoning", T.StringType()),
    ]
)


def parse_turn(raw: Column) -> Column:
    return F.from_json(raw, _TURN)


def merge_dimensions(own: Column, said: Column) -> Column:
    """Own dimension scores, replaced or extended by the numeric ones said, clamped to 0..100."""
    numbers = F.transform_values(
        F.coalesce(said, F.create_map().cast("map<string,string>")),
        lambda _, v: clamp(v.try_cast("double"), 0, 100),
    )
    valid = F.map_filter(
        F.coalesce(said, F.create_map().cast("map<string,string>")),
        lambda _, v: v.try_cast("double").isNotNull(),
    )
    new = F.map_filter(numbers, lambda k, _: F.array_contains(F.map_keys(valid), k))
    kept = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def add_evidence(own: Column, said: Column) -> Column:
    """Own evidence, then new non-blank texts (200 characters), no repeats among the new, three at most."""
    fresh = F.transform(
        F.filter(strings(said), lambda e: e.isNotNull() & (F.trim(e) != "")), lambda e: F.substring(e, 1, 200)
    )
    return F.slice(F.concat(own, F.array_distinct(F.array_except(fresh, own))), 1, 3)


def apply_turns(state: DataFrame, turns: DataFrame, round_no: int) -> DataFrame:
    """State of every expert after one round.

    `state`: pair, agent, score, confidence, dimension_scores, evidence. `turns`: pair, agent, round and
    `turn` (the parsed answer). An expert without an answer keeps everything. A revision needs a number.
    """
    said = turns.where(F.col("round") == round_no).select(*_SEAT, "turn")
    joined = state.join(said, _SEAT, "left")
    number = F.col("turn.score").try_cast("double")
    stance = one_of(F.coalesce(F.col("turn.stance"), F.lit("maintain")), fixed.STANCES, "maintain")
    revises = (stance == "revise") & number.isNotNull()
    score = F.when(revises, clamp(number, 0, 100)).otherwise(clamp(F.col("score"), 0, 100))
    answered = F.col("turn").isNotNull()
    return joined.select(
        *_SEAT,
        F.when(answered, score).otherwise(F.col("score")).alias("score"),
        "confidence",
        F.when(answered, merge_dimensions(F.col("dimension_scores"), F.col("turn.dimension_scores")))
        .otherwise(F.col("dimension_scores"))
        .alias("dimension_scores"),
        F.when(answered, add_evidence(F.col("evidence"), F.col("turn.evidence")))
        .otherwise(F.col("evidence"))
        .alias("evidence"),
        F.when(revises, "revise").otherwise("maintain").alias("stance"),
        F.substring(F.coalesce("turn.reasoning", F.lit("")), 1, 150).alias("reasoning"),
        F.lit(round_no).alias("round"),
        F.round(F.when(answered, score).otherwise(F.col("score")) - F.col("score"), 2).alias("score_delta"),
    )


def _after(state: Column, said: Column) -> dict[str, Column]:
    """What an answer of one round (round, turn) leaves of an expert's state, by the rules of `apply_turns`."""
    turn = said["turn"]
    number = turn["score"].try_cast("double")
    stance = one_of(F.coalesce(turn["stance"], F.lit("maintain")), fixed.STANCES, "maintain")
    revises = F.coalesce((stance == "revise") & number.isNotNull(), F.lit(False))
    score = F.when(revises, clamp(number, 0, 100)).otherwise(clamp(state["score"], 0, 100))
    delta = F.round(score - state["score"], 2)
    told = F.when(revises, "revise").otherwise("maintain")
    step = F.struct(said["round"].cast("int").alias("round"), score.alias("score"), delta.alias("score_delta"), told.alias("stance"))
    return {
        "score": score,
        "dimension_scores": merge_dimensions(state["dimension_scores"], turn["dimension_scores"]),
        "evidence": add_evidence(state["evidence"], turn["evidence"]),
        "reasoning": F.substring(F.coalesce(turn["reasoning"], F.lit("")), 1, 150),
        "history": F.array_append(state["history"], step),
    }


_HISTORY = "array<struct<round:int,score:double,score_delta:double,stance:string>>"


def fold_turns(state: DataFrame, turns: DataFrame) -> DataFrame:
    """State of every expert after all rounds, each on the result of the one before.

    `state` and `turns` as in `apply_turns`. An expert's turns are one group, sorted by round and folded in one pass,
    instead of a join per round. Adds reasoning (of the last answer) and history: (round, score, score_delta, stance) of
    every round with an answer; an expert without answers keeps everything and has no history.
    """
    said = turns.where(F.col("turn").isNotNull()).groupBy(*_SEAT).agg(F.collect_list(F.struct("round", "turn")).alias("_said"))
    kinds = {
        "score": "double",
        "dimension_scores": "map<string,double>",
        "evidence": "array<string>",
        "reasoning": "string",
        "history": _HISTORY,
    }
    first = {
        "score": F.col("score"),
        "dimension_scores": F.col("dimension_scores"),
        "evidence": F.col("evidence"),
        "reasoning": F.lit(""),
        "history": F.array(),
    }

    def typed(fields: dict[str, Column]) -> Column:
        return F.struct(*[fields[n].cast(kind).alias(n) for n, kind in kinds.items()])

    by_round = F.array_sort("_said", lambda a, b: (a["round"] - b["round"]).cast("int"))
    folded = F.aggregate(by_round, typed(first), lambda s, x: typed(_after(s, x)))
    joined = state.join(said, _SEAT, "left")
    done = joined.withColumn("_end", F.coalesce(folded, typed(first)))
    return done.select(*_SEAT, "confidence", *[F.col(f"_end.{n}").alias(n) for n in kinds])


def score_changes(turns: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Change of each expert's score against its previous round (against `initial` in the first)."""
    before = Window.partitionBy(*_SEAT).orderBy("round")
    previous = F.lag("score").over(before)
    if initial is None:
        return turns.withColumn("score_delta", F.round(F.col("score") - previous, 2))
    start = initial.select(*_SEAT, F.col("score").alias("_start"))
    return (
        turns.withColumn("_previous", previous)
        .join(start, _SEAT, "left")
        .withColumn("score_delta", F.round(F.col("score") - F.coalesce("_previous", "_start"), 2))
        .drop("_previous", "_start")
    )


def round_facts(turns: DataFrame, settings: ScreenSettings = DEFAULTS) -> DataFrame:
    """Per (pair, round): mean, population std, largest change and whether the round converged."""
    facts = (
        turns.where(F.col("agent") != fixed.ADVOCATE)
        .groupBy(*PAIR, "round")
        .agg(
            F.avg("score").alias("mean"),
            F.stddev_pop("score").alias("std"),
            F.max(F.abs("score_delta")).alias("max_delta"),
        )
    )
    close = F.col("std") <= settings.debate_std_threshold
    settled = (F.col("round") > 1) & (F.col("max_delta") <= settings.debate_score_delta)
    return facts.withColumn("converged", close | F.coalesce(settled, F.lit(False)))


def convergence(turns: DataFrame, settings: ScreenSettings = DEFAULTS) -> DataFrame:
    """Where the discussion ends: first converged round, else the last allowed one."""
    facts = round_facts(turns, settings).where(F.col("round") <= settings.debate_max_rounds)
    ended = facts.groupBy(*PAIR).agg(
        F.min(F.when(F.col("converged"), F.col("round"))).alias("_at"), F.max("round").alias("_last")
    )
    end = ended.select(
        *PAIR,
        F.coalesce("_at", "_last").alias("round"),
        F.when(F.col("_at").isNotNull(), "converged").otherwise("max_rounds").alias("convergence"),
    )
    return end.join(facts, [*PAIR, "round"]).select(
        *PAIR, F.col("round").alias("rounds"), "convergence",
        F.col("mean").alias("final_mean"), F.col("std").alias("final_std"),
    )


def transcript_meta(panel: DataFrame, turns: DataFrame, initial: DataFrame) -> DataFrame:
    """Rounds, outcome, first and last mean, std and scores of every discussed pair.

    `initial` is the divergence of the pair (mean, std); score maps hold a handful of experts each.
    """

    def score_map(rows: DataFrame, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct("agent", "score")))
        return rows.groupBy(*PAIR).agg(F.map_from_entries(entries).alias(name))

    spoken = turns.where(F.col("agent") != fixed.ADVOCATE)
    rounds = turns.groupBy(*PAIR).agg(
        F.count_distinct(F.when(F.col("agent") != fixed.ADVOCATE, F.col("round"))).alias("rounds"),
        F.bool_or(F.col("agent") == fixed.ADVOCATE).alias("advocate_used"),
    )
    last = spoken.groupBy(*_SEAT).agg(F.max_by("score", "round").alias("score"))
    stats = last.groupBy(*PAIR).agg(
        F.avg("score").alias("final_mean"), F.stddev_pop("score").alias("final_std")
    )
    quiet = panel.where(F.col("agent") == fixed.RULE_BASED_EXPERT).select(*_SEAT, "score")
    end = convergence(turns).select(*PAIR, "convergence")
    return (
        rounds.join(stats, PAIR, "left")
        .join(end, PAIR, "left")
        .join(initial.select(*PAIR, F.col("mean").alias("initial_mean"), F.col("std").alias("initial_std")), PAIR)
        .join(score_map(panel, "initial_scores"), PAIR, "left")
        .join(score_map(last.unionByName(quiet), "final_scores"), PAIR, "left")
        .withColumn("convergence", F.when(F.col("rounds") == 0, "consensus").otherwise(F.col("convergence")))
    )


def turn_requests(state: DataFrame, round_no: int, arguments: DataFrame | None = None) -> DataFrame:
    """(pair, agent, round, request): what a model needs for one expert's turn, as JSON text.

    request: agent, round, score, peers (agent, score, confidence and first evidence of the pair's other experts, by
    name) and argument (the advocate's, empty without one). `arguments`: pair, argument. A pair has a handful of seats.
    """
    card = F.struct("agent", "score", "confidence", F.get("evidence", F.lit(0)).alias("evidence"))
    seats = state.groupBy(*PAIR).agg(F.array_sort(F.collect_list(card)).alias("_seats"))
    rows = state.select(*_SEAT, "score").join(seats, PAIR)
    if arguments is None:
        rows = rows.withColumn("argument", F.lit(""))
    else:
        rows = rows.join(arguments.select(*PAIR, "argument"), PAIR, "left")
    peers = F.filter("_seats", lambda s: s["agent"] != F.col("agent"))
    number = F.lit(round_no).alias("round")
    request = F.to_json(
        F.struct("agent", number, "score", peers.alias("peers"), F.coalesce("argument", F.lit("")).alias("argument"))
    )
    return rows.select(*_SEAT, number, request.alias("request"))


def run_discussion(
    panel: DataFrame,
    turns: DataFrame | None = None,
    settings: ScreenSettings = DEFAULTS,
    staged: bool = False,
    ask: Callable[[DataFrame], DataFrame] | None = None,
    arguments: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(final panel state, transcript) of pairs that discuss; the rule-based expert stays as it is.

    `panel` holds only pairs that need a discussion; `turns`: pair, agent, round, turn (raw JSON text).
    `staged` writes the state between rounds, which several later steps read.

    Without `turns`, `ask` adds the answers as `raw` to `turn_requests` of each round's state, as
    `model_points.ask_panel` does; NULL leaves an expert as it is. Pairs that converged are not asked again, and each
    round is written, so that every seat is asked once a round.
    """
    if (turns is None) == (ask is None):
        raise ValueError("give either turns or ask")
    if turns is not None:
        parsed = turns.withColumn("turn", parse_turn(F.col("turn")))
    carried = ["score", "confidence", "dimension_scores", "evidence"]
    seats = panel.select(*_SEAT, "pos")
    quiet = panel.where(F.col("agent") == fixed.RULE_BASED_EXPERT).select(*_SEAT, "pos", *carried)
    open_state = panel.where(F.col("agent") != fixed.RULE_BASED_EXPERT).select(*_SEAT, *carried)
    closed, transcript = None, None
    for round_no in range(1, settings.debate_max_rounds + 1):
        if ask is not None:
            answers = ask(turn_requests(open_state, round_no, arguments))
            parsed = answers.select(*_SEAT, "round", parse_turn(F.col("raw")).alias("turn"))
        after = apply_turns(open_state, parsed, round_no)
        if staged or ask is not None:
            after = stage(after, f"round-{round_no}")
        said = after.select(*_SEAT, "round", "stance", F.col("reasoning").alias("content"), "score", "score_delta")
        transcript = said if transcript is None else transcript.unionByName(said)
        if round_no == settings.debate_max_rounds:
            ended = after
        else:
            done = round_facts(said, settings).where("converged").select(*PAIR)
            ended = after.join(done, PAIR, "left_semi")
            open_state = after.join(done, PAIR, "left_anti").select(*_SEAT, *carried)
        ended = ended.select(*_SEAT, *carried)
        closed = ended if closed is None else closed.unionByName(ended)
    final = closed.join(seats, _SEAT).unionByName(quiet)
    return final, transcript
