"""Panel of experts: weights, raw scores, divergence, arbitration, evidence, reports.

Panel rows are long: tenant_id, job_id, candidate_id, agent, score, confidence, dimension_scores (map),
evidence (array, three texts at most) and `pos`, a whole number that orders the results of a panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import fixed
from matchloom.functions import rules
from matchloom.functions.text import clamp, to_float
from matchloom.operators.ranking import top_k
from matchloom.operators.sizes import broadcast_if_small, many_tasks
from matchloom.settings import DEFAULTS, ScreenSettings

PAIR = ["tenant_id", "job_id", "candidate_id"]
# Panel rows whose parts of reports one task joins; it sorts all parts at once.
ROWS_PER_TASK = 250_000

_RAW = T.StructType(
    [
        T.StructField("score", T.StringType()),
        T.StructField("dimension_scores", T.MapType(T.StringType(), T.StringType())),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.StringType()),
    ]
)


# --- model output ---


def is_json_object(raw: Column) -> Column:
    """Whether a model answer is a JSON object; bad JSON and other values are not."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def dimension_map(values: Column) -> Column:
    known = F.coalesce(values, F.create_map().cast("map<string,string>"))
    return F.transform_values(known, lambda _, v: clamp(to_float(v, 0), 0, 100))


def short_evidence(values: Column) -> Column:
    present = F.filter(rules.strings(values), lambda e: e.isNotNull() & (F.trim(e) != ""))
    return F.slice(F.transform(present, lambda e: F.substring(e, 1, 200)), 1, 3)


def parse_panel_answer(raw: Column, default_confidence: float = DEFAULTS.default_confidence) -> Column:
    """Struct(score, dimension_scores, evidence, confidence) of a raw answer; every field has a fallback."""
    answer = F.from_json(raw, _RAW)
    confidence = clamp(to_float(answer["confidence"], default_confidence), 0, 1)
    return F.struct(
        clamp(to_float(answer["score"], 0), 0, 100).alias("score"),
        dimension_map(answer["dimension_scores"]).alias("dimension_scores"),
        short_evidence(answer["evidence"]).alias("evidence"),
        F.when(confidence == 0, F.lit(default_confidence)).otherwise(confidence).alias("confidence"),
    )


def visual_score(similarity: Column) -> Column:
    """Panel score of a visual similarity column."""
    return F.least(F.lit(100.0), similarity * 100.0)


def stability_rows(candidates: DataFrame, as_of_year: int, keys: list[str]) -> DataFrame:
    """Rule-based expert: one panel row per candidate from the structured work experience."""
    spans = rules.job_spans(F.col("structured.work_experience"), F.lit(as_of_year))
    verdict = rules.stability(spans)
    return candidates.select(*keys, verdict.alias("v")).select(*keys, "v.*")


# --- roster and weights ---


def category_weights(category: Column) -> Column:
    """Map expert -> weight of a category; unknown categories count as general."""

    def literal(weights: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])

    chosen = literal(fixed.PANEL_WEIGHTS[fixed.DEFAULT_CATEGORY])
    for name, weights in fixed.PANEL_WEIGHTS.items():
        chosen = F.when(category == name, literal(weights)).otherwise(chosen)
    return chosen


def panel_roster(category: Column) -> Column:
    """Names of the experts on a category's panel, in panel order."""
    return F.map_keys(category_weights(category))


def resolve_weights(category: Column, override: Column) -> Column:
    """Arbitration weights of a job: the override if all of it is valid, else those of the category.

    A valid override names only experts of the panel and gives positive numbers; experts it leaves out get
    0 and the rest is scaled to sum 1 (6 digits).
    """
    base = category_weights(category)
    values = F.transform_values(override, lambda _, w: w.try_cast("double"))
    valid = (
        override.isNotNull()
        & (F.size(F.map_keys(override)) > 0)
        & (F.size(F.array_except(F.map_keys(override), F.map_keys(base))) == 0)
        & ~F.exists(F.map_values(values), lambda w: w.isNull() | (w <= 0))
    )
    total = F.aggregate(F.map_values(values), F.lit(0.0), lambda a, w: a + w)
    scaled = F.transform_values(
        base, lambda k, _: F.round(F.coalesce(F.try_element_at(values, k), F.lit(0.0)) / total, 6)
    )
    return F.when(valid, scaled).otherwise(base)


# --- divergence ---


def divergence(panel: DataFrame, settings: ScreenSettings = DEFAULTS) -> DataFrame:
    """Mean (weighted by confidence), population std and whether the panel must discuss.

    The rule-based expert does not count; with one expert or none left there is nothing to discuss.
    """
    voted = panel.where(F.col("agent") != fixed.RULE_BASED_EXPERT)
    w = F.greatest(F.col("confidence"), F.lit(0.1))
    stats = voted.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_experts"),
        (F.sum(F.col("score") * w) / F.sum(w)).alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.min("score").alias("min_score"),
    )
    several = F.col("n_experts") > 1
    std = F.when(several, F.col("std")).otherwise(F.lit(0.0))
    return stats.select(
        *PAIR,
        "n_experts",
        "mean",
        std.alias("std"),
        (several & (std > settings.debate_std_threshold)).alias("needs_discussion"),
        (F.col("min_score") >= settings.advocate_threshold).alias("needs_advocate"),
    )


# --- arbitration and reports ---


def _weighted(panel: DataFrame, weights: DataFrame) -> DataFrame:
    """Panel rows with their job's weights; those of the general category where the job has none.

    Few weights are broadcast: dealt by job, all rows of a job would meet in one task.
    """
    general = category_weights(F.lit(fixed.DEFAULT_CATEGORY))
    known = broadcast_if_small(weights.select("tenant_id", "job_id", "weights"))
    return panel.join(known, ["tenant_id", "job_id"], "left").withColumn("weights", F.coalesce("weights", general))


def arbitrate(panel: DataFrame, weights: DataFrame, digits: int = 1) -> DataFrame:
    """Overall score per pair: sum(w*c*s) / sum(w*c), c clamped to 0.1..1, experts without weight ignored.

    `weights`: tenant_id, job_id, weights (map). Pairs whose weights sum to 0 score 0; a job without a row has
    the general weights.
    """
    joined = _weighted(panel, weights).withColumn("w", F.try_element_at("weights", F.col("agent")))
    wc = F.col("w") * clamp(F.col("confidence"), 0.1, 1.0)
    sums = joined.groupBy(*PAIR).agg(F.sum(wc * F.col("score")).alias("num"), F.sum(wc).alias("den"))
    score = F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.lit(0.0))
    return sums.select(*PAIR, F.round(score, digits).alias("overall_score"))


def dimension_means(panel: DataFrame, weights: DataFrame, digits: int = 1) -> DataFrame:
    """Mean per (pair, dimension) over the experts registered in the job's weights, in long form."""
    registered = _weighted(panel, weights).where(F.try_element_at("weights", F.col("agent")).isNotNull())
    return (
        registered.select(*PAIR, F.explode("dimension_scores").alias("dimension", "value"))
        .groupBy(*PAIR, "dimension")
        .agg(F.round(F.avg("value"), digits).alias("value"))
    )


def merged_evidence(panel: DataFrame, limit: int = 5) -> DataFrame:
    """(pair, rank, text): first occurrence of each text, best confidence first, at most `limit`."""
    texts = panel.select(*PAIR, "pos", "confidence", F.posexplode("evidence").alias("idx", "text")).where(
        F.coalesce("text", F.lit("")) != ""
    )
    # At most three texts per result: position and index make one number, which keeps the aggregate hashed.
    at = F.col("pos").cast("bigint") * 4 + F.col("idx")
    first = texts.groupBy(*PAIR, "text").agg(
        F.min(at).alias("at"), F.min_by("confidence", at).alias("confidence")
    )
    return top_k(first, PAIR, [F.desc("confidence"), F.asc("at")], limit).drop("at")


def _by_pos(a: Column, b: Column) -> Column:
    # Structs with a map have no natural order, so compare the position only.
    return F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)


def reports(panel: DataFrame, weights: DataFrame, digits: int = 1) -> DataFrame:
    """One report per pair: overall score, dimension map, merged evidence, expert details.

    The parts of the reports of a large panel are dealt by pair to tasks of bounded rows, which join them.
    """
    tasks = many_tasks(panel, ROWS_PER_TASK)

    def by_pair(part: DataFrame) -> DataFrame:
        return part if tasks is None else part.repartition(tasks, *PAIR)

    dims = dimension_means(panel, weights, digits).groupBy(*PAIR).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "value")))).alias("dimension_scores")
    )
    texts = merged_evidence(panel).groupBy(*PAIR).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda e: e["text"]).alias("evidence")
    )
    fields = ["agent", "score", "confidence", "dimension_scores", "evidence"]
    # A panel has a handful of experts, so the list stays small.
    details = panel.groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("pos", *fields)), _by_pos).alias("agent_details")
    )
    return (
        by_pair(arbitrate(panel, weights, digits))
        .join(by_pair(dims), PAIR, "left")
        .join(by_pair(texts), PAIR, "left")
        .join(by_pair(details), PAIR, "left")
        .withColumns(
            {
                "dimension_scores": F.coalesce(
                    "dimension_scores", F.create_map().cast("map<string,double>")
                ),
                "evidence": rules.strings(F.col("evidence")),
            }
        )
    )


def recommendation_input(reports_: DataFrame) -> DataFrame:
    """The texts a recommendation model reads: experts with scores, and the top three evidence texts."""
    experts = F.array_join(
        F.transform("agent_details", lambda d: F.format_string("%s=%.0f分", d["agent"], d["score"])), "; "
    )
    top = F.array_join(F.slice("evidence", 1, 3), " | ")
    return reports_.select(
        *PAIR, "overall_score", experts.alias("experts"), F.coalesce(F.nullif(top, F.lit("")), F.lit("无")).alias("evidence")
    )


def report_from_cache(cached: DataFrame) -> DataFrame:
    """Cached verdicts in the shape of fresh reports: missing fields get defaults, bad details drop out."""
    details = F.filter(
        F.col("agent_details"),
        lambda d: d["agent"].isNotNull() & d["score"].between(0, 100) & F.coalesce(d["confidence"], F.lit(0.7)).between(0, 1),
    )
    return cached.select(
        *PAIR,
        F.coalesce(F.col("overall_score").cast("double"), F.lit(0.0)).alias("overall_score"),
        F.coalesce("dimension_scores", F.create_map().cast("map<string,double>")).alias("dimension_scores"),
        F.coalesce("recommendation_text", F.lit("")).alias("recommendation_text"),
        rules.strings(F.col("evidence")).alias("evidence"),
        F.coalesce(details, F.expr("filter(agent_details, d -> false)")).alias("agent_details"),
    )
