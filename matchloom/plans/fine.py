"""Fine screening: reuse, panel scores, discussion, arbitration and the rows to store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators import panel as P
from matchloom.operators.discussion import run_discussion, transcript_meta
from matchloom.operators.incremental import upsert
from matchloom.settings import DEFAULTS, ScreenSettings
from matchloom.sources.staging import stage

PAIR = P.PAIR
_RESULT_KEY = PAIR
_RESULT_KEEP = ["id", "created_at"]


def job_weights(jobs: DataFrame, category: str = "job_category", override: str = "weights_override") -> DataFrame:
    """tenant_id, job_id, weights."""
    return jobs.select(
        "tenant_id", "job_id", P.resolve_weights(F.col(category), F.col(override)).alias("weights")
    )


def split_cached(listed: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached verdicts of listed pairs, listed pairs that need the panel)."""
    pairs = listed.select(*PAIR)
    return cached.join(pairs, PAIR, "left_semi"), pairs.join(cached.select(*PAIR), PAIR, "left_anti")


_DETAIL = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("agent", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("dimension_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("evidence", T.ArrayType(T.StringType())),
    ]
)


def _same_details(reports: DataFrame) -> DataFrame:
    """Expert details of one type, whatever fields the stored ones have; without any: NULL."""
    known = reports.schema["agent_details"].dataType.elementType.names

    def full(d: Column) -> Column:
        fields = [(d[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in _DETAIL]
        return F.struct(*fields)

    return reports.withColumn("agent_details", F.transform("agent_details", full))


def discussions(panel: DataFrame, transcript: DataFrame, initial: DataFrame) -> DataFrame:
    """(pair, discussion): the turns in order of round and expert, and the meta data of the discussion.

    A pair has at most as many turns as experts times rounds.
    """
    turn = F.struct("round", "agent", "stance", "content", "score", "score_delta")
    turns = transcript.groupBy(*PAIR).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    meta = transcript_meta(panel, transcript, initial)
    named = meta.select(*PAIR, F.struct(*[c for c in meta.columns if c not in PAIR]).alias("meta"))
    return turns.join(named, PAIR, "left").select(*PAIR, F.struct("turns", "meta").alias("discussion"))


def fine_screen(
    panel: DataFrame,
    turns: DataFrame,
    weights: DataFrame,
    cached: DataFrame | None = None,
    settings: ScreenSettings = DEFAULTS,
    digits: int = 1,
    staged: bool = True,
    recommend: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Reports of all pairs: fresh ones from the panel, cached ones passed through unchanged.

    Panel rows with an `error` are left out; a pair without any good row gives a row with `failed`. Both kinds have
    expert details, `discussion` (NULL without one, and for cached pairs) and `recommendation_text`: for fresh pairs
    that of `recommend`, a function from reports to (pair, recommendation_text), else empty.
    `staged` writes the tables that several steps read, instead of deriving them again for each.
    """
    keep = stage if staged else lambda df, _: df
    good = panel.where(F.col("error").isNull()) if "error" in panel.columns else panel
    initial = keep(P.divergence(good, settings).where("needs_discussion"), "debated")
    debated = initial.select(*PAIR)
    argued = good.join(debated, PAIR, "left_semi")
    final, transcript = run_discussion(argued, turns, settings, staged)
    columns = [*PAIR, "agent", "pos", "score", "confidence", "dimension_scores", "evidence"]
    settled = good.join(debated, PAIR, "left_anti").select(*columns).unionByName(final.select(*columns))
    settled = keep(settled, "settled-panel")
    fresh = _same_details(P.reports(settled, weights, digits))
    fresh = fresh.join(keep(discussions(argued, transcript, initial), "discussions"), PAIR, "left")
    if recommend is None:
        fresh = fresh.withColumn("recommendation_text", F.lit(""))
    else:
        texts = recommend(fresh).select(*PAIR, "recommendation_text")
        fresh = fresh.join(texts, PAIR, "left").withColumn(
            "recommendation_text", F.coalesce("recommendation_text", F.lit(""))
        )
    fresh = fresh.withColumns({"cached": F.lit(False), "failed": F.lit(False)})
    if "error" in panel.columns:
        failed = panel.select(*PAIR).distinct().join(good.select(*PAIR), PAIR, "left_anti")
        fresh = fresh.unionByName(
            failed.withColumns({"cached": F.lit(False), "failed": F.lit(True)}), allowMissingColumns=True
        )
    if cached is None:
        return fresh
    none = F.lit(None).cast(fresh.schema["discussion"].dataType)
    reused = _same_details(P.report_from_cache(cached)).withColumns(
        {"discussion": none, "cached": F.lit(True), "failed": F.lit(False)}
    )
    return fresh.unionByName(reused.select(*fresh.columns))


def result_rows(
    reports: DataFrame, candidates: DataFrame, jobs: DataFrame, task_id: Column, now: Column
) -> DataFrame:
    """Rows to store: expert details, turns and meta folded into the discussion JSON, both fingerprints attached."""
    profile = candidates.select("tenant_id", "candidate_id", "profile_hash")
    config = jobs.select("tenant_id", "job_id", "config_hash")
    parts = [F.col("agent_details")]
    if "discussion" in reports.columns:
        parts += [F.col("discussion.turns").alias("turns"), F.col("discussion.meta").alias("meta")]
    discussion = F.to_json(F.struct(*parts))
    text = F.col("recommendation_text") if "recommendation_text" in reports.columns else F.lit("")
    return (
        reports.join(profile, ["tenant_id", "candidate_id"], "left")
        .join(config, ["tenant_id", "job_id"], "left")
        .select(
            F.uuid().alias("id"), *PAIR, task_id.alias("task_id"), "overall_score", "dimension_scores",
            "evidence", text.alias("recommendation_text"), discussion.alias("discussion_json"),
            "profile_hash", "config_hash",
            now.alias("created_at"), now.alias("updated_at"),
        )
    )


def store_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (tenant, job, candidate): the id and creation time of a known pair stay."""
    return upsert(old, new, _RESULT_KEY, _RESULT_KEEP)
