"""Job-level settings, rerank candidates, scores, thresholds, final list and reasons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed
from matchloom.functions.rules import skill_hit, skill_set, strings
from matchloom.functions.vectors import cosine_score
from matchloom.operators.quality import candidate_limit
from matchloom.operators.ranking import ranked
from matchloom.settings import DEFAULTS, ScreenSettings

_PAIR = ["tenant_id", "job_id", "candidate_id"]


def allowed_overrides(overrides: Column) -> Column:
    """Known keys whose value has the right type; everything else is dropped."""
    known = F.coalesce(overrides, F.create_map().cast("map<string,string>"))

    def keeps(key: Column, value: Column) -> Column:
        test = F.lit(False)
        for name, kind in fixed.OVERRIDE_TYPES.items():
            typed = value.try_cast(kind).isNotNull()
            test = F.when(key == name, typed).otherwise(test)
        return test

    return F.map_filter(known, keeps)


def setting(overrides: Column, name: str, default) -> Column:
    """Job override of a setting, else its global value."""
    kind = fixed.OVERRIDE_TYPES[name]
    return F.coalesce(F.try_element_at(overrides, F.lit(name)).try_cast(kind), F.lit(default).cast(kind))


def job_settings(jobs: DataFrame, settings: ScreenSettings = DEFAULTS) -> DataFrame:
    """(tenant, job) with every retrieval and rerank setting resolved."""
    allowed = allowed_overrides(F.col("screen_overrides"))
    most = F.lit(settings.max_candidates)
    if "max_candidates" in jobs.columns:  # asked for by the request
        most = candidate_limit(F.coalesce(F.col("max_candidates"), most))
    return jobs.select(
        "tenant_id",
        "job_id",
        setting(allowed, "rag_top_k", settings.rag_top_k).alias("rag_top_k"),
        F.lower(setting(allowed, "rerank_mode", settings.rerank_mode)).alias("rerank_mode"),
        setting(allowed, "rerank_pairs_factor", settings.rerank_pairs_factor).alias("pairs_factor"),
        setting(allowed, "rerank_doc_chars", settings.rerank_doc_chars).alias("doc_chars"),
        setting(allowed, "rerank_threshold", settings.rerank_threshold).alias("threshold_cross"),
        setting(allowed, "rerank_threshold_cosine", settings.rerank_threshold_cosine).alias("threshold_cosine"),
        most.alias("max_candidates"),
    )


def default_query(title: Column, skill_graph: Column, requirements: Column, max_skills: int | None = 10) -> Column:
    """Title, first `max_skills` skills (None: all) and first five requirements, blanks dropped."""
    skills = strings(skill_graph)
    parts = F.concat(
        F.array(F.coalesce(title, F.lit(""))),
        skills if max_skills is None else F.slice(skills, 1, max_skills),
        F.slice(strings(requirements), 1, 5),
    )
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def rerank_cut(fused: DataFrame, job_conf: DataFrame, settings: ScreenSettings = DEFAULTS) -> DataFrame:
    """Keep the best max(1, N * factor) fused candidates per job; cosine uses a factor of at least 4."""
    factor = F.when(
        F.col("rerank_mode") == "cosine",
        F.greatest(F.col("pairs_factor"), F.lit(settings.rerank_cosine_min_factor)),
    ).otherwise(F.col("pairs_factor"))
    order = [F.desc("rrf_score"), F.asc("candidate_id")]
    return (
        ranked(fused, ["tenant_id", "job_id"], order, "fused_rank")
        .join(job_conf, ["tenant_id", "job_id"])
        .where(F.col("fused_rank") <= F.greatest(F.lit(1), F.col("max_candidates") * factor))
    )


def rerank_document(evidence: Column, text: Column, chars: Column) -> Column:
    """First evidence chunk, else the candidate's text, cut to `chars`."""
    return F.substring(F.coalesce(F.get(evidence, F.lit(0)), text, F.lit("")), F.lit(1), chars)


def cross_scores(
    cut: DataFrame, evidence: DataFrame, texts: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column]
) -> DataFrame:
    """(tenant, job, candidate, cross_score) of the cut's pairs whose job asks for a cross-encoder.

    The other pairs never reach the scorer. `cut`: pairs with rerank_mode and doc_chars. `evidence`: pairs with an
    array `evidence`. `texts`: tenant_id, candidate_id, text. `queries`: tenant_id, job_id, query.
    """
    document = rerank_document(F.col("evidence"), F.col("text"), F.col("doc_chars"))
    asked = (
        cut.where("rerank_mode = 'cross_encoder'")
        .select(*_PAIR, "doc_chars")
        .join(evidence.select(*_PAIR, "evidence"), _PAIR, "left")
        .join(texts, ["tenant_id", "candidate_id"], "left")
        .join(queries, ["tenant_id", "job_id"], "left")
        .select(*_PAIR, F.coalesce("query", F.lit("")).alias("_query"), document.alias("_document"))
    )
    return asked.select(*_PAIR, scorer(F.col("_query"), F.col("_document")).alias("cross_score"))


def score_pairs(cut: DataFrame) -> DataFrame:
    """Score by the job's mode: cross-encoder score if wanted and present, else cosine, else RRF.

    Needs query_vector, doc_vector and cross_score (each may be NULL). The threshold follows the mode that
    gave the score; an RRF score has none.
    """
    # Fallback pairs of a cross-encoder job carry a cosine score and its threshold.
    cross = F.when(F.col("rerank_mode") == "cross_encoder", F.col("cross_score"))
    cos = cosine_score(F.col("query_vector"), F.col("doc_vector"))
    mode = F.when(cross.isNotNull(), "cross_encoder").when(F.col("_cos").isNotNull(), "cosine").otherwise("rrf")
    scored = cut.withColumn("_cos", cos).withColumns(
        {"score_mode": mode, "score": F.coalesce(cross, F.col("_cos"), F.col("rrf_score"))}
    )
    threshold = F.when(F.col("score_mode") == "cross_encoder", F.col("threshold_cross")).when(
        F.col("score_mode") == "cosine", F.col("threshold_cosine")
    )
    return scored.where(threshold.isNull() | (F.col("score") >= threshold)).drop("_cos")


def final_list(scored: DataFrame, settings: ScreenSettings = DEFAULTS) -> DataFrame:
    """Best N per job by score; ties keep the fused order. N is the job's `max_candidates` where that column is."""
    rounded = scored.withColumn("score", F.round("score", 4))
    order = [F.desc("score"), F.asc("fused_rank")]
    most = F.col("max_candidates") if "max_candidates" in scored.columns else F.lit(settings.max_candidates)
    return ranked(rounded, ["tenant_id", "job_id"], order).where(F.col("rank") <= most)


def evidence_excerpts(evidence: Column) -> Column:
    return F.transform(F.slice(strings(evidence), 1, 3), lambda e: F.substring(e, 1, 200))


def reasons(skill_graph: Column, skills: Column, excerpts: Column) -> Column:
    """Up to five matched skills and the head of the first evidence, as texts."""
    first = F.get(excerpts, F.lit(0))
    text = F.lower(F.coalesce(first, F.lit("")))
    # one set of skills and one text for all tags
    known = F.array(F.struct(skill_set(skills).alias("skills"), text.alias("text")))
    matched = F.transform(
        known, lambda k: F.filter(strings(skill_graph), lambda tag: skill_hit(tag, k["skills"], k["text"]))
    )[0]
    by_skill = F.when(
        F.size(matched) > 0,
        F.concat(F.lit(fixed.REASON_SKILLS), F.array_join(F.slice(matched, 1, 5), ", ")),
    )
    by_text = F.when(first.isNotNull(), F.concat(F.lit(fixed.REASON_EVIDENCE), F.substring(first, 1, 80)))
    return F.filter(F.array(by_skill, by_text), lambda r: r.isNotNull())
