"""Coarse screening of all jobs in one plan: rules, two recalls, fusion, rerank, top N, reasons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators import fusion, rerank
from matchloom.operators.dense import dense_search
from matchloom.operators.hard_filter import (
    candidate_facts,
    distinct_rules,
    hard_filter_pool,
    job_rules,
)
from matchloom.operators.sizes import only_owners_of
from matchloom.operators.sparse import bm25_search
from matchloom.settings import DEFAULTS, ScreenSettings
from matchloom.sources.staging import stage

_JOB = ["tenant_id", "job_id"]
_PAIR = ["tenant_id", "job_id", "candidate_id"]


@dataclass(frozen=True)
class ScreenInputs:
    """Tables of one screening. Vectors and cross-encoder scores are model outputs given as columns.

    jobs: tenant_id, job_id, title, query (may be NULL), hard_requirements, skill_graph, screen_overrides;
        optional max_candidates (N of the job's request).
    candidates: tenant_id, candidate_id, resume_text, structured.
    chunks: tenant_id, candidate_id, chunk_index, chunk, embedding.
    job_vectors: tenant_id, job_id, vector (of the expanded query text, else of the query).
    cross_scores: tenant_id, job_id, candidate_id, cross_score; optional.
    """

    jobs: DataFrame
    candidates: DataFrame
    chunks: DataFrame
    job_vectors: DataFrame
    cross_scores: DataFrame | None = None


def search_queries(jobs: DataFrame) -> DataFrame:
    """Add the query for the sparse side and the expanded text for the dense side."""
    asked = F.nullif(F.col("query"), F.lit("")) if "query" in jobs.columns else F.lit(None).cast("string")
    default = rerank.default_query(F.col("title"), F.col("skill_graph"), F.col("hard_requirements"))
    query = F.coalesce(asked, default)
    expanded = F.nullif(F.col("expanded_query"), F.lit("")) if "expanded_query" in jobs.columns else None
    return jobs.withColumns(
        {"query": query, "dense_query": query if expanded is None else F.coalesce(expanded, query)}
    )


def coarse_screen(
    inputs: ScreenInputs,
    settings: ScreenSettings = DEFAULTS,
    as_of_year: int | None = None,
    staged: bool = True,
    prune: bool = True,
    include_nonmatching: bool = False,
    scorer: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(tenant, job, candidate, rank, score, score_mode, rrf_score, evidence, reasons), top N per job.

    `scorer` maps (query, rerank document) to a score from 0 to 1, as `model_points.pair_scorer` does. It is asked
    after the rerank cut, for pairs of cross-encoder jobs only, and takes the place of `inputs.cross_scores`; a pair
    that it answers with NULL falls back to cosine.

    `prune` spares the sparse recall the pairs of frequent tokens; the list is the same without it.
    `include_nonmatching` lists pool members without any query token behind the matching ones.
    """
    jobs = inputs.jobs
    if scorer is not None and inputs.cross_scores is not None:
        raise ValueError("give either a scorer or cross_scores")
    if "screen_overrides" not in jobs.columns:
        jobs = jobs.withColumn("screen_overrides", F.lit(None).cast("map<string,string>"))
    jobs = job_rules(search_queries(jobs))
    conf = rerank.job_settings(jobs, settings)
    job_rule = jobs.select("tenant_id", "job_id", "rule_id")

    pool = hard_filter_pool(distinct_rules(jobs), candidate_facts(inputs.candidates, as_of_year))
    if staged:
        pool = stage(pool, "pool")

    # Per-job top_k may differ: recall to the greatest, then cut per job.
    k = conf.agg(F.max("rag_top_k")).first()[0] or settings.rag_top_k
    docs = inputs.candidates.select("tenant_id", "candidate_id", F.col("resume_text").alias("text"))
    queries = jobs.select("tenant_id", "job_id", "rule_id", "query")
    sparse = bm25_search(
        docs, queries, k, pool=pool, settings=settings, prune=prune, include_nonmatching=include_nonmatching
    )
    # A job whose pool is empty stops before recall.
    open_rules = pool.select("tenant_id", "rule_id").distinct()
    open_jobs = job_rule.join(open_rules, ["tenant_id", "rule_id"], "left_semi")
    vectors = inputs.job_vectors.join(open_jobs.select(*_JOB), _JOB, "left_semi")
    dense = dense_search(vectors, inputs.chunks, k)
    if staged:
        sparse, dense = stage(sparse, "sparse-hits"), stage(dense, "dense-hits")
    per_job_k = conf.select(*_JOB, "rag_top_k")
    sparse, dense = (
        hits.join(per_job_k, _JOB).where(F.col("rank") <= F.col("rag_top_k")).drop("rag_top_k")
        for hits in (sparse, dense)
    )

    fused = fusion.reciprocal_rank_fusion([dense, sparse], settings.rrf_k)
    # The whole pool of a job without recall: the cut below keeps no more than its first members.
    factor = F.greatest(F.col("pairs_factor"), F.lit(settings.rerank_cosine_min_factor))
    most = conf.agg(F.max(F.col("max_candidates") * factor)).first()[0] or 1
    fused = fusion.with_fallback(fused, pool, open_jobs, max(1, int(most)))
    evidence = fusion.evidence(dense, inputs.chunks)
    # The cut counts every fused candidate; those outside the job's pool drop out after it.
    cut = rerank.rerank_cut(fused, conf, settings)
    cut = cut.join(job_rule, _JOB).join(pool, ["tenant_id", "rule_id", "candidate_id"], "left_semi")
    if staged:
        cut = stage(cut, "rerank-pairs")

    # Document vector: that of the candidate's best chunk hit, else of its first chunk. From here on the
    # large tables are reduced to the candidates of the cut before anything else happens to them.
    owner = ["tenant_id", "candidate_id"]
    best_chunk = dense.groupBy(*_PAIR).agg(F.min_by("chunk_index", "rank").alias("hit_chunk"))
    vectors = only_owners_of(
        inputs.chunks.select(*owner, "chunk_index", F.col("embedding").alias("doc_vector")), cut, owner
    )
    if staged:
        vectors = stage(vectors, "candidate-vectors")
    first_chunk = vectors.groupBy(*owner).agg(F.min("chunk_index").alias("first_chunk"))
    pairs = (
        cut.join(evidence, _PAIR, "left")
        .join(best_chunk, _PAIR, "left")
        .join(first_chunk, owner, "left")
        .withColumn("chunk_index", F.coalesce("hit_chunk", "first_chunk"))
        .join(vectors, [*owner, "chunk_index"], "left")
        .join(inputs.job_vectors.select(*_JOB, F.col("vector").alias("query_vector")), _JOB, "left")
    )
    cross_scores = inputs.cross_scores
    if scorer is not None:
        texts = only_owners_of(docs, cut.where("rerank_mode = 'cross_encoder'"), owner)
        cross_scores = rerank.cross_scores(cut, evidence, texts, queries.select(*_JOB, "query"), scorer)
        if staged:
            cross_scores = stage(cross_scores, "cross-scores")
    if cross_scores is None:
        pairs = pairs.withColumn("cross_score", F.lit(None).cast("double"))
    else:
        pairs = pairs.join(cross_scores, _PAIR, "left")
    listed = rerank.final_list(rerank.score_pairs(pairs), settings)

    excerpts = rerank.evidence_excerpts(F.col("evidence"))
    profile = only_owners_of(
        inputs.candidates.select(*owner, F.col("structured.skills").alias("_skills")), cut, owner
    )
    return (
        listed.join(jobs.select(*_JOB, "skill_graph"), _JOB)
        .join(profile, owner)
        .select(
            *_PAIR, "rank", "score", "score_mode", "rrf_score",
            excerpts.alias("evidence"),
            rerank.reasons(F.col("skill_graph"), F.col("_skills"), excerpts).alias("reasons"),
        )
    )


def screen_summary(
    jobs: DataFrame, candidates: DataFrame, listed: DataFrame, cached: DataFrame, batch_size: int = DEFAULTS.batch_size
) -> DataFrame:
    """Per job: pool size, batches, accepted candidates and how many of them have a cached verdict.

    The candidates come in the batches named by a column `batch`, else in pages of `batch_size`.
    """
    pool_size = F.count(F.lit(1))
    if "batch" in candidates.columns:
        batches = F.count_distinct("batch")
    else:
        batches = F.ceil(pool_size / batch_size).cast("bigint")
    sizes = candidates.groupBy("tenant_id").agg(pool_size.alias("pool_size"), batches.alias("batches"))
    hits = listed.join(cached.select(*_PAIR).distinct().withColumn("_hit", F.lit(1)), _PAIR, "left")
    counts = hits.groupBy(*_JOB).agg(
        F.count(F.lit(1)).alias("accepted"), F.count("_hit").alias("cache_hits")
    )
    zero = F.lit(0).cast("bigint")
    return (
        jobs.select(*_JOB)
        .join(sizes, "tenant_id", "left")
        .join(counts, _JOB, "left")
        .select(
            *_JOB,
            F.coalesce("pool_size", zero).alias("pool_size"),
            F.coalesce("batches", zero).alias("batches"),
            F.coalesce("accepted", zero).alias("accepted"),
            F.coalesce("cache_hits", zero).alias("cache_hits"),
        )
    )
