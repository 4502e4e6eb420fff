"""Reciprocal-rank fusion, evidence and the fallback for jobs without recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.ranking import top_k
from matchloom.operators.sizes import only_keys_of, only_owners_of
from matchloom.settings import DEFAULTS

_PAIR = ["tenant_id", "job_id", "candidate_id"]


def best_rank_per_candidate(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*_PAIR).agg(F.min("rank").alias("rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = DEFAULTS.rrf_k, per_chunk: bool = True) -> DataFrame:
    """(tenant, job, candidate, rrf_score): sum of 1 / (k + rank) over all lists.

    A candidate listed with several chunks adds up; `per_chunk=False` counts its best rank per list only.
    """
    chosen = lists if per_chunk else [best_rank_per_candidate(hits) for hits in lists]
    ranks = reduce(DataFrame.unionByName, [hits.select(*_PAIR, "rank") for hits in chosen])
    return ranks.groupBy(*_PAIR).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("rrf_score"))


def evidence(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk texts per (job, candidate) in hit order, blanks dropped. At most k hits exist per job.

    The chunk table is read once and reduced to the hits before it is joined; where it is a view of texts, only those of
    the candidates hit are cut.
    """
    keys = ["tenant_id", "candidate_id", "chunk_index"]
    owned = only_owners_of(chunks.select(*keys, "chunk"), hits, keys[:2])
    texts = only_keys_of(owned, hits, keys).where(F.col("chunk") != "")
    located = hits.join(texts, keys)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "chunk")))
    return located.groupBy(*_PAIR).agg(F.transform(ordered, lambda h: h["chunk"]).alias("evidence"))


def with_fallback(fused: DataFrame, pool: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Add the pool members, score 0, for jobs that recalled nothing.

    A caller that cuts the list by (score, candidate) afterwards may pass its cut as `limit`: the first `limit`
    members are all that the cut can keep, so the result is that of the whole pool.

    `pool`: tenant_id, rule_id, candidate_id. `jobs`: tenant_id, job_id, rule_id.
    """
    unserved = jobs.join(fused, ["tenant_id", "job_id"], "left_anti")
    first = pool.join(unserved.select("tenant_id", "rule_id").distinct(), ["tenant_id", "rule_id"], "left_semi")
    if limit is not None:
        first = top_k(first, ["tenant_id", "rule_id"], [F.asc("candidate_id")], limit, "_pos")
    filled = unserved.select("tenant_id", "job_id", "rule_id").join(first, ["tenant_id", "rule_id"])
    return fused.unionByName(filled.select(*_PAIR, F.lit(0.0).alias("rrf_score")))


def merge_batches(results: DataFrame, score: str = "score") -> DataFrame:
    """Best score per (job, candidate) over batches of one screening.

    With evidence (arrays of texts) and a `batch` number, the evidence of all batches is appended in batch order.
    """
    best = F.max(score).alias(score)
    if "evidence" not in results.columns:
        return results.groupBy(*_PAIR).agg(best)
    # one entry per batch of the pair
    parts = F.array_sort(F.collect_list(F.struct("batch", "evidence")))
    texts = F.flatten(F.transform(parts, lambda p: F.coalesce(p["evidence"], F.array().cast("array<string>"))))
    return results.groupBy(*_PAIR).agg(best, texts.alias("evidence"))
