"""Settings of a screening run; job-level overrides replace some of them per job."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScreenSettings:
    batch_size: int = 200
    # retrieval
    rag_top_k: int = 30
    rrf_k: int = 60
    chunk_size: int = 500
    chunk_overlap: int = 50
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_delta: float = 1.0
    # rerank
    rerank_mode: str = "cosine"
    rerank_pairs_factor: int = 2
    rerank_cosine_min_factor: int = 4
    rerank_doc_chars: int = 400
    rerank_threshold: float = 0.4
    rerank_threshold_cosine: float = 0.55
    max_candidates: int = 10
    max_candidates_cap: int = 50
    # panel
    debate_std_threshold: float = 12.0
    debate_max_rounds: int = 2
    debate_score_delta: float = 3.0
    advocate_threshold: float = 80.0
    default_confidence: float = 0.7
    # money, per million tokens
    price_prompt_per_m: float = 0.27
    price_completion_per_m: float = 1.10
    # feedback
    preference_delta: float = 0.05
    preference_clamp: float = 0.15


DEFAULTS = ScreenSettings()
