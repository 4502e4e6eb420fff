import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions.model_points import pair_scorer
from matchloom.operators import fusion, rerank
from matchloom.operators.dense import dense_search
from matchloom.operators.hard_filter import distinct_rules, job_rules
from matchloom.operators.sparse import bm25_search
from matchloom.plans.screening import ScreenInputs, coarse_screen, screen_summary
from tests.test_rules import candidates

WORDS = "python java go spark sql rust data 机 器 cloud".split()


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [("t" if i % 3 else "u", i, " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))) for i in range(n)]


def brute_bm25(docs, queries, k, nonmatching=False):
    """Straightforward scoring of every document for every query."""
    out = set()
    for tenant, job, text in queries:
        mine = [(cid, body.split()) for t, cid, body in docs if t == tenant]
        avgdl = sum(len(b) for _, b in mine) / len(mine)
        scored = []
        for cid, body in mine:
            total, matched = 0.0, False
            for q in text.split():
                df = sum(q in b for _, b in mine)
                if not df:
                    continue
                tf = body.count(q)
                matched |= tf > 0
                idf = math.log((len(mine) + 1) / df)
                part = tf * 2.5 / (1.5 * (0.25 + 0.75 * len(body) / avgdl) + tf)
                total += idf * (1 + part) if (tf or nonmatching) else 0.0
            if round(total, 6) > 0 and (matched or nonmatching):
                scored.append((-round(total, 6), cid))
        out |= {(job, rank + 1, cid) for rank, (_, cid) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("nonmatching", [False, True])
@pytest.mark.parametrize("max_terms", [500_000, 3])
def test_bm25_equals_brute_force(spark, nonmatching, max_terms):
    docs = corpus(40)
    queries = [("t", 1, "python sql"), ("u", 2, "机 rust rust"), ("t", 3, "cloud missing"), ("t", 4, "missing")]
    found = bm25_search(
        spark.createDataFrame(docs, "tenant_id string, candidate_id long, text string"),
        spark.createDataFrame(queries, "tenant_id string, job_id long, query string"),
        k=7, include_nonmatching=nonmatching, max_broadcast_terms=max_terms,
    )
    got = {(r["job_id"], r["rank"], r["candidate_id"]) for r in found.collect()}
    assert got == brute_bm25(docs, queries, 7, nonmatching)


@pytest.mark.parametrize("k", [1, 3, 8])
@pytest.mark.parametrize("pooled", [False, True])
def test_pruning_changes_nothing(spark, k, pooled):
    rng = random.Random(8)
    # Two words in nearly every document, the others ever rarer.
    words = ["the", "a"] + [f"w{i}" for i in range(40)]
    weights = [40, 30] + [30 / (i + 1) for i in range(40)]
    docs = [("t", i, " ".join(rng.choices(words, weights, k=rng.randint(3, 25)))) for i in range(300)]
    members = [d for d in docs if not pooled or d[1] % 3]
    queries = [("t", j, " ".join(rng.choices(words, weights, k=8) + ["the", "a"])) for j in range(6)]
    table = spark.createDataFrame([(*q, "r") for q in queries], "tenant_id string, job_id long, query string, rule_id string")
    pool = spark.createDataFrame([(t, "r", c) for t, c, _ in members], "tenant_id string, rule_id string, candidate_id long")
    found = bm25_search(
        spark.createDataFrame(docs, "tenant_id string, candidate_id long, text string"),
        table if pooled else table.drop("rule_id"), k=k, pool=pool if pooled else None, prune=True,
    )
    got = {(r["job_id"], r["rank"], r["candidate_id"]) for r in found.collect()}
    assert got == brute_bm25(members, queries, k)


def test_bm25_first_hit(spark):
    docs = [("t", 0, "Python 机器学习 深度学习"), ("t", 1, "Java Spring 微服务"), ("t", 2, "Python Go 后端")]
    found = bm25_search(
        spark.createDataFrame(docs, "tenant_id string, candidate_id long, text string"),
        spark.createDataFrame([("t", 1, "Python")], "tenant_id string, job_id long, query string"), k=3,
    ).orderBy("rank").collect()
    assert found[0]["candidate_id"] in (0, 2) and {r["candidate_id"] for r in found} == {0, 2}


def test_bm25_pool_statistics(spark):
    docs = corpus(30)
    members = [d for d in docs if d[1] % 2 == 0]
    schema = "tenant_id string, candidate_id long, text string"
    queries = spark.createDataFrame([("t", 1, "r", "python sql")], "tenant_id string, job_id long, rule_id string, query string")
    pool = spark.createDataFrame([(t, "r", c) for t, c, _ in members], "tenant_id string, rule_id string, candidate_id long")
    found = bm25_search(spark.createDataFrame(docs, schema), queries, k=5, pool=pool)
    got = {(r["job_id"], r["rank"], r["candidate_id"]) for r in found.collect()}
    assert got == brute_bm25(members, [("t", 1, "python sql")], 5)


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_dense_equals_brute_force(spark, max_bytes):
    rng = np.random.default_rng(3)
    # Few distinct vectors, so that ties are common.
    pool = rng.normal(size=(9, 6)).astype("float32")
    chunks = [("t" if i % 4 else "u", i // 2, i % 2, pool[i % 9].tolist()) for i in range(60)]
    queries = [("t" if j % 2 else "u", j, rng.normal(size=6).astype("float32").tolist()) for j in range(5)]
    found = dense_search(
        spark.createDataFrame(queries, "tenant_id string, job_id long, vector array<float>"),
        spark.createDataFrame(chunks, "tenant_id string, candidate_id long, chunk_index int, embedding array<float>").repartition(3),
        k=4, max_broadcast_bytes=max_bytes, block_bytes=96, group_rows=7,
    )
    got = {(r["job_id"], r["rank"], r["candidate_id"], r["chunk_index"]) for r in found.collect()}
    expected = set()
    for tenant, job, vector in queries:
        q = np.array(vector, dtype="float64")
        scored = []
        for t, cid, index, emb in chunks:
            if t == tenant:
                e = np.array(emb, dtype="float64")
                scored.append((-round(float(q @ e / np.linalg.norm(q) / np.linalg.norm(e)), 6), cid, index))
        expected |= {(job, i + 1, c, x) for i, (_, c, x) in enumerate(sorted(scored)[:4])}
    assert got == expected


def hits(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, job_id int, candidate_id string, rank int")


def test_fusion_adds_up_chunks(spark):
    dense = hits(spark, [("t", 1, "a", 1), ("t", 1, "a", 3), ("t", 1, "b", 2)])
    sparse = hits(spark, [("t", 1, "a", 2)])
    scores = {r["candidate_id"]: r["rrf_score"] for r in fusion.reciprocal_rank_fusion([dense, sparse]).collect()}
    assert scores == {"a": round(1 / 61 + 1 / 63 + 1 / 62, 6), "b": round(1 / 62, 6)}
    best = fusion.reciprocal_rank_fusion([dense, sparse], per_chunk=False).where("candidate_id = 'a'").first()
    assert best["rrf_score"] == round(1 / 61 + 1 / 62, 6)


def test_fallback_fills_only_empty_jobs(spark):
    fused = spark.createDataFrame([("t", 1, "a", 0.1)], "tenant_id string, job_id int, candidate_id string, rrf_score double")
    pool = spark.createDataFrame([("t", "r", c) for c in "cab"], "tenant_id string, rule_id string, candidate_id string")
    jobs = spark.createDataFrame([("t", 1, "r"), ("t", 2, "r")], "tenant_id string, job_id int, rule_id string")
    rows = fusion.with_fallback(fused, pool, jobs, 2).collect()
    assert sorted((r["job_id"], r["candidate_id"], r["rrf_score"]) for r in rows) == [(1, "a", 0.1), (2, "a", 0.0), (2, "b", 0.0)]


def conf(spark, overrides):
    jobs = spark.createDataFrame([("t", 1, overrides)], "tenant_id string, job_id int, screen_overrides map<string,string>")
    return rerank.job_settings(jobs).first()


def test_overrides_are_typed_and_listed(spark):
    row = conf(spark, {"rag_top_k": "7", "rerank_doc_chars": "123", "evil_param": "1"})
    assert (row["rag_top_k"], row["doc_chars"]) == (7, 123)
    row = conf(spark, {"rag_top_k": "9", "rerank_threshold": "0.7", "rerank_pairs_factor": "abc"})
    assert (row["rag_top_k"], row["threshold_cross"], row["pairs_factor"]) == (9, 0.7, 2)
    row = conf(spark, {"rerank_mode": "cross_encoder", "rerank_threshold": ".33", "rerank_threshold_cosine": ".66"})
    assert (row["rerank_mode"], row["threshold_cross"], row["threshold_cosine"]) == ("cross_encoder", 0.33, 0.66)
    assert conf(spark, None)["rerank_mode"] == "cosine"


def test_score_falls_back_and_keeps_its_threshold(spark):
    rows = [
        (1, "cross_encoder", 0.5, [1.0, 0.0], [1.0, 0.0]),   # cross score above 0.4
        (2, "cross_encoder", 0.3, [1.0, 0.0], [1.0, 0.0]),   # cross score below 0.4
        (3, "cross_encoder", None, [1.0, 0.0], [-1.0, 0.1]), # cosine, below 0.55
        (4, "cosine", 0.1, [1.0, 0.0], [1.0, 0.1]),          # cross score ignored
        (5, "cosine", None, None, None),                     # RRF, no threshold
    ]
    df = spark.createDataFrame(
        rows, "candidate_id int, rerank_mode string, cross_score double, query_vector array<double>, doc_vector array<double>"
    ).withColumns({"rrf_score": F.lit(0.01), "threshold_cross": F.lit(0.4), "threshold_cosine": F.lit(0.55)})
    kept = {r["candidate_id"]: r["score_mode"] for r in rerank.score_pairs(df).collect()}
    assert kept == {1: "cross_encoder", 4: "cosine", 5: "rrf"}


def screening(spark):
    rows = [
        ("c1", "Python 机器学习 backend", [("2020", "2024")], ["硕士"], ["Python"]),
        ("c2", "Java Spring", [("2015", "2024")], ["本科"], ["Java"]),
        ("c3", "cooking", [], ["专科"], []),
    ]
    jobs = spark.createDataFrame(
        [("t", "j1", "Python dev", None, ["本科及以上学历"], ["Python"]), ("t", "j2", "Chef", "nothing known", ["博士"], [])],
        "tenant_id string, job_id string, title string, query string, hard_requirements array<string>, skill_graph array<string>",
    )
    chunks = spark.createDataFrame(
        [("t", "c1", 0, "Python 机器学习 backend", [1.0, 0.0]), ("t", "c2", 0, "Java Spring", [0.6, 0.8]), ("t", "c3", 0, "cooking", [0.0, 1.0])],
        "tenant_id string, candidate_id string, chunk_index int, chunk string, embedding array<float>",
    )
    vectors = spark.createDataFrame(
        [("t", "j1", [1.0, 0.0]), ("t", "j2", [0.0, 1.0])], "tenant_id string, job_id string, vector array<float>"
    )
    return ScreenInputs(jobs, candidates(spark, rows), chunks, vectors)


@pytest.mark.parametrize("staged", [True, False])
def test_coarse_screen(spark, staged):
    rows = coarse_screen(screening(spark), as_of_year=2026, staged=staged).orderBy("job_id", "rank").collect()
    # c3 fails the degree rule and j2's pool is empty.
    assert [(r["job_id"], r["candidate_id"], r["rank"]) for r in rows] == [("j1", "c1", 1), ("j1", "c2", 2)]
    assert rows[0]["score"] == 1.0 and rows[0]["score_mode"] == "cosine"
    assert rows[0]["reasons"][0] == "技能匹配：Python" and rows[1]["reasons"] == ["原文证据：Java Spring"]


def test_scorer_is_asked_after_the_cut(spark):
    def only_python():
        def rate(queries, documents):
            if any("cooking" in d for d in documents):  # outside the pool, so never a pair
                raise AssertionError("asked for a pair outside the cut")
            return [None if "Java" in d else 0.9 for d in documents]

        return rate

    given = screening(spark)
    mode = F.create_map(F.lit("rerank_mode"), F.lit("cross_encoder"))
    asked = replace(given, jobs=given.jobs.withColumn("screen_overrides", mode))
    rows = coarse_screen(asked, as_of_year=2026, scorer=pair_scorer(only_python)).orderBy("rank").collect()
    assert [(r["candidate_id"], r["score"], r["score_mode"]) for r in rows] == [("c1", 0.9, "cross_encoder"), ("c2", 0.8, "cosine")]
    # A cosine job does not ask it.
    plain = coarse_screen(given, as_of_year=2026, scorer=pair_scorer(only_python)).collect()
    assert {r["score_mode"] for r in plain} == {"cosine"}
    scores = spark.createDataFrame([("t", "j1", "c1", 0.5)], "tenant_id string, job_id string, candidate_id string, cross_score double")
    with pytest.raises(ValueError):
        coarse_screen(replace(asked, cross_scores=scores), scorer=pair_scorer(only_python))


def test_summary_counts_batches(spark):
    given = screening(spark)
    listed = spark.createDataFrame([("t", "j1", "c1")], "tenant_id string, job_id string, candidate_id string")
    counts = {r["job_id"]: r for r in screen_summary(given.jobs, given.candidates, listed, listed, batch_size=2).collect()}
    assert [counts["j1"][c] for c in ("pool_size", "batches", "accepted", "cache_hits")] == [3, 2, 1, 1]
    assert [counts["j2"][c] for c in ("pool_size", "batches", "accepted", "cache_hits")] == [3, 2, 0, 0]
    named = given.candidates.withColumn("batch", F.when(F.col("candidate_id") == "c1", "a").otherwise("b"))
    assert {r["batches"] for r in screen_summary(given.jobs, named, listed, listed).collect()} == {2}
    none = given.candidates.where("false")
    assert {(r["pool_size"], r["batches"]) for r in screen_summary(given.jobs, none, listed, listed).collect()} == {(0, 0)}


def test_jobs_with_equal_needs_share_a_rule(spark):
    jobs = spark.createDataFrame(
        [("t", 1, ["本科", "Go Rust"], ["Go", "Rust"]), ("t", 2, ["本科 Rust Go"], ["rust", "go"])],
        "tenant_id string, job_id int, hard_requirements array<string>, skill_graph array<string>",
    )
    assert distinct_rules(job_rules(jobs)).count() == 1
