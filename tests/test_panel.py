import json
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import discussion as D
from matchloom.operators import panel as P
from matchloom.plans.fine import fine_screen, job_weights

SCHEMA = (
    "tenant_id string, job_id string, candidate_id string, agent string, pos bigint, score double, confidence double, "
    "dimension_scores map<string,double>, evidence array<string>"
)


def panel(spark, results, candidate="c"):
    rows = [("t", "j", candidate, a, i, float(s), float(c), {"d": float(s)}, [f"{a} text"]) for i, (a, s, c) in enumerate(results)]
    return spark.createDataFrame(rows, SCHEMA)


def weights(spark, category, override=None):
    jobs = spark.createDataFrame(
        [("t", "j", category, override)], "tenant_id string, job_id string, job_category string, weights_override map<string,string>"
    )
    return job_weights(jobs)


def test_arbitration(spark):
    results = [("interviewer", 80, 0.9), ("skill_evaluator", 60, 0.8), ("culture_fit", 70, 0.7), ("stability_analyzer", 90, 0.9)]
    overall = P.arbitrate(panel(spark, results), weights(spark, "tech")).first()["overall_score"]
    assert abs(overall - 73.7) <= 0.15


def test_advocate_does_not_count(spark):
    results = [("interviewer", 80, 0.9), ("culture_fit", 80, 0.9), ("stability_analyzer", 80, 0.9), ("devils_advocate", 10, 0.9)]
    rows = panel(spark, results)
    table = weights(spark, "general")
    assert P.arbitrate(rows, table).first()["overall_score"] == 80.0
    assert P.dimension_means(rows, table).first()["value"] == 80.0


def test_nobody_with_weight_scores_zero(spark):
    rows = panel(spark, [("devils_advocate", 10, 0.9)])
    assert P.arbitrate(rows, weights(spark, "general")).first()["overall_score"] == 0.0


@pytest.mark.parametrize("scores,needed", [((75, 72), False), ((95, 40), True), ((90,), False)])
def test_divergence(spark, scores, needed):
    names = ["interviewer", "culture_fit"]
    results = [(n, s, 0.8) for n, s in zip(names, scores)] + [("stability_analyzer", 0, 0.9)]
    assert P.divergence(panel(spark, results)).first()["needs_discussion"] is needed


def test_divergence_mean_is_weighted_and_std_is_not(spark):
    row = P.divergence(panel(spark, [("interviewer", 100, 0.9), ("culture_fit", 0, 0.0)])).first()
    assert row["mean"] == pytest.approx(90.0) and row["std"] == 50.0


@pytest.mark.parametrize(
    "category,override,expected",
    [
        ("tech", None, {"interviewer": 0.35, "skill_evaluator": 0.35, "culture_fit": 0.15, "stability_analyzer": 0.15}),
        ("tech", {"skill_evaluator": "0.6", "interviewer": "0.4"}, {"interviewer": 0.4, "skill_evaluator": 0.6, "culture_fit": 0, "stability_analyzer": 0}),
        ("tech", {"skill_evaluator": "3", "interviewer": "1"}, {"interviewer": 0.25, "skill_evaluator": 0.75, "culture_fit": 0, "stability_analyzer": 0}),
        ("general", {"nobody": "1"}, {"interviewer": 0.5, "culture_fit": 0.3, "stability_analyzer": 0.2}),
        ("general", {"interviewer": "0"}, {"interviewer": 0.5, "culture_fit": 0.3, "stability_analyzer": 0.2}),
        ("general", {"interviewer": "-0.5"}, {"interviewer": 0.5, "culture_fit": 0.3, "stability_analyzer": 0.2}),
        ("general", {"interviewer": "abc"}, {"interviewer": 0.5, "culture_fit": 0.3, "stability_analyzer": 0.2}),
        ("not_a_category", None, {"interviewer": 0.5, "culture_fit": 0.3, "stability_analyzer": 0.2}),
    ],
)
def test_weights(spark, category, override, expected):
    assert weights(spark, category, override).first()["weights"] == expected


def test_answers_are_cleaned(spark):
    def parsed(raw):
        return spark.range(1).select(P.parse_panel_answer(F.lit(raw)).alias("p")).first()["p"]

    p = parsed('{"score": "120", "dimension_scores": {"a": -5, "b": "x"}, "evidence": [" ", "e1", "e2", "e3", "e4"], "confidence": 0}')
    assert (p.score, p.dimension_scores, p.evidence, p.confidence) == (100.0, {"a": 0.0, "b": 0.0}, ["e1", "e2", "e3"], 0.7)
    p = parsed("not json")
    assert (p.score, p.dimension_scores, p.evidence, p.confidence) == (0.0, {}, [], 0.7)


def test_evidence_first_seen_then_confidence(spark):
    rows = spark.createDataFrame(
        [
            ("t", "j", "c", "a", 0, 1.0, 0.5, {}, ["x", "y"]),
            ("t", "j", "c", "b", 1, 1.0, 0.9, {}, ["x", "z", ""]),
        ],
        SCHEMA,
    )
    merged = [r["text"] for r in P.merged_evidence(rows).orderBy("rank").collect()]
    assert merged == ["z", "x", "y"]


def turns(spark, said):
    return spark.createDataFrame(
        [("t", "j", "c", agent, round_no, raw) for agent, round_no, raw in said],
        "tenant_id string, job_id string, candidate_id string, agent string, round int, turn string",
    )


def test_discussion_stops_when_converged(spark):
    start = panel(spark, [("interviewer", 95, 0.8), ("culture_fit", 40, 0.8), ("stability_analyzer", 10, 0.9)])
    said = turns(
        spark,
        [
            ("interviewer", 1, '{"stance": "revise", "score": 70, "evidence": ["new"], "dimension_scores": {"d": 500, "q": "x"}}'),
            ("culture_fit", 1, '{"stance": "revise", "score": "none"}'),
            ("interviewer", 2, '{"stance": "revise", "score": 45}'),
            ("culture_fit", 2, '{"stance": "maintain", "score": 1}'),
        ],
    )
    final, transcript = D.run_discussion(start, said)
    scores = {r["agent"]: r["score"] for r in final.collect()}
    assert scores == {"interviewer": 45.0, "culture_fit": 40.0, "stability_analyzer": 10.0}
    log = {(r["agent"], r["round"]): (r["stance"], r["score_delta"]) for r in transcript.collect()}
    assert log[("interviewer", 1)] == ("revise", -25.0) and log[("culture_fit", 1)] == ("maintain", 0.0)
    row = final.where("agent = 'interviewer'").first()
    assert row["evidence"] == ["interviewer text", "new"] and row["dimension_scores"] == {"d": 100.0}

    # With a wide threshold the first round already converges.
    near = turns(spark, [("interviewer", 1, '{"stance": "revise", "score": 50}'), ("interviewer", 2, '{"stance": "revise", "score": 99}')])
    final, transcript = D.run_discussion(start, near)
    assert {r["agent"]: r["score"] for r in final.collect()}["interviewer"] == 50.0
    assert transcript.agg(F.max("round")).first()[0] == 1


def test_fine_screen_reuses_and_survives_failures(spark):
    good = panel(spark, [("interviewer", 80, 0.9), ("culture_fit", 78, 0.9)], "fresh").withColumn("error", F.lit(None).cast("string"))
    bad = panel(spark, [("interviewer", 0, 0.9)], "broken").withColumn("error", F.lit("timeout"))
    cached = spark.createDataFrame(
        [("t", "j", "known", 61.0, None, None, None, None)],
        "tenant_id string, job_id string, candidate_id string, overall_score double, dimension_scores map<string,double>, "
        "recommendation_text string, evidence array<string>, agent_details array<struct<agent:string,score:double,confidence:double>>",
    )
    done = fine_screen(good.unionByName(bad), turns(spark, []), weights(spark, "general"), cached)
    rows = {r["candidate_id"]: r for r in done.collect()}
    assert rows["known"]["overall_score"] == 61.0 and rows["known"]["cached"]
    assert rows["broken"]["failed"] and rows["broken"]["overall_score"] is None
    assert 78 < rows["fresh"]["overall_score"] < 80 and not rows["fresh"]["failed"]


def test_folded_rounds_equal_one_round_after_the_other(spark):
    rng = random.Random(2)
    seats = [("t", 1, c, a) for c in range(6) for a in ("x", "y")]
    own = [(*s, float(rng.randrange(101)), 0.8, {"a": 5.0, "b": 7.0}, ["own"]) for s in seats]
    pair = "tenant_id string, job_id int, candidate_id int, agent string"
    state = spark.createDataFrame(own, f"{pair}, score double, confidence double, dimension_scores map<string,double>, evidence array<string>")
    rows = []
    for s in seats[1:]:
        for r in rng.sample([2, 3, 4, 5], rng.randrange(5)):
            said = {"stance": rng.choice(["revise", "maintain", None]), "score": rng.choice(["12", "140", "-3", "none", None])}
            said |= {"dimension_scores": {rng.choice("abc"): rng.choice(["50", "bad"])}, "evidence": [f"e{r}", "", "own"], "reasoning": f"why {r}"}
            rows.append((*s, r, json.dumps(said)))
    turns = spark.createDataFrame(rows, f"{pair}, round int, raw string").withColumn("turn", D.parse_turn(F.col("raw"))).drop("raw")
    want, history = state, {s: [] for s in seats}
    answered = {(*r[:4], r[4]) for r in rows}
    for r in (2, 3, 4, 5):
        done = D.apply_turns(want, turns, r).persist()
        for x in done.collect():
            seat = (x["tenant_id"], x["job_id"], x["candidate_id"], x["agent"])
            if (*seat, r) in answered:
                history[seat].append((r, x["score"], x["score_delta"], x["stance"]))
        want = done.select(*state.columns)
    end = {tuple(x)[:4]: x for x in want.select("tenant_id", "job_id", "candidate_id", "agent", "score", "dimension_scores", "evidence").collect()}
    for x in D.fold_turns(state, turns).collect():
        seat = (x["tenant_id"], x["job_id"], x["candidate_id"], x["agent"])
        w = end[seat]
        assert (x["score"], x["dimension_scores"], x["evidence"]) == (w["score"], w["dimension_scores"], w["evidence"])
        assert [tuple(h) for h in x["history"]] == history[seat]
        assert x["reasoning"] == (f"why {history[seat][-1][0]}" if history[seat] else "")
