"""The model points, with deterministic stand-ins for models."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from matchloom.functions.model_points import ask_panel, embedder, pair_scorer
from matchloom.operators import feedback as B
from matchloom.operators import incremental as C
from matchloom.operators.discussion import run_discussion
from matchloom.plans.ingest import refresh_vectors, vectorise
from matchloom.sources import resumes
from matchloom.streaming.runner import results_then_status, updates_to


def hashing():
    def encode(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("model down")
        return [[b / 255 for b in hashlib.md5(t.encode()).digest()[:4]] for t in texts]

    return encode


def test_vectorise(spark):
    texts = spark.createDataFrame([("t", "c1", "x" * 1200), ("t", "c2", "  ")], "tenant_id string, candidate_id string, text string")
    rows = vectorise(texts, embedder(hashing)).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == ["c1_chunk_0", "c1_chunk_1", "c1_chunk_2"]
    assert all(len(r["embedding"]) == 4 for r in rows)
    down = spark.createDataFrame([("t", "c3", "boom")], "tenant_id string, candidate_id string, text string")
    assert vectorise(down, embedder(hashing)).first()["embedding"] is None


def test_refreshed_vectors(spark):
    schema = "tenant_id string, candidate_id string, text string"
    before = [("t", "c1", "x" * 1200), ("t", "c2", "old"), ("t", "c3", "old"), ("u", "c1", "other tenant"), ("t", "c5", "kept")]
    stored = vectorise(spark.createDataFrame(before, schema), embedder(hashing))
    texts = [("t", "c1", "short now"), ("t", "c2", "a" * 600 + "boom"), ("t", "c3", "  "), ("t", "c4", "first")]
    rows, failed = refresh_vectors(stored, spark.createDataFrame(texts, schema).repartition(4, "candidate_id"), embedder(hashing))
    got = {(r["tenant_id"], r["candidate_id"], r["chunk_index"]): r["chunk"] for r in rows.collect()}
    # c2 failed in one chunk and c3 has none: both keep what is stored.
    assert got == {
        ("t", "c1", 0): "short now", ("t", "c2", 0): "old", ("t", "c3", 0): "old", ("t", "c4", 0): "first",
        ("u", "c1", 0): "other tenant", ("t", "c5", 0): "kept",
    }
    assert [r["candidate_id"] for r in failed.collect()] == ["c2"]


def test_model_discussion(spark):
    def follow():
        def ask(row):
            request = json.loads(row["request"])
            if request["agent"] == "mute":
                raise RuntimeError("no answer")
            if request["agent"] == "garbled":
                return "no JSON"
            peers = [p["score"] for p in request["peers"]]
            return json.dumps({"stance": "revise", "score": sum(peers) / len(peers), "reasoning": request["argument"]})

        return ask

    seats = [  # c1 settles in round 1, c2 talks on; the rule-based expert is not asked
        ("t", "j", "c1", "a", 0, 20.0), ("t", "j", "c1", "b", 1, 60.0), ("t", "j", "c1", "mute", 2, 40.0),
        ("t", "j", "c2", "a", 0, 0.0), ("t", "j", "c2", "garbled", 1, 100.0),
        ("t", "j", "c2", "mute", 2, 100.0), ("t", "j", "c2", "stability_analyzer", 3, 5.0),
    ]
    panel = spark.createDataFrame(
        seats, "tenant_id string, job_id string, candidate_id string, agent string, pos int, score double"
    ).withColumns({
        "confidence": F.lit(0.5), "dimension_scores": F.lit(None).cast("map<string,double>"),
        "evidence": F.array().cast("array<string>"),
    })
    arguments = spark.createDataFrame([("t", "j", "c2", "doubt")], "tenant_id string, job_id string, candidate_id string, argument string")
    final, transcript = run_discussion(panel, ask=lambda rows: ask_panel(rows, follow, attempts=1), arguments=arguments)
    turns = {(r["candidate_id"], r["round"], r["agent"]): (r["stance"], r["score"], r["content"]) for r in transcript.collect()}
    assert turns == {
        ("c1", 1, "a"): ("revise", 50.0, ""), ("c1", 1, "b"): ("revise", 30.0, ""), ("c1", 1, "mute"): ("maintain", 40.0, ""),
        ("c2", 1, "a"): ("revise", 100.0, "doubt"), ("c2", 1, "garbled"): ("maintain", 100.0, ""),
        ("c2", 1, "mute"): ("maintain", 100.0, ""),
    }
    scores = {(r["candidate_id"], r["agent"]): r["score"] for r in final.collect()}
    assert scores[("c2", "stability_analyzer")] == 5.0 and scores[("c1", "b")] == 30.0 and len(scores) == len(seats)
    with pytest.raises(ValueError):
        run_discussion(panel)


def test_pair_scorer(spark):
    def overlap():
        return lambda qs, ds: [len(set(q.split()) & set(d.split())) / len(q.split()) for q, d in zip(qs, ds)]

    df = spark.createDataFrame([("a b", "b c"), ("a", "a")], "q string, d string")
    score = pair_scorer(overlap)
    assert [r[0] for r in df.select(score(F.col("q"), F.col("d"))).collect()] == [0.5, 1.0]


def test_panel_answers_retry_and_report_errors(spark):
    def flaky():
        seen = set()

        def ask(row):
            if row["agent"] == "broken":
                raise ValueError("no answer")
            if row["agent"] not in seen:
                seen.add(row["agent"])
                raise TimeoutError("first try")
            return '{"score": 50}'

        return ask

    pairs = spark.createDataFrame([("c", "interviewer"), ("c", "broken")], "candidate_id string, agent string").coalesce(1)
    rows = {r["agent"]: (r["raw"], r["error"]) for r in ask_panel(pairs, flaky).collect()}
    assert rows == {"interviewer": ('{"score": 50}', None), "broken": (None, "no answer")}


def test_resume_files(spark, tmp_path):
    files = {
        "ok.pdf": b"%PDF-1.7 text", "OK.PNG": bytes.fromhex("89504E47") + b"123456", "fake.pdf": b"GIF89a--------",
        "short.pdf": b"%PDF", "big.jpg": bytes.fromhex("FFD8FF") + b"x" * 200, "cv.docx": b"PK\x03\x04 12345678",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    good, bad = resumes.accepted_files(resumes.read_files(spark, str(tmp_path)), 100)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    assert {r["name"] for r in good.select(name).collect()} == {"ok.pdf", "OK.PNG"}
    assert {r["name"]: r["reason"] for r in bad.select(name, "reason").collect()} == {
        "fake.pdf": "signature", "short.pdf": "too_short", "big.jpg": "too_large", "cv.docx": "extension"
    }


def test_display_order(spark):
    df = spark.createDataFrame([("a", 50.0, 90.0), ("b", 80.0, 60.0), ("c", 70.0, None)], "candidate_id string, overall_score double, adjusted_score double")
    assert [r["candidate_id"] for r in B.display_order(df).collect()] == ["a", "c", "b"]
    assert [r["candidate_id"] for r in B.display_order(df, raw=True).collect()] == ["b", "c", "a"]


def test_results_are_stored_before_the_status(spark, tmp_path):
    rows = [("t1", "candidate_done", 1), ("t1", "done", 2), ("t2", "stage", 3)]
    df = spark.createDataFrame(rows, "task_id string, type string, ms long")
    df.write.parquet(str(tmp_path / "in"))
    order = []
    handle = results_then_status(
        lambda b: order.append(("results", b.count())), lambda b: order.append(("status", b.count()))
    )
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(handle).start()
    query.awaitTermination()
    assert order == [("results", 1), ("status", 1)]


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v long")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).groupBy("k").agg(F.sum("v").alias("v"))
        # A new checkpoint makes the second run repeat batch 0 into the same folder.
        updates_to(stream, str(tmp_path / "out"), str(tmp_path / f"cp{_}")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "v").collect()] == [("a", 3)]


def test_vector_replacement(spark):
    old = spark.createDataFrame([("c1", 0, "old"), ("c1", 1, "old"), ("c2", 0, "old")], "candidate_id string, i int, v string")
    new = spark.createDataFrame([("c1", 0, "new")], "candidate_id string, i int, v string")
    rows = {tuple(r) for r in C.replace_groups(old, new, ["candidate_id"]).collect()}
    assert rows == {("c1", 0, "new"), ("c2", 0, "old")}
