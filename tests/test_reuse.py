import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators import feedback as B
from matchloom.operators import incremental as C
from matchloom.operators import metrics as M
from matchloom.operators import quality as Q
from matchloom.operators import ranking as R
from matchloom.fixed import SERVICE_EDGES, STAGE_EDGES


def fingerprint(spark, text, structured, schema):
    df = spark.createDataFrame([(text, structured)], T.StructType([T.StructField("x", T.StringType()), T.StructField("s", schema)]))
    return df.select(C.profile_fingerprint(df, "x", "s")).first()[0]


def test_fingerprint_ignores_order(spark):
    ab = T.StructType([T.StructField("a", T.StringType()), T.StructField("skills", T.ArrayType(T.StringType()))])
    ba = T.StructType([T.StructField("skills", T.ArrayType(T.StringType())), T.StructField("a", T.StringType())])
    one = fingerprint(spark, "v1", ("1", ["Go", "Java"]), ab)
    assert one == fingerprint(spark, "v1", (["Java", "Go"], "1"), ba)
    assert one != fingerprint(spark, "v2", ("1", ["Go", "Java"]), ab)
    assert one != fingerprint(spark, "v1", ("1", ["Go", "Java", "SQL"]), ab)
    assert len(fingerprint(spark, "x", None, ab)) == 32


def test_job_fingerprint(spark):
    def of(jd, weights, overrides):
        df = spark.createDataFrame([(jd, weights, overrides)], "jd map<string,string>, w map<string,double>, o map<string,string>")
        return df.select(C.job_fingerprint(df, "jd", "w", "o")).first()[0]

    base = of({"t": "a", "u": "b"}, None, None)
    assert base == of({"u": "b", "t": "a"}, None, None)
    assert len({base, of({"t": "x"}, None, None), of({"t": "a", "u": "b"}, {"i": 1.0}, None), of({"t": "a", "u": "b"}, None, {"k": "1"})}) == 4


PAIR = "tenant_id string, job_id string, candidate_id string"


def test_checkpoint_merge(spark):
    schema = f"{PAIR}, score double"
    empty = spark.createDataFrame([], schema)
    two = spark.createDataFrame([("t", "j", "c1", 88.5), ("t", "j", "c2", 61.0)], schema)
    assert C.merge_checkpoint(empty, two).where("from_checkpoint").count() == 2
    cached = spark.createDataFrame([("t", "j", "c1", 99.9)], schema)
    rows = C.merge_checkpoint(cached, spark.createDataFrame([("t", "j", "c1", 10.0)], schema)).collect()
    assert [(r["score"], r["from_checkpoint"]) for r in rows] == [(99.9, False)]
    assert C.merge_checkpoint(empty, empty).count() == 0


def test_checkpoint_hashes(spark):
    verdict = f"{PAIR}, profile_hash string, config_hash string"
    people = spark.createDataFrame(
        [("t", "c1", "p1"), ("t", "c2", "p2"), ("t", "c3", "p3"), ("t", "c4", "")], "tenant_id string, candidate_id string, profile_hash string"
    )
    jobs = spark.createDataFrame([("t", "j", "conf")], "tenant_id string, job_id string, config_hash string")
    cached = spark.createDataFrame([], verdict)
    reports = spark.createDataFrame(
        [("t", "j", "c1", "p1", "conf"), ("t", "j", "c2", "old", "conf"), ("t", "j", "c3", "p3", None), ("t", "j", "c4", "", "conf")], verdict
    )
    kept = C.merge_checkpoint(cached, reports, people, jobs).collect()
    assert [(r["candidate_id"], r["from_checkpoint"]) for r in kept] == [("c1", True)]
    assert C.merge_checkpoint(cached, reports).count() == 4
    with pytest.raises(ValueError):
        C.merge_checkpoint(cached, reports, people)


def test_upsert_keeps_id_and_overwrites_nulls(spark):
    schema = "k string, id string, name string"
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], schema)
    new = spark.createDataFrame([("b", "9", None), ("c", "3", "z")], schema)
    rows = {tuple(r) for r in C.upsert(old, new, ["k"], ["id"]).collect()}
    assert rows == {("a", "1", "x"), ("b", "2", None), ("c", "3", "z")}


def test_newest_per_key_and_the_others(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 5, "y"), ("a", 3, 4, "z"), ("b", 4, 1, None)], "k string, id int, ts int, v string")
    assert {r["id"] for r in R.newest_per_key(rows, ["k"], ["ts", "id"]).collect()} == {2, 4}
    assert {r["id"] for r in R.older_duplicates(rows, ["k"], ["ts", "id"]).collect()} == {1, 3}


@pytest.mark.parametrize(
    "score,boost,expected",
    [(87.2, 0.0, 87.2), (72.4, 0.1, 79.64), (87.2, 0.05, 91.56), (72.4, -0.05, 68.78), (98.0, 0.15, 100.0), (1.0, -1.5, 0.0)],
)
def test_boost(spark, score, boost, expected):
    assert spark.range(1).select(B.adjusted_score(F.lit(score), F.lit(boost))).first()[0] == expected


def test_boost_expires_and_renews(spark):
    day = 86_400
    log = [("u", "suitable", 0), ("u", "suitable", 20 * day), ("u", "suitable", 45 * day), ("v", "suitable", 0), ("v", "not_suitable", 31 * day)]
    df = spark.createDataFrame(log, "user_id string, feedback string, ts long")
    got = {r["user_id"]: r["boost"] for r in B.expiring_boosts(df, ["user_id"], "ts", 30 * day).collect()}
    assert got == {"u": 0.15, "v": -0.05}
    live = B.expiring_boosts(df, ["user_id"], "ts", 30 * day, as_of=F.lit(70 * day)).collect()
    assert [r["user_id"] for r in live] == ["u"]


def test_high_potential_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    log = [("t", rng.randrange(6), rng.randrange(30), rng.choice(["suitable", "not_suitable", "pending"])) for _ in range(200)]
    df = spark.createDataFrame(log, "tenant_id string, job_id int, target_id int, feedback string")
    got = {(r["job_id"], r["rank"], r["target_id"]) for r in B.high_potential(df, df.select("tenant_id", "job_id"), 4).collect()}
    good = {t for _, _, t, f in log if f == "suitable"}
    want = set()
    for job in {j for _, j, _, _ in log}:
        refused = {t for _, j, t, f in log if j == job and f == "not_suitable"}
        want |= {(job, i + 1, t) for i, t in enumerate(sorted(good - refused)[:4])}
    assert got == want


def test_paging(spark):
    df = spark.range(250).select(F.col("id"), (F.col("id") / 3).cast("int").alias("created_at"))
    first, second = (R.page(df, "created_at", "id", offset=o) for o in (0, 200))
    ids = [r["id"] for r in first.collect()] + [r["id"] for r in second.collect()]
    assert len(ids) == len(set(ids)) == 250
    assert R.load_for_screening(df, "created_at", "id", 300).count() == 250
    assert R.load_for_screening(df, "created_at", "id", 0).count() == 200
    pages = R.page_numbers(df.withColumn("k", F.lit(1)), ["k"], "created_at", "id", 200, bucket=F.floor(F.col("created_at") / 10))
    assert {r["page"]: r["count"] for r in pages.groupBy("page").count().collect()} == {0: 200, 1: 50}
    assert {r["id"] for r in pages.where("page = 0").collect()} == set(ids[:200])


def observed(spark, values):
    rows = [("unit", {"status": "200", "method": "GET"}, float(v), None) for v in values]
    return spark.createDataFrame(rows, "name string, labels map<string,string>, value double, ts timestamp")


@pytest.mark.parametrize("time", ["timestamp", "timestamp_ntz"])
def test_deep_pages_equal_the_sorted_list(spark, time):
    rng = random.Random(4)
    # One day holds half of the rows, one pair is repeated, some values are NULL.
    rows = [(rng.choice([3, 3, 3, rng.randrange(40), None]), rng.choice([rng.randrange(-200, 200), None]) if i % 9 == 0 else i) for i in range(300)]
    rows += [(3, 50)] * 4
    df = spark.createDataFrame(rows, "day int, id bigint").repartition(3)
    stamp = F.date_add(F.lit("2024-02-27").cast("date"), F.col("day")).cast(time)
    df = df.withColumn("at", stamp)
    low = -10**9
    ordered = sorted(rows, key=lambda r: (-(low if r[0] is None else r[0]), low if r[1] is None else r[1]))
    for offset in (0, 151, 299, 400):
        got = [(r["day"], r["id"]) for r in R.page(df, "at", "id", offset, 7, max_rows=20).collect()]
        assert got == ordered[offset : offset + 7]
    assert R.page(df.where("false"), "at", "id", 50, 7, max_rows=20).count() == 0


def test_deep_page_with_text_ids(spark):
    df = spark.range(100).selectExpr("id % 2 AS at", "lpad(cast(id AS string), 3, '0') AS key")
    got = [r["key"] for r in R.page(df, "at", "key", 60, 3, max_rows=10).collect()]
    assert got == ["020", "022", "024"]


def test_histogram(spark):
    rows = M.histograms(observed(spark, [0.3, 5.0, 0.02, 70.0]), STAGE_EDGES)
    assert Q.histogram_violations(rows, ["name", "labels"]).count() == 0
    assert rows.where("le IS NULL").first()["cumulative"] == 4
    go = {r["le"]: (r["cumulative"], r["sum"]) for r in M.histograms(observed(spark, [0.3, 5.0]), SERVICE_EDGES).collect()}
    assert go[0.5][0] == 1 and go[8.0][0] == 2 and go[None] == (2, 5.3)


def test_broken_histogram_is_found(spark):
    rows = spark.createDataFrame(
        [("h", 1.0, 3, 4), ("h", 2.0, 2, 4), ("h", None, 5, 4)], "name string, le double, cumulative int, count int"
    )
    found = {r["violation"] for r in Q.histogram_violations(rows, ["name"]).collect()}
    assert found == {"not_monotone", "inf_not_count"}


def test_text_export(spark):
    counted = M.counters(observed(spark, [1, 2]))
    assert M.export_counters(counted).first()["line"] == 'unit_total{method="GET",status="200"} 3'
    total = spark.createDataFrame([("x_total", "", 1.5)], "name string, labels string, value double")
    assert M.export_counters(total).first()["line"] == "x_total 1.5"
    lines = [r["line"] for r in M.export_histograms(M.histograms(observed(spark, [0.3]), STAGE_EDGES)).collect()]
    assert 'unit_bucket{method="GET",status="200",le="0.5"} 1' in lines
    assert 'unit_bucket{method="GET",status="200",le="+Inf"} 1' in lines


def test_requests_in_window_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    calls = [(rng.choice("ab"), i, rng.randrange(500)) for i in range(120)]
    df = spark.createDataFrame(calls, "caller string, id int, ms long")
    got = {r["id"]: r["in_window"] for r in M.requests_in_window(df, ["caller"], "ms", "id", 60, bucket_spans=1).collect()}
    assert got == {i: sum(c2 == c and t - 60 < t2 <= t for c2, _, t2 in calls) for c, i, t in calls}


def test_route_labels(spark):
    paths = [("/screen/tasks/8c1f6a52-0b1e-4c57-9a3e-3f0f6a2b9d11/events",), ("/jobs/12",), ("",), (None,)]
    df = spark.createDataFrame(paths, "p string")
    assert [r[0] for r in df.select(M.route_label(F.col("p"))).collect()] == ["/screen/tasks/:id/events", "/jobs/:id", "unmatched", "unmatched"]


def test_reuse_counts(spark):
    now = dt.datetime(2024, 1, 1)
    candidates = spark.createDataFrame([("t", "a", "h1"), ("t", "b", "h2"), ("t", "c", ""), ("t", "d", "h4")], "tenant_id string, candidate_id string, profile_hash string")
    jobs = spark.createDataFrame([("t", "j", "cfg"), ("t", "k", "cfg")], "tenant_id string, job_id string, config_hash string")
    verdicts = spark.createDataFrame(
        [("t", "j", "a", "h1", "cfg", now), ("t", "j", "b", "old", "cfg", now), ("t", "k", "a", "h1", "old", now), ("t", "j", "c", "h3", "cfg", now)],
        f"{PAIR}, profile_hash string, config_hash string, created_at timestamp",
    )
    got = {(r["job_id"], r["outcome"]): r["n"] for r in C.reuse_counts(candidates, C.cached_verdicts(verdicts), jobs).collect() if r["n"]}
    assert got == {
        ("j", "hit"): 1, ("j", "no_hash"): 1, ("j", "no_verdict"): 1, ("j", "profile_changed"): 1,
        ("k", "no_hash"): 1, ("k", "no_verdict"): 2, ("k", "config_changed"): 1,
    }
    assert C.reusable(candidates, verdicts, jobs).count() == 1
