import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import text as X
from matchloom.functions.labels import label_string
from matchloom.operators import skills as K
from matchloom.plans import ingest as I


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def test_tokenize_mixes_words_and_cjk(spark):
    assert value(spark, X.tokenize(F.lit("Python 机器, C++/Go-lang"))) == ["python", "机", "器", "c++/go-lang"]
    assert value(spark, X.tokenize(F.lit(None).cast("string"))) == []


def brute_chunks(text, size, overlap):
    text = text.strip()
    if not text:
        return []
    pieces, start, step = [], 0, max(size - overlap, 1)
    while True:
        piece = text[start : start + size].strip()
        if piece:
            pieces.append(piece)
        if start + size >= len(text):
            return pieces
        start += step


@pytest.mark.parametrize("overlap", [0, 50])
def test_chunk_starts(spark, overlap):
    body = "".join(chr(97 + i % 26) for i in range(1200))
    assert value(spark, X.chunk(F.lit(body), 500, overlap)) == brute_chunks(body, 500, overlap)
    assert len(value(spark, X.chunk(F.lit(body), 500, 50))) == 3


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n　机", max_size=60), st.integers(2, 9), st.integers(0, 3))
def test_chunk_equals_brute_force(spark, body, size, overlap):
    assert value(spark, X.chunk(F.lit(body), size, overlap)) == brute_chunks(body, size, overlap)


@pytest.mark.parametrize(
    "raw,masked,by_id",
    [
        ("11010119900101123X", "110101********123X", "110101********123X"),
        ("13812345678", "138****5678", "13812345678"),
        ("joe@example.com", "jo***example.com", "joe@example.com"),
        ("a@example.com", "a@***example.com", "a@example.com"),
        ("x@y@z.com", "x@y@***z.com", "x@y@z.com"),
    ],
)
def test_masking(spark, raw, masked, by_id):
    assert value(spark, X.mask_personal(F.lit(raw))) == masked
    assert value(spark, X.mask_id_numbers(F.lit(raw))) == by_id


def test_clip_keeps_head_and_tail(spark):
    body = "h" * 2200 + "m" * 500 + "t" * 1200
    clipped = value(spark, X.clip_head_tail(F.lit(body)))
    assert clipped.startswith("h" * 2200 + "\n") and clipped.endswith("\n" + "t" * 1200) and "m" not in clipped
    assert value(spark, X.clip_head_tail(F.lit("short"))) == "short"


def test_lenient_conversions(spark):
    assert value(spark, X.to_float(F.lit("abc"), 0.7)) == 0.7
    assert value(spark, X.year_in(F.lit("since 2015.07"))) == 2015
    assert value(spark, X.year_in(F.lit("至今"))) == 0
    assert value(spark, X.clean_strings(F.array(F.lit(" a "), F.lit(" "), F.lit(None)))) == ["a"]
    assert value(spark, X.one_of(F.lit("x"), ["a"], "a")) == "a"
    assert value(spark, X.split_times(F.lit("a\n\n b \n"))) == ["a", "b"]


def test_labels_are_sorted_and_quoted(spark):
    labels = F.create_map(F.lit("status"), F.lit("200"), F.lit("method"), F.lit("GET"))
    assert value(spark, label_string(labels)) == '{method="GET",status="200"}'
    assert value(spark, label_string(F.lit(None).cast("map<string,string>"))) == ""


@pytest.mark.parametrize(
    "skill,exact,near",
    [
        ("Python", "Python", "Python"), ("golang", "Go", "Go"), ("Spring Boot", "Java", "Java"),
        ("JavaScript", None, "Java"), ("机器学习", "Machine Learning", "Machine Learning"), ("Kotlin", None, None),
    ],
)
def test_skill_rules(spark, skill, exact, near):
    assert value(spark, K.rule_tag(F.lit(skill))) == exact
    assert value(spark, K.rule_tag(F.lit(skill), substring=True)) == near


def test_match_skills_dedupes_last(spark):
    profiles = spark.createDataFrame([(1, ["golang", "Foo", "go", "Bar"]), (2, [])], "id int, skills array<string>")
    nearest = spark.createDataFrame([("Foo", "SQL"), ("Bar", "SQL")], "skill string, tag string")
    rows = K.match_skills(profiles, ["id"], nearest).collect()
    assert {r["id"]: r["skills"] for r in rows} == {1: ["Go", "SQL"], 2: []}


def test_parsed_records(spark):
    jd = value(spark, I.parse_jd(F.lit('{"title": "", "hard_requirements": [" a ", ""], "skill_graph": "x", "job_category": " TECH"}')))
    assert jd.title == "未命名岗位" and jd.hard_requirements == ["a"] and jd.skill_graph == [] and jd.job_category == "tech"
    resume = value(
        spark,
        I.parse_resume(F.lit('{"name": "N", "work_experience": [{"company": "c", "title": 3}, "x"], "skills": [" a", ""]}')),
    )
    assert resume.name == "N" and resume.email == "" and resume.skills == ["a"] and resume.education == []
    assert [tuple(w) for w in resume.work_experience] == [("c", "3", "", "", "")]
