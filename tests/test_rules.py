import pytest
from pyspark.sql import functions as F

from matchloom.functions import rules
from matchloom.functions.text import run_terms
from matchloom.operators.hard_filter import filter_funnel, hard_filter
from matchloom.schemas import STRUCTURED

SKILL_HITS = [
    ("Java", ["javascript", "react"], "熟练 javascript/typescript", False),
    ("Java", ["java"], "java 后端", True),
    ("C", ["css"], "写过 css", False),
    ("C", ["c"], "", True),
    ("C++", ["c++", "ci/cd"], "", True),
    ("CI/CD", [], "负责 ci/cd 流水线", True),
    ("Node.js", ["node.js"], "", True),
    ("C++", ["c#"], "只会 c#", False),
    ("机器学习", ["机器学习平台"], "", True),
    ("机器学习", [], "负责机器学习平台建设", True),
    ("", ["x"], "x", False),
]


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def strings(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


@pytest.mark.parametrize("tag,skills,text,expected", SKILL_HITS)
def test_skill_hit(spark, tag, skills, text, expected):
    assert value(spark, rules.skill_hit(F.lit(tag), strings(*skills), F.lit(text))) is expected


@pytest.mark.parametrize(
    "text,tag,expected",
    [
        ("javascript", "java", False), ("java.", "java", True), ("java/go", "go", True), ("xjava", "java", False),
        ("c++11", "c++", False), ("c++", "c++", True), ("node.js", "node", True), ("node.js", "js", False),
        ("3d/go.", "go", True), ("a" * 40, "a" * 31, False), ("ci/cd", "ci/cd", True), ("ci/cd", "cd", True),
    ],
)
def test_terms_agree_with_the_boundary_pattern(spark, text, tag, expected):
    by_terms = F.array_contains(run_terms(F.lit(text)), tag)
    by_pattern = rules.skill_hit(F.lit(tag), strings(), F.lit(text))
    assert value(spark, by_terms) is expected
    assert value(spark, by_pattern) is expected


@pytest.mark.parametrize("text,level", [("本科及以上学历", 2), ("硕士以上", 3), ("具备良好沟通能力", 0), ("博士优先, 本科", 4)])
def test_required_degree(spark, text, level):
    assert value(spark, rules.required_degree(strings("沟通", text))) == level


def test_required_years_takes_the_first_number(spark):
    assert value(spark, rules.required_years(strings("经验", "3 年以上后端经验", "5年"))) == 3
    assert value(spark, rules.required_years(strings("经验丰富"))) == 0
    assert value(spark, rules.required_years(F.lit(None).cast("array<string>"))) == 0


def test_required_skills(spark):
    found = value(spark, rules.required_skills(strings("精通 FastAPI / Flask 等框架", "3 年以上经验")))
    assert found == ["FastAPI", "Flask"]


def profile(spark, degrees=(), jobs=(), skills=()):
    row = (
        [(None, None, s, e, None) for s, e in jobs],
        [(None, d, None, None, None) for d in degrees],
        list(skills),
    )
    return spark.createDataFrame([row], STRUCTURED)


@pytest.mark.parametrize(
    "jobs,years",
    [
        ([("2015.07", "")], 11),
        ([("2015.07", "2018.06"), ("2019.01", "2021.01")], 5),
        ([("2015", "2018"), ("2017", "2019"), ("2020", "2021")], 5),
        ([("2015-01", "至今"), ("", "2010")], 11),
        ([], 0),
        ([("2020", "2018")], 0),
    ],
)
def test_candidate_years(spark, jobs, years):
    df = profile(spark, jobs=jobs)
    assert df.select(rules.candidate_years(F.col("work_experience"), F.lit(2026))).first()[0] == years


def test_candidate_degree(spark):
    assert profile(spark, ["本科", "硕士"]).select(rules.candidate_degree(F.col("education"))).first()[0] == 3
    assert profile(spark).select(rules.candidate_degree(F.col("education"))).first()[0] == 0


def test_stability(spark):
    def verdict(jobs):
        df = profile(spark, jobs=jobs)
        spans = rules.job_spans(F.col("work_experience"), F.lit(2026))
        return df.select(rules.stability(spans).alias("v")).first()["v"].asDict()

    assert verdict([("2021", "2026")]) == {"score": 90.0, "confidence": 0.9, "tenure": 5.0, "job_changes": 0}
    assert verdict([]) == {"score": 60.0, "confidence": 0.3, "tenure": 0.0, "job_changes": 0}
    assert verdict([("2010", "2012"), ("2014", "2016")])["score"] == 80.0 - 16.0
    assert verdict([("2000", "2004"), ("2014", "2018")])["score"] == 90.0 - 24.0


def candidates(spark, rows):
    data = [
        ("t", cid, text, ([(None, None, s, e, None) for s, e in jobs], [(None, d, None, None, None) for d in degrees], skills))
        for cid, text, jobs, degrees, skills in rows
    ]
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("tenant_id", T.StringType()), T.StructField("candidate_id", T.StringType()),
            T.StructField("resume_text", T.StringType()), T.StructField("structured", STRUCTURED),
        ]
    )
    return spark.createDataFrame(data, schema)


def jobs(spark, rows):
    return spark.createDataFrame(
        [(tenant, job, reqs, graph) for tenant, job, reqs, graph in rows],
        "tenant_id string, job_id string, hard_requirements array<string>, skill_graph array<string>",
    )


def passed(spark, reqs, graph, rows):
    found = hard_filter(jobs(spark, [("t", "j", reqs, graph)]), candidates(spark, rows), 2026)
    return sorted(r["candidate_id"] for r in found.collect())


def test_hard_filter_word_boundary(spark):
    rows = [
        ("frontend", "熟练 JavaScript", [], [], ["JavaScript", "React"]),
        ("backend", "java 后端", [], [], ["Java"]),
    ]
    assert passed(spark, ["精通 Java 开发"], ["Java"], rows) == ["backend"]


def test_hard_filter_degree_and_skill(spark):
    rows = [("college", "Python", [], ["专科"], ["Python"]), ("bachelor", "Python", [], ["本科"], ["Python"])]
    assert passed(spark, ["本科及以上学历", "精通 Python"], ["Python"], rows) == ["bachelor"]
    # Without a skill in the requirements, skills do not restrict.
    assert passed(spark, ["本科及以上学历"], ["Go"], rows) == ["bachelor"]


def test_hard_filter_years(spark):
    rows = [
        ("c1", "", [("2020", "2024")], ["硕士"], ["Python"]),
        ("c2", "", [("2015", "2024")], ["本科"], ["Java"]),
        ("c3", "", [], ["硕士"], ["Go"]),
    ]
    assert passed(spark, ["硕士及以上学历", "3年以上经验"], ["Python", "Go"], rows) == ["c1"]
    assert passed(spark, [], [], rows) == ["c1", "c2", "c3"]
    assert passed(spark, None, None, rows) == ["c1", "c2", "c3"]


def test_hard_filter_stays_in_the_tenant(spark):
    found = hard_filter(
        jobs(spark, [("other", "j", [], [])]), candidates(spark, [("c1", "", [], [], [])]), 2026
    )
    assert found.count() == 0


def test_funnel_keeps_jobs_nobody_passes(spark):
    table = jobs(spark, [("t", "open", [], []), ("t", "strict", ["博士"], [])])
    rows = filter_funnel(table, candidates(spark, [("c1", "", [], ["本科"], [])]), 2026).collect()
    assert {r["job_id"]: (r["n_candidates"], r["n_passed"]) for r in rows} == {"open": (1, 1), "strict": (1, 0)}


def test_hard_filter_has_no_cross_join(spark):
    found = hard_filter(
        jobs(spark, [("t", "j", ["精通 Java"], ["Java"])]), candidates(spark, [("c1", "java", [], [], [])]), 2026
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_years_in_full_width_typography(spark):
    rows = [("3　年以上",), ("５年经验",), ("１０ 年",), ("无",)]
    df = spark.createDataFrame(rows, "r string")
    got = [r[0] for r in df.select(rules.required_years(F.array("r"))).collect()]
    assert got == [3, 5, 10, 0]
