"""Rule filter: which candidates meet the hard requirements of which job.

Both sides are reduced before they meet: jobs to distinct rules, candidates to their degree, years and
skill terms. Rules with skills meet candidates on equal terms, rules without skills on equal
(degree, years) cells. Only pairs that pass are produced; there is no jobs x candidates product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import rules
from matchloom.functions.text import is_plain_run, run_terms, term_runs
from matchloom.operators.sizes import broadcast_if_small, is_small


def job_rules(jobs: DataFrame, requirements: str = "hard_requirements", graph: str = "skill_graph") -> DataFrame:
    """Add need_degree, need_years, need_skills and the rule_id that jobs with equal needs share."""
    reqs = F.col(requirements)
    needs = jobs.withColumns(
        {
            "need_degree": rules.required_degree(reqs),
            "need_years": rules.required_years(reqs),
            "need_skills": F.array_sort(rules.needed_skills(reqs, F.col(graph))),
        }
    )
    key = F.concat_ws("|", "need_degree", "need_years", F.array_join("need_skills", " "))
    return needs.withColumn("rule_id", F.md5(key.cast("binary")))


def distinct_rules(jobs_with_rules: DataFrame) -> DataFrame:
    return jobs_with_rules.select(
        "tenant_id", "rule_id", "need_degree", "need_years", "need_skills"
    ).dropDuplicates(["tenant_id", "rule_id"])


def candidate_facts(candidates: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """Degree level, years of experience, lower-case skills and text of each candidate."""
    year = F.year(F.current_date()) if as_of_year is None else F.lit(as_of_year)
    return candidates.select(
        "tenant_id",
        "candidate_id",
        rules.candidate_degree(F.col("structured.education")).alias("degree"),
        rules.candidate_years(F.col("structured.work_experience"), year).alias("years"),
        rules.skill_set(F.col("structured.skills")).alias("skills"),
        F.lower(F.coalesce(F.col("resume_text"), F.lit(""))).alias("text"),
    )


def _terms_found(facts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tenant, candidate, term, degree, years) for the terms of the vocabulary; some of them come twice.

    Terms come from the skills and the text. Those outside the vocabulary are dropped before anything is
    deduplicated or shuffled; the vocabulary is broadcast if it is small enough.
    """
    keys = ["tenant_id", "candidate_id", "degree", "years"]
    # No run holds a blank, so skills and text are searched as one; each run of a candidate is looked up once.
    whole = F.concat_ws(" ", F.array_join("skills", " "), "text")
    runs = facts.select(*keys, F.explode(F.array_distinct(term_runs(whole))).alias("run"))
    run = F.col("run")
    hint = F.broadcast if is_small(vocabulary) else (lambda df: df)

    # Most runs are plain words outside the vocabulary; only the others are taken apart.
    known_words = vocabulary.select("tenant_id", F.col("term").alias("run"), F.lit(True).alias("_known"))
    kept = runs.join(hint(known_words), ["tenant_id", "run"], "left").where(
        F.col("_known").isNotNull() | ~is_plain_run(run)
    )
    terms = F.when(F.col("_known").isNotNull() & is_plain_run(run), F.array(run)).otherwise(run_terms(run))
    return kept.select(*keys, F.explode(terms).alias("term")).join(
        hint(vocabulary), ["tenant_id", "term"], "left_semi"
    )


def candidate_terms(facts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tenant, candidate, term, degree, years) for the terms of the vocabulary, each once."""
    return _terms_found(facts, vocabulary).dropDuplicates(["tenant_id", "candidate_id", "term"])


def hard_filter_pool(rule_table: DataFrame, facts: DataFrame) -> DataFrame:
    """(tenant_id, rule_id, candidate_id) of every candidate that passes a rule."""
    enough = (F.col("degree") >= F.col("need_degree")) & (F.col("years") >= F.col("need_years"))

    with_skills = rule_table.where(F.size("need_skills") > 0).select(
        "tenant_id", "rule_id", "need_degree", "need_years", F.explode("need_skills").alias("term")
    )
    vocabulary = with_skills.select("tenant_id", "term").distinct()
    # The pairs are made distinct, so the terms need not be: they meet the rules without a shuffle of their own.
    by_term = (
        _terms_found(facts, vocabulary)
        .join(broadcast_if_small(with_skills), ["tenant_id", "term"])
        .where(enough)
        .select("tenant_id", "rule_id", "candidate_id")
        .distinct()
    )

    cells = facts.groupBy("tenant_id", "degree", "years").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    open_cells = (
        rule_table.where(F.size("need_skills") == 0)
        .select("tenant_id", "rule_id", "need_degree", "need_years")
        .join(cells, "tenant_id")
        .where(enough)
        .select("tenant_id", "rule_id", "degree", "years")
    )
    # At most one row per (rule, degree, years): a few hundred per rule.
    by_cell = facts.join(open_cells, ["tenant_id", "degree", "years"]).select(
        "tenant_id", "rule_id", "candidate_id"
    )
    return by_term.unionByName(by_cell)


def hard_filter(jobs: DataFrame, candidates: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """(tenant_id, job_id, candidate_id) of every passing pair; jobs without requirements pass all."""
    ruled = job_rules(jobs)
    pool = hard_filter_pool(distinct_rules(ruled), candidate_facts(candidates, as_of_year))
    return ruled.select("tenant_id", "job_id", "rule_id").join(pool, ["tenant_id", "rule_id"]).drop("rule_id")


def filter_funnel(jobs: DataFrame, candidates: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """Candidates per job before and after the filter; jobs that nobody passes are kept with 0."""
    pool_sizes = candidates.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    ruled = job_rules(jobs)
    passed = (
        hard_filter_pool(distinct_rules(ruled), candidate_facts(candidates, as_of_year))
        .groupBy("tenant_id", "rule_id")
        .agg(F.count(F.lit(1)).alias("n_passed"))
    )
    return (
        ruled.select("tenant_id", "job_id", "rule_id")
        .join(pool_sizes, "tenant_id", "left")
        .join(passed, ["tenant_id", "rule_id"], "left")
        .select(
            "tenant_id",
            "job_id",
            F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
            F.coalesce("n_passed", F.lit(0)).alias("n_passed"),
        )
    )
