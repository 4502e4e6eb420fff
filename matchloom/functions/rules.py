"""Requirement and profile rules: degree, years, skills, tag hits, job stability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom import fixed
from matchloom.functions.text import year_in

_NO_STRINGS = "array<string>"


def strings(values: Column) -> Column:
    """NULL and the empty array mean the same."""
    return F.coalesce(values, F.array().cast(_NO_STRINGS))


def degree_level(text: Column) -> Column:
    """Highest level among the degree keywords the text contains, 0 without one."""
    level = F.lit(0)
    for word, value in sorted(fixed.DEGREE_LEVELS, key=lambda kv: kv[1]):
        level = F.when(text.contains(word), F.lit(value)).otherwise(level)
    return level


def _highest(levels: Column) -> Column:
    return F.coalesce(F.array_max(levels), F.lit(0))


def required_degree(requirements: Column) -> Column:
    return _highest(F.transform(strings(requirements), lambda r: degree_level(F.coalesce(r, F.lit("")))))


def candidate_degree(education: Column) -> Column:
    return _highest(F.transform(education, lambda e: degree_level(F.coalesce(e["degree"], F.lit("")))))


def required_years(requirements: Column) -> Column:
    """Number in the first requirement that states years, 0 without one. Full-width digits and blanks count."""
    numbers = F.transform(
        strings(requirements),
        lambda r: F.regexp_extract(
            F.translate(F.coalesce(r, F.lit("")), fixed.WIDE_DIGITS, fixed.PLAIN_DIGITS), fixed.REQUIREMENT_YEARS_PATTERN, 1
        ),
    )
    first = F.get(F.filter(numbers, lambda n: n != ""), F.lit(0))
    return F.coalesce(first.try_cast("int"), F.lit(0))


def required_skills(requirements: Column) -> Column:
    """Every technology-like token of the requirements, in order, repeats kept."""
    return F.flatten(
        F.transform(
            strings(requirements),
            lambda r: F.regexp_extract_all(
                F.coalesce(r, F.lit("")), F.lit(fixed.REQUIREMENT_SKILL_PATTERN), F.lit(0)
            ),
        )
    )


def needed_skills(requirements: Column, skill_graph: Column) -> Column:
    """Required skills that are also in the job's skill graph, in lower case."""
    lower = lambda values: F.transform(values, F.lower)
    return F.array_intersect(lower(required_skills(requirements)), lower(strings(skill_graph)))


def skill_set(skills: Column) -> Column:
    return F.transform(strings(skills), lambda s: F.lower(F.trim(s)))


def skill_hit(tag: Column, skills: Column, text: Column) -> Column:
    """Whether a tag is met by a set of lower-case skills or by a lower-case text.

    CJK tags match as substrings; other tags need a boundary on both sides.
    """
    low = F.lower(F.trim(F.coalesce(tag, F.lit(""))))
    body = F.coalesce(text, F.lit(""))
    quoted = F.concat(
        F.lit(r"(?<![a-z0-9+#.])\Q"), F.replace(low, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![a-z0-9+#])")
    )
    by_substring = F.exists(skills, lambda s: s.contains(low)) | body.contains(low)
    # No pattern is compiled for what does not even contain the tag.
    by_boundary = F.exists(skills, lambda s: s.contains(low) & F.rlike(s, quoted)) | (body.contains(low) & F.rlike(body, quoted))
    hit = F.array_contains(skills, low) | F.when(low.rlike(fixed.CJK_PATTERN), by_substring).otherwise(
        by_boundary
    )
    return F.when(low == "", F.lit(False)).otherwise(hit)


def job_spans(work_experience: Column, as_of_year: Column) -> Column:
    """(start, end) years of each job, sorted; an open end counts to `as_of_year`; no start, no span."""
    spans = F.transform(
        work_experience,
        lambda w: F.named_struct(
            F.lit("s"),
            year_in(w["start_date"]),
            F.lit("e"),
            F.greatest(
                F.when(year_in(w["end_date"]) > 0, year_in(w["end_date"])).otherwise(as_of_year),
                year_in(w["start_date"]),
            ),
        ),
    )
    return F.array_sort(F.filter(spans, lambda w: w["s"] > 0))


def merged_years(spans: Column) -> Column:
    """Total length of sorted spans, overlaps counted once."""
    zero = F.lit(0)

    def step(acc: Column, span: Column) -> Column:
        gap = span["s"] > acc["e"]
        return F.named_struct(
            F.lit("total"),
            F.when(gap, acc["total"] + acc["e"] - acc["s"]).otherwise(acc["total"]),
            F.lit("s"),
            F.when(gap, span["s"]).otherwise(acc["s"]),
            F.lit("e"),
            F.when(gap, span["e"]).otherwise(F.greatest(acc["e"], span["e"])),
        )

    start = F.named_struct(F.lit("total"), zero, F.lit("s"), zero, F.lit("e"), zero)
    return F.coalesce(
        F.aggregate(spans, start, step, lambda acc: acc["total"] + acc["e"] - acc["s"]), zero
    )


def candidate_years(work_experience: Column, as_of_year: Column) -> Column:
    return merged_years(job_spans(work_experience, as_of_year))


def stability(spans: Column) -> Column:
    """Score, confidence, mean tenure and job changes from a candidate's sorted job spans."""
    n = F.coalesce(F.size(spans), F.lit(0))
    tenures = F.filter(F.transform(spans, lambda w: w["e"] - w["s"]), lambda t: t > 0)
    total = F.aggregate(tenures, F.lit(0), lambda a, t: a + t)
    mean = F.when(F.size(tenures) > 0, total / F.size(tenures)).otherwise(F.lit(0.0))
    following = F.slice(spans, 2, F.greatest(n, F.lit(1)))
    gaps = F.zip_with(
        F.slice(spans, 1, F.greatest(n - 1, F.lit(0))),
        following,
        lambda a, b: F.greatest(b["s"] - a["e"], F.lit(0)),
    )
    gap_years = F.aggregate(gaps, F.lit(0), lambda a, g: a + F.coalesce(g, F.lit(0)))
    return stability_score(n, mean, gap_years)


def stability_score(n_jobs: Column, mean_tenure: Column, gap_years: Column) -> Column:
    """Struct of the stability verdict from its three inputs; no history gives a neutral score."""
    base = (
        F.when(mean_tenure >= 3, 90.0).when(mean_tenure >= 2, 80.0).when(mean_tenure >= 1, 65.0).otherwise(40.0)
    )
    penalty = F.least(gap_years * F.lit(8.0), F.lit(24.0))
    none = n_jobs == 0
    return F.struct(
        F.when(none, F.lit(60.0)).otherwise(F.greatest(F.lit(0.0), base - penalty)).alias("score"),
        F.when(none, F.lit(0.3)).otherwise(F.lit(0.9)).alias("confidence"),
        F.when(none, F.lit(0.0)).otherwise(mean_tenure).alias("tenure"),
        F.when(none, F.lit(0)).otherwise(n_jobs - 1).cast("int").alias("job_changes"),
    )
