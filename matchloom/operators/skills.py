"""Skill standardisation: aliases first, then nearest standard tag by vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed
from matchloom.functions.text import clean_strings
from matchloom.operators.dense import unit_rows
from matchloom.operators.sizes import broadcast_if_small
from matchloom.sources.staging import stage


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(table, key)


def rule_tag(skill: Column, substring: bool = False) -> Column:
    """Standard tag of a raw skill by rules, NULL without one.

    Order: the tag itself, then an exact alias (lower case, no blanks). `substring` adds the first alias of
    three or more characters that contains or is contained in the key; it also maps `javascript` to Java.
    """
    key = F.replace(F.lower(F.trim(skill)), F.lit(" "), F.lit(""))
    itself = F.when(skill.isin(*fixed.STANDARD_TAGS), skill)
    if not substring:
        return F.coalesce(itself, _lookup(fixed.SKILL_ALIASES, key))

    def by_key(k: Column) -> Column:
        # A chain of tests ends at the first alias that fits.
        near = F
        for alias, name in fixed.SKILL_ALIASES:
            if len(alias) >= 3:
                near = near.when(k.contains(alias) | F.lit(alias).contains(k), name)
        return F.coalesce(_lookup(fixed.SKILL_ALIASES, k), near)

    # As a lambda variable the key is computed once, not per alias.
    return F.coalesce(itself, F.get(F.transform(F.array(key), by_key), F.lit(0)))


def standardise(skills: Column, substring: bool = False) -> Column:
    """Rule-mapped skills in order, the raw skill where no rule applies, repeats dropped."""
    return F.array_distinct(
        F.transform(clean_strings(skills), lambda s: F.coalesce(rule_tag(s, substring), s))
    )


def nearest_tags(skill_vectors: DataFrame, tag_vectors: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(skill, tag, similarity): nearest standard tag above the threshold, else tag is NULL.

    `tag_vectors` holds the fixed list of standard tags, so it is collected and sent along; every Arrow batch
    of skills is one matrix product. Equal similarities take the first tag name.
    """
    tags = sorted(tag_vectors.select("tag", "vector").collect(), key=lambda row: row["tag"])
    names = np.array([row["tag"] for row in tags], dtype=object)
    matrix = unit_rows(np.array([row["vector"] for row in tags], dtype="float64"))

    @F.pandas_udf("tag string, similarity double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if vectors.empty:
            return pd.DataFrame({"tag": [], "similarity": []})
        sims = np.round(unit_rows(np.stack(vectors.to_numpy()).astype("float64")) @ matrix.T, 6)
        best = sims.argmax(axis=1)
        return pd.DataFrame({"tag": names[best], "similarity": sims[np.arange(len(sims)), best]})

    found = skill_vectors.where(F.col("vector").isNotNull()).select("skill", nearest("vector").alias("_n"))
    similarity = F.col("_n.similarity")
    return found.select(
        "skill", F.when(similarity > threshold, F.col("_n.tag")).alias("tag"), similarity.alias("similarity")
    )


def match_skills(
    profiles: DataFrame, keys: list[str], nearest: DataFrame | None = None, substring: bool = False
) -> DataFrame:
    """(keys, skills): rules, then the nearest tag for the rest, order kept, repeats dropped last.

    `profiles` holds the keys and an array `skills`; `nearest` comes from `nearest_tags`.
    """
    if nearest is None:
        return profiles.select(*keys, standardise(F.col("skills"), substring).alias("skills"))
    exploded = profiles.select(*keys, F.posexplode_outer(clean_strings(F.col("skills"))).alias("_pos", "skill"))
    # Skills without a near tag stay as they are. The others are few: stored and counted, they meet the profiles' skills
    # without a shuffle by skill, where common ones would gather in one task.
    tagged = stage(nearest.where(F.col("tag").isNotNull()).select("skill", "tag"), "skill-tags")
    mapped = exploded.withColumn("_rule", rule_tag(F.col("skill"), substring)).join(
        broadcast_if_small(tagged), "skill", "left"
    )
    tag = F.coalesce("_rule", "tag", "skill")
    # One profile's skills: a bounded list per key.
    ordered = F.array_sort(F.collect_list(F.when(tag.isNotNull(), F.struct("_pos", tag.alias("tag")))))
    return mapped.groupBy(*keys).agg(
        F.array_distinct(F.transform(ordered, lambda s: s["tag"])).alias("skills")
    )
