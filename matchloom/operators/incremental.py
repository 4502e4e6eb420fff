"""Fingerprints, reuse of earlier verdicts, upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = ["tenant_id", "job_id", "candidate_id"]
_UNIT_SEPARATOR = 31


# --- fingerprints ---


def _canonical(col: Column, dtype: T.DataType) -> Column:
    """The value with struct fields and map keys in name order, at every level."""
    if isinstance(dtype, T.StructType):
        parts = [_canonical(col[f.name], f.dataType).alias(f.name) for f in sorted(dtype, key=lambda f: f.name)]
        return F.struct(*parts)
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return F.transform(col, lambda x: _canonical(x, dtype.elementType))
        return col
    if isinstance(dtype, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(col)))
    return col


def canonical_json(col: Column, dtype: T.DataType) -> Column:
    """JSON text that does not depend on key order nor on the order of `skills`; NULL becomes `{}`."""
    ordered = _canonical(col, dtype)
    if isinstance(dtype, T.StructType) and "skills" in dtype.names:
        ordered = ordered.withField("skills", F.array_sort(col["skills"]))
    return F.coalesce(F.to_json(ordered), F.lit("{}"))


def digest(text: Column, canonical: Column) -> Column:
    body = F.concat(F.coalesce(text, F.lit("")), F.char(F.lit(_UNIT_SEPARATOR)), canonical)
    return F.substring(F.sha2(body, 256), 1, 32)


def profile_fingerprint(df: DataFrame, text: str, structured: str) -> Column:
    """32 hex digits over a candidate's text and structured profile."""
    return digest(F.col(text), canonical_json(F.col(structured), df.schema[structured].dataType))


def job_fingerprint(df: DataFrame, jd: str, weights: str, overrides: str) -> Column:
    """32 hex digits over everything that decides a job's scores."""
    parts = {
        name: canonical_json(F.col(column), df.schema[column].dataType)
        for name, column in (("jd", jd), ("screen", overrides), ("weights", weights))
    }
    payload = F.to_json(F.struct(*[value.alias(name) for name, value in parts.items()]))
    return digest(F.lit("job-config-v1"), payload)


# --- reuse ---


def cached_verdicts(match_results: DataFrame) -> DataFrame:
    """Verdicts that carry a profile hash; without one nobody can tell whether they still hold."""
    return match_results.where(F.coalesce("profile_hash", F.lit("")) != "")


def _compared(candidates: DataFrame, verdicts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Verdict pairs next to today's hashes; pairs without a verdict do not appear."""
    hashed = candidates.where(F.coalesce("profile_hash", F.lit("")) != "").select(
        "tenant_id", "candidate_id", F.col("profile_hash").alias("_profile_now")
    )
    configs = jobs.select("tenant_id", "job_id", F.col("config_hash").alias("_config_now"))
    same_profile = F.col("profile_hash") == F.col("_profile_now")
    same_config = F.coalesce(F.col("config_hash"), F.lit("")) == F.col("_config_now")
    return (
        verdicts.join(hashed, ["tenant_id", "candidate_id"])
        .join(configs, ["tenant_id", "job_id"])
        .withColumns({"_same_profile": same_profile, "_same_config": same_config})
    )


def reusable(candidates: DataFrame, verdicts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Verdicts whose profile and job fingerprints are both unchanged."""
    kept = _compared(candidates, verdicts, jobs).where(F.col("_same_profile") & F.col("_same_config"))
    return kept.select(*verdicts.columns)


def reuse_counts(candidates: DataFrame, verdicts: DataFrame, jobs: DataFrame) -> DataFrame:
    """(tenant, job, outcome, n) of all candidates per job: hit, or the first reason for a miss.

    Only pairs with a verdict are joined; the rest is counted by subtraction, so there is no
    jobs x candidates product.
    """
    has_hash = F.coalesce("profile_hash", F.lit("")) != ""
    sizes = candidates.groupBy("tenant_id").agg(
        F.count(F.when(has_hash, 1)).alias("_hashed"), F.count(F.when(~has_hash, 1)).alias("no_hash")
    )
    seen = (
        _compared(candidates, verdicts, jobs)
        .groupBy("tenant_id", "job_id")
        .agg(
            F.count(F.lit(1)).alias("_seen"),
            F.count(F.when(F.col("_same_profile") & F.col("_same_config"), 1)).alias("hit"),
            F.count(F.when(~F.col("_same_profile"), 1)).alias("profile_changed"),
            F.count(F.when(F.col("_same_profile") & ~F.col("_same_config"), 1)).alias("config_changed"),
        )
    )
    zero = F.lit(0).cast("bigint")
    wide = (
        jobs.select("tenant_id", "job_id")
        .join(sizes, "tenant_id", "left")
        .join(seen, ["tenant_id", "job_id"], "left")
        .withColumn("no_verdict", F.coalesce("_hashed", zero) - F.coalesce("_seen", zero))
    )
    outcomes = ["hit", "no_hash", "no_verdict", "profile_changed", "config_changed"]
    pairs = F.array(*[F.struct(F.lit(o).alias("outcome"), F.coalesce(o, zero).alias("n")) for o in outcomes])
    return wide.select("tenant_id", "job_id", F.explode(pairs).alias("p")).select("tenant_id", "job_id", "p.*")


def live_checkpoints(checkpoints: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Checkpoint rows not older than their time to live."""
    return checkpoints.where(F.col("updated_at") >= now - F.make_dt_interval(hours=F.lit(hours)))


def checkpoint_reports(events: DataFrame, now_ms: Column, ttl_ms: int = 7_200_000) -> DataFrame:
    """(task_id, ms, report) a retry may reuse: finished reports since the task's last `done`.

    Dropped once the newest of them is older than the time to live. `events`: task_id, ms, type, report.
    """
    relevant = events.where(F.col("type").isin("candidate_done", "done"))
    ends = relevant.groupBy("task_id").agg(
        F.max(F.when(F.col("type") == "done", F.col("ms"))).alias("_done"),
        F.max(F.when(F.col("type") == "candidate_done", F.col("ms"))).alias("_last"),
    )
    open_tasks = ends.where((now_ms - F.col("_last") <= ttl_ms) & (F.col("_last") > F.coalesce("_done", F.lit(-1))))
    return (
        relevant.where("type = 'candidate_done'")
        .join(open_tasks, "task_id")
        .where(F.col("ms") > F.coalesce("_done", F.lit(-1)))
        .select("task_id", "ms", "report")
    )


def merge_checkpoint(
    cached: DataFrame, checkpoint: DataFrame, candidates: DataFrame | None = None, jobs: DataFrame | None = None
) -> DataFrame:
    """Cached verdicts plus the finished reports of a failed run for pairs without one.

    With `candidates` (profile_hash) and `jobs` (config_hash), which go together, a report is taken only if it carries
    the fingerprints that both have now; one stored without fingerprints is then computed anew.
    """
    if (candidates is None) != (jobs is None):
        raise ValueError("give both candidates and jobs, or neither")
    if candidates is not None:
        checkpoint = reusable(candidates, checkpoint, jobs)
    added = checkpoint.join(cached.select(*PAIR), PAIR, "left_anti")
    return cached.withColumn("from_checkpoint", F.lit(False)).unionByName(
        added.withColumn("from_checkpoint", F.lit(True))
    )


def retry_plan(tasks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per task: whether it may be retried and how many finished reports the retry reuses."""
    done = checkpoints.groupBy("tenant_id", "task_id").agg(F.count(F.lit(1)).alias("reused"))
    allowed = ~F.col("status").isin("pending", "running")
    return tasks.join(done, ["tenant_id", "task_id"], "left").select(
        "tenant_id",
        "task_id",
        allowed.alias("can_retry"),
        F.when(allowed, F.coalesce("reused", F.lit(0).cast("bigint"))).otherwise(F.lit(0)).alias("reused"),
    )


def cache_hit_counts(listed: DataFrame, cached: DataFrame) -> DataFrame:
    hits = listed.join(cached.select(*PAIR), PAIR, "left_semi")
    return hits.groupBy("tenant_id", "job_id").agg(F.count(F.lit(1)).alias("cache_hits"))


# --- upserts and deletes ---


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Rows of `old` with the rows of `new` laid over them by key.

    A key met again takes the new values, but the columns in `keep` (id, creation time) stay; `new` has one
    row per key and the columns of `old`.
    """
    updated = [c for c in old.columns if c not in keys and c not in keep]
    left = old.select(*keys, F.struct(*keep, *updated).alias("_old"))
    right = new.select(*keys, F.struct(*keep, *updated).alias("_new"))
    joined = left.join(right, keys, "full")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    columns = {k: F.col(k) for k in keys}
    columns |= {c: F.when(is_old, F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")) for c in keep}
    columns |= {c: F.when(is_new, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) for c in updated}
    return joined.select(*[columns[c].alias(c) for c in old.columns])


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every old row of a key that `new` brings, then add the new rows (chunk vectors, summaries)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_keys(df: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(doomed.select(*keys), keys, "left_anti")


def split_existing(new: DataFrame, old: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose key exists, rows whose key is new)."""
    known = old.select(*keys)
    return new.join(known, keys, "left_semi"), new.join(known, keys, "left_anti")
