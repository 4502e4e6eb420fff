"""Ingest: model answers to typed records, records to tables, texts to chunks and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import fixed
from matchloom.functions.text import (
    chunk,
    clean_strings,
    clip_head_tail,
    mask_id_numbers,
    mask_personal,
    one_of,
    truncate,
)
from matchloom.operators.incremental import profile_fingerprint, replace_groups
from matchloom.operators.panel import is_json_object
from matchloom.operators.skills import match_skills
from matchloom.schemas import EDUCATION, WORK_EXPERIENCE
from matchloom.sources.staging import stage
from matchloom.sources.tables import with_ids


def _fields(names: list[str]) -> T.StructType:
    """Every field as text; nested values keep their JSON."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _text(value: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def _string_list(json: Column) -> Column:
    return clean_strings(F.when(json.startswith("["), F.from_json(json, T.ArrayType(T.StringType()))))


def _record_list(json: Column, record: T.StructType) -> Column:
    """Objects of a JSON array with every field as text, '' where missing."""
    items = F.filter(
        F.when(json.startswith("["), F.from_json(json, T.ArrayType(T.StringType()))),
        lambda x: x.startswith("{"),
    )
    records = F.transform(items, lambda x: F.from_json(x, record))
    filled = F.transform(
        records, lambda r: F.struct(*[F.coalesce(r[n], F.lit("")).alias(n) for n in record.names])
    )
    return F.coalesce(filled, F.array().cast(T.ArrayType(record)))


def split_model_answers(df: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose answer is a JSON object, the others)."""
    good = is_json_object(F.col(raw))
    return df.where(good), df.where(~good)


def jd_model_input(jd_text: Column) -> Column:
    """The text given to the extraction model: first 20 000 characters, id numbers masked."""
    return mask_id_numbers(truncate(jd_text, 20_000))


def parse_jd(raw: Column) -> Column:
    """Struct(title, hard_requirements, soft_requirements, skill_graph, job_category)."""
    lists = ["hard_requirements", "soft_requirements", "skill_graph"]
    answer = F.from_json(raw, _fields(["title", *lists, "job_category"]))
    category = F.lower(F.trim(F.coalesce(answer["job_category"], F.lit(""))))
    return F.struct(
        _text(answer["title"], fixed.UNTITLED_JOB).alias("title"),
        *[_string_list(answer[name]).alias(name) for name in lists],
        one_of(category, fixed.CATEGORIES, fixed.DEFAULT_CATEGORY).alias("job_category"),
    )


def resume_model_input(text: Column) -> Column:
    return mask_id_numbers(clip_head_tail(text))


def parse_resume(raw: Column) -> Column:
    """Struct(name, email, phone, work_experience, education, skills)."""
    texts = ["name", "email", "phone"]
    answer = F.from_json(raw, _fields([*texts, "work_experience", "education", "skills"]))
    return F.struct(
        *[_text(answer[n]).alias(n) for n in texts],
        _record_list(answer["work_experience"], WORK_EXPERIENCE).alias("work_experience"),
        _record_list(answer["education"], EDUCATION).alias("education"),
        _string_list(answer["skills"]).alias("skills"),
    )


def parse_reply_intent(raw: Column) -> Column:
    """Struct(intent, new_times, message): at most five times, message masked and cut."""
    answer = F.from_json(raw, _fields(["intent", "new_times", "message"]))
    message = mask_personal(F.coalesce(answer["message"], F.lit("")))
    return F.struct(
        one_of(_text(answer["intent"], "other"), fixed.REPLY_INTENTS, "other").alias("intent"),
        F.slice(_string_list(answer["new_times"]), 1, 5).alias("new_times"),
        F.substring(message, 1, 200).alias("message"),
    )


def parse_invitation(raw: Column, job_title: Column) -> Column:
    """Struct(subject, body): default subject names the job, body masked."""
    answer = F.from_json(raw, _fields(["subject", "body"]))
    default = F.concat(F.lit(fixed.INVITATION_SUBJECT), job_title)
    return F.struct(
        F.coalesce(F.nullif(answer["subject"], F.lit("")), default).alias("subject"),
        mask_personal(F.coalesce(answer["body"], F.lit(""))).alias("body"),
    )


def jobs_table(answers: DataFrame) -> DataFrame:
    """Job rows from (tenant_id, jd_text, raw answer); empty texts are no jobs."""
    parsed = answers.where(F.trim("jd_text") != "").withColumn("jd", parse_jd(F.col("raw")))
    return with_ids(parsed, "job_id").select(
        "tenant_id", "job_id", F.col("jd.title").alias("title"), "jd_text", "jd",
        F.col("jd.job_category").alias("job_category"),
    )


def candidates_table(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate rows with fingerprint, rejected rows) from (tenant_id, text, profile)."""
    flat = with_ids(profiles, "candidate_id").withColumn("structured", F.col("profile"))
    rows = flat.select(
        "tenant_id", "candidate_id",
        F.col("profile.name").alias("name"),
        F.col("profile.email").alias("email"),
        F.col("profile.phone").alias("phone"),
        F.col("text").alias("resume_text"),
        "structured",
        profile_fingerprint(flat, "text", "structured").alias("profile_hash"),
    )
    accepted = rows.where(F.col("email") != "")
    return accepted, rows.where(F.col("email") == "").withColumn("reason", F.lit("email_missing"))


def chunk_rows(texts: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(tenant, candidate, chunk_index, chunk, chunk_id) of every text."""
    pieces = F.posexplode(chunk(F.col("text"), size, overlap)).alias("chunk_index", "chunk")
    key = F.concat(F.col("candidate_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    return texts.select("tenant_id", "candidate_id", pieces).withColumn("chunk_id", key)


def vectorise(texts: DataFrame, embed: Callable[[Column], Column], size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunk rows with the vector that `embed` gives (a pandas UDF; NULL where the model failed)."""
    return chunk_rows(texts, size, overlap).withColumn("embedding", embed(F.col("chunk")))


def refresh_vectors(
    stored: DataFrame, texts: DataFrame, embed: Callable[[Column], Column], size: int = 500, overlap: int = 50
) -> tuple[DataFrame, DataFrame]:
    """(stored vectors brought up to date, candidates that failed) for new texts of some candidates.

    A candidate is replaced as a whole: one chunk without a vector is a failure, which keeps its old rows, and a text
    without chunks keeps them too. The new rows are written once, so the model sees every chunk once.
    `stored`: the columns of `chunk_rows` and embedding.
    """
    keys = ["tenant_id", "candidate_id"]
    made = stage(vectorise(texts, embed, size, overlap), "new-vectors")
    failed = made.where(F.col("embedding").isNull()).select(*keys).distinct()
    fresh = made.join(failed, keys, "left_anti").select(*stored.columns)
    return replace_groups(stored, fresh, keys), failed


def ingest_resumes(
    answers: DataFrame, nearest: DataFrame | None = None, substring_aliases: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, chunk rows, rejects) from (tenant_id, candidate_id, text, raw answer).

    Skills are standardised; rows whose answer is no JSON object or has no e-mail are rejects.
    """
    good, bad = split_model_answers(answers, "raw")
    parsed = good.withColumn("profile", parse_resume(F.col("raw")))
    keys = ["tenant_id", "candidate_id"]
    if nearest is None:
        # Rules only: a row-local expression, no shuffle.
        from matchloom.operators.skills import standardise

        skilled = parsed.withColumn("skills", standardise(F.col("profile.skills"), substring_aliases))
    else:
        matched = match_skills(
            parsed.select(*keys, F.col("profile.skills").alias("skills")), keys, nearest, substring_aliases
        )
        skilled = parsed.join(matched, keys)
    profiles = skilled.withColumn("profile", F.col("profile").withField("skills", F.col("skills")))
    accepted, rejected = candidates_table(profiles.select(*keys, "text", "profile"))
    rejects = rejected.select(*keys, "reason").unionByName(
        bad.select(*keys, F.lit("not_an_object").alias("reason"))
    )
    return accepted, chunk_rows(good.select(*keys, "text")), rejects
