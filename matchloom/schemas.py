"""Record types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

WORK_EXPERIENCE = _struct(
    ("company", _S), ("title", _S), ("start_date", _S), ("end_date", _S), ("description", _S)
)
EDUCATION = _struct(
    ("school", _S), ("degree", _S), ("major", _S), ("start_date", _S), ("end_date", _S)
)
STRUCTURED = _struct(
    ("work_experience", T.ArrayType(WORK_EXPERIENCE)),
    ("education", T.ArrayType(EDUCATION)),
    ("skills", T.ArrayType(_S)),
)
JD = _struct(
    ("title", _S),
    ("hard_requirements", T.ArrayType(_S)),
    ("soft_requirements", T.ArrayType(_S)),
    ("skill_graph", T.ArrayType(_S)),
    ("job_category", _S),
)
JOBS = _struct(
    ("tenant_id", _S), ("job_id", _S), ("title", _S), ("jd", JD),
    ("weights_override", T.MapType(_S, _S)), ("screen_overrides", T.MapType(_S, _S)),
)
CANDIDATES = _struct(
    ("tenant_id", _S), ("candidate_id", _S), ("email", _S), ("resume_text", _S),
    ("structured", STRUCTURED), ("profile_hash", _S), ("created_at", T.TimestampType()),
)
CHUNKS = _struct(
    ("tenant_id", _S), ("candidate_id", _S), ("chunk_index", _I), ("chunk", _S),
    ("embedding", T.ArrayType(T.FloatType())),
)
PANEL = _struct(
    ("tenant_id", _S), ("job_id", _S), ("candidate_id", _S), ("agent", _S), ("score", _D),
    ("dimension_scores", T.MapType(_S, _D)), ("evidence", T.ArrayType(_S)), ("confidence", _D),
)
TURNS = _struct(
    ("tenant_id", _S), ("job_id", _S), ("candidate_id", _S), ("round", _I), ("agent", _S),
    ("stance", _S), ("content", _S), ("score", _D), ("score_delta", _D),
)
MATCH_RESULTS = _struct(
    ("id", _S), ("tenant_id", _S), ("job_id", _S), ("candidate_id", _S), ("task_id", _S),
    ("overall_score", _D), ("dimension_scores", T.MapType(_S, _D)), ("recommendation_text", _S),
    ("evidence", T.ArrayType(_S)), ("discussion_json", _S), ("profile_hash", _S), ("config_hash", _S),
    ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()),
)
INTERACTIONS = _struct(
    ("id", _S), ("tenant_id", _S), ("session_id", _S), ("user_id", _S), ("event_type", _S),
    ("target_id", _S), ("job_id", _S), ("feedback", _S), ("created_at", T.TimestampType()),
)
COST_RECORDS = _struct(
    ("id", _S), ("tenant_id", _S), ("trace_id", _S), ("model_name", _S), ("tokens_prompt", _I),
    ("tokens_completion", _I), ("cost", T.DecimalType(12, 6)), ("created_at", T.TimestampType()),
)
TASKS = _struct(
    ("id", _S), ("tenant_id", _S), ("job_id", _S), ("user_id", _S), ("session_id", _S), ("status", _S),
    ("progress", _I), ("candidates_n", _I), ("error_msg", _S),
    ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()),
)
EVENTS = _struct(
    ("type", _S), ("task_id", _S), ("progress", _I), ("message", _S), ("payload", _S),
    ("occurred_at", T.LongType()),
)
OBSERVATIONS = _struct(
    ("name", _S), ("labels", T.MapType(_S, _S)), ("value", _D), ("ts", T.TimestampType())
)
