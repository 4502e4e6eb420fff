"""Queries: reads, JSON columns, model answers to records, ingest, scalar functions, validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import fixed
from matchloom.functions import text as X
from matchloom.functions.model_points import embedder
from matchloom.operators import quality as Q
from matchloom.plans import ingest as I
from matchloom.sources import events as E
from matchloom.sources import resumes, tables
from matchloom.sources.staging import new_path
from workload import models
from workload import sql as S
from workload.entities import micros
from workload.registry import query

# --- reads, lookups, JSON columns ---


@query(
    "s1_tenant_rows",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def _(t):
    rows = t.orders.withColumnRenamed("o_orderstatus", "tenant_id")
    return tables.tenant_rows(rows, "F", "o_orderdate").select("o_orderkey", "o_totalprice")


@query(
    "s2_lookup",
    """
SELECT s_suppkey AS o_orderkey, o_custkey, o_orderkey IS NOT NULL AS found
FROM (SELECT s_suppkey + 14950 AS s_suppkey FROM supplier) LEFT JOIN orders ON o_orderkey = s_suppkey
""",
)
def _(t):
    wanted = t.supplier.select((F.col("s_suppkey") + 14950).alias("o_orderkey"))
    return tables.lookup(t.orders.select("o_orderkey", "o_custkey"), wanted, ["o_orderkey"])


def event_log(t):
    """Events as a screening log: one task per user; some lines are broken or have no type."""
    item = F.col("event_id")
    body = F.to_json(
        F.struct(
            F.when(item % 13 != 0, F.col("event_type")).alias("type"),
            F.when(item % 3 == 0, (item % 100).cast("int")).alias("progress"),
            F.when(item % 5 == 0, F.concat(F.lit("m "), item.cast("string"))).alias("message"),
            F.col("user_id").alias("candidate_id"),
            F.struct(
                F.col("event_type").alias("model_name"), (item % 500).cast("int").alias("tokens_prompt"),
                F.round("value", 2).alias("cost"),
            ).alias("usage"),
        )
    )
    line = F.when(item % 17 == 0, F.concat(body, F.lit("}{"))).when(item % 19 == 0, F.lit("[1, 2]")).otherwise(body)
    return t.events.select(
        (F.col("user_id") % 50).cast("string").alias("task_id"), F.floor(micros(F.col("ts")) / 1000).alias("occurred_at"),
        "event_id", line.alias("value"),
    )


LOG = """
log AS (
  SELECT event_id, (user_id % 50)::VARCHAR AS task_id, floor(epoch_us(ts) / 1000)::BIGINT AS occurred_at, event_type AS type,
         CASE WHEN event_id % 3 = 0 THEN (event_id % 100)::INT ELSE 0 END AS progress,
         CASE WHEN event_id % 5 = 0 THEN 'm ' || event_id ELSE '' END AS message,
         user_id AS candidate_id, (event_id % 500)::INT AS tokens_prompt, round(value, 2) AS cost
  FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0
)"""


@query(
    "s3_t1_event_lines",
    f"WITH {LOG} SELECT event_id, type, progress, message, candidate_id, tokens_prompt FROM log",
)
def _(t):
    return E.parse_event_lines(event_log(t)).select(
        "event_id", "type", "progress", "message",
        E.field("$.candidate_id", "bigint").alias("candidate_id"),
        E.field("$.usage.tokens_prompt", "int").alias("tokens_prompt"),
    )


@query(
    "s4_event_lines_written",
    """
SELECT '{"type":"' || event_type || '","task_id":' || user_id || ',"seq":' || event_id || '}' AS value FROM events
""",
)
def _(t):
    rows = t.events.select(
        F.col("event_type").alias("type"), F.col("user_id").alias("task_id"), F.col("event_id").alias("seq")
    )
    path = new_path(t.spark, "event-lines")
    E.write_event_lines(rows, path)
    return t.spark.read.text(path)


@query(
    "s5_s6_json_columns",
    """
SELECT event_id, (props->>'$.k')::INT AS k, CASE WHEN event_id % 3 = 0 THEN '[]' ELSE '["' || event_type || '"]' END AS tags,
       (event_id % 3 <> 0)::INT AS n_tags FROM events
""",
)
def _(t):
    props = tables.decode_json(F.col("props"), T.StructType([T.StructField("k", T.IntegerType())]))
    tags = tables.encode_string_list(F.when(F.col("event_id") % 3 != 0, F.array("event_type")))
    return t.events.select(
        "event_id", props["k"].alias("k"), tags.alias("tags"),
        F.size(tables.decode_string_list(tags)).alias("n_tags"),
    )


@query(
    "s7_f12_file_checks",
    """
SELECT page_id, CASE WHEN page_id % 6 = 5 THEN 'extension' WHEN strlen(html) > 4000 THEN 'too_large'
         WHEN page_id % 6 = 1 THEN 'signature' WHEN page_id % 6 = 4 THEN 'signature' END AS reason FROM pages
""",
)
def _(t):
    kind = F.col("page_id") % 6
    name = F.concat(
        F.lit("/in/cv."),
        F.when(kind <= 1, "PDF").when(kind == 2, "png").when(kind == 3, "jpg").when(kind == 4, "jpeg").otherwise("doc"),
    )
    lead = F.when(kind == 0, F.lit("25504446")).when(kind == 2, F.lit("89504E47")).when(kind == 3, F.lit("FFD8FF"))
    content = F.concat(F.unhex(F.coalesce(lead, F.lit("00"))), F.col("html").cast("binary"))
    reason = resumes.reject_reason(name, F.octet_length("html"), content, 4000)
    return t.pages.select("page_id", reason.alias("reason"))


@query(
    "s12_append_costs",
    "SELECT l_returnflag AS model_name, count(*) AS n, count(*) AS n_ids FROM lineitem GROUP BY ALL",
)
def _(t):
    path = new_path(t.spark, "cost-records")
    tables.append(tables.with_ids(t.views.costs()), path)
    return t.spark.read.parquet(path).groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids")
    )


@query(
    "s13_task_states",
    """
SELECT user_id AS task_id, arg_max(event_type, ts) AS status, count(*) AS updates FROM events GROUP BY ALL
""",
)
def _(t):
    from matchloom.streaming.folds import current_status

    rows = t.events.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"))
    return current_status(rows).select("task_id", "status", "updates")


@query(
    "s16_events_by_task",
    f"""
WITH {LOG},
ends AS (SELECT task_id, min(occurred_at) AS e FROM log WHERE type = 'error' GROUP BY ALL)
SELECT task_id, count(*) AS n FROM log LEFT JOIN ends USING (task_id) WHERE e IS NULL OR occurred_at <= e GROUP BY ALL
""",
)
def _(t):
    path = new_path(t.spark, "task-events")
    E.write_by_task(E.parse_event_lines(event_log(t)).select("task_id", "occurred_at", "type"), path, buckets=4)
    stored = t.spark.read.parquet(path)
    return E.until_end(stored).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


# --- model answers to records ---


def jd_answers(t):
    """A raw extraction answer per document; some fields are missing or of the wrong type."""
    d = F.col("doc_id")
    graph = F.array_distinct(X.tokenize(F.col("text")))
    body = F.concat(
        F.lit("{"),
        F.when(d % 4 != 0, F.concat(F.lit('"title": "'), "source", F.lit('", '))).otherwise(F.lit("")),
        F.lit('"hard_requirements": '),
        F.when(d % 5 == 0, F.lit('"none"')).otherwise(F.lit('[" a ", "", "b"]')),
        F.lit(', "skill_graph": '), F.to_json(graph),
        F.lit(', "job_category": "'),
        F.when(d % 3 == 0, F.lit(" Tech ")).when(d % 3 == 1, F.lit("design")).otherwise(F.lit("chef")),
        F.lit('"}'),
    )
    return t.documents.select(F.col("lang").alias("tenant_id"), d.alias("job_id"), F.col("text").alias("jd_text"), body.alias("raw"))


_JD = f"""
jd AS (
  SELECT d.*, doc_id AS job_id, CASE WHEN doc_id % 4 <> 0 THEN source ELSE '未命名岗位' END AS title,
         CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'a,b' END AS hard,
         array_to_string(list_filter(c.toks, lambda x, i: list_position(c.toks, x) = i), ',') AS graph,
         CASE doc_id % 3 WHEN 0 THEN 'tech' WHEN 1 THEN 'design' ELSE 'general' END AS job_category
  FROM documents d JOIN docs c ON c.candidate_id = d.doc_id
)"""


@query(
    "x1_f10_f11_jd_records",
    f"WITH {S.CANDIDATES}, {_JD} SELECT job_id, title, hard, '' AS soft, graph, job_category FROM jd",
)
def _(t):
    jd = jd_answers(t).withColumn("jd", I.parse_jd(F.col("raw")))
    joined = lambda name, alias: F.array_join(f"jd.{name}", ",").alias(alias)
    return jd.select(
        "job_id", "jd.title", joined("hard_requirements", "hard"), joined("soft_requirements", "soft"),
        joined("skill_graph", "graph"), "jd.job_category",
    )


@query(
    "x1_f8_jd_model_input",
    r"""
SELECT doc_id, md5(regexp_replace(substr(text, 1, 20000), '([0-9]{6})[0-9]{8}([0-9]{3}[0-9Xx])', '\1********\2', 'g')) AS digest FROM documents
""",
)
def _(t):
    model_input = I.jd_model_input(F.col("text"))
    return t.documents.select("doc_id", F.md5(model_input.cast("binary")).alias("digest"))


@query(
    "s17_jobs_table",
    f"WITH {S.CANDIDATES}, {_JD} SELECT lang AS tenant_id, job_category, count(*) AS n FROM jd WHERE trim(text) <> '' GROUP BY ALL",
)
def _(t):
    jobs = I.jobs_table(jd_answers(t).withColumn("job_id", F.col("job_id").cast("string")))
    return jobs.groupBy("tenant_id", "job_category").agg(F.count(F.lit(1)).alias("n"))


def resume_answers(t):
    """A raw profile answer per document: no e-mail for one in seven, no object for one in eleven."""
    d = F.col("doc_id")
    profile = F.to_json(
        F.struct(
            F.col("source").alias("name"),
            F.when(d % 7 != 0, F.concat(F.lit("c"), d.cast("string"), F.lit("@x.org"))).alias("email"),
            F.array(
                F.struct(
                    F.lit("acme").alias("company"), (2000 + d % 20).cast("string").alias("start_date"),
                    F.lit(5).alias("title"),
                )
            ).alias("work_experience"),
            F.array(F.lit("golang"), F.lit(" "), F.lit("Python"), F.lit("go"), F.col("lang")).alias("skills"),
        )
    )
    raw = F.when(d % 11 == 0, F.concat(F.lit("sorry: "), profile)).otherwise(profile)
    return t.documents.select(F.col("lang").alias("tenant_id"), d.alias("candidate_id"), "text", raw.alias("raw"))


@query(
    "x2_resume_records",
    """
SELECT doc_id AS candidate_id, source AS name, CASE WHEN doc_id % 7 <> 0 THEN 'c' || doc_id || '@x.org' ELSE '' END AS email,
       '' AS phone, 1 AS n_jobs, (2000 + doc_id % 20)::VARCHAR AS start_date, '5' AS title, '' AS end_date, 0 AS n_education,
       'golang,Python,go,' || lang AS skills
FROM documents WHERE doc_id % 11 <> 0
""",
)
def _(t):
    good, _bad = I.split_model_answers(resume_answers(t), "raw")
    first = F.get("p.work_experience", F.lit(0))
    return good.withColumn("p", I.parse_resume(F.col("raw"))).select(
        "candidate_id", "p.name", "p.email", "p.phone", F.size("p.work_experience").alias("n_jobs"),
        first["start_date"].alias("start_date"), first["title"].alias("title"), first["end_date"].alias("end_date"),
        F.size("p.education").alias("n_education"), F.array_join("p.skills", ",").alias("skills"),
    )


@query(
    "x6_r4_s18_ingest",
    f"""
WITH {S.CANDIDATES}, {S.CHUNK_TEXTS},
kind AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'not_an_object' WHEN doc_id % 7 = 0 THEN 'email_missing' ELSE 'candidate' END AS what FROM documents)
SELECT what, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM kind GROUP BY ALL
UNION ALL SELECT 'chunk', count(*), sum(candidate_id)::BIGINT FROM chunk_texts WHERE candidate_id % 11 <> 0
UNION ALL SELECT 'skills: Go,Python,' || lang, count(*), sum(doc_id)::BIGINT FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 GROUP BY lang
""",
)
def _(t):
    accepted, chunks, rejects = I.ingest_resumes(resume_answers(t))
    skills = F.concat(F.lit("skills: "), F.array_join("structured.skills", ","))
    parts = [
        accepted.select(F.lit("candidate").alias("what"), "candidate_id"),
        chunks.select(F.lit("chunk").alias("what"), "candidate_id"),
        rejects.select(F.col("reason").alias("what"), "candidate_id"),
        accepted.select(skills.alias("what"), "candidate_id"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.sum("candidate_id").alias("id_sum"))


@query(
    "r3_r4_refreshed_vectors",
    f"""
WITH {S.CANDIDATES}, {S.CHUNK_TEXTS},
answers AS (SELECT candidate_id, chunk_index, md5(chunk) AS h FROM chunk_texts),
failed AS (SELECT DISTINCT candidate_id FROM answers WHERE h[1] = 'f' AND candidate_id % 2 = 0),
fresh AS (SELECT * FROM answers WHERE candidate_id % 2 = 0 AND candidate_id NOT IN (SELECT candidate_id FROM failed))
SELECT candidate_id, chunk_index::INT AS chunk_index, ('0x' || h[2:3])::BIGINT AS first FROM fresh
UNION ALL SELECT candidate_id, chunk_index::INT, -255 FROM answers
WHERE candidate_id % 3 <> 0 AND candidate_id NOT IN (SELECT candidate_id FROM fresh)
UNION ALL SELECT candidate_id, -1, 0 FROM failed
""",
)
def _(t):
    texts = t.views.documents()
    old = I.chunk_rows(texts.where("candidate_id % 3 <> 0")).withColumn("embedding", F.array(F.lit(-1.0).cast("float")))
    vectors, failed = I.refresh_vectors(old, texts.where("candidate_id % 2 = 0"), embedder(models.digest_encoder))
    first = F.round(F.get("embedding", F.lit(0)) * 255).cast("bigint")
    return vectors.select("candidate_id", "chunk_index", first.alias("first")).unionByName(
        failed.select("candidate_id", F.lit(-1).alias("chunk_index"), F.lit(0).cast("bigint").alias("first"))
    )


@query(
    "x3_reply_intents",
    """
SELECT conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'other' ELSE 'decline' END AS intent,
       'a|b' AS new_times, 'call 138****5678 or jo***example.com' AS message FROM conversations
""",
)
def _(t):
    intent = F.when(F.length("text") % 3 == 0, "accept").when(F.length("text") % 3 == 1, "maybe").otherwise("decline")
    raw = F.concat(
        F.lit('{"intent": "'), intent,
        F.lit('", "new_times": ["a", " ", "b"], "message": "call 13812345678 or joe@example.com"}'),
    )
    return t.conversations.withColumn("r", I.parse_reply_intent(raw)).select(
        "conv_id", "turn", "r.intent", F.array_join("r.new_times", "|").alias("new_times"), "r.message"
    )


@query(
    "x4_invitations",
    """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Hello' ELSE '面试邀请：' || p_name END AS subject,
       'mail an***x.org, id 110101********123X' AS body FROM part
""",
)
def _(t):
    raw = F.concat(
        F.lit('{"subject": "'), F.when(F.col("p_partkey") % 2 == 0, "Hello").otherwise(""),
        F.lit('", "body": "mail ann@x.org, id 11010119900101123X"}'),
    )
    draft = t.part.withColumn("r", I.parse_invitation(raw, F.col("p_name")))
    return draft.select("p_partkey", "r.subject", "r.body")


# --- scalar functions ---

_EMAIL = r"([A-Za-z0-9._%+-]{2})[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})|([A-Za-z0-9._%+-]@)([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
_ID = r"([0-9]{6})[0-9]{8}([0-9]{3}[0-9Xx])"


@query(
    "f1_f2_masking",
    rf"""
WITH ids AS (SELECT doc_id, text, regexp_replace(text, '{_ID}', '\1********\2', 'g') AS by_id FROM documents)
SELECT doc_id, md5(by_id) AS by_id,
       md5(regexp_replace(regexp_replace(by_id, '(1[3-9][0-9])[0-9]{{4}}([0-9]{{4}})', '\1****\2', 'g'), '{_EMAIL}', '\1\3***\2\4', 'g')) AS masked
FROM ids
""",
)
def _(t):
    digest = lambda c: F.md5(c.cast("binary"))
    return t.documents.select(
        "doc_id",
        digest(X.mask_id_numbers(F.col("text"))).alias("by_id"),
        digest(X.mask_personal(F.col("text"))).alias("masked"),
    )


@query(
    "f3_years_in_text",
    r"SELECT page_id, coalesce(try_cast(regexp_extract(html, '(20[0-9]{2}|19[0-9]{2})', 1) AS INT), 0) AS year FROM pages",
)
def _(t):
    return t.pages.select("page_id", X.year_in(F.col("html")).alias("year"))


@query(
    "f9_json_brief",
    """
SELECT c_custkey, substr('{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}', 1, 40) AS brief FROM customer
""",
)
def _(t):
    return t.customer.select("c_custkey", X.json_brief(F.struct("c_name", "c_mktsegment"), 40).alias("brief"))


@query(
    "f13_longer_extraction",
    "SELECT doc_id, CASE WHEN length(source) < 50 AND length(text) > length(source) THEN text ELSE source END AS text FROM documents",
)
def _(t):
    return t.documents.select("doc_id", X.longer_extraction(F.col("source"), F.col("text")).alias("text"))


@query(
    "p8_proposed_times",
    f"""
WITH parts AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: {S.strip('p')}), lambda p: p <> '')[1:10] AS times FROM documents)
SELECT doc_id, len(times)::INT AS n, md5(array_to_string(times, '|')) AS digest FROM parts
""",
)
def _(t):
    times = X.split_times(F.col("text"))
    return t.documents.select(
        "doc_id", F.size(times).alias("n"), F.md5(F.array_join(times, "|").cast("binary")).alias("digest")
    )


@query(
    "p1_candidate_payload",
    """
SELECT doc_id, md5(text) AS text_digest, CASE WHEN doc_id % 4 = 0 THEN '{}' ELSE '{"lang":"' || lang || '"}' END AS structured FROM documents
""",
)
def _(t):
    from matchloom.plans.payload import candidate_payload

    rows = t.documents.select(
        F.col("doc_id").alias("candidate_id"), F.col("text").alias("resume_text"),
        F.when(F.col("doc_id") % 4 != 0, F.struct("lang")).alias("structured"),
    )
    payload = candidate_payload(rows)
    return payload.select(
        F.col("candidate_id").alias("doc_id"), F.md5(F.col("resume_text").cast("binary")).alias("text_digest"),
        F.col("structured_json").alias("structured"),
    )


@query(
    "p9_u1_batches",
    "SELECT lang, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM documents GROUP BY ALL",
)
def _(t):
    from matchloom.plans.payload import flatten_batches

    # Requests of two shapes: a list of batches, or one list of candidates.
    per_page = t.documents.groupBy("lang", F.floor(F.col("doc_id") / 50).alias("page")).agg(
        F.collect_list("doc_id").alias("ids")
    )
    none = F.array().cast("array<bigint>")
    many = per_page.where("page % 2 = 0").select(
        "lang", none.alias("candidates"), F.array("ids", none).alias("batches")
    )
    single = per_page.where("page % 2 = 1").select(
        "lang", F.col("ids").alias("candidates"), F.lit(None).cast("array<array<bigint>>").alias("batches")
    )
    flat = flatten_batches(many.unionByName(single), ["lang"])
    return flat.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("candidate").alias("id_sum"))


@query(
    "u5_u6_u7_array_sets",
    f"""
WITH {S.CANDIDATES}, {S.JOBS},
sets AS (SELECT job_id, toks, skill_graph, list_filter(dist, lambda x: len(x) > 3) AS other FROM jobs JOIN jobs1 USING (job_id, toks))
SELECT job_id, array_to_string(list_sort(list_intersect(skill_graph, other)), ',') AS both,
       array_to_string(list_filter(toks, lambda x, i: list_position(toks, x) = i), ',') AS distinct_tokens,
       array_to_string(list_filter(skill_graph, lambda x: NOT list_contains(other, x)), ',') AS only_graph FROM sets
""",
)
def _(t):
    rows = t.views.jobs().withColumn("toks", X.tokenize(F.col("query")))
    other = F.filter(F.array_distinct("toks"), lambda x: F.length(x) > 3)
    return rows.select(
        "job_id",
        F.array_join(F.array_sort(F.array_intersect("skill_graph", other)), ",").alias("both"),
        F.array_join(F.array_distinct("toks"), ",").alias("distinct_tokens"),
        F.array_join(F.array_except("skill_graph", other), ",").alias("only_graph"),
    )


# --- validation ---


@query(
    "v1_weight_violations",
    """
WITH w AS (SELECT l_linenumber, l_returnflag, l_discount, l_tax, l_orderkey, l_partkey, l_suppkey, l_quantity,
  CASE l_returnflag WHEN 'A' THEN 'tech' WHEN 'N' THEN 'general' ELSE 'odd' END AS category,
  l_linenumber = 7 AS none, round(l_quantity / 50, 2) AS a, round(1.03 - l_quantity / 50 - l_tax, 2) AS b FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  CASE WHEN none THEN '' ELSE array_to_string(list_filter([
    CASE WHEN l_linenumber = 1 AND category <> 'tech' THEN 'unknown_expert' END,
    CASE WHEN a <= 0 OR a > 1 OR b <= 0 OR b > 1 THEN 'weight_range' END,
    CASE WHEN round(a + b, 9) < 0.99 OR round(a + b, 9) > 1.01 THEN 'weight_sum' END], lambda x: x IS NOT NULL), ',') END AS violations
FROM w
""",
)
def _(t):
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    category = F.when(F.col("l_returnflag") == "A", "tech").when(F.col("l_returnflag") == "N", "general").otherwise("odd")
    a = F.round(quantity / 50, 2)
    b = F.round(F.lit(1.03) - quantity / 50 - F.col("l_tax"), 2)
    first = F.when(line == 1, "skill_evaluator").otherwise("interviewer")
    weights = F.when(line != 7, F.create_map(first, a, F.lit("culture_fit"), b))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        F.array_join(Q.weight_violations(category, weights), ",").alias("violations"),
    )


@query(
    "v2_override_violations",
    """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'unknown_key' WHEN 2 THEN 'value_type' WHEN 3 THEN 'unknown_key,value_type' ELSE '' END AS violations
FROM part
""",
)
def _(t):
    kind = F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit('{"rag_top_k": '), size, F.lit(', "rerank_mode": "cosine"}')))
        .when(kind == 1, F.concat(F.lit('{"evil": '), size, F.lit("}")))
        .when(kind == 2, F.lit('{"chunk_size": [1]}'))
        .when(kind == 3, F.lit('{"evil": {"a": 1}}'))
    )
    return t.part.select("p_partkey", F.array_join(Q.override_violations(text), ",").alias("violations"))


@query(
    "v3_feedback_kinds",
    "SELECT event_id, event_type NOT IN ('suitable', 'purchase') AS rejected FROM events",
)
def _(t):
    kind = F.when(F.col("event_type") == "purchase", "suitable").otherwise(F.col("event_type"))
    return t.events.select("event_id", (F.size(Q.feedback_violations(kind)) > 0).alias("rejected"))


@query(
    "v4_v7_request_checks",
    """
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 10 = 0 THEN 'tenant_missing' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'job_missing' END, CASE WHEN o_orderkey % 60 NOT BETWEEN 1 AND 50 THEN 'max_candidates' END],
  lambda x: x IS NOT NULL), ',') AS violations FROM orders
""",
)
def _(t):
    key = F.col("o_orderkey")
    tenant = F.when(key % 10 != 0, F.col("o_orderstatus"))
    job = F.when(key % 7 != 0, F.col("o_orderpriority")).otherwise("")
    found = Q.request_violations(tenant, job, key % 60)
    return t.orders.select("o_orderkey", F.array_join(found, ",").alias("violations"))


@query(
    "v5_interview_checks",
    """
SELECT doc_id, array_to_string(list_filter([CASE WHEN len(string_split(text, chr(10))) > 10 THEN 'proposed_times' END,
  CASE WHEN doc_id % 7 = 0 THEN 'email_missing' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents
""",
)
def _(t):
    email = F.when(F.col("doc_id") % 7 != 0, F.lit("a@x.org"))
    found = Q.interview_violations(F.split("text", r"\n"), email)
    return t.documents.select("doc_id", F.array_join(found, ",").alias("violations"))


@query(
    "f10_enum_fallback",
    """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'tech' WHEN p_size % 5 = 1 THEN 'design' ELSE 'general' END AS category FROM part
""",
)
def _(t):
    size = F.col("p_size") % 5
    value = F.when(size == 0, "tech").when(size == 1, "design").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", X.one_of(value, fixed.CATEGORIES, fixed.DEFAULT_CATEGORY).alias("category"))
