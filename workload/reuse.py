"""Queries: fingerprints, cached verdicts, checkpoints, upserts, deletes, joins by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.text import tokenize
from matchloom.operators import incremental as C
from matchloom.operators.ranking import newest_per_key, older_duplicates
from workload import sql as S
from workload.registry import query

PEOPLE = """
people AS (
  SELECT c_mktsegment AS tenant_id, c_custkey AS candidate_id,
         CASE WHEN c_custkey % 11 = 0 THEN '' ELSE substr(sha256(c_name || chr(31) ||
           '{"nation":' || c_nationkey || ',"skills":' || to_json(list_sort([c_mktsegment, c_name, 'a']))::VARCHAR || '}'), 1, 32) END AS profile_hash
  FROM customer
),
config AS (
  SELECT DISTINCT c_mktsegment AS tenant_id, o_orderpriority AS job_id,
         substr(sha256('job-config-v1' || chr(31) || '{"jd":' || to_json('{"skills":["a","b"],"title":"' || o_orderpriority || '"}')::VARCHAR
           || ',"screen":"{}","weights":' || to_json('{"b":2,"x":1}')::VARCHAR || '}'), 1, 32) AS config_hash
  FROM orders JOIN customer ON o_custkey = c_custkey
),
verdict_log AS (
  SELECT o_orderkey AS id, p.tenant_id, o_orderpriority AS job_id, o_custkey AS candidate_id,
         'task-' || (o_orderkey % 50) AS task_id, round(o_totalprice / 10000, 2) AS overall_score,
         CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'stale' ELSE p.profile_hash END AS profile_hash,
         CASE WHEN o_orderkey % 6 = 0 THEN 'old' ELSE c.config_hash END AS config_hash, o_orderdate AS created_at
  FROM orders JOIN people p ON p.candidate_id = o_custkey
  JOIN config c ON c.tenant_id = p.tenant_id AND c.job_id = o_orderpriority
),
verdicts AS (
  SELECT * FROM verdict_log
  QUALIFY row_number() OVER (PARTITION BY tenant_id, job_id, candidate_id ORDER BY created_at DESC, id DESC) = 1
),
cached AS (SELECT * FROM verdicts WHERE profile_hash <> '')"""


# --- fingerprints ---


@query(
    "c1_profile_fingerprint",
    f"""
WITH {S.CANDIDATES},
skilled AS (
  SELECT d.*, lang, list_filter(toks, lambda x, i: list_position(toks, x) = i) AS skills
  FROM docs d JOIN documents ON doc_id = candidate_id
)
SELECT candidate_id, substr(sha256(text || chr(31) || '{{"lang":"' || lang || '","skills":' ||
         to_json(list_sort(skills))::VARCHAR || '}}'), 1, 32) AS profile_hash FROM skilled
""",
)
def _(t):
    docs = t.documents.select(
        "doc_id", "text",
        F.struct(
            F.array_distinct(tokenize(F.col("text"))).alias("skills"), F.col("lang")
        ).alias("structured"),
    )
    return docs.select(
        F.col("doc_id").alias("candidate_id"),
        C.profile_fingerprint(docs, "text", "structured").alias("profile_hash"),
    )


@query("c2_job_fingerprint", f"WITH {PEOPLE} SELECT * FROM config")
def _(t):
    return t.views.config_jobs().select("tenant_id", "job_id", "config_hash")


# --- verdicts ---


@query("w1_newest_verdict", f"WITH {PEOPLE} SELECT id, overall_score FROM verdicts")
def _(t):
    return t.views.verdicts().select("id", "overall_score")


@query(
    "j6_older_duplicates",
    f"WITH {PEOPLE} SELECT id FROM verdict_log WHERE id NOT IN (SELECT id FROM verdicts)",
)
def _(t):
    return older_duplicates(t.views.verdict_log(), C.PAIR, ["created_at", "id"]).select("id")


@query("c3_cached_verdicts", f"WITH {PEOPLE} SELECT id, profile_hash FROM cached")
def _(t):
    return C.cached_verdicts(t.views.verdicts()).select("id", "profile_hash")


@query(
    "c4_j3_reusable_verdicts",
    f"""
WITH {PEOPLE}
SELECT v.id, v.candidate_id, v.overall_score FROM cached v
JOIN people p USING (tenant_id, candidate_id) JOIN config c USING (tenant_id, job_id)
WHERE p.profile_hash <> '' AND v.profile_hash = p.profile_hash AND v.config_hash = c.config_hash
""",
)
def _(t):
    v = t.views
    kept = C.reusable(v.stored_candidates(), C.cached_verdicts(v.verdicts()), v.config_jobs())
    return kept.select("id", "candidate_id", "overall_score")


@query(
    "c5_miss_reasons",
    f"""
WITH {PEOPLE},
judged AS (
  SELECT c.tenant_id, c.job_id, CASE WHEN p.profile_hash = '' THEN 'no_hash' WHEN v.id IS NULL THEN 'no_verdict'
           WHEN v.profile_hash <> p.profile_hash THEN 'profile_changed' WHEN v.config_hash <> c.config_hash THEN 'config_changed'
           ELSE 'hit' END AS outcome
  FROM config c JOIN people p USING (tenant_id) LEFT JOIN cached v USING (tenant_id, job_id, candidate_id)
)
SELECT c.tenant_id, c.job_id, o.outcome, count(j.outcome) AS n
FROM config c CROSS JOIN (VALUES ('hit'), ('no_hash'), ('no_verdict'), ('profile_changed'), ('config_changed')) o(outcome)
LEFT JOIN judged j ON j.tenant_id = c.tenant_id AND j.job_id = c.job_id AND j.outcome = o.outcome GROUP BY ALL
""",
)
def _(t):
    v = t.views
    return C.reuse_counts(v.stored_candidates(), C.cached_verdicts(v.verdicts()), v.config_jobs())


def checkpoint_rows(t):
    """Finished reports of failed runs: orders of status F, with the verdict columns."""
    v = t.views
    failed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return newest_per_key(v.verdict_log().join(failed, "id", "left_semi"), C.PAIR, ["created_at", "id"])


@query(
    "c6_u3_merge_checkpoint",
    f"""
WITH {PEOPLE},
failed AS (
  SELECT v.* FROM verdict_log v JOIN orders ON o_orderkey = id WHERE o_orderstatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY v.tenant_id, v.job_id, v.candidate_id ORDER BY created_at DESC, id DESC) = 1
),
kept AS (SELECT * FROM cached)
SELECT id, false AS from_checkpoint FROM kept
UNION ALL SELECT id, true FROM failed f
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.tenant_id = f.tenant_id AND k.job_id = f.job_id AND k.candidate_id = f.candidate_id)
""",
)
def _(t):
    cached = C.cached_verdicts(t.views.verdicts())
    return C.merge_checkpoint(cached, checkpoint_rows(t)).select("id", "from_checkpoint")


@query(
    "c6_checked_checkpoint",
    f"""
WITH {PEOPLE},
kept AS (
  SELECT v.* FROM cached v JOIN people p USING (tenant_id, candidate_id) JOIN config c USING (tenant_id, job_id)
  WHERE p.profile_hash <> '' AND v.profile_hash = p.profile_hash AND v.config_hash = c.config_hash
),
failed AS (
  SELECT v.* FROM verdict_log v JOIN orders ON o_orderkey = id WHERE o_orderstatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY v.tenant_id, v.job_id, v.candidate_id ORDER BY created_at DESC, id DESC) = 1
)
SELECT id, false AS from_checkpoint FROM kept
UNION ALL SELECT f.id, true FROM failed f JOIN people p USING (tenant_id, candidate_id) JOIN config c USING (tenant_id, job_id)
WHERE p.profile_hash <> '' AND f.profile_hash = p.profile_hash AND f.config_hash = c.config_hash
  AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.tenant_id = f.tenant_id AND k.job_id = f.job_id AND k.candidate_id = f.candidate_id)
""",
)
def _(t):
    v = t.views
    people, config = v.stored_candidates(), v.config_jobs()
    kept = C.reusable(people, C.cached_verdicts(v.verdicts()), config)
    return C.merge_checkpoint(kept, checkpoint_rows(t), people, config).select("id", "from_checkpoint")


@query(
    "c7_live_checkpoints",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 2 HOUR",
)
def _(t):
    checkpoints = t.events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("updated_at"))
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    return C.live_checkpoints(checkpoints, now).select("event_id")


@query(
    "c8_retry_plan",
    """
WITH tasks AS (
  SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded'
           ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'running' END END AS status FROM orders
),
done AS (SELECT l_orderkey AS task_id, count(*) AS reused FROM lineitem GROUP BY ALL)
SELECT task_id, status NOT IN ('pending', 'running') AS can_retry,
       CASE WHEN status NOT IN ('pending', 'running') THEN coalesce(reused, 0) ELSE 0 END AS reused
FROM tasks LEFT JOIN done USING (task_id)
""",
)
def _(t):
    busy = F.when(F.col("o_orderkey") % 2 == 0, "pending").otherwise("running")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded")
    tasks = t.orders.select(
        F.lit("t").alias("tenant_id"), F.col("o_orderkey").alias("task_id"), F.coalesce(status, busy).alias("status")
    )
    reports = t.lineitem.select(F.lit("t").alias("tenant_id"), F.col("l_orderkey").alias("task_id"))
    return C.retry_plan(tasks, reports).drop("tenant_id")


@query(
    "c9_cache_hit_counts",
    f"""
WITH {PEOPLE}
SELECT tenant_id, job_id, count(*) AS cache_hits FROM verdicts v
WHERE EXISTS (SELECT 1 FROM cached c WHERE c.id = v.id) GROUP BY ALL
""",
)
def _(t):
    verdicts = t.views.verdicts()
    return C.cache_hit_counts(verdicts, C.cached_verdicts(verdicts))


# --- upserts and deletes ---


def uploads(t):
    """Stored and freshly uploaded candidates: suppliers meet customers by (nation, number)."""
    old = t.customer.select(
        F.col("c_nationkey").alias("tenant_id"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("email"),
        F.concat(F.lit("old"), F.col("c_custkey").cast("string")).alias("id"), F.lit(1).alias("created"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
    )
    new = t.supplier.select(
        F.col("s_nationkey").alias("tenant_id"), F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("email"),
        F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("id"), F.lit(2).alias("created"),
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
    )
    # Half of the suppliers re-upload the customer of the same number, in that customer's tenant.
    again = new.join(old.select("email", F.col("tenant_id").alias("_t")), "email").select(
        F.when(F.substring("id", 4, 9).cast("int") % 2 == 0, F.col("_t")).otherwise(F.col("tenant_id")).alias("tenant_id"),
        "email", "id", "created", "name", "balance",
    )
    return old, again


_UPLOADS = """
old AS (SELECT c_nationkey AS tenant_id, 'm' || c_custkey AS email, 'old' || c_custkey AS id, 1 AS created,
               c_name AS name, c_acctbal AS balance FROM customer),
new AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN c_nationkey ELSE s_nationkey END AS tenant_id, 'm' || s_suppkey AS email,
               'new' || s_suppkey AS id, 2 AS created, s_name AS name, s_acctbal AS balance
        FROM supplier JOIN customer ON c_custkey = s_suppkey)"""


@query(
    "s8_candidate_upsert",
    f"""
WITH {_UPLOADS}
SELECT tenant_id, email, coalesce(o.id, n.id) AS id, coalesce(o.created, n.created) AS created,
       coalesce(n.name, o.name) AS name, coalesce(n.balance, o.balance) AS balance
FROM old o FULL JOIN new n USING (tenant_id, email)
""",
)
def _(t):
    old, new = uploads(t)
    return C.upsert(old, new, ["tenant_id", "email"], ["id", "created"])


@query(
    "s9_result_upsert",
    f"""
WITH {PEOPLE},
before AS (SELECT * FROM verdict_log WHERE created_at < TIMESTAMP '1999-01-01'
  QUALIFY row_number() OVER (PARTITION BY tenant_id, job_id, candidate_id ORDER BY created_at DESC, id DESC) = 1),
after AS (SELECT * FROM verdict_log WHERE created_at >= TIMESTAMP '1999-01-01'
  QUALIFY row_number() OVER (PARTITION BY tenant_id, job_id, candidate_id ORDER BY created_at DESC, id DESC) = 1)
SELECT tenant_id, job_id, candidate_id, coalesce(b.id, a.id) AS id, coalesce(a.overall_score, b.overall_score) AS overall_score,
       coalesce(a.task_id, b.task_id) AS task_id
FROM before b FULL JOIN after a USING (tenant_id, job_id, candidate_id)
""",
)
def _(t):
    from matchloom.plans.fine import store_results

    log = t.views.verdict_log()
    cut = F.col("created_at") < F.lit("1999-01-01").cast("timestamp_ntz")
    order = ["created_at", "id"]
    before, after = (newest_per_key(log.where(c), C.PAIR, order) for c in (cut, ~cut))
    return store_results(before, after).select(*C.PAIR, "id", "overall_score", "task_id")


@query(
    "s10_vector_replace",
    """
WITH fresh AS (SELECT vec_id - vec_id % 5 AS candidate_id, vec_id % 5 AS chunk_index, 'new' AS origin FROM embeddings WHERE label < 4),
     old AS (SELECT vec_id - vec_id % 5 AS candidate_id, vec_id % 5 AS chunk_index, 'old' AS origin FROM embeddings)
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE candidate_id NOT IN (SELECT candidate_id FROM fresh)
""",
)
def _(t):
    v = F.col("vec_id")
    key = [(v - v % 5).alias("candidate_id"), (v % 5).alias("chunk_index")]
    old = t.embeddings.select(*key, F.lit("old").alias("origin"))
    fresh = t.embeddings.where("label < 4").select(*key, F.lit("new").alias("origin"))
    return C.replace_groups(old, fresh, ["candidate_id"])


@query(
    "s11_delete_keys",
    """
SELECT l_orderkey, count(*) AS n FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL
""",
)
def _(t):
    doomed = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.delete_keys(t.lineitem, doomed, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s14_summary_upsert",
    """
WITH s AS (SELECT conv_id AS summary_id, turn, md5(text) AS digest FROM conversations)
SELECT summary_id, digest FROM s QUALIFY row_number() OVER (PARTITION BY summary_id ORDER BY turn DESC) = 1
""",
)
def _(t):
    rows = t.conversations.select(
        F.col("conv_id").alias("summary_id"), "turn", F.md5(F.col("text").cast("binary")).alias("digest")
    )
    first = newest_per_key(rows.where("turn = 0"), ["summary_id"], ["turn"])
    later = newest_per_key(rows.where("turn > 0"), ["summary_id"], ["turn"])
    return C.replace_groups(first, later, ["summary_id"]).select("summary_id", "digest")


@query(
    "j12_split_existing",
    f"""
WITH {_UPLOADS}
SELECT email, tenant_id, true AS known FROM new WHERE EXISTS (SELECT 1 FROM old WHERE old.tenant_id = new.tenant_id AND old.email = new.email)
UNION ALL
SELECT email, tenant_id, false FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.tenant_id = new.tenant_id AND old.email = new.email)
""",
)
def _(t):
    old, new = uploads(t)
    known, unknown = C.split_existing(new, old, ["tenant_id", "email"])
    both = known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))
    return both.select("email", "tenant_id", "known")
