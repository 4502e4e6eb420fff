"""How the given tables stand for the entities of matching and screening.

The same mapping is written twice: here for Spark, and in `workload.sql` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed
from matchloom.functions.text import chunk, tokenize
from matchloom.operators.sizes import dealt

AS_OF_YEAR = 2003
# Jobs are spread over the tenants; `en` holds most documents and gets most jobs.
JOB_TENANTS = ["en", "en", "en", "en", "de", "fr", "es"]
DEGREES = ["专科", "本科", "硕士", "博士"]
JOB_DEGREES = ["", "本科及以上学历", "硕士及以上学历"]
CATEGORY_BY_PRIORITY = {"1": "tech", "2": "management", "3": "design", "4": "general", "5": "other"}
EXPERT_BY_LINE = {
    1: "interviewer", 2: "skill_evaluator", 3: "culture_fit", 4: "stability_analyzer",
    5: "leadership", 6: "visual_evaluator", 7: "devils_advocate",
}

# Line items that one task may have to aggregate as panel rows: each takes some 500 bytes there.
LINES_PER_TASK = 250_000


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp_ntz"))


class Entities:
    def __init__(self, tables):
        self.t = tables

    # --- candidates, jobs, vectors ---

    def documents(self) -> DataFrame:
        """tenant_id, candidate_id, text."""
        return self.t.documents.select(
            F.col("lang").alias("tenant_id"), F.col("doc_id").alias("candidate_id"), "text"
        )

    def work_experience(self) -> DataFrame:
        """candidate_id, work_experience: one job span per order of the customer with that id."""
        start = F.year("o_orderdate")
        span = F.struct(
            start.cast("string").alias("start_date"),
            (start + F.col("o_orderkey") % 4).cast("string").alias("end_date"),
        )
        return self.t.orders.groupBy(F.col("o_custkey").alias("candidate_id")).agg(
            F.collect_list(span).alias("work_experience")
        )

    def candidates(self) -> DataFrame:
        """Documents with a structured profile: degree by id, jobs from orders, the distinct tokens as skills."""
        skills = F.array_distinct(tokenize(F.col("text")))
        degree = pick(DEGREES, F.col("candidate_id") % 4)
        return (
            self.documents()
            .join(self.work_experience(), "candidate_id", "left")
            .select(
                "tenant_id",
                "candidate_id",
                F.col("text").alias("resume_text"),
                F.struct(
                    F.col("work_experience"),
                    F.array(F.struct(degree.alias("degree"))).alias("education"),
                    skills.alias("skills"),
                ).alias("structured"),
            )
        )

    def jobs(self) -> DataFrame:
        """Benchmark items as jobs: requirements from id and tokens, the distinct tokens as skill graph."""
        distinct = F.array_distinct(tokenize(F.col("text")))
        item = F.col("item_id")
        return self.t.benchmark.select(
            pick(JOB_TENANTS, item % 7).alias("tenant_id"),
            item.alias("job_id"),
            F.col("text").alias("query"),
            F.concat(F.lit("job "), item.cast("string")).alias("title"),
            F.concat(
                F.array(pick(JOB_DEGREES, item % 3), F.concat((item % 6).cast("string"), F.lit(" 年"))),
                F.when(item % 4 == 0, F.array().cast("array<string>")).otherwise(distinct),
            ).alias("hard_requirements"),
            distinct.alias("skill_graph"),
        )

    def job_vectors(self) -> DataFrame:
        """tenant_id, job_id, vector: the vector with the job's id."""
        vectors = self.t.embeddings.select(F.col("vec_id").alias("job_id"), F.col("embedding").alias("vector"))
        return self.jobs().select("tenant_id", "job_id").join(vectors, "job_id")

    def chunk_texts(self) -> DataFrame:
        """tenant_id, candidate_id, chunk_index, chunk: all chunks of all documents."""
        return self.documents().select(
            "tenant_id",
            "candidate_id",
            F.posexplode(chunk(F.col("text"), 500, 50)).alias("chunk_index", "chunk"),
        )

    def chunks(self) -> DataFrame:
        """Chunks with a vector: the given vectors stand in for the embedder, by (candidate, chunk)."""
        vec_id = (F.col("candidate_id") + 97 * F.col("chunk_index")) % F.lit(self.t.embeddings.count())
        return (
            self.chunk_texts()
            .withColumn("vec_id", vec_id)
            .join(self.t.embeddings.select("vec_id", "embedding"), "vec_id")
            .drop("vec_id")
        )

    def raw_skills(self) -> DataFrame:
        """candidate_id, skills: the distinct tokens and one alias, chosen by id."""
        aliases = [alias for alias, _ in fixed.SKILL_ALIASES]
        alias = F.upper(pick(aliases, F.col("candidate_id") % len(aliases)))
        tokens = F.array_distinct(tokenize(F.col("text")))
        return self.documents().select("candidate_id", F.array_append(tokens, alias).alias("skills"))

    # --- panel rows ---

    def panel(self) -> DataFrame:
        """Line items as panel rows: the order is the candidate, its priority the job, its status the tenant."""
        orders = self.t.orders.select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_orderstatus").alias("tenant_id"),
            F.col("o_orderpriority").alias("job_id"),
        )
        agent = pick(list(EXPERT_BY_LINE.values()), F.col("l_linenumber") - 1)
        return (
            dealt(self.t.lineitem, ["l_orderkey"], LINES_PER_TASK)
            .join(orders, "l_orderkey")
            .select(
                "tenant_id",
                "job_id",
                F.col("l_orderkey").alias("candidate_id"),
                agent.alias("agent"),
                # Line, part, supplier and quantity packed into one number: the order of the results.
                (
                    ((F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 100
                    + F.col("l_quantity").cast("bigint")
                ).alias("pos"),
                "l_quantity",
                (F.col("l_quantity") * 2).alias("score"),
                (1.0 - F.col("l_discount")).alias("confidence"),
                F.create_map(
                    F.lit("depth"), F.col("l_quantity") * 2, F.lit("fit"), F.col("l_tax") * 1000
                ).alias("dimension_scores"),
                F.array(
                    F.concat(F.lit("part "), (F.col("l_partkey") % 20).cast("string")),
                    F.concat("l_returnflag", "l_linestatus"),
                ).alias("evidence"),
            )
        )

    def panel_seats(self) -> DataFrame:
        """One row per (candidate, expert): the first by `pos`."""
        from matchloom.operators.panel import PAIR

        rows = self.panel()
        rest = [c for c in rows.columns if c not in (*PAIR, "agent")]
        first = rows.groupBy(*PAIR, "agent").agg(F.min_by(F.struct(*rest), "pos").alias("_r"))
        return first.select(*PAIR, "agent", "_r.*")

    def panel_jobs(self) -> DataFrame:
        """tenant_id, job_id, job_category of the panel rows."""
        categories = F.create_map(*[F.lit(x) for kv in CATEGORY_BY_PRIORITY.items() for x in kv])
        return (
            self.t.orders.select(F.col("o_orderstatus").alias("tenant_id"), F.col("o_orderpriority").alias("job_id"))
            .distinct()
            .withColumn("job_category", F.try_element_at(categories, F.substring("job_id", 1, 1)))
        )

    def panel_weights(self) -> DataFrame:
        from matchloom.operators.panel import category_weights

        return self.panel_jobs().select(
            "tenant_id", "job_id", category_weights(F.col("job_category")).alias("weights")
        )

    def turns(self) -> DataFrame:
        """Conversations as discussions: two seats, two turns a round, the score from the text length."""
        return self.t.conversations.select(
            F.lit("t").alias("tenant_id"),
            (F.col("conv_id") % 10).alias("job_id"),
            F.col("conv_id").alias("candidate_id"),
            (F.floor(F.col("turn") / 2) + 1).cast("int").alias("round"),
            F.concat(F.lit("seat"), (F.col("turn") % 2).cast("string")).alias("agent"),
            (F.length("text") % 101).cast("double").alias("score"),
            "text",
        )

    # --- stored candidates and verdicts ---

    def stored_candidates(self) -> DataFrame:
        """Customers as stored candidates: the segment is the tenant; the hash covers name and profile."""
        from matchloom.operators.incremental import profile_fingerprint

        rows = self.t.customer.select(
            F.col("c_mktsegment").alias("tenant_id"),
            F.col("c_custkey").alias("candidate_id"),
            F.col("c_name").alias("resume_text"),
            F.struct(
                F.array(F.col("c_mktsegment"), F.col("c_name"), F.lit("a")).alias("skills"),
                F.col("c_nationkey").alias("nation"),
            ).alias("structured"),
        )
        hashed = rows.withColumn("profile_hash", profile_fingerprint(rows, "resume_text", "structured"))
        no_hash = F.col("candidate_id") % 11 == 0
        return hashed.withColumn("profile_hash", F.when(no_hash, "").otherwise(F.col("profile_hash")))

    def config_jobs(self) -> DataFrame:
        """One job per (segment, priority), with a configuration fingerprint."""
        from matchloom.operators.incremental import job_fingerprint

        jobs = (
            self.t.orders.join(self.t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_mktsegment").alias("tenant_id"), F.col("o_orderpriority").alias("job_id"))
            .distinct()
            .withColumn("jd", F.struct(F.col("job_id").alias("title"), F.array(F.lit("b"), F.lit("a")).alias("skills")))
            .withColumn("weights", F.create_map(F.lit("x"), F.lit(1), F.lit("b"), F.lit(2)))
            .withColumn("overrides", F.lit(None).cast("map<string,string>"))
        )
        return jobs.withColumn("config_hash", job_fingerprint(jobs, "jd", "weights", "overrides"))

    def verdict_log(self) -> DataFrame:
        """Orders as verdicts of (segment, priority, customer), several per pair, some stale."""
        key = F.col("o_orderkey")
        people = self.stored_candidates().select(
            "tenant_id", F.col("candidate_id").alias("o_custkey"), F.col("profile_hash").alias("_now")
        )
        rows = self.t.orders.join(people, "o_custkey").withColumn("job_id", F.col("o_orderpriority"))
        rows = rows.join(self.config_jobs().select("tenant_id", "job_id", F.col("config_hash").alias("_conf")), ["tenant_id", "job_id"])
        return rows.select(
            key.alias("id"),
            "tenant_id",
            "job_id",
            F.col("o_custkey").alias("candidate_id"),
            F.concat(F.lit("task-"), (key % 50).cast("string")).alias("task_id"),
            F.round(F.col("o_totalprice") / 10000, 2).alias("overall_score"),
            F.when(key % 7 == 0, "").when(key % 5 == 0, "stale").otherwise(F.col("_now")).alias("profile_hash"),
            F.when(key % 6 == 0, "old").otherwise(F.col("_conf")).alias("config_hash"),
            F.col("o_orderdate").alias("created_at"),
        )

    def verdicts(self) -> DataFrame:
        """The newest verdict of each pair."""
        from matchloom.operators.incremental import PAIR
        from matchloom.operators.ranking import newest_per_key

        return newest_per_key(self.verdict_log(), PAIR, ["created_at", "id"])

    # --- feedback and requests ---

    def feedback(self) -> DataFrame:
        """Events as feedback: purchase is suitable, error is not suitable, all else pending."""
        kind = F.col("event_type")
        return self.t.events.select(
            F.lit("t").alias("tenant_id"),
            "event_id",
            F.col("user_id"),
            (F.col("event_id") % 40).alias("job_id"),
            (F.col("event_id") % 97).alias("target_id"),
            F.when(kind == "purchase", "suitable").when(kind == "error", "not_suitable").otherwise("pending").alias("feedback"),
            F.floor(micros(F.col("ts")) / 1_000_000).alias("seconds"),
            "ts",
        )

    def observations(self) -> DataFrame:
        """Events as timed calls: the value in seconds, labelled by event type and user group."""
        return self.t.events.select(
            F.lit("call_seconds").alias("name"),
            F.create_map(
                F.lit("type"), F.col("event_type"), F.lit("group"), (F.col("user_id") % 3).cast("string")
            ).alias("labels"),
            "value",
            "ts",
        )

    def costs(self) -> DataFrame:
        """Line items as model calls: the return flag is the model, quantity and price give tokens."""
        from matchloom.operators.metrics import call_cost

        prompt = (F.col("l_quantity") * 10).cast("int")
        completion = F.floor(F.col("l_extendedprice") / 100).cast("int")
        return self.t.lineitem.select(
            F.col("l_linestatus").alias("tenant_id"),
            (F.col("l_orderkey")).alias("trace_id"),
            F.col("l_returnflag").alias("model_name"),
            prompt.alias("tokens_prompt"),
            completion.alias("tokens_completion"),
            F.round(call_cost(prompt, completion), 9).alias("cost"),
        )
