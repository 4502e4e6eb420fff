"""Queries: feedback, boosts, result lists, costs, counters, histograms, windows, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom import fixed
from matchloom.functions.labels import counter_name
from matchloom.operators import feedback as B
from matchloom.operators import metrics as M
from matchloom.operators import quality as Q
from matchloom.operators import ranking as R
from matchloom.sources.tables import resolve_names
from workload.entities import micros
from workload.registry import query
from workload.reuse import PEOPLE

FEEDBACK = """
fb AS (
  SELECT event_id, user_id, event_id % 40 AS job_id, event_id % 97 AS target_id, floor(epoch_us(ts) / 1000000)::BIGINT AS seconds, ts,
         CASE event_type WHEN 'purchase' THEN 'suitable' WHEN 'error' THEN 'not_suitable' ELSE 'pending' END AS feedback,
         CASE event_type WHEN 'purchase' THEN 0.05 WHEN 'error' THEN -0.05 ELSE 0 END::DOUBLE AS step
  FROM events
)"""

BOOSTS = f"""
{FEEDBACK},
boosts AS (SELECT user_id, greatest(-0.15, least(0.15, round(sum(step), 6))) AS boost FROM fb GROUP BY ALL)"""


# --- feedback ---


@query("a15_preference_boosts", f"WITH {BOOSTS} SELECT * FROM boosts")
def _(t):
    return B.preference_boosts(t.views.feedback(), ["user_id"])


@query(
    "t8_boost_with_ttl",
    f"""
WITH {FEEDBACK},
marked AS (
  SELECT *, CASE WHEN seconds - lag(seconds) OVER (PARTITION BY user_id ORDER BY seconds, event_id) >= 86400 THEN 1 ELSE 0 END AS pause FROM fb
),
stretched AS (
  SELECT *, sum(pause) OVER (PARTITION BY user_id ORDER BY seconds, event_id ROWS UNBOUNDED PRECEDING) AS stretch FROM marked
),
sums AS (SELECT user_id, stretch, sum(step) AS s, max(seconds) AS last_feedback FROM stretched GROUP BY ALL)
SELECT user_id, last_feedback, greatest(-0.15, least(0.15, round(s, 6))) AS boost FROM sums
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY stretch DESC) = 1
""",
)
def _(t):
    return B.expiring_boosts(t.views.feedback(), ["user_id"], "seconds", 86_400)


@query(
    "j7_f5_l5_adjusted_results",
    f"""
WITH {PEOPLE}, {BOOSTS}
SELECT v.id, v.overall_score, round(greatest(0, least(100, v.overall_score * (1 + coalesce(b.boost, 0)))), 6) AS adjusted_score
FROM verdicts v LEFT JOIN boosts b ON b.user_id = v.candidate_id % 200
""",
)
def _(t):
    results = t.views.verdicts().withColumn("user_id", F.col("candidate_id") % 200)
    boosts = B.preference_boosts(t.views.feedback(), ["user_id"])
    return B.with_boost(results, boosts, ["user_id"], digits=6).select("id", "overall_score", "adjusted_score")


_SHOWN = "SELECT *, row_number() OVER (ORDER BY {0} DESC, candidate_id, id) AS rank FROM adjusted QUALIFY rank <= 100"


@query(
    "l5_display_order",
    f"""
WITH {PEOPLE}, {BOOSTS},
adjusted AS (
  SELECT v.id, v.candidate_id, v.overall_score,
         round(greatest(0, least(100, v.overall_score * (1 + coalesce(b.boost, 0)))), 6) AS adjusted_score
  FROM verdicts v LEFT JOIN boosts b ON b.user_id = v.candidate_id % 200 WHERE v.job_id = '1-URGENT' AND v.tenant_id = 'BUILDING'
)
SELECT 'adjusted' AS shown, id, adjusted_score AS score FROM ({_SHOWN.format('adjusted_score')})
UNION ALL SELECT 'raw', id, overall_score FROM ({_SHOWN.format('overall_score')})
""",
)
def _(t):
    results = t.views.verdicts().where("job_id = '1-URGENT' AND tenant_id = 'BUILDING'")
    boosts = B.preference_boosts(t.views.feedback(), ["user_id"])
    listed = B.with_boost(results.withColumn("user_id", F.col("candidate_id") % 200), boosts, ["user_id"], digits=6)
    # The first page of one job's list, by either score.
    adjusted = B.display_order(listed).limit(100).select(F.lit("adjusted").alias("shown"), "id", F.col("adjusted_score").alias("score"))
    raw = B.display_order(listed, raw=True).limit(100).select(F.lit("raw").alias("shown"), "id", F.col("overall_score").alias("score"))
    return adjusted.unionByName(raw)


@query(
    "j5_u4_high_potential",
    f"""
WITH {FEEDBACK},
good AS (SELECT DISTINCT target_id FROM fb WHERE feedback = 'suitable'),
jobs AS (SELECT DISTINCT job_id FROM fb),
refused AS (SELECT DISTINCT job_id, target_id FROM fb WHERE feedback = 'not_suitable')
SELECT j.job_id, g.target_id, row_number() OVER (PARTITION BY j.job_id ORDER BY g.target_id) AS rank
FROM jobs j CROSS JOIN good g WHERE NOT EXISTS (SELECT 1 FROM refused r WHERE r.job_id = j.job_id AND r.target_id = g.target_id)
QUALIFY rank <= 5
""",
)
def _(t):
    log = t.views.feedback()
    found = B.high_potential(log, log.select("tenant_id", "job_id"))
    return found.select("job_id", "target_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "w9_l3_result_ranks",
    f"""
WITH {PEOPLE}
SELECT id, rank() OVER (PARTITION BY tenant_id, job_id ORDER BY overall_score DESC) AS rank FROM verdicts
""",
)
def _(t):
    return R.score_ranks(t.views.verdicts(), ["tenant_id", "job_id"], "overall_score").select("id", "rank")


@query(
    "w3_top_results",
    f"""
WITH {PEOPLE}
SELECT id, row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY overall_score DESC, id) AS rank FROM verdicts QUALIFY rank <= 10
""",
)
def _(t):
    order = [F.desc("overall_score"), F.asc("id")]
    return R.top_k(t.views.verdicts(), ["tenant_id", "job_id"], order, 10).select("id", "rank")


@query(
    "p3_results_of_tasks",
    f"WITH {PEOPLE} SELECT tenant_id, task_id, count(*) AS n, max(overall_score) AS best FROM verdicts GROUP BY ALL",
)
def _(t):
    return M.results_of_tasks(t.views.verdicts())


@query(
    "j8_display_names",
    """
SELECT o_orderkey, coalesce(s_name, substr(o_custkey::VARCHAR, 1, 8)) AS name
FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey
""",
)
def _(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"))
    names = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return resolve_names(rows, "key", names, "name").drop("key")


@query(
    "j1_ranked_candidates",
    """
SELECT l_orderkey, o_custkey, o_totalprice FROM
  (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL) r JOIN orders ON o_orderkey = l_orderkey
""",
)
def _(t):
    ranked = t.lineitem.select("l_orderkey").distinct()
    people = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    return R.ranked_candidates(ranked, people, ["l_orderkey"])


@query(
    "l6_experts_by_score",
    """
SELECT l_orderkey, string_agg(l_linenumber || ':' || l_quantity::INT, ',' ORDER BY l_quantity DESC, l_linenumber) AS experts
FROM lineitem GROUP BY ALL
""",
)
def _(t):
    from matchloom.functions.labels import by_score

    listed = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("agent"))).alias("d")
    )
    text = F.transform(
        by_score(F.col("d")),
        lambda d: F.concat(d["agent"].cast("string"), F.lit(":"), d["score"].cast("int").cast("string")),
    )
    return listed.select("l_orderkey", F.array_join(text, ",").alias("experts"))


# --- paging ---


@query(
    "w8_page_numbers",
    """
SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) - 1) // 200) AS page
FROM orders
""",
)
def _(t):
    pages = R.page_numbers(t.orders, ["o_orderstatus"], "o_orderdate", "o_orderkey", 200)
    return pages.select("o_orderkey", "page")


@query(
    "l1_page",
    "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 400",
)
def _(t):
    return R.page(t.orders, "o_orderdate", "o_orderkey", offset=400).select("o_orderkey")


@query(
    "l1_deep_page",
    "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET (SELECT count(*) // 2 FROM orders)",
)
def _(t):
    # So that the ranges are searched at small scale too.
    return R.page(t.orders, "o_orderdate", "o_orderkey", offset=t.orders.count() // 2, max_rows=500).select("o_orderkey")


@query(
    "l2_load_for_screening",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 300",
)
def _(t):
    return R.load_for_screening(t.orders, "o_orderdate", "o_orderkey", 300).select("o_orderkey", "o_custkey")


@query(
    "l4_interactions_of_jobs",
    """
SELECT event_id, event_id % 40 AS job_id, row_number() OVER (PARTITION BY event_id % 40 ORDER BY ts DESC, event_id DESC) AS rank
FROM events QUALIFY rank <= 100
""",
)
def _(t):
    order = [F.desc("ts"), F.desc("event_id")]
    return R.top_k(t.views.feedback(), ["tenant_id", "job_id"], order, 100).select("event_id", "job_id", "rank")


# --- cost ---

_COSTS = """
costs AS (
  SELECT l_orderkey AS trace_id, l_linestatus AS tenant_id, l_returnflag AS model_name, (l_quantity * 10)::INT AS tokens_prompt,
         floor(l_extendedprice / 100)::INT AS tokens_completion,
         round((l_quantity * 10)::INT / 1000000.0::DOUBLE * 0.27 + floor(l_extendedprice / 100)::INT / 1000000.0::DOUBLE * 1.1, 9) AS cost
  FROM lineitem
)"""


@query(
    "p4_call_cost",
    f"WITH {_COSTS} SELECT trace_id, count(*) AS n, round(sum(cost), 8) AS cost FROM costs GROUP BY ALL",
)
def _(t):
    return t.views.costs().groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 8).alias("cost")
    )


@query(
    "a1_cost_by_model",
    f"""
WITH {_COSTS}
SELECT tenant_id, model_name, count(*) AS calls, sum(tokens_prompt)::BIGINT AS prompt_tokens,
       sum(tokens_completion)::BIGINT AS completion_tokens, round(sum(cost), 8) AS total_cost FROM costs GROUP BY ALL
""",
)
def _(t):
    found = M.cost_by_model(t.views.costs(), ["tenant_id", "model_name"])
    return found.withColumn("total_cost", F.round("total_cost", 8))


@query(
    "a2_a3_cost_totals",
    f"""
WITH {_COSTS}
SELECT round(coalesce(sum(cost), 0), 8) AS total_cost, coalesce(sum(tokens_prompt + tokens_completion), 0)::BIGINT AS total_tokens FROM costs
""",
)
def _(t):
    totals = M.cost_totals(t.views.costs())
    return totals.withColumn("total_cost", F.round("total_cost", 8))


@query(
    "a16_running_cost",
    f"""
WITH {_COSTS}
SELECT trace_id, sum(tokens_prompt + tokens_completion)::BIGINT AS tokens, round(sum(cost), 8) AS usd FROM costs GROUP BY ALL
""",
)
def _(t):
    return M.running_cost(t.views.costs()).withColumn("usd", F.round("usd", 8))


# --- stored counts ---


@query(
    "a4_stored_counts",
    """
SELECT 'match_results' AS what, count(*) AS n FROM orders UNION ALL SELECT 'candidates', count(*) FROM documents
""",
)
def _(t):
    return M.stored_counts({"match_results": t.orders, "candidates": t.documents})


@query(
    "a5_tasks_by_status",
    """
WITH tasks AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'running' END AS status FROM orders)
SELECT s.status, count(t.status) AS n FROM (VALUES ('pending'), ('running'), ('succeeded'), ('failed')) s(status)
LEFT JOIN tasks t USING (status) GROUP BY ALL
""",
)
def _(t):
    code = F.col("o_orderstatus")
    status = F.when(code == "F", "failed").when(code == "O", "succeeded").otherwise("running")
    return M.tasks_by_status(t.orders.select(status.alias("status")))


@query("a6_candidates_by_tenant", "SELECT source AS tenant_id, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    return M.rows_by_tenant(t.documents, "source")


# --- counters and histograms ---

_LABELS = """'{group="' || (user_id % 3) || '",type="' || event_type || '"}'"""


def _edges(values):
    return "[" + ", ".join(str(e) for e in values) + "]"


def _histogram_sql(edges):
    return f"""
edges AS (SELECT unnest({_edges(edges)})::DOUBLE AS le UNION ALL SELECT NULL),
obs AS (SELECT 'call_seconds' AS name, {_LABELS} AS labels, value FROM events),
keys AS (SELECT name, labels, sum(value) AS sum, count(*) AS count FROM obs GROUP BY ALL),
hist AS (
  SELECT k.name, k.labels, e.le, count(CASE WHEN e.le IS NULL OR o.value <= e.le THEN 1 END) AS cumulative,
         any_value(k.sum) AS sum, any_value(k.count) AS count
  FROM keys k CROSS JOIN edges e JOIN obs o ON o.name = k.name AND o.labels = k.labels GROUP BY k.name, k.labels, e.le
)"""


@query(
    "a7_f7_counters",
    f"SELECT 'calls' AS name, {_LABELS} AS labels, count(*)::DOUBLE AS value FROM events GROUP BY ALL",
)
def _(t):
    rows = t.views.observations().withColumns({"name": F.lit("calls"), "value": F.lit(1.0)})
    return M.counters(rows)


@query(
    "a8_bucket_counts",
    f"""
WITH obs AS (SELECT 'call_seconds' AS name, {_LABELS} AS labels,
  list_filter({_edges(fixed.STAGE_EDGES)}::DOUBLE[], lambda e: value <= e)[1] AS le FROM events)
SELECT name, labels, le, count(*) AS n FROM obs GROUP BY ALL
""",
)
def _(t):
    return M.bucket_counts(t.views.observations(), fixed.STAGE_EDGES)


@query(
    "a9_histograms",
    f"WITH {_histogram_sql(fixed.SERVICE_EDGES)} SELECT name, labels, le, cumulative, round(sum, 6) AS sum, count FROM hist",
)
def _(t):
    rows = M.histograms(t.views.observations(), fixed.SERVICE_EDGES)
    return rows.withColumn("sum", F.round("sum", 6))


@query(
    "w6_cumulated_buckets",
    f"WITH {_histogram_sql(fixed.STAGE_EDGES)} SELECT name, labels, le, cumulative FROM hist",
)
def _(t):
    return M.cumulate(M.bucket_counts(t.views.observations(), fixed.STAGE_EDGES), fixed.STAGE_EDGES)


@query(
    "v6_histogram_violations",
    f"WITH {_histogram_sql(fixed.STAGE_EDGES)} SELECT name, labels, 'none' AS violation FROM hist WHERE cumulative > count",
)
def _(t):
    rows = M.histograms(t.views.observations(), fixed.STAGE_EDGES)
    return Q.histogram_violations(rows, ["name", "labels"])


@query(
    "v6_broken_histograms",
    f"""
WITH {_histogram_sql(fixed.STAGE_EDGES)},
broken AS (
  SELECT name, labels, le, count,
         cumulative + CASE WHEN le = {fixed.STAGE_EDGES[0]} AND contains(labels, 'group="1"') THEN count + 1
                           WHEN le IS NULL AND contains(labels, 'group="2"') THEN 1 ELSE 0 END AS cumulative FROM hist
),
stepped AS (
  SELECT *, lag(cumulative) OVER (PARTITION BY name, labels ORDER BY coalesce(le, 'inf'::DOUBLE)) > cumulative AS falls FROM broken
)
SELECT DISTINCT name, labels, 'not_monotone' AS violation FROM stepped WHERE falls
UNION ALL SELECT name, labels, 'inf_not_count' FROM stepped WHERE le IS NULL AND cumulative <> count
""",
)
def _(t):
    rows = M.histograms(t.views.observations(), fixed.STAGE_EDGES)
    first = (F.col("le") == fixed.STAGE_EDGES[0]) & F.col("labels").contains('group="1"')
    last = F.col("le").isNull() & F.col("labels").contains('group="2"')
    wrong = F.when(first, F.col("count") + 1).when(last, F.lit(1)).otherwise(F.lit(0))
    return Q.histogram_violations(rows.withColumn("cumulative", F.col("cumulative") + wrong), ["name", "labels"])


@query(
    "s15_gauge_export",
    f"""
SELECT 'call_seconds' || labels || ' ' ||
       CASE WHEN value = floor(value) THEN printf('%.0f', value) ELSE regexp_replace(printf('%.6f', value), '0+$', '') END AS line
FROM (SELECT {_LABELS} AS labels, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY ts DESC, value DESC) = 1)
""",
)
def _(t):
    return M.export_gauges(M.gauges(t.views.observations()))


@query(
    "a10_gauges",
    f"""
SELECT 'call_seconds' AS name, {_LABELS} AS labels, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY ts DESC, value DESC) = 1
""",
)
def _(t):
    return M.gauges(t.views.observations())


@query(
    "a11_snapshot",
    f"""
SELECT 'call_seconds' AS name, {_LABELS} AS labels, count(*) AS count, round(sum(value), 6) AS sum, round(avg(value), 9) AS avg
FROM events GROUP BY ALL
""",
)
def _(t):
    rows = M.snapshot(t.views.observations(), digits=9)
    return rows.withColumn("sum", F.round("sum", 6))


_ROUTES = """
req AS (
  SELECT CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method,
         CASE WHEN event_id % 17 = 0 THEN 'unmatched' ELSE '/' || event_type || '/:id' END AS route,
         CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, value FROM events
)"""


def requests(t):
    item = F.col("event_id")
    method = F.when(item % 3 == 0, "GET").when(item % 3 == 1, "POST").otherwise("PUT")
    path = F.when(
        item % 17 != 0, F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"))
    )
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    return t.events.select(
        method.alias("method"), M.route_label(path).alias("route"), status.alias("status"), "value", "ts"
    )


@query(
    "a12_p7_request_counts",
    f"WITH {_ROUTES} SELECT method, route, status, count(*) AS n FROM req GROUP BY ALL",
)
def _(t):
    return requests(t).groupBy("method", "route", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a12_request_latency",
    f"""
WITH {_ROUTES},
edges AS (SELECT unnest({_edges(fixed.SERVICE_EDGES)})::DOUBLE AS le UNION ALL SELECT NULL)
SELECT '{{method="' || method || '",route="' || route || '"}}' AS labels, le,
       count(CASE WHEN le IS NULL OR value <= le THEN 1 END) AS cumulative FROM req CROSS JOIN edges GROUP BY ALL
""",
)
def _(t):
    rows = requests(t).select(
        *M.observation("http_request_seconds", F.col("value"), F.col("ts"), method=F.col("method"), route=F.col("route"))
    )
    return M.histograms(rows, fixed.SERVICE_EDGES).select("labels", "le", "cumulative")


@query(
    "a13_model_calls",
    """
SELECT l_returnflag AS model, l_linestatus AS kind, CASE WHEN l_linenumber = 5 THEN 'error' ELSE 'ok' END AS status,
       count(*) AS calls, sum(l_quantity::BIGINT)::BIGINT AS tokens, sum(l_partkey)::BIGINT AS cost,
       sum(l_suppkey)::BIGINT AS seconds FROM lineitem GROUP BY ALL
""",
)
def _(t):
    return M.model_calls(
        t.lineitem.select(
            F.col("l_returnflag").alias("model"),
            F.col("l_linestatus").alias("kind"),
            F.when(F.col("l_linenumber") == 5, "error").otherwise("ok").alias("status"),
            F.col("l_quantity").cast("bigint").alias("tokens"),
            F.col("l_partkey").alias("cost"),  # in whole units, so that sums are exact
            F.col("l_suppkey").alias("seconds"),
        )
    )


@query(
    "a14_screening_totals",
    """
SELECT o_orderstatus = 'O' AS completed, coalesce(l.n, 0) > 3 AS cached, count(*) AS tasks,
       sum(coalesce(l.n, 0))::BIGINT AS candidates
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey GROUP BY ALL
""",
)
def _(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("candidates"))
    tasks = t.orders.join(n, "o_orderkey", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    status = F.when(F.col("o_orderstatus") == "O", "succeeded").otherwise("running")
    return M.screening_totals(
        tasks.select(status.alias("status"), (F.col("candidates") > 3).alias("cached"), "candidates")
    )


@query(
    "a14_discussion_rounds",
    """
WITH edges AS (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1, 2, 3, 5, 8, 13, 21, 34, 60])::DOUBLE AS le UNION ALL SELECT NULL)
SELECT le, count(CASE WHEN le IS NULL OR (turn // 2 + 1) <= le THEN 1 END) AS cumulative FROM conversations CROSS JOIN edges GROUP BY ALL
""",
)
def _(t):
    rows = t.views.turns().select(
        *M.observation("screen_discussion_rounds", F.col("round"), F.lit(None).cast("timestamp"))
    )
    return M.histograms(rows, fixed.STAGE_EDGES).select("le", "cumulative")


@query(
    "a17_stage_timings",
    "SELECT event_type AS stage, count(*) AS n, round(avg(value), 9) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL",
)
def _(t):
    timed = t.events.select(F.col("event_type").alias("stage"), "value")
    found = M.stage_timings(timed, ["stage"], accuracy=1_000_000)
    return found.withColumn("mean", F.round("mean", 9))


@query(
    "a18_task_metrics",
    """
SELECT o_orderstatus AS status, count(*) AS tasks, sum(o_custkey)::BIGINT AS seconds, sum(l.n)::BIGINT AS fine_candidates,
       sum(l.hits)::BIGINT AS cache_hits, sum(l.n - l.hits)::BIGINT AS cache_misses, sum(o_orderkey % 3)::BIGINT AS retries
FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem GROUP BY ALL) l
  ON l_orderkey = o_orderkey GROUP BY ALL
""",
)
def _(t):
    fine = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("fine_candidates"), F.count_if(F.col("l_returnflag") == "R").alias("cache_hits")
    )
    return M.task_metrics(
        t.orders.join(fine, "o_orderkey").select(
            F.col("o_orderstatus").alias("status"),
            F.col("o_custkey").alias("seconds"),
            "fine_candidates",
            "cache_hits",
            (F.col("o_orderkey") % 3).alias("retries"),
        )
    )


@query(
    "s15_f14_text_export",
    f"""
WITH {_histogram_sql(fixed.STAGE_EDGES)},
shown AS (
  SELECT *, CASE WHEN le IS NULL THEN '+Inf' ELSE regexp_replace(printf('%.3f', le), '\\.?0+$', '') END AS edge FROM hist
)
SELECT 'calls_total' || labels || ' ' || count(*) AS line FROM obs GROUP BY labels
UNION ALL SELECT name || '_bucket' || regexp_replace(labels, '}}$', ',le="' || edge || '"}}') || ' ' || cumulative FROM shown
UNION ALL SELECT name || '_sum' || labels || ' ' || regexp_replace(printf('%.6f', sum), '...$', '') FROM shown WHERE le IS NULL
UNION ALL SELECT name || '_count' || labels || ' ' || count FROM shown WHERE le IS NULL
""",
)
def _(t):
    rows = t.views.observations()
    counted = M.counters(rows.withColumns({"name": F.lit("calls"), "value": F.lit(1.0)}))
    lines = M.export_counters(counted).unionByName(M.export_histograms(M.histograms(rows, fixed.STAGE_EDGES)))
    # Sums of floats depend on their order in the last digits: three decimals of them are compared.
    short = F.regexp_replace("line", r"(_sum.* [0-9]+\.[0-9]{3})[0-9]{3}$", "$1")
    return lines.select(short.alias("line"))


@query(
    "f14_counter_names",
    "SELECT DISTINCT p_type || CASE WHEN p_size % 2 = 0 THEN '_total' ELSE '' END AS name, p_type || '_total' AS counter FROM part",
)
def _(t):
    name = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "_total").otherwise(""))
    return t.part.select(name.alias("name"), counter_name(name).alias("counter")).distinct()


# --- rates ---


@query(
    "w7_requests_in_window",
    """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS in_window
FROM events
""",
)
def _(t):
    requests_ = t.events.select("event_id", "user_id", F.floor(micros(F.col("ts")) / 1000).alias("ms"))
    day = 86_400_000
    return M.requests_in_window(requests_, ["user_id"], "ms", "event_id", day, bucket_spans=2).select(
        "event_id", "in_window"
    )

