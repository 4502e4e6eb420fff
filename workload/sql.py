"""SQL building blocks for DuckDB: the same mapping as `workload.entities`."""

TOKEN = r"[A-Za-z0-9_+#./-]+|[\x{4e00}-\x{9fff}]"


def tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{TOKEN}'), lambda x: lower(x))"


def ordered_distinct(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


CANDIDATES = f"""
docs AS MATERIALIZED (
  SELECT lang AS tenant_id, doc_id AS candidate_id, text, {tokens('text')} AS toks FROM documents
)"""

JOBS = f"""
jobs0 AS (
  SELECT ['en','en','en','en','de','fr','es'][(item_id % 7) + 1] AS tenant_id, item_id AS job_id,
         text AS query, 'job ' || item_id AS title, {tokens('text')} AS toks FROM benchmark
),
jobs1 AS (
  SELECT *, list_filter(toks, lambda x, i: list_position(toks, x) = i) AS dist FROM jobs0
),
jobs AS MATERIALIZED (
  SELECT tenant_id, job_id, query, title, toks, dist AS skill_graph,
         ['', '本科及以上学历', '硕士及以上学历'][(job_id % 3) + 1] AS degree_req,
         [0, 2, 3][(job_id % 3) + 1] AS need_degree, (job_id % 6)::INT AS need_years,
         CASE WHEN job_id % 4 = 0 THEN []::VARCHAR[] ELSE dist END AS skill_reqs
  FROM jobs1
)"""

# BM25+ with the tenant as the corpus: qt, tf, stats, dfreq -> bm (tenant_id, job_id, candidate_id, score)
BM25 = """
qt AS (
  SELECT tenant_id, job_id, token, count(*) AS qtf
  FROM (SELECT tenant_id, job_id, unnest(toks) AS token FROM jobs) GROUP BY ALL
),
tf AS (
  SELECT tenant_id, candidate_id, token, dl, count(*) AS tf
  FROM (SELECT tenant_id, candidate_id, len(toks) AS dl, unnest(toks) AS token FROM docs) GROUP BY ALL
),
stats AS (SELECT tenant_id, count(*) AS n, avg(len(toks)) AS avgdl FROM docs GROUP BY ALL),
dfreq AS (SELECT tenant_id, token, count(*) AS df FROM tf GROUP BY ALL),
bm AS (
  SELECT qt.tenant_id, qt.job_id, tf.candidate_id,
         sum(qt.qtf * ln((s.n + 1) / d.df) *
             (1 + tf.tf * 2.5 / (1.5 * (1 - 0.75 + 0.75 * tf.dl / s.avgdl) + tf.tf))) AS score
  FROM qt JOIN tf USING (tenant_id, token) JOIN dfreq d USING (tenant_id, token) JOIN stats s USING (tenant_id)
  GROUP BY ALL
)"""


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


CHUNK_TEXTS = f"""
ch0 AS (SELECT tenant_id, candidate_id, {strip('text')} AS body FROM docs),
ch1 AS (
  SELECT tenant_id, candidate_id,
         list_filter(list_transform(
           range(CASE WHEN length(body) <= 500 THEN 1 ELSE ceil((length(body) - 500) / 450.0)::BIGINT + 1 END),
           lambda i: {strip('substr(body, i * 450 + 1, 500)')}), lambda p: p <> '') AS pieces
  FROM ch0
),
chunk_texts AS (
  SELECT tenant_id, candidate_id, unnest(range(len(pieces)))::INT AS chunk_index, unnest(pieces) AS chunk FROM ch1
)"""

DENSE = """
chunks AS (
  SELECT c.*, e.embedding::DOUBLE[] AS v FROM chunk_texts c
  JOIN embeddings e ON e.vec_id = (candidate_id + 97 * chunk_index) % (SELECT count(*) FROM embeddings)
),
jv AS (SELECT tenant_id, job_id, embedding::DOUBLE[] AS qv FROM jobs JOIN embeddings ON vec_id = job_id),
sim AS MATERIALIZED (
  SELECT tenant_id, job_id, candidate_id, chunk_index, chunk,
         round(list_dot_product(qv, v) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))), 6) AS score
  FROM jv JOIN chunks USING (tenant_id)
),
dense AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY score DESC, candidate_id, chunk_index) AS rank
  FROM sim QUALIFY rank <= 30
)"""

SPARSE = """
sparse AS MATERIALIZED (
  SELECT tenant_id, job_id, candidate_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY round(score, 6) DESC, candidate_id) AS rank
  FROM bm WHERE round(score, 6) > 0 QUALIFY rank <= 30
)"""

FUSED = """
fused AS MATERIALIZED (
  SELECT tenant_id, job_id, candidate_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf_score
  FROM (SELECT tenant_id, job_id, candidate_id, rank FROM dense
        UNION ALL SELECT tenant_id, job_id, candidate_id, rank FROM sparse)
  GROUP BY ALL
)"""

SPANS = """
spans AS (
  SELECT o_custkey AS candidate_id, year(o_orderdate)::INT AS s,
         (year(o_orderdate) + o_orderkey % 4)::INT AS e FROM orders
),
merged AS (
  SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT candidate_id, s, max(e) AS e FROM spans GROUP BY ALL)
),
islands AS (
  SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END)
              OVER (PARTITION BY candidate_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island
  FROM merged
),
years AS (
  SELECT candidate_id, sum(e - s)::INT AS years
  FROM (SELECT candidate_id, island, min(s) AS s, max(e) AS e FROM islands GROUP BY ALL) GROUP BY ALL
)"""

FACTS = """
facts AS (
  SELECT tenant_id, candidate_id, [1, 2, 3, 4][(candidate_id % 4) + 1] AS degree,
         coalesce(years, 0) AS years, lower(text) AS low,
         list_filter(toks, lambda x, i: list_position(toks, x) = i) AS skills
  FROM docs LEFT JOIN years USING (candidate_id)
)"""

NEEDS = """
needs AS (
  SELECT *, list_distinct(list_filter(
              flatten(list_transform(skill_reqs, lambda r: regexp_extract_all(r, '[A-Za-z][A-Za-z0-9+#./]{1,30}'))),
              lambda s: list_contains(skill_graph, lower(s)))) AS need_skills
  FROM jobs
)"""


def hit(tag: str, skills: str, text: str) -> str:
    pattern = f"'(^|[^a-z0-9+#.])' || regexp_escape({tag}) || '($|[^a-z0-9+#])'"
    return (
        f"(list_contains({skills}, {tag}) OR regexp_matches({text}, {pattern}) "
        f"OR regexp_matches(array_to_string({skills}, ' '), {pattern}))"
    )


# The skills are tokens of the text: what a text does not contain, they do not either.
POOL = f"""
pool_tags AS (SELECT DISTINCT tenant_id, unnest(need_skills) AS tag FROM needs),
pool_hits AS MATERIALIZED (
  SELECT tenant_id, tag, candidate_id FROM pool_tags JOIN facts f USING (tenant_id)
  WHERE contains(f.low, tag) AND {hit('tag', 'f.skills', 'f.low')}
),
pool_skilled AS (
  SELECT DISTINCT job_id, candidate_id
  FROM (SELECT tenant_id, job_id, unnest(need_skills) AS tag FROM needs) JOIN pool_hits USING (tenant_id, tag)
),
pool AS (
  SELECT n.tenant_id, n.job_id, f.candidate_id
  FROM needs n JOIN facts f USING (tenant_id) LEFT JOIN pool_skilled s ON s.job_id = n.job_id AND s.candidate_id = f.candidate_id
  WHERE f.degree >= n.need_degree AND f.years >= n.need_years AND (len(n.need_skills) = 0 OR s.job_id IS NOT NULL)
)"""


PANEL = """
panel0 AS (
  SELECT o_orderstatus AS tenant_id, o_orderpriority AS job_id, l_orderkey AS candidate_id,
         ['interviewer','skill_evaluator','culture_fit','stability_analyzer','leadership','visual_evaluator','devils_advocate'][l_linenumber] AS agent,
         l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_quantity * 2 AS score, 1.0::DOUBLE - l_discount AS confidence,
         l_quantity * 2 AS depth, l_tax * 1000 AS fit,
         ['part ' || (l_partkey % 20), l_returnflag || l_linestatus] AS evidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
panel AS (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos
  FROM panel0
),
weights AS (
  SELECT * FROM (VALUES
    ('1', 'interviewer', 0.35), ('1', 'skill_evaluator', 0.35), ('1', 'culture_fit', 0.15), ('1', 'stability_analyzer', 0.15),
    ('2', 'interviewer', 0.35), ('2', 'leadership', 0.35), ('2', 'culture_fit', 0.15), ('2', 'stability_analyzer', 0.15),
    ('3', 'interviewer', 0.30), ('3', 'skill_evaluator', 0.25), ('3', 'visual_evaluator', 0.15), ('3', 'culture_fit', 0.15), ('3', 'stability_analyzer', 0.15),
    ('4', 'interviewer', 0.50), ('4', 'culture_fit', 0.30), ('4', 'stability_analyzer', 0.20),
    ('5', 'interviewer', 0.50), ('5', 'culture_fit', 0.30), ('5', 'stability_analyzer', 0.20)) w(prio, agent, weight)
),
weighted AS (
  SELECT p.*, w.weight::DOUBLE AS weight FROM panel p JOIN weights w ON w.prio = p.job_id[1] AND w.agent = p.agent
)"""

TURNS = """
turns AS (
  SELECT (conv_id % 10) AS job_id, conv_id AS candidate_id, (turn // 2 + 1)::INT AS round, 'seat' || (turn % 2) AS agent,
         (length(text) % 101)::DOUBLE AS score, text FROM conversations
),
deltas AS (
  SELECT *, round(score - lag(score) OVER (PARTITION BY candidate_id, agent ORDER BY round), 2) AS score_delta FROM turns
),
rounds AS (
  SELECT job_id, candidate_id, round, avg(score) AS mean, stddev_pop(score) AS std, max(abs(score_delta)) AS max_delta
  FROM deltas GROUP BY ALL
),
judged AS (
  SELECT *, (std <= 12 OR (round > 1 AND coalesce(max_delta <= 3, false))) AS converged FROM rounds WHERE round <= 2
),
ending AS (
  SELECT job_id, candidate_id, coalesce(min(CASE WHEN converged THEN round END), max(round)) AS rounds,
         CASE WHEN bool_or(converged) THEN 'converged' ELSE 'max_rounds' END AS convergence FROM judged GROUP BY ALL
)"""
