"""What tasks hold and shuffles carry as tables grow; results beside the plain way."""

from pyspark.sql import functions as F

from matchloom.operators import panel, skills, sparse
from matchloom.operators.dense import dense_search
from matchloom.operators.hard_filter import candidate_terms, hard_filter_pool
from matchloom.operators.panel import merged_evidence
from matchloom.operators.sizes import only_owners_of
from workload import entities, load
from workload.registry import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_carry_no_chunk_text(spark):
    queries = spark.createDataFrame([("t", 1, [1.0, 0.0])], "tenant_id string, job_id long, vector array<float>")
    chunks = spark.createDataFrame(
        [("t", 1, 0, [1.0, 0.0], "body")],
        "tenant_id string, candidate_id long, chunk_index int, embedding array<float>, long_text string",
    ).repartition(2)
    found = dense_search(queries, chunks, 1, max_broadcast_bytes=0, block_bytes=8)
    assert "CoGroup" in plan(found) and "long_text" not in plan(found).partition("Repartition")[0]
    assert [r["candidate_id"] for r in found.collect()] == [1]


def test_key_of_a_skill_is_computed_once(spark):
    df = spark.createDataFrame([(" My SQL",), ("javascript",), ("",)], "s string")
    tagged = df.select(skills.rule_tag(F.col("s"), substring=True).alias("tag"))
    assert plan(tagged).count("lower(") == 1
    assert [r["tag"] for r in tagged.collect()] == ["SQL", "Java", "Python"]


def test_tags_meet_skills_without_a_shuffle_by_skill(spark):
    profiles = spark.createDataFrame([(1, ["x", "y", "py"])], "id int, skills array<string>")
    nearest = spark.createDataFrame([("x", "Go", 0.9), ("y", None, 0.1)], "skill string, tag string, similarity double")
    mapped = skills.match_skills(profiles, ["id"], nearest)
    assert "strategy=broadcast" in plan(mapped)
    assert mapped.first()["skills"] == ["Go", "y", "Python"]


def test_each_run_of_a_candidate_is_looked_up_once(spark):
    facts = spark.createDataFrame(
        [("t", 1, 2, 3, ["go", "c++", None], "go go rust/go"), ("t", 2, 2, 3, None, None)],
        "tenant_id string, candidate_id long, degree int, years int, skills array<string>, text string",
    )
    vocabulary = spark.createDataFrame([("t", w) for w in ("go", "c++", "rust", "sql")], "tenant_id string, term string")
    terms = candidate_terms(facts, vocabulary)
    assert plan(terms).count("regexp_extract_all") == 1 and "explode(array_distinct(regexp_extract_all" in plan(terms)
    assert sorted((r["candidate_id"], r["term"]) for r in terms.collect()) == [(1, "c++"), (1, "go"), (1, "rust")]


def test_scoring_tasks_follow_the_pairs(spark, monkeypatch):
    docs = spark.createDataFrame([("t" if i % 3 else "u", i) for i in range(300)], "tenant_id string, candidate_id long")
    queries = spark.createDataFrame([("t", j) for j in range(5)] + [("v", 9)], "tenant_id string, job_id long")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sparse.scoring_tasks(docs, queries) == least
    monkeypatch.setattr(sparse, "_TASK_PAIRS", 10)
    assert sparse.scoring_tasks(docs, queries) == 100  # 200 documents of t and its 5 jobs
    assert sparse.scoring_tasks(docs, queries.where("false")) == least


def test_pool_words_keep_every_row_of_the_pool(spark):
    rules = [f"r{i:03}" for i in range(130)]  # more than two words of bits
    terms = spark.createDataFrame(
        [("t", i, r, "go" if i % 2 else "sql", 1) for i, r in enumerate(rules)],
        "tenant_id string, job_id long, rule_id string, token string, qtf long",
    )
    members = [("t", r, c) for i, r in enumerate(rules) for c in range(4) if (i + c) % 3] + [("t", "r001", 1), ("t", "r128", 0)] * 2
    pool = spark.createDataFrame(members, "tenant_id string, rule_id string, candidate_id long")
    index = spark.createDataFrame(
        [("t", c, w, 5, 1) for c in range(5) for w in ("", "go", "sql")],
        "tenant_id string, candidate_id long, token string, dl int, tf long",
    )
    got = sparse._scoped_index(terms, index, sparse.pool_words(terms, pool))
    asked = {(r, "go" if i % 2 else "sql") for i, r in enumerate(rules)}
    wanted = [(r, c, w) for _, r, c in members for w in ("", "go", "sql") if w == "" or (r, w) in asked]
    assert sorted((r["rule_id"], r["candidate_id"], r["token"]) for r in got.collect()) == sorted(wanted)


def test_panel_rows_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch, tmp_path):
    lines = [(o, o % 30, 1, n, float(n), 0.1 * (n % 3), 0.01, "R", "F") for o in range(200) for n in range(1, 4)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double"
    lineitem = spark.createDataFrame(lines, names + ", l_tax double, l_returnflag string, l_linestatus string")
    orders = spark.createDataFrame(
        [(o, "O", f"{o % 5 + 1}-X") for o in range(200)], "o_orderkey long, o_orderstatus string, o_orderpriority string"
    )
    for name, table in (("lineitem", lineitem), ("orders", orders)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")

    def found():
        return merged_evidence(entities.Entities(Tables(spark, str(tmp_path))).panel())

    few = found()
    monkeypatch.setattr(entities, "LINES_PER_TASK", 20)
    many = found()
    assert "l_orderkey" not in plan(few).partition("RepartitionByExpression")[2].partition("\n")[0]
    assert "RepartitionByExpression [l_orderkey" in plan(many) and ", 30" in plan(many)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 200 * 2


def test_index_counts_tokens_text_by_text(spark):
    terms = spark.createDataFrame(
        [("t", 1, w, 1) for w in ("go", "c++", "\u5e74")] + [("u", 2, "sql", 1)],
        "tenant_id string, job_id long, token string, qtf long",
    )
    rows = [("t", 1, "Go go C++ \u5e74\u5e74 sql"), ("t", 2, None), ("u", 1, "go SQL"), (None, 3, "go"), ("t", None, "go")]
    schema = "tenant_id string, candidate_id long, text string"
    wanted = [
        ("t", 1, "", 6, 1), ("t", 1, "c++", 6, 1), ("t", 1, "go", 6, 2), ("t", 1, "\u5e74", 6, 2), ("t", 2, "", 0, 1),
        ("t", None, "", 1, 1), ("t", None, "go", 1, 1), ("u", 1, "", 2, 1), ("u", 1, "sql", 2, 1),
    ]

    def found(index):
        return sorted(map(str, (tuple(r[c] for c in ("tenant_id", "candidate_id", "token", "dl", "tf")) for r in index.collect())))

    index = sparse.build_index(spark.createDataFrame(rows, schema), terms, parts=2)
    # No table of all the tokens of a split: nothing is aggregated before the documents are dealt out.
    assert "sum(tf" not in plan(index) and "count(1)" not in plan(index)
    assert found(index) == sorted(map(str, wanted))
    twice = sparse.build_index(spark.createDataFrame(rows + [("t", 1, "go x x x x x"), ("t", 1, "go")], schema), terms, parts=2)
    assert "sum(tf" in plan(twice).partition("Repartition")[0]
    more = [r for r in wanted if r[:3] not in (("t", 1, ""), ("t", 1, "go"))]
    more += [("t", 1, "", 6, 2), ("t", 1, "go", 6, 3), ("t", 1, "", 1, 1), ("t", 1, "go", 1, 1)]
    assert found(twice) == sorted(map(str, more))


def test_terms_meet_rules_without_a_shuffle_of_their_own(spark):
    facts = spark.createDataFrame(
        [("t", 1, 2, 3, ["go", "c++"], "go rust/go"), ("t", 2, 2, 3, ["sql"], None), ("t", 1, 2, 3, ["go"], "go")],
        "tenant_id string, candidate_id long, degree int, years int, skills array<string>, text string",
    )
    rules = spark.createDataFrame(
        [("t", "a", 0, 0, ["go", "rust"]), ("t", "b", 0, 4, ["go"]), ("t", "c", 2, 3, ["sql", "go"])],
        "tenant_id string, rule_id string, need_degree int, need_years int, need_skills array<string>",
    )
    pool = hard_filter_pool(rules, facts)
    assert "first(degree" not in plan(pool)
    assert sorted((r["rule_id"], r["candidate_id"]) for r in pool.collect()) == [("a", 1), ("c", 1), ("c", 2)]


def test_only_texts_of_wanted_owners_are_cut(spark):
    texts = spark.createDataFrame([("t", i, f"a{i} b{i}") for i in range(5)] + [("u", 1, "x")], "tenant_id string, id long, text string")
    pieces = texts.select("tenant_id", "id", F.posexplode(F.split("text", " ")).alias("pos", "piece"))
    small = spark.createDataFrame([("t", 1), ("t", 3), ("t", 3), (None, 1), ("u", None)], "tenant_id string, id long")
    kept = only_owners_of(pieces, small, ["tenant_id", "id"])
    assert plan(kept).index("Generate") < plan(kept).index("LeftSemi")
    assert sorted(r["piece"] for r in kept.collect()) == ["a1", "a3", "b1", "b3"]
    assert only_owners_of(pieces, small, ["id"]).count() == 5
    assert only_owners_of(pieces, pieces.where("piece = 'a2'"), ["tenant_id", "id"]).count() == 2


def test_parts_of_reports_are_dealt_to_bounded_tasks(spark, monkeypatch):
    rows = [
        ("t", "j", c, a, float(c), 0.5, {"d": 1.0}, [f"e{c}"], p)
        for c in range(40) for p, a in enumerate(("leadership", "interviewer"))
    ]
    table = spark.createDataFrame(
        rows,
        "tenant_id string, job_id string, candidate_id long, agent string, score double, confidence double, "
        "dimension_scores map<string,double>, evidence array<string>, pos long",
    )
    weights = spark.createDataFrame([("t", "j", {"leadership": 1.0})], "tenant_id string, job_id string, weights map<string,double>")
    few = panel.reports(table, weights)
    monkeypatch.setattr(panel, "ROWS_PER_TASK", 8)
    many = panel.reports(table, weights)
    assert "strategy=broadcast" in plan(panel.arbitrate(table, weights))
    assert "Repartition" not in plan(few) and plan(many).count("RepartitionByExpression") == 4
    key = lambda r: r["candidate_id"]
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key)


def test_rerank_documents_move_only_texts_of_listed_candidates(spark, tmp_path):
    docs = [(i, "en", f"word{i} common {'long ' * 200}") for i in range(60)] + [(3, "en", "word3 again"), (None, "en", "word5"), (70, None, "word7")]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, lang string, text string"),
        "benchmark": spark.createDataFrame([(0, "word3 word5"), (1, "word9 word7")], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    found = load()[0]["r18_rerank_document"](spark, str(tmp_path))
    # The texts meet the few listed candidates first, without a shuffle, and then the pairs.
    texts = plan(found).rpartition(" AS candidate_id")[2]
    assert "Join LeftSemi" in texts and "strategy=broadcast" in texts
    got = sorted((r["job_id"], r["candidate_id"]) for r in found.collect())
    assert {c for j, c in got if j == 0} >= {3, 5} and got.count((0, 3)) == 2
