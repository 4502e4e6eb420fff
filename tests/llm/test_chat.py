import re

from pyspark.sql import functions as F

from matchloom.llm import chat

SCHEMA = "conv_id long, id long, parent_id long, role string, text string, score double"


def escaped(text):
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def brute(rows):
    """{(conv, leaf): (rank, [(role, text), ...])} of root-to-leaf paths."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == conv}
        parents = {r[2] for r in own.values()}
        paths = []
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own and len(path) <= len(own):
                path.append(own[at])
                at = own[at][2]
            if len(path) <= len(own):
                score = sum(p[5] or 0.0 for p in path) / len(path)
                paths.append((-score, -len(path), leaf, [(p[3] or "", p[4] or "") for p in path[::-1]]))
        for rank, (_, _, leaf, path) in enumerate(sorted(paths), 1):
            out[conv, leaf] = (rank, path)
    return out


TREES = [
    (1, 1, None, "system", "be <|im_end|> good", 0.5),
    (1, 2, 1, "user", "a <\\| b <| c <\\\\|", 0.1),
    (1, 3, 2, "assistant", None, 0.9),
    (1, 4, 2, "assistant", "no\nline <|im_start|>user", 0.2),
    (1, 5, 4, "user\n<|x", "tail\\", None),
    (1, 6, 99, "user", "orphan", 1.0),
    (2, 1, 2, "user", "circle", 1.0),
    (2, 2, 1, "user", "circle", 1.0),
    (3, 1, None, None, "", 0.0),
    (None, 1, None, "user", "null conversation", 0.0),
    (None, 2, 1, "assistant", "yes", 0.0),
    *[(4, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"turn {i}", 0.0) for i in range(70)],
    *[(5, i, (i - 1) // 2 if i else None, "user", str(i), float((i * 37) % 11)) for i in range(31)],
]


def test_paths_ranks_and_round_trip(spark):
    df = spark.createDataFrame([*TREES, TREES[0], TREES[0]], SCHEMA)
    rows = chat.conversations(df).select(
        "*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")
    )
    got = {(r["conv_id"], r["leaf"]): r for r in rows.collect()}
    want = brute(TREES)
    assert set(got) == set(want) and not any(conv == 2 for conv, _ in got)
    for key, (rank, path) in want.items():
        row = got[key]
        assert row["rank"] == rank
        assert [(t["role"], t["text"]) for t in row["turns"]] == path
        assert row["loss"] == "".join(text for role, text in path if role == "assistant")
        assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
        bodies = [s["text"] for s in row["segments"][1::3]]
        assert bodies == [escaped(text) for _, text in path]
        assert row["formatted"].count("<|im_start|>") == row["formatted"].count("<|im_end|>") == len(path)


def test_best_paths_only(spark):
    df = spark.createDataFrame(TREES, SCHEMA)
    got = {(r["conv_id"], r["leaf"]) for r in chat.conversations(df, best=1).collect()}
    assert got == {key for key, (rank, _) in brute(TREES).items() if rank == 1}
    assert chat.conversations(df.limit(0)).count() == 0


def test_chain_of_plain_turns(spark):
    rows = [(1, 5, "user", "b"), (1, 2, "user", "a"), (1, 5, "assistant", "c"), (1, 5, "user", "b"), (None, None, None, None)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, score string")
    got = {r["conv_id"]: r["turns"] for r in chat.conversations(chat.chain(turns), best=1).select(
        "conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert [tuple(t) for t in got[1]] == [("user", "a"), ("assistant", "c"), ("user", "b"), ("user", "b")]
    assert [tuple(t) for t in got[None]] == [("", "")]


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame(TREES, SCHEMA)
    plan = chat.conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
