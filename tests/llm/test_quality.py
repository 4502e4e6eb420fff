import re
from collections import Counter

from pyspark.sql import functions as F

from matchloom.llm import quality_rules as q
from tests.llm.helpers import awkward, empty


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [
    None,
    "",
    " \n\t",
    "a b c d e",
    "a b c d",
    "a b c d e a b c d e",
    "a a a a a a a",
    "x\x0by\x0cz\r\nq  w \x1c    v",
    "l1 a\nl1 a\n l1 a\n\n\nl1 a",
    "a<b> & c|d $$ 100% #x *y*",
    "a b c d e f a b c d e g h a b c d e",
    "one two three four five six seven eight nine ten " * 3,
    " ".join(str(i * i % 1009) for i in range(20_000)),
]


def test_measures_are_those_of_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for row in df.select("i", "t", q.judge(F.col("t")).alias("q")).collect():
        m = row["q"]
        got = (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"])
        want = brute(row["t"])
        assert got == want, row["t"]
        assert m["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (m["base_failed"] and m["kept"])


def test_keep_leaves_columns_alone(spark):
    docs = awkward(spark)
    kept = q.keep(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "2", "None"]  # the long one repeats itself
    assert all(r["n_words"] == "x" for r in rows)
    assert q.keep(empty(spark)).count() == 0


def test_each_rule_can_reject(spark):
    clean = "the cat and the dog went to a house by the sea with an old friend of the family "
    bad = {
        "too_short": "the cat",
        "repeated_words": clean + clean,
        "mean_word_length": " ".join("abcdefghijklmnopqrstuvwxyz" + str(i) for i in range(30)),
        "symbols_per_word": clean.replace(" ", " # "),
        "exclamations_per_word": clean.replace(" ", "! "),
        "duplicate_lines": "\n".join(["a b"] * 6 + clean.split()[:2] + [clean]),  # five of nine lines repeat an earlier one
        "stop_word_ratio": " ".join(f"qz{i}" for i in range(120)),
    }
    df = spark.createDataFrame([*bad.items(), ("", clean)], "rule string, t string")
    for row in df.select("rule", q.judge(F.col("t")).alias("q")).collect():
        if row["rule"]:
            assert row["rule"] in row["q"]["failed_rules"]
        else:
            assert row["q"]["kept"], row["q"]["failed_rules"]


def test_filtered_plan_runs_no_python_and_is_not_quadratic(spark):
    words = " ".join(str(i) for i in range(60_000))
    df = spark.createDataFrame([(words,)], "text string")
    assert q.keep(df).count() == 0  # would not end if arrays were made anew for each element
    plan = q.keep(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
