"""The registered queries over the smallest given tables, against SQL or brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import packing, quality_rules
from matchloom.llm.queries import ORACLE, QUERIES
from matchloom.llm.registry import table
from matchloom.sources.staging import stage
from tests.llm.helpers import awkward, empty
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near import brute_classes
from tests.llm.test_quality import brute
from tests.llm.test_runs import brute_collapsed, brute_runs
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").collect()


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    status, detail, _, _ = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLE[name])
    assert status == "ok", detail


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language(spark, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d["doc_id"]]["held_out"] == (crc(d["doc_id"], 3) == 1)
    held = [d for d in docs if crc(d["doc_id"], 3) == 1]
    assert sum(rows[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.98 * len(held)


def test_shards(spark, docs):
    rows = QUERIES["op3_ring_shards"](spark, SF).collect()
    by = {r["doc_id"]: r for r in rows}
    for d in docs:
        body = d["text"].encode()
        assert (by[d["doc_id"]]["size"], by[d["doc_id"]]["text_crc32"]) == (len(body) + 16, zlib.crc32(body))
    loads = Counter(r["shard"] for r in rows)
    assert max(loads.values()) - min(loads[s] for s in range(40)) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(loads[s]))


def test_base_scores(spark, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op4_ppm_score"](spark, SF).collect()}
    sizes = {d["doc_id"]: len(d["text"].encode()) for d in docs}
    tokens = {d["doc_id"]: [*d["text"].encode().lower().split(), None] for d in docs}  # None: the end
    counts = Counter(t for d in docs if crc(d["doc_id"], 7) != 2 for t in tokens[d["doc_id"]])
    total = sum(counts.values())
    gains = []
    for doc, own in tokens.items():
        r = rows[doc]
        assert r["held_out"] == (crc(doc, 7) == 2) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(counts[t] > 0 for t in own))
        want = sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own)
        assert abs(r["base_score"] - want) < 1e-6
        if r["held_out"]:
            gains.append(r["score"] > -1.2 * (sizes[doc] + 1))  # 4 bits a byte; an even share is 8
    assert len(gains) > 20 and all(gains)


def test_classes(spark, docs):
    rows = {r["doc_id"]: r["class_id"] for r in QUERIES["op5_bag_minhash"](spark, SF).collect()}
    assert rows == brute_classes([(d["doc_id"], d["text"]) for d in docs])


def test_mixture(spark, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op6_mixing"](spark, SF).collect()}
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += len(WORD.findall(d["text"]))
    targets, taken = brute_targets(sizes), Counter()
    for d in docs:
        r = rows[d["doc_id"]]
        assert r["size"] == len(WORD.findall(d["text"])) and r["source_size"] == sizes[d["source"]]
        assert abs(r["target"] - targets[d["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[d["source"]] += r["taken"]
    assert all(taken[s] == round(t) for s, t in targets.items())


def test_batches(spark, docs):
    rows = QUERIES["op9_length_buckets"](spark, SF).collect()
    lengths = {d["doc_id"]: len(WORD.findall(d["text"])) for d in docs}
    assert {r["doc_id"]: r["length"] for r in rows} == lengths
    ends = packing.boundaries(sorted(Counter(lengths.values()).items()), 16)
    assert all(r["padded"] == min(e for e in ends if e >= r["length"]) for r in rows)


def test_fingerprints(spark, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op10_chroma_prints"](spark, SF).collect()}
    assert len(rows) == len(docs)
    same = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        first = same.setdefault(d["text"], d["doc_id"])
        if rows[d["doc_id"]]["frames"]:
            assert rows[d["doc_id"]]["class_id"] == rows[first]["class_id"]


def test_periodic_runs(spark, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(rows) == len(docs)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for d in docs:
        words, h = WORD.findall(d["text"]), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found, r = brute_runs(words), rows[d["doc_id"]]
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r["collapsed_sha256"] == sha(brute_collapsed(words, found))


def test_pipeline_stage_by_stage(spark, docs):
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    functions = dict(corpus_pipeline.STAGES)
    source = table(spark, SF, "documents")
    step, kept = {}, source
    for name, fn in corpus_pipeline.STAGES:
        kept = step[name] = fn(spark, kept, SF).persist()
        if name != "packing":
            assert kept.columns == source.columns
    assert list(functions) == ["quality_rules", "language_id", "near_copies", "mixture", "packing"]

    def passes(text):
        n, chars, symbols, dup, repeats = brute(text)
        lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        words = WORD.findall(text)
        stop = sum(w.lower() in quality_rules.STOP_WORDS for w in words)
        return (
            n >= 10 and repeats <= 0.2 * n and 2 <= chars / n <= 14 and symbols <= 0.1 * n
            and text.count("!") <= 0.3 * n and dup <= 0.5 * lines and (n < 100 or stop >= 0.02 * n)
        )

    clean = [d for d in docs if passes(d["text"])]
    assert ids(step["quality_rules"]) == sorted(d["doc_id"] for d in clean)
    assert ids(step["language_id"]) == ids(step["quality_rules"])  # all of these are in a clear language
    classes = brute_classes([(d["doc_id"], d["text"]) for d in clean])
    assert ids(step["near_copies"]) == sorted(set(classes.values()))
    sizes = Counter()
    for r in step["near_copies"].collect():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    mixed = Counter()
    for r in step["mixture"].collect():
        mixed[r["source"]] += len(WORD.findall(r["text"]))
    most = max(len(WORD.findall(d["text"])) for d in docs)
    assert all(2 * abs(mixed[s] - t) <= most + 1 for s, t in brute_targets(sizes).items())
    texts = Counter((r["doc_id"], r["text"]) for r in step["mixture"].collect())
    assert set(texts) <= {(d["doc_id"], d["text"]) for d in docs}
    assert Counter((r["doc_id"], r["text"]) for r in step["packing"].collect()) == texts
    assert step["packing"].select("row").distinct().count() == step["packing"].count()
    assert ids(step["packing"]) == ids(step["mixture"])
    packed = corpus_pipeline.run(spark, SF)
    assert ids(packed) == ids(step["packing"])
    assert packed.groupBy("bucket", "batch").count().count() == step["packing"].groupBy("bucket", "batch").count().count()


@pytest.mark.parametrize("make", ["awkward", "unlabelled", "empty"])
def test_pipeline_over_awkward_tables(spark, make):
    docs = {"awkward": awkward, "empty": empty, "unlabelled": lambda s: awkward(s).withColumn("lang", F.lit(None).cast("string"))}[make](spark)
    columns = docs.columns
    for name, fn in corpus_pipeline.STAGES:
        docs = stage(fn(spark, docs, SF), "awkward")
        if name != "packing":
            assert docs.columns == columns
    assert docs.count() == 0 if make == "empty" else {r["doc_id"] for r in docs.collect()} & {1, 2}
