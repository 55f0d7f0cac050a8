"""What the large tables showed: steps whose tasks grew with the input, or did the same work again; each against a plain version."""

import hashlib
import math
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import vectors as V
from sparkloom.operators import blocks, compress, findings, index, retrieve


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain_embedding(terms, dim=V.DIM):
    sums = {}
    for t in dict.fromkeys(terms):
        h = hashlib.md5(t.encode()).hexdigest()
        b = int(h[:8], 16) % dim
        sums[b] = sums.get(b, 0) + (1 if int(h[9], 16) % 2 else -1)
    kept = {b: v for b, v in sorted(sums.items()) if v}
    norm = math.sqrt(sum(v * v for v in kept.values()))
    return [(b, v / norm) for b, v in kept.items()]


def test_embeddings_are_formed_within_the_row(spark):
    rows = [(1, ["a", "b", "a"]), (2, []), (3, None), (4, [f"w{i}" for i in range(300)]), (5, [f"w{i}" for i in range(40)])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    for dim in (V.DIM, 3):  # at 3 buckets cancel
        x = V.hash_embed(df, F.col("t"), "k", dim=dim)
        assert not any(s in plan(x) for s in ("Exchange", "Aggregate", "Sort", "Window"))
        want = [(k, b, v) for k, t in rows for b, v in plain_embedding(t or [], dim)]
        assert sorted((r["k"], r["bucket"], round(r["value"], 12)) for r in x.collect()) == [(k, b, round(v, 12)) for k, b, v in want]
    s = spark.createDataFrame([(1, i, str(i), t) for i, t in ((1, "one two"), (2, ""), (3, "one"))], "repository_id long, symbol_id long, source_hash string, search_document string")
    e = index.embed(s)
    assert not any(x in plan(e) for x in ("Exchange", "Aggregate", "Sort", "Window"))
    assert {r["symbol_id"]: [(x["bucket"], round(x["value"], 12)) for x in r["embedding"]] for r in e.collect()} == {i: [(b, round(v, 12)) for b, v in plain_embedding(t)] for i, t in ((1, ["one", "two"]), (3, ["one"]))}


def test_encoded_runs_are_read_once(spark):
    """A run that is too short was read again from each of its characters, and each text several times."""
    runs = ["QUJD" * 500, "QUJD" * 511 + "Q", "QUJD" * 512, "x QUJD" * 600, "=" + "QUJD" * 600 + "===" + "QUJD" * 700 + "é" + "a" * 2047, "a" * 40_000, ("b" * 2000 + " ") * 400]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(runs)], "i long, t string")
    got = {r["i"]: r["c"] for r in df.select("i", compress.compress_text(F.col("t"), F.lit(10**7), F.lit(500)).alias("c")).collect()}
    assert [got[i] for i in range(len(runs))] == [compress.compress(x, 10**7, 500) for x in runs]
    assert re.sub(compress.ENCODED_AT, "", "".join(runs)) == re.sub(compress.ENCODED, "", "".join(runs))
    lines = ["an ERROR", "fine", "Panic", "assertion", "xwarnx", "rror", "İerror", "", "trace back", "TraceBack"]
    told = spark.createDataFrame([(x,) for x in lines], "t string").select("t", compress.tells(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in told} == {x: bool(re.search(f"(?i){compress.IMPORTANT}", x)) for x in lines}


def test_cosines_in_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 40)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    rng = np.random.default_rng(5)
    v = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(150)]  # many ties
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [1.0, 2.0], [math.nan, 1.0, 0.0, 0.0]]
    rows = [(i % 2, i, x) for i, x in enumerate(v + odd)]
    df = spark.createDataFrame(rows, "repository_id long, symbol_id long, embedding array<float>")
    q = df.filter("symbol_id % 5 = 0 or symbol_id >= 150").select(F.col("symbol_id").alias("query_id"), "repository_id", F.col("embedding").alias("vector"))
    got = retrieve.vector_hits(q, df, 9)
    p = plan(got)
    assert "FlatMapCoGroupsInArrow" in p
    exact = df.join(q, "repository_id").select("query_id", "symbol_id", F.round(V.cosine(F.col("embedding"), F.col("vector")), 6).alias("score")).filter("score is not null")
    key = lambda df: sorted((r["query_id"], r["rank"], r["symbol_id"], repr(r["score"] + 0.0)) for r in df.collect())
    assert key(got) == key(retrieve.best(exact, 9, "semantic"))


def test_many_queries_in_blocks_find_what_few_find(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 30)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(25)]
    code = lambda n: " ".join(rng.choice(words, n))
    s = spark.createDataFrame([(i % 2, i, code(int(rng.integers(0, 12)))) for i in range(120)], "repository_id long, symbol_id long, source_code string")
    q = spark.createDataFrame([(i, i % 3, x) for i, x in enumerate([code(3) for _ in range(30)] + ["", "none"])], "query_id long, repository_id long, question string")
    i = retrieve.build_index(s)
    key = lambda df: sorted(map(repr, df.collect()))
    few, many = key(retrieve.lexical_hits(q, i.lists, 5)), key(retrieve.lexical_hits_of_many(q, i.lists, 5))
    assert few == many and len(few) > 90
    assert key(retrieve.semantic_hits(q, i.vectors, 5)) == key(retrieve.semantic_hits_of_many(q, i.vectors, 5))


def test_search_terms_stay_in_arrow():
    idents = [["fooBar", "foo", "FOO"], None, [], ["x"] * 3] * 100  # more than a slice
    got = X.search_terms.func(pa.array(idents, pa.list_(pa.string()))).to_pylist()
    assert got == [["fooBar", "foo", "bar"], [], [], ["x"]] * 100


def test_findings_of_a_line_and_equal_spans_meet_once(spark):
    s = [(i, f"f{i % 2}", "module" if i % 7 == 0 else "class", i % 5 * 40, i % 5 * 40 + i % 3 * 30) for i in range(90)]
    f = [(i, f"f{i % 3}", i % 11 * 25) for i in range(80)]
    df = spark.createDataFrame(s, "symbol_id long, file_path string, symbol_type string, start_line int, end_line int")
    got = findings.enclosing_symbols(spark.createDataFrame(f, "finding_id long, file_path string, line int"), df)
    assert re.search(r"Aggregate \[file_path#\d+, line#\d+L\], \[file_path", got._jdf.queryExecution().analyzed().toString())
    want = {}
    for i, path, line in f:
        inner = [(t == "module", b - a, k) for k, p, t, a, b in s if p == path and a <= line <= b]
        modules = [k for k, p, t, _, _ in s if p == path and t == "module"]
        want[i] = (min(inner)[2], "span") if inner else (min(modules), "module") if modules else (None, None)
    assert {r["finding_id"]: (r["symbol_id"], r["how"]) for r in got.collect()} == want
