"""The corpus pipeline against a plain version, and its SQL-checked operators against DuckDB."""

import re

import brute
import duckdb
import pytest

import corpus_pipeline
from test_similar import components
from sparkloom.llm import decontaminate, langid, packing, queries
from sparkloom.tables import table

SMALL = "/root/testdata/sf0.001"


def plain(spark, folder):
    docs = [(x["doc_id"], x["text"], x["lang"], x["source"]) for x in table(spark, folder, "documents").collect()]
    items = [re.findall(r"[^\W_]+", x["text"].lower()) for x in table(spark, folder, "benchmark").collect()]
    net = langid.train(table(spark, folder, "documents"))
    langs, scores = langid.predict(net, [d[1] for d in docs])
    docs = [d for d, lang, s in zip(docs, langs, scores, strict=True) if lang != "und" and s >= 0.35]
    texts = {k: t for k, t, _ in brute.drop_lines([(d[0], d[3], d[1]) for d in docs])}
    first = {c for _, c in components(list(texts.items()))[0]}
    kept = {}
    for k in sorted(first):
        words = [w.decode() for w in decontaminate.words_of(texts[k])]
        if not any(i and brute.word_edits(i, words) <= len(i) // 5 for i in items):
            kept[k] = texts[k]
    return kept


def test_pipeline_equals_the_plain_one(spark):
    got = corpus_pipeline.run(spark, SMALL)
    kept = plain(spark, SMALL)
    want = sorted((k, i, s, n) for k, t in kept.items() for i, (s, n) in enumerate(packing.cut([*packing.token_ids(t, packing.default_vocabulary()), 0])))
    assert sorted((x["doc_id"], x["piece"], x["start"], x["length"]) for x in got.collect()) == want
    ends = got.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(x[1] <= packing.SIZE for x in ends)
    assert len(ends) <= -(-sum(n for *_, n in want) // packing.SIZE) + 1


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SMALL, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "Hello there my friend", None, None, 3), (2, "Hello there my friend", None, None, 3)], docs.schema)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    clash = odd.selectExpr("*", "1 AS node", "'x' AS label", "2 AS host", "array(1) AS x", "3 AS mark", "4 AS count", "5 AS component_id", "6 AS bucket")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for some in (clash, docs.limit(0)):
            out = stage(spark, some, SMALL)
            assert out.columns == some.columns and dict(out.dtypes) == dict(some.dtypes)
            assert out.count() <= some.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SMALL).count() == 4


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = queries.queries()[name](spark, SMALL)
    cur = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_each_operator_has_one_query():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
