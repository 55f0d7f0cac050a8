"""Language identification: held-out accuracy, determinism, defined results for odd rows."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import langid

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def network(docs):
    return langid.train(docs)


def test_held_out_accuracy(docs, network):
    got = langid.identify(docs, network).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right >= 0.97 * n


def test_held_out_rows_are_those_of_the_hash(docs, network):
    for x in langid.identify(docs, network).select("doc_id", "held_out").collect():
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)


def test_training_is_repeatable_and_ignores_held_out_rows(spark, docs, network):
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).repartition(7)
    again = langid.train(other)
    assert again.labels == network.labels
    assert all((getattr(again, k) == getattr(network, k)).all() for k in ("embed", "conv", "bias", "out", "out_bias"))


def test_odd_rows(spark, network):
    long = "the house and the garden " * 40_000
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "é"), (5, long), (None, "bonjour à tous les amis"), (4, "é")]
    docs = spark.createDataFrame([(*t, 1.0, "x") for t in rows], "doc_id long, text string, score double, lang_pred string")
    got = [(x["doc_id"], x["lang_pred"], x["score"]) for x in langid.identify(docs, network).collect()]
    assert len(got) == len(rows)
    assert {(k, p, s) for k, p, s in got if k in (1, 2, 3)} == {(k, "und", 0.0) for k in (1, 2, 3)}
    assert all(p in network.labels and 0 < s <= 1 for k, p, s in got if k not in (1, 2, 3))
    assert langid.identify(docs.limit(0), network).count() == 0


def test_whole_texts_count(network):
    en, fr = "the and with that for this from which " * 60, "les des une avec pour dans est que vous " * 200
    both = langid.predict(network, [en, fr, en + fr])
    assert both[0][2] == both[0][1]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "hello", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(x["lang_pred"], x["score"]) for x in langid.identify(docs).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "hello there", "en") for i in range(9)], "doc_id long, text string, lang string")
    assert {x["lang_pred"] for x in langid.identify(one).collect()} == {"en"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_letters_are_those_of_unicode(network):
    assert not any(map(langid.has_letter, ("", "12 _!?", "½ ² Ⅷ ①", "\u0301", "٣", "😀")))
    assert all(map(langid.has_letter, ("½x", "é", "日", "ʰ", "_a_")))
    assert langid.predict(network, ["½ ² Ⅷ ①"]) == (["und"], [0.0])


def test_forward_pass_is_that_of_plain_loops(network):
    data, total = ("El río y la casa, the house; déjà vu 123 " * 9).encode(), [0.0] * len(network.labels)
    starts = range(0, len(data), langid.WINDOW)
    for at in starts:
        window = data[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        hidden = []
        for f in range(network.conv.shape[1]):
            best = -float("inf")
            for i in range(langid.WINDOW - max(langid.WIDTHS) + 1):
                best = max(best, sum(float(network.embed[window[i + k], d]) * float(network.conv[k * langid.EMBED + d, f]) for k in range(max(langid.WIDTHS)) for d in range(langid.EMBED)))
            hidden.append(max(0.0, best + float(network.bias[f])))
        scores = [sum(h * float(network.out[f, c]) for f, h in enumerate(hidden)) + float(network.out_bias[c]) for c in range(len(network.labels))]
        parts = [math.exp(s - max(scores)) for s in scores]
        total = [t + p / sum(parts) / len(starts) for t, p in zip(total, parts, strict=True)]
    (lang,), (score,) = langid.predict(network, [data.decode()])
    assert lang == network.labels[total.index(max(total))] and abs(score - max(total)) < 1e-4
