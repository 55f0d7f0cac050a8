"""Retrieval quality, latency and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import suffix_match

KS = (1, 3, 5, 10)


WORD = r"[\p{L}\p{N}_]+"


def expected_by_text(cases: DataFrame, symbols: DataFrame) -> DataFrame:
    """(query_id, expected): the symbols whose code holds a case's text.

    A word within the text, not at its ends, is a word of any code that holds it, so the two meet by the longest such
    word and only then is the text looked for. Cases of under three words have none and are looked for in all code.
    """
    words = F.regexp_extract_all(F.col("question"), F.lit(WORD), F.lit(0))
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    c = cases.select("query_id", "question", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("probe"))
    s = symbols.select("qualified_name", "source_code")
    each = s.select("qualified_name", "source_code", F.explode(F.array_distinct(F.regexp_extract_all("source_code", F.lit(WORD), F.lit(0)))).alias("probe"))
    long = each.join(c.filter("probe is not null"), "probe").filter(F.col("source_code").contains(F.col("question")))
    short = s.join(c.filter("probe is null and question is not null"), F.col("source_code").contains(F.col("question")))
    return long.select("query_id", F.col("qualified_name").alias("expected")).unionByName(short.select("query_id", F.col("qualified_name").alias("expected")))


def first_hit_rank(cases: DataFrame, ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, first_hit): the rank of the first candidate that is expected, null without."""
    hit = ranked.join(expected, "query_id").filter(suffix_match(F.col("qualified_name"), F.col("expected"))).groupBy("query_id").agg(F.min("rank").alias("first_hit"))
    return cases.select("query_id").join(hit, "query_id", "left")


def recall(first: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """n_cases, recall at each k, and the mean reciprocal rank."""
    at = [F.round(F.avg(F.when(F.col("first_hit") <= k, F.lit(1.0)).otherwise(F.lit(0.0))), 6).alias(f"recall_at_{k}") for k in ks]
    return first.agg(F.count("*").alias("n_cases"), *at, F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))), 6).alias("mrr"))


def first_files(ranked: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """The first n distinct files of each query in the order of its candidates."""
    m = ranked.groupBy("query_id", "file_path").agg(F.min("rank").alias("first_rank"))
    nth = m.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")).cast("long")).filter(F.col("nth") <= n)
    return nth.join(files, "file_path").select("query_id", "file_path", "nth", F.col("tokens").cast("long").alias("tokens"))


def against_whole(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Mean context against the whole repository's tokens."""
    whole = symbols.agg(F.sum("token_count").cast("double").alias("whole"))
    mean = rows.agg(F.count("*").alias("n_cases"), F.avg("context_tokens").alias("mean"))
    return mean.crossJoin(whole).select("n_cases", F.round("whole", 6).alias("whole_tokens"), F.round("mean", 6).alias("avg_context_tokens"), F.round(100.0 * (1.0 - F.col("mean") / F.col("whole")), 1).alias("reduction_percent"))


def latency(samples: DataFrame, column: str, *keys: str) -> DataFrame:
    """n, p50, p95 and mean of each group; a percentile is the sample at place floor(p * n) of the sorted ones."""
    w = Window.partitionBy(*keys).orderBy(column)
    r = samples.select(*keys, F.col(column).alias("x"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    at = lambda p: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))), F.col("x")))
    return r.groupBy(*keys).agg(F.max("n").alias("n"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), F.round(F.avg("x"), 6).alias("mean_ms"))
