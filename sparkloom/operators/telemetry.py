"""Marts over recorded queries and model requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICE_IN, PRICE_OUT = 3.0, 15.0


def _pct(part, whole):
    return F.when(whole != 0, F.round(100.0 * part / whole, 1)).otherwise(F.lit(0.0))


def metrics(queries: DataFrame, requests: DataFrame, counted: dict[str, DataFrame], *, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> DataFrame:
    """One row: how many of each table, averages, tokens saved against candidates and against whole files, dollars."""
    q = queries.agg(
        F.count("*").alias("queries"), F.round(F.coalesce(F.avg("context_tokens"), F.lit(0.0)), 1).alias("avg_context_tokens"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 2).alias("avg_latency_ms"),
        F.coalesce(F.sum("candidate_tokens"), F.lit(0)).alias("candidate_tokens"), F.coalesce(F.sum("context_tokens"), F.lit(0)).alias("context_tokens"),
        F.coalesce(F.sum("baseline_tokens"), F.lit(0)).alias("baseline_tokens"), F.coalesce(F.sum(F.when(F.col("baseline_tokens") > 0, F.col("context_tokens"))), F.lit(0)).alias("based_context"),
    )
    r = requests.agg(F.count("*").alias("requests"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    out = q.crossJoin(r)  # one row each
    for name, df in counted.items():
        out = out.crossJoin(df.agg(F.count("*").alias(name)))
    saved, vs_files = F.col("candidate_tokens") - F.col("context_tokens"), F.col("baseline_tokens") - F.col("based_context")
    return out.select(
        "queries", "requests", *counted, "avg_context_tokens", "avg_latency_ms", "input_tokens", "output_tokens", "candidate_tokens", "context_tokens", saved.alias("tokens_saved"), _pct(saved, F.col("candidate_tokens")).alias("reduction_percent"),
        "baseline_tokens", vs_files.alias("saved_vs_files"), _pct(vs_files, F.col("baseline_tokens")).alias("reduction_vs_files"), F.round(vs_files / 1e6 * price_in, 4).alias("usd_saved_vs_files"),
        F.round(F.col("context_tokens") / 1e6 * price_in, 4).alias("usd_context"), F.round(F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out, 4).alias("usd_requests"),
    )


def tokens_by_query(requests: DataFrame) -> DataFrame:
    return requests.groupBy("query_id").agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("llm_input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("llm_output_tokens"))


def recent_queries(queries: DataFrame, repositories: DataFrame, requests: DataFrame, limit: int = 100) -> DataFrame:
    """The latest queries with their repository's name, savings, and the tokens of their requests (null without)."""
    top = queries.join(repositories, "repository_id").orderBy(F.desc("query_id")).limit(limit)
    saved, vs = F.col("candidate_tokens") - F.col("context_tokens"), F.col("baseline_tokens") - F.col("context_tokens")
    based = F.col("baseline_tokens") > 0
    return top.join(tokens_by_query(requests), "query_id", "left").select(
        "query_id", "repository", "mode", "query_text", "candidate_tokens", "context_tokens", saved.alias("tokens_saved"), _pct(saved, F.col("candidate_tokens")).alias("reduction_percent"), "baseline_tokens",
        F.when(based, vs).otherwise(0).cast("long").alias("saved_vs_files"), F.when(based, F.round(100.0 * vs / F.col("baseline_tokens"), 1)).otherwise(F.lit(0.0)).alias("reduction_vs_files"), F.round("latency_ms", 2).alias("latency_ms"), "llm_input_tokens", "llm_output_tokens",
    )


def latest_by(df: DataFrame, key: str, *order) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def query_results(ranked: DataFrame, picked: DataFrame) -> DataFrame:
    """The rows that record rankings: rank, score, reasons, and whether packing took the symbol."""
    took = picked.select("query_id", "symbol_id", F.lit(True).alias("selected"))
    return ranked.join(took, ["query_id", "symbol_id"], "left").select("query_id", "symbol_id", "rank", F.col("fused_score").alias("score"), "reasons", F.coalesce("selected", F.lit(False)).alias("selected"))
