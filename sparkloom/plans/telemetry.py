"""Queries for the telemetry marts and the cost doctor."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import doctor, telemetry
from sparkloom.plans.registry import query
from sparkloom.plans.views import view
from sparkloom.tables import table

PRICES = {"large-": (5.0, 25.0), "large-a": (10.0, 50.0), "medium-b": (3.0, 15.0), "small-c": (1.0, 5.0)}
D = "::DOUBLE"


def _price_sql(col: str, side: int) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({col}, '{p}') THEN {PRICES[p][side]}{D}" for p in sorted(PRICES, key=lambda p: (-len(p), p))) + " END"


_USD = "(coalesce(input_tokens, 0) / 1e6 * {0} + coalesce(cached_input_tokens, 0) / 1e6 * {0} * 0.10::DOUBLE + coalesce(cache_creation_input_tokens, 0) / 1e6 * {0} * 1.25::DOUBLE + coalesce(output_tokens, 0) / 1e6 * {1})"
PRICED = f"pr AS (SELECT *, coalesce({_price_sql('model', 0)}, 3.0{D}) AS pin, coalesce({_price_sql('model', 1)}, 15.0{D}) AS pout FROM v_requests)"
ATTR = f"""{PRICED}, at0 AS (SELECT count(*) AS requests, sum(input_tokens)::BIGINT AS fresh, sum(cached_input_tokens)::BIGINT AS reads, sum(cache_creation_input_tokens)::BIGINT AS writes, sum(output_tokens)::BIGINT AS output, sum(tool_result_chars)::BIGINT AS tool_chars, sum(tool_schema_chars)::BIGINT AS schema_chars, count(*) FILTER (NOT success) AS failed,
 sum(input_tokens / 1e6 * pin) AS fresh_usd, sum(coalesce(cached_input_tokens, 0) / 1e6 * pin * 0.1{D}) AS read_usd, sum(coalesce(cache_creation_input_tokens, 0) / 1e6 * pin * 1.25{D}) AS write_usd, sum(output_tokens / 1e6 * pout) AS output_usd FROM pr),
attr AS (SELECT *, fresh_usd + read_usd + write_usd + output_usd AS total_usd, reads / (fresh + reads){D} AS hit_rate, fresh_usd / fresh * 1e6 AS eff_price FROM at0)"""
MIX = f"{PRICED}, mix AS (SELECT model, count(*) AS requests, sum(coalesce(input_tokens, 0))::BIGINT AS fresh, sum(coalesce(cached_input_tokens, 0))::BIGINT AS reads, sum(coalesce(cache_creation_input_tokens, 0))::BIGINT AS writes, sum(coalesce(output_tokens, 0))::BIGINT AS output, round(sum({_USD.format('pin', 'pout')}), 9) AS usd FROM pr GROUP BY 1)"
_MONEY = ("fresh_usd", "read_usd", "write_usd", "output_usd", "total_usd", "hit_rate", "eff_price")


def _requests(spark, d):
    return view(spark, d, "requests")


@query("""WITH q AS (SELECT count(*) AS queries, round(avg(context_tokens), 1) AS avg_context_tokens, round(avg(latency_ms), 2) AS avg_latency_ms, sum(candidate_tokens)::BIGINT AS candidate_tokens, sum(context_tokens)::BIGINT AS context_tokens, sum(baseline_tokens)::BIGINT AS baseline_tokens, sum(CASE WHEN baseline_tokens > 0 THEN context_tokens END)::BIGINT AS based FROM v_queries),
r AS (SELECT count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM v_requests), s AS (SELECT count(*) AS symbols FROM v_symbols), e AS (SELECT count(*) AS embeddings FROM embeddings), g AS (SELECT count(*) AS relationships FROM v_edges)
SELECT queries, requests, symbols, embeddings, relationships, avg_context_tokens, avg_latency_ms, input_tokens, output_tokens, candidate_tokens, context_tokens, candidate_tokens - context_tokens AS tokens_saved, round(100.0::DOUBLE * (candidate_tokens - context_tokens) / candidate_tokens, 1) AS reduction_percent,
baseline_tokens, baseline_tokens - based AS saved_vs_files, round(100.0::DOUBLE * (baseline_tokens - based) / baseline_tokens, 1) AS reduction_vs_files, round((baseline_tokens - based) / 1e6 * 3, 4) AS usd_saved_vs_files, round(context_tokens / 1e6 * 3, 4) AS usd_context, round(input_tokens / 1e6 * 3 + output_tokens / 1e6 * 15, 4) AS usd_requests FROM q, r, s, e, g""")
def agg_metrics(spark, d):
    return telemetry.metrics(view(spark, d, "queries"), _requests(spark, d), {"symbols": view(spark, d, "symbols"), "embeddings": table(spark, d, "embeddings"), "relationships": view(spark, d, "edges")})


@query("SELECT query_id, coalesce(sum(input_tokens), 0)::BIGINT AS llm_input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS llm_output_tokens FROM v_requests GROUP BY 1")
def agg_llm_by_query(spark, d):
    return telemetry.tokens_by_query(_requests(spark, d))


_RECENT = """WITH repo AS (SELECT n_nationkey::BIGINT AS repository_id, n_name AS repository FROM nation), l AS (SELECT query_id, sum(input_tokens)::BIGINT AS llm_input_tokens, sum(output_tokens)::BIGINT AS llm_output_tokens FROM v_requests GROUP BY 1),
t AS (SELECT * FROM v_queries JOIN repo USING (repository_id){0})
SELECT query_id, repository, mode, query_text, candidate_tokens, context_tokens, candidate_tokens - context_tokens AS tokens_saved, CASE WHEN candidate_tokens <> 0 THEN round(100.0::DOUBLE * (candidate_tokens - context_tokens) / candidate_tokens, 1) ELSE 0.0::DOUBLE END AS reduction_percent, baseline_tokens,
CASE WHEN baseline_tokens > 0 THEN baseline_tokens - context_tokens ELSE 0 END AS saved_vs_files, CASE WHEN baseline_tokens > 0 THEN round(100.0::DOUBLE * (baseline_tokens - context_tokens) / baseline_tokens, 1) ELSE 0.0::DOUBLE END AS reduction_vs_files, round(latency_ms, 2) AS latency_ms, llm_input_tokens, llm_output_tokens FROM t LEFT JOIN l USING (query_id)"""


def _repos(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("repository_id"), F.col("n_name").alias("repository"))


@query(_RECENT.format(" ORDER BY query_id DESC LIMIT 100"))
def recent_queries(spark, d):
    return telemetry.recent_queries(view(spark, d, "queries"), _repos(spark, d), _requests(spark, d))


@query("WITH repo AS (SELECT n_nationkey::BIGINT AS repository_id, n_name AS repository FROM nation) SELECT query_id, repository FROM v_queries JOIN repo USING (repository_id)")
def join_query_repo(spark, d):
    return view(spark, d, "queries").join(_repos(spark, d), "repository_id").select("query_id", "repository")


@query("WITH l AS (SELECT query_id, sum(input_tokens)::BIGINT AS llm_input_tokens, sum(output_tokens)::BIGINT AS llm_output_tokens FROM v_requests GROUP BY 1) SELECT query_id, mode, llm_input_tokens, llm_output_tokens FROM v_queries LEFT JOIN l USING (query_id)")
def join_query_llm(spark, d):
    return view(spark, d, "queries").join(telemetry.tokens_by_query(_requests(spark, d)), "query_id", "left").select("query_id", "mode", "llm_input_tokens", "llm_output_tokens")


@query("SELECT repository_id, query_id, mode, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY latency_ms DESC, query_id DESC) AS n FROM v_queries) x WHERE n = 1")
def latest_run(spark, d):
    return telemetry.latest_by(view(spark, d, "queries"), "repository_id", F.desc("latency_ms"), F.desc("query_id")).select("repository_id", "query_id", "mode", "latency_ms")


@query(f"SELECT DISTINCT model, {_price_sql('model', 0)} AS price_in, {_price_sql('model', 1)} AS price_out FROM v_requests")
def model_price(spark, d):
    m = _requests(spark, d).select("model").distinct()
    return m.select("model", doctor.price(F.col("model"), PRICES, 0).alias("price_in"), doctor.price(F.col("model"), PRICES, 1).alias("price_out"))


@query(f"WITH {PRICED} SELECT request_id, round({_USD.format('pin', 'pout')}, 9) AS usd FROM pr")
def row_usd(spark, d):
    return doctor.priced(_requests(spark, d), PRICES).select("request_id", F.round(doctor.row_usd(F.col("pin"), F.col("pout")), 9).alias("usd"))


@query(f"WITH {ATTR} SELECT requests, fresh, reads, writes, output, tool_chars, schema_chars, failed, " + ", ".join(f"round({c}, 9) AS {c}" for c in _MONEY) + " FROM attr")
def agg_attribute(spark, d):
    return doctor.attribute(_requests(spark, d), PRICES).withColumns({c: F.round(c, 9) for c in _MONEY})


@query(f"WITH {MIX} SELECT *, row_number() OVER (ORDER BY usd DESC, model) AS pos FROM mix")
def agg_model_mix(spark, d):
    return doctor.model_mix(_requests(spark, d), PRICES)


_EFFECT = "SELECT '{0}' AS lever, count(*) FILTER ({1}) AS active, count(*) FILTER (NOT {1}) AS inactive, coalesce(avg(output_tokens) FILTER ({1}), 0) AS avg_active, coalesce(avg(output_tokens) FILTER (NOT {1}), 0) AS avg_inactive FROM v_requests"


@query("WITH e AS (" + " UNION ALL ".join(_EFFECT.format(k, v) for k, v in doctor.LEVERS.items()) + ") SELECT lever, active, inactive, round(avg_active, 6) AS avg_active, round(avg_inactive, 6) AS avg_inactive, CASE WHEN active >= 5 AND inactive >= 5 AND avg_inactive > 0 THEN round(1 - avg_active / avg_inactive, 6) END AS reduction FROM e")
def agg_effect(spark, d):
    out = None
    for k, flag in doctor.LEVERS.items():
        e = doctor.effect(_requests(spark, d), flag).select(F.lit(k).alias("lever"), "active", "inactive", *(F.round(c, 6).alias(c) for c in ("avg_active", "avg_inactive", "reduction")))
        out = e if out is None else out.unionByName(e)
    return out


@query(f"WITH {ATTR}, c AS (SELECT count(*) AS compressed, coalesce(sum(compression_chars_saved), 0)::BIGINT AS chars_saved FROM v_requests WHERE compression_chars_saved > 0) SELECT compressed, chars_saved, floor(chars_saved / 4.0::DOUBLE)::BIGINT AS tokens_saved, round(floor(chars_saved / 4.0::DOUBLE) / 1e6 * eff_price, 6) AS usd_saved FROM c, attr")
def agg_compression(spark, d):
    return doctor.compression_effect(_requests(spark, d), PRICES)


@query(f"""WITH r AS (SELECT *, {_price_sql('requested_model', 0)} AS ri, {_price_sql('requested_model', 1)} AS ro, {_price_sql('model', 0)} AS si, {_price_sql('model', 1)} AS so FROM v_requests WHERE requested_model IS NOT NULL AND requested_model <> model)
SELECT count(*) AS routed, round(coalesce(sum({_USD.format('ri', 'ro')} - {_USD.format('si', 'so')}), 0), 9) AS usd_saved, count(*) FILTER (ri IS NULL OR si IS NULL) AS unpriced FROM r""")
def agg_routing(spark, d):
    return doctor.routing_savings(_requests(spark, d), PRICES)


_GROW = "g AS (SELECT count(*) AS n, round(avg(x) FILTER (i <= greatest(1, m // 4)), 6) AS early, round(avg(x) FILTER (i > m - greatest(1, m // 4)), 6) AS late FROM (SELECT input_tokens + coalesce(cached_input_tokens, 0) AS x, row_number() OVER (ORDER BY conv_id, turn) AS i, count(*) OVER () AS m FROM v_requests) y)"


@query(f"WITH {_GROW} SELECT n, early, late FROM g")
def quartile_growth(spark, d):
    return doctor.growth(_requests(spark, d), "conv_id", "turn")


@query(f"""WITH {ATTR}, {MIX[len(PRICED) + 2:]}, {_GROW}, sk AS ({_EFFECT.format('skill', 'token_lean_active')}), red AS (SELECT CASE WHEN active >= 5 AND inactive >= 5 AND avg_inactive > 0 THEN 1 - avg_active / avg_inactive END AS reduction FROM sk),
top AS (SELECT arg_max(model, usd) AS top_model, max(usd) AS top_usd, sum(usd) AS mix_usd FROM mix), b AS (SELECT attr.*, g.early, g.late, red.reduction, top.* FROM attr, g, red, top),
rules AS (
SELECT 0 AS i, 'output_dominant' AS code, total_usd > 0 AND output_usd >= 0.5 * total_usd AS fires, output_usd * CASE WHEN reduction > 0 THEN reduction ELSE 0.25{D} END AS saving FROM b
UNION ALL SELECT 1, 'no_caching', requests >= 5 AND reads = 0 AND writes = 0 AND fresh / requests > 5000, floor(fresh * 0.9{D}) / 1e6 * eff_price * 0.9{D} FROM b
UNION ALL SELECT 2, 'cache_churn', requests >= 5 AND writes > 0 AND reads < 0.5 * writes, write_usd * 0.25{D} / 1.25{D} FROM b
UNION ALL SELECT 3, 'cache_misses', requests >= 5 AND (reads > 0 OR writes > 0) AND (fresh + reads) / requests > 10000 AND hit_rate < 0.4, floor(fresh * 0.7{D}) / 1e6 * eff_price * 0.9{D} FROM b
UNION ALL SELECT 4, 'history_growth', requests >= 8 AND early > 0 AND late >= 2 * early, NULL FROM b
UNION ALL SELECT 5, 'retrieval_unused', requests >= 10 AND 1 < 2, NULL FROM b
UNION ALL SELECT 6, 'tool_output_heavy', fresh > 0 AND tool_chars / 4.0{D} >= 0.2{D} * fresh, tool_chars / 4.0{D} * 0.3{D} / 1e6 * eff_price FROM b
UNION ALL SELECT 7, 'expensive_model_dominant', requests >= 20 AND top_usd >= 0.9{D} * mix_usd AND {_price_sql('top_model', 0)} >= 5, NULL FROM b
UNION ALL SELECT 8, 'tool_schema_heavy', requests >= 10 AND schema_chars / 4.0{D} / requests >= 2000, NULL FROM b
UNION ALL SELECT 9, 'retry_storm', failed >= 3 AND failed / requests{D} >= 0.2, NULL FROM b)
SELECT code, round(saving, 4) AS saving, row_number() OVER (ORDER BY round(saving, 4) DESC NULLS LAST, i) AS pos FROM rules WHERE fires""")
def doctor_rules(spark, d):
    return doctor.diagnose(_requests(spark, d), 1, "conv_id", "turn", prices=PRICES)


@query("""WITH b AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, count(*) AS events, CAST(arg_max(length(text), turn) FILTER (turn % 2 = 0) AS BIGINT) AS input_tokens, CAST(arg_max(length(text), turn) FILTER (turn % 2 = 1) AS BIGINT) AS output_tokens FROM b GROUP BY 1""")
def src_usage_sse(spark, d):
    from sparkloom.sources import usage

    return usage.fold_demo(table(spark, d, "conversations"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens FROM events")
def src_usage_json(spark, d):
    from sparkloom.sources import usage

    body = F.concat(F.lit('{"usage":{"input_tokens":'), F.get_json_object("props", "$.k"), F.lit("}}"))
    u = usage.usage_of(body)
    return table(spark, d, "events").select("event_id", u["input_tokens"].alias("input_tokens"), u["output_tokens"].alias("output_tokens"))
