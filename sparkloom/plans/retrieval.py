"""Queries for retrieval, packing and evaluation; each batch of queries is one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import evaluate, pack, retrieve
from sparkloom.plans.registry import query
from sparkloom.plans.views import view
from sparkloom.shared_store import materialize

RAW = "regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*')"
CAMEL = "list_transform(regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+'), lambda y: lower(y))"


def terms_sql(p: str, src: str) -> str:
    """CTEs ending in {p}terms(k, term): the first 300 distinct terms of src(k, t)."""
    return f"""{p}src AS ({src}), {p}idents AS (SELECT k, unnest({RAW.format('t')}) AS ident, generate_subscripts({RAW.format('t')}, 1) AS pos FROM {p}src),
{p}parts AS (SELECT k, pos, unnest(list_concat([ident], {CAMEL.format('ident')})) AS part, generate_subscripts(list_concat([ident], {CAMEL.format('ident')}), 1) AS sub FROM {p}idents),
{p}firsts AS (SELECT k, lower(part) AS term, min(pos * 100000 + sub) AS spot FROM {p}parts GROUP BY 1, 2),
{p}terms AS (SELECT k, term FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY spot) AS r FROM {p}firsts) x WHERE r <= 300)"""


QTERMS, STERMS = terms_sql("q", "SELECT query_id AS k, question AS t FROM v_cases"), terms_sql("s", "SELECT symbol_id AS k, source_code AS t FROM v_symbols")
SYM = """
tok AS (SELECT query_id, repository_id, regexp_matches(trim(question), '^[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*$') AS like_, trim(question) AS q, list_transform(regexp_extract_all(question, '[A-Za-z_][A-Za-z0-9_.]*'), lambda t: rtrim(t, '.')) AS ts FROM v_cases),
tk AS (SELECT query_id, repository_id, like_, q, unnest(ts) AS t FROM tok), tk2 AS (SELECT query_id, repository_id, lower(t) AS key, CASE WHEN like_ AND t = q THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS base FROM tk WHERE (like_ AND t = q) OR contains(t, '.') OR contains(t, '_') OR (length(t) > 3 AND regexp_matches(t, '^[A-Z]'))),
symr AS (SELECT query_id, symbol_id, max(round(base * CASE WHEN lower(qualified_name) = key THEN 1.0::DOUBLE WHEN lower(symbol_name) = key THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END, 6)) AS score FROM tk2 t JOIN v_symbols s ON s.repository_id = t.repository_id AND (lower(qualified_name) = key OR lower(symbol_name) = key OR ends_with(lower(qualified_name), '.' || key)) GROUP BY 1, 2),
symh AS (SELECT query_id, symbol_id, 'symbol' AS source, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS rank FROM symr) x WHERE rank <= 10)"""
LEX = f"""{QTERMS}, {STERMS},
post AS (SELECT s.repository_id, t.term, s.symbol_id, count(*) OVER (PARTITION BY s.symbol_id) AS terms FROM sterms t JOIN v_symbols s ON s.symbol_id = t.k),
size_ AS (SELECT repository_id, count(*) AS n, avg(terms) AS mean FROM (SELECT DISTINCT repository_id, symbol_id, terms FROM post) x GROUP BY 1), dfs AS (SELECT repository_id, term, count(*) AS df FROM post GROUP BY 1, 2),
lexr AS (SELECT c.query_id, p.symbol_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.terms / mean))), 6) AS score
  FROM qterms q JOIN v_cases c ON c.query_id = q.k JOIN post p ON p.repository_id = c.repository_id AND p.term = q.term JOIN dfs d ON d.repository_id = p.repository_id AND d.term = p.term JOIN size_ z ON z.repository_id = p.repository_id GROUP BY 1, 2),
lexh AS (SELECT query_id, symbol_id, 'lexical' AS source, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS rank FROM lexr) x WHERE rank <= 30)"""
_HASH = "SELECT k, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 384 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(term), 10, 1) AS BIGINT) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM {0} GROUP BY 1, 2"
SEM = f"""
qv AS (SELECT k, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS v FROM ({_HASH.format('qterms')}) x WHERE v <> 0), sv AS (SELECT k, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS v FROM ({_HASH.format('sterms')}) x WHERE v <> 0),
semr AS (SELECT c.query_id, s.symbol_id, round(sum(qv.v * sv.v), 6) + 0.0::DOUBLE AS score FROM qv JOIN v_cases c ON c.query_id = qv.k JOIN v_symbols s ON s.repository_id = c.repository_id JOIN sv ON sv.k = s.symbol_id AND sv.bucket = qv.bucket GROUP BY 1, 2),
semh AS (SELECT query_id, symbol_id, 'semantic' AS source, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS rank FROM semr) x WHERE rank <= 30)"""
FUSED = """
hits AS (SELECT * FROM symh UNION ALL SELECT * FROM lexh UNION ALL SELECT * FROM semh),
fused0 AS (SELECT query_id, symbol_id, round(sum(CASE WHEN source = 'symbol' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 9) AS fused_score, list_sort(list_distinct(list(source))) AS reasons FROM hits GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, symbol_id) AS pos FROM fused0) x WHERE pos <= 60)"""
_REASON = "CASE " + " ".join(f"WHEN relationship_type = '{k}' AND outward = {str(o).upper()} THEN '{n}'" for (k, o), n in retrieve.REASONS.items()) + " END"
GRAPH = f"""
ends_ AS (SELECT source_symbol_id AS seed, target_symbol_id AS symbol_id, relationship_type, confidence, TRUE AS outward FROM v_edges WHERE target_symbol_id <> source_symbol_id UNION ALL SELECT target_symbol_id, source_symbol_id, relationship_type, confidence, FALSE FROM v_edges WHERE target_symbol_id <> source_symbol_id),
near AS (SELECT f.query_id, e.symbol_id, round(max(0.7::DOUBLE * f.fused_score * e.confidence), 12) AS contribution, list_sort(list_distinct(list({_REASON}))) AS reasons FROM ends_ e JOIN fused f ON f.symbol_id = e.seed AND f.pos <= 20 GROUP BY 1, 2)"""
ADMIT = """
cand AS (SELECT n.query_id, n.symbol_id, n.contribution, n.reasons, CAST(s.token_count AS BIGINT) AS tokens, row_number() OVER (PARTITION BY n.query_id ORDER BY n.contribution DESC, n.symbol_id) AS i FROM near n JOIN v_symbols s USING (symbol_id) WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = n.query_id AND f.symbol_id = n.symbol_id)),
walk(query_id, i, taken, left_, ok) AS (SELECT query_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(6000 AS BIGINT), FALSE FROM (SELECT DISTINCT query_id FROM cand) x
  UNION ALL SELECT w.query_id, c.i, w.taken + CASE WHEN w.taken < 20 AND c.tokens <= w.left_ THEN 1 ELSE 0 END, w.left_ - CASE WHEN w.taken < 20 AND c.tokens <= w.left_ THEN c.tokens ELSE 0 END, w.taken < 20 AND c.tokens <= w.left_ FROM walk w JOIN cand c ON c.query_id = w.query_id AND c.i = w.i + 1),
grown AS (SELECT f.query_id, f.symbol_id, round(f.fused_score + coalesce(n.contribution, 0), 12) AS fused_score, list_sort(list_distinct(list_concat(f.reasons, coalesce(n.reasons, [])))) AS reasons FROM fused f LEFT JOIN near n USING (query_id, symbol_id)
  UNION ALL SELECT c.query_id, c.symbol_id, c.contribution, c.reasons FROM cand c JOIN walk w ON w.query_id = c.query_id AND w.i = c.i AND w.ok)"""
ALL = f"{LEX}, {SYM}, {SEM}, {FUSED}, {GRAPH}, {ADMIT}"
HAS = lambda *r: "(" + " OR ".join(f"list_contains(reasons, '{x}')" for x in r) + ")"
CATEGORY = f"CASE WHEN {HAS('symbol')} THEN 'target' WHEN {HAS('graph_callee', 'graph_import', 'graph_base')} THEN 'dependencies' WHEN {HAS('graph_caller', 'graph_importer', 'graph_subclass')} THEN 'callers' WHEN {HAS('graph_test', 'graph_tested')} THEN 'tests' WHEN {HAS('graph_child')} THEN 'implementation' WHEN {HAS('semantic')} THEN 'semantic' ELSE 'additional' END"
TIER = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pack.TIERS.items()) + " END"
PACK = f"""
cat AS (SELECT g.query_id, g.symbol_id, g.fused_score, {CATEGORY} AS category, s.file_path, s.start_line AS a, s.end_line AS b, CAST(s.token_count AS BIGINT) AS tokens FROM grown g JOIN v_symbols s USING (symbol_id)),
ord AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {TIER}, fused_score DESC, symbol_id) AS i FROM cat),
fold(query_id, i, running, took, ok) AS (SELECT query_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS STRUCT(f VARCHAR, a BIGINT, b BIGINT)[]), FALSE FROM (SELECT DISTINCT query_id FROM ord) x
  UNION ALL SELECT query_id, i, CASE WHEN fits THEN running + tokens ELSE running END, CASE WHEN fits THEN list_append(took, {{'f': file_path, 'a': a, 'b': b}}) ELSE took END, fits FROM (
    SELECT o.query_id, o.i, p.running, p.took, o.tokens, o.file_path, o.a, o.b, p.running + o.tokens <= 11400 AND len(list_filter(p.took, lambda t: t.f = o.file_path AND t.a <= o.b AND o.a <= t.b)) = 0 AS fits FROM fold p JOIN ord o ON o.query_id = p.query_id AND o.i = p.i + 1) y),
picked AS (SELECT o.query_id, row_number() OVER (PARTITION BY o.query_id ORDER BY o.i) AS pos, o.symbol_id, o.category, o.tokens, p.running AS running_tokens, o.fused_score, o.file_path FROM ord o JOIN fold p ON p.query_id = o.query_id AND p.i = o.i AND p.ok)"""
RESULT = "array_to_string(reasons, ',') AS reasons"


_INDEXES: dict[tuple[str, str], retrieve.SearchIndex] = {}


def _index(spark, d) -> retrieve.SearchIndex:
    """The symbols' index: built by the first query of a session that reads a folder, stored, and read by all later ones."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        _INDEXES[key] = retrieve.build_index(view(spark, d, "symbols"))
    return _INDEXES[key]


def _hits(spark, d):
    q, s, index = view(spark, d, "cases"), view(spark, d, "symbols"), _index(spark, d)
    return retrieve.symbol_hits(q, s).unionByName(retrieve.lexical_hits(q, index.lists)).unionByName(retrieve.semantic_hits(q, index.vectors))


def grown(spark, d):
    s = view(spark, d, "symbols")
    fused = materialize(retrieve.fuse(_hits(spark, d)), "fused")
    return retrieve.expand(fused, view(spark, d, "edges"), s), s


def picked(spark, d):
    g, s = grown(spark, d)
    g = materialize(g, "grown")
    return pack.pack_context(retrieve.load(g, s)), g, s


@query(f"WITH {SYM} SELECT * FROM symh")
def topk_symbol(spark, d):
    return retrieve.symbol_hits(view(spark, d, "cases"), view(spark, d, "symbols"))


@query(f"WITH {LEX} SELECT * FROM lexh")
def topk_lexical(spark, d):
    return retrieve.lexical_hits(view(spark, d, "cases"), _index(spark, d).lists)


@query(f"WITH {LEX}, {SEM} SELECT * FROM semh")
def topk_semantic(spark, d):
    return retrieve.semantic_hits(view(spark, d, "cases"), _index(spark, d).vectors)


@query("""WITH p AS (SELECT q.symbol_id AS query_id, v.symbol_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM v_vectors q JOIN v_vectors v USING (repository_id) WHERE q.symbol_id % 100 = 0)
SELECT query_id, symbol_id, 'semantic' AS source, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS rank FROM p) x WHERE rank <= 30""")
def join_knn(spark, d):
    v = view(spark, d, "vectors")
    return retrieve.vector_hits(v.filter("symbol_id % 100 = 0").select(F.col("symbol_id").alias("query_id"), "repository_id", F.col("embedding").alias("vector")), v)


@query(f"WITH {LEX}, {SYM}, {SEM}, {FUSED} SELECT query_id, symbol_id, fused_score, {RESULT}, pos FROM fused")
def rrf(spark, d):
    return retrieve.fuse(_hits(spark, d)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {LEX}, {SYM}, {SEM}, {FUSED}, {GRAPH} SELECT query_id, symbol_id, contribution, {RESULT} FROM near")
def agg_graph_max(spark, d):
    return retrieve.neighbours(materialize(retrieve.fuse(_hits(spark, d)), "fused"), view(spark, d, "edges")).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH RECURSIVE {ALL} SELECT query_id, symbol_id, fused_score, {RESULT} FROM grown")
def graph_expand(spark, d):
    return grown(spark, d)[0].withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH RECURSIVE {ALL}, {terms_sql('n', "SELECT symbol_id AS k, replace(qualified_name, '.', ' ') AS t FROM v_symbols")}, {terms_sql('d', "SELECT symbol_id AS k, coalesce(docstring, '') AS t FROM v_symbols")},
no AS (SELECT g.query_id, g.symbol_id, count(*) AS c FROM grown g JOIN qterms q ON q.k = g.query_id JOIN nterms n ON n.k = g.symbol_id AND n.term = q.term GROUP BY 1, 2), dc AS (SELECT g.query_id, g.symbol_id, count(*) AS c FROM grown g JOIN qterms q ON q.k = g.query_id JOIN dterms n ON n.k = g.symbol_id AND n.term = q.term GROUP BY 1, 2),
re AS (SELECT g.query_id, g.symbol_id, round(fused_score + (0.05::DOUBLE * coalesce(no.c, 0) + CASE WHEN list_contains(reasons, 'symbol') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + 0.02::DOUBLE * coalesce(dc.c, 0)), 12) AS rerank_score FROM grown g LEFT JOIN no USING (query_id, symbol_id) LEFT JOIN dc USING (query_id, symbol_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, symbol_id) AS rank FROM re""")
def rerank_det(spark, d):
    g, s = grown(spark, d)
    out = retrieve.rerank(g, view(spark, d, "cases"), s).select("query_id", "symbol_id", "rerank_score")
    return retrieve.positions(out, "rerank_score").withColumnRenamed("pos", "rank")


@query(f"WITH RECURSIVE {ALL}, r AS (SELECT query_id, symbol_id, fused_score, reasons, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, symbol_id) AS rank FROM grown) SELECT query_id, symbol_id, fused_score, {RESULT}, rank FROM r WHERE rank <= 10")
def hybrid_search(spark, d):
    return retrieve.hybrid(view(spark, d, "cases"), view(spark, d, "symbols"), view(spark, d, "edges"), index=_index(spark, d), top_n=10).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH RECURSIVE {ALL}, {PACK} SELECT * FROM picked")
def pack_context(spark, d):
    return picked(spark, d)[0]


_ACCOUNT = f"""WITH RECURSIVE {ALL}, {PACK}, files AS (SELECT file_path, sum(token_count) AS token_count FROM v_symbols GROUP BY 1),
f AS (SELECT query_id, count(*) AS candidates_found, sum(tokens) AS candidate_tokens FROM cat GROUP BY 1), t AS (SELECT query_id, count(*) AS candidates_selected, sum(tokens) AS context_tokens FROM picked GROUP BY 1),
b AS (SELECT query_id, sum(token_count) AS baseline_tokens, count(*) AS baseline_files FROM (SELECT DISTINCT query_id, file_path FROM picked) x JOIN files USING (file_path) GROUP BY 1),
a AS (SELECT query_id, CAST(candidates_found AS BIGINT) AS candidates_found, CAST(coalesce(candidates_selected, 0) AS BIGINT) AS candidates_selected, CAST(candidate_tokens AS BIGINT) AS candidate_tokens, CAST(coalesce(context_tokens, 0) AS BIGINT) AS context_tokens, CAST(coalesce(baseline_tokens, 0) AS BIGINT) AS baseline_tokens, CAST(coalesce(baseline_files, 0) AS BIGINT) AS baseline_files FROM f LEFT JOIN t USING (query_id) LEFT JOIN b USING (query_id))"""


@query(f"""{_ACCOUNT} SELECT *, candidate_tokens - context_tokens AS dropped_tokens, CASE WHEN candidate_tokens > 0 THEN round(100.0::DOUBLE * (1.0::DOUBLE - context_tokens / candidate_tokens::DOUBLE), 1) ELSE 0.0::DOUBLE END AS reduction_percent,
baseline_tokens - context_tokens AS saved_vs_files, CASE WHEN baseline_tokens > 0 THEN round(100.0::DOUBLE * (1.0::DOUBLE - context_tokens / baseline_tokens::DOUBLE), 1) ELSE 0.0::DOUBLE END AS reduction_vs_files FROM a""")
def accounting(spark, d):
    p, g, s = picked(spark, d)
    return pack.accounting(retrieve.load(g, s), p, s.groupBy("file_path").agg(F.sum("token_count").alias("token_count")))


@query(f"{_ACCOUNT} SELECT query_id, baseline_tokens, baseline_files FROM a WHERE baseline_files > 0")
def file_baseline(spark, d):
    p, _, s = picked(spark, d)
    took = p.select("query_id", "file_path").distinct()
    files = s.join(took.select("file_path").distinct(), "file_path", "left_semi").groupBy("file_path").agg(F.sum("token_count").alias("t"))
    return took.join(files, "file_path").groupBy("query_id").agg(F.sum("t").alias("baseline_tokens"), F.count("*").alias("baseline_files"))


@query(f"WITH RECURSIVE {ALL}, {PACK} SELECT query_id, category, count(*) AS n, min(pos) AS first_pos, row_number() OVER (PARTITION BY query_id ORDER BY {TIER}) AS section FROM picked GROUP BY query_id, category")
def section_order(spark, d):
    from pyspark.sql import Window

    p = picked(spark, d)[0].groupBy("query_id", "category").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return p.withColumn("section", F.row_number().over(Window.partitionBy("query_id").orderBy(pack.tier(F.col("category")))).cast("long"))


@query()
def render_prompt(spark, d):
    p, _, s = picked(spark, d)
    return pack.render_prompt(view(spark, d, "cases"), p, s)


#: What a case expects: the qualified names of the documents that hold its text.
EXPECTED = "expect AS (SELECT c.query_id, s.qualified_name AS expected FROM v_cases c JOIN v_symbols s ON contains(s.source_code, c.question))"
RANKS = f"""{EXPECTED}, rk AS (SELECT g.query_id, s.qualified_name, row_number() OVER (PARTITION BY g.query_id ORDER BY fused_score DESC, g.symbol_id) AS rank FROM grown g JOIN v_symbols s USING (symbol_id)),
first_ AS (SELECT c.query_id, min(r.rank) AS first_hit FROM v_cases c LEFT JOIN (SELECT rk.query_id, rk.rank FROM rk JOIN expect e ON e.query_id = rk.query_id AND (lower(rk.qualified_name) = lower(e.expected) OR ends_with(lower(rk.qualified_name), '.' || lower(e.expected)) OR ends_with(lower(e.expected), '.' || lower(rk.qualified_name)))) r USING (query_id) GROUP BY 1)"""


def _first_hits(spark, d):
    g, s = grown(spark, d)
    ranked = retrieve.positions(g).join(s.select("symbol_id", "qualified_name"), "symbol_id").withColumnRenamed("pos", "rank")
    cases = view(spark, d, "cases")
    return evaluate.first_hit_rank(cases, ranked, evaluate.expected_by_text(cases, s))


@query(f"WITH RECURSIVE {ALL}, {RANKS} SELECT query_id, first_hit FROM first_")
def first_hit_rank(spark, d):
    return _first_hits(spark, d)


@query(f"""WITH RECURSIVE {ALL}, {RANKS} SELECT count(*) AS n_cases, """ + ", ".join(f"round(avg(CASE WHEN first_hit <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0::DOUBLE / first_hit, 0)), 6) AS mrr FROM first_")
def agg_eval(spark, d):
    return evaluate.recall(_first_hits(spark, d))


@query(f"""WITH RECURSIVE {ALL}, files AS (SELECT file_path, sum(token_count) AS tokens FROM v_symbols GROUP BY 1), o AS (SELECT g.query_id, s.file_path, row_number() OVER (PARTITION BY g.query_id ORDER BY fused_score DESC, g.symbol_id) AS rank FROM grown g JOIN v_symbols s USING (symbol_id)),
m AS (SELECT query_id, file_path, min(rank) AS first_rank FROM o GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS nth FROM m)
SELECT query_id, file_path, nth, CAST(tokens AS BIGINT) AS tokens FROM n JOIN files USING (file_path) WHERE nth <= 3""")
def first_files(spark, d):
    g, s = grown(spark, d)
    ranked = retrieve.positions(g).withColumnRenamed("pos", "rank").join(s.select("symbol_id", "file_path"), "symbol_id")
    return evaluate.first_files(ranked, s.groupBy("file_path").agg(F.sum("token_count").alias("tokens")), 3)


@query(f"""{_ACCOUNT}, w AS (SELECT sum(token_count)::DOUBLE AS whole FROM v_symbols) SELECT count(*) AS n_cases, round(any_value(whole), 6) AS whole_tokens, round(avg(context_tokens), 6) AS avg_context_tokens,
round(100.0::DOUBLE * (1.0::DOUBLE - avg(context_tokens) / any_value(whole)), 1) AS reduction_percent FROM a, w""")
def agg_baseline(spark, d):
    p, g, s = picked(spark, d)
    rows = pack.accounting(retrieve.load(g, s), p, s.groupBy("file_path").agg(F.sum("token_count").alias("token_count")))
    return evaluate.against_whole(rows, s)


@query("""WITH r AS (SELECT repository_id, list_sort(list(latency_ms)) AS xs FROM v_queries GROUP BY 1)
SELECT repository_id, CAST(len(xs) AS BIGINT) AS n, xs[1 + least(len(xs) - 1, CAST(floor(0.5::DOUBLE * len(xs)) AS BIGINT))] AS p50_ms, xs[1 + least(len(xs) - 1, CAST(floor(0.95::DOUBLE * len(xs)) AS BIGINT))] AS p95_ms, round(list_avg(xs), 6) AS mean_ms FROM r""")
def agg_percentile(spark, d):
    return evaluate.latency(view(spark, d, "queries"), "latency_ms", "repository_id")


REASON_SQL = "CASE " + " ".join(f"WHEN t = '{k}' AND o = {str(o).upper()} THEN '{n}'" for (k, o), n in retrieve.REASONS.items()) + " END"


@query(f"""WITH b AS (SELECT source_symbol_id AS seed, target_symbol_id AS symbol_id, relationship_type AS t, TRUE AS o, confidence FROM v_edges UNION ALL SELECT target_symbol_id, source_symbol_id, relationship_type, FALSE, confidence FROM v_edges)
SELECT seed, symbol_id, {REASON_SQL} AS reason, confidence FROM b WHERE seed IS NOT NULL AND symbol_id IS NOT NULL AND seed <> symbol_id AND {REASON_SQL} IS NOT NULL""")
def join_graph(spark, d):
    return retrieve.touching(view(spark, d, "edges")).select("seed", "symbol_id", "reason", "confidence")


@query(f"WITH {LEX}, {SYM}, {SEM} SELECT query_id, symbol_id, source, rank FROM symh UNION ALL SELECT query_id, symbol_id, source, rank FROM lexh UNION ALL SELECT query_id, symbol_id, source, rank FROM semh")
def rank_source(spark, d):
    return _hits(spark, d).select("query_id", "symbol_id", "source", "rank")


@query(f"WITH {LEX}, {SYM}, {SEM}, {FUSED} SELECT query_id, symbol_id FROM fused WHERE pos <= 20")
def seeds(spark, d):
    return retrieve.fuse(_hits(spark, d)).filter(F.col("pos") <= retrieve.SEEDS).select("query_id", "symbol_id")


@query(f"WITH {LEX}, {SYM}, {SEM}, {FUSED} SELECT query_id, count(*) AS n, max(pos) AS last FROM fused GROUP BY 1")
def cap_candidates(spark, d):
    return retrieve.fuse(_hits(spark, d)).groupBy("query_id").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query(f"WITH RECURSIVE {ALL}, {PACK} SELECT query_id, symbol_id, category FROM cat")
def categorize(spark, d):
    g, s = grown(spark, d)
    return retrieve.load(g, s).select("query_id", "symbol_id", pack.categorize(F.col("reasons"), F.col("changed")).alias("category"))


@query(f"WITH RECURSIVE {ALL}, {PACK} SELECT query_id, CAST(sum(tokens) AS BIGINT) AS candidate_tokens FROM cat GROUP BY 1")
def agg_candidate_tokens(spark, d):
    g, s = grown(spark, d)
    return retrieve.load(g, s).groupBy("query_id").agg(F.sum("token_count").alias("candidate_tokens"))


@query(f"WITH RECURSIVE {ALL}, {PACK} SELECT g.query_id, g.symbol_id, row_number() OVER (PARTITION BY g.query_id ORDER BY g.fused_score DESC, g.symbol_id) AS rank, g.fused_score AS score, {RESULT}, p.symbol_id IS NOT NULL AS selected FROM grown g LEFT JOIN picked p ON p.query_id = g.query_id AND p.symbol_id = g.symbol_id")
def sink_query(spark, d):
    from sparkloom.operators import telemetry

    p, g, _ = picked(spark, d)
    return telemetry.query_results(retrieve.positions(g).withColumnRenamed("pos", "rank"), p).withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH t AS (SELECT item_id, trim(text) AS q, regexp_matches(trim(text), '^[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)*$') AS like_, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.]*'), lambda x: rtrim(x, '.')) AS ts FROM benchmark),
u AS (SELECT item_id, list_concat(CASE WHEN like_ THEN [q] ELSE [] END, list_filter(ts, lambda x: x <> q AND (contains(x, '.') OR contains(x, '_') OR (length(x) > 3 AND regexp_matches(x, '^[A-Z]'))))) AS xs FROM t),
e AS (SELECT item_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS p FROM u), f AS (SELECT item_id, lower(x) AS k, min(p) AS p, arg_min(x, p) AS x FROM e GROUP BY 1, 2)
SELECT item_id, string_agg(x, ' ' ORDER BY p) AS tokens FROM f GROUP BY 1""")
def candidate_tokens(spark, d):
    from sparkloom.functions import text as X
    from sparkloom.tables import table

    t = table(spark, d, "benchmark").select("item_id", X.candidate_tokens(F.col("text")).alias("xs"))
    return t.filter(F.size("xs") > 0).select("item_id", F.array_join("xs", " ").alias("tokens"))


@query(f"WITH {terms_sql('q', 'SELECT item_id AS k, text AS t FROM benchmark')} SELECT k AS item_id, term FROM qterms")
def build_tsquery(spark, d):
    from sparkloom.functions import text as X
    from sparkloom.tables import table

    return table(spark, d, "benchmark").select("item_id", F.explode(X.tsquery_terms(F.col("text"))).alias("term"))


@query(f"WITH {QTERMS}, {STERMS} SELECT DISTINCT c.query_id, s.symbol_id FROM qterms q JOIN v_cases c ON c.query_id = q.k JOIN sterms t ON t.term = q.term JOIN v_symbols s ON s.symbol_id = t.k AND s.repository_id = c.repository_id")
def fts_match(spark, d):
    from sparkloom.functions import text as X

    terms = view(spark, d, "cases").select("query_id", "repository_id", F.explode(X.tsquery_terms(F.col("question"))).alias("term"))
    return retrieve.postings(_index(spark, d).lists).join(terms, ["repository_id", "term"]).select("query_id", "symbol_id").distinct()


@query("SELECT a.vec_id, round(1.0::DOUBLE - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_distance(spark, d):
    from sparkloom.functions import vectors as V
    from sparkloom.tables import table

    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(F.lit(1.0) - V.cosine(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query()
def fix_context(spark, d):
    from sparkloom.operators import findings

    return findings.fix_context(view(spark, d, "findings"), view(spark, d, "symbols"), view(spark, d, "edges"))
