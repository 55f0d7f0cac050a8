"""The thin queries over whole tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, langid, licenses, line_dedup, packing, secrets, simhash, substring_dedup, topk, url_filter
from sparkloom.tables import table

URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, count="n_dropped").select("doc_id", "text", "n_dropped")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
pages AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY 1),
lines AS (SELECT r, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
counts AS (SELECT source, line, count(DISTINCT r) AS n FROM lines WHERE source IS NOT NULL AND regexp_matches(line, '[^ \t\r]') GROUP BY 1, 2),
bad AS (SELECT c.source, c.line FROM counts c JOIN pages p USING (source) WHERE n >= 2 AND n > 0.1 * pages),
marked AS (SELECT l.r, l.line, l.pos, b.line IS NOT NULL AS bad FROM lines l LEFT JOIN bad b ON b.source = l.source AND b.line = l.line),
kept AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS text, count(*) FILTER (bad) AS n_dropped FROM marked GROUP BY r)
SELECT d.doc_id, kept.text AS text, coalesce(n_dropped, 0) AS n_dropped FROM d LEFT JOIN kept USING (r)"""


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


def _rules_sql(host: str, path: str) -> tuple[str, str]:
    """CASE branches for the rule and its verdict, longest first."""
    fits = []
    for says, name in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[0] != "allow", r[1])):
        own, _, rest = name.partition("/")
        fits.append((f"({host} = '{own}' OR ends_with({host}, '.{own}')) AND starts_with({path}, '/{rest}')", name, says))
    return tuple("CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END" for i in (1, 2))


def _place_sql(url: str, part: str) -> str:
    rest = f"CASE WHEN position('://' IN {url}) > 0 THEN substr({url}, position('://' IN {url}) + 3) ELSE '' END"
    host = f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '')"
    tail = f"regexp_extract({rest}, '^[^/?#]*([^#]*)', 1)"
    return {
        "host": host,
        "path": f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')",
        "node": f"CASE WHEN position('://' IN {url}) > 0 THEN {host} || CASE WHEN {tail} = '' THEN '/' ELSE {tail} END END",
    }[part]


def _op2_sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    target = lambda tag, attr: f"regexp_extract(regexp_extract(html, '{quoted(tag)}'), '{quoted(attr)}', 1)"
    whole = "CASE WHEN position('://' IN t) > 0 THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t END"
    said = _rules_sql("nhost", "npath")[1]
    rule, verdict = _rules_sql("host", "path")
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, {_place_sql("url", "host")} AS host, {_place_sql("url", "path")} AS path, {_place_sql("url", "node")} AS node FROM pages),
links AS (SELECT node AS a, host, {target(url_filter.CANONICAL, url_filter.HREF)} AS t FROM p UNION ALL SELECT node, host, {target(url_filter.REFRESH, url_filter.TARGET)} FROM p),
tos AS (SELECT a, {whole} AS u FROM links),
e AS (SELECT DISTINCT a, {_place_sql("u", "node")} AS b FROM tos WHERE u IS NOT NULL AND a IS NOT NULL),
both_ AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
nodes AS (SELECT a, b, {_place_sql("('x://' || b)", "host")} AS nhost, {_place_sql("('x://' || b)", "path")} AS npath FROM reach),
says AS (SELECT a AS node, max(CASE WHEN {said} = 'allow' THEN 1 ELSE 0 END) AS allowed, max(CASE WHEN {said} = 'block' THEN 1 ELSE 0 END) AS blocked FROM nodes GROUP BY a),
judged AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS own, coalesce(s.blocked = 1 AND s.allowed = 0, FALSE) AS hit FROM p LEFT JOIN says s USING (node))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN hit THEN 'block' END, 'allow') AS verdict, own IS NULL AND hit AS propagated FROM judged"""


def op3_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10"""


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def _op5_sql() -> str:
    known = ", ".join(f"('{d}', '{n}')" for d, n in licenses.digests())
    return f"""
WITH known(digest, license) AS (VALUES {known}), d AS (SELECT doc_id, md5({licenses.canonical_sql()}) AS digest FROM documents)
SELECT doc_id, digest, license FROM d LEFT JOIN known USING (digest)"""


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, folder, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_topk, op4_best_fit_packing, op5_license_scan, op6_decontamination, op7_simhash, op8_substring_dedup, op9_language_id, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_url_filter": _op2_sql(), "op3_topk": OP3_SQL, "op5_license_scan": _op5_sql(), "op10_secret_scan": secrets.scan_sql()}
