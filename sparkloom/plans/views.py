"""The reference shapes (symbols, edges, requests, queries, cases, findings, files) as views over the data tables.

Each is SQL that Spark and other engines read alike, with the tables' names in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sparkloom.tables import table

VIEWS: dict[str, str] = {
    "symbols": """
SELECT doc_id AS symbol_id, CAST(substr(source, 4, 9) AS BIGINT) AS repository_id, lang AS language, concat(source, '/', lang, CASE WHEN doc_id % 9 = 0 THEN '/tests/' ELSE '/' END, 'f', CAST(doc_id % 5 AS STRING), '.py') AS file_path,
       CASE WHEN doc_id % 11 = 0 THEN concat('test_', regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*', 0)) ELSE regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*', 0) END AS symbol_name,
       concat(source, '.', lang, '.', regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*', 0)) AS qualified_name,
       CASE WHEN doc_id % 10 = 0 THEN 'module' WHEN doc_id % 10 <= 2 THEN 'class' WHEN doc_id % 10 <= 5 THEN 'function' ELSE 'method' END AS symbol_type,
       CAST(doc_id % 97 AS BIGINT) + 1 AS start_line, CAST(doc_id % 97 + doc_id % 5 AS BIGINT) + 1 AS end_line,
       CASE WHEN doc_id % 10 > 0 THEN doc_id - doc_id % 10 END AS parent_symbol_id, text AS source_code,
       CASE WHEN doc_id % 10 BETWEEN 3 AND 5 THEN concat('def ', regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*', 0), '()') END AS signature,
       CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 60) END AS docstring, CAST(floor(length(text) / 5) AS BIGINT) + 1 AS token_count
FROM {documents}""",
    "vectors": "SELECT vec_id AS symbol_id, vec_id % 5 AS repository_id, embedding FROM {embeddings}",
    "edges": """
SELECT source_symbol_id, target_symbol_id, relationship_type, round(max(confidence), 6) AS confidence FROM (
  SELECT CAST(l_suppkey AS BIGINT) AS source_symbol_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_partkey % 400 AS BIGINT) END AS target_symbol_id,
         CASE WHEN l_linenumber = 1 THEN 'CONTAINS' WHEN l_linenumber = 2 THEN 'TESTS' WHEN l_returnflag = 'A' THEN 'CALLS' WHEN l_returnflag = 'N' THEN 'IMPORTS' ELSE 'INHERITS' END AS relationship_type, CAST(1.0 AS DOUBLE) - l_discount AS confidence
  FROM {lineitem}) e GROUP BY source_symbol_id, target_symbol_id, relationship_type""",
    "raw_edges": """
SELECT l_orderkey AS edge_id, CAST(l_suppkey AS BIGINT) AS source_symbol_id, CASE WHEN l_returnflag = 'A' THEN 'CALLS' WHEN l_returnflag = 'N' THEN 'IMPORTS' ELSE 'INHERITS' END AS relationship_type,
       CASE WHEN l_linenumber = 1 THEN 'self' WHEN l_linenumber = 2 THEN 'attr' ELSE 'bare' END AS via,
       CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN CAST(0.9 AS DOUBLE) WHEN l_returnflag = 'A' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence, CAST(l_partkey % 300 AS BIGINT) AS target_doc, l_linenumber AS line_no
FROM {lineitem}""",
    "requests": """
SELECT conv_id * 1000 + turn AS request_id, conv_id AS query_id, conv_id, turn, CAST(floor(length(text) / 4) AS BIGINT) AS output_tokens,
       CAST(coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) * 4 AS BIGINT) AS input_tokens,
       CASE WHEN conv_id % 6 = 5 THEN NULL ELSE CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS BIGINT) END AS cached_input_tokens,
       CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(length(text) % 300 AS BIGINT) END AS cache_creation_input_tokens,
       CAST(length(text) * 2 AS BIGINT) AS tool_result_chars, CAST(9000 + conv_id % 7 * 100 AS BIGINT) AS tool_schema_chars, conv_id % 2 = 0 AS token_lean_active, conv_id % 3 = 0 AS cap_applied, conv_id % 7 = 0 AS terse_applied,
       CAST(CASE WHEN conv_id % 4 = 0 THEN length(text) % 900 ELSE 0 END AS BIGINT) AS compression_chars_saved,
       CASE conv_id % 4 WHEN 0 THEN 'large-a-20250101' WHEN 1 THEN 'medium-b' WHEN 2 THEN 'small-c' ELSE 'unlisted-x' END AS model,
       CASE WHEN conv_id % 5 = 0 THEN 'large-a' WHEN conv_id % 5 = 1 THEN 'medium-b' END AS requested_model, conv_id % 11 <> 0 AS success, role
FROM {conversations}""",
    "queries": """
SELECT event_id AS query_id, user_id % 20 AS repository_id, event_type AS mode, concat(event_type, ' ', CAST(user_id AS STRING)) AS query_text, CAST(floor(value) AS BIGINT) % 40 AS candidates_found, CAST(floor(value) AS BIGINT) % 17 AS candidates_selected,
       CAST(floor(value * 13) AS BIGINT) % 5000 AS candidate_tokens, CAST(floor(value * 7) AS BIGINT) % 1500 AS context_tokens, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value * 17) AS BIGINT) % 8000 END AS baseline_tokens, event_id % 9 AS baseline_files, CAST(event_id % 1000 AS DOUBLE) / 8 AS latency_ms
FROM {events}""",
    "cases": "SELECT item_id AS query_id, item_id % 20 AS repository_id, text AS question FROM {benchmark}",
    "findings": """
SELECT l.doc_id AS finding_id, concat(d.source, '/', d.lang, CASE WHEN d.doc_id % 9 = 0 THEN '/tests/' ELSE '/' END, 'f', CAST(d.doc_id % 5 AS STRING), '.py') AS file_path, CAST(l.doc_id * 7 % 100 AS BIGINT) AS line
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    "files": """
SELECT page_id AS file_id, concat(regexp_extract(url, '://[^/]*/([^?#]*)', 1), CASE page_id % 7 WHEN 0 THEN '/node_modules' WHEN 1 THEN '/src/core' WHEN 2 THEN '/tests' ELSE '' END, '/', 'm', CAST(page_id % 13 AS STRING),
       CASE page_id % 11 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.min.js' WHEN 3 THEN '.PNG' WHEN 4 THEN '/.env' WHEN 5 THEN '.ts' WHEN 6 THEN '.go' WHEN 7 THEN '/__init__.py' WHEN 8 THEN '.tar.gz' WHEN 9 THEN '' ELSE '.rs' END) AS path, html FROM {pages}""",
    "previous": "SELECT doc_id, source AS repo, concat(lang, '/', CAST(doc_id AS STRING)) AS path, text AS body FROM {documents} WHERE doc_id % 10 <> 3",
    "current": "SELECT doc_id, source AS repo, concat(lang, '/', CAST(doc_id AS STRING)) AS path, CASE WHEN doc_id % 10 = 5 THEN concat(text, ' changed') ELSE text END AS body FROM {documents} WHERE doc_id % 10 <> 7",
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, folder, t) for t in re.findall(r"\{(\w+)\}", sql)})


def with_views(sql: str) -> str:
    """A query with the views that it names as v_<name> put before it, for an engine where tables stand under their names."""
    used = [n for n in VIEWS if re.search(rf"\bv_{n}\b", sql)]
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql)
    recursive = bool(re.match(r"\s*WITH\s+RECURSIVE", sql))
    heads = [f"v_{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in used]
    if not heads:
        return sql
    joint = ", " if body != sql else " "
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(heads)}{joint}{body}"
