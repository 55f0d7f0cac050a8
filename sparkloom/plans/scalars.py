"""Queries for the scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import paths, text, vectors
from sparkloom.operators import compress, rewrite
from sparkloom.plans.registry import query
from sparkloom.plans.views import view
from sparkloom.tables import table

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
CAMEL = "list_transform(regexp_extract_all(regexp_replace({0}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+'), lambda y: lower(y))"
#: Distinct in order of first place: DuckDB's list_distinct doesn't keep the order.
ORDERED = "list_filter({0}, lambda v, i: list_position({0}, v) = i)"
TOKENS = "CASE WHEN {0} = '' THEN 0 ELSE CAST(greatest(1, round_even((length({0}) / CAST(4 AS DOUBLE) + len(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')) * CAST(1.3 AS DOUBLE)) / CAST(2 AS DOUBLE), 0)) AS BIGINT) END"
#: Terms in order, by exploding: (key, pos, term) from identifiers.
TERMS = f"""
idents AS (SELECT k, unnest(ids) AS ident, generate_subscripts(ids, 1) AS pos FROM src),
parts AS (SELECT k, pos, unnest(list_concat([ident], {CAMEL.format("ident")})) AS term, generate_subscripts(list_concat([ident], {CAMEL.format("ident")}), 1) AS sub FROM idents),
firsts AS (SELECT k, lower(term) AS key, arg_min(term, pos * 100000 + sub) AS term, min(pos * 100000 + sub) AS spot FROM parts GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY spot) AS r FROM firsts),
terms AS (SELECT k, key, term, spot, r FROM ranked WHERE r <= 300)"""
RAW = "regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*')"


@query(f"SELECT doc_id, {TOKENS.format('text')} AS tokens FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query(f"""WITH i AS (SELECT doc_id, list_filter({RAW.format('text')}, lambda x: NOT list_contains({_LIST(text.STOP)}, lower(x))) AS xs FROM documents)
SELECT doc_id, array_to_string(({ORDERED.format('xs')})[1:200], ' ') AS identifiers FROM i""")
def extract_identifiers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.extract_identifiers(F.col("text")), " ").alias("identifiers"))


@query(f"""WITH src AS (SELECT DISTINCT p_name AS k, [replace(p_name, ' ', '_')] AS ids FROM part UNION SELECT 'HTTPServerError_v2_x', ['HTTPServerError_v2_x']), {TERMS}
SELECT k AS name, string_agg(term, ' ' ORDER BY spot) AS terms FROM terms GROUP BY k""")
def split_identifier(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("ident")).distinct()
    names = names.unionByName(spark.sql("SELECT 'HTTPServerError_v2_x' AS name, 'HTTPServerError_v2_x' AS ident"))
    return names.select("name", F.array_join(text.split_identifier(F.col("ident")), " ").alias("terms"))


@query(f"""WITH src AS (SELECT doc_id AS k, {RAW.format('text')} AS ids FROM documents), {TERMS}
SELECT k AS doc_id, string_agg(term, ' ' ORDER BY spot) AS terms, count(*) AS n_terms FROM terms GROUP BY k""")
def build_search_terms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.search_terms(F.array_distinct(text.raw_identifiers(F.col("text")))).alias("t"))
    return docs.filter(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("terms"), F.size("t").cast("long").alias("n_terms"))


@query(f"""WITH src AS (SELECT item_id AS k, {RAW.format('text')} AS ids FROM benchmark), {TERMS}
SELECT k AS item_id, string_agg(key, ' | ' ORDER BY spot) AS tsquery FROM terms GROUP BY k""")
def expand_query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.tsquery_terms(F.col("text")), " | ").alias("tsquery"))


@query(f"""WITH src AS (SELECT symbol_id AS k, repository_id, {RAW.format('source_code')} AS ids FROM v_symbols), {TERMS}
SELECT s.repository_id, t.key AS term, count(*) AS symbols FROM terms t JOIN v_symbols s ON s.symbol_id = t.k GROUP BY 1, 2""")
def postings(spark, d):
    rows = view(spark, d, "symbols").select("repository_id", F.explode(text.query_keys(F.col("source_code"))).alias("term"))
    return rows.groupBy("repository_id", "term").agg(F.count("*").alias("symbols"))


@query(f"""WITH src AS (SELECT item_id AS k, {RAW.format('text')} AS ids FROM benchmark), {TERMS},
h AS (SELECT k, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 384 AS bucket, CASE WHEN CAST('0x' || substr(md5(key), 10, 1) AS BIGINT) % 2 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS s FROM terms),
v AS (SELECT k, bucket, sum(s) AS value FROM h GROUP BY 1, 2)
SELECT k AS item_id, bucket, round(value / sqrt(sum(value * value) OVER (PARTITION BY k)), 6) AS value FROM v WHERE value <> 0""")
def hash_embed(spark, d):
    x = vectors.hash_embed(table(spark, d, "benchmark"), text.query_keys(F.col("text")), "item_id")
    return x.select("item_id", "bucket", F.round("value", 6).alias("value"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


_EXT = "CASE WHEN contains(path, '.') THEN lower(regexp_extract(path, '\\.([^.]*)$', 1)) END"
_LANG = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{lang}'" for e, lang in paths.LANGUAGES.items()) + " END"
_DIRS = f"list_has_any(string_split(path, '/')[:-2], {_LIST(paths.IGNORED)})"
_SECRET = f"regexp_matches(lower(path), '{paths.SECRET_FILE}')"


@query(f"WITH f AS (SELECT file_id, path, {_EXT} AS ext FROM v_files) SELECT file_id, path, {_LANG} AS language, coalesce(list_contains({_LIST(paths.BINARY)}, ext), FALSE) AS is_binary FROM f")
def ext_lookup(spark, d):
    p = F.col("path")
    return view(spark, d, "files").select("file_id", "path", paths.language_of(p).alias("language"), paths.is_binary(p).alias("is_binary"))


@query(f"SELECT file_id, {_DIRS} AS ignored, {_DIRS} OR list_contains(string_split(path, '/')[:-2], 'core') OR contains(path, '/core/') AS ignored_extra FROM v_files")
def in_ignored_dir(spark, d):
    p = F.col("path")
    return view(spark, d, "files").select("file_id", paths.in_ignored_dir(p).alias("ignored"), paths.in_ignored_dir(p, ["/core/"]).alias("ignored_extra"))


@query(f"WITH f AS (SELECT *, {_EXT} AS ext FROM v_files) SELECT file_id, path, {_LANG} AS language FROM f WHERE NOT {_DIRS} AND NOT {_SECRET} AND NOT coalesce(list_contains({_LIST(paths.BINARY)}, ext), FALSE) AND {_LANG} IS NOT NULL")
def filter_indexable(spark, d):
    return view(spark, d, "files").filter(paths.should_index(F.col("path"))).select("file_id", "path", paths.language_of(F.col("path")).alias("language"))


@query(f"SELECT file_id, path, {_SECRET} AS is_secret FROM v_files")
def secret_file(spark, d):
    return view(spark, d, "files").select("file_id", "path", paths.is_secret_file(F.col("path")).alias("is_secret"))


def _redact_sql(col: str) -> str:
    steps, cur = [], col
    for label, p in paths.SECRETS.items():
        q = p.replace("'", "''")
        steps.append(f"len(regexp_extract_all({cur}, '{q}'))")
        cur = f"regexp_replace({cur}, '{q}', '{paths.redacted_as(label, chr(92))}', 'g')"
    return f"{cur} AS redacted, CAST({' + '.join(steps)} AS BIGINT) AS n_secrets"


@query(f"SELECT doc_id, {_redact_sql('text')} FROM documents")
def redact(spark, d):
    out, n, _ = paths.redact(F.col("text"))
    return table(spark, d, "documents").select("doc_id", out.alias("redacted"), n.alias("n_secrets"))


@query("""WITH f AS (SELECT file_id, list_filter(string_split(regexp_replace(path, '\\.[^.]*$', ''), '/'), lambda x: x <> '') AS xs FROM v_files),
g AS (SELECT file_id, CASE WHEN len(xs) > 0 AND xs[-1] = '__init__' THEN xs[:-2] ELSE xs END AS xs FROM f)
SELECT file_id, CASE WHEN len(xs) = 0 THEN 'root' ELSE array_to_string(xs, '.') END AS module FROM g""")
def module_name(spark, d):
    return view(spark, d, "files").select("file_id", paths.module_name(F.col("path")).alias("module"))


_COLOURED = "concat(chr(27), '[31m', substr(text, 1, 200), chr(27), '[0m', chr(10), chr(10), chr(10), substr(text, 201))"
_SQUEEZE = "regexp_replace({0}, '\\n[ \\t]*\\n[ \\t]*\\n(?:[ \\t]*\\n)*', chr(10) || chr(10), 'g')"
_ANSI = "regexp_replace({0}, '\\x1b\\[[0-9;?]*[A-Za-z]|\\x1b\\][^\\x07]*\\x07', '', 'g')"


@query(f"SELECT doc_id, {_ANSI.format(_COLOURED)} AS clean FROM documents")
def strip_ansi(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_ansi(F.expr(_COLOURED)).alias("clean"))


@query(f"SELECT doc_id, {_SQUEEZE.format(_COLOURED)} AS squeezed FROM documents")
def squeeze_blank(spark, d):
    return table(spark, d, "documents").select("doc_id", text.squeeze_blank(F.expr(_COLOURED)).alias("squeezed"))


_REPEATED = "concat(repeat(concat(lang, chr(10)), CAST(doc_id % 6 AS INT)), text)"


@query(f"""WITH l AS (SELECT doc_id, string_split({_REPEATED}, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
b AS (SELECT *, CASE WHEN line IS NOT DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AND pos > 1 THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM b),
r AS (SELECT doc_id, grp, any_value(line) AS line, count(*) AS n FROM g GROUP BY 1, 2),
o AS (SELECT doc_id, grp, CASE WHEN n >= 3 AND regexp_matches(line, '[^ \t\r]') THEN line || chr(10) || '[previous line repeated ' || (n - 1) || ' more times]' ELSE rtrim(repeat(line || chr(10), n), '') END AS chunk, n, line FROM r)
SELECT doc_id, string_agg(CASE WHEN n >= 3 AND regexp_matches(line, '[^ \t\r]') THEN chunk ELSE left(chunk, length(chunk) - 1) END, chr(10) ORDER BY grp) AS deduped FROM o GROUP BY doc_id""")
def dedupe_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.dedupe_lines(F.expr(_REPEATED)).alias("deduped"))


@query("WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS preview FROM f")
def preview(spark, d):
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT query_id, CASE WHEN baseline_tokens > 0 THEN round(100.0::DOUBLE * (1.0::DOUBLE - context_tokens / baseline_tokens::DOUBLE), 1) ELSE 0.0::DOUBLE END AS saved FROM v_queries")
def pct_guard(spark, d):
    return view(spark, d, "queries").select("query_id", text.percent_saved(F.col("context_tokens"), F.col("baseline_tokens")).alias("saved"))


@query("""SELECT symbol_id, lower(qualified_name) = lower(symbol_name) OR ends_with(lower(qualified_name), '.' || lower(symbol_name)) OR ends_with(lower(symbol_name), '.' || lower(qualified_name)) AS matches FROM v_symbols""")
def suffix_match(spark, d):
    return view(spark, d, "symbols").select("symbol_id", text.suffix_match(F.col("qualified_name"), F.col("symbol_name")).alias("matches"))


@query("SELECT symbol_id, starts_with(lower(symbol_name), 'test') OR contains(file_path, '/tests/') OR starts_with(file_path, 'tests/') OR starts_with(regexp_extract(file_path, '[^/]*$'), 'test_') AS is_test FROM v_symbols")
def is_test_symbol(spark, d):
    return view(spark, d, "symbols").select("symbol_id", paths.is_test_symbol(F.col("symbol_name"), F.col("file_path")).alias("is_test"))


@query("""SELECT symbol_id, concat_ws(chr(10), 'Repository: ' || CAST(repository_id AS VARCHAR), 'File: ' || file_path, 'Symbol: ' || qualified_name, 'Type: ' || symbol_type, 'Signature: ' || nullif(signature, ''), 'Documentation: ' || nullif(docstring, ''), 'Code:' || chr(10) || substr(source_code, 1, 4000)) AS input FROM v_symbols""")
def embedding_input(spark, d):
    c = F.col
    return view(spark, d, "symbols").select("symbol_id", text.embedding_input(c("repository_id").cast("string"), c("file_path"), c("qualified_name"), c("symbol_type"), c("signature"), c("docstring"), c("source_code")).alias("input"))


@query("SELECT a.symbol_id AS a, b.symbol_id AS b FROM v_symbols a JOIN v_symbols b ON a.file_path = b.file_path AND a.symbol_id < b.symbol_id AND a.start_line <= b.end_line AND b.start_line <= a.end_line")
def span_overlap(spark, d):
    from sparkloom.operators.pack import overlapping_pairs

    return overlapping_pairs(view(spark, d, "symbols"))


@query("SELECT DISTINCT left(sha256(html), 16) AS key, html AS body FROM pages")
def blob_store(spark, d):
    return compress.blobs(table(spark, d, "pages"), "html")


@query("""SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def tool_result_chars(spark, d):
    return rewrite.bodies_of(table(spark, d, "conversations")).select("conv_id", rewrite.tool_result_chars(F.col("body")).alias("chars"))


@query(compress.compress_sql("text", 4000, 1500, "documents"))
def compress_text(spark, d):
    return table(spark, d, "documents").select("doc_id", compress.compress_text(F.col("text"), F.lit(4000), F.lit(1500)).alias("compressed"))


# A log: colours, repeated and blank lines, an encoded run, lines that tell of errors.
_LOG = "concat(chr(27), '[1m', text, chr(27), '[0m', chr(10), repeat(concat('same ', lang, chr(10)), CAST(doc_id % 7 AS INT)), chr(10), chr(10), chr(10), repeat('QUJD', CAST(200 * (doc_id % 5) AS INT)), '=', chr(10), 'Error in ', source, chr(10), text, chr(10), 'a warning', chr(10), text)"


@query(compress.compress_sql(_LOG, 900, 500, "documents"))
def compress_logs(spark, d):
    return table(spark, d, "documents").select("doc_id", compress.compress_text(F.expr(_LOG), F.lit(900), F.lit(500)).alias("compressed"))


@query()
def shrink_json(spark, d):
    bodies = rewrite.bodies_of(table(spark, d, "conversations"))
    return bodies.select("conv_id", compress.compress_text(F.col("body"), F.lit(1000), F.lit(500)).alias("compressed"))


@query()
def rewrite_bodies(spark, d):
    bodies = rewrite.bodies_of(table(spark, d, "conversations"))
    return rewrite.rewrite(bodies, "body", rewrite.Rewrites(routes={"large-a": "small-c"}, max_tokens=1000, thinking_budget=2000, terse=True, compress=(2000, 800), auto_cache=True))
