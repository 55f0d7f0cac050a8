"""Queries for scanning, parsing, edges, incremental work, findings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.parse import parse_files
from sparkloom.operators import compress, findings, index, rewrite
from sparkloom.plans.registry import query
from sparkloom.plans.retrieval import _HASH, STERMS
from sparkloom.plans.views import view
from sparkloom.sources import files, reports
from sparkloom.tables import table

IS_TEST = "(starts_with(lower({0}.symbol_name), 'test') OR contains({0}.file_path, '/tests/') OR starts_with({0}.file_path, 'tests/') OR starts_with(regexp_extract({0}.file_path, '[^/]*$'), 'test_'))"
TARGET = "CASE e.line_no WHEN 1 THEN t.symbol_name WHEN 2 THEN upper(t.qualified_name) WHEN 3 THEN concat('x.', t.symbol_name) ELSE 'nowhere.at_all' END"


@query(f"""WITH raw AS (SELECT e.relationship_type, e.via, e.confidence, s.repository_id, s.symbol_id AS source_symbol_id, s.parent_symbol_id AS sp, {IS_TEST.format('s')} AS is_test, lower({TARGET}) AS q, regexp_extract(lower({TARGET}), '[^.]*$') AS n
  FROM v_raw_edges e JOIN v_symbols s ON s.symbol_id = e.source_symbol_id JOIN v_symbols t ON t.symbol_id = e.target_doc),
q AS (SELECT repository_id, lower(qualified_name) AS k, max(symbol_id) AS id FROM v_symbols GROUP BY 1, 2), p AS (SELECT repository_id, lower(symbol_name) AS k, parent_symbol_id AS p, max(symbol_id) AS id FROM v_symbols GROUP BY 1, 2, 3 HAVING count(*) = 1),
n AS (SELECT repository_id, lower(symbol_name) AS k, max(symbol_id) AS id FROM v_symbols GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT raw.*, coalesce(q.id, CASE WHEN via = 'self' THEN p.id END, n.id) AS target_symbol_id FROM raw LEFT JOIN q ON q.repository_id = raw.repository_id AND q.k = raw.q LEFT JOIN p ON p.repository_id = raw.repository_id AND p.k = raw.n AND p.p IS NOT DISTINCT FROM raw.sp LEFT JOIN n ON n.repository_id = raw.repository_id AND n.k = raw.n),
ok AS (SELECT * FROM r WHERE target_symbol_id IS NOT NULL AND target_symbol_id <> source_symbol_id),
a AS (SELECT repository_id, source_symbol_id, target_symbol_id, relationship_type, confidence FROM ok UNION ALL SELECT repository_id, source_symbol_id, target_symbol_id, 'TESTS', least(confidence, 0.8::DOUBLE) FROM ok WHERE relationship_type = 'CALLS' AND is_test
  UNION ALL SELECT repository_id, parent_symbol_id, symbol_id, 'CONTAINS', 1.0::DOUBLE FROM v_symbols WHERE parent_symbol_id IS NOT NULL)
SELECT repository_id, source_symbol_id, target_symbol_id, relationship_type, max(confidence) AS confidence FROM a GROUP BY 1, 2, 3, 4""")
def resolve_edges(spark, d):
    s, e = view(spark, d, "symbols"), view(spark, d, "raw_edges").alias("e")
    own = s.select("symbol_id", "repository_id").alias("s")
    t = s.select("symbol_id", "symbol_name", "qualified_name").alias("t")
    raw = e.join(own, F.col("s.symbol_id") == F.col("e.source_symbol_id")).join(t, F.col("t.symbol_id") == F.col("e.target_doc"))
    raw = raw.select(F.col("s.repository_id").alias("repository_id"), "e.source_symbol_id", "e.relationship_type", F.expr(TARGET).alias("target_name"), "e.via", "e.confidence")
    return index.resolve_edges(s, raw)


@query("SELECT source_symbol_id, target_doc AS target_symbol_id, relationship_type, max(confidence) AS confidence FROM v_raw_edges GROUP BY 1, 2, 3")
def agg_edge_dedup(spark, d):
    e = view(spark, d, "raw_edges").select("source_symbol_id", F.col("target_doc").alias("target_symbol_id"), "relationship_type", "confidence")
    return index.keep_strongest(e)


@query("""WITH b AS (SELECT s.symbol_id, 'outgoing' AS direction, e.relationship_type, e.target_symbol_id AS other_id, e.confidence FROM v_edges e JOIN v_symbols s ON s.symbol_id = e.source_symbol_id UNION ALL SELECT s.symbol_id, 'incoming', e.relationship_type, e.source_symbol_id, e.confidence FROM v_edges e JOIN v_symbols s ON s.symbol_id = e.target_symbol_id)
SELECT b.symbol_id, direction, relationship_type, other_id, o.qualified_name AS other_name, confidence FROM b LEFT JOIN v_symbols o ON o.symbol_id = b.other_id""")
def rel_lookup(spark, d):
    s = view(spark, d, "symbols")
    return findings.relationships(view(spark, d, "edges"), s, s)


@query("""WITH h AS (SELECT f.finding_id, s.symbol_id, row_number() OVER (PARTITION BY f.finding_id ORDER BY s.symbol_type = 'module', s.end_line - s.start_line, s.symbol_id) AS n FROM v_findings f JOIN v_symbols s ON s.file_path = f.file_path AND f.line BETWEEN s.start_line AND s.end_line),
m AS (SELECT file_path, min(symbol_id) AS symbol_id FROM v_symbols WHERE symbol_type = 'module' GROUP BY 1)
SELECT f.finding_id, coalesce(h.symbol_id, m.symbol_id) AS symbol_id, CASE WHEN h.symbol_id IS NOT NULL THEN 'span' WHEN m.symbol_id IS NOT NULL THEN 'module' END AS how FROM v_findings f LEFT JOIN h ON h.finding_id = f.finding_id AND h.n = 1 LEFT JOIN m ON m.file_path = f.file_path""")
def join_interval(spark, d):
    return findings.enclosing_symbols(view(spark, d, "findings"), view(spark, d, "symbols"))


@query("""WITH k AS (SELECT symbol_id, string_split(lower(qualified_name), '.') AS ps FROM v_symbols), e AS (SELECT symbol_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM k), x AS (SELECT symbol_id, array_to_string(ps[i:], '.') AS k, i > 1 AS part FROM e),
b AS (SELECT k, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY part, symbol_id) AS n FROM x) y WHERE n = 1), a AS (SELECT DISTINCT symbol_name AS name FROM v_symbols UNION SELECT DISTINCT qualified_name FROM v_symbols)
SELECT name, b.symbol_id FROM a LEFT JOIN b ON b.k = lower(a.name)""")
def lookup_symbol(spark, d):
    s = view(spark, d, "symbols")
    return findings.lookup(s, s.select(F.col("symbol_name").alias("name")).union(s.select("qualified_name")))


def _states(spark, d):
    of = lambda v: view(spark, d, v).select(F.concat_ws("/", "repo", "path").alias("path"), F.sha2("body", 256).alias("content_hash"))
    return of("previous"), of("current")


STATES = "p AS (SELECT concat(repo, '/', path) AS path, sha256(body) AS h FROM v_previous), c AS (SELECT concat(repo, '/', path) AS path, sha256(body) AS h FROM v_current)"


@query(f"WITH {STATES} SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'A' WHEN c.path IS NULL THEN 'D' ELSE 'M' END AS op FROM p FULL JOIN c ON p.path = c.path WHERE p.h IS DISTINCT FROM c.h")
def changes(spark, d):
    return index.changes(*_states(spark, d))


@query(f"WITH {STATES} SELECT path, h AS content_hash FROM c")
def incremental_index(spark, d):
    p, c = _states(spark, d)
    return index.incremental(p, c, index.changes(p, c))


@query(f"WITH {STATES} SELECT p.path, p.h AS content_hash FROM p JOIN c ON p.path = c.path AND p.h = c.h")
def anti_deleted(spark, d):
    p, c = _states(spark, d)
    return index.without(p, index.changes(p, c))


@query(f"WITH {STATES} SELECT count(*) AS files_deleted, count(*) AS symbols_deleted FROM p LEFT JOIN c ON p.path = c.path WHERE c.path IS NULL")
def delete_file(spark, d):
    p, c = _states(spark, d)
    gone = index.changes(p, c).filter("op = 'D'")
    return index.delete_files(p, p.withColumnRenamed("path", "file_path"), gone)[2]


@query("SELECT c.doc_id AS symbol_id FROM v_current c WHERE NOT EXISTS (SELECT 1 FROM v_previous p WHERE p.doc_id = c.doc_id AND sha256(p.body) = sha256(c.body))")
def anti_stale(spark, d):
    of = lambda v: view(spark, d, v).select(F.col("doc_id").alias("symbol_id"), F.sha2("body", 256).alias("source_hash"))
    have = of("previous").withColumns({"embedding_model": F.lit("hash"), "embedding_version": F.lit("1")})
    return index.stale(of("current"), have, "hash", "1").select("symbol_id")


@query(f"WITH {STERMS}, h AS ({_HASH.format('sterms')}) SELECT s.symbol_id, sha256(s.source_code) AS source_hash, count(*) AS buckets FROM h JOIN v_symbols s ON s.symbol_id = h.k WHERE h.v <> 0 GROUP BY 1, 2")
def embed_repo(spark, d):
    s = view(spark, d, "symbols").select("repository_id", "symbol_id", F.sha2("source_code", 256).alias("source_hash"), "source_code")
    none = s.select("symbol_id", "source_hash", F.lit("hash").alias("embedding_model"), F.lit("0").alias("embedding_version"))
    e = index.embed(index.stale(s, none, "hash", "1"), terms="source_code")
    return e.select("symbol_id", "source_hash", F.size("embedding").cast("long").alias("buckets"))


@query("""WITH o AS (SELECT n_name AS name, n_nationkey::BIGINT AS repository_id, CAST(n_regionkey AS VARCHAR) AS url FROM nation), n AS (SELECT r_name AS name, NULL::BIGINT AS repository_id, 'new' AS url FROM region UNION ALL SELECT n_name, NULL, CASE WHEN n_regionkey = 1 THEN 'moved' END FROM nation WHERE n_regionkey <= 2)
SELECT coalesce(n.name, o.name) AS name, coalesce(n.repository_id, o.repository_id) AS repository_id, coalesce(n.url, o.url) AS url FROM o FULL JOIN n ON o.name = n.name""")
def upsert_repo(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    old = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("repository_id"), F.col("n_regionkey").cast("string").alias("url"))
    new = r.select(F.col("r_name").alias("name"), F.lit("new").alias("url")).unionByName(n.filter("n_regionkey <= 2").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 1, "moved").alias("url")))
    return index.upsert(old, new, "name")


@query("SELECT DISTINCT path FROM (SELECT concat(repo, '/', path) AS path FROM v_previous UNION ALL SELECT concat(repo, '/', path) FROM v_current) x")
def union_paths(spark, d):
    p, c = _states(spark, d)
    return p.select("path").union(c.select("path")).dropDuplicates(["path"])


@query()
def scan_walk(spark, d):
    return files.scan_walk(spark, d, all_files=True).select("path", "size")


@query("SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL ELSE html END AS text FROM pages")
def read_text(spark, d):
    nul = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("a\0"), "html")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", files.read_text(F.encode(nul, "UTF-8")).alias("text"))


@query("""SELECT doc_id, op, path FROM (SELECT doc_id, 'M' AS op, concat('m', doc_id) AS path FROM documents UNION ALL SELECT doc_id, 'D', concat('old', doc_id) FROM documents UNION ALL SELECT doc_id, 'A', concat('new', doc_id) FROM documents
UNION ALL SELECT doc_id, 'A', 'a b' FROM documents UNION ALL SELECT doc_id, 'D', 'gone' FROM documents UNION ALL SELECT doc_id, 'M', 'kind' FROM documents) x""")
def scan_diff(spark, d):
    z = lambda *xs: F.concat(*(F.concat(x if not isinstance(x, str) else F.lit(x), F.lit("\0")) for x in xs))
    i = F.col("doc_id").cast("string")
    out = z("M", F.concat(F.lit("m"), i), "R087", F.concat(F.lit("old"), i), F.concat(F.lit("new"), i), "A", "a b", "D", "gone", "T", "kind")
    return table(spark, d, "documents").select("doc_id", F.explode(files.parse_name_status(out)).alias("c")).select("doc_id", "c.op", "c.path")


@query("SELECT doc_id, concat('f', doc_id, '.py') AS file_path, doc_id AS line, 'E' || quality AS code, 'says: x' AS message FROM labels WHERE doc_id % 7 <> 0")
def src_flake8(spark, d):
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("f"), i, F.lit(".py\t"), i, F.lit("\tE"), F.col("quality").cast("string"), F.when(F.col("doc_id") % 7 == 0, F.lit(": no tab")).otherwise(F.lit("\tsays: x")))
    return reports.tab_findings(table(spark, d, "labels").select("doc_id", text.alias("line")))


@query("SELECT doc_id, concat('f', doc_id, '.py') AS file_path, doc_id AS line, 'W' || toxic AS code, 'says x' AS message FROM labels WHERE doc_id % 5 <> 0")
def src_pylint(spark, d):
    one = F.struct(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("doc_id").alias("line"), F.concat(F.lit("W"), F.col("toxic").cast("string")).alias("symbol"), F.lit("says x").alias("message"))
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("{not json")).otherwise(F.to_json(F.array(one)))
    return reports.json_findings(table(spark, d, "labels").select("doc_id", text.alias("report")))


@query("SELECT item_id, text AS question, concat('a.', item_id, '|b') AS expected FROM benchmark")
def src_eval_json(spark, d):
    one = F.struct(F.col("text").alias("question"), F.array(F.concat(F.lit("a."), F.col("item_id").cast("string")), F.lit("b")).alias("expected_symbols"))
    c = reports.cases_of(table(spark, d, "benchmark").select("item_id", F.to_json(F.array(one)).alias("body")))
    return c.select("item_id", "question", F.array_join("expected_symbols", "|").alias("expected"))


PYTHON = '''import os.path
from pkg import m{1}


class C{0}(Base):
    """Of {0}."""

    def run(self):
        return self.go(help())

    def go(self, x):
        return x


def main():
    C{0}().run()
'''
JAVA = """package a.b;
import java.util.List;

public class C{0} extends Base {{
    private int n = 0;

    public int run(List<String> xs) {{
        return go(xs.size());
    }}

    int go(int n) {{ return n; }}
}}
"""


def _sources(spark, d, template: str, ext: str):
    i = F.col("doc_id").cast("string")
    text = F.lit(template.replace("{{", "{").replace("}}", "}"))
    text = F.replace(F.replace(text, F.lit("{0}"), i), F.lit("{1}"), (F.col("doc_id") - F.pmod("doc_id", F.lit(10))).cast("string"))
    return table(spark, d, "documents").select(F.concat(F.lit("pkg/m"), i, F.lit(f".{ext}")).alias("path"), text.alias("text"))


def _symbols_sql(ext: str, module: str, rows: list[tuple]) -> str:
    each = ", ".join("{'q': " + f"concat({q})" + f", 't': '{t}', 'a': {a}, 'z': {z}" + "}" for q, t, a, z in rows)
    return f"WITH r AS (SELECT doc_id, unnest([{each}]) AS x FROM documents) SELECT concat('pkg/m', doc_id, '.{ext}') AS file_path, x.q AS qualified_name, x.t AS symbol_type, CAST(x.a AS BIGINT) AS start_line, CAST(x.z AS BIGINT) AS end_line FROM r"


_M = "'pkg.m', doc_id"


@query(_symbols_sql("py", "pkg", [(_M, "module", 1, 2), (f"{_M}, '.C', doc_id", "class", 5, 12), (f"{_M}, '.C', doc_id, '.run'", "method", 8, 9), (f"{_M}, '.C', doc_id, '.go'", "method", 11, 12), (f"{_M}, '.main'", "function", 15, 16)]))
def parse_python(spark, d):
    return parse_files(_sources(spark, d, PYTHON, "py")).select("file_path", "qualified_name", "symbol_type", "start_line", "end_line")


@query(_symbols_sql("java", "pkg", [(_M, "module", 1, 2), (f"{_M}, '.C', doc_id", "class", 4, 12), (f"{_M}, '.C', doc_id, '.run'", "method", 7, 9), (f"{_M}, '.C', doc_id, '.go'", "method", 11, 11)]))
def parse_spec(spark, d):
    return parse_files(_sources(spark, d, JAVA, "java")).select("file_path", "qualified_name", "symbol_type", "start_line", "end_line")


GO = """package a
import "fmt"

type C{0} struct {{
    n int
}}

func (c *C{0}) Run(x int) int {{
    return help(x)
}}

func Main() {{ fmt.Println(1) }}
"""
RUST = """use std::fmt;

pub struct C{0} {{
    n: i32,
}}

impl C{0} {{
    pub fn run(&self) -> i32 {{
        help(self.n)
    }}
}}

fn main() {{ run(); }}
"""
TYPESCRIPT = """import {{ a }} from "./a";

export interface S{0} {{
    n: number;
}}

export class C{0} extends Base {{
    async run(x: number): Promise<number> {{
        return help(x);
    }}
}}

export const pick = (a: Map<string, number>): number => {{ return sum(a); }}
"""
JAVASCRIPT = """import a from "./a";

const re = /["'{{]/;

class C{0} {{
    run(x) {{
        return help(x);
    }}
}}

function main() {{ return run(); }}
"""
_C = f"{_M}, '.C', doc_id"


def _spans(spark, d, template, ext):
    return parse_files(_sources(spark, d, template, ext)).select("file_path", "qualified_name", "symbol_type", "start_line", "end_line")


@query(_symbols_sql("go", "pkg", [(_M, "module", 1, 2), (_C, "class", 4, 6), (f"{_M}, '.Run'", "method", 8, 10), (f"{_M}, '.Main'", "function", 12, 12)]))
def parse_go(spark, d):
    return _spans(spark, d, GO, "go")


@query(_symbols_sql("rs", "pkg", [(_M, "module", 1, 1), (_C, "class", 3, 5), (f"{_C}, '.run'", "method", 8, 10), (f"{_M}, '.main'", "function", 13, 13)]))
def parse_rust(spark, d):
    return _spans(spark, d, RUST, "rs")


@query(_symbols_sql("ts", "pkg", [(_M, "module", 1, 1), (f"{_M}, '.S', doc_id", "class", 3, 5), (_C, "class", 7, 11), (f"{_C}, '.run'", "method", 8, 10), (f"{_M}, '.pick'", "function", 13, 13)]))
def parse_typescript(spark, d):
    return _spans(spark, d, TYPESCRIPT, "ts")


@query(_symbols_sql("js", "pkg", [(_M, "module", 1, 3), (_C, "class", 5, 9), (f"{_C}, '.run'", "method", 6, 8), (f"{_M}, '.main'", "function", 11, 11)]))
def parse_javascript(spark, d):
    return _spans(spark, d, JAVASCRIPT, "js")


@query("""WITH r AS (SELECT doc_id, unnest([{'q': concat('.C', doc_id), 's': concat('class C', doc_id, '(Base)'), 'd': concat('Of ', doc_id, '.')}, {'q': concat('.C', doc_id, '.run'), 's': 'def run(self)', 'd': NULL},
{'q': concat('.C', doc_id, '.go'), 's': 'def go(self, x)', 'd': NULL}, {'q': '.main', 's': 'def main()', 'd': NULL}]) AS x FROM documents) SELECT concat('pkg.m', doc_id, x.q) AS qualified_name, x.s AS signature, x.d AS docstring FROM r""")
def parse_heads(spark, d):
    return parse_files(_sources(spark, d, PYTHON, "py")).filter("symbol_type != 'module'").select("qualified_name", "signature", "docstring")


@query("""WITH r AS (SELECT doc_id, unnest([{'s': 0, 'k': 'IMPORTS', 't': 'os.path', 'v': NULL, 'c': 0.9::DOUBLE}, {'s': 0, 'k': 'IMPORTS', 't': concat('pkg.m', doc_id - doc_id % 10), 'v': NULL, 'c': 0.9::DOUBLE}, {'s': 1, 'k': 'INHERITS', 't': 'Base', 'v': NULL, 'c': 0.9::DOUBLE},
{'s': 2, 'k': 'CALLS', 't': 'go', 'v': 'self', 'c': 0.9::DOUBLE}, {'s': 2, 'k': 'CALLS', 't': 'help', 'v': 'bare', 'c': 0.6::DOUBLE}, {'s': 4, 'k': 'CALLS', 't': 'run', 'v': 'attr', 'c': 0.6::DOUBLE}, {'s': 4, 'k': 'CALLS', 't': concat('C', doc_id), 'v': 'bare', 'c': 0.6::DOUBLE}]) AS x FROM documents)
SELECT concat('pkg/m', doc_id, '.py') AS file_path, CAST(x.s AS BIGINT) AS local_id, x.k AS relationship_type, x.t AS target_name, x.v AS via, x.c AS confidence FROM r""")
def parse_edges(spark, d):
    return parse_files(_sources(spark, d, PYTHON, "py")).select("file_path", "local_id", F.explode("edges").alias("e")).select("file_path", "local_id", "e.*")


@query("""SELECT 'CONTAINS' AS relationship_type, 4 * count(*) AS n FROM documents UNION ALL SELECT 'CALLS', 2 * count(*) FROM documents
UNION ALL SELECT 'IMPORTS', count(*) FROM documents a JOIN documents b ON b.doc_id = a.doc_id - a.doc_id % 10 WHERE a.doc_id % 10 <> 0""")
def full_index(spark, d):
    from sparkloom.shared_store import materialize

    symbols, raw = index.symbols_from(materialize(parse_files(_sources(spark, d, PYTHON, "py")), "parsed"), 1)
    return index.resolve_edges(symbols, raw).groupBy("relationship_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT conv_id, CAST(length('[{\"name\":\"search\"}]') AS BIGINT) AS chars FROM conversations")
def tool_schema_chars(spark, d):
    return rewrite.bodies_of(table(spark, d, "conversations")).select("conv_id", rewrite.tool_schema_chars(F.col("body")).alias("chars"))


def _rewritten(spark, d, how: rewrite.Rewrites):
    return rewrite.rewrite(rewrite.bodies_of(table(spark, d, "conversations")), "body", how)


@query("SELECT DISTINCT conv_id, 'large-a' AS routed_from, 'small-c' AS model FROM conversations")
def rw_route(spark, d):
    return _rewritten(spark, d, rewrite.Rewrites(routes={"large-a": "small-c"})).select("conv_id", "routed_from", F.get_json_object("new_body", "$.model").alias("model"))


@query("SELECT DISTINCT conv_id, TRUE AS cap_applied, CAST(1024 AS BIGINT) AS max_tokens, CAST(9000 AS BIGINT) AS budget_tokens FROM conversations")
def rw_caps(spark, d):
    r = _rewritten(spark, d, rewrite.Rewrites(max_tokens=1024, thinking_budget=20_000))
    return r.select("conv_id", "cap_applied", F.get_json_object("new_body", "$.max_tokens").cast("long").alias("max_tokens"), F.get_json_object("new_body", "$.thinking.budget_tokens").cast("long").alias("budget_tokens"))


@query(f"SELECT DISTINCT conv_id, TRUE AS terse_applied, 'Be exact.' || chr(10) || chr(10) || '{rewrite.TERSE}' AS system FROM conversations")
def rw_terse(spark, d):
    return _rewritten(spark, d, rewrite.Rewrites(terse=True)).select("conv_id", "terse_applied", F.get_json_object("new_body", "$.system").alias("system"))


@query("SELECT DISTINCT conv_id, CAST(3 AS BIGINT) AS marks FROM conversations")
def rw_autocache(spark, d):
    return _rewritten(spark, d, rewrite.Rewrites(auto_cache=True)).select("conv_id", F.regexp_count("new_body", F.lit('"cache_control"')).cast("long").alias("marks"))


_SHORT = compress.compress_sql("text", 300, 150, "(SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL)")


@query(f"""WITH c AS ({_SHORT}), t AS (SELECT conv_id, conv_id * 100000 + turn AS doc_id, length(text) AS n FROM conversations)
SELECT conv_id, CAST(sum(CASE WHEN length(compressed) + 64 < n THEN n - length(compressed) ELSE 0 END) AS BIGINT) AS chars_saved FROM t LEFT JOIN c USING (doc_id) GROUP BY conv_id""")
def rw_compress(spark, d):
    return _rewritten(spark, d, rewrite.Rewrites(compress=(300, 150))).select("conv_id", "chars_saved")


@query("SELECT DISTINCT symbol_name AS name, (SELECT count(*) FROM v_symbols o WHERE lower(o.symbol_name) = lower(s.symbol_name)) AS n FROM v_symbols s")
def ci_eq(spark, d):
    s = view(spark, d, "symbols")
    n = s.groupBy(F.lower("symbol_name").alias("k")).agg(F.count("*").alias("n"))
    return s.select(F.col("symbol_name").alias("name")).distinct().withColumn("k", F.lower("name")).join(n, "k").select("name", "n")


