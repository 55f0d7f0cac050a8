"""From analyzer findings and names to symbols, and what stands around them in the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import pack, retrieve
from sparkloom.shared_store import materialize

#: Lines of a stretch: findings and symbols meet by file and stretch, so that a large file isn't one key.
STRETCH = 64


def enclosing_symbols(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """(finding_id, symbol_id, how): the smallest symbol around each finding's line, modules last; else its file's module.

    how is `span`, `module` or, without any symbol, null. Of equal spans the smallest id. An equi-join on file and
    stretch of lines, then the exact test.
    """
    f = findings.select("finding_id", "file_path", F.col("line").cast("long").alias("line"))
    cell = lambda c: F.floor(c / STRETCH)
    s = symbols.select("symbol_id", "file_path", "symbol_type", F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("b"))
    # Equal spans of a file are one, its smallest id, and findings of a line are looked for once: pairs grow with lines, not with rows.
    spans = s.groupBy("file_path", "a", "b", (F.col("symbol_type") == "module").alias("m")).agg(F.min("symbol_id").alias("symbol_id"))
    cells = spans.select("*", F.explode(F.sequence(cell(F.col("a")), F.greatest(cell(F.col("a")), cell(F.col("b"))))).alias("cell"))
    order = F.struct("m", (F.col("b") - F.col("a")).alias("n"), "symbol_id")
    lines = f.select("file_path", "line").distinct().withColumn("cell", cell(F.col("line")))
    hit = lines.join(cells, ["file_path", "cell"]).filter("a <= line and line <= b").groupBy("file_path", "line").agg(F.min(order)["symbol_id"].alias("inner"))
    modules = s.filter("symbol_type = 'module'").groupBy("file_path").agg(F.min("symbol_id").alias("module"))
    both = f.join(hit, ["file_path", "line"], "left").join(modules, "file_path", "left")
    how = F.when(F.col("inner").isNotNull(), "span").when(F.col("module").isNotNull(), "module")
    return both.select("finding_id", F.coalesce("inner", "module").alias("symbol_id"), how.alias("how"))


def relationships(edges: DataFrame, symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """(symbol_id, direction, relationship_type, other_id, other_name, confidence) of the edges that touch the asked symbols."""
    a = asked.select("symbol_id").distinct()
    out = edges.join(a, edges["source_symbol_id"] == a["symbol_id"]).select("symbol_id", F.lit("outgoing").alias("direction"), "relationship_type", F.col("target_symbol_id").alias("other_id"), "confidence")
    into = edges.join(a, edges["target_symbol_id"] == a["symbol_id"]).select("symbol_id", F.lit("incoming").alias("direction"), "relationship_type", F.col("source_symbol_id").alias("other_id"), "confidence")
    names = symbols.select(F.col("symbol_id").alias("other_id"), F.col("qualified_name").alias("other_name"))
    return out.unionByName(into).join(names, "other_id", "left").select("symbol_id", "direction", "relationship_type", "other_id", "other_name", "confidence")


def lookup(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(name, symbol_id): the symbol of each name: its qualified name but for case, else a dotted end of it, smallest id first."""
    key = F.lower("qualified_name")
    parts = F.split(key, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("k"), (i > 1).alias("part")))
    keys = symbols.select("symbol_id", F.explode(ends).alias("e")).select("symbol_id", "e.*")
    best = keys.groupBy("k").agg(F.min(F.struct("part", "symbol_id"))["symbol_id"].alias("symbol_id"))
    asked = names.select("name").distinct().withColumn("k", F.lower("name"))
    return asked.join(best, "k", "left").select("name", "symbol_id")


def fix_context(findings: DataFrame, symbols: DataFrame, edges: DataFrame, *, index: retrieve.SearchIndex | None = None, max_tokens: int | None = None) -> DataFrame:
    """The packed context of each finding: a search for the enclosing symbol's qualified name, with that symbol as changed."""
    found = materialize(enclosing_symbols(findings, symbols).filter("symbol_id is not null"), "enclosing")
    asked = found.join(symbols.select("symbol_id", "repository_id", "qualified_name"), "symbol_id").select(F.col("finding_id").alias("query_id"), "symbol_id", "repository_id", F.col("qualified_name").alias("question"))
    # Findings that ask the same are searched for once, and those of one symbol are packed once.
    questions = asked.groupBy("repository_id", "question").agg(F.min("query_id").alias("query_id"))
    targets = asked.groupBy("repository_id", "question", "symbol_id").agg(F.min("query_id").alias("target"))
    targets = materialize(targets.join(questions, ["repository_id", "question"]).select("query_id", "target", "symbol_id"), "targets")
    ranked = materialize(retrieve.load(retrieve.hybrid(materialize(questions, "questions"), symbols, edges, index=index, many=True), symbols).drop("changed"), "ranked")
    each = ranked.join(targets.select("query_id", "target", F.col("symbol_id").alias("__own")), "query_id").drop("query_id").withColumn("changed", F.col("symbol_id") == F.col("__own")).drop("__own")
    packed = pack.pack_context(each, max_tokens=max_tokens, key="target")
    mine = found.join(targets.select("symbol_id", "target"), "symbol_id").select(F.col("finding_id").alias("query_id"), "target")
    return mine.join(packed, "target").drop("target")


def rank_of_reasons(hits: DataFrame) -> DataFrame:
    """(query_id, symbol_id, source, rank): the place in each source's own order."""
    w = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "symbol_id")
    return hits.select("query_id", "symbol_id", "source", F.row_number().over(w).cast("long").alias("rank"))
