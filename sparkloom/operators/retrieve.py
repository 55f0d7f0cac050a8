"""Ranked retrieval for batches of queries: symbol, lexical, semantic; fusion, graph expansion, reranking.

Queries have query_id, repository_id, question; symbols what the tables name. Hits are (query_id, symbol_id, source, score, rank).
Each retriever joins on the repository, so no query sees another's rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as X
from sparkloom.functions import vectors as V
from sparkloom.operators import blocks
from sparkloom.shared_store import materialize

WEIGHTS = {"symbol": 2.0, "lexical": 1.0, "semantic": 1.0}
RRF_K, SYMBOL_LIMIT, LEXICAL_LIMIT, SEMANTIC_LIMIT, CANDIDATES = 60, 10, 30, 30, 60
SEEDS, GRAPH_WEIGHT, GRAPH_TOKENS = 20, 0.7, 6000
# What an edge makes of a neighbour, by its type and whether the seed is its source.
REASONS = {
    ("CONTAINS", True): "graph_child", ("CONTAINS", False): "graph_parent", ("CALLS", True): "graph_callee", ("CALLS", False): "graph_caller", ("IMPORTS", True): "graph_import",
    ("IMPORTS", False): "graph_importer", ("INHERITS", True): "graph_base", ("INHERITS", False): "graph_subclass", ("TESTS", True): "graph_tested", ("TESTS", False): "graph_test",
}
K1, LENGTH_SHARE = 1.2, 0.75


def best(hits: DataFrame, limit: int, source: str) -> DataFrame:
    """The first `limit` of each query by score, then id, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "symbol_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "symbol_id", F.lit(source).alias("source"), "score", F.col("rank").cast("long").alias("rank"))


def symbol_hits(queries: DataFrame, symbols: DataFrame, limit: int = SYMBOL_LIMIT) -> DataFrame:
    """Symbols whose qualified name, name or dotted suffix is a token of the query: an equi-join on all such keys."""
    tokens = queries.select("query_id", "repository_id", X.is_symbol_like(F.col("question")).alias("like"), F.posexplode(X.candidate_tokens(F.col("question"))).alias("pos", "token"))
    tokens = tokens.select("query_id", "repository_id", F.lower("token").alias("key"), F.when((F.col("pos") == 0) & F.col("like"), F.lit(1.0)).otherwise(F.lit(0.85)).alias("base"))
    q = F.lower("qualified_name")
    parts = F.split(q, r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("key"), F.lit(0.9).alias("w")))
    keys = F.concat(F.array(F.struct(q.alias("key"), F.lit(1.0).alias("w")), F.struct(F.lower("symbol_name").alias("key"), F.lit(0.95).alias("w"))), tails)
    names = symbols.select("repository_id", "symbol_id", F.explode(keys).alias("k")).select("repository_id", "symbol_id", "k.*")
    found = tokens.join(names, ["repository_id", "key"]).groupBy("query_id", "symbol_id").agg(F.max(F.round(F.col("base") * F.col("w"), 6)).alias("score"))
    return best(found, limit, "symbol")


def term_lists(symbols: DataFrame) -> DataFrame:
    """(repository_id, symbol_id, keys): what the lexical and the semantic ranking read of a symbol; worth storing."""
    return symbols.select("repository_id", "symbol_id", X.query_keys(F.col("source_code")).alias("keys"))


def postings(lists: DataFrame) -> DataFrame:
    """(repository_id, term, symbol_id, terms): the inverted index of term_lists(); terms is how many the symbol has."""
    return lists.select("repository_id", "symbol_id", F.size("keys").alias("terms"), F.explode("keys").alias("term"))


def lexical_hits(queries: DataFrame, lists: DataFrame, limit: int = LEXICAL_LIMIT) -> DataFrame:
    """BM25 over the distinct terms of each symbol within its repository (lists: those of term_lists()).

    Only postings of terms that some query asks for are counted and scored, so the rest is never shuffled where the
    asked terms are few enough for Spark to broadcast.
    """
    sizes = lists.filter(F.size("keys") > 0).groupBy("repository_id").agg(F.count("*").alias("n"), F.avg(F.size("keys")).alias("mean"))
    terms = queries.select("query_id", "repository_id", F.explode(X.tsquery_terms(F.col("question"))).alias("term"))
    index = postings(lists).join(terms.select("repository_id", "term").distinct(), ["repository_id", "term"])
    df = index.groupBy("repository_id", "term").agg(F.count("*").alias("df"))
    asked = terms.join(df, ["repository_id", "term"]).join(sizes, "repository_id")
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.select("query_id", "repository_id", "term", idf.alias("idf"), "mean")
    part = F.col("idf") * (K1 + 1) / (F.lit(1.0) + K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * F.col("terms") / F.col("mean")))
    found = index.join(asked, ["repository_id", "term"]).groupBy("query_id", "symbol_id").agg(F.round(F.sum(part), 6).alias("score"))
    return best(found, limit, "lexical")


def lexical_hits_of_many(queries: DataFrame, lists: DataFrame, limit: int = LEXICAL_LIMIT) -> DataFrame:
    """lexical_hits() for queries whose number grows with the symbols': pairs are scored within blocks and only the best leave them."""
    n = F.size("keys")
    sizes = lists.filter(n > 0).groupBy("repository_id").agg(F.count("*").alias("n"), F.avg(n).alias("mean"))
    terms = queries.select("query_id", "repository_id", F.explode(X.tsquery_terms(F.col("question"))).alias("term"))
    df = postings(lists).groupBy("repository_id", "term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(df, ["repository_id", "term"]).join(sizes, "repository_id").groupBy("repository_id", "query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("x"))
    asked = asked.select("repository_id", "query_id", F.col("x.term").alias("keys"), F.col("x.idf").alias("weights"))
    weight = F.lit(K1 + 1) / (F.lit(1.0) + K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * n / F.col("mean")))
    rows = lists.join(sizes, "repository_id").filter(n > 0).select("repository_id", "symbol_id", "keys", F.array_repeat(weight, n).alias("weights"))
    found = blocks.best_in_cells(asked, rows, blocks.sums(limit)).withColumn("score", F.round("score", 6))
    return best(found, limit, "lexical")


def semantic_hits_of_many(queries: DataFrame, vectors: DataFrame, limit: int = SEMANTIC_LIMIT) -> DataFrame:
    """semantic_hits() for queries whose number grows with the symbols'."""
    parts = lambda c: (F.col(f"{c}.bucket").cast("array<bigint>").alias("keys"), F.col(f"{c}.value").alias("weights"))
    q = queries.select("repository_id", "query_id", V.embedding(X.query_keys(F.col("question"))).alias("e")).filter("e is not null").select("repository_id", "query_id", *parts("e"))
    rows = vectors.filter("embedding is not null").select("repository_id", "symbol_id", *parts("embedding"))
    found = blocks.best_in_cells(q, rows, blocks.sums(limit)).withColumn("score", F.round("score", 6) + F.lit(0.0))
    return best(found, limit, "semantic")


class SearchIndex(NamedTuple):
    """What a search reads of symbols, made once when they are indexed: their terms, and their embeddings."""

    lists: DataFrame  # repository_id, symbol_id, keys
    vectors: DataFrame  # repository_id, symbol_id, embedding: [(bucket, value)]


def build_index(symbols: DataFrame) -> SearchIndex:
    """The index of symbols that no store has, written to the shared folder."""
    lists = materialize(term_lists(symbols), "terms")
    return SearchIndex(lists, materialize(lists.select("repository_id", "symbol_id", V.embedding(F.col("keys")).alias("embedding")), "vectors"))


def stored_index(symbols: DataFrame, embeddings: DataFrame) -> SearchIndex:
    """The index out of the store's tables of one model: search documents as they are, and embeddings; no code is read."""
    keys = F.array_distinct(F.filter(F.split("search_document", " "), lambda x: x != ""))
    return SearchIndex(symbols.select("repository_id", "symbol_id", keys.alias("keys")), embeddings.select("repository_id", "symbol_id", "embedding"))


def semantic_hits(queries: DataFrame, vectors: DataFrame, limit: int = SEMANTIC_LIMIT) -> DataFrame:
    """Cosine of hash embeddings, multiplied bucket by bucket; queries without a term find nothing.

    Vectors stay where they are stored when the queries' buckets are few enough for Spark to broadcast; sums are formed in the tasks first.
    """
    q = V.hash_embed(queries, X.query_keys(F.col("question")), "query_id", "repository_id").withColumnRenamed("value", "qv")
    x = vectors.select("repository_id", "symbol_id", F.explode("embedding").alias("x")).select("repository_id", "symbol_id", "x.bucket", "x.value")
    found = x.join(q, ["repository_id", "bucket"]).groupBy("query_id", "symbol_id").agg((F.round(F.sum(F.col("value") * F.col("qv")), 6) + F.lit(0.0)).alias("score"))  # no -0.0
    return best(found, limit, "semantic")


def vector_hits(queries: DataFrame, vectors: DataFrame, limit: int = SEMANTIC_LIMIT) -> DataFrame:
    """Exact cosine top-k of stored embeddings (queries: query_id, repository_id, vector) within each repository.

    All pairs of a repository are multiplied, block by block; each block hands on its best `limit` of a query alone.
    """
    rows = vectors.select("repository_id", "symbol_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select("repository_id", "query_id", F.col("vector").cast("array<double>").alias("vector"))
    found = blocks.best_in_cells(asked, rows, blocks.cosines(limit)).withColumn("score", F.round("score", 6))
    return best(found, limit, "semantic")


def fuse(hits: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, limit: int = CANDIDATES) -> DataFrame:
    """Reciprocal rank fusion: (query_id, symbol_id, fused_score, reasons, pos), the first `limit` of each query."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (weights or WEIGHTS).items() for x in kv)), F.col("source")), F.lit(1.0))
    fused = hits.groupBy("query_id", "symbol_id").agg(F.round(F.sum(weight / (F.lit(float(k)) + F.col("rank"))), 9).alias("fused_score"), F.array_sort(F.collect_set("source")).alias("reasons"))
    return positions(fused).filter(F.col("pos") <= limit)


def positions(df: DataFrame, score: str = "fused_score") -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "symbol_id")).cast("long"))


def graph_reason(kind: Column, outward: Column) -> Column:
    out = F.lit(None).cast("string")
    for (k, o), name in REASONS.items():
        out = F.when((kind == k) & (outward == o), name).otherwise(out)
    return out


def touching(edges: DataFrame) -> DataFrame:
    """(seed, symbol_id, relationship_type, confidence, reason): each edge from both of its ends; loops and unknown types go."""
    e = edges.filter("target_symbol_id is not null and source_symbol_id != target_symbol_id")
    out = e.select(F.col("source_symbol_id").alias("seed"), F.col("target_symbol_id").alias("symbol_id"), "relationship_type", "confidence", F.lit(True).alias("outward"))
    back = e.select(F.col("target_symbol_id").alias("seed"), F.col("source_symbol_id").alias("symbol_id"), "relationship_type", "confidence", F.lit(False).alias("outward"))
    return out.unionByName(back).withColumn("reason", graph_reason(F.col("relationship_type"), F.col("outward"))).filter("reason is not null").drop("outward")


def neighbours(fused: DataFrame, edges: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """(query_id, symbol_id, contribution, reasons): for each neighbour of a seed the strongest edge, and all reasons."""
    s = fused.filter(F.col("pos") <= max(1, seeds)).select("query_id", F.col("symbol_id").alias("seed"), "fused_score")
    near = touching(edges).join(s, "seed").groupBy("query_id", "symbol_id")
    return near.agg(F.round(F.max(F.lit(GRAPH_WEIGHT) * F.col("fused_score") * F.col("confidence")), 12).alias("contribution"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def expand(fused: DataFrame, edges: DataFrame, symbols: DataFrame, *, most: int = SEEDS, tokens: int = GRAPH_TOKENS) -> DataFrame:
    """(query_id, symbol_id, fused_score, reasons): candidates raised by their edges, and new neighbours.

    New ones come in by contribution, then id, while at most `most` do and each fits the tokens that are left; one that
    doesn't fit is passed over. A query's seeds bound its neighbours' list.
    """
    near = neighbours(fused, edges)
    old = fused.select("query_id", "symbol_id", "fused_score", F.col("reasons").alias("r")).join(near, ["query_id", "symbol_id"], "left")
    old = old.select("query_id", "symbol_id", F.round(F.col("fused_score") + F.coalesce("contribution", F.lit(0.0)), 12).alias("fused_score"), F.array_sort(F.array_union("r", F.coalesce("reasons", F.array().cast("array<string>")))).alias("reasons"))
    new = near.join(fused.select("query_id", "symbol_id"), ["query_id", "symbol_id"], "left_anti").join(symbols.select("symbol_id", F.col("token_count").cast("long").alias("tokens")), "symbol_id")
    one = F.struct((-F.col("contribution")).alias("neg"), "symbol_id", "tokens", "reasons")
    lists = new.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("xs"))
    kind = "array<struct<symbol_id:bigint,fused_score:double,reasons:array<string>>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(tokens).cast("long").alias("left"))

    def step(s, x):
        full = (F.size(s["out"]) >= most) | (x["tokens"] > s["left"])
        item = F.struct(x["symbol_id"].alias("symbol_id"), (-x["neg"]).alias("fused_score"), x["reasons"].alias("reasons"))
        return F.when(full, s).otherwise(F.struct(F.concat(s["out"], F.array(item)).alias("out"), (s["left"] - x["tokens"]).alias("left")))

    added = lists.select("query_id", F.explode(F.aggregate("xs", start, step)["out"]).alias("x")).select("query_id", "x.*")
    return old.unionByName(added)


def rerank(candidates: DataFrame, queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """candidates with rerank_score: 0.05 for each query term in the qualified name, 0.1 for a symbol hit, 0.02 for each in the docstring."""
    q = queries.select("query_id", X.query_keys(F.col("question")).alias("q"))
    s = symbols.select("symbol_id", X.search_keys(F.split("qualified_name", r"\.")).alias("name"), X.query_keys(F.coalesce("docstring", F.lit(""))).alias("doc"))
    both = candidates.join(q, "query_id").join(s, "symbol_id")
    bonus = F.lit(0.05) * F.size(F.array_intersect("q", "name")) + F.when(F.array_contains("reasons", "symbol"), F.lit(0.1)).otherwise(F.lit(0.0)) + F.lit(0.02) * F.size(F.array_intersect("q", "doc"))
    return both.select(*candidates.columns, F.round(F.col("fused_score") + bonus, 12).alias("rerank_score"))


def hybrid(queries: DataFrame, symbols: DataFrame, edges: DataFrame | None = None, *, index: SearchIndex | None = None, semantic: bool = True, reranked: bool = False, top_n: int | None = None, many: bool = False) -> DataFrame:
    """(query_id, symbol_id, fused_score, reasons, rank[, rerank_score]): all retrievers fused, expanded, reranked, cut.

    With an index, terms and embeddings are read from it; without, it is built of the symbols first. many: the queries' number
    grows with the symbols', so pairs are scored within blocks.
    """
    index = index or build_index(symbols)
    hits = symbol_hits(queries, symbols).unionByName((lexical_hits_of_many if many else lexical_hits)(queries, index.lists))
    if semantic:
        hits = hits.unionByName((semantic_hits_of_many if many else semantic_hits)(queries, index.vectors))
    fused = materialize(fuse(hits), "fused")  # the expansion reads it four times
    out = expand(fused, edges, symbols) if edges is not None else fused.drop("pos")
    if reranked:
        out = rerank(out, queries, symbols)
    out = positions(out, "rerank_score" if reranked else "fused_score").withColumnRenamed("pos", "rank")
    return out.filter(F.col("rank") <= top_n) if top_n else out


def load(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """candidates with what packing needs of their symbols; the code itself stays out until the end."""
    cols = ("symbol_id", "qualified_name", "file_path", "start_line", "end_line", "token_count")
    return candidates.join(symbols.select(*cols), "symbol_id").withColumn("changed", F.lit(False))
