"""The symbol store as set operations: ids, edges between files, changes, stale embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions import text as X


def keep_strongest(edges: DataFrame) -> DataFrame:
    """Of each (source, target, type) the edge of the highest confidence; max is pre-aggregated in the tasks."""
    rest = [c for c in edges.columns if c not in ("source_symbol_id", "target_symbol_id", "relationship_type", "confidence")]
    return edges.groupBy("source_symbol_id", "target_symbol_id", "relationship_type", *rest).agg(F.max("confidence").alias("confidence"))


def symbol_id(repository, path, qualified, line, local):
    """An id that stays as long as the file does."""
    return F.xxhash64(repository, path, qualified, line, local)


def symbols_from(parsed: DataFrame, repository_id: int) -> tuple[DataFrame, DataFrame]:
    """(symbols, raw edges) of parsed files, under ids that follow from the content."""
    rid = F.lit(repository_id).cast("long")
    first = Window.partitionBy("file_path")
    own = F.struct("local_id", symbol_id(rid, F.col("file_path"), F.col("qualified_name"), F.col("start_line"), F.col("local_id")).alias("id"))
    p = parsed.withColumns({"repository_id": rid, "symbol_id": own["id"], "__ids": F.map_from_entries(F.collect_list(own).over(first))})  # a file's symbols
    p = p.withColumn("parent_symbol_id", F.element_at("__ids", F.col("parent_local_id"))).drop("__ids")
    symbols = p.select(
        "repository_id", "symbol_id", "parent_symbol_id", "file_path", paths.language_of(F.col("file_path")).alias("language"), "symbol_name", "qualified_name", "symbol_type", "signature", "docstring", "start_line", "end_line",
        "source_code", X.content_hash(F.col("source_code")).alias("source_hash"), X.token_count(F.col("source_code")).alias("token_count"), F.array_join("search_terms", " ").alias("search_document"),
    )
    raw = p.select("repository_id", F.col("symbol_id").alias("source_symbol_id"), "file_path", F.explode("edges").alias("e")).select("repository_id", "source_symbol_id", "file_path", "e.*")
    return symbols, raw


def resolve_edges(symbols: DataFrame, raw: DataFrame, *, contains: bool = True) -> DataFrame:
    """(repository_id, source_symbol_id, target_symbol_id, relationship_type, confidence).

    A raw edge's target_name is looked up in its repository: as a qualified name (of equal ones the largest id); else, if
    called via self, as the only symbol of that name under the source's parent; else as the only symbol of that name. The
    rest, and loops, are dropped. A call from a test is also a TESTS edge, of 0.8 at most. Names are counted before the
    joins, so each lookup is an equi-join with one row for each name.
    """
    s = symbols.select("repository_id", "symbol_id", F.lower("symbol_name").alias("name"), F.lower("qualified_name").alias("qualified"), "parent_symbol_id", paths.is_test_symbol(F.col("symbol_name"), F.col("file_path")).alias("is_test"))
    quals = s.groupBy("repository_id", F.col("qualified").alias("k")).agg(F.max("symbol_id").alias("by_qualified"))
    under = s.groupBy("repository_id", F.col("name").alias("k"), F.col("parent_symbol_id").alias("p")).agg(F.count("*").alias("n"), F.max("symbol_id").alias("by_parent")).filter("n = 1").drop("n")
    names = s.groupBy("repository_id", F.col("name").alias("k")).agg(F.count("*").alias("n"), F.max("symbol_id").alias("by_name")).filter("n = 1").drop("n")
    source = s.select("repository_id", F.col("symbol_id").alias("source_symbol_id"), F.col("parent_symbol_id").alias("source_parent"), "is_test")
    r = raw.join(source, ["repository_id", "source_symbol_id"]).withColumns({"__q": F.lower("target_name"), "__n": F.substring_index(F.lower("target_name"), ".", -1)})
    r = r.join(quals.withColumnRenamed("k", "__q"), ["repository_id", "__q"], "left").join(names.withColumnRenamed("k", "__n"), ["repository_id", "__n"], "left").alias("r")
    meets = (F.col("r.repository_id") == F.col("u.repository_id")) & (F.col("r.__n") == F.col("u.k")) & F.col("r.source_parent").eqNullSafe(F.col("u.p"))
    r = r.join(under.alias("u"), meets, "left").select("r.*", "by_parent")
    target = F.coalesce("by_qualified", F.when(F.col("via") == "self", F.col("by_parent")), "by_name")
    cols = ["repository_id", "source_symbol_id", "target_symbol_id", "relationship_type", "confidence"]
    found = r.withColumn("target_symbol_id", target).filter("target_symbol_id is not null and target_symbol_id != source_symbol_id")
    tests = F.when((F.col("relationship_type") == "CALLS") & F.col("is_test"), F.array("relationship_type", F.lit("TESTS"))).otherwise(F.array("relationship_type"))
    found = found.withColumn("__kind", F.explode(tests))
    found = found.withColumns({"confidence": F.when((F.col("__kind") == "TESTS") & (F.col("relationship_type") == "CALLS"), F.least("confidence", F.lit(0.8))).otherwise(F.col("confidence")), "relationship_type": F.col("__kind")}).select(*cols)
    if contains:
        nested = symbols.filter("parent_symbol_id is not null").select("repository_id", F.col("parent_symbol_id").alias("source_symbol_id"), F.col("symbol_id").alias("target_symbol_id"), F.lit("CONTAINS").alias("relationship_type"), F.lit(1.0).alias("confidence"))
        found = found.unionByName(nested)
    return keep_strongest(found).select(*cols)


def changes(previous: DataFrame, current: DataFrame, *, path: str = "path", digest: str = "content_hash") -> DataFrame:
    """(path, op): A, M or D between two states of a repository's files; what is alike gives no row."""
    p, c = previous.select(path, F.col(digest).alias("__old")), current.select(path, F.col(digest).alias("__new"))
    op = F.when(F.col("__old").isNull(), "A").when(F.col("__new").isNull(), "D").when(F.col("__old") != F.col("__new"), "M")
    return p.join(c, path, "full_outer").select(path, op.alias("op")).filter("op is not null")


def without(rows: DataFrame, changed: DataFrame, *, path: str = "path") -> DataFrame:
    """The rows of files that no change touches."""
    return rows.join(changed.select(path).distinct(), path, "left_anti")


def incremental(previous: DataFrame, current: DataFrame, changed: DataFrame, *, path: str = "path") -> DataFrame:
    """previous with what changed taken out, and put in anew from current where it is still there."""
    fresh = current.join(changed.filter("op != 'D'").select(path).distinct(), path, "left_semi")
    return without(previous, changed, path=path).unionByName(fresh)


def stale(symbols: DataFrame, embeddings: DataFrame, model: str, version: str) -> DataFrame:
    """The symbols that have no embedding of this model and version and of their present code."""
    have = embeddings.filter((F.col("embedding_model") == model) & (F.col("embedding_version") == version)).select("symbol_id", "source_hash")
    return symbols.join(have, ["symbol_id", "source_hash"], "left_anti").select(*symbols.columns)


def embed(symbols: DataFrame, *, model: str = "hash", version: str = "1", terms: str = "search_document") -> DataFrame:
    """Sparse hash embeddings as rows of the embeddings table."""
    from sparkloom.functions import vectors as V

    vector = V.embedding(X.query_keys(F.col(terms))).cast("array<struct<bucket:int,value:double>>")
    # An explode, as a filter would form the vector twice.
    x = symbols.select("repository_id", "symbol_id", "source_hash", F.explode(F.filter(F.array(vector), lambda v: F.size(v) > 0)).alias("embedding"))
    return x.select("repository_id", "symbol_id", "source_hash", F.lit(model).alias("embedding_model"), F.lit(version).alias("embedding_version"), F.lit(V.DIM).alias("embedding_dimension"), "embedding")


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with those of new put in or taken over where they aren't null; new has some of the columns of rows, each key once."""
    both = rows.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    take = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")
    return both.select(*(take(c).alias(c) for c in rows.columns))


def delete_files(files: DataFrame, symbols: DataFrame, gone: DataFrame, *, path: str = "path", symbol_path: str = "file_path") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files left, symbols left, one row with the numbers of files and symbols that went)."""
    keys = gone.select(F.col(path).alias("__p")).distinct()
    n_files = files.join(keys, files[path] == keys["__p"], "left_semi").agg(F.count("*").alias("files_deleted"))
    n_symbols = symbols.join(keys, symbols[symbol_path] == keys["__p"], "left_semi").agg(F.count("*").alias("symbols_deleted"))
    return files.join(keys, files[path] == keys["__p"], "left_anti"), symbols.join(keys, symbols[symbol_path] == keys["__p"], "left_anti"), n_files.crossJoin(n_symbols)
