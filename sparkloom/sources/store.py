"""The tables of an engine as Parquet: schemas, partitions by repository, appends, and a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
SCHEMAS = {
    "repositories": "repository_id long, name string, url string, local_path string, default_branch string, indexed_commit_sha string, created_at timestamp, updated_at timestamp",
    "source_files": "repository_id long, path string, language string, content_hash string, size_bytes long, token_count long",
    "symbols": """repository_id long, symbol_id long, parent_symbol_id long, file_path string, language string, symbol_name string, qualified_name string, symbol_type string, signature string, docstring string,
start_line long, end_line long, source_code string, source_hash string, token_count long, search_document string""",
    "raw_edges": "repository_id long, source_symbol_id long, file_path string, relationship_type string, target_name string, via string, confidence double",
    "symbol_relationships": "repository_id long, source_symbol_id long, target_symbol_id long, relationship_type string, confidence double",
    "symbol_embeddings": "repository_id long, symbol_id long, source_hash string, embedding_model string, embedding_version string, embedding_dimension int, embedding array<struct<bucket:int,value:double>>",
    "indexing_runs": "run_id long, repository_id long, mode string, status string, base_commit string, head_commit string, files long, symbols long, files_deleted long, symbols_deleted long, redactions long, error string, duration_ms double, created_at timestamp",
    "queries": "query_id long, repository_id long, query_text string, mode string, candidates_found long, candidates_selected long, candidate_tokens long, context_tokens long, dropped_tokens long, baseline_tokens long, baseline_files long, latency_ms double, created_at timestamp",
    "retrieval_results": "query_id long, symbol_id long, rank long, score double, reasons array<string>, selected boolean",
    "llm_requests": """request_id long, query_id long, model string, requested_model string, input_tokens long, output_tokens long, cached_input_tokens long, cache_creation_input_tokens long, tool_result_chars long, tool_schema_chars long,
token_lean_active boolean, terse_applied boolean, cap_applied boolean, compression_chars_saved long, latency_ms double, success boolean, error string, created_at timestamp""",
    "evaluation_runs": "run_id long, repository_id long, n_cases long, recall_at_1 double, recall_at_3 double, recall_at_5 double, recall_at_10 double, mrr double, avg_context_tokens double, config string, created_at timestamp",
}
PARTITIONED = ("source_files", "symbols", "raw_edges", "symbol_relationships", "symbol_embeddings")


class Store:
    """Tables below one folder, in any store that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def version(self) -> int:
        """The version of the stored schema; 0 if there is none yet."""
        at = self._path("_version")
        return int(self.spark.read.text(at).first()[0]) if self._exists(at) else 0

    def create(self) -> int:
        """Write the version where it is missing; a newer one than ours is an error."""
        have = self.version()
        if have > VERSION:
            raise ValueError(f"the store has schema {have}, this library knows {VERSION}")
        if have < VERSION:
            self.spark.createDataFrame([(str(VERSION),)], "v string").coalesce(1).write.mode("overwrite").text(self._path("_version"))
        return VERSION

    def read(self, name: str, repositories: list[int] | None = None) -> DataFrame:
        """A table, empty if nothing was written; `repositories` prunes partitions."""
        schema, at = SCHEMAS[name], self._path(name)
        df = self.spark.read.schema(schema).parquet(at) if self._exists(at) else self.spark.createDataFrame([], schema)
        if repositories is not None:
            df = df.filter(F.col("repository_id").isin([int(r) for r in repositories]))
        return df

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))

    def replace(self, name: str, df: DataFrame, repository_id: int) -> None:
        """Put df in the place of a repository's partition; df must not read that partition lazily."""
        at = self._path(name)
        own = f"{at}/repository_id={int(repository_id)}"
        self._shaped(name, df).drop("repository_id").write.mode("overwrite").parquet(own)

    def overwrite(self, name: str, df: DataFrame) -> None:
        self._shaped(name, df).write.mode("overwrite").parquet(self._path(name))

    def append(self, name: str, df: DataFrame) -> None:
        self._shaped(name, df).write.mode("append").parquet(self._path(name))
