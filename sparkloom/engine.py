"""The library's front: index repositories, search, pack context, ask, and look at what it cost."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions import text as X
from sparkloom.functions.parse import parse_files
from sparkloom.operators import doctor, evaluate, findings, index, pack, retrieve, telemetry
from sparkloom.providers import Authorization, Everyone, LanguageModel, NoModel
from sparkloom.shared_store import materialize
from sparkloom.sources import files as scan
from sparkloom.sources.store import Store

MODEL, MODEL_VERSION = "hash", "2"


class RepositoryNotFound(LookupError):
    pass


class AmbiguousRepository(LookupError):
    pass


#: Stands for the commit of an index that holds changes which no commit has.
DIRTY = "uncommitted"


class Engine:
    """One store, one user. Queries run in batches: a list of questions is one plan keyed by query_id."""

    def __init__(self, spark: SparkSession, folder: str, *, user: str | None = None, authorization: Authorization | None = None, model: LanguageModel | None = None):
        self.spark, self.store, self.user = spark, Store(spark, folder), user
        self.authorization, self.model = authorization or Everyone(), model or NoModel()
        self.store.create()

    # --- repositories

    def repositories(self) -> DataFrame:
        r = self.store.read("repositories")
        allowed = self.authorization.allowed(self.user)
        return r if allowed is None else r.filter(F.col("repository_id").isin(list(allowed)))

    def register(self, name: str, **fields) -> int:
        """The id of a repository; it is put in, or its fields are taken over, by name."""
        old = materialize(self.store.read("repositories"), "repositories")
        new = self.spark.createDataFrame([(name, *map(str, fields.values()))], "name string" + "".join(f", {k} string" for k in fields))
        now = F.current_timestamp()
        new = new.withColumns({"repository_id": F.xxhash64("name"), "updated_at": now})
        new = new.join(old.select("name", F.col("created_at").alias("__c")), "name", "left").withColumn("created_at", F.coalesce("__c", now)).drop("__c")
        self.store.overwrite("repositories", index.upsert(old, new, "name"))
        return new.first()["repository_id"]

    def resolve(self, name: str | None = None) -> int:
        """The repository of a name, or the only one there is."""
        r = self.repositories()
        found = r.filter(F.col("name") == name) if name else r
        rows = found.select("repository_id", "name").orderBy("name").limit(20).collect()
        if not rows:
            raise RepositoryNotFound(f"no repository named {name!r}" if name else "no repositories indexed yet")
        if len(rows) > 1:
            raise AmbiguousRepository("several repositories, name one of: " + ", ".join(x["name"] for x in rows))
        return rows[0]["repository_id"]

    # --- indexing

    def index(self, path: str, name: str | None = None, *, incremental: bool = False, extra: Sequence[str] = ()) -> dict:
        """Index the files below path. In a git repository ignored files are left out.

        Incrementally, git tells what differs from the commit that was indexed last, and other files aren't read; if that commit
        is unknown or gone, all is indexed. Without git, or after a run over changes that weren't committed (they may have been taken
        back since, of which git knows nothing), files whose content differs from what is stored are indexed anew.
        """
        began = time.time()
        rid = self.register(name or path.rstrip("/").rsplit("/", 1)[-1], local_path=path)
        told = None
        if incremental and scan.head(path):
            base = self.store.read("repositories").filter(F.col("repository_id") == rid).select("indexed_commit_sha").first()[0]
            if base != DIRTY:
                told = scan.changed_since(self.spark, path, base, self.store.read("source_files", [rid]))
                incremental = told is not None
        mode = "incremental" if incremental else "full"
        try:
            stats = self._index(rid, path, incremental, extra, told)
        except Exception as e:
            self._log(rid, mode, "failed", began, error=str(e)[:2000])
            raise
        self._log(rid, mode, "completed", began, head_commit=scan.head(path), **stats)
        if sha := scan.head(path):
            self.register(name or path.rstrip("/").rsplit("/", 1)[-1], indexed_commit_sha=sha if scan.clean(path) else DIRTY)
        return {"repository_id": rid, **stats}

    def _log(self, rid: int, mode: str, status: str, began: float, **more) -> None:
        row = {"repository_id": rid, "mode": mode, "status": status, "duration_ms": 1000 * (time.time() - began)} | {k: v for k, v in more.items() if v is not None}
        df = self.spark.createDataFrame([tuple(row.values())], list(row)).withColumns({"created_at": F.current_timestamp(), "run_id": F.xxhash64(F.uuid())})
        self.store.append("indexing_runs", df)

    def _index(self, rid: int, path: str, incremental: bool, extra: Sequence[str], told: DataFrame | None = None) -> dict:
        if told is not None:
            told = materialize(told.filter(paths.should_index(F.col("path"), extra)), "told")
            walked = scan.read_listed(told.filter("op != 'D'").select("path", F.lit(-1).cast("long").alias("size")), path).filter("content is not null")
        else:
            walked = scan.scan_walk(self.spark, path, extra=extra)
            if scan.head(path):
                walked = walked.join(scan.scan_git(self.spark, path), "path", "left_semi")
        found = walked.select("path", F.col("size").alias("size_bytes"), scan.read_text(F.col("content")).alias("raw")).filter("raw is not null")
        clean, count, _ = paths.redact(F.col("raw"))
        found = found.select("path", "size_bytes", F.sha2("raw", 256).alias("content_hash"), clean.alias("text"), count.alias("redactions"))
        current = materialize(found, "scan")
        files = current.select(F.lit(rid).cast("long").alias("repository_id"), "path", paths.language_of(F.col("path")).alias("language"), "content_hash", "size_bytes", X.token_count(F.col("text")).alias("token_count"))
        gone_files = gone_symbols = 0
        if incremental:
            old = {t: materialize(self.store.read(t, [rid]), t) for t in ("source_files", "symbols", "raw_edges")}
            if told is not None:
                # Files that git doesn't speak of are as they were; what it tells without a change of content is no change.
                files = index.without(old["source_files"], told).unionByName(files, allowMissingColumns=True)
            changed = materialize(index.changes(old["source_files"], files), "changes")
            # A modified file is taken out and put in anew.
            left, kept, numbers = index.delete_files(old["source_files"], old["symbols"], changed)
            gone_files, gone_symbols = numbers.first()
            work = current.join(changed.filter("op != 'D'").select("path"), "path", "left_semi")
            raw_kept = old["raw_edges"].join(changed.select(F.col("path").alias("file_path")), "file_path", "left_anti")
        else:
            work = current
        symbols, raw = index.symbols_from(materialize(parse_files(work), "parsed"), rid)
        if incremental:
            symbols, raw = kept.unionByName(symbols), raw_kept.unionByName(raw)
        symbols, raw = materialize(symbols, "symbols"), materialize(raw, "raw")
        edges = materialize(index.resolve_edges(symbols, raw), "edges")
        have = self.store.read("symbol_embeddings", [rid])
        have = materialize(have.join(symbols.select("symbol_id", "source_hash"), ["symbol_id", "source_hash"], "left_semi"), "embeddings")
        repository = self.store.read("repositories").filter(F.col("repository_id") == rid).select(F.lit(rid).cast("long").alias("repository_id"), F.col("name").alias("__repository"))
        wanted = index.stale(symbols, have, MODEL, MODEL_VERSION).join(F.broadcast(repository), "repository_id")
        said = X.embedding_input(*map(F.col, ("__repository", "file_path", "qualified_name", "symbol_type", "signature", "docstring", "source_code")))
        fresh = materialize(index.embed(wanted.withColumn("__said", said), model=MODEL, version=MODEL_VERSION, terms="__said"), "embedded")
        for table, df in (("source_files", files), ("symbols", symbols), ("raw_edges", raw), ("symbol_relationships", edges), ("symbol_embeddings", have.unionByName(fresh))):
            self.store.replace(table, df, rid)
        red = work.agg(F.coalesce(F.sum("redactions"), F.lit(0))).first()[0]
        return {"files": work.count(), "symbols": symbols.count(), "files_deleted": gone_files, "symbols_deleted": gone_symbols, "redactions": red}

    def scoped(self, table: str, repository: str | None = None) -> DataFrame:
        """A table of one repository that the user may read: no retrieval sees another's rows."""
        return self.store.read(table, [self.resolve(repository)])

    # --- retrieval

    def _search_index(self, rid: int) -> retrieve.SearchIndex:
        own = self.store.read("symbol_embeddings", [rid]).filter((F.col("embedding_model") == MODEL) & (F.col("embedding_version") == MODEL_VERSION))
        return retrieve.stored_index(self.store.read("symbols", [rid]), own)

    def _queries(self, questions: str | Sequence[str], rid: int) -> DataFrame:
        many = [questions] if isinstance(questions, str) else list(questions)
        return self.spark.createDataFrame([(i, rid, q) for i, q in enumerate(many)], "query_id long, repository_id long, question string")

    def search(self, questions: str | Sequence[str], repository: str | None = None, *, limit: int = 10, graph: bool = True, semantic: bool = True, reranked: bool = False) -> DataFrame:
        rid = self.resolve(repository)
        s, e = self.store.read("symbols", [rid]), self.store.read("symbol_relationships", [rid])
        found = retrieve.hybrid(self._queries(questions, rid), s, e if graph else None, index=self._search_index(rid), semantic=semantic, reranked=reranked, top_n=limit)
        cols = ("symbol_id", "symbol_name", "qualified_name", "symbol_type", "file_path", "start_line", "end_line", "token_count", "signature")
        return found.join(s.select(*cols), "symbol_id").orderBy("query_id", "rank")

    def context(self, questions: str | Sequence[str], repository: str | None = None, *, max_tokens: int | None = None, mode: str = "context", record: bool = True) -> DataFrame:
        """One row for each question: its prompt and what the packing found, took and saved."""
        began = time.time()
        rid = self.resolve(repository)
        s, e, q = self.store.read("symbols", [rid]), self.store.read("symbol_relationships", [rid]), self._queries(questions, rid)
        ranked = materialize(retrieve.load(retrieve.hybrid(q, s, e, index=self._search_index(rid)), s), "ranked")
        picked = materialize(pack.pack_context(ranked, max_tokens=max_tokens), "picked")
        books = pack.accounting(ranked, picked, self.store.read("source_files", [rid]).select(F.col("path").alias("file_path"), "token_count"))
        out = materialize(pack.render_prompt(q, picked, s).join(q.select("query_id", "question"), "query_id").join(books, "query_id", "left"), "context")
        if record:
            return self._record(rid, mode, out, ranked, picked, 1000 * (time.time() - began))
        return out

    def _record(self, rid: int, mode: str, out: DataFrame, ranked: DataFrame, picked: DataFrame, ms: float) -> DataFrame:
        """out with recorded_id, under which each query and its results are in the store."""
        batch = F.lit(f"{time.time_ns()}")
        own = lambda: F.xxhash64(batch, F.col("query_id"))
        q = out.withColumns({"recorded_id": own(), "repository_id": F.lit(rid).cast("long"), "query_text": F.col("question"), "mode": F.lit(mode), "latency_ms": F.lit(ms), "created_at": F.current_timestamp()})
        self.store.append("queries", q.drop("query_id").withColumnRenamed("recorded_id", "query_id").fillna(0))
        took = picked.select("query_id", "symbol_id", F.lit(True).alias("selected"))
        rows = ranked.join(took, ["query_id", "symbol_id"], "left").select(own().alias("query_id"), "symbol_id", "rank", F.col("fused_score").alias("score"), "reasons", F.coalesce("selected", F.lit(False)).alias("selected"))
        self.store.append("retrieval_results", rows)
        return out.withColumn("recorded_id", own())

    def ask(self, question: str, repository: str | None = None, *, max_tokens: int | None = None, answer_tokens: int = 1024) -> dict:
        """Pack, ask the language model, and record its use, also if it fails."""
        row = self.context(question, repository, max_tokens=max_tokens, mode="ask").first()
        began, error, answer, usage = time.time(), None, None, None
        try:
            answer, usage = self.model.generate(row["prompt"], answer_tokens)
            return {"answer": answer, "query_id": row["recorded_id"], "context_tokens": row["context_tokens"], "input_tokens": usage.input_tokens, "output_tokens": usage.output_tokens}
        except Exception as e:
            error = str(e)[:2000]
            raise
        finally:
            u = usage
            data = (row["recorded_id"], self.model.name, u and u.input_tokens, u and u.output_tokens, u and u.cached_input_tokens, u and u.cache_creation_input_tokens, 1000 * (time.time() - began), error is None, error)
            schema = "query_id long, model string, input_tokens long, output_tokens long, cached_input_tokens long, cache_creation_input_tokens long, latency_ms double, success boolean, error string"
            self.store.append("llm_requests", self.spark.createDataFrame([data], schema).withColumns({"created_at": F.current_timestamp(), "request_id": F.xxhash64(F.uuid())}))

    def symbol(self, name: str, repository: str | None = None) -> DataFrame:
        s = self.scoped("symbols", repository)
        return findings.lookup(s, self.spark.createDataFrame([(name,)], "name string")).join(s, "symbol_id")

    def relationships(self, name: str, repository: str | None = None) -> DataFrame:
        s = self.scoped("symbols", repository)
        asked = findings.lookup(s, self.spark.createDataFrame([(name,)], "name string")).filter("symbol_id is not null")
        return findings.relationships(self.scoped("symbol_relationships", repository), s, asked)

    def fix(self, found: DataFrame, repository: str | None = None, *, max_tokens: int | None = None) -> DataFrame:
        """The context of each analyzer finding (finding_id, file_path, line)."""
        return findings.fix_context(found, self.scoped("symbols", repository), self.scoped("symbol_relationships", repository), index=self._search_index(self.resolve(repository)), max_tokens=max_tokens)

    # --- what it cost

    def metrics(self) -> DataFrame:
        names = ("repositories", "source_files", "symbols", "symbol_relationships")
        return telemetry.metrics(self.store.read("queries"), self.store.read("llm_requests"), {n: self.store.read(n) for n in names})

    def recent(self, limit: int = 100) -> DataFrame:
        return telemetry.recent_queries(self.store.read("queries"), self.repositories().select("repository_id", F.col("name").alias("repository")), self.store.read("llm_requests"), limit)

    def status(self, repository: str | None = None) -> DataFrame:
        return telemetry.latest_by(self.store.read("indexing_runs", [self.resolve(repository)]), "repository_id", F.desc("created_at"), F.desc("run_id"))

    def diagnose(self) -> DataFrame:
        return doctor.diagnose(self.store.read("llm_requests"), self.store.read("queries").count(), "created_at", "request_id")

    def evaluate(self, cases: DataFrame, repository: str | None = None) -> DataFrame:
        """Recall and MRR of cases (question, expected_symbols), recorded as a run."""
        rid = self.resolve(repository)
        c = materialize(cases.withColumns({"query_id": F.xxhash64("question"), "repository_id": F.lit(rid).cast("long")}).dropDuplicates(["query_id"]), "cases")
        s = self.store.read("symbols", [rid])
        ranked = retrieve.hybrid(c.select("query_id", "repository_id", "question"), s, self.store.read("symbol_relationships", [rid]), index=self._search_index(rid)).join(s.select("symbol_id", "qualified_name"), "symbol_id")
        expected = c.select("query_id", F.explode("expected_symbols").alias("expected"))
        out = materialize(evaluate.recall(evaluate.first_hit_rank(c, ranked, expected)), "recall")
        self.store.append("evaluation_runs", out.withColumns({"repository_id": F.lit(rid).cast("long"), "run_id": F.xxhash64(F.uuid()), "created_at": F.current_timestamp(), "config": F.to_json(F.struct(F.lit(MODEL).alias("embedding_model"), F.lit(True).alias("graph")))}))
        return out
