"""python -m sparkloom STORE COMMAND ...: index, search, context, symbol, eval, analyze, metrics, doctor, migrate."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sparkloom.engine import Engine
from sparkloom.sources import reports


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("store", help="folder of the tables")
    p.add_argument("--repo")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index")
    x.add_argument("path")
    x.add_argument("--incremental", action="store_true")
    for name in ("search", "context", "symbol", "relationships"):
        sub.add_parser(name).add_argument("text")
    x = sub.add_parser("eval")
    x.add_argument("cases", help="JSON list of {question, expected_symbols}")
    x = sub.add_parser("analyze")
    x.add_argument("report", help="lines of path TAB line TAB code TAB message")
    for name in ("metrics", "queries", "doctor", "status", "migrate"):
        sub.add_parser(name)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    e = Engine(spark, a.store)
    if a.command == "migrate":
        print("schema", e.store.version())
    elif a.command == "index":
        print(e.index(a.path, a.repo, incremental=a.incremental))
    elif a.command == "context":
        print(e.context(a.text, a.repo).first()["prompt"])
    else:
        from pyspark.sql import functions as F

        df = {
            "search": lambda: e.search(a.text, a.repo).select("rank", "qualified_name", "file_path", "start_line", "token_count", "fused_score", "reasons"),
            "symbol": lambda: e.symbol(a.text, a.repo),
            "relationships": lambda: e.relationships(a.text, a.repo),
            "eval": lambda: e.evaluate(reports.read_cases(spark, a.cases), a.repo),
            "analyze": lambda: e.fix(reports.tab_findings(spark.read.text(a.report), "value").withColumn("finding_id", F.xxhash64("file_path", "line", "code", "message")), a.repo),
            "metrics": e.metrics,
            "queries": e.recent,
            "doctor": e.diagnose,
            "status": lambda: e.status(a.repo),
        }[a.command]()
        df.show(100, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
