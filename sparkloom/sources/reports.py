"""Reports of analyzers, and sets of evaluation cases, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tab_findings(lines: DataFrame, column: str = "line") -> DataFrame:
    """(file_path, line, code, message) of lines `path TAB row TAB code TAB text`; lines with other fields are dropped."""
    f = F.split(F.col(column), "\t", -1)
    rest = [c for c in lines.columns if c != column]
    ok = lines.withColumn("__f", f).filter((F.size("__f") == 4) & F.col("__f")[1].rlike("^ *[0-9]+ *$"))
    return ok.select(*rest, F.col("__f")[0].alias("file_path"), F.trim(F.col("__f")[1]).cast("long").alias("line"), F.col("__f")[2].alias("code"), F.col("__f")[3].alias("message"))


def json_findings(reports: DataFrame, column: str = "report") -> DataFrame:
    """(file_path, line, code, message) of reports that are JSON lists; what can't be read gives no row."""
    item = "array<struct<path:string,line:bigint,symbol:string,`message-id`:string,message:string>>"
    rest = [c for c in reports.columns if c != column]
    x = reports.select(*rest, F.explode(F.from_json(column, item)).alias("x")).filter("x is not null and x.path is not null")
    return x.select(*rest, F.col("x.path").alias("file_path"), F.coalesce("x.line", F.lit(0)).alias("line"), F.coalesce(F.col("x.symbol"), F.col("x.message-id")).alias("code"), F.col("x.message").alias("message"))


def cases_of(reports: DataFrame, column: str = "body") -> DataFrame:
    """(question, expected_symbols) of JSON lists of cases."""
    item = "array<struct<question:string,expected_symbols:array<string>>>"
    rest = [c for c in reports.columns if c != column]
    return reports.select(*rest, F.explode(F.from_json(column, item)).alias("x")).select(*rest, "x.question", "x.expected_symbols")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON file that is one list."""
    return spark.read.schema("question string, expected_symbols array<string>").json(path, multiLine=True)
