"""From documents to training sequences: five stages, each one of the operators in sparkloom.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, langid, line_dedup, packing, similar
from sparkloom.shared_store import materialize
from sparkloom.tables import table


# Of all stages: null, empty and very long texts are read whole and judged like others, repeated rows each, an empty table stays empty, and
# columns besides those named here pass through, whatever their names. What a stage says of one of these cases follows.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language claims with 0.35 of the probability go; mixed ones stay. Null, empty and letterless texts go."""
    return langid.drop_rejected(docs, least=0.35)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; n_chars follows the text.

    Null text stays null, a document without source keeps its text, a text of such lines alone becomes empty.
    """
    out = line_dedup.drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word Jaccard similarity 0.8 or more join, the one of the smallest doc_id stays.

    Texts without a word, null ones too, are equal. Of rows of one doc_id one stays; rows without doc_id stay all.
    """
    return similar.keep_first_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, up to a fifth of its words edited, go. Null and empty texts hold none; an
    empty benchmark takes nothing away."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised rest in sequences of 2048 ids: one row for each piece; a null or empty text is its closing id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizer and network are no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
