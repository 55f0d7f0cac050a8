"""Tables written to the folder that driver and executors share, to cut lineage durably."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder of our own only where it is unset and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="sparkloom-"))
    return named.rstrip("/")


def materialize(df: DataFrame, label: str = "t", compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparkloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more: what was made of them must have been written out."""
    for t in tables:
        _drop(t.sparkSession, t._stored_at)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already when the process ends
        return
