"""Queries that run as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.streaming import rollup


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_rollup(spark, d):
    t = rollup.hourly(spark, f"{d}/events.parquet", uuid.uuid4().hex)
    return t.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
