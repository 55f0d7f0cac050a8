"""Usage counters out of recorded responses: whole JSON bodies and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"


def usage_of(body: Column) -> Column:
    """A struct of the counters in a response body; nulls if it can't be read."""
    return F.from_json(body, f"struct<model:string,usage:{USAGE}>", {"mode": "PERMISSIVE"})["usage"]


def fold_events(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, events, model, input, cache and output tokens) of streams given as rows (keys, seq, line).

    Lines begin with `data:`. The start of a message sets model, input and cache counters, deltas the output, of which
    the last counts; lines that can't be read are passed over.
    """
    shape = f"struct<type:string,message:struct<model:string,usage:{USAGE}>,usage:{USAGE}>"
    e = lines.filter(F.col("line").startswith("data:")).select(*keys, "seq", F.from_json(F.trim(F.substring(F.col("line"), F.lit(6), F.length("line"))), shape).alias("e")).filter("e.type is not null")
    start = F.when(F.col("e.type") == "message_start", F.col("seq"))
    delta = F.when((F.col("e.type") == "message_delta") & F.col("e.usage.output_tokens").isNotNull(), F.col("seq"))
    first = lambda c: F.max_by(F.col(f"e.message.{c}"), start)
    return e.groupBy(*keys).agg(
        F.count("*").alias("events"), first("model").alias("model"), first("usage.input_tokens").alias("input_tokens"), first("usage.cache_read_input_tokens").alias("cached_input_tokens"),
        first("usage.cache_creation_input_tokens").alias("cache_creation_input_tokens"), F.max_by(F.col("e.usage.output_tokens"), delta).alias("output_tokens"),
    )


def fold_demo(conversations: DataFrame) -> DataFrame:
    """Conversations as streams: even turns start messages, odd ones are deltas."""
    start = F.concat(F.lit('data: {"type":"message_start","message":{"model":"m","usage":{"input_tokens":'), F.length("text"), F.lit("}}}"))
    delta = F.concat(F.lit('data: {"type":"message_delta","usage":{"output_tokens":'), F.length("text"), F.lit("}}"))
    lines = conversations.select("conv_id", F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, start).otherwise(delta).alias("line"))
    return fold_events(lines, "conv_id").select("conv_id", "events", "input_tokens", "output_tokens")
