"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.shared_store import materialize

SALTS = 16
#: A line without such a character (anything but spaces, tabs and carriage returns) is blank.
SOLID = r"[^ \t\r]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line: two XXH64 with different seeds."""
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(7), line).alias("y"))


def boilerplate_lines(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = 0.1) -> DataFrame:
    """(host, x, y): key hashes of the lines on more than `ratio` of a host's pages.

    A line counts once a page, however often the page repeats it; a repeated row is a page of its own. A line of one page
    alone is no repetition, however few pages its host has.
    Blank lines, rows without host and rows without text give no line (but a row without text is a page of its host).
    The counts are pre-aggregated on each page and in each task. A host's page total meets its lines in SALTS
    shares, so that a host with a third of all pages isn't one task.
    """
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).filter("host is not null")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages")).select("host", "pages", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    kept = F.filter(_lines(F.col("text")), lambda x: x.rlike(SOLID))
    counts = (
        pages.select("host", F.explode(F.array_distinct(F.transform(kept, _key))).alias("k"))
        .groupBy("host", F.col("k.x").alias("x"), F.col("k.y").alias("y"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .withColumn("salt", F.pmod(F.col("x"), F.lit(SALTS)).cast("int"))
    )
    return counts.join(totals, ["host", "salt"]).filter(F.col("n") > F.lit(float(ratio)) * F.col("pages")).select("host", "x", "y")


def drop_boilerplate(docs: DataFrame, *, host: str = "source", text: str = "text", ratio: float = 0.1, count: str | None = None) -> DataFrame:
    """docs with the boilerplate lines of each host taken out of `text`; all other columns and rows stay.

    Null text stays null, null host keeps its text, empty text stays empty; a text of boilerplate alone becomes empty.
    Lines are parted by newline; blank lines (of spaces, tabs and carriage returns) are never dropped. Texts are read whole, and a long
    text costs time in proportion; its distinct lines are held once. `count` names a column for the number of dropped lines.
    A host's flagged keys are one row (fewer than lines per page / ratio of them). They are written out first, so that
    Spark knows their size: it broadcasts them only below its own limit, and else deals documents and rows out by
    host and salt.
    """
    flagged = (
        boilerplate_lines(docs, host=host, text=text, ratio=ratio)
        .groupBy("host")
        .agg(F.collect_list(F.struct("x", "y")).alias("__bad"))
        .select(F.col("host").alias("__host"), "__bad", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    )
    flagged = materialize(flagged, "boilerplate")
    salt = F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int")
    joined = docs.join(flagged, (docs[host] == flagged["__host"]) & (salt == flagged["__salt"]), "left")
    lines = _lines(F.col(text))
    bad = F.array_intersect(F.transform(lines, _key), F.col("__bad"))
    joined = joined.withColumn("__own", F.when(F.col("__bad").isNotNull() & F.col(text).isNotNull(), bad))
    some = F.size("__own") > 0
    left = F.filter(lines, lambda x: ~F.array_contains(F.col("__own"), _key(x)) | ~x.rlike(SOLID))
    cols = [F.when(some, F.array_join(left, "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns]
    if count:
        cols.append(F.when(some, F.size(lines) - F.size(left)).otherwise(F.lit(0)).cast("long").alias(count))
    return joined.select(*cols)
