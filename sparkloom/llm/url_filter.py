"""URL rules whose decisions also hold for redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import connected_components
from sparkloom.shared_store import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'>\s]+)"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'>\s]+)"""
AMP = "(?i)&(amp|#38|#x26);"
WITH_HOST = "^[A-Za-z][A-Za-z0-9+.-]*://"
#: A scheme without host, or a place on the page itself.
NO_LINK = "^([A-Za-z][A-Za-z0-9+.-]*:|#)"

#: (verdict, rule): the rule's host is what stands before its first slash.
Rules = Sequence[tuple[str, str]]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What makes two URLs the same place: host, path and query, without scheme and fragment; null without ://."""
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(tail == "", F.lit("/")).otherwise(tail)))


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none; of rules of one length the allowing comes first."""
    rule = verdict = None
    for says, name in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1])):
        own, _, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(name)) if rule is None else rule.when(fits, F.lit(name))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _relative(to: Column, base: Column) -> Column:
    """Path and query of a link without leading slash, taken on from the path of the page it is on; . and .. are steps."""
    merged = F.concat(F.regexp_extract(base, r"(?s)^.*/", 0), F.regexp_extract(to, r"^[^?#]*", 0))
    steps = F.split(F.regexp_replace(merged, "^/", ""), "/", -1)
    none = F.array().cast("array<string>")
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    done = F.aggregate(steps, none, lambda d, x: F.when(x == "..", up(d)).when(x == ".", d).otherwise(F.concat(d, F.array(x))))
    end = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(done) > 0), F.lit("/")).otherwise(F.lit(""))
    path = F.when(F.substring(to, 1, 1).isin("?", "#"), base).otherwise(F.concat(F.lit("/"), F.array_join(done, "/"), end))
    return F.concat(path, F.regexp_extract(to, r"^[^?#]*(.*)$", 1))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes joined by a canonical link or a refresh; links that name no host are taken on the page's own, those
    without leading slash from the page's path. &amp; in a link is &; links of schemes without // and bare fragments lead nowhere."""

    steps = pages.select(F.col(url).alias("u"), F.array(*(F.regexp_extract(F.regexp_extract(F.col(html), t, 0), a, 1) for t, a in ((CANONICAL, HREF), (REFRESH, TARGET)))).alias("to"))
    steps = steps.select("u", F.explode("to").alias("to")).filter("to != ''").withColumn("host", host_of(F.col("u")))
    steps = steps.withColumn("to", F.regexp_replace("to", AMP, "&"))
    site = F.concat(F.lit("http://"), "host")
    whole = F.when(F.col("to").rlike(WITH_HOST), F.col("to")).when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).when(F.col("to").startswith("/"), F.concat(site, "to"))
    base = path_of(F.col("u"))
    base = F.when(base == "", F.lit("/")).otherwise(base)
    whole = whole.when(~F.col("to").rlike(NO_LINK), F.concat(site, _relative(F.col("to"), base)))
    steps = steps.withColumn("to", whole).filter("to is not null").distinct()
    return steps.select(node_of(F.col("u")).alias("a"), node_of(F.col("to")).alias("b")).filter("a is not null and b is not null and a != b")


def judge_urls(pages: DataFrame, rules: Rules, redirects: DataFrame | None = None, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict, propagated) for each row of pages.

    A URL with a rule takes the rule's verdict. Any other takes that of its aliases (the component over redirects, given
    as columns `src` and `dst`, canonical links and refreshes): allow if a rule allows one of them, else block if
    a rule blocks one of them, else allow. Rules are a short list that comes with the job, not data. Null URLs, and
    those without ://, have no host, path, rule or alias and are allowed. Repeated rows are judged each.
    """
    rows = pages.select(F.col(key), F.col(url).alias("__url"))
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")))
    edges = materialize(edges.distinct(), "aliases")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    member = nodes.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    place = F.concat(F.lit("x://"), F.col("node"))
    member = member.withColumns({"host": host_of(place), "path": path_of(place)})
    member = member.withColumn("said", rule_of(F.col("host"), F.col("path"), rules)[1])
    says = member.groupBy("component").agg(F.max(F.when(F.col("said") == "allow", 1)).alias("allowed"), F.max(F.when(F.col("said") == "block", 1)).alias("blocked"))
    says = says.filter("blocked = 1 and allowed is null").select("component")
    blocked = member.join(says, "component", "left_semi").select(F.col("node").alias("__node"), F.lit(True).alias("__hit"))
    host, path = host_of(F.col("__url")), path_of(F.col("__url"))
    rows = rows.withColumns({"host": host, "path": path, "__node": node_of(F.col("__url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    passed_on = verdict.isNull() & F.col("__hit").isNotNull()
    return rows.join(blocked, "__node", "left").select(
        key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(passed_on, F.lit("block")), F.lit("allow")).alias("verdict"), passed_on.alias("propagated")
    )
