"""URL filter as a sort-merge range join, in DataFrame operations only.

A rule (host, path, action) fits its host and every subdomain, if the url's path starts
with the rule's path; of the rules that fit, the longest (host and path together, then
host) wins. Reversed host labels, each ended by a dot, turn "host and its subdomains"
into an interval of keys: all keys with the rule's key as prefix. Rule paths come first
in the key: a url has one key for each rule path that its path starts with.

Intervals of prefixes nest. The sweep sorts the events "rule opens", "rule closes" and
"url" of all keys together; the top of the stack of active rules is, after an opening,
that rule, and after a closing, the rule that encloses it (its parent, found once by
joining rules on their own prefixes). So the innermost active rule at a url is the last
top before it. The sorted events are cut into key ranges; each range starts with the last
top of the ranges before it, of which there is one row for each range.

Defined results: a null url, or one without "://", has an empty host and path; repeated
urls and page ids are judged one by one; rules with a null part are ignored; of rules
with the same host and path the smallest action wins (allow before block); without a
rule the verdict is the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Stash

#: The stated rules: host, path, action (fixed values).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a url column; both empty without "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    known = F.coalesce(url.contains("://"), F.lit(False))
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def _host_key(host):
    """com.example.www. for www.example.com"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(events: DataFrame) -> DataFrame:
    """Adds ``top``: the innermost rule active at each event, by a sorted sweep.

    Two passes over ranges of keys: in each range the last top so far, then across ranges.
    """
    # urls of one key spread over ranges by their salt, so a hot url is no hot range
    ranged = Stash(
        events.repartitionByRange("path", "key", "kind", "salt").select("*", F.spark_partition_id().alias("range"))
    )
    inside = Window.partitionBy("range").orderBy("path", "key", "kind", "salt")
    # a top is a struct, so that "no rule active" differs from "no event yet"
    local = ranged.df.select("*", F.last("state", ignorenulls=True).over(inside).alias("seen"))
    ends = (
        ranged.df.where("state is not null")
        .groupBy("range")
        .agg(F.max_by("state", F.struct("path", "key", "kind", "salt")).alias("end"))
    )
    # one row for each range: the last top of all ranges before it
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.df.select("range").distinct()
        .join(ends, "range", "left")
        .select("range", F.last("end", ignorenulls=True).over(earlier).alias("carry"))
    )
    return local.join(F.broadcast(carried), "range").withColumn("top", F.coalesce("seen", "carry")["rule"])


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "host string, path string, action string")
    host, path = host_and_path(F.col("url").cast("string"))
    # written once: the row numbers must be the same wherever they are read
    urls = Stash(
        pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    ).df
    known = (
        rules.where("host is not null and path is not null and action is not null")
        .groupBy("host", "path")
        .agg(F.min("action").alias("action"))
        .select(
            F.col("path").alias("rule_path"),
            _host_key(F.col("host")).alias("rule_key"),
            F.struct(F.concat("host", "path").alias("rule"), F.col("action").alias("verdict"), F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size")).alias("rule"),
        )
    )
    # the enclosing rule: the longest other rule on the same path whose key is a prefix
    prefixes = known.select("rule_path", "rule_key", F.explode(F.expr("transform(filter(sequence(1, length(rule_key) - 1), i -> substring(rule_key, i, 1) = '.'), i -> substring(rule_key, 1, i))")).alias("prefix"))
    parents = (
        prefixes.join(known.select("rule_path", F.col("rule_key").alias("prefix"), F.col("rule").alias("above")), ["rule_path", "prefix"])
        .groupBy("rule_path", "rule_key")
        .agg(F.max_by("above", F.length("prefix")).alias("above"))
    )
    nested = known.join(parents, ["rule_path", "rule_key"], "left")
    empty = F.lit(None).cast("long")
    opens = nested.select(
        F.col("rule_path").alias("path"), F.col("rule_key").alias("key"), F.lit(0).alias("kind"), F.length("rule_key").cast("long").alias("salt"),
        F.struct("rule").alias("state"), empty.alias("row"),
    )
    # "/" follows ".": past every key with this prefix; of closings on one key the innermost comes first
    closes = nested.select(
        F.col("rule_path").alias("path"), F.concat(F.expr("substring(rule_key, 1, length(rule_key) - 1)"), F.lit("/")).alias("key"), F.lit(-1).alias("kind"), (-F.length("rule_key")).cast("long").alias("salt"),
        F.struct(F.col("above").alias("rule")).alias("state"), empty.alias("row"),
    )
    starts = known.select(F.col("rule_path").alias("path"), F.length("rule_path").alias("n")).distinct()
    lengths = [r.n for r in starts.select("n").distinct().collect()]  # a few numbers, at most the longest rule path
    fits = (
        urls.select("row", "host", "path", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("n"))
        .where("length(path) >= n")
        .select("row", "host", F.expr("substring(path, 1, n)").alias("path"))
        .join(starts.select("path"), "path")
    )
    asked = fits.select(
        "path", _host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.xxhash64("row").alias("salt"),
        F.lit(None).cast(opens.schema["state"].dataType).alias("state"), "row",
    )
    swept = _sweep(opens.unionByName(closes).unionByName(asked))
    # a url has at most one top for each rule path it starts with; the longest wins
    best = (
        swept.where("row is not null and top is not null")
        .groupBy("row")
        .agg(F.max_by("top", F.struct("top.size", "top.host_size", "top.rule")).alias("top"))
    )
    return urls.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rule_host, rule_path, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""
