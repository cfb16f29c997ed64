"""Operator 3: URL filters by a sort-merge range join, with DataFrame functions only.

A rule (host, path) becomes the canonical key of its host's labels in reverse, a mark that ends the host, and its path;
all urls that it fits have a key that starts with it, so the rule is an interval of keys.  A url has one key for each
suffix of its host that is as deep as some rule.  Rules nest or are disjoint, so a sorted sweep over interval starts,
urls and interval ends only needs a stack of active rules: its top after each start or end is worked out once for the
rules, and a running last value carries the top to the urls.

Keys of different hosts never nest, as the mark ends the host, so each host of the rules has sweeps of its own: as many
as its urls need, which are dealt to them by hash, and its rules' events go to each of them.  There may be any number of
rules; only hosts with urls and rules are swept.

Defined results: a null url, or one without ``://``, has empty host and path and takes the default verdict; a
rule fits its host and all subdomains where the url's path starts with the rule's; the longest rule wins, and
between rules of one length that of the longer host; of equal rules block wins; a rule with an empty path fits all paths of its host, one with an empty or null host
or a null path fits nothing; empty tables give empty tables;
repeated rows are judged each on their own; only the id and url columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: (action, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
#: Ends the host in a key; no host can hold it.
END = "#"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    there = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def suffix(labels: Column, depth: Column | int) -> Column:
    """The last ``depth`` labels of a host in reverse."""
    return F.array_join(F.slice(F.reverse(labels), 1, depth), ".")


def key(site: Column, path: Column) -> Column:
    """A reversed host, its end and a path, as bytes."""
    return F.encode(F.concat(site, F.lit(END), path), "UTF-8")


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A few rules as a DataFrame (``action``, ``host``, ``path``)."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(n) for n in ("action", "host", "path")))
    given = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("action", "host", "path"), rule))) for rule in rules))
    return spark.range(1).select(F.inline(given))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with key, site (the reversed host), depth and the text that names them."""
    labels = F.split(F.col("host"), r"\.", -1)
    named = rules.where("host <> '' and path is not null").select("action", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.size(labels).alias("depth"), suffix(labels, F.size(labels)).alias("site"), "path")
    # of equal rules block wins
    keyed = named.withColumn("key", key(F.col("site"), F.col("path"))).drop("path")
    return keyed.groupBy("rule", "host_length", "depth", "site", "key").agg(F.max("action").alias("action"))


def sweep_events(rules: DataFrame) -> DataFrame:
    """Starts and ends of the rules' intervals with the top of the stack after them.

    An end restores the rule around it: the deepest rule of its site whose key is a proper prefix of its own.
    """
    outer = rules.select(F.col("site").alias("outer_site"), F.col("key").alias("outer_key"), F.struct("rule", "host_length", "action").alias("outer_top"))
    at_least = F.octet_length(F.encode("site", "UTF-8")) + 1
    prefixes = rules.where(F.octet_length("key") > at_least).select("site", "key", F.explode(F.sequence(at_least, F.octet_length("key") - 1)).alias("n"))
    prefixes = prefixes.select("site", "key", F.expr("substring(key, 1, n)").alias("prefix"))
    around = prefixes.join(outer, (F.col("site") == F.col("outer_site")) & (F.col("prefix") == F.col("outer_key"))).groupBy("key").agg(F.max_by("outer_top", F.octet_length("prefix")).alias("around"))
    every = rules.join(around, "key", "left").select("site", "key", F.struct("rule", "host_length", "action").alias("own"), "around")
    nothing = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("host_length"), F.lit(None).cast("string").alias("action"))
    starts = every.select("site", F.col("key").alias("at"), F.lit(0).alias("kind"), F.octet_length("key").alias("depth_bytes"), F.col("own").alias("top"))
    # byte 255 never occurs in UTF-8: the end lies behind all keys that start with the rule's
    ends = every.select("site", F.concat("key", F.lit(b"\xff")).alias("at"), F.lit(2).alias("kind"), (-F.octet_length("key")).alias("depth_bytes"), F.coalesce("around", nothing).alias("top"))
    return starts.unionByName(ends)


def judge(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule`` and ``verdict`` of every row; ``rules`` may be a DataFrame of any size."""
    spark = pages.sparkSession
    given = rules if isinstance(rules, DataFrame) else rule_frame(spark, rules)
    table = materialize(rule_table(given.select("action", "host", "path")), "rules")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).select("id", host.alias("host"), path.alias("path"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    depths = [r["depth"] for r in table.select("depth").distinct().collect()]  # as many as hosts have labels
    labels = F.split(F.col("host"), r"\.", -1)
    deep = F.filter(F.array(*(F.lit(d) for d in depths)).cast("array<int>"), lambda d: d <= F.size("labels"))
    points = rows.where("host <> ''").withColumn("labels", labels).withColumn("depth", F.explode(deep)).select(suffix(F.col("labels"), F.col("depth")).alias("site"), "path", "row")
    # the sites that have both rules and urls, with as many sweeps as an even deal gives them
    sites = table.select("site").distinct()
    counts = materialize(points.join(sites, "site", "left_semi").groupBy("site").agg(F.count("*").alias("n")), "sites")
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = counts.select("site", F.ceil(F.col("n") / share).cast("int").alias("sweeps"))
    nothing = F.lit(None).cast("struct<rule:string,host_length:int,action:string>")
    own = points.join(dealt, "site").select("site", F.pmod(F.xxhash64("row"), F.col("sweeps")).cast("int").alias("sweep"), key(F.col("site"), F.col("path")).alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("depth_bytes"), nothing.alias("top"), "row")
    events = sweep_events(table).join(dealt, "site").withColumn("sweep", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1))).withColumn("row", F.lit(None).cast("long"))
    running = Window.partitionBy("site", "sweep").orderBy("at", "kind", "depth_bytes").rowsBetween(Window.unboundedPreceding, 0)
    swept = own.unionByName(events.select(*own.columns)).withColumn("active", F.last("top", ignorenulls=True).over(running))
    hits = swept.where((F.col("kind") == 1) & F.col("active.rule").isNotNull())
    best = hits.groupBy("row").agg(F.max_by(F.col("active"), F.struct(F.length("active.rule"), F.col("active.host_length"), F.col("active.action"))).alias("active"))
    return rows.join(best, "row", "left").select(F.col("id").alias(id_col), "host", "path", F.col("active.rule").alias("rule"), F.coalesce("active.action", F.lit(default)).alias("verdict"))
