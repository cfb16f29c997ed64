"""Queries over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import diff, evaluation, facts, findings, rules, runs, structure, tables
from tessera.streaming import events as streams


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fact_final_value(spark: SparkSession, sf: str) -> DataFrame:
    """Order priorities stand for levels: the first level with a value gives each customer's final one."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice", F.col("o_orderkey").alias("ord"))
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return facts.final_value(orders, ["o_custkey"], levels, "o_orderpriority", "o_orderstatus", "o_totalprice", "ord")


FACT_FINAL_VALUE = """
with b as (select o_custkey, o_orderpriority as level, o_orderstatus as value, row_number() over (partition by o_custkey order by o_orderpriority, o_totalprice desc, o_orderkey) as n from orders where o_orderstatus is not null)
select o_custkey, value, level from b where n = 1
"""


def best_fact(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's line of the largest discount, ties to the earliest order."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return facts.best_of(rows, ["l_suppkey"], "l_shipdate", "l_discount", "ord").select("l_suppkey", F.col("l_shipdate").alias("ship_date"), "l_discount", "n_sources")


BEST_FACT = """
select l_suppkey, arg_max(l_shipdate, struct_pack(d := l_discount, o := -(l_orderkey * 10 + l_linenumber))) as ship_date, max(l_discount) as l_discount, count(*) as n_sources from lineitem group by 1
"""


def synopsis_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("canonical", F.col("l_returnflag"))
    return facts.synopsis_mismatch(rows, ["l_orderkey"], F.col("l_linenumber") == 1)


SYNOPSIS_MISMATCH = """
with s as (select l_orderkey, list(distinct l_returnflag) filter (l_linenumber = 1) as s, list(distinct l_returnflag) filter (l_linenumber <> 1) as b from lineitem group by 1)
select l_orderkey, coalesce(len(b), 0) > 0 and len(list_filter(coalesce(s, []), lambda x: not list_contains(b, x))) > 0 as mismatch from s
"""


def run_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Mean event value by type: even days as the second run against odd ones."""
    rows = table(spark, sf, "events").withColumn("run", F.dayofmonth("ts") % 2)
    means = rows.groupBy("run", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return evaluation.delta(means.where("run = 1"), means.where("run = 0"), "event_type", "mean")


RUN_DELTA = """
with m as (select day(ts) % 2 as run, event_type, round(avg(value), 6) as mean from events group by 1, 2)
select event_type, a.mean as before, b.mean as after, round(b.mean - a.mean, 6) as delta from (select * from m where run = 1) a full join (select * from m where run = 0) b using (event_type)
"""


def histogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("value is not null")
    bin_of = F.least(F.floor(F.col("value") / 20), F.lit(4)).cast("long")
    return rows.groupBy("event_type", bin_of.alias("bin")).agg(F.count("*").alias("n"))


HISTOGRAM_BINS = "select event_type, least(floor(value / 20), 4)::bigint as bin, count(*) as n from events where value is not null group by 1, 2"


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders")
    old = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("value"))
    new = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("value"))
    return old, new


def diff_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return diff.diff_values(old, new, "o_orderkey", "value")


DIFF_FULL_OUTER = """
with a as (select o_orderkey, o_orderstatus as value from orders where o_orderkey % 7 <> 0), b as (select o_orderkey, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end as value from orders where o_orderkey % 5 <> 0)
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' when a.value is not distinct from b.value then 'unchanged' else 'modified' end as change, a.value as old_value, b.value as new_value
from a full join b on a.o_orderkey = b.o_orderkey
"""


def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diff_full_outer(spark, sf).groupBy("change").agg(F.count("*").alias("n"))


DIFF_SUMMARY = f"select change, count(*) as n from ({DIFF_FULL_OUTER}) group by 1"


def _sections(spark: SparkSession, sf: str, old: bool) -> DataFrame:
    """Parts as the sections of a document (brand) in two versions; titles and standard sections repeat."""
    title = F.concat_ws(" ", "p_name", (F.col("p_size") % 7).cast("string"))
    standard = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("#", "p_type", (F.col("p_size") % 9).cast("string")))
    rows = table(spark, sf, "part").where("p_partkey % 4 < 2" if old else "p_partkey % 5 <> 0")
    content = F.concat("p_type", F.when(F.lit(not old) & (F.col("p_partkey") % 13 == 0), "!").otherwise(""))
    return rows.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").cast("long").alias("ord"), F.concat(F.lit("1.2 " if old else ""), title).alias("title"), standard.alias("standard"), content.alias("content"))


def diff_or_match(spark: SparkSession, sf: str) -> DataFrame:
    return diff.diff_sections(_sections(spark, sf, True), _sections(spark, sf, False))


#: The new sections that nobody matched are taken in order, and only rows that were given out before block one.
DIFF_OR_MATCH = r"""
with recursive p as (select p_brand as doc_id, p_partkey::bigint as ord, p_name || ' ' || (p_size % 7) as title, case when p_partkey % 3 = 0 then p_type || '#' || (p_size % 9) end as standard, p_type as content from part),
a as (select * replace ('1.2 ' || title as title) from p where ord % 4 < 2),
b as (select * replace (content || case when ord % 13 = 0 then '!' else '' end as content) from p where ord % 5 <> 0),
m as (select a.doc_id, a.ord as old_ord, min(b.ord) as new_ord from a join b on a.doc_id = b.doc_id and (a.standard = b.standard or trim(regexp_replace(lower(a.title), '^\d+(\.\d+)*\s*', ''), ' ') = trim(regexp_replace(lower(b.title), '^\d+(\.\d+)*\s*', ''), ' ')) group by 1, 2),
d as (select a.doc_id, case when m.new_ord is null then 'removed' when a.content = b.content then 'unchanged' else 'modified' end as change, coalesce(b.title, a.title) as title, coalesce(a.standard, b.standard) as standard, a.ord as old_ord, m.new_ord
  from a left join m on m.doc_id = a.doc_id and m.old_ord = a.ord left join b on b.doc_id = a.doc_id and b.ord = m.new_ord),
f as (select *, row_number() over (partition by doc_id order by ord) as k from b where (doc_id, ord) not in (select doc_id, new_ord from m)),
s(doc_id, k, titles, standards, ord, title, standard) as (
  select doc_id, 0::bigint, coalesce((select list(title) from d where d.doc_id = x.doc_id), []), coalesce((select list(standard) from d where d.doc_id = x.doc_id and standard is not null), []), null::bigint, null::varchar, null::varchar from (select distinct doc_id from b) x
  union all
  select s.doc_id, f.k, case when list_contains(titles, f.title) or coalesce(list_contains(standards, f.standard), false) then titles else list_append(titles, f.title) end,
    case when f.standard is null or list_contains(titles, f.title) or list_contains(standards, f.standard) then standards else list_append(standards, f.standard) end,
    case when not (list_contains(titles, f.title) or coalesce(list_contains(standards, f.standard), false)) then f.ord end, f.title, f.standard
  from s join f on f.doc_id = s.doc_id and f.k = s.k + 1)
select doc_id, change, title, standard, old_ord, new_ord from d union all select doc_id, 'added', title, standard, null, ord from s where ord is not null
"""


def rule_version_diff(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    new = part.where("p_partkey % 9 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).otherwise(F.col("p_size")))
    return rules.version_diff(part.where("p_partkey % 8 <> 0"), new, "p_partkey", ["p_brand", "p_size"])


RULE_VERSION_DIFF = """
with a as (select p_partkey, p_brand, p_size from part where p_partkey % 8 <> 0), b as (select p_partkey, p_brand, case when p_partkey % 4 = 0 then null else p_size end as p_size from part where p_partkey % 9 <> 0)
select coalesce(a.p_partkey, b.p_partkey) as p_partkey, case when a.p_partkey is null then 'added' when b.p_partkey is null then 'removed' when a.p_brand is not distinct from b.p_brand and a.p_size is not distinct from b.p_size then 'unchanged' else 'modified' end as change from a full join b on a.p_partkey = b.p_partkey
"""


def impact_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Changed orders touch what their priority maps to; orders differ in up to eight parts."""
    changes = diff_full_outer(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    mapping = {"1-URGENT": ["visits", "procedures"], "2-HIGH": ["risks"], "5-LOW": []}
    found = diff.impact(changes, mapping, section="o_orderpriority", parts=F.col("o_orderkey") % 9)
    return found.groupBy("change", "impacted", "severity", "requires_update").agg(F.count("*").alias("n"))


IMPACT_EXPLODE = f"""
with m(section, impacted) as (values ('1-URGENT', 'visits'), ('1-URGENT', 'procedures'), ('2-HIGH', 'risks'))
select change, impacted, case when change = 'removed' or o_orderkey % 9 > 5 then 'high' else 'medium' end as severity, change = 'removed' or o_orderkey % 9 > 5 as requires_update, count(*) as n
from ({DIFF_FULL_OUTER}) d join orders using (o_orderkey) join m on m.section = o_orderpriority where change <> 'unchanged' group by 1, 2, 3, 4
"""


_PATTERNS = (("BRASS", 1.0), ("STEEL", 2.0), ("ANODIZED", 3.0), ("TIN", 0.5), ("ECONOMY", 4.0), ("PROMO", 5.0))


def longest_pattern_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Cost of lines by the longest price pattern that the part's type contains, with a total."""
    prices = spark.createDataFrame([(i, *p) for i, p in enumerate(_PATTERNS)], "ord int, pattern string, price double")
    parts = findings.longest_pattern(table(spark, sf, "part").select("p_partkey", "p_type"), prices, "p_type", "pattern", "ord")
    priced = parts.join(prices, "pattern", "left")
    rows = table(spark, sf, "lineitem").join(priced, F.col("l_partkey") == F.col("p_partkey"))
    cost = F.round(F.sum(F.col("l_quantity") * F.coalesce("price", F.lit(0.0))), 2)
    rolled = rows.rollup("l_returnflag").agg(cost.alias("cost"), F.count_if(F.col("price").isNull()).alias("n_unpriced"), F.count("*").alias("n"))
    return rolled.select(F.coalesce("l_returnflag", F.lit("total")).alias("level"), "cost", "n_unpriced", "n")


LONGEST_PATTERN_COST = """
with p(ord, pattern, price) as (values (0, 'BRASS', 1.0), (1, 'STEEL', 2.0), (2, 'ANODIZED', 3.0), (3, 'TIN', 0.5), (4, 'ECONOMY', 4.0), (5, 'PROMO', 5.0)),
m as (select p_partkey, arg_min(price::double, -length(pattern) * 100 + ord) as price from part left join p on contains(p_type, pattern) group by 1)
select coalesce(l_returnflag, 'total') as level, round(sum(l_quantity * coalesce(price, 0.0)), 2) as cost, count(*) filter (price is null) as n_unpriced, count(*) as n from lineitem join m on l_partkey = p_partkey group by rollup(l_returnflag)
"""

_KEYS = ("ECONMY", "MEDIUMS", "STANDRD", "PROMOO", "SMALL", "SMALLER", "LARG")


def fuzzy_key(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of a few known keys within three edits."""
    kinds = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    near = F.array_min(F.filter(F.array(*(F.struct(F.levenshtein("p_type", F.lit(k)).cast("long").alias("d"), F.lit(k).alias("key")) for k in _KEYS)), lambda x: x["d"] <= 3))
    return kinds.select("p_type", "n", near["key"].alias("key"), near["d"].alias("distance"))


FUZZY_KEY = f"""
with k(key) as (values {', '.join(f"('{k}')" for k in _KEYS)}), t as (select p_type, count(*) as n from part group by 1),
d as (select p_type, key, levenshtein(p_type, key) as d, row_number() over (partition by p_type order by levenshtein(p_type, key), key) as r from t cross join k where levenshtein(p_type, key) <= 3)
select t.p_type, n, key, d as distance from t left join d on d.p_type = t.p_type and r = 1
"""


def registry_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as a registry: those without orders appear as not found."""
    counted = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    registry = table(spark, sf, "customer").select("c_custkey")
    both = registry.join(counted, F.col("c_custkey") == F.col("o_custkey"), "full")
    return both.select(F.coalesce("c_custkey", "o_custkey").alias("key"), F.when(F.col("o_custkey").isNull(), "not_found").otherwise("found").alias("status"), F.coalesce("n", F.lit(0)).alias("n"), "total")


REGISTRY_FULL_OUTER = """
with o as (select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1)
select coalesce(c_custkey, o_custkey) as key, case when o_custkey is null then 'not_found' else 'found' end as status, coalesce(n, 0) as n, total from customer full join o on c_custkey = o_custkey
"""


def semi_some(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    customers = table(spark, sf, "customer")
    return customers.join(urgent, customers["c_custkey"] == urgent["o_custkey"], "left_semi").select("c_custkey", "c_name")


SEMI_SOME = "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')"


def anti_none(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    customers = table(spark, sf, "customer")
    return customers.join(urgent, customers["c_custkey"] == urgent["o_custkey"], "left_anti").select("c_custkey", "c_name")


ANTI_NONE = "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')"


def tenant_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Lines resolve their region over order, customer and nation."""
    region = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    owners = table(spark, sf, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("tenant_id"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(owners, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("tenant_id").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


TENANT_CHAIN = """
select r_name as tenant_id, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1
"""


def findings_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return findings.histograms(table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"), {"o_orderpriority": "info", "o_orderstatus": "other"})


FINDINGS_GROUPING_SETS = """
select case when grouping(p) = 0 then 'o_orderpriority' when grouping(s) = 0 then 'o_orderstatus' else 'total' end as dimension, case when grouping(p) = 0 then p when grouping(s) = 0 then s end as bucket, count(*) as n
from (select coalesce(o_orderpriority, 'info') as p, coalesce(o_orderstatus, 'other') as s from orders) group by grouping sets ((p), (s), ())
"""


def correction_mining(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumnRenamed("event_id", "ord")
    return findings.mine_corrections(rows, ["event_type", "props"], 40)


CORRECTION_MINING = "select event_type, props, count(*) as frequency, min(event_id) as first_ord, count(*) >= 40 as recommended from events group by 1, 2"


def dedup_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's order of each status with the best priority."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return findings.keep_best(rows, ["o_custkey"], key, [F.asc("o_orderpriority"), F.asc("o_orderkey")])


DEDUP_KEEP_BEST = """
select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderpriority, o_orderkey) as n from orders where o_orderstatus <> 'P') where n = 1
union all select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'P' or o_orderstatus is null
"""


def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page behind a cursor; the page's size is the feature."""
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return findings.page(rows, [("o_orderpriority", False), ("o_totalprice", True), ("o_orderkey", False)], ("2-HIGH", 200000.0, 0), 51)


KEYSET_PAGE = """
select o_orderpriority, o_totalprice, o_orderkey from orders where o_orderpriority > '2-HIGH' or (o_orderpriority = '2-HIGH' and (o_totalprice < 200000 or (o_totalprice = 200000 and o_orderkey > 0)))
order by o_orderpriority, o_totalprice desc, o_orderkey limit 51
"""


def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's latest order and the date of the one before."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    ranked = rules.prioritised(orders.withColumn("previous", F.expr("lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey)")), ["o_custkey"], F.desc("o_orderdate"), [F.desc("o_orderkey")])
    return ranked.select("o_custkey", "o_orderkey", "o_orderdate", "previous")


LATEST_VERSION = """
select o_custkey, o_orderkey, o_orderdate, previous from (select *, lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1
"""


def rate_limit_sliding(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.sliding_count(table(spark, sf, "events"), "user_id", "ts", 3600)
    return found.select("event_id", "user_id", "in_window", (F.col("in_window") > 2).alias("limited"))


RATE_LIMIT_SLIDING = "select event_id, user_id, n as in_window, n > 2 as limited from (select *, count(*) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as n from events)"


def stale_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose last event is old at the end of the stream have stale runs."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    rows = last.withColumn("status", F.when(F.col("kind") == "error", "failed").otherwise("running"))
    return runs.stale(rows, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")).select("user_id", "updated_at", "status")


STALE_RUNS = """
with l as (select user_id, max(ts) as updated_at, arg_max(event_type, struct_pack(t := ts, e := event_id)) as kind from events group by 1)
select user_id, updated_at, case when kind = 'error' then 'failed' when updated_at < timestamp '2024-01-30 00:00:00' - interval 5 minute then 'failed' else 'running' end as status from l
"""


def run_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_states(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", ["purchase"], ["error"])


RUN_STATE_FOLD = """
select user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) as last_event, count(*) as n_events, count(*) filter (event_type = 'purchase') as n_completed, count(*) filter (event_type = 'error') as n_failed from events group by 1
"""


def rect_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as cells and drawings: box sides from quantity and line number."""
    rows = table(spark, sf, "lineitem")
    box = (F.col("l_linenumber") * 10).cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("l_quantity").alias("w")
    key = F.col("l_orderkey").alias("table_id")
    cells = rows.select(key, F.col("l_linenumber").alias("cell_id"), *box[:2], F.lit(10.0).alias("w"), F.lit(5.0).alias("h"))
    drawings = rows.select(key, F.col("l_linenumber").alias("drawing_id"), *box, F.lit(4.0).alias("h"))
    return runs.overlap_cells(drawings, cells)


RECT_OVERLAP = """
with r as (select l_orderkey as table_id, l_linenumber as n, l_linenumber * 10.0::double as x, l_quantity as w from lineitem),
o as (select d.table_id, d.n as drawing_id, c.n as cell_id, round(((least(d.x + d.w, c.x + 10) - greatest(d.x, c.x)) * 4.0) / 50.0, 6) as share, d.x as dx, d.w as dw, c.x as cx from r d join r c on d.table_id = c.table_id where d.x < c.x + 10 and c.x < d.x + d.w)
select table_id, drawing_id, cell_id, share from o where ((least(dx + dw, cx + 10) - greatest(dx, cx)) * 4.0) / 50.0 >= 0.6
"""


def continuation_offsets(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "orders").join(sizes, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "n")
    return structure.running_offsets(rows, "o_custkey", "o_orderkey", "n")


CONTINUATION_OFFSETS = """
with s as (select l_orderkey, count(*) as n from lineitem group by 1)
select o_custkey, o_orderkey, n, coalesce(sum(n) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as offset from orders join s on o_orderkey = l_orderkey
"""


def upsert_versions(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return tables.upsert(old, new, ["o_orderkey"])


UPSERT_VERSIONS = """
with a as (select o_orderkey, o_orderstatus as value from orders where o_orderkey % 7 <> 0), b as (select o_orderkey, case when o_orderkey % 11 = 0 then 'X' else o_orderstatus end as value from orders where o_orderkey % 5 <> 0)
select o_orderkey, value from b union all select o_orderkey, value from a where o_orderkey not in (select o_orderkey from b)
"""


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each table when one nation's customers go."""
    named = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem")}
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    kept = tables.cascade(named, links, "customer", F.col("c_nationkey") == 7)
    parts = [kept[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CASCADE_DELETE = """
with c as (select c_custkey from customer where c_nationkey is distinct from 7), o as (select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 7))
select 'customer' as name, count(*) as n from c union all select 'orders', count(*) from o union all select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders join customer on o_custkey = c_custkey where c_nationkey = 7)
"""


def active_version(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's dearest order becomes the only active one."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.lit(True).alias("active"))
    best = F.expr("row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)") == 1
    return tables.exactly_one(rows.withColumn("_b", best), "o_custkey", "o_orderkey", "active", F.col("_b")).select("o_custkey", "o_orderkey", "active")


ACTIVE_VERSION = "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1 as active from orders"


RENAMED = {"SMALL": "LARGE", "PROMO": "SALE", "LARGE": "BIG"}


def _keyed_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Part types as keys, alone and as the beginning of longer ones, in a column, in JSON and in a comment."""
    longer = F.concat("p_type", F.when(F.col("p_partkey") % 4 == 0, "_X").otherwise(""))
    gap = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise("")
    field = F.when(F.col("p_partkey") % 5 == 0, "zone").otherwise("standardSection")
    return table(spark, sf, "part").select("p_partkey", longer.alias("section"), F.concat(F.lit('{"'), field, F.lit('":'), gap, F.lit('"'), longer, F.lit('"}')).alias("results"), F.concat(F.lit("was "), longer, F.lit(" "), F.upper("p_name")).alias("comment"))


def key_rename(spark: SparkSession, sf: str) -> DataFrame:
    """Renamed keys, the third of which is the name that the first gets; longer keys stay, but for comments."""
    return tables.rename_keys(_keyed_parts(spark, sf), RENAMED, ["section"], ["results"], ["comment"])


_KEYED = """k as (select p_partkey, p_type || case when p_partkey % 4 = 0 then '_X' else '' end as t, case when p_partkey % 3 = 0 then ' ' else '' end as gap, case when p_partkey % 5 = 0 then 'zone' else 'standardSection' end as field, upper(p_name) as name from part)"""
KEY_RENAME = f"""
with {_KEYED}, n as (select *, case t when 'SMALL' then 'BIG' when 'LARGE' then 'BIG' when 'PROMO' then 'SALE' else t end as renamed from k)
select p_partkey, renamed as section, '{{"' || field || '":' || gap || '"' || case when field = 'standardSection' then renamed else t end || '"}}' as results,
  replace(replace(replace('was ' || t || ' ' || name, 'SMALL', 'BIG'), 'LARGE', 'BIG'), 'PROMO', 'SALE') as comment from n
"""


def key_rename_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the renaming would touch."""
    return tables.rename_counts(_keyed_parts(spark, sf), RENAMED, ["section"], ["results"], ["comment"])


KEY_RENAME_COUNTS = f"""
with {_KEYED}, o as (select unnest(['SMALL', 'PROMO', 'LARGE']) as old_key)
select 'section' as field, old_key, count(*) filter (starts_with(t, old_key)) as n from k cross join o group by all
union all select 'results', old_key, count(*) filter (field = 'standardSection' and t = old_key) from k cross join o group by all
union all select 'comment', old_key, count(*) filter (contains(t || ' ' || name, old_key)) from k cross join o group by all
"""


def json_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.where("k >= 5").groupBy("event_type", "k").agg(F.count("*").alias("n"))


JSON_PATH_FILTER = "select event_type, (props->>'$.k')::bigint as k, count(*) as n from events where (props->>'$.k')::bigint >= 5 group by 1, 2"


def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return tables.broken_keys(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


DUPLICATE_KEYS = "select l_partkey, l_suppkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1"


def severity_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Two severity maps and the declared order over order priorities."""
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "Major").when(F.col("o_orderpriority") == "3-MEDIUM", "minor").otherwise("none")
    rows = table(spark, sf, "orders").select(raw.alias("raw"))
    mapped = rows.select(T.severity_intra(F.col("raw")).alias("intra"), T.severity_inter(F.col("raw")).alias("inter"))
    return mapped.withColumn("rank", T.severity_rank(F.col("intra")).cast("long")).groupBy("intra", "inter", "rank").agg(F.count("*").alias("n"))


SEVERITY_MAPS = """
with r as (select case o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'major' when '3-MEDIUM' then 'minor' else 'none' end as raw from orders),
m as (select case raw when 'critical' then 'high' when 'major' then 'medium' when 'minor' then 'low' else 'medium' end as intra, case raw when 'major' then 'high' when 'minor' then 'medium' else 'info' end as inter from r)
select intra, inter, list_position(['critical', 'high', 'medium', 'low', 'info'], intra)::bigint as rank, count(*) as n from m group by 1, 2, 3
"""


def tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    return streams.tumbling(table(spark, sf, "events"), "1 day")


TUMBLING_WINDOW = "select event_type, date_trunc('day', ts)::timestamp as start, count(*) as n, round(sum(value), 6) as total from events group by 1, 2"


def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(table(spark, sf, "events"), "2 hours")


SESSION_WINDOWS = """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, min(ts) as start, max(ts) as last, count(*) as n from s group by user_id, s
"""

QUERIES = {f.__name__: f for f in (fact_final_value, best_fact, synopsis_mismatch, run_delta, histogram_bins, diff_full_outer, diff_summary, diff_or_match, rule_version_diff, impact_explode, longest_pattern_cost, fuzzy_key, registry_full_outer, semi_some, anti_none, tenant_chain, findings_grouping_sets, correction_mining, dedup_keep_best, keyset_page, latest_version, rate_limit_sliding, stale_runs, run_state_fold, rect_overlap, continuation_offsets, upsert_versions, cascade_delete, active_version, key_rename, key_rename_counts, json_path_filter, duplicate_keys, severity_maps, tumbling_window, session_windows)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
