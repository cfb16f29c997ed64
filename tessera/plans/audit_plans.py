"""Queries of the audit, scoring and schedule operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import findings as FF
from tessera.operators import audit, schedules, structure
from tessera.plans.finding_plans import pick, sql_pick


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def editorial_checks(spark: SparkSession, sf: str) -> DataFrame:
    # line ends as wide spaces, as the tables have no others
    found = table(spark, sf, "documents").select("lang", F.explode(FF.editorial(F.replace("text", F.lit("\n"), F.lit("  ")))).alias("c"))
    return found.groupBy("lang", F.col("c.kind").alias("kind"), F.col("c.severity").alias("severity")).agg(F.count("*").alias("n"))


EDITORIAL_CHECKS = r"""
with c as (select lang, unnest([case when contains(replace(text, chr(10), '  '), '  ') then 'double_space' end,
  case when len(regexp_extract_all(lower(text), '\b(will|shall)\b')) > 2 and len(regexp_extract_all(lower(text), '\b(was|were|has been)\b')) > 2 then 'mixed_tense' end,
  case when regexp_matches(lower(text), '\[(tbd|insert|placeholder|todo)\]') then 'placeholder' end]) as kind from documents)
select lang, kind, case kind when 'double_space' then 'low' when 'mixed_tense' then 'medium' else 'high' end as severity, count(*) as n from c where kind is not null group by 1, 2
"""


def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as evaluation results: priority is the stage, status the outcome."""
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").otherwise("error")
    part = F.when(F.col("o_orderstatus") != "P", F.pmod("o_orderkey", F.lit(101)) / 100.0)
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), status.alias("status"), part.alias("precision"), (part / 2).alias("recall"), (part / 4).alias("f1"), F.pmod("o_custkey", F.lit(50)).alias("latency"), (F.pmod("o_orderkey", F.lit(7)) / 8).alias("cost"))
    return audit.stage_metrics(rows)


STAGE_METRICS = """
with r as (select o_orderpriority as stage, o_orderstatus as s, case when o_orderstatus <> 'P' then (o_orderkey % 101) / 100.0::double end as p, o_custkey % 50 as latency, (o_orderkey % 7) / 8 as cost from orders)
select stage, count(*) as total, count(*) filter (s = 'F') as passed, count(*) filter (s = 'O') as failed, round(count(*) filter (s = 'F') / count(*), 6) as pass_rate,
  round(avg(p), 6) as avg_precision, round(avg(p / 2), 6) as avg_recall, round(avg(p / 4), 6) as avg_f1, round(avg(latency), 6) as avg_latency, round(sum(cost), 6) as cost from r group by 1
"""


def tuning_stats(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "incorrect").otherwise("skipped")
    rating = F.substring("o_orderpriority", 1, 1).cast("int")
    return audit.tuning_stats(table(spark, sf, "orders").select("o_custkey", verdict.alias("verdict"), rating.alias("rating")), "o_custkey")


TUNING_STATS = f"""
select o_custkey, count(*) as total, count(*) filter (o_orderstatus = 'F') as correct, count(*) filter (o_orderstatus = 'O') as incorrect, round(avg(substr(o_orderpriority, 1, 1)::int), 2) as mean_rating,
  {', '.join(f"count(*) filter (substr(o_orderpriority, 1, 1) = '{n}') as rating_{n}" for n in range(1, 6))} from orders group by 1
"""


def disagreement_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of parts as two classifiers."""
    rows = table(spark, sf, "part").select("p_brand", F.substring("p_name", 1, 1).alias("algo_section"), F.substring(F.lower("p_type"), 1, 1).alias("llm_section"), F.when(F.col("p_size") > 25, "resolved_llm").alias("classified_by"))
    return audit.disagreements(rows).groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if("resolved").alias("n_resolved"), F.round(F.count_if("resolved") / F.count("*"), 6).alias("rate"))


DISAGREEMENT_RATES = """
select p_brand, count(*) as n, count(*) filter (p_size > 25) as n_resolved, round(count(*) filter (p_size > 25) / count(*), 6) as rate from part where substr(p_name, 1, 1) <> substr(lower(p_type), 1, 1) group by 1
"""


_CELL_VALUES = ("X", "✓", " + ", "–", "-", "", " ", "v", "5 ML", "x", " x ")


def schedule_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Users' events of the month's first half as expected schedules, of the second as detected ones: visits in several
    spellings, cells with ticks and dashes, corrected cells, and footnotes of which some lack a visit."""
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("first", F.dayofmonth("ts") <= 15)
    visit = F.concat(F.when(F.col("event_id") % 11 == 0, "VISIT ").otherwise("Visit "), F.col("k") % 6)
    item = rows.select("user_id", "event_id", "first", F.col("event_type").alias("procedure"), visit.alias("visit"), pick("k", *_CELL_VALUES).alias("value"), F.when(F.col("event_id") % 7 == 0, pick("event_id", *_CELL_VALUES)).alias("manual"))
    marks = rows.where("user_id % 4 <> 0 and k % 9 = 0").select("user_id", "event_id", "first", F.lit("footnote").alias("kind"), F.col("event_type").alias("procedure"), F.when(F.col("event_id") % 5 != 0, visit).alias("visit"), (F.col("k") % 4).cast("string").alias("value"), F.lit(None).cast("string").alias("manual"))
    cells = item.withColumn("kind", F.lit("cell"))
    expected = cells.unionByName(marks.where("visit is not null")).unionByName(item.withColumn("kind", F.lit("visit"))).unionByName(item.withColumn("kind", F.lit("procedure")))
    samples = rows.groupBy("user_id").agg(F.when(F.col("user_id") % 13 != 5, F.count_if(F.col("first") & (F.col("user_id") % 17 != 6))).alias("expected_tables"), F.count_if(~F.col("first") & (F.col("user_id") % 19 != 7)).alias("actual_tables"))
    return audit.schedule_scores(samples, expected.where("first and user_id % 17 <> 6").drop("manual"), cells.unionByName(marks).where("not first and user_id % 19 <> 7"), "user_id")


SCHEDULE_SCORES = f"""
with r as (select *, (props->>'$.k')::bigint as k, day(ts) <= 15 as first from events),
v as (select *, case when event_id % 11 = 0 then 'VISIT ' else 'Visit ' end || (k % 6) as visit from r),
c as (select user_id, first, event_type as p, visit as v, lower(trim(case when not first and event_id % 7 = 0 then {sql_pick('event_id', *_CELL_VALUES)} else {sql_pick('k', *_CELL_VALUES)} end, chr(160) || ' ')) as raw from v),
n as (select *, case when raw in ('x', '✓', '✔', '+') then 'x' when raw in ('-', '–', '—') then '-' else raw end as x from c),
f as (select user_id, first, event_type as p, visit as v, (k % 4)::varchar as x from v where user_id % 4 <> 0 and k % 9 = 0 and event_id % 5 <> 0),
i as (select distinct user_id, first, 'visit' as kind, v as item from n union select distinct user_id, first, 'procedure', p from n
  union select distinct user_id, first, 'cell', p || '|' || v || '|' || x from n where x <> '' union select distinct user_id, first, 'footnote', p || '|' || v || '|' || x from f),
e as (select * from i where first and user_id % 17 <> 6), a as (select * from i where not first and user_id % 19 <> 7),
m as (select user_id, kind, count(*) as ne, count(a.item) as hit from e left join a using (user_id, kind, item) group by 1, 2),
q as (select user_id, kind, count(*) as na from a group by 1, 2),
s as (select user_id, case when user_id % 13 <> 5 then count(*) filter (first and user_id % 17 <> 6) end as te, count(*) filter (not first and user_id % 19 <> 7) as ta from r group by user_id),
w as (select s.*, k.kind, coalesce(ne, 0) as ne, coalesce(na, 0) as na, coalesce(hit, 0) as hit from s cross join (select unnest(['visit', 'procedure', 'cell', 'footnote']) as kind) k left join m on m.user_id = s.user_id and m.kind = k.kind left join q on q.user_id = s.user_id and q.kind = k.kind),
z as (select *, case when ne + na = 0 then 1.0 when na = 0 then 0.0 else hit / na end::double as pr, case when ne + na = 0 then 1.0 when ne = 0 then 0.0 else hit / ne end::double as re, te is not null and (kind <> 'footnote' or ne + na > 0) as scored from w)
select user_id, kind, case when te is not null then ((te > 0) = (ta > 0))::int end as detection, case when scored then round(pr, 6) end as precision, case when scored then round(re, 6) end as recall,
  case when scored then round(case when pr + re = 0 then 0.0 else 2 * pr * re / (pr + re) end, 6) end as f1 from z
"""


def majority_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's most frequent order status, ties to the first order."""
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("canonical"), F.col("o_orderstatus").alias("value"), F.lit(0.6).alias("confidence"), F.col("o_orderkey").alias("ord"))
    return audit.merge_answers(rows, ["o_custkey"])


MAJORITY_ANSWERS = """
with v as (select o_custkey, o_orderstatus as value, count(*) as n, min(o_orderkey) as first from orders group by 1, 2)
select o_custkey, value, round(least(0.95, 0.6 + 0.1 * (n - 1)), 6)::double as confidence, n from (select *, row_number() over (partition by o_custkey order by n desc, first) as r from v) where r = 1
"""


def zone_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Part types as raw zones against a few known ones."""
    raw = table(spark, sf, "part").select(F.concat(F.lit("x."), F.lower("p_type")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return audit.resolve_zone(raw, "raw", ["economy", "base.medium", "standrd"]).select("raw", "n", "zone")


ZONE_RESOLUTION = """
select 'x.' || lower(p_type) as raw, count(*) as n, case lower(p_type) when 'economy' then 'economy' when 'medium' then 'base.medium' when 'standard' then 'standrd' end as zone from part group by 1, 3
"""

_NAMES = ("Informed consent", "Vital signs", "ECG", "Physical exam", "Blood test", "Randomization", "Study drug")


def schedule_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Schedules drawn from orders: line numbers are procedures, an order's lines with a return are marked.

    Equal tables are parsed and counted once.
    """
    marked = [F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == i + 1)).alias(f"marked_{i}") for i in range(len(_NAMES))]
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*marked, F.max("l_linenumber").alias("n"))
    header = "<tr><th>Procedure</th><th>Screening Visit 1</th><th>Visit 2 Day 1</th><th>Visit 3 Day 8</th><th>Visit 4 Week 2</th></tr>"
    body = [F.concat(F.lit(f"<tr><td>{name}</td><td>"), F.when(F.col(f"marked_{i}"), "X<sup>1</sup>").otherwise(""), F.lit("</td><td>X</td><td>"), F.when(F.lit(i + 1) <= F.col("n"), "5 mL").otherwise("-"), F.lit("</td><td></td></tr>")) for i, name in enumerate(_NAMES)]
    html = F.concat(F.lit(f"<table>{header}"), *body, F.lit("</table>"))
    places, once = schedules.distinct_tables(lines.select(F.col("l_orderkey").alias("block_id"), F.lit("Schedule of assessments").alias("title"), html.alias("html")))
    counts = schedules.cells(once, "key").groupBy("key", "normal").agg(F.count("*").alias("n"), F.sum(F.size("markers")).alias("n_markers"))
    return places.join(counts, "key").select("block_id", "normal", "n", "n_markers")


SCHEDULE_CELLS = """
with o as (select l_orderkey as block_id, count(distinct l_linenumber) filter (l_returnflag = 'R') as m, max(l_linenumber) as n from lineitem group by 1),
c as (select block_id, unnest([{'normal': 'X', 'n': 7 + m, 'k': m}, {'normal': '', 'n': 14 - m, 'k': 0}, {'normal': '5 mL', 'n': n, 'k': 0}, {'normal': '–', 'n': 7 - n, 'k': 0}]) as c from o)
select block_id, c.normal as normal, c.n::bigint as n, c.k::bigint as n_markers from c where c.n > 0
"""


def turn_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each turn among those of one role in its conversation."""
    turns = table(spark, sf, "conversations")
    return structure.occurrence(turns, ["conv_id"], F.col("role"), [F.col("turn")]).select("conv_id", "turn", "role", "occurrence")


TURN_OCCURRENCES = "select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) - 1 as occurrence from conversations"

QUERIES = {f.__name__: f for f in (editorial_checks, stage_metrics, tuning_stats, disagreement_rates, schedule_scores, majority_answers, zone_resolution, schedule_cells, turn_occurrences)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
