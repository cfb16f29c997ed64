"""Queries of assembled documents and of chains of model calls with recorded replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chains, headings
from tessera.plans.format_plans import _ELEMENTS
from tessera.sources import docx
from tessera.sources.tables import table

#: Turns as sections: every fifth has no standard section, and a text's beginning is its title.
SECTIONS = """s as (select conv_id, turn as o, substr(text, 1, 20) as title, case when turn % 5 <> 4 then role || '.' || turn end as std, '[' || substr(text, 1, 20) || ']' || chr(10) || text as part from conversations)"""


def turn_sections(spark: SparkSession, sf: str) -> DataFrame:
    standard = F.when(F.col("turn") % 5 != 4, F.concat_ws(".", "role", F.col("turn").cast("string")))
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.concat_ws("/", "conv_id", "turn").alias("section_id"), F.substring("text", 1, 20).alias("title"), standard.alias("standard"), F.col("text").alias("content"))


def recorded(reply: Callable[[str, Column], Column]) -> chains.Ask:
    """A model whose replies to a stage's prompts are known as an expression, as those of a log are by a join: a log made of
    the prompts themselves would run every stage twice for each stage after it."""
    return lambda rows, stage: rows.withColumn("reply", F.when(F.col("prompt").isNotNull(), reply(stage, F.col("prompt"))))


def digit(digest: Column, at: int, most: int) -> Column:
    return F.ascii(F.substring(digest, at, 1)) % most


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of pages under their headings; two thirds of a page's elements, read once more, are the paragraphs whose
    bold letters and sizes count.  Each page stands twice, so that equal texts take different paragraphs."""
    pages = table(spark, sf, "pages").select("page_id", F.concat("html", F.lit("\n"), "html").alias("html"))
    elements = docx.html_elements(pages, "page_id")
    long = F.length("text")
    properties = elements.where("ord % 3 <> 1").select("page_id", "ord", "text", (F.col("ord") % 4 == 0).alias("bold"), (long % 3 * 4 + 10).cast("double").alias("size"), F.lit(None).cast("int").alias("num_id"), F.lit(None).cast("int").alias("ilvl"), F.lit(None).cast("string").alias("style"))
    sizes = headings.base_size(properties, "page_id")
    blocks = docx.assembled(docx.with_properties(elements, properties, "page_id"), sizes, "page_id")
    return blocks.select("page_id", "section", F.sha2("title", 256).alias("title"), "level", "ord", "kind", F.sha2("content", 256).alias("content"))


#: Headings of pages: by their tag, by bold letters larger than the page's median, by a number, or by bold letters alone.
PAGE_BLOCKS = f"""
with {_ELEMENTS.replace("regexp_extract_all(html,", "regexp_extract_all(html || chr(10) || html,")},
f as (select *, substr(lower(text), 1, 80) as fp from x),
n as (select *, row_number() over (partition by page_id, fp order by ord) as k from f),
p as (select page_id, fp, ord % 4 = 0 as bold, (length(text) % 3 * 4 + 10)::double as size, row_number() over (partition by page_id, fp order by ord) as k from f where ord % 3 <> 1),
b as (select page_id, case when count(*) < 5 then 12.0 else median(size) end as base from p group by page_id),
e as (select n.*, p.size, coalesce(p.bold, regexp_matches(n.e, '(?i)<strong|<b[\\s>]')) as bold, coalesce(b.base, 12.0) as base from n left join p on p.page_id = n.page_id and p.fp = n.fp and p.k = n.k and n.fp <> '' left join b on b.page_id = n.page_id),
v as (select *, regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\s+', 1) as num from e),
w as (select *, case when text = '' or tag = 'table' or regexp_matches(lower(text), '^(день|days?|неделя|weeks?|визит|visits?|месяц|months?)\\s+\\d+(\\s*\\([^)]*\\))?\\s*$') and not tag like 'h%' or regexp_matches(text, '^\\d+\\s*[-–—]\\s+[a-zа-яё]') and not tag like 'h%' then null
  when tag like 'h%' then substr(tag, 2)::int
  when bold and size > base then case when size / base >= 1.6 then 1 when size / base >= 1.3 then 2 else 3 end
  when num <> '' and (bold or not regexp_matches(text, '[,;:]$') and (contains(num, '.') or length(text) <= 80)) then len(string_split(num, '.'))
  when bold and num = '' and length(text) between 5 and 120 and not regexp_matches(text, '[,;:.]$') and regexp_matches(text, '^[A-ZА-ЯЁ0-9]') then case when length(text) <= 60 and text = upper(text) then 1 when length(text) <= 80 then 2 else 3 end end as lvl from v),
h as (select *, coalesce(lvl <= 4, false) as head from w where text <> '' or tag = 'table'),
y as (select *, last_value(case when head then {{'o': ord, 't': trim(text, ' '), 'l': lvl}} end ignore nulls) over (partition by page_id order by ord rows unbounded preceding) as up, bool_or(head) over (partition by page_id) as headed from h)
select page_id, coalesce(up.o, 0)::int as section, sha256(coalesce(up.t, 'Document')) as title, coalesce(up.l, 0)::int as level, ord::int as ord, case when tag = 'li' then 'list' else 'paragraph' end as kind, sha256(text) as content from y where not head and (up is not null or not headed)
"""


TARGETS = ("user", "system/x", "assistant.1", "zzz", "THE", "er.2")
BUDGET, CHECK_BUDGET = 900, 420


def budgeted_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The source text of several targets in every conversation."""
    sections = turn_sections(spark, sf)
    targets = sections.select("conv_id").distinct().select("conv_id", F.explode(F.array(*map(F.lit, TARGETS))).alias("target"))
    found = chains.source_texts(targets, sections, "conv_id", BUDGET)
    return found.select("conv_id", "target", F.col("how").cast("long").alias("how"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"))


#: A fold over the parts in order, for each target (``t``) and budget (``m``).
_SOURCES = f"""{SECTIONS},
j as (select conv_id, target, o, part, case when starts_with(std, target) then 0 when starts_with(std, string_split(target, '/')[1]) then 1 when contains(lower(title), lower(target)) or contains(lower(coalesce(std, '')), lower(target)) then 2 end as how from s cross join t),
b as (select *, min(how) over (partition by conv_id, target) as best from j where how is not null),
p as (select conv_id, target, best, part, row_number() over (partition by conv_id, target order by o) as n from b where how = best),
rec(conv_id, target, most, n, text, ended) as (
  select distinct conv_id, target, most, 0::bigint, '', false from s cross join t cross join m
  union all
  select p.conv_id, p.target, r.most, p.n, case when length(r.text) + length(p.part) <= r.most then r.text || case when r.text <> '' then chr(10) || chr(10) || '---' || chr(10) || chr(10) else '' end || p.part
      when r.most - length(r.text) > 200 then r.text || chr(10) || chr(10) || '---' || chr(10) || chr(10) || substr(p.part, 1, r.most - length(r.text)) else r.text end, length(r.text) + length(p.part) > r.most
  from rec r join p on p.conv_id = r.conv_id and p.target = r.target and p.n = r.n + 1 where not r.ended),
src as (select conv_id, target, most, arg_max(text, n) as text from rec group by all)"""
BUDGETED_SOURCES = f"""
with recursive t as (select unnest({list(TARGETS)}) as target), m as (select {BUDGET} as most), {_SOURCES}
select src.conv_id, src.target, h.best::bigint as how, length(text) as n_chars, sha256(text) as digest from src left join (select distinct conv_id, target, best from p) h on h.conv_id = src.conv_id and h.target = src.target
"""


PLAN = (("a", "Aims", "user"), ("b", "Methods", "assistant/x"), ("c", "None", None), ("d", "Nothing", "zzz"), ("e", "Second", "er.2"))


def _generation(stage: str, prompt: Column) -> Column:
    digest = F.sha2(prompt, 256)
    if stage == "generation":
        return F.when(digit(digest, 1, 11) != 0, F.concat(F.lit("draft "), digest))
    if stage == "regeneration":
        return F.when(digit(digest, 1, 5) != 0, F.concat(F.lit("mended "), digest))
    return F.when(digit(digest, 1, 3) != 0, F.concat(F.lit('Found: [{"description": "d'), F.substring(digest, 1, 4), F.lit('", "severity": "high", "protocol_quote": "q"}, {"description": ""}, {"description": "e"}] end'))).otherwise("none: []")


def generated_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections generated from conversations, checked and written again in up to two rounds."""
    sections = turn_sections(spark, sf)
    wanted = F.inline(F.array(*(F.struct(F.lit(i).alias("section_id"), F.lit(title).alias("title"), F.lit(t).cast("string").alias("target")) for i, title, t in PLAN)))
    targets = sections.select("conv_id").distinct().select("conv_id", wanted)
    made = chains.generated(targets, sections, recorded(_generation), "conv_id", BUDGET, CHECK_BUDGET, rounds=2)
    return made.select("conv_id", "section_id", "status", "content", F.size("findings").cast("long").alias("n_findings"), F.col("passed_round").cast("long").alias("passed_round"))


def _mended(n: int) -> str:
    """A round in SQL: the check of what is open, and the text written again."""
    listed = """case when c.bad then chr(10) || chr(10) || 'Findings:' || chr(10) || '1. [high] d' || substr(c.d, 1, 4) || chr(10) || '   source: q' || chr(10) || '2. [medium] e' else chr(10) || chr(10) || 'Findings:' || chr(10) end"""
    return f"""c{n} as (select *, sha256('Check the section ' || title || chr(10) || chr(10) || 'Source:' || chr(10) || check_source || chr(10) || chr(10) || 'Text:' || chr(10) || substr(content, 1, {CHECK_BUDGET})) as d, content is not null and passed is null as todo from r{n}),
b{n} as (select *, todo and ascii(d) % 3 <> 0 as bad from c{n}),
a{n} as (select c.*, sha256('Mend the section ' || title || chr(10) || chr(10) || 'Source:' || chr(10) || substr(source, 1, {BUDGET * 2 // 5}) || chr(10) || chr(10) || 'Text:' || chr(10) || substr(content, 1, {BUDGET * 2 // 5}) || {listed}) as again from b{n} c),
r{n + 1} as (select conv_id, section_id, title, target, source, check_source, case when bad and ascii(again) % 5 <> 0 then 'mended ' || again else content end as content, case when todo then (case when bad then 2 else 0 end) else n_findings end as n_findings, case when todo and not bad then {n} else passed end as passed from a{n})"""


GENERATED_SECTIONS = f"""
with recursive w(section_id, title, target) as (values {", ".join(f"('{i}', '{title}', {'null' if t is None else repr(t)})" for i, title, t in PLAN)}),
t as (select distinct target from w where target is not null), m as (select unnest([{BUDGET}, {CHECK_BUDGET}]) as most), {_SOURCES},
g as (select k.conv_id, w.*, x.text as source, y.text as check_source, w.target is not null and length(coalesce(x.text, '')) >= 30 as enough from (select distinct conv_id from conversations) k cross join w
  left join src x on x.conv_id = k.conv_id and x.target = w.target and x.most = {BUDGET} left join src y on y.conv_id = k.conv_id and y.target = w.target and y.most = {CHECK_BUDGET}),
q as (select *, case when enough then sha256('Write the section ' || title || ' from these sections:' || chr(10) || chr(10) || source) end as d from g),
r0 as (select conv_id, section_id, title, target, source, check_source, case when ascii(d) % 11 <> 0 then 'draft ' || d end as content, 0 as n_findings, null::int as passed from q),
{_mended(0)}, {_mended(1)}
select r2.conv_id, section_id, case when not enough then 'skipped' when content is null then 'failed' else 'completed' end as status, content, n_findings::bigint as n_findings, passed::bigint as passed_round from r2 join (select conv_id, section_id, enough from g) using (conv_id, section_id)
"""


REGISTRY = (("study_drug", "the of and"), ("sample_size", "und der les"), ("design", "que la zzz"), ("visits", "thing tion er"))


def _facts(stage: str, prompt: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(stage), prompt), 256)
    fact = F.concat(F.lit('Here: {"value": " drug'), digit(digest, 2, 3), F.lit(' ", "confidence": 0.'), digit(digest, 3, 10), F.when(digit(digest, 4, 2) == 0, ', "source_text": "as said"').otherwise(""), F.lit("}"))
    return F.when(digit(digest, 1, 4) == 0, '{"value": null, "confidence": 0}').when(digit(digest, 1, 4) == 1, '{"value": "  "}').otherwise(fact)


def targeted_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts asked for in the best turns of every conversation, and once more where none was found."""
    sections = turn_sections(spark, sf).withColumnRenamed("content", "text")
    registry = spark.createDataFrame(list(REGISTRY), "fact_key string, query string")
    return chains.targeted_facts(registry, sections, recorded(_facts), "conv_id").withColumn("pass", F.col("pass").cast("long"))


def _said(stage: str) -> str:
    """What the recorded model says to a stage's prompt, in SQL: a struct of value, confidence and quote."""
    return f"""(select case when ascii(d) % 4 < 2 then null else {{'value': 'drug' || ascii(substr(d, 2, 1)) % 3, 'confidence': (ascii(substr(d, 3, 1)) % 10) / 10, 'quote': case when ascii(substr(d, 4, 1)) % 2 = 0 then 'as said' else '' end}} end from (select sha256('{stage}' || prompt) as d))"""


TARGETED_FACTS = rf"""
with {SECTIONS}, reg(fact_key, query) as (values {", ".join(map(str, REGISTRY))}),
w as (select conv_id, conv_id || '/' || turn as section_id, text, substr(text, 1, 20) as title, regexp_extract_all(lower(substr(text, 1, 20) || chr(10) || text), '[а-яёА-ЯЁa-zA-Z0-9][а-яёА-ЯЁa-zA-Z0-9-]*') as words from conversations),
st as (select conv_id, count(*) as n, avg(len(words)) as mean from w group by 1),
a as (select fact_key, term, count(*) as times from (select fact_key, unnest(string_split(query, ' ')) as term from reg) group by all),
tf as (select conv_id, section_id, len(words) as length, term, count(*) as tf from (select conv_id, section_id, words, unnest(words) as term from w) group by 1, 2, 3, 4),
df as (select conv_id, term, count(*) as df from tf group by 1, 2),
r as (select fact_key, conv_id, section_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) as score from tf join a using (term) join df using (conv_id, term) join st using (conv_id) group by 1, 2, 3),
k as (select *, row_number() over (partition by fact_key, conv_id order by score desc, section_id) as rank from r where score > 0),
q as (select k.conv_id, fact_key, k.section_id, rank, text, 'Find the fact: ' || fact_key || chr(10) || chr(10) || 'Section: ' || title || chr(10) || chr(10) || text as prompt from k join w on w.conv_id = k.conv_id and w.section_id = k.section_id where rank <= 3),
f as (select *, {_said('targeted')} as s0, {_said('targeted_sample_1')} as s1, {_said('targeted_sample_2')} as s2 from q),
l as (select *, s0 is not null and s0.confidence < 0.7 and fact_key in ('study_drug', 'sample_size') as unsure from f),
o as (select *, case when unsure then list_filter([s0, s1, s2], lambda x: x is not null) when s0 is not null then [s0] else [] end as votes from l),
c as (select *, list_transform(votes, lambda x: len(list_filter(votes, lambda y: case when fact_key = 'sample_size' then y.value[5:] = x.value[5:] else y.value = x.value end))) as many from o),
one as (select *, list_position(many, list_max(many)) as pos from c where len(votes) > 0),
pass1 as (select conv_id, fact_key, section_id, votes[pos].value as value, case when unsure and len(votes) > 1 then least(0.95, votes[pos].confidence + 0.1 * (many[pos] - 1)) else votes[pos].confidence end as confidence, votes[pos].quote as quote, text, 1 as pass from one),
gap as (select *, {_said('targeted_gap')} as s from q where rank = 1 and not exists (select 1 from pass1 where pass1.conv_id = q.conv_id and pass1.fact_key = q.fact_key)),
every as (select * from pass1 union all select conv_id, fact_key, section_id, s.value, s.confidence, s.quote, text, 2 from gap where s is not null)
select conv_id, fact_key, section_id, value, round(confidence::double, 6) as confidence, case when quote = '' then substr(text, 1, 240) else quote end as quote, pass::bigint as pass from every
"""


CHECKS = (("csr", "csr_1", 0, "Identity", ["user"], ["assistant.1", "zzz"]), ("csr", "csr_2", 1, "Design", ["er.2", "the"], ["none"]), ("icf", "icf_1", 0, "Consent", ["system", "user.0"], ["er"]), ("icf", "icf_2", 1, "Risks", ["stant"], ["user"]))
AUDIT_BUDGET = 1200


def _audit(stage: str, prompt: Column) -> Column:
    if stage == "inter_audit_qa":
        verdicts = F.transform(F.filter(F.regexp_extract_all(prompt, F.lit("#(\\d+) "), F.lit(1)), lambda n: n.cast("int") % 7 != 0), lambda n: F.concat(F.lit('{"finding": '), n, F.lit(', "is_false_positive": '), F.when(n.cast("int") % 3 == 0, "true").otherwise("false"), F.lit("}")))
        return F.concat(F.lit("[" ), F.array_join(verdicts, ", "), F.lit("]"))
    digest = F.sha2(prompt, 256)
    one = lambda i: F.concat(F.lit('{"check_id": "'), F.when(i == 1, "CSR-X").otherwise("CSR-"), i, F.lit('", "severity": "'), F.get(F.array(*map(F.lit, ("Major", "minor", "other", "MAJOR"))), i), F.lit('", "description": "'), F.when(i == 2, "").otherwise(F.concat(F.lit("d"), i, F.substring(digest, 1, 6))), F.lit('"}'))
    return F.concat(F.lit("Reply [" ), F.array_join(F.transform(F.sequence(F.lit(0), digit(digest, 2, 4)), one), ", "), F.lit("]"))


def compared_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every second conversation as the source of the next one: findings by groups of checks, verified in fives."""
    sections = turn_sections(spark, sf).withColumnRenamed("conv_id", "doc")
    ids = sections.select("doc").distinct()
    pairs = ids.where("doc % 2 = 0").select(F.col("doc").alias("pair_id"), F.col("doc").alias("source_doc"), (F.col("doc") + 1).alias("checked_doc"), F.when(F.col("doc") % 4 == 0, "csr").otherwise("icf").alias("kind"))
    checks = spark.createDataFrame([(k, c, o, label, f"checks of {c}", a, b) for k, c, o, label, a, b in CHECKS], "kind string, check string, ord int, label string, text string, source_zones array<string>, checked_zones array<string>")
    found = chains.compared_documents(pairs, checks, sections, recorded(_audit), AUDIT_BUDGET)
    return found.select("pair_id", F.col("finding").cast("long").alias("finding"), "check_id", "severity", "family", "description", "category", "verified", "status")


COMPARED_DOCUMENTS = f"""
with {SECTIONS}, k(kind, "check", ord, label, zones, others) as (values {", ".join(f"('{k}', '{c}', {o}, '{label}', {a}, {b})" for k, c, o, label, a, b in CHECKS)}),
p as (select distinct conv_id as pair_id, conv_id + 1 as checked, case when conv_id % 4 = 0 then 'csr' else 'icf' end as kind from conversations where conv_id % 2 = 0),
z as (select pair_id, "check", ord, label, pair_id as doc, zones, 0 as side from p join k using (kind) union all select pair_id, "check", ord, label, checked, others, 1 from p join k using (kind)),
j as (select z.*, s.o, s.part, case when len(list_filter(zones, lambda x: starts_with(coalesce(std, chr(1)), x))) > 0 then 0 when len(list_filter(zones, lambda x: contains(lower(title), x) or contains(lower(coalesce(std, '')), x))) > 0 then 1 else 2 end as how from z join s on s.conv_id = z.doc),
b as (select *, min(how) over (partition by pair_id, "check", side) as best from j),
n as (select *, row_number() over (partition by pair_id, "check", side order by o) as n from b where how = best),
x as (select pair_id, "check", ord, label, side, substr(string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by o), 1, {AUDIT_BUDGET // 2}) as text from n where how < 2 or n <= 5 group by 1, 2, 3, 4, 5),
q as (select a.pair_id, a."check", a.ord, sha256('Checks: ' || a.label || chr(10) || 'checks of ' || a."check" || chr(10) || chr(10) || 'Source:' || chr(10) || a.text || chr(10) || chr(10) || 'Checked:' || chr(10) || c.text) as d from x a join x c on a.pair_id = c.pair_id and a."check" = c."check" and a.side = 0 and c.side = 1 where length(a.text) >= 50 and length(c.text) >= 50),
f as (select pair_id, ord, d, unnest(range(0, ascii(substr(d, 2, 1)) % 4 + 1)) as i from q),
g as (select *, row_number() over (partition by pair_id order by ord, i) as finding from f where i <> 2)
select pair_id, finding, case when i = 1 then 'CSR-X' else 'CSR-' end || i as check_id, case when i in (0, 3) then 'high' else 'medium' end as severity, 'OVERCLAIMING_UNDERDISCLOSURE' as family, 'd' || i || substr(d, 1, 6) as description,
  case when i = 1 then 'expert' else 'concordance' end as category, finding % 7 <> 0 as verified, case when finding % 7 <> 0 and finding % 3 = 0 then 'false_positive' else 'pending' end as status from g
"""

QUERIES = {f.__name__: f for f in (page_blocks, budgeted_sources, generated_sections, targeted_facts, compared_documents)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
