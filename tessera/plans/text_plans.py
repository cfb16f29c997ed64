"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, facts, retrieval, rules, structure
from tessera.sources import tables

RULES = (
    rules.SectionRule("licence", ("licen[sc]ed?", "public license", "copyright"), negative=("password",)),
    rules.SectionRule("contact", ("[a-z0-9.]+@[a-z0-9.]+", "phone"), required=("@",)),
    rules.SectionRule("articles", ("the ", " of ", " and "), kind="subzone", parent="licence"),
    rules.SectionRule("references", ("https?://",)),
)
FACTS = (
    rules.FactRule("email", (r"([a-z0-9.]+@[a-z0-9]+\.[a-z.]+)",)),
    rules.FactRule("phone", (r"(\+?[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4})",)),
    rules.FactRule("licence", (r"(licensed under [a-z ]+)", r"(released under [a-z ]+)")),
)
ASKED = (("q1", "the of and"), ("q2", "und der die"), ("q3", "les et pour"), ("q4", "license public general license"))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents")


def texts(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Ids, texts and the other columns that are asked for, over all cores: what follows works hard on each text."""
    return tables.spread(docs(spark, sf).select("doc_id", "text", *more))


def doc_headings(spark: SparkSession, sf: str) -> DataFrame:
    rows = structure.lines(texts(spark, sf)).withColumn("heading", structure.is_heading(F.col("line")))
    under = structure.last_heading(rows)
    words = F.size(T.tokens(F.col("line")))
    return under.groupBy("doc_id", F.coalesce("under", F.lit(-1)).cast("long").alias("heading_ord")).agg(F.count("*").alias("n_lines"), F.sum(words).alias("n_tokens"))


DOC_HEADINGS = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents),
f as (select *, trim(line, ' ') as flat from l),
h as (select doc_id, ord, line, flat <> '' and (
  regexp_matches(flat, '^[0-9]+(\.[0-9]+)*[.)]?\s+\S') or (regexp_matches(flat, '[A-Z]') and not regexp_matches(flat, '[a-z]'))
  or (length(flat) <= 40 and regexp_matches(flat, '[A-Za-z]') and not regexp_matches(flat, '[.,;:!?]$'))) as heading from f),
u as (select doc_id, line, last_value(case when heading then ord end ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and current row) as under from h)
select doc_id, coalesce(under, -1)::bigint as heading_ord, count(*) as n_lines, sum(len(regexp_extract_all(line, '[а-яёА-ЯЁa-zA-Z0-9][а-яёА-ЯЁa-zA-Z0-9-]*')))::bigint as n_tokens
from u group by 1, 2
"""


def html_text_strip(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    text = T.html_text(F.col("html"))
    return pages.select("page_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("digest"))


_STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g'), ' ')"""
HTML_TEXT_STRIP = f"select page_id, length(t)::bigint as n_chars, sha256(t) as digest from (select page_id, {_STRIP} as t from pages)"


def html_elements(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<(p|h[1-6]|li|table)[ >]"), F.lit(1))).alias("tag"))
    return found.groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


HTML_ELEMENTS = r"""
select page_id, lower(tag) as tag, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '(?i)<(p|h[1-6]|li|table)[ >]', 1)) as tag from pages) group by 1, 2
"""


def token_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.top_tokens(texts(spark, sf), 50, stop=("that", "this", "with"))


TOKEN_TOPK = r"""
select token, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[а-яёА-ЯЁa-zA-Z0-9][а-яёА-ЯЁa-zA-Z0-9-]*')) as token from documents)
where length(token) >= 4 and not regexp_matches(token, '^[0-9]+$') and token not in ('that', 'this', 'with') group by 1 order by n desc, token limit 50
"""


def token_stems(spark: SparkSession, sf: str) -> DataFrame:
    words = texts(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n"))  # each distinct word is stemmed once
    return counted.groupBy(T.stripped(F.col("w"), T.EN_SUFFIXES).alias("stem")).agg(F.sum("n").alias("n"))


TOKEN_STEMS = f"""
select regexp_replace(w, '^(.{{3,}}?)(?:{'|'.join(T.EN_SUFFIXES)})$', '\\1') as stem, sum(n)::bigint as n
from (select w, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) group by 1) group by 1
"""


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame(list(ASKED), "query_id string, query string")
    return retrieval.bm25(texts(spark, sf), asked, 10).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


BM25_TOPK = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[а-яёА-ЯЁa-zA-Z0-9][а-яёА-ЯЁa-zA-Z0-9-]*') as words from documents),
s as (select count(*) as n, avg(len(words)) as mean from w),
q(query_id, query) as (values ('q1','the of and'), ('q2','und der die'), ('q3','les et pour'), ('q4','license public general license')),
a as (select query_id, term, count(*) as times from (select query_id, unnest(string_split(query, ' ')) as term from q) group by 1, 2),
tf as (select doc_id, len(words) as length, term, count(*) as tf from (select doc_id, words, unnest(words) as term from w) where term in (select term from a) group by 1, 2, 3),
df as (select term, count(*) as df from tf group by 1),
r as (select query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) as score
  from tf join a using (term) join df using (term) cross join s group by 1, 2),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from r where score > 0)
select query_id, doc_id, score, rank from k where rank <= 10
"""


def content_digest_dups(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).withColumn("digest", T.content_digest(F.col("text")))
    return structure.spread_occurrence(rows.select("doc_id", "digest"), F.col("digest"), "doc_id", 100_000).where("occurrence > 0").select("doc_id", "digest", "occurrence")


CONTENT_DIGEST_DUPS = r"""
select doc_id, digest, occurrence from (select doc_id, digest, row_number() over (partition by digest order by doc_id) - 1 as occurrence
from (select doc_id, case when substr(trim(text, ' '), 1, 200) = '' then '' else sha256(substr(trim(text, ' '), 1, 200)) end as digest from documents)) where occurrence > 0
"""


def word_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of documents and of benchmark passages that are alike by half of their words."""

    def prepared(rows: DataFrame, key: str, name: str) -> DataFrame:
        flat = structure.sentences(rows, key).select(key, F.col("ord").cast("long").alias(f"{name}_ord"), T.word_set(F.col("sentence")).alias(name))
        return flat.where(F.size(name) > 0)

    items = prepared(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "b")
    pairs = retrieval.alike(prepared(texts(spark, sf), "doc_id", "a"), items, ["doc_id", "a_ord"], ["item_id", "b_ord"], "a", "b", 0.5)
    return pairs.select("doc_id", F.col("a_ord").alias("ord"), "item_id", F.col("b_ord").alias("item_ord"), F.round("overlap", 6).alias("overlap"))


_FLAT = r"trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')"


def _sql_sentences(table: str, key: str) -> str:
    split = r"string_split_regex(text, '[.!?]\s+')"
    return f"select {key}, ord, list_distinct(list_filter(string_split(f, ' '), lambda x: x <> '')) as w from (select {key}, ord, {_FLAT} as f from (select {key}, unnest({split}) as s, (generate_subscripts({split}, 1) - 1)::bigint as ord from {table})) where f <> ''"


#: Every pair that shares a word.
WORD_JACCARD_PAIRS = f"""
with a as ({_sql_sentences('documents', 'doc_id')}), b as ({_sql_sentences('benchmark', 'item_id')}),
p as (select doc_id, a.ord, item_id, b.ord as item_ord, len(list_intersect(a.w, b.w)) as n_shared, len(a.w) + len(b.w) as n_every from a join b on list_has_any(a.w, b.w))
select doc_id, ord, item_id, item_ord, round(n_shared / (n_every - n_shared), 6) as overlap from p where n_shared / (n_every - n_shared) >= 0.5
"""


def prefix_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    kept = docs(spark, sf).where(~T.excluded(F.col("source"), ["src1", "src9"]))
    return kept.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


PREFIX_EXCLUSION = "select source, count(*) as n_docs, sum(n_chars)::bigint as n_chars from documents where source is null or not (starts_with(source, 'src1') or starts_with(source, 'src9')) group by 1"


def rule_classify_flat(spark: SparkSession, sf: str) -> DataFrame:
    rows = structure.lines(texts(spark, sf)).withColumnRenamed("line", "title")
    found = rules.classify(rows, RULES)
    return rules.keep_singletons(found, "doc_id", "ord").where("section is not null").select("doc_id", F.col("ord").cast("long").alias("ord"), "section", F.round("confidence", 9).alias("confidence"))


def _sql_len(p: str) -> str:
    return f"length(regexp_extract(t, '{p}', 0))"


def _sql_score(r: rules.SectionRule) -> str:
    hits = " + ".join(f"(case when {_sql_len(p)} > 0 then 1 else 0 end)" for p in r.patterns)
    total = " + ".join(_sql_len(p) for p in r.patterns)
    score = f"case when {hits} > 0 then least(0.99::double, 0.6::double + 0.3::double * least(({total}) / greatest(length(t), 1), 1.0::double) + 0.05::double * least({hits}, 2)) else 0.0::double end"
    for p in r.negative:
        score = f"case when regexp_matches(t, '{p}') then greatest(0.0::double, {score} - 0.4::double) else {score} end"
    if r.required:
        score = f"case when {' or '.join(f'''regexp_matches(t, '{p}')''' for p in r.required)} then {score} else 0.0 end"
    return f"({score})::double"


RULE_CLASSIFY_FLAT = f"""
with l as (select doc_id, lower(unnest(string_split(text, chr(10)))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents),
s as (select doc_id, ord, {', '.join(f'{_sql_score(r)} as s{i}' for i, r in enumerate(RULES))} from l),
b as (select doc_id, ord, greatest({', '.join(f's{i}' for i in range(len(RULES)))}) as c, case {' '.join(f"when s{i} = greatest({', '.join(f's{j}' for j in range(len(RULES)))}) then '{r.section}'" for i, r in enumerate(RULES))} end as section from s),
n as (select *, row_number() over (partition by doc_id, section order by c desc, ord) as n from b where c > 0)
select doc_id, ord::bigint as ord, section, round(c, 9) as confidence from n where not (section = 'references' and n > 1)
"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.extract_facts(texts(spark, sf, "source"), FACTS, keep=["source"])
    return found.withColumn("canonical", F.lower("value"))


def rule_fact_extract(spark: SparkSession, sf: str) -> DataFrame:
    return rules.extract_facts(texts(spark, sf), FACTS).groupBy("doc_id", "fact_key", "value").agg(F.count("*").alias("n"))


def _sql_facts() -> str:
    clean = r"regexp_replace(case when length(f) > 120 then c120 else f end, '[,;:\s]+$', '')"
    parts = " union all ".join(f"select doc_id, lang, source, {i * 10 + j} as p, '{r.key}' as fact_key, unnest(regexp_extract_all(text, '(?i){p}', 1)) as raw, generate_subscripts(regexp_extract_all(text, '(?i){p}', 1), 1) as k from documents" for i, r in enumerate(FACTS) for j, p in enumerate(r.patterns))
    return f"""m as ({parts}),
q as (select doc_id, lang, source, p, k, fact_key, trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' ') as flat from m),
f0 as (select *, case when strpos(regexp_replace(flat, '[.;]\\s', '~~'), '~~') > 1 and regexp_matches(flat, '[.;]\\s') then trim(substr(flat, 1, strpos(regexp_replace(flat, '[.;]\\s', '~~'), '~~') - 1), ' ') else flat end as f from q),
f1 as (select *, case when length(substr(f, 1, 121)) - length(regexp_replace(substr(f, 1, 121), '.* ', '')) > 21 then trim(substr(f, 1, length(substr(f, 1, 121)) - length(regexp_replace(substr(f, 1, 121), '.* ', '')) - 1), ' ') else trim(substr(f, 1, 120), ' ') end as c120 from f0),
facts as (select doc_id, lang, source, p, k, fact_key, {clean} as value from f1)"""


RULE_FACT_EXTRACT = f"with {_sql_facts()} select doc_id, fact_key, value, count(*) as n from facts where value <> '' group by 1, 2, 3"


def fact_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of documents of source 1, and of no other whatever its name, weigh as those of a synopsis."""
    title = F.when(F.col("source") == "src1", "Study synopsis")
    voted = facts.vote(_facts(spark, sf), ["doc_id", "fact_key"], title=title)
    return voted.select("doc_id", "fact_key", "canonical", "value", "confidence", "n_sources")


FACT_VOTE = f"""
with {_sql_facts()} select doc_id, fact_key, lower(value) as canonical, arg_min(value, p * 1000000 + k) as value, round(least(0.95, 0.6 + 0.1 * sum(case when source = 'src1' then 2 else 1 end)), 6)::double as confidence, count(*) as n_sources
from facts where value <> '' group by doc_id, fact_key, lower(value)
"""


def fact_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Every value, with its document, of the facts of twenty documents that have several canonical values."""
    found = _facts(spark, sf).where("canonical <> ''").withColumn("at", F.struct("doc_id", "ord")).withColumn("batch", F.floor(F.col("doc_id") / 20))
    every = facts.contradictions(found, ["batch", "fact_key"], source="doc_id", order="at")
    return every.select("batch", "fact_key", "n_values", F.array_join(F.transform("entries", lambda e: F.concat_ws("@", e["value"], e["source"].cast("string"))), "; ").alias("entries"))


FACT_CONTRADICTIONS = f"""
with {_sql_facts()} select doc_id // 20 as batch, fact_key, count(distinct lower(value)) as n_values, string_agg(value || '@' || doc_id, '; ' order by doc_id, p, k) as entries
from facts where value <> '' group by 1, fact_key having count(distinct lower(value)) > 1
"""


def coverage_semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages by whether some document has their first sentence."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    items = structure.sentences(items, "item_id").where("ord = 0").select("item_id", T.fingerprint(F.col("sentence")).alias("key"))
    keys = structure.sentences(texts(spark, sf)).select(T.fingerprint(F.col("sentence")).alias("key")).where("key <> ''").distinct()
    hit, miss = items.join(keys, "key", "left_semi"), items.join(keys, "key", "left_anti")
    return hit.select("item_id", F.lit(True).alias("covered")).unionByName(miss.select("item_id", F.lit(False).alias("covered")))


_FP = r"substr(lower(trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'), ' ')), 1, 80)"
COVERAGE_SEMI_ANTI = f"""
with k as (select distinct {_FP.format('s')} as key from (select unnest(string_split_regex(text, '[.!?]\\s+')) as s from documents))
select item_id, {_FP.format("string_split_regex(text, '[.!?]\\s+')[1]")} in (select key from k where key <> '') as covered from benchmark
"""


def neighbour_window(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    around = structure.neighbours(turns, "conv_id", "turn", F.concat_ws(":", "role", F.length("text").cast("string")))
    return around.select("conv_id", "turn", "context")


NEIGHBOUR_WINDOW = "select conv_id, turn, array_to_string(list(role || ':' || length(text)) over (partition by conv_id order by turn rows between 3 preceding and 3 following), ' | ') as context from conversations"


def parent_chain(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return structure.parents(turns.withColumn("level", level), "conv_id", "turn", "level", 3).select("conv_id", "turn", F.col("level").cast("long").alias("level"), "parent")


PARENT_CHAIN = """
with t as (select conv_id, turn, case role when 'system' then 1 when 'user' then 2 else 3 end::bigint as level from conversations)
select conv_id, turn, level, (select max(p.turn) from t p where p.conv_id = t.conv_id and p.turn < t.turn and p.level < t.level) as parent from t
"""


def section_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    found = structure.anomalies(structure.lines(texts(spark, sf)))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


SECTION_ANOMALIES = """
with l as (select doc_id, lower(trim(unnest(string_split(text, chr(10))), ' ')) as k, generate_subscripts(string_split(text, chr(10)), 1) as ord from documents),
c as (select *, count(*) over (partition by doc_id, k) as same from l)
select doc_id, kind, count(*) as n from (select doc_id, unnest([case when k = '' then 'empty' end, case when k <> '' and length(k) < 20 then 'short' end, case when k <> '' and same > 1 then 'duplicate' end]) as kind from c) where kind is not null group by 1, 2
"""


def fixed_batches(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    dealt = structure.fixed_batches(turns, "conv_id", ["turn"], 5)
    return dealt.groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


FIXED_BATCHES = """
select conv_id, batch, count(*) as n, sum(length(text))::bigint as n_chars from (select *, ((row_number() over (partition by conv_id order by turn) - 1) // 5)::bigint as batch from conversations) group by 1, 2
"""


def set_prf(spark: SparkSession, sf: str) -> DataFrame:
    """A length heuristic against the quality labels, by language."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs(spark, sf).join(labels, "doc_id")
    return evaluation.set_scores(rows, ["lang"], F.col("n_chars") >= 500, F.col("quality") == 1)


SET_PRF = """
with c as (select lang, count(*) filter (n_chars >= 500 and quality = 1) as hit, count(*) filter (n_chars >= 500) as predicted, count(*) filter (quality = 1) as expected from documents join labels using (doc_id) group by 1),
r as (select *, case when predicted = 0 and expected = 0 then 1.0 when predicted = 0 then 1.0 when expected = 0 then 0.0 else hit / predicted end::double as p, case when predicted = 0 and expected = 0 then 1.0 when predicted = 0 then 0.0 when expected = 0 then 1.0 else hit / expected end::double as r from c)
select lang, hit, predicted, expected, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 6) as f1 from r
"""


def brier_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs(spark, sf).join(labels, "doc_id")
    return evaluation.brier(rows, ["lang"], F.least(F.col("n_chars") / 2000, F.lit(1.0)), F.col("quality"))


BRIER_BY_LANG = "select lang, round(avg(pow(least(n_chars / 2000, 1.0) - quality, 2)), 6) as brier, count(*) as n from documents join labels using (doc_id) group by 1"


def calibration_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf)
    prior = F.when(F.col("lang") == "en", 0.2).otherwise(-0.1)
    sources = F.pmod("n_chars", F.lit(5)) + 1
    return rows.select("doc_id", F.round(T.calibrated(F.least(F.col("n_chars") / 4000, F.lit(1.0)), prior, sources), 6).alias("confidence"))


CALIBRATION_APPLY = "select doc_id, round(1 / (1 + exp(-((least(n_chars / 4000, 1.0) - 0.5) + 0.3 * (case when lang = 'en' then 0.2 else -0.1 end) + 0.15 * ln(1 + n_chars % 5)))), 6) as confidence from documents"


def calibration_grid(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs(spark, sf).join(labels, "doc_id").select(F.least(F.col("n_chars") / 4000, F.lit(1.0)).alias("confidence"), F.col("quality").cast("double").alias("correct"), F.when(F.col("lang") == "en", 0.2).otherwise(-0.1).alias("prior"), (F.pmod("n_chars", F.lit(5)) + 1).alias("sources"))
    return evaluation.calibration_grid(rows, "confidence", "correct", [0.5, 1.0, 1.5, 2.0, 2.5, 3.0], [0.0, 0.15, 0.3, 0.45, 0.6], [0.0, 0.1, 0.15, 0.2, 0.3], "prior", "sources")


CALIBRATION_GRID = """
with g as (select a.v::double as alpha, b.v::double as beta, c.v::double as gamma, row_number() over (order by a.v, b.v, c.v) as i from (select unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]) as v) a, (select unnest([0.0, 0.15, 0.3, 0.45, 0.6]) as v) b, (select unnest([0.0, 0.1, 0.15, 0.2, 0.3]) as v) c),
r as (select least(n_chars / 4000, 1.0) as c, quality as q, case when lang = 'en' then 0.2 else -0.1 end as prior, n_chars % 5 as m from documents join labels using (doc_id)),
s as (select i, alpha, beta, gamma, round(avg(pow(1 / (1 + exp(-(alpha * (c - 0.5) + beta * prior + gamma * ln(1 + m)))) - q, 2)), 9) as brier from r cross join g group by all)
select alpha, beta, gamma, brier from s order by brier, i limit 1
"""


def coverage_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that labelled and all documents have, by language."""
    rows = docs(spark, sf).select("doc_id", "lang", "source")
    labelled = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left_semi")
    return evaluation.coverage(rows, labelled, "lang", "source")


COVERAGE_BY_KEY = """
with e as (select distinct lang, lower(trim(source)) as v from documents), a as (select distinct lang, lower(trim(source)) as v from documents where doc_id in (select doc_id from labels))
select lang, count(e.v) as n_expected, count(a.v) as n_actual, count(*) filter (e.v is not null and a.v is not null) as n_shared from e full join a using (lang, v) group by lang
"""

QUERIES = {f.__name__: f for f in (doc_headings, html_text_strip, html_elements, token_topk, token_stems, bm25_topk, content_digest_dups, word_jaccard_pairs, prefix_exclusion, rule_classify_flat, rule_fact_extract, fact_vote, fact_contradictions, coverage_semi_anti, neighbour_window, parent_chain, section_anomalies, fixed_batches, set_prf, brier_by_lang, calibration_apply, calibration_grid, coverage_by_key)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
