"""Queries over formats: markers and footnotes of cells, schedules, tables, anchors, model responses, stems and canonical values.

Where a rule can't be stated in SQL, documents take written forms in turn and the SQL has what each form should give,
worked out by hand from the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import diff, runs, schedules, sections
from tessera.plans.finding_plans import pick, sql_pick
from tessera.plans.section_plans import LINES, lines
from tessera.sources import docx, responder
from tessera.sources.tables import spread, table
from tessera.streaming import events


def forms(spark: SparkSession, sf: str, given: list, name: str = "form") -> DataFrame:
    """Documents with one of the forms each, in turn."""
    return table(spark, sf, "documents").select("doc_id", pick("doc_id", *given).alias(name))


def sql_text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


def expected(values: list[str | None], name: str) -> str:
    return f"select doc_id, [{', '.join(map(sql_text, values))}][doc_id % {len(values)} + 1] as {name} from documents"


_CELLS = {
    "X<sup>1</sup>": "X|1", "X1": "X|1", "Day 1": "Day 1|", "7": "|7", "45": "45|", "a† b": "a b|†", "x²": "x|2", "X (3)": "X|3", "X 5mL": "X 5mL|", None: "|", "<sup>a, *†</sup>–": "–|a,*,†", "X (45)": "X (45)|", "a (123)": "a|23",
    "<sup>31, 30</sup>x": "x|30", "(X) 3": "(X)|3", "X&dagger;<sup>2</sup>": "X|2,†", "<b>✓</b> 12": "✓|12", "– 3": "–|3", "ECG<sup>2b</sup>*": "ECG|2b,*", "Visit&nbsp;2": "Visit 2|", "<sup></sup>": "|", "30.": "|30", "X<SUP class='n'>4</SUP> §": "X|4,§",
}


def cell_marker_forms(spark: SparkSession, sf: str) -> DataFrame:
    found = forms(spark, sf, list(_CELLS)).withColumn("m", schedules.cell_markers(F.col("form")))
    return found.select("doc_id", F.concat("m.text", F.lit("|"), F.array_join("m.markers", ",")).alias("cell"))


CELL_MARKER_FORMS = expected(list(_CELLS.values()), "cell")

_NOTES = {
    "<p>1) first</p><p>* second<br/>1. again</p>none": "1=first;*=second", "<li>† - Holds &amp; stands</li><li>12: x</li>": "†=Holds & stands;12=x", None: "", "<p>MFI-20 is long</p><p>§</p>": "", "2 – two</p><p>3. <b>three</b> parts": "2=two;3=three parts",
}


def footnote_definitions(spark: SparkSession, sf: str) -> DataFrame:
    found = forms(spark, sf, list(_NOTES)).withColumn("f", schedules.footnotes(F.col("form")))
    return found.select("doc_id", F.array_join(F.transform("f", lambda d: F.concat_ws("=", d["marker"], d["text"])), ";").alias("notes"))


FOOTNOTE_DEFINITIONS = expected(list(_NOTES.values()), "notes")

_HEAD = "<tr><th rowspan='2'>Procedure</th><th>Screening</th><th colspan='2'>Period</th><th>Follow-up visit</th></tr><tr><td>Visit 1</td><td>Visit 2 Day 1</td><td>Visit 3 Day 8</td><td>Week 4</td></tr>"
_ROWS = [("Informed consent<sup>1</sup>", "X", "", "", "–"), ("Vital signs", "X*", "X", "–", "5 mL"), ("ECG", "(X)", "x 3", "", ""), ("Physical exam", "", "✓", "7", "X")]
_WIDE = f"<table>{_HEAD}{''.join('<tr>' + ''.join(f'<td>{c}</td>' for c in row) + '</tr>' for row in _ROWS)}</table>"
_TALL_ROWS = [("Visits", *(r[0] for r in _ROWS)), *((f"Visit {i} day {i}", *(r[i] for r in _ROWS)) for i in range(1, 5))]
_TALL = f"<table>{''.join('<tr>' + ''.join(f'<td>{c}</td>' for c in row) + '</tr>' for row in _TALL_ROWS)}</table>"
_PRICES = "<table><tr><td>Item</td><td>Price</td></tr><tr><td>Pen</td><td>2</td></tr></table>"
_TABLES = (("Schedule of assessments", _WIDE), ("Schedule of assessments", _TALL), ("Prices", _PRICES), (None, None), ("График процедур", _WIDE))


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("block_id"), "source")
    return docs.withColumn("title", pick("block_id", *(t for t, _ in _TABLES))).withColumn("html", pick("block_id", *(h for _, h in _TABLES)))


def schedule_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with spans, turned ones, and ones that are no schedules."""
    return schedules.detect(_tables(spark, sf)).select("block_id", "is_schedule", "orientation", "named", F.col("n_procedure_signals").alias("n_signals"))


SCHEDULE_SIGNALS = """
select doc_id as block_id, [true, true, false, false, true][doc_id % 5 + 1] as is_schedule, ['visits_cols', 'visits_rows', 'unknown', 'unknown', 'visits_cols'][doc_id % 5 + 1] as orientation, [true, true, false, false, true][doc_id % 5 + 1] as named,
  [4, 0, 0, 0, 4][doc_id % 5 + 1]::bigint as n_signals from documents
"""

_VISITS = {"wide": ("Screening / Visit 1", "Period / Visit 2 Day 1", "Visit 3 Day 8", "Follow-up visit / Week 4"), "tall": tuple(f"Visit {i} day {i}" for i in range(1, 5))}
#: normal mark, confidence and markers of the cells of ``_ROWS``
_MARKS = (
    (("X", 1.0, ""), ("", 1.0, ""), ("", 1.0, ""), ("–", 1.0, "")),
    (("X", 1.0, "*"), ("X", 1.0, ""), ("–", 1.0, ""), ("5 mL", 0.7, "")),
    (("X", 1.0, ""), ("X", 1.0, "3"), ("", 1.0, ""), ("", 1.0, "")),
    (("", 1.0, ""), ("X", 1.0, ""), ("7", 0.9, "7"), ("X", 1.0, "")),
)


def span_schedule_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of schedules whose headers have spans, or whose visits are rows."""
    found = schedules.cells(_tables(spark, sf))
    return found.select("block_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "procedure", "visit", "normal", "confidence", F.array_join("markers", ",").alias("markers"))


def _sql_cells() -> str:
    names = ("Informed consent", "Vital signs", "ECG", "Physical exam")
    rows = [f"({kind!r}, {r}, {c}, {names[r]!r}, {_VISITS[kind][c]!r}, {m!r}, {conf}, {k!r})" for kind in _VISITS for r, marks in enumerate(_MARKS) for c, (m, conf, k) in enumerate(marks)]
    return f"with t(kind, row, col, procedure, visit, normal, confidence, markers) as (values {', '.join(rows)})\nselect doc_id as block_id, row::bigint as row, col::bigint as col, procedure, visit, normal, confidence::double as confidence, markers from documents join t on kind = ['wide', 'tall', '', '', 'wide'][doc_id % 5 + 1]"


SPAN_SCHEDULE_CELLS = _sql_cells()


_PAINTS = ("bgcolor='#ff0'", 'style="background-color: rgb(1, 2, 300)"', "data-shd-fill=a1b2c3", "style='background: none'")
_PLAIN_ROW = "".join(f"<td>{c}</td>" for c in _ROWS[1][1:])
_PAINTED = _WIDE.replace(_PLAIN_ROW, "".join(f"<td {paint}>{c}</td>" for paint, c in zip(_PAINTS, _ROWS[1][1:])))


def cell_fills(spark: SparkSession, sf: str) -> DataFrame:
    """Fill colours of cells, given in several ways; every other document's table has none."""
    tables = table(spark, sf, "documents").select(F.col("doc_id").alias("block_id"), F.lit("Schedule of assessments").alias("title"), pick("doc_id", _PAINTED, _WIDE).alias("html"))
    return schedules.cells(tables).where("fill is not null").select("block_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "fill")


CELL_FILLS = "select doc_id as block_id, 1::bigint as row, unnest([0, 1, 2])::bigint as col, unnest(['#FFFF00', '#0102FF', '#A1B2C3']) as fill from documents where doc_id % 2 = 0"


def merged_schedules(spark: SparkSession, sf: str) -> DataFrame:
    """The schedules of a source as parts of one: equal orientation, visits and headers merge, rows count on."""
    tables = _tables(spark, sf)
    found = schedules.cells(tables).join(tables.select("block_id", F.coalesce("source", F.lit("none")).alias("section_id"), F.col("block_id").alias("block_ord")), "block_id")
    merged = schedules.merge_continuations(found)
    return merged.groupBy("section_id", "merged_id").agg(F.count_distinct("block_id").alias("n_parts"), F.max("row").cast("long").alias("last_row"), F.count_distinct("row").alias("n_rows"))


MERGED_SCHEDULES = """
with t as (select coalesce(source, 'none') as section_id, doc_id, ['wide', 'tall', null, null, 'wide'][doc_id % 5 + 1] as kind from documents)
select section_id, min(doc_id) as merged_id, count(*) as n_parts, count(*) * 4 - 1 as last_row, count(*) * 4 as n_rows from t where kind is not null group by section_id, kind
"""


def orientation_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    tables = _tables(spark, sf)
    found = schedules.detect(tables).join(tables.select("block_id", F.coalesce("source", F.lit("none")).alias("doc_id")), "block_id")
    return schedules.orientation_conflict(found)


ORIENTATION_CONFLICTS = """
with t as (select coalesce(source, 'none') as doc_id, ['wide', 'tall', null, null, 'wide'][doc_id % 5 + 1] as kind from documents)
select doc_id, count(distinct kind) > 1 as conflict from t where kind is not null group by 1
"""


def drawn_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Empty cells that a drawing covers become marks; turns are cells, and every other one is covered."""
    cells = table(spark, sf, "conversations").select(F.col("conv_id").alias("block_id"), F.col("turn").alias("row"), F.lit(0).alias("col"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("raw")).withColumn("normal", F.col("raw")).withColumn("confidence", F.lit(0.7))
    covered = cells.where("row % 2 = 0").select("block_id", "row", "col", F.inline(F.array(F.struct(F.lit("line").alias("kind")), F.struct(F.lit("arrow").alias("kind")))))
    return schedules.drawing_overrides(cells, covered).select("block_id", F.col("row").cast("long").alias("row"), "normal", "confidence", "source")


DRAWN_CELLS = """
select conv_id as block_id, turn::bigint as row, case when turn % 6 = 0 then 'X' when turn % 3 = 0 then '' else role end as normal, case when turn % 6 = 0 then 0.85 else 0.7 end::double as confidence, case when turn % 6 = 0 then 'arrow' else 'text' end as source from conversations
"""


def parsed_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as tables of HTML with a row for each line; every second one has its headers in header cells."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda x, i: F.concat(F.lit("<tr><td class='a'> "), escaped(x), F.lit("&nbsp;</td><TD>"), i.cast("string"), F.lit("</TD></tr>"))
    head = F.when(F.col("doc_id") % 2 == 0, "<tr><th>Line</th><th>N<b>o</b></th></tr><tr></tr>").otherwise("")
    html = F.concat(F.lit("<TABLE>"), head, F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), row), ""), F.lit("</TABLE>"))
    found = table(spark, sf, "documents").select("doc_id", T.html_table(html).alias("t"))
    return found.select("doc_id", F.sha2(F.array_join("t.headers", "|"), 256).alias("headers"), F.size("t.rows").cast("long").alias("n_rows"), F.sha2(F.array_join(F.transform("t.rows", lambda r: F.array_join(r, "|")), "/"), 256).alias("rows"))


PARSED_TABLES = r"""
with w as (select doc_id, [trim(regexp_replace(x, '[\s\x{00A0}]+', ' ', 'g'), ' ') for x in string_split(coalesce(text, ''), chr(10))] as w from documents),
r as (select doc_id, list_transform(w, lambda x, i: x || '|' || (i - 1)) as r from w)
select doc_id, sha256(case when doc_id % 2 = 0 then 'Line|N o' else r[1] end) as headers, case when doc_id % 2 = 0 then len(r) else len(r) - 1 end as n_rows, sha256(array_to_string(case when doc_id % 2 = 0 then r else r[2:] end, '/')) as rows from r
"""


def footnote_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Markers and references of the lines that have any."""
    found = lines(spark, sf).select("doc_id", "ord", F.concat(F.array_join(T.footnote_marks(F.col("line")), ","), F.lit("|"), F.array_join(T.footnote_references(F.col("line")), ",")).alias("marks"))
    return found.where("marks <> '|'")


#: Every mark in turn: what stands before it and behind it.
FOOTNOTE_MARKS = rf"""
with {LINES},
m as (select doc_id, ord, array_to_string(list_transform(regexp_extract_all(line, '(^|[ \t\r\f])([*†‡§¶]|[0-9]+)[ \t\r\f]*[):.]', 0), lambda x: regexp_extract(x, '([*†‡§¶]|[0-9]+)', 1)), ',') || '|' || array_to_string(list_transform(regexp_extract_all(line, '\[[0-9]+\]|<sup>[0-9]+</sup>', 0), lambda x: regexp_extract(x, '[0-9]+', 0)), ',') as marks from l)
select * from m where marks <> '|'
"""


def markdown_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each document as a table of two columns."""
    rows = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.array(x, F.lit(" a|b ")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(sections.markdown_table(F.array(F.coalesce("lang", F.lit("none")), F.lit(" ")), rows), 256).alias("digest"))


MARKDOWN_TABLES = r"""
with l as (select doc_id, coalesce(lang, 'none') as lang, string_split(coalesce(text, ''), chr(10)) as lines from documents),
r as (select doc_id, '| ' || lang || ' |   |' || chr(10) || '| --- | --- |' || array_to_string([chr(10) || '| ' || case when trim(regexp_replace(replace(x, '|', '\|'), '\s+', ' ', 'g'), ' ') = '' then ' ' else trim(regexp_replace(replace(x, '|', '\|'), '\s+', ' ', 'g'), ' ') end || ' | a\|b |' for x in lines], '') as t from l)
select doc_id, sha256(t) as digest from r
"""


def parsed_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as a model's response: its turns as JSON between other words, some of it cut off, comes back whole."""
    packed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.struct(t["turn"].alias("a"), t["text"].alias("b"))))
    said = table(spark, sf, "conversations").groupBy("conv_id").agg(packed.alias("json"))
    cut = F.when(F.col("conv_id") % 3 == 0, F.expr("substring(json, 1, length(json) - 1)")).otherwise(F.concat("json", F.lit(" done {x}")))
    responses = said.select("conv_id", F.concat(F.lit("<think>[1]</think> Found: "), cut).alias("content"))
    return responder.parse_rows(responses, "a long, b string").select("conv_id", "a", F.sha2("b", 256).alias("digest"))


PARSED_RESPONSES = "select conv_id, turn as a, sha256(text) as digest from conversations"


def replayed_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts with their recorded response, the last one of several."""
    turns = table(spark, sf, "conversations")
    prompts = turns.where("role = 'user'").select("conv_id", "turn", responder.prompt_key(F.lit("m"), F.lit(""), F.col("text")).alias("prompt_key"))
    log = turns.where("role = 'user' and conv_id % 3 <> 0").select(responder.prompt_key(F.lit("m"), F.lit(""), F.col("text")).alias("prompt_key"), F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("content"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"))
    return responder.replay(prompts, log).select("conv_id", "turn", "content")


REPLAYED_PROMPTS = """
with l as (select text, arg_max('r' || conv_id, conv_id * 100 + turn) as content from conversations where role = 'user' and conv_id % 3 <> 0 group by 1)
select conv_id, turn, content from conversations left join l using (text) where role = 'user'
"""


def transient_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as messages of errors: those that ask for another try."""
    return table(spark, sf, "documents").select("doc_id", responder.transient(F.col("text")).alias("transient"))


TRANSIENT_ERRORS = "select doc_id, coalesce(regexp_matches(text, '(?i)429|50[234]|timeout|econnreset|rate limit|overloaded'), false) as transient from documents"


def cell_values(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents as cells: how often each normalised value occurs."""
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]")).alias("w"))
    return words.groupBy(T.normal_cell(F.col("w")).alias("value")).agg(F.count("*").alias("n"))


CELL_VALUES = r"""
with w as (select lower(trim(unnest(string_split_regex(text, '[ \n]')), ' ')) as w from documents)
select case when regexp_full_match(w, '[xх✓✔+]') then 'x' when regexp_full_match(w, '[-–—]') then '-' else w end as value, count(*) as n from w group by 1
"""


def vml_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Styles written from the numbers of order lines, in several orders and cases."""
    styles = F.concat(F.lit("position:absolute; LEFT : "), F.col("l_quantity").cast("decimal(12,2)"), F.lit("pt;top:-"), F.col("l_extendedprice").cast("decimal(12,2)"), F.lit("pt"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(";Width: "), F.col("l_partkey").cast("string"), F.lit("pt"))).otherwise(""), F.lit(";height:"), F.col("l_linenumber").cast("string"), F.lit("pt;"))
    box = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sections.vml_box(styles).alias("b"))
    return box.select("l_orderkey", "l_linenumber", "b.x", "b.y", "b.w", "b.h")


VML_BOXES = "select l_orderkey, l_linenumber, round(round(l_quantity, 2) * 12700)::bigint as x, -round(round(l_extendedprice, 2) * 12700)::bigint as y, case when l_linenumber % 2 = 0 then l_partkey * 12700 else 0 end::bigint as w, l_linenumber * 12700::bigint as h from lineitem"


def vml_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Types of shapes numbered by parts: how many are of each kind."""
    shapes = table(spark, sf, "part").select(F.concat(F.when(F.col("p_size") % 5 == 0, "#_X0000_T").when(F.col("p_size") % 5 == 1, "other").otherwise("#_x0000_t"), (F.col("p_partkey") % 100).cast("string")).alias("shape"))
    return shapes.groupBy("shape", sections.vml_kind(F.col("shape")).alias("kind")).agg(F.count("*").alias("n"))


VML_KINDS = """
with s as (select case when p_size % 5 = 0 then '#_X0000_T' when p_size % 5 = 1 then 'other' else '#_x0000_t' end || p_partkey % 100 as shape, p_partkey % 100 as t, p_size % 5 <> 1 as known from part)
select shape, case when not known then 'shape' when t between 13 and 16 or t between 66 and 69 then 'arrow' when t between 32 and 37 or t = 75 then 'line' when t in (76, 77, 87, 88) then 'bracket' else 'shape' end as kind, count(*) as n from s group by 1, 2
"""


def stemmed_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn's tokens as stems."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(T.stem_phrase(F.col("text")), 256).alias("digest"))


def sql_stems(text: str) -> str:
    """A text's stems in SQL: suffixes come off tokens of one script."""
    ending = lambda names: f"regexp_replace(w, '^(.{{3,}}?)(?:{'|'.join(names)})$', '\\1')"
    return f"array_to_string(list_transform(regexp_extract_all(lower({text}), '[а-яёa-z0-9][а-яёa-z0-9-]*'), lambda w: case when regexp_matches(w, '^[а-яё-]+$') then {ending(T.RU_SUFFIXES)} when regexp_matches(w, '^[a-z-]+$') then {ending(T.EN_SUFFIXES)} else w end), ' ')"


STEMMED_PHRASES = f"select conv_id, turn, sha256({sql_stems('text')}) as digest from conversations"


def canonical_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as values of facts: numbers of protocols, sizes (the first number of a text, if any), and free texts."""
    key = pick("turn", "protocol_number", "sample_size", "sponsor")
    raw = F.when(key == "protocol_number", F.concat(F.lit(" "), F.col("role"), F.lit(" -\u00a0"), F.col("conv_id").cast("string"))).when((key == "sample_size") & (F.col("conv_id") % 2 == 0), F.concat(F.lit("N = 00"), F.length("text").cast("string"), F.lit(" of 7"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(T.canonical(key, raw), 256).alias("digest"))


CANONICAL_FACTS = f"""
select conv_id, turn, sha256(case turn % 3 when 0 then upper(role) || '-' || conv_id when 1 then case when conv_id % 2 = 0 then length(text)::varchar when regexp_matches(text, '[0-9]') then case when ltrim(regexp_extract(text, '[0-9]+', 0), '0') = '' then '0' else ltrim(regexp_extract(text, '[0-9]+', 0), '0') end else {sql_stems('text')} end else {sql_stems('text')} end) as digest from conversations
"""


def bounded_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents between boundaries, two words in a row, and a broken pattern, which never matches."""
    text = F.lower(F.coalesce("text", F.lit("")))
    tests = [T.fits(text, p).alias(n) for n, p in (("one", r"(?i)\bon\b"), ("two", r"\bof the\b"), ("broken", "(broken"))]
    return table(spark, sf, "documents").select("doc_id", *tests)


BOUNDED_PATTERNS = """
with w as (select doc_id, lower(coalesce(text, '')) as t from documents)
select doc_id, list_contains(regexp_extract_all(t, '[а-яёa-z0-9_]+'), 'on') as one, regexp_matches(t, '(^|[^а-яёa-z0-9_])of the([^а-яёa-z0-9_]|$)') as two, false as broken from w
"""


def word_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of a document against the next one: the changed words, put together again, give both lines."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.split("text", "\n", -1).alias("old"))
    pairs = docs.select("doc_id", F.posexplode_outer(F.arrays_zip("old", F.slice("old", F.lit(2), F.size("old")).alias("new"))).alias("ord", "pair"))
    rows = pairs.select("doc_id", F.col("ord").cast("long").alias("ord"), "pair.old", "pair.new").where("new is not null")
    found = diff.with_word_changes(rows, "old", "new")
    side = lambda gone: F.sha2(F.array_join(F.transform(F.filter("parts", lambda p: p["kind"] != gone), lambda p: p["text"]), ""), 256)
    return found.select("doc_id", "ord", side("add").alias("old"), side("remove").alias("new"), (F.size(F.filter("parts", lambda p: p["kind"] == "equal")) > 0).alias("alike"))


_WORDS = r"[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]"
#: Two lines have words in common if they have a token in common: a word, or what stands between words.
WORD_DIFFS = rf"""
with {LINES}, n as (select doc_id, ord, line, lead(line) over (partition by doc_id order by ord) as next from l)
select doc_id, ord, sha256(line) as old, sha256(next) as new, list_has_any(regexp_extract_all(line, '{_WORDS}'), regexp_extract_all(next, '{_WORDS}')) as alike from n where next is not null
"""


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages: users are tenants, some are broken or without a tenant."""
    rows = table(spark, sf, "events")
    packed = F.to_json(F.struct(F.col("event_type").alias("type"), F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string"))).alias("tenantId"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("docVersionId"), F.col("event_id").cast("string").alias("processingRunId")))
    return rows.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), packed)).otherwise(packed).alias("value"))


def subscribed_events(spark: SparkSession, sf: str) -> DataFrame:
    found = events.subscribe(events.parse_messages(_messages(spark, sf)), "t1", "v2")
    return found.select(F.col("processingRunId").cast("long").alias("event_id"), "type")


SUBSCRIBED_EVENTS = "select event_id, event_type as type from events where event_id % 11 <> 0 and event_id % 7 <> 0 and user_id % 4 = 1 and user_id % 3 = 2"


def published_events(spark: SparkSession, sf: str) -> DataFrame:
    """Published events come back as they were."""
    rows = events.parse_messages(_messages(spark, sf))
    back = events.parse_messages(events.publish(rows))
    return back.groupBy("tenantId", "type").agg(F.count("*").alias("n"))


PUBLISHED_EVENTS = "select 't' || (user_id % 4) as \"tenantId\", event_type as type, count(*) as n from events where event_id % 11 <> 0 and event_id % 7 <> 0 group by 1, 2"


def failed_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as failed jobs: with tries left they wait longer each time, else they are set aside."""
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("event_id") % 4 + 1).cast("int").alias("attempts"))
    again, dead = events.split_dead(rows, {"click": 3, "purchase": 2})
    return again.select("event_id", F.lit("again").alias("state"), "delay_seconds").unionByName(dead.select("event_id", F.lit("dead").alias("state"), F.lit(None).cast("double").alias("delay_seconds")))


FAILED_JOBS = """
with j as (select event_id, event_id % 4 + 1 as n, case event_type when 'click' then 3 when 'purchase' then 2 else 1 end as most from events)
select event_id, case when n < most then 'again' else 'dead' end as state, case when n < most then 5.0 * 2 ** (n - 1) end::double as delay_seconds from j
"""


def attempts_once(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of steps by their idempotency key, each counted once."""
    key = runs.idempotency_key(F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id") % 3)
    rows = table(spark, sf, "events").withColumn("key", key)
    return events.once(rows, "key").groupBy("event_type").agg(F.count("*").alias("n"))


ATTEMPTS_ONCE = "select event_type, count(distinct user_id || ':' || event_type || ':' || (event_id % 3)) as n from events group by 1"


def element_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The block elements of pages in order, with their text: lists and unclosed paragraphs hold others."""
    return docx.html_elements(table(spark, sf, "pages"), "page_id").select("page_id", F.col("ord").cast("long").alias("ord"), "tag", F.sha2("text", 256).alias("digest"))


#: An element ends with the end tag of its own name: an alternative for each name.
_ELEMENT = "(?is)" + "|".join(f"<{tag}[^>]*>.*?</{tag}>" for tag in ("p", *(f"h{n}" for n in range(1, 7)), "table", "li", "ol", "ul"))
_INLINE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(e, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g'), ' ')"""
_ELEMENTS = f"""m as (select page_id, regexp_extract_all(html, '{_ELEMENT}', 0) as e from pages),
u as (select page_id, unnest(e) as e, generate_subscripts(e, 1) - 1 as ord from m),
x as (select page_id, ord::bigint as ord, e, lower(regexp_extract(e, '(?i)^<(p|h[1-6]|table|li|ol|ul)', 1)) as tag, {_INLINE} as text from u)"""
ELEMENT_TEXTS = f"with {_ELEMENTS} select page_id, ord, tag, sha256(text) as digest from x"

QUERIES = {f.__name__: f for f in (cell_marker_forms, footnote_definitions, schedule_signals, span_schedule_cells, cell_fills, merged_schedules, orientation_conflicts, drawn_cells, parsed_tables, footnote_marks, markdown_tables, parsed_responses, replayed_prompts, transient_errors, cell_values, vml_boxes, vml_kinds, stemmed_phrases, canonical_facts, bounded_patterns, word_diffs, subscribed_events, published_events, failed_jobs, attempts_once, element_texts)}
SQL = {name: globals()[name.upper()] for name in QUERIES}
