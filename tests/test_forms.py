"""Forms of single values and what is made of them."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import diff, sections
from tessera.sources import responder

FOOT = {"* ) see below": "*|", "text 12. more [3] and <sup>14</sup>": "12|3,14", "1: a 2) b": "1,2|", "no marks": "|", None: None, "v1.2 [x] †: y": "†|"}
ERRORS = {"HTTP 429": "true", "502 Bad gateway": "true", "Timeout after 3 s": "true", "ECONNRESET": "true", "invalid key": "false", None: "false", "model is Overloaded": "true"}
VALUES = {"x": "x", " Х ": "x", "✓": "x", "+": "x", "—": "-", "–": "-", " 5 ML ": "5 ml", None: "", "X (1)": "x (1)"}
STYLES = {"left:10pt;top:2.5pt;width:100pt;height:1pt": "127000,31750,1270000,12700,horizontal", "position:absolute;LEFT: 1pt ;width:3pt;height:7pt": "12700,0,38100,88900,vertical", "width:4pt;height:4pt": "0,0,50800,50800,", None: "0,0,0,0,horizontal"}
SHAPES = {"#_x0000_t32": "line", "#_x0000_t13": "arrow", "#_x0000_t87": "bracket", "#_x0000_t1": "shape", "t": "shape", None: "shape"}
PHRASES = {
    "Клинические исследования безопасности": "клиническ исследован безопаснос", "Studies of treated patients": "stud of treat patient", "visit-2 дней": "visit-2 дней", "Сроки проведения": "срок проведен", None: None, "N": "n", "Фазы II и III": "фаз ii и iii", "organizations": "organ",
}
TITLES = {"синопсис протокола": "true", "мегасинопсис": "false", "Синопсис": "true", "synopsis": "false", None: "false", "(синопсис)": "true"}
FACTS = {
    ("protocol_number", " ab-12 / 3 "): "AB-12/3", ("sample_size", "N = 0120 subjects"): "120", ("sample_size", "none"): "none", ("study_phase", "Фаза 2/3"): "2/3", ("study_phase", "Phase IV"): "4", ("study_phase", "phase ii / iii"): "2/3",
    ("study_duration", "12 недель"): "12 weeks", ("study_duration", "006 Mo."): "6 months", ("study_duration", "3 фазы"): "3 фазы", ("study_duration", "long"): "long", ("other", "Treated  Patients"): "treat patient", ("sponsor", " "): "", ("study_phase", None): "",
}
RESPONSES = {
    '[{"a": 1}, {"a": 2}]': "1,2", 'Sure: {"a": 3} ok': "3", '[{"a": 4}, {"a": 5}, {"a"': "4,5", "не могу помочь с этим": None, "no json": None, '<think>{"a": 9}</think>{"a": 6}': "6", '{"b": 7}': None, '```json\n[{"a": 8, "s": "]}"}]\n```': "8", None: None,
}
EDITS = {("a b c", "a x c"): "equal:a ;remove:b;add:x;equal: c", ("same", "same"): "equal:same", ("", "new"): "add:new", ("gone", None): "remove:gone", ("one, two", "one; two"): "equal:one;remove:,;add:;;equal: two"}


def box(form):
    b = sections.vml_box(form)
    way = F.when(b["w"] >= 2 * b["h"], "horizontal").when(b["h"] >= 2 * b["w"], "vertical").otherwise("")
    return F.concat_ws(",", b["x"], b["y"], b["w"], b["h"], way)


CASES = [
    (FOOT, lambda c: F.concat(F.array_join(T.footnote_marks(c), ","), F.lit("|"), F.array_join(T.footnote_references(c), ","))), (ERRORS, lambda c: responder.transient(c).cast("string")), (VALUES, T.normal_cell), (STYLES, box), (SHAPES, sections.vml_kind), (PHRASES, T.stem_phrase),
    (TITLES, lambda c: (T.fits(F.lower(F.coalesce(c, F.lit(""))), r"(?i)\bсинопсис\b") | T.fits(F.lower(F.coalesce(c, F.lit(""))), "(broken")).cast("string")),
]


@pytest.mark.parametrize("forms, made", CASES)
def test_forms(spark, forms, made):
    rows = spark.createDataFrame(list(enumerate(forms)), "i int, form string")
    assert [r["made"] for r in rows.select("i", made(F.col("form")).alias("made")).orderBy("i").collect()] == list(forms.values())


def test_canonical_values(spark):
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(FACTS)], "i int, key string, raw string")
    assert [r["c"] for r in rows.select("i", T.canonical(F.col("key"), F.col("raw")).alias("c")).orderBy("i").collect()] == list(FACTS.values())


def test_responses(spark):
    rows = spark.createDataFrame(list(enumerate(RESPONSES)), "i int, content string")
    found = responder.parse_rows(rows, "a int").groupBy("i").agg(F.array_join(F.array_sort(F.collect_list("a")), ",").alias("found"))
    assert {r["i"]: r["found"] for r in found.collect()} == {i: v for i, v in enumerate(RESPONSES.values()) if v is not None}


def test_word_changes():
    for (old, new), wanted in EDITS.items():
        assert ";".join(f"{k}:{v}" for k, v in diff.word_changes(old, new)) == wanted
