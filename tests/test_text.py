import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_stems(spark):
    pairs = [("исследования", "исследован"), ("исследованием", "исследован"), ("patients", "patient"), ("randomized", "randomiz"), ("the", "the"), ("mfi20", "mfi20"), ("Visits", "visit"), ("studies", "stud"), ("да", "да"), ("", "")]
    found = values(spark, [(a,) for a, _ in pairs], "w string", T.stem(F.col("w")))
    assert found == [b for _, b in pairs]


def test_phrases_of_one_meaning_are_equal(spark):
    same = T.stem_equals(F.col("a"), F.col("b"))
    assert values(spark, [("Клинические исследования", "клинического исследование"), ("blood tests", "blood drug")], "a string, b string", same) == [True, False]


def test_canonical_values(spark):
    cases = [
        ("sample_size", "30 пациентов", "30"), ("sample_size", "007 subjects", "7"), ("study_phase", "Phase III", "3"), ("study_phase", "II/III", "2/3"), ("study_phase", "фаза 3", "3"), ("study_phase", "1 / 2", "1/2"),
        ("study_duration", "12 wk", "12 weeks"), ("study_duration", "6 мес.", "6 months"), ("study_duration", "2 года", "2 years"), ("protocol_number", " ab-12 3 ", "AB-123"),
        ("sponsor", "  ", ""), ("sponsor", None, ""), ("sponsor", "Acme   Labs", "acme lab"),
    ]
    found = values(spark, [c[:2] for c in cases], "k string, v string", T.canonical(F.col("k"), F.col("v")))
    assert found == [c[2] for c in cases]


def test_clean_values(spark):
    long = "word " * 40
    cases = [(" a   b ", "a b"), ("First part. Second part", "First part"), ("keep 1.5 mg", "keep 1.5 mg"), ("ends;", "ends"), (long, ("word " * 24).strip()), ("x" * 150, "x" * 120), ("a, ", "a")]
    assert values(spark, [(a,) for a, _ in cases], "v string", T.clean_value(F.col("v"))) == [b for _, b in cases]


def test_calibration_and_jaccard(spark):
    one = values(spark, [(0.5, None, 1)], "c double, p double, n int", T.calibrated(F.col("c"), F.col("p"), F.col("n")))[0]
    assert one == pytest.approx(0.5)
    sets = T.jaccard(T.word_set(F.col("a")), T.word_set(F.col("b")))
    assert values(spark, [("A b, c", "b C d"), ("", "x"), (None, "x")], "a string, b string", sets)[:2] == [0.5, 0.0]


def test_keys_anchors_and_cells(spark):
    key = T.dedup_key(*map(F.col, "abcde"))
    assert values(spark, [("t", None, "s2", "1", None), ("t", "s1", "s2", None, None)], "a string, b string, c string, d string, e string", key) == ["t|?|s2|1|?", None]
    anchor = T.section_anchor(F.col("n"), F.col("o"), F.col("k"))
    assert values(spark, [("1.2", 5, "design"), (None, 7, None)], "n string, o int, k string", anchor) == ["[S1.2:design]", "[S#7]"]
    back = T.parsed_anchor(F.col("a"))
    assert [tuple(r) for r in values(spark, [("see [S1.2:design] x",), ("[S#7]",)], "a string", back)] == [("1.2", "design"), ("#7", None)]
    assert values(spark, [("✓",), ("—",), (" Day 1 ",), (None,)], "v string", T.normal_cell(F.col("v"))) == ["x", "-", "day 1", ""]


def test_digests_titles_html(spark):
    assert values(spark, [("  ",), (None,)], "t string", T.content_digest(F.col("t"))) == ["", ""]
    assert values(spark, [("1.2.3 Study Design ",), ("Appendix",)], "t string", T.normal_title(F.col("t"))) == ["study design", "appendix"]
    assert values(spark, [("<p>a&nbsp;&amp;lt; <b>b</b></p>",)], "t string", T.html_text(F.col("t"))) == ["a &lt; b"]


def test_excluded_prefixes(spark):
    hit = T.excluded(F.col("s"), ["pre", "x"])
    assert values(spark, [("preclinical",), ("a",), (None,)], "s string", hit) == [True, False, False]


def test_html_tables_and_footnotes(spark):
    table = T.html_table(F.col("t"))
    rows = [("<tr><th>A</th><th>B &amp; C</th></tr><tr><td>1</td><td><b>2</b></td></tr>",), ("<tr><td>h</td></tr>\n<TR><TD>x\ny</TD></TR>",), ("",)]
    assert [(r["headers"], r["rows"]) for r in values(spark, rows, "t string", table)] == [(["A", "B & C"], [["1", "2"]]), (["h"], [["x y"]]), ([], [])]
    assert values(spark, [("* first 2) second a.",)], "t string", T.footnote_marks(F.col("t"))) == [["2"]]
    assert values(spark, [("see [3] and <sup>12</sup>",)], "t string", T.footnote_references(F.col("t"))) == [["3", "12"]]
