import zipfile

import pytest

from tessera.sources import docx, files, responder

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
DOCUMENT = f"""<w:document {NS}><w:body>
<w:p><w:pPr><w:pStyle w:val="Heading1"/><w:outlineLvl w:val="0"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="32"/></w:rPr><w:t>Title</w:t></w:r></w:p>
<w:p><w:r><w:t>Body text</w:t></w:r><w:r><wp:anchor><wp:positionH><wp:posOffset>100</wp:posOffset></wp:positionH><wp:positionV><wp:posOffset>200</wp:posOffset></wp:positionV><wp:extent cx="5" cy="5"/><a:xfrm><a:off x="1" y="2"/><a:ext cx="900" cy="30"/></a:xfrm><a:prstGeom prst="rightArrow"/></wp:anchor></w:r></w:p>
<w:tbl><w:tblGrid><w:gridCol w:w="2000"/><w:gridCol w:w="1000"/></w:tblGrid>
<w:tr><w:trPr><w:trHeight w:val="300"/></w:trPr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"""
FOOTNOTES = f'<w:footnotes {NS}><w:footnote w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>Note</w:t></w:r></w:p></w:footnote></w:footnotes>'
NUMBERING = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "one.docx", "w") as z:
        for name, text in (("document", DOCUMENT), ("footnotes", FOOTNOTES), ("numbering", NUMBERING)):
            z.writestr(f"word/{name}.xml", text)
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "other.txt").write_text("x")
    return str(tmp_path)


def test_docx_parts(spark, folder):
    read = docx.read(spark, folder)
    assert read.count() == 2
    rows = docx.paragraphs(read).orderBy("ord").collect()
    assert len([r for r in rows if r["error"]]) == 1
    good = [r for r in rows if not r["error"]]
    assert (good[0]["text"], good[0]["style"], good[0]["outline"], good[0]["bold"], good[0]["size"], good[0]["num_id"], good[0]["ilvl"]) == ("Title", "Heading1", 0, True, 16.0, 1, 0)
    assert not good[1]["bold"] and good[1]["size"] is None
    cells = [tuple(r)[1:] for r in docx.table_cells(read).orderBy("row", "col").collect()]
    h, d = 300 * docx.DXA, docx.DEFAULT_ROW
    assert cells == [(0, 0, 0, "a", 0, 0, 2000 * docx.DXA, h + d), (0, 0, 1, "b", 2000 * docx.DXA, 0, 1000 * docx.DXA, h), (0, 1, 1, "c", 2000 * docx.DXA, h, 1000 * docx.DXA, d)]
    assert [tuple(r)[2:] for r in docx.drawings(read).collect()] == [(1, "arrow", "horizontal", 101, 202, 900, 30)]
    assert [tuple(r)[1:] for r in docx.footnotes(read).collect()] == [(2, "Note")]
    assert [tuple(r)[1:] for r in docx.numbering_levels(read).collect()] == [(1, 0, 3, "%1.")]


def test_responses_are_replayed_parsed_and_tried_again(spark):
    log = spark.createDataFrame([("k", "old", 1), ("k", 'text [{"a": 1, "b": "x]"}, {"b": "no a"}] more', 2)], "prompt_key string, content string, ord int")
    prompts = spark.createDataFrame([("k", "p"), ("none", "q")], "prompt_key string, prompt string")
    found = responder.replay(prompts, log)
    assert {r["prompt_key"]: r["content"] is None for r in found.collect()} == {"k": False, "none": True}
    assert [(r["a"], r["b"]) for r in responder.parse_rows(found, "a int, b string").collect()] == [(1, "x]")]

    def respond(prompt, json_mode):
        if prompt == "q":
            raise RuntimeError("bad request")
        return prompt.upper()

    assert {tuple(r) for r in responder.answer(prompts, respond).collect()} == {("k", "P", None), ("none", None, "bad request")}


@pytest.mark.parametrize("text, wanted", [("<think>[1]</think> x {\"a\": {\"b\": [1, \"}\"]}} y", '{"a": {"b": [1, "}"]}}'), ("no json", None), ("{broken} [1, 2]", "[1, 2]"), ('["a\\"]"]', '["a\\"]"]')])
def test_json_spans(text, wanted):
    assert responder.json_span(text) == wanted


def test_taxonomy_and_reports(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("zones:\n- key: a\n  patterns: [x]\n  subzones:\n  - key: b\n")
    found = files.read_taxonomy(spark, str(tmp_path / "t.yaml"))
    assert sorted((r["section"], r["parent"], r["kind"]) for r in found.collect()) == [("a", None, "zone"), ("a.b", "a", "subzone")]
    docs = spark.createDataFrame([("d", "a", "T")], "doc string, zone string, title string")
    files.write_report(docs, docs, docs, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/zone-distribution")).first()["n"] == "1"


def test_elements_end_with_their_own_name(spark):
    pages = spark.createDataFrame([(1, "<li><p>a</p> b</li><P class=x>c<b>d</b></p><ul><li>e</li></ul><h2>f</h2><p>lost<table><tr><td>1</td></tr></table>"), (2, None), (3, "")], "id int, html string")
    found = [(r["id"], r["ord"], r["tag"], r["text"]) for r in docx.html_elements(pages, "id").orderBy("id", "ord").collect()]
    assert found == [(1, 0, "li", "a b"), (1, 1, "p", "cd"), (1, 2, "ul", "e"), (1, 3, "h2", "f"), (1, 4, "table", "1")]


def test_each_paragraph_is_taken_once(spark):
    elements = docx.html_elements(spark.createDataFrame([(1, "<h1>Aims</h1><p>Same  text</p><p><b>same text</b></p><p>same text</p><li>Other</li><table><tr><th>h</th></tr><tr><td>c</td></tr></table><p>last</p>")], "id int, html string"), "id")
    properties = spark.createDataFrame([(1, 5, "same text", False, 10.0, 1, 0, "s"), (1, 2, "Same text", True, 20.0, None, None, None), (1, 3, "other", False, None, None, None, None)], "id int, ord int, text string, bold boolean, size double, num_id int, ilvl int, style string")
    found = docx.with_properties(elements, properties, "id").orderBy("ord").collect()
    assert [(r["tag"], r["bold"], r["size"], r["num_id"]) for r in found[:5]] == [("h1", False, None, None), ("p", True, 20.0, None), ("p", False, 10.0, 1), ("p", False, None, None), ("li", False, None, None)]
    assert found[0]["style"] == "heading 1" and found[2]["paragraph_style"] == "s"
    size = spark.createDataFrame([(1, 12.0)], "id int, base_size double")
    blocks = docx.assembled(docx.with_properties(elements, properties, "id"), size, "id").orderBy("ord").collect()
    # the larger bold text is a heading, too
    assert [(r["section"], r["title"], r["level"], r["ord"], r["kind"], r["content"]) for r in blocks] == [(1, "Same text", 1, 2, "paragraph", "same text"), (1, "Same text", 1, 3, "paragraph", "same text"), (1, "Same text", 1, 4, "list", "Other"), (1, "Same text", 1, 5, "table", "h\nc"), (1, "Same text", 1, 6, "paragraph", "last")]
    plain = docx.html_elements(spark.createDataFrame([(1, "<p>one</p>"), (2, "<p>early</p><h2>T</h2><p>x</p>")], "id int, html string"), "id")
    whole = docx.assembled(docx.with_properties(plain, properties.limit(0), "id"), size, "id")
    assert {(r["id"], r["title"], r["level"], r["content"]) for r in whole.collect()} == {(1, "Document", 0, "one"), (2, "T", 2, "x")}


VML = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:v="urn:schemas-microsoft-com:vml"'
INLINE = '<w:drawing><wp:inline><wp:extent cx="900" cy="30"/><a:prstGeom prst="line"/></wp:inline></w:drawing>'
OLD = '<w:pict><v:shape type="#_x0000_t66" style="position:absolute;left:1.5pt;top:-2pt;width:10pt;height:2pt"/></w:pict>'


def zipped(path, document):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", document)


def test_legacy_shapes_are_read_where_the_choice_has_no_drawing(spark, tmp_path):
    def alternative(choice, fallback):
        return f"<w:p><w:r><mc:AlternateContent>{choice}<mc:Fallback>{fallback}</mc:Fallback></mc:AlternateContent></w:r></w:p>"

    body = alternative(f"<mc:Choice>{INLINE}</mc:Choice>", OLD) + alternative("", OLD) + alternative("<mc:Choice><w:t>none</w:t></mc:Choice>", '<w:pict><v:line style="width:1pt;height:9pt"/><v:rect style="left:3pt"/><v:oval type="#_x0000_t88" style="width:4pt;height:3pt"/></w:pict>')
    zipped(tmp_path / "both.docx", f"<w:document {NS} {VML}><w:body>{body}</w:body></w:document>")
    found = [tuple(r)[1:] for r in docx.drawings(docx.read(spark, str(tmp_path))).orderBy("drawing").collect()]
    p = docx.POINT
    assert found == [(0, 0, "line", "horizontal", 0, 0, 900, 30), (1, 1, "arrow", "horizontal", round(1.5 * p), -2 * p, 10 * p, 2 * p), (2, 2, "line", "vertical", 0, 0, p, 9 * p), (3, 2, "bracket", None, 0, 0, 4 * p, 3 * p)]


def test_damaged_and_encrypted_files_become_rows(spark, tmp_path):
    zipped(tmp_path / "good.docx", DOCUMENT)
    whole = (tmp_path / "good.docx").read_bytes()
    at = whole.index(b"word/document.xml") + len("word/document.xml")
    with zipfile.ZipFile(tmp_path / "packed.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", DOCUMENT * 3)
    packed = bytearray((tmp_path / "packed.docx").read_bytes())
    packed[at + 8 : at + 60] = b"\xff" * 52
    (tmp_path / "packed.docx").write_bytes(packed)
    locked = bytearray(whole)
    for mark, place in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + place] |= 1
    (tmp_path / "locked.docx").write_bytes(locked)
    with zipfile.ZipFile(tmp_path / "empty.docx", "w") as z:
        z.writestr("other.xml", "<a/>")
    found = docx.paragraphs(docx.read(spark, str(tmp_path))).collect()
    failed = {r["path"].rsplit("/", 1)[1]: r["error"] for r in found if r["error"]}
    assert set(failed) == {"packed.docx", "locked.docx", "empty.docx"} and any(r["text"] == "Title" for r in found)
    assert {r["path"].rsplit("/", 1)[1] for r in docx.table_cells(docx.read(spark, str(tmp_path))).collect()} == {"good.docx"}


def test_archives_are_whole_and_repeatable(spark, tmp_path):
    rows = [("a", "p1.txt", "one"), ("a", "p1.txt", "two"), ("a", "p/2", "é" * 3000000), ("b/c", "x", None), (None, "y", "z")]
    members = spark.createDataFrame(rows, "run string, name string, content string")
    for _ in range(2):
        found = {(r["group"], r["n_members"]) for r in files.write_archives(members, "run", str(tmp_path / "out")).collect()}
        assert found == {("a", 3), ("b_c", 1), ("none", 1)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.zip", "b_c.zip", "none.zip"]
    with zipfile.ZipFile(tmp_path / "out" / "a.zip") as z:
        assert sorted(z.namelist()) == ["p1-2.txt", "p1.txt", "p_2"] and {z.read(n).decode()[:3] for n in ("p1.txt", "p1-2.txt")} == {"one", "two"} and len(z.read("p_2")) == 6000000


def test_reports_are_read_back(spark, tmp_path):
    findings = spark.createDataFrame([("v1", 2, "high", "b & <c>\x01"), ("v1", 1, None, "a"), ("v2", 1, "low", "z")], "version string, n int, severity string, description string")
    reports = files.word_reports(findings, "version", ["severity", "description"], ["n"], "Findings of")
    assert reports.count() == 2
    written = files.write_archives(reports.withColumnRenamed("group", "run"), "run", str(tmp_path / "zips")).collect()
    assert {r["n_members"] for r in written} == {1}
    for r in reports.collect():
        (tmp_path / r["name"]).write_bytes(r["content"])
    read = docx.read(spark, str(tmp_path)).where("path like '%.docx'")
    cells = sorted((r["path"].rsplit("/", 1)[1], r["row"], r["col"], r["text"]) for r in docx.table_cells(read).collect())
    assert cells == [("v1.docx", 0, 0, "severity"), ("v1.docx", 0, 1, "description"), ("v1.docx", 1, 0, ""), ("v1.docx", 1, 1, "a"), ("v1.docx", 2, 0, "high"), ("v1.docx", 2, 1, "b & <c>"), ("v2.docx", 0, 0, "severity"), ("v2.docx", 0, 1, "description"), ("v2.docx", 1, 0, "low"), ("v2.docx", 1, 1, "z")]
    assert [r["text"] for r in docx.paragraphs(read).where("style = 'Heading1'").orderBy("path").collect()] == ["Findings of v1", "Findings of v2"]


def test_fact_registry(spark, tmp_path):
    (tmp_path / "facts.yaml").write_text("""meta:
  - {fact_key: phase, value_type: string, priority: 250, confidence: high, labels_en: [phase], topics: [b, a]}
  - {fact_key: phase, value_type: integer, topics: [c]}
  - {fact_key: odd, value_type: shape, priority: often, topics: none}
  - just text
note: not a list
design:
  - {fact_key: study_arms, value_type: list, topics: [a]}
""")
    found = files.read_fact_registry(spark, str(tmp_path / "facts.yaml"))
    rows = [(r["fact_key"], r["category"], r["priority"], r["topics"], r["error"]) for r in found.collect()]
    assert rows == [("phase", "meta", 250, ["b", "a"], None), ("phase", "meta", None, ["c"], "repeated fact_key"), ("odd", "meta", None, [], "unknown value_type shape; priority often isn't a number; topics: not a list"), ("just text", "meta", None, [], "unknown value_type None"), ("study_arms", "design", None, ["a"], None)]
    more = spark.createDataFrame([("phase", ["z", "a"]), ("sponsor", ["s"])], "fact_key string, topics array<string>")
    assert {r["fact_key"]: r["expected_sections"] for r in files.section_priors(found, more).collect()} == {"phase": ["a", "b", "z"], "study_arms": ["a"], "sponsor": ["s"]}
    anchors = spark.createDataFrame([("phase", ["x"], ["phase", "study"])], "fact_key string, ru array<string>, en array<string>")
    assert {r["fact_key"]: r["query"] for r in files.fact_queries(found, anchors).collect()} == {"phase": "x phase study", "study_arms": "study arms"}


def test_report_has_shares(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc int, zone string")
    files.write_report(rows.limit(1), rows, spark.createDataFrame([("t",)], "title string"), str(tmp_path / "r"))
    assert [tuple(r) for r in files.distribution(rows, "zone").collect()] == [("a", 2, 66.7), ("b", 1, 33.3)]
    assert {tuple(r) for r in spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "r" / "zone-distribution-tsv")).collect()} == {("a", "2", "66.7"), ("b", "1", "33.3")}
