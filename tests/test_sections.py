from pyspark.sql import functions as F

from tessera.operators import sections as S


def test_texts_and_markdown(spark):
    sections = spark.createDataFrame([("a",), ("b",)], "section_id string")
    blocks = spark.createDataFrame([("a", 1, "list", "item"), ("a", 0, "paragraph", "text"), ("a", 2, "table", "t"), ("a", 3, None, "")], "section_id string, ord int, kind string, content string")
    assert {r["section_id"]: r["text"] for r in S.section_texts(sections, blocks).collect()} == {"a": "text\n- item\n\nt\n", "b": ""}
    rows = spark.createDataFrame([(["h", " "], [["a|b", None], ["x  y", ""]])], "h array<string>, r array<array<string>>")
    assert rows.select(S.markdown_table(F.col("h"), F.col("r"))).first()[0] == "| h |   |\n| --- | --- |\n| a\\|b |   |\n| x y |   |"


def test_gates(spark):
    facts = spark.createDataFrame([(1, 0.5, "a", "a"), (2, 0.0, None, None), (3, 0.9, "a", "b"), (4, 0.9, "a", None)], "id int, confidence double, deterministic_value string, llm_value string")
    assert sorted(r["id"] for r in S.to_check(facts).collect()) == [1, 3]
    sections = spark.createDataFrame([(1, 0.9, False), (2, 0.5, None), (3, None, True), (4, None, None)], "id int, confidence double, is_false_heading boolean")
    assert sorted(r["id"] for r in S.needs_model(sections).collect()) == [2, 4]
    priors = spark.createDataFrame([("k", ["design", "ip"])], "fact_key string, expected array<string>")
    rows = spark.createDataFrame([("k", "design"), ("k", "design.x"), ("k", "designs"), ("k", None), ("k", "synopsis"), ("other", "zzz")], "fact_key string, section string")
    assert sorted(r["section"] or "" for r in S.within_priors(rows, priors).collect()) == ["", "design", "design.x", "synopsis", "zzz"]


def test_coverage_and_prelabels(spark):
    p = spark.createDataFrame([(1, "num", "Z1", "llm"), (2, "num", "z2", "llm"), (3, "editorial", "z1", "llm"), (4, "num", "z3", "deterministic")], "id int, family string, zone string, method string")
    q = spark.createDataFrame([(10, "NUM", "z1", True), (11, "NUM", "z3", True), (12, "NUM", "z9", False), (13, "EDITORIAL", "z1", True)], "id int, family string, zone string, must_detect boolean")
    covered, missed, extra = ([r["id"] for r in x.collect()] for x in S.coverage(p, q))
    assert (covered, missed, extra) == ([10], [11], [2])
    rows = spark.createDataFrame([("editorial", None, "confirmed", True), ("num", "false_positive", None, None), ("num", "open", "dismissed", None), ("num", "open", "confirmed", True), ("num", "open", "confirmed", None)], "f string, s string, v string, q boolean")
    assert [r[0] for r in rows.select(S.prelabel(*map(F.col, "fsvq"))).collect()] == ["skip", "rejected", "rejected", "accepted", "skip"]


def test_counts(spark):
    facts = spark.createDataFrame([("d", 0.4, "validated", True), ("d", 0.5, "x", False), ("d", 0.8, None, None)], "doc string, confidence double, status string, has_contradiction boolean")
    assert tuple(S.fact_summary(facts, ["doc"]).first()) == ("d", 3, 1, 1, 1, 1, 1)
    results = spark.createDataFrame([("s", 0.0), ("s", 0.2), ("s", 1.0), ("s", None)], "stage string, confidence double")
    assert tuple(S.batch_evaluation(results).first()) == ("s", 4, 0.4, 1, 1, 0, 0, 1)
    golden = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("s", 3, "c")], "session string, id int, expected string")
    current = spark.createDataFrame([(1, "a"), (2, "x")], "id int, value string")
    assert tuple(S.regression(golden, current, "id", "session").first()) == ("s", 3, 1, 0.333333)


def test_order_dependent_folds(spark):
    rows = [("d", 0, 0, True, 5), ("d", 1, 1, False, 5), ("d", 2, 2, False, 5), ("d", 3, 1, False, 5), ("d", 4, 0, False, 5), ("d", 5, 2, False, 50)]
    data = spark.createDataFrame(rows, "doc_id string, ord int, level int, collapsed boolean, size long")
    assert [r["number"] for r in S.numbered(data).orderBy("ord").collect()] == ["1", "1.1", "1.1.1", "1.2", "2", "2.1"]
    assert sorted(r["ord"] for r in S.visible(data).collect()) == [0, 4, 5]
    assert [r["part"] for r in S.grouped(data, 12).orderBy("ord").collect()] == [0, 0, 1, 2, 3, 4]
    assert [r["ord"] for r in S.orphaned(spark.createDataFrame([("d", 0, 0), ("d", 1, 2), ("d", 2, 1)], "doc_id string, ord int, level int")).collect()] == [1]
    sections = spark.createDataFrame([("d", 0, 7, False), ("d", 1, 3, True), ("d", 2, 3, False), ("d", 3, None, True), ("e", 4, 9, False), ("e", 5, 1, False)], "doc_id string, ord long, paragraph int, is_manual boolean")
    found = {(r["doc_id"], r["paragraph"], r["is_manual"]): r["ord"] for r in S.reordered(sections).collect()}
    assert found == {("d", 3, False): 0, ("d", 3, True): 1, ("d", 7, False): 2, ("d", None, True): 3, ("e", 9, False): 4, ("e", 1, False): 5}


def test_places_and_vml(spark):
    a = spark.createDataFrame([("d", 5, "x"), ("d", 9, "y")], "doc string, ord int, a string")
    b = spark.createDataFrame([("d", 1, "p"), ("d", 2, "q"), ("d", 3, "r")], "doc string, ord int, b string")
    assert sorted((r["a"], r["b"]) for r in S.by_place(a, b, "doc", "ord").collect()) == [("x", "p"), ("y", "q")]
    v = spark.createDataFrame([("position:absolute;left:10pt;top:-2.5pt;width:3", "#_x0000_t13"), (None, None)], "s string, t string")
    assert [tuple(r[0]) + (r[1],) for r in v.select(S.vml_box(F.col("s")), S.vml_kind(F.col("t"))).collect()] == [(127000, -31750, 38100, 0, "arrow"), (0, 0, 0, 0, "shape")]
