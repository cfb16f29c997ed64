import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import findings as FF
from tessera.functions import text as FT
from tessera.operators import audit
from tessera.plans import finding_plans


def column(spark, rows, ddl, expression):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expression).collect()]


def test_canonical_values(spark):
    cases = [("dose_mismatch", "5 МГ / кг", "5mg/kg"), ("dose_mismatch", "2,5  мл", "2.5ml"), ("dose_mismatch", "10 µg", "10mcg"), ("sample_size_mismatch", "N = 30", "30"), ("duration_mismatch", "4 недели", "4 weeks"), ("other", " «A»  b ", '"a" b'), ("other", " ", None), (None, "X", "x")]
    assert column(spark, [c[:2] for c in cases], "i string, v string", FF.canonical_value(F.col("i"), F.col("v"))) == [c[2] for c in cases]


def test_anti_patterns(spark):
    found = FF.anti_pattern(("description", F.col("d")), ("quote", F.col("q")))
    rows = [("Возможно не так", None), ("ясно", "было бы лучше"), ("доза не указана", None), ("доза 5 не указана", None), (None, None)]
    got = column(spark, rows, "d string, q string", found)
    assert [g and (g["field"], g["pattern"]) for g in got] == [("description", "hedging:возможно"), ("quote", "suggestion-like:было бы"), ("description", "missingness-no-value"), None, None]
    texts = [("возможно стоит", "hedging:возможно стоит"), ("следует уточнить дозу", "suggestion-like"), ("требуется уточнение", "meta:требуется уточнение"), ("major не указан", None), ("критический не указан", "missingness-no-value")]
    got = column(spark, [(t, None) for t, _ in texts], "d string, q string", found)
    assert [g and g["pattern"] for g in got] == [w for _, w in texts]


def test_editorial_and_group_keys(spark):
    texts = [("a  b [TBD]",), ("will will shall was were has been",), ("fine",)]
    assert [[x["kind"] for x in r] for r in column(spark, texts, "t string", FF.editorial(F.col("t")))] == [["double_space", "placeholder"], ["mixed_tense"], []]
    names = "family explicit issue ref target rv tv quote".split()
    key = FF.group_key(*map(F.col, names))
    rows = [("num", "k", None, None, None, "1", None, "q"), ("num", "", None, "s", None, "1", None, "q"), (None, None, None, None, None, None, None, " Quote  X"), (None,) * 8]
    assert column(spark, rows, ", ".join(f"{n} string" for n in names), key) == ["NUM|DK|k", "NUM|CV|unknown|s|?|1|?", "UNKNOWN|quote x", None]


def test_table_facts(spark):
    rows = spark.createDataFrame([(1, 0, ["Sponsor:", "Acme"]), (1, 1, ["30", "Число пациентов"]), (1, 2, ["other", "x"]), (1, 3, ["Phase", None]), (1, 4, ["one"])], "id int, ord int, cells array<string>")
    found = audit.table_facts(rows, "id", "ord", "cells", audit.synonym_table(spark))
    assert sorted((r["fact_key"], r["value"]) for r in found.collect()) == [("sample_size", "30"), ("sponsor", "Acme")]
    wide = spark.createDataFrame([(1, 0, ["Sponsor", "x" * 300], ["Phase", "v"]), (1, 1, ["a", "b"], ["Phase", "v"]), (2, 0, ["a", "b"], ["Phase"])], "id int, ord int, cells array<string>, headers array<string>")
    found = audit.table_facts(wide, "id", "ord", "cells", audit.synonym_table(spark), "headers")
    assert sorted((r["ord"], r["layout"], r["fact_key"], len(r["value"])) for r in found.collect()) == [(0, 0, "sponsor", 240), (0, 1, "study_phase", 240), (1, 1, "study_phase", 1)]


def test_zones_and_prompts(spark):
    raw = spark.createDataFrame([("design.visits",), ("Design Visits",), ("x.safety",), ("desing",), ("ae",), ("nothing",)], "z string")
    found = [r["zone"] for r in audit.resolve_zone(raw, "z", ["design", "design.visits", "safety", "ip"]).collect()]
    assert found == ["design.visits", "design.visits", "safety", "design", None, None]
    zones = spark.createDataFrame([(1, "a", "x" * 900), (1, "b", "y" * 900), (2, "a", "z")], "doc_id int, zone string, zone_text string")
    pairs = audit.zone_pairs(zones, "doc_id", "zone", spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"))
    assert [tuple(r) for r in pairs.collect()] == [(1, "a", "b")]
    manual = spark.createDataFrame([(1, "b", "a"), (1, "b", "zzz")], "doc_id int, a string, b string")
    own = audit.zone_pairs(zones, "doc_id", "zone", spark.createDataFrame([("a", "b")], "a string, b string"), manual)
    assert [tuple(r) for r in own.collect()] == [(1, "b", "a")]
    plan = audit.prompt_plan(zones, pairs, "doc_id", 1500, {"p": "prompt"})
    assert sorted((r["doc_id"], r["label"]) for r in plan.collect()) == [(1, "cross:a>b"), (1, "editorial:a"), (1, "editorial:b"), (1, "self:a"), (1, "self:b"), (2, "full_cross"), (2, "full_editorial"), (2, "full_self")]


def test_matching_and_judging(spark):
    columns = "doc int, id int, family string, kind string, zone string, quote string"
    p = spark.createDataFrame([(1, 1, "num", "t", "z", "a b c d"), (1, 2, "NUM ", "x", None, "a, (b) c!"), (1, 3, "text", "t", "z", "a b c"), (1, 4, "num", "T ", " Z", "other words"), (1, 5, None, "t", "z", "a b c")], columns)
    e = spark.createDataFrame([(1, 10, "num", "x", "z", "a b c"), (1, 11, "num", "q", "z", "c d e"), (1, 12, "num", "t", "z", "unlike")], columns)
    assert sorted((r["predicted"], r["expected"], r["lenient"]) for r in audit.match_findings(p, e, "doc").collect()) == [(1, 12, 0.5), (2, 10, 1.0)]
    assert audit.match_findings(p, e, "doc", "strict").collect() == []
    strict = spark.createDataFrame([(1, 20, "num", "t", "z", "a b c d e")], columns)
    assert [(r["predicted"], r["strict"]) for r in audit.match_findings(p, strict, "doc", "strict").collect()] == [(1, 0.8)]
    c = audit.judge_candidates(p, e, "doc", 1)
    verdicts = spark.createDataFrame([(1, 1, 10, True), (1, 2, 10, True)], "doc int, predicted int, expected int, same boolean")
    assert [(r["predicted"], r["expected"]) for r in audit.judged(c, verdicts, "doc").collect()] == [(1, 10)]


def brute_pairs(p, e, least):
    """Pairs of two lists of findings (group, id, family, kind, zone, quote), one by one."""
    def words(q):
        return {w for w in "".join(" " if c.isspace() else c for c in (q or "").lower() if c not in FT.QUOTE_MARKS[1:-1]).split(" ") if w}

    found = set()
    for g, i, f, k, z, q in p:
        for h, j, f2, k2, z2, q2 in e:
            if g == h and f and f2 and f.strip().upper() == f2.strip().upper():
                a, b = words(q), words(q2)
                overlap = len(a & b) / len(a | b) if a and b else 0.0
                place = bool(k and k2 and z and z2) and k.strip().lower() == k2.strip().lower() and z.strip().upper() == z2.strip().upper()
                if place or overlap >= min(least, 0.5):
                    found.add((g, i, j, round(overlap, 6), round(overlap, 6) if place and overlap >= 0.7 else 0.0, round(overlap, 6) if overlap >= 0.5 else 0.5 if place else 0.0))
    return found


def random_findings(side, n):
    draw = random.Random(side)
    quotes = [" ".join(draw.choice(["a", "B,", "c", "«d»", "e\u00a0f", "g\th", "—", "i"]) for _ in range(draw.choice([0, 1, 2, 3, 5, 40]))) for _ in range(n)] + [None]
    return [(i % 3, i, draw.choice(["num", " NUM", "logic", None, ""]), draw.choice(["t", "T ", "u", None]), draw.choice(["z", " Z", "y", None]), draw.choice(quotes)) for i in range(n)]


@pytest.mark.parametrize("least", [0.2, 0.5])
def test_pairs_are_those_of_one_by_one(spark, least):
    columns = "doc int, id int, family string, kind string, zone string, quote string"
    p, e = random_findings(1, 90), random_findings(2, 60)
    sides = [spark.createDataFrame(rows, columns) for rows in (p, e)]
    names = ("predicted", "expected")
    nested = [rows.groupBy("doc").agg(F.collect_list(F.struct("id", "family", "kind", "zone", "quote")).alias(n)) for rows, n in zip(sides, names)]
    wanted = brute_pairs(p, e, least)
    assert any(0 < s[3] < 0.5 and s[5] == 0.0 for s in wanted) == (least < 0.5)
    for found in (audit.overlap_pairs(*sides, "doc", least), audit.nested_pairs(nested[0].join(nested[1], "doc"), "doc", *names, least)):
        rows = found.select("doc", *names, *(F.round(c, 6) for c in ("overlap", "strict", "lenient"))).collect()
        assert len(rows) == len(wanted) and set(map(tuple, rows)) == wanted


def test_scores_of_whole_documents_and_of_all_items(spark, tmp_path):
    far = "x " * 200
    docs = [(0, far + "one two", "en"), (3, "one two three four", None), (6, "lines a b c d\nno\nb q r s t u", "en"), (9, None, "fr")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(0).cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, "x one two"), (4, "one five six seven"), (8, "four one, nine ten")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {(r["scope"], r["predicted"], r["expected"]): r["overlap"] for r in finding_plans.finding_scores(spark, str(tmp_path)).where("lenient = 0 or overlap > 0").collect()}
    assert found["benchmark", 0, 2] == 1.0  # words beyond the first 300 characters
    assert found["benchmark", 3, 2] == 0.4 and found["benchmark", 3, 8] == 0.333333  # no language; below the lenient overlap
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    columns = "scope, doc_id, predicted, expected, overlap, strict, lenient"
    wanted = con.execute(f"select {columns} from ({finding_plans.FINDING_SCORES})").fetchall()
    assert sorted(map(tuple, finding_plans.finding_scores(spark, str(tmp_path)).select(*columns.split(", ")).collect())) == sorted(wanted)


def test_structure_and_links(spark):
    e = spark.createDataFrame([(1, 0, "Aims", 1), (1, 1, "aims ", 2), (1, 2, "Gone", 1)], "d int, ord int, title string, level int")
    a = spark.createDataFrame([(1, 0, "Aims", 2), (1, 1, "AIMS", 3), (1, 2, "More", 1)], "d int, ord int, title string, level int")
    found = sorted((r["kind"], r["title"], r["expected_level"], r["level"]) for r in audit.structure_diff(e, a, "d").collect())
    assert found == [("extra", "More", None, 1), ("missing", "Gone", 1, None), ("wrong_level", "Aims", 1, 2), ("wrong_level", "aims ", 2, 3)]
    f = spark.createDataFrame([(1, 1, ["the quoted  words"], ["z2"]), (1, 2, ["short"], ["z1", None]), (1, 3, [None, "the quoted words"], ["none"]), (1, 4, [None], ["none"]), (1, 5, ["not in any text", "again the quoted"], []), (1, 6, [" "], ["z3"])], "doc int, id int, quotes array<string>, zones array<string>")
    s = spark.createDataFrame([(1, "s0", 0, "z1", "The quoted words here"), (1, "s1", 1, "z2.x", "again the quoted words"), (1, "s2", 2, "z3.a.b", None)], "doc int, section_id string, ord int, standard string, content string")
    assert {r["id"]: r["section_id"] for r in audit.link_findings(f, s, "doc").collect()} == {1: "s1", 2: "s0", 3: "s0", 5: "s1", 6: "s2"}


def test_sources_and_footnotes(spark):
    s = spark.createDataFrame([(1, "s0", "design.x", "T", 0, "one"), (1, "s1", "design.x", "T", 1, "two"), (1, "s2", "q", "About safety", 2, "")], "doc int, section_id string, standard string, title string, ord int, content string")
    t = spark.createDataFrame([(1, "a", ["design"]), (1, "b", ["none", "safety"]), (1, "c", ["zzz"]), (1, "d", ["gn.x"]), (1, "e", ["Safety"])], "doc int, target string, zones array<string>")
    found = {}
    for r in audit.prefix_sources(t, s, "doc", fallback=2).collect():
        found.setdefault(r["target"], []).append(r["section_id"])
    assert {k: sorted(v) for k, v in found.items()} == {"a": ["s0", "s1"], "b": ["s2"], "c": ["s0", "s1"], "d": ["s0", "s1"], "e": ["s0", "s1"]}
    m = spark.createDataFrame([("icf", ["design.x", "q", "none"])], "target string, sources array<string>")
    assert [r["content"] for r in audit.source_contents(m, s, "[none]").orderBy("pos").collect()] == ["two", "[none]", "[none]"]
    d = spark.createDataFrame([("t", "1", "x", 0), ("t", "*", "y", 1), ("t", "1", "z", 2)], "table string, marker string, text string, ord int")
    n = spark.createDataFrame([("t", "2", 0), ("t", "*", 1)], "table string, marker string, ord int")
    assert [(r["marker"], r["text"]) for r in audit.resolved_footnotes(d, n, "table").orderBy("marker_order").collect()] == [("1", "x"), ("*", "y"), ("2", "")]


def test_metrics(spark):
    kinds = "d int, kind string, procedure string, visit string, value string"
    e = spark.createDataFrame([(1, "visit", None, "Visit 1", None), (1, "visit", None, "Visit 2", None), (1, "procedure", "ecg", None, None), (1, "cell", "ecg", "Visit 1", "x"), (1, "cell", "ecg", "Visit 2", " "), (2, "footnote", "ecg", "Visit 1", "1")], kinds)
    a = spark.createDataFrame([(1, "cell", "ecg", "VISIT 1", "", None), (1, "cell", "ecg", "Visit 1", "-", "✓"), (2, "footnote", "ecg", None, "1", None), (2, "footnote", "ecg", "Visit 1", "2", None), (3, "cell", "ecg", "Visit 1", "x", None)], f"{kinds}, manual string")
    samples = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, None, 1), (4, 0, 0)], "d int, expected_tables int, actual_tables int")
    found = {(r["d"], r["kind"]): (r["detection"], r["precision"], r["recall"], r["f1"]) for r in audit.schedule_scores(samples, e, a, "d").collect()}
    # visits count as they are written, cells by their scored value
    assert found[1, "visit"] == (1, 0.5, 0.5, 0.5) and found[1, "cell"] == found[1, "procedure"] == (1, 1, 1, 1) and found[1, "footnote"] == (1, None, None, None)
    assert found[2, "footnote"] == (0, 0, 0, 0) and found[2, "visit"] == (0, 1, 1, 1) and found[3, "visit"] == (None, None, None, None) and found[4, "cell"] == (1, 1, 1, 1) and len(found) == 16
    r = spark.createDataFrame([("x", "passed", 1.0, None, 0.5, 10, 0.1), ("x", "error", None, None, None, None, None)], "stage string, status string, precision double, recall double, f1 double, latency int, cost double")
    one = audit.stage_metrics(r).first()
    assert (one["total"], one["passed"], one["failed"], one["pass_rate"], one["avg_recall"]) == (2, 1, 0, 0.5, None)
    v = spark.createDataFrame([(1, "correct", 5), (1, "incorrect", 2), (1, "skip", None)], "session_id int, verdict string, rating int")
    assert tuple(audit.tuning_stats(v).first()) == (1, 3, 1, 1, 3.5, 0, 1, 0, 0, 1)
    m = spark.createDataFrame([(1, {"a": 1.0, "b": 0.0}), (1, {"a": 0.0})], "run_id int, metrics map<string,double>")
    assert {x["family"]: (x["mean"], x["n"]) for x in audit.family_macro(m).collect()} == {"a": (0.5, 2), "b": (0.0, 1)}
    s = spark.createDataFrame([("a", "b", "resolved_algo"), ("a", "a", None), (None, "b", None), ("a", "c", None)], "algo_section string, llm_section string, classified_by string")
    assert [x["resolved"] for x in audit.disagreements(s).collect()] == [True, False]


def test_verdicts_answers_and_examples(spark):
    f = spark.createDataFrame([(1, "open", "low", "d"), (2, "open", "low", "d"), (3, "open", "low", "d")], "id int, status string, severity string, details string")
    v = spark.createDataFrame([(1, "dismissed", None, None), (2, "adjusted", "critical", "n")], "id int, verdict string, severity string, details string")
    assert sorted(tuple(r) for r in audit.apply_verdicts(f, v).collect()) == [(1, "false_positive", "low", None), (2, "open", "high", "n"), (3, "open", "low", "d")]
    a = spark.createDataFrame([("k", "x", "X", 0.5, 0), ("k", "y", "Y", 0.6, 1), ("k", "y", "y", 0.9, 2)], "fact_key string, canonical string, value string, confidence double, ord int")
    assert tuple(audit.merge_answers(a, ["fact_key"]).first()) == ("k", "Y", pytest.approx(0.7), 2)
    s = spark.createDataFrame([("s", i, 0, "k", str(i)) for i in range(3)], "section string, sample_id int, ord int, fact_key string, value string")
    assert sorted(r["facts"] for r in audit.few_shots(s, 2).collect()) == ["k=0", "k=1"]
