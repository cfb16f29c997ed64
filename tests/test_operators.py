import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import diff, evaluation, facts, findings, headings, retrieval, rules, runs, structure, tables
from tessera.sources import responder
from tessera.streaming import events

RULES = (
    rules.SectionRule("design", ("study design", "design")),
    rules.SectionRule("design.visits", ("visit",), kind="subzone", parent="design"),
    rules.SectionRule("safety", ("safety", "adverse"), negative=("efficacy",)),
    rules.SectionRule("safety.visits", ("visits",), kind="subzone", parent="safety"),
    rules.SectionRule("synopsis", ("synopsis",), required=("protocol",)),
)


def test_classifier_scores(spark):
    rows = [(0, "Study Design", ""), (1, "Other", "about safety"), (2, "Safety and efficacy", ""), (3, "Synopsis", ""), (4, "Synopsis of protocol", ""), (5, None, None)]
    found = {r["ord"]: (r["section"], r["confidence"]) for r in rules.classify(spark.createDataFrame(rows, "ord int, title string, content string"), RULES, "title", "content").collect()}
    assert found[0] == ("design", pytest.approx(0.99)) and found[1] == ("safety", 0.65)
    assert found[2] == ("safety", pytest.approx(0.6 + 0.3 * 6 / 19 + 0.05 - 0.4)) and found[3] == (None, 0.0)
    assert found[4][0] == "synopsis" and found[5] == (None, 0.0)


def test_hierarchy_and_singletons(spark):
    rows = [("d", 0, 1, "Safety", ""), ("d", 1, 2, "Visits", ""), ("d", 2, 1, "Study design", ""), ("d", 3, 2, "Visits", ""), ("d", 4, 1, "Protocol synopsis", ""), ("d", 5, 1, "Synopsis protocol and more words", "")]
    sections = spark.createDataFrame(rows, "doc_id string, ord int, level int, title string, content string")
    found = [r["section"] for r in rules.classify_hierarchical(sections, RULES).orderBy("ord").collect()]
    assert found == ["safety", "safety.visits", "design", "design.visits", "synopsis", None]


def test_vote_and_contradictions(spark):
    rows = [(1, "n", "30", 0, "Body"), (1, "n", "30 pts", 1, "Synopsis"), (1, "n", "31", 2, None), (1, "n", "", 3, None)]
    data = spark.createDataFrame(rows, "doc_id int, fact_key string, value string, ord int, title string").withColumn("canonical", F.substring("value", 1, 2))
    voted = facts.vote(data, ["doc_id", "fact_key"], title=F.col("title"))
    found = {r["canonical"]: (r["value"], r["confidence"], r["n_sources"]) for r in voted.collect()}
    assert found == {"30": ("30 pts", pytest.approx(0.9), 2), "31": ("31", pytest.approx(0.7), 1)}
    found = facts.contradictions(data.where("canonical <> ''"), ["doc_id", "fact_key"], source="title").first()
    assert found["n_values"] == 2 and [tuple(e) for e in found["entries"]] == [("30", "Body"), ("30 pts", "Synopsis"), ("31", None)]


def test_merged_answers_keep_the_earlier_of_equal_ones(spark):
    rows = [("d", "k", "a", 0.5, 0), ("d", "k", "b", 0.7, 1), ("d", "k", "B", 0.7, 2), ("d", "one", "x", 0.1, 3)]
    found = {r["k"]: r for r in facts.merge_answers(spark.createDataFrame(rows, "d string, k string, value string, confidence double, ord int"), ["d", "k"]).collect()}
    assert (found["k"]["value"], found["k"]["variants"], found["k"]["contradiction"]) == ("b", ["a", "b", "B"], True)
    assert (found["one"]["n_sources"], found["one"]["contradiction"]) == (1, False)


def test_parents_equal_a_stack(spark):
    rnd = random.Random(1)
    rows = [(d, i, rnd.randint(1, 4)) for d in range(6) for i in range(40)]
    found = {(r["d"], r["i"]): r["parent"] for r in structure.parents(spark.createDataFrame(rows, "d int, i long, lv int"), "d", "i", "lv", 4).collect()}
    stack, last = [], None
    for d, i, lv in rows:
        if d != last:
            stack, last = [], d
        while stack and stack[-1][1] >= lv:
            stack.pop()
        assert found[d, i] == (stack[-1][0] if stack else None)
        stack.append((i, lv))


def test_heading_detector(spark):
    rows = [
        ("Heading style", "Heading 2", None, False, None, (2, "style")), ("Outlined", None, 0, False, None, (1, "outline")), ("Large", None, None, True, 20.0, (1, "visual")), ("Larger", None, None, True, 16.0, (2, "visual")),
        ("1.2 Title", None, None, False, None, (2, "numbered")), ("1 Item,", None, None, False, None, None), ("1 " + "x" * 90, None, None, False, None, None), ("Day 5", None, None, True, None, None),
        ("3 – footnote text", None, None, False, None, None), ("SHORT CAPS", None, None, True, 12.0, (1, "visual")), ("Bold sentence.", None, None, True, 12.0, None), ("plain", None, None, False, None, None), (" ", "Heading 1", None, False, None, None),
    ]
    data = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "i int, text string, style string, outline int, bold boolean, size double")
    found = headings.detect(data, F.lit(12.0)).orderBy("i").collect()
    assert [(r["level"], r["method"]) if r["method"] else None for r in found] == [r[5] for r in rows]


def test_numbering_chunks_batches(spark):
    levels = spark.createDataFrame([("d", 1, 0, 1, "%1."), ("d", 1, 1, 1, "%1.%2)"), ("e", 1, 0, 7, "%1."), ("f", 2, 0, 1, "%1")], "doc_id string, num_id int, ilvl int, start int, format string")
    rows = [("d", 0, 1, 0), ("d", 1, 1, 1), ("d", 2, 1, 1), ("d", 3, 1, 0), ("d", 4, 1, 1), ("d", 5, None, None), ("e", 6, 1, 0), ("e", 7, 1, 1), ("g", 8, 1, 0)]
    found = headings.number_paragraphs(spark.createDataFrame(rows, "doc_id string, ord int, num_id int, ilvl int"), levels)
    assert [r["number"] for r in found.orderBy("ord").collect()] == ["1", "1.1", "1.2", "2", "2.1", None, "7", None, None]
    text = " ".join(f"w{i}" for i in range(3000))
    parts = headings.chunks(text, 500, 50)
    assert "".join([parts[0], *(p[50:] for p in parts[1:])]) == text and max(map(len, parts)) <= 500
    sized = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 5, 20, 1])], "g string, o int, s long")
    assert [r["batch"] for r in headings.budget_batches(sized, "g", "o", "s", 10, 3).orderBy("o").collect()] == [0, 0, 1, 2, 3]
    assert headings.within_budget(sized, ["g"], [F.col("o")], F.col("s"), 12).count() == 2


SECTION = "doc_id int, ord long, title string, standard string, content string"


def test_diff_and_changes(spark):
    old = spark.createDataFrame([(1, 0, "1 Aims", None, "x"), (1, 1, "Methods", "m", "y"), (1, 2, "Gone", None, "z")], SECTION)
    new = spark.createDataFrame([(1, 0, "Aims", "a", "x"), (1, 1, "How", "m", "y2"), (1, 2, "New", None, "n"), (1, 3, "New", None, "n2"), (1, 4, "How", "q", "t"), (2, 0, "Gone", None, "z")], SECTION)
    found = sorted((r["doc_id"], r["change"], r["title"], r["old_ord"], r["new_ord"]) for r in diff.diff_sections(old, new).collect())
    assert found == [(1, "added", "New", None, 2), (1, "modified", "How", 1, 1), (1, "removed", "Gone", 2, None), (1, "unchanged", "Aims", 0, 0), (2, "added", "Gone", None, 0)]
    assert diff.word_changes("a b c", "a x c") == [("equal", "a "), ("remove", "b"), ("add", "x"), ("equal", " c")]
    parts = diff.with_word_changes(spark.createDataFrame([("a b", "a c"), ("", ""), (None, "x")], "o string, n string"), "o", "n").collect()
    assert [[tuple(p) for p in r["parts"]] for r in parts] == [[("equal", "a "), ("remove", "b"), ("add", "c")], [], [("add", "x")]]


def test_only_added_sections_block_later_ones(spark):
    new = spark.createDataFrame([(1, 0, "A", "X", ""), (1, 1, "B", "X", ""), (1, 2, "B", "Y", "")], SECTION)
    found = diff.diff_sections(spark.createDataFrame([], SECTION), new)
    assert sorted(r["new_ord"] for r in found.collect()) == [0, 2]


def test_word_boundaries_and_invalid_patterns(spark):
    rows = spark.createDataFrame([("синопсис протокола",), ("мегасинопсис",), ("ip и т.д.",)], "t string")
    assert [r[0] for r in rows.select(T.fits(F.col("t"), r"(?i)\bсинопсис\b")).collect()] == [True, False, False]
    assert [r[0] for r in rows.select(T.fits(F.col("t"), "(broken")).collect()] == [False] * 3
    broken = (rules.SectionRule("s", ("(broken", "синопсис"), negative=("[",)),)
    assert rules.classify(rows.withColumnRenamed("t", "title"), broken).where("section = 's'").count() == 2


def test_headings_fall_back_to_a_model(spark):
    paragraphs = spark.createDataFrame([(d, i, f" p{i} ") for d in (1, 2) for i in range(4)], "doc_id int, paragraph int, text string")
    own = spark.createDataFrame([(1, 0, "p0", 1, "visual"), (2, 0, "p0", 1, "style"), (2, 1, "p1", 1, "numbered")], "doc_id int, paragraph int, text string, level int, method string")
    answers = spark.createDataFrame([(1, 1, 2), (1, 2, 12), (1, 9, 1), (2, 1, 1), (2, 3, 1)], "doc_id int, paragraph int, level int")
    found = sorted((r["doc_id"], r["paragraph"], r["text"], r["method"]) for r in headings.with_fallback(own, paragraphs, answers).collect())
    assert found == [(1, 1, "p1", "llm"), (2, 0, "p0", "style"), (2, 1, "p1", "numbered")]


def test_longest_pattern_by_join_too(spark, monkeypatch):
    rows = spark.createDataFrame([("gpt-4o-mini",), ("gpt-4",), ("none",), (None,)], "m string")
    prices = spark.createDataFrame([(0, "gpt-4"), (1, "gpt-4o"), (2, "t-4o-m"), (3, "gpt-4o")], "ord int, p string")
    few = findings.longest_pattern(rows, prices, "m", "p", "ord").collect()
    monkeypatch.setattr(findings, "MAX_PATTERNS", 1)
    many = findings.longest_pattern(rows, prices, "m", "p", "ord").collect()
    assert sorted(map(str, few)) == sorted(str(r) for r in many) and {r["m"]: r["p"] for r in few} == {"gpt-4o-mini": "gpt-4o", "gpt-4": "gpt-4", "none": None, None: None}


def test_failed_jobs_are_tried_again_or_set_aside(spark):
    jobs = spark.createDataFrame([("a", "parse", 1), ("b", "parse", 3), ("c", "audit", 1), ("d", "other", 1)], "id string, kind string, attempts int")
    again, dead = events.split_dead(jobs, {"parse": 3, "audit": 2})
    assert sorted((r["id"], r["delay_seconds"]) for r in again.collect()) == [("a", 5.0), ("c", 5.0)]
    assert sorted(r["id"] for r in dead.collect()) == ["b", "d"]
    published = events.publish(spark.createDataFrame([("t", None, "x", None)], "type string, docVersionId string, tenantId string, timestamp string").withColumn("processingRunId", F.lit("r")))
    parsed = events.parse_messages(published)
    assert [(r["type"], r["tenantId"], r["processingRunId"]) for r in parsed.collect()] == [("t", "x", "r")] and published.first()["key"] == "x"


def test_responses_that_were_cut_off(spark):
    texts = ['[{"a": 1}, {"a": 2}, {"a": ', 'so: {"a": 3}', "не могу помочь с этим {\"a\": 4}", "nothing", '<think>{"a": 9}</think>[{"a": 5}]']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    assert sorted((r["i"], r["a"]) for r in responder.parse_rows(rows, "a int").collect()) == [(0, 1), (0, 2), (1, 3), (4, 5)]
    errors = spark.createDataFrame([("HTTP 503",), ("Rate limit",), ("bad key",), (None,)], "e string")
    assert [r[0] for r in errors.select(responder.transient(F.col("e"))).collect()] == [True, True, False, False]


def test_alike_finds_all_pairs(spark):
    rnd = random.Random(3)
    sets = [(i, rnd.sample([f"w{k}" * (k % 3 + 1) for k in range(14)], rnd.randint(1, 7))) for i in range(60)]
    left, right = spark.createDataFrame(sets, "i int, a array<string>"), spark.createDataFrame(sets[:30], "j int, b array<string>")
    for least in (0.5, 0.8):
        found = {(r["i"], r["j"]) for r in retrieval.alike(left, right, ["i"], ["j"], "a", "b", least).collect()}
        assert found == {(i, j) for i, x in sets for j, y in sets[:30] if len({*x} & {*y}) / len({*x} | {*y}) >= least}


def test_busy_keys_are_counted_in_parts(spark):
    rnd = random.Random(5)
    times = sorted(rnd.randint(0, 4_000_000) for _ in range(300))
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "i int, k int, t long").withColumn("ts", F.expr("timestamp_micros(t * 1000)"))
    found = {r["i"]: r["in_window"] for r in runs.sliding_count(rows, "k", "ts", 60).collect()}
    assert found == {i: sum(t - 60_000 < x <= t for x in times) for i, t in enumerate(times)}


def test_greedy_pairs_and_rates(spark):
    scored = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.85), (1, 2, 2, 0.3), (2, 5, 5, 0.1)], "g int, l int, r int, s double")
    assert [(r["l"], r["r"]) for r in evaluation.greedy_pairs(scored, "g", "l", "r", "s", 0.25).orderBy("l").collect()] == [(1, 1), (2, 2)]
    counts = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (0, 2, 0), (1, 2, 4)], "h int, p int, e int")
    for empty, wanted in (("sets", [(1, 1, 1), (1, 0, 0), (0, 1, 0)]), ("tables", [(1, 1, 1), (0, 0, 0), (0, 0, 0)])):
        p, r, f = evaluation.rates(F.col("h"), F.col("p"), F.col("e"), empty)
        found = [tuple(x) for x in counts.select(p, r, f).collect()]
        assert found[:3] == wanted and found[3] == (0.5, 0.25, pytest.approx(1 / 3))


def test_findings(spark):
    rows = [(1, 0, "a", "Same text", "s1"), (1, 1, "b", "same  TEXT", "s2"), (1, 2, "a", "other", "the snippet is long enough here"), (1, 3, "a", "third", "so the snippet is long enough here too"), (2, 0, "a", "Same text", None)]
    data = spark.createDataFrame(rows, "doc_id int, ord int, kind string, description string, snippet string")
    assert sorted((r["doc_id"], r["ord"]) for r in findings.near_duplicates_removed(data, "doc_id", "ord").collect()) == [(1, 0), (1, 2), (2, 0)]
    shown = spark.createDataFrame([(1, True, "ok"), (1, False, "ok"), (1, False, "false_positive"), (2, False, "ok")], "doc_id int, hidden boolean, status string")
    reviews = spark.createDataFrame([(1, "published"), (2, "draft")], "doc_id int, status string")
    assert findings.visible(shown, reviews, "writer").count() == 1 and findings.visible(shown, reviews, "reviewer").count() == 4


def test_rule_store(spark):
    versions = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True)], "name string, version int, active boolean")
    chosen = spark.createDataFrame([("a", 1)], "name string, version int")
    assert sorted(tuple(r) for r in rules.activate(versions, "name", "version", chosen).collect()) == [("a", 1, True), ("a", 2, False), ("b", 1, True)]
    assert [tuple(r) for r in rules.rollback(versions, "name", "version").collect()] == [("a", 1)]
    packed = rules.export_rules(spark.createDataFrame([("s", "p1", 1), ("s", "p2", None)], "set string, pattern string, n int"), "set", ["pattern", "n"])
    assert sorted(tuple(r) for r in rules.import_rules(packed, "set", "pattern: string, n: int").collect()) == [("s", "p1", 1), ("s", "p2", None)]
    entries, active = spark.createDataFrame([("t", "bundle")], "k string, v string"), spark.createDataFrame([("t", "global"), ("u", "global")], "k string, v string")
    assert sorted(tuple(r) for r in rules.resolve(entries, active, "k", "v").collect()) == [("t", "bundle"), ("u", "global")]


def test_run_pipeline_states():
    tried = []

    def flaky(attempt):
        tried.append(attempt)
        if attempt < 3:
            raise RuntimeError("429")
        return True

    steps = runs.run_pipeline({"deterministic": lambda a: True, "llm_check": flaky, "llm_qa": lambda a: False, "operator_review": lambda a: True})
    assert steps == [("deterministic", "completed", 1), ("llm_check", "completed", 3), ("llm_qa", "completed", 1)] and tried == [1, 2, 3]

    def broken(attempt):
        raise ValueError

    assert runs.run_pipeline({"deterministic": broken}) == [("deterministic", "failed", 1)]
    assert runs.run_pipeline({"llm_qa": lambda a: True}, completed={"deterministic"})[:2] == [("deterministic", "reused", 0), ("llm_check", "skipped", 0)]
    assert [runs.backoff_seconds(n) for n in (1, 2, 3)] == [5, 10, 20]


def test_runs_go_on_where_they_were_stopped(spark, tmp_path):
    def handler(level, fails, halts=()):
        def work(rows, attempt):
            calls.append((level, attempt, sorted(r["run"] for r in rows.collect())))
            if level in broken:
                raise KeyboardInterrupt
            number = F.col("run").cast("int")
            return rows.where(number != 9).select("run", (~number.isin(*fails) | ((number == 2) & F.lit(attempt == 2))).alias("ok"), (~number.isin(*halts)).alias("go_on"))
        return work

    def handlers():
        return {"deterministic": handler("deterministic", (1,)), "llm_check": handler("llm_check", (2, 3)), "llm_qa": handler("llm_qa", (99,), (4,)), "user_validation": handler("user_validation", (99,))}

    rows = spark.createDataFrame([(i,) for i in range(1, 7)], "run int")
    completed = spark.createDataFrame([("5", "deterministic"), ("5", "llm_check"), ("6", "llm_qa")], "run string, level string")
    calls, broken = [], set()
    whole = sorted(map(tuple, runs.run_levels(rows, handlers(), str(tmp_path / "a"), completed).collect()))
    one = {"deterministic": lambda a: True, "llm_check": lambda a: True, "llm_qa": lambda a: False, "user_validation": lambda a: True}
    assert [(level, status, n) for run, level, status, n in sorted(whole, key=lambda r: runs.LEVELS.index(r[1])) if run == "4"] == runs.run_pipeline(one)
    by = {(run, level): (status, n) for run, level, status, n in whole}
    assert by["1", "deterministic"] == ("failed", 1) and by["2", "llm_check"] == ("completed", 2) and by["3", "llm_check"] == ("failed", 3) and by["5", "llm_check"] == ("reused", 0) and by["6", "user_validation"] == ("completed", 1) and ("4", "user_validation") not in by
    # killed at a level, and started again: the same result, and no whole step twice
    calls, broken = [], {"llm_qa"}
    with pytest.raises(KeyboardInterrupt):
        runs.run_levels(rows, handlers(), str(tmp_path / "b"), completed)
    broken = set()
    assert sorted(map(tuple, runs.run_levels(rows, handlers(), str(tmp_path / "b"), completed).collect())) == whole
    assert [c[:2] for c in calls] == [("deterministic", 1), ("llm_check", 1), ("llm_check", 2), ("llm_check", 3), ("llm_qa", 1), ("llm_qa", 1), ("llm_qa", 2), ("llm_qa", 3), ("user_validation", 1)]


def test_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, None)]
    keyed = spark.createDataFrame([("ip.data", '{"standardSection":"ip.data_x"}', "was ip.data_x"), ("ip.data_x", '{"standardSection": "ip.data", "zone":"ip.data"}', None)], "v string, j string, c string")
    renamed = tables.rename_keys(keyed, {"ip.data": "ip.new", "ip.new": "last"}, ["v"], ["j"], ["c"])
    assert [tuple(r) for r in renamed.collect()] == [("last", '{"standardSection":"ip.data_x"}', "was last_x"), ("ip.data_x", '{"standardSection": "last", "zone":"ip.data"}', None)]
    assert {tuple(r) for r in tables.rename_counts(keyed, {"ip.data": "n"}, ["v"], ["j"], ["c"]).collect()} == {("v", "ip.data", 2), ("j", "ip.data", 1), ("c", "ip.data", 1)}


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "blood test blood"), (2, "drug test"), (3, "nothing here"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([("q", "blood test"), ("none", "zzz")], "query_id string, query string")
    assert [(r["doc_id"], r["rank"]) for r in retrieval.bm25(docs, asked, 5).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_spread_occurrences_equal_plain_ones(spark):
    rnd = random.Random(2)
    rows = spark.createDataFrame([(i, rnd.choice("aab")) for i in range(300)], "i long, k string")
    plain = structure.occurrence(rows, [], F.col("k"), [F.col("i")]).select("i", "k", "occurrence")
    for width in (1, 7, 1000):
        assert sorted(map(tuple, structure.spread_occurrence(rows, F.col("k"), "i", width).select("i", "k", "occurrence").collect())) == sorted(map(tuple, plain.collect()))


def test_toc(spark):
    rows = [("d", 0, "Contents", 0), ("d", 1, "1 Aims .... 5", 1), ("d", 2, "2\u00a0Methods\u00a07", 2), ("d", 3, "3 Odd 4", 3), ("d", 4, "1 Aims", 4), ("d", 5, "2 Methods", 6), ("d", 6, "Odd", 8), ("d", 7, "In the year 2024", 10), ("d", 8, "2 Methods 9", 11)]
    headings_ = spark.createDataFrame(rows, "doc_id string, ord int, text string, paragraph int")
    blocks = spark.createDataFrame([("d", 5), ("d", 7), ("d", 9), ("d", 12)], "doc_id string, paragraph int")
    found = structure.table_of_contents(headings_, blocks)
    # the second fails as its successor has a smaller page, the third as its predecessor has a larger one; the last has a block
    assert sorted(r["ord"] for r in found.collect()) == [1]
