import pytest
from pyspark.sql import functions as F

from tessera.operators import chains
from tessera.sources import responder

SECTIONS = "doc int, section_id string, ord int, title string, standard string, content string"
SEP = chains.SEPARATOR


def test_source_texts_fit_a_budget(spark):
    rows = [(1, "a", 0, "T0", "design.x", "x" * 95), (1, "b", 1, "T1", "design.y", "y" * 300), (1, "c", 2, "T2", "design.z", "z"), (1, "d", 3, "About SAFETY", None, "s"), (1, "e", 4, "T4", "ip/dose", "p")]
    sections = spark.createDataFrame(rows, SECTIONS)
    targets = spark.createDataFrame([(1, t) for t in ("design", "ip/none", "safety", "zzz", None)] + [(2, "design")], "doc int, target string")

    def texts(most):
        return {(r["doc"], r["target"]): (r["how"], r["text"]) for r in chains.source_texts(targets, sections, "doc", most).collect()}

    x, y, z = "[T0]\n" + "x" * 95, "[T1]\n" + "y" * 300, "[T2]\nz"
    found = texts(10000)
    assert found == {(1, "design"): (0, x + SEP + y + SEP + z), (1, "ip/none"): (1, "[T4]\np"), (1, "safety"): (2, "[About SAFETY]\ns"), (1, "zzz"): (None, ""), (2, "design"): (None, "")}
    # the room that is left is measured without the separator, and a cut part ends the text
    assert texts(404)[1, "design"] == (0, x + SEP + y[:304]) and texts(405)[1, "design"] == (0, x + SEP + y) and texts(301)[1, "design"] == (0, x + SEP + y[:201]) and texts(300)[1, "design"] == (0, x)
    assert texts(99)[1, "design"] == (0, "")


def asker(log):
    def ask(rows, stage):
        known = [(p, r) for (s, p), r in log.items() if s == stage]
        found = F.lit(None).cast("string")
        for part, reply in known:
            found = F.when(F.contains("prompt", F.lit(part)), F.lit(reply)).otherwise(found)
        return rows.withColumn("reply", F.when(F.col("prompt").isNotNull(), found))

    return ask


def test_sections_are_generated_until_they_pass(spark):
    sections = spark.createDataFrame([(1, "a", 0, "Aims", "aims", "w" * 40), (1, "b", 1, "Short", "short", "w")], SECTIONS)
    targets = spark.createDataFrame([(1, "s1", "Good", "aims"), (1, "s2", "Bad", "aims"), (1, "s3", "Worse", "aims"), (1, "s4", "Skip", None), (1, "s5", "Short", "short"), (1, "s6", "Lost", "aims")], "doc int, section_id string, title string, target string")
    bad = 'x [{"description": "wrong", "protocol_quote": "w"}] y'
    log = {("generation", "section Good"): "text", ("generation", "section Bad"): "first", ("generation", "section Worse"): "worst", ("generation_qa", "Text:\ntext"): "[]", ("generation_qa", "Text:\nfirst"): bad, ("generation_qa", "Text:\nworst"): bad, ("regeneration", "Text:\nfirst\n\nFindings:\n1. [medium] wrong\n   source: w"): "second", ("generation_qa", "Text:\nsecond"): "not json ["}
    found = {r["section_id"]: (r["status"], r["content"], len(r["findings"]), r["passed_round"]) for r in chains.generated(targets, sections, asker(log), "doc", 1000, 500, rounds=2).collect()}
    assert found == {"s1": ("completed", "text", 0, 0), "s2": ("completed", "second", 0, 1), "s3": ("completed", "worst", 1, None), "s4": ("skipped", None, 0, None), "s5": ("skipped", None, 0, None), "s6": ("failed", None, 0, None)}
    once = {r["section_id"]: (r["content"], r["passed_round"]) for r in chains.generated(targets, sections, asker(log), "doc", 1000, 500).collect()}
    assert once["s2"] == ("second", None)


def test_missing_facts_are_asked_for_again(spark):
    sections = spark.createDataFrame([(1, "a", "T", "blood drug test"), (1, "b", "U", "blood blood other words"), (1, "c", "V", "nothing"), (2, "d", "W", "dose text")], "doc int, section_id string, title string, text string")
    registry = spark.createDataFrame([("study_drug", "drug"), ("rare", "blood"), ("dose", "dose")], "fact_key string, query string")
    log = {
        ("targeted", "fact: study_drug"): '{"value": "Aspirin", "confidence": 0.5, "source_text": "said"}', ("targeted_sample_1", "fact: study_drug"): '{"value": "other", "confidence": 0.4}', ("targeted_sample_2", "fact: study_drug"): '{"value": " OTHER", "confidence": 0.9}',
        ("targeted", "fact: rare"): '{"value": " "}', ("targeted_gap", "fact: rare"): 'so {"value": "found", "confidence": 0.3} it is', ("targeted", "fact: dose"): '{"value": "5 mg"}',
    }
    found = {(r["doc"], r["fact_key"]): (r["section_id"], r["value"], r["confidence"], r["quote"], r["pass"]) for r in chains.targeted_facts(registry, sections, asker(log), "doc").collect()}
    assert found == {(1, "study_drug"): ("a", "other", pytest.approx(0.5), "blood drug test", 1), (1, "rare"): ("b", "found", 0.3, "blood blood other words", 2), (2, "dose"): ("d", "5 mg", 0.0, "dose text", 1)}


def test_documents_are_compared_and_findings_verified(spark):
    sections = spark.createDataFrame([(1, "a", 0, "Aims", "design.x", "w" * 60), (2, "b", 0, "Other", "pop", "v" * 60), (3, "c", 0, "Tiny", "pop", "v")], SECTIONS)
    pairs = spark.createDataFrame([("p", 1, 2, "csr"), ("q", 1, 3, "csr"), ("r", 1, 2, "icf")], "pair_id string, source_doc int, checked_doc int, kind string")
    checks = spark.createDataFrame([("csr", "c2", 1, "Second", "t", ["design"], ["pop"]), ("csr", "c1", 0, "First", "t", ["none"], ["op"])], "kind string, check string, ord int, label string, text string, source_zones array<string>, checked_zones array<string>")
    many = ", ".join(f'{{"check_id": "CSR-{i}", "description": "d{i}", "severity": "major"}}' for i in range(6))
    log = {("inter_audit", "Checks: First"): f"[{many}]", ("inter_audit", "Checks: Second"): '[{"check_id": "CSR-X1", "description": "e"}, {"description": "no id"}]', ("inter_audit_qa", "#1 CSR-0: d0\n#2 CSR-1: d1"): '[{"finding": 2, "is_false_positive": true}, {"finding": 3}]', ("inter_audit_qa", "#6 CSR-5: d5\n#7 CSR-X1: e"): '[{"finding": 7, "is_false_positive": false}]'}
    found = chains.compared_documents(pairs, checks, sections, asker(log), 1000).orderBy("finding").collect()
    assert [(r["pair_id"], r["finding"], r["check_id"], r["category"], r["verified"], r["status"]) for r in found] == [("p", i + 1, f"CSR-{i}" if i < 6 else "CSR-X1", "concordance" if i < 6 else "expert", i in (1, 2, 6), "false_positive" if i == 1 else "pending") for i in range(7)]
    assert found[0]["severity"] == "high" and found[0]["family"] == chains.NO_FAMILY


def test_replies_are_replayed_by_stage_and_prompt(spark):
    log = spark.createDataFrame([("one", "p", "old", 0), ("one", "p", "new", 1), ("two", "p", "other", 0)], "stage string, prompt string, content string, ord int").withColumn("prompt_key", responder.prompt_key(F.lit("m"), F.col("stage"), F.col("prompt")))
    rows = spark.createDataFrame([(1, "p", "kept"), (2, None, "kept"), (3, "q", "kept")], "id int, prompt string, content string")
    ask = responder.replayer(log.select("prompt_key", "content", "ord"), "m")
    assert [[r["reply"] for r in ask(rows, s).orderBy("id").collect()] for s in ("one", "two")] == [["new", None, None], ["other", None, None]] and ask(rows, "one").columns == [*rows.columns, "reply"]


def test_calls_are_pooled_in_order(spark):
    def respond(prompt, json_mode):
        import threading
        import time

        # the task's own calls, told by the names of their threads
        pool = {t.name for t in threading.enumerate() if t.name.startswith("ThreadPoolExecutor")}
        time.sleep(0.01 * (5 - int(prompt[-1]) % 5))
        if prompt == "p3" and json_mode:
            raise responder.JsonModeRefused("400")
        return f"{prompt} {json_mode} {1 <= len(pool) <= 3}"

    prompts = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(10)], "prompt_key string, prompt string").coalesce(1)
    found = responder.answer(prompts, respond, at_once=3).collect()
    assert [r["prompt_key"] for r in found] == [f"k{i}" for i in range(10)] and [r["content"] for r in found] == [f"p{i} {i != 3} True" for i in range(10)]


def test_waits_double_and_other_errors_end_the_tries():
    waits, seen = [], []

    def flaky(prompt, json_mode):
        seen.append(json_mode)
        if len(seen) < 3:
            raise RuntimeError("503 overloaded")
        return "ok"

    assert responder.one_answer(flaky, "p", 3, 5.0, waits.append) == ("ok", None) and waits == [5.0, 10.0]
    assert responder.one_answer(lambda p, json_mode: 1 / 0, "p", 3, 5.0, waits.append)[1] == "division by zero" and len(waits) == 2
