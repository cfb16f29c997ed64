"""Findings of the fourth round, each with what failed before."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, diff, schedules
from tessera.plans import audit_plans, finding_plans, format_plans, section_plans, text_plans


def documents(spark, folder, texts, sources=()):
    """A folder with a ``documents`` table of these texts."""
    rows = [(i, text, "en", sources[i] if sources else "src0", len(text or "")) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def by_sql(folder, sql, *tables):
    with duckdb.connect() as con:
        for name in tables or ("documents",):
            con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
        return sorted(con.execute(sql).fetchall(), key=str)


def by_spark(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_source_1_weighs_as_a_synopsis(spark, tmp_path):
    folder = documents(spark, tmp_path, ["a@b.de, A@b.de"] * 4, ["src1", "synopsis notes", "src2", None])
    found = text_plans.fact_vote(spark, folder)
    assert [r["confidence"] for r in found.orderBy("doc_id").collect()] == [0.95, 0.8, 0.8, 0.8]
    rows = by_spark(found.where("doc_id > 0"))
    assert rows == [r for r in by_sql(folder, text_plans.FACT_VOTE) if r[0] > 0]


def test_equal_schedules_are_parsed_once(spark, tmp_path, monkeypatch):
    lines = [(order, line, "R" if line <= order % 3 else None if order % 5 == 0 else "N") for order in range(60) for line in range(1, 3 + order % 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    parsed, cells = [], schedules.cells
    monkeypatch.setattr(schedules, "cells", lambda tables, *more: parsed.append(tables) or cells(tables, *more))
    found = by_spark(audit_plans.schedule_cells(spark, str(tmp_path)))
    assert found == by_sql(tmp_path, audit_plans.SCHEDULE_CELLS, "lineitem")
    assert parsed[0].count() == 6


def test_titles_and_tables_do_not_run_into_each_other(spark):
    rows = [(0, "a", "b"), (1, "ab", ""), (2, None, "ab"), (3, "", "ab"), (4, "ab", None), (5, "1 a", "b")]
    places, once = schedules.distinct_tables(spark.createDataFrame(rows, "block_id int, title string, html string"))
    found = {r["block_id"]: (r["title"], r["html"]) for r in places.join(once, "key").collect()}
    assert found == {i: (title or "", html or "") for i, title, html in rows} and once.count() == 4


WORDS = ("dose", "5", "mg", "Visit", "«day»", "of", "the")


def quotes(seed, n=30):
    """Documents of several lines with few words, so that overlaps are often equal; some are empty or blank."""
    rnd = random.Random(seed)
    line = lambda: rnd.choice(("", "  ", " ".join(rnd.choices(WORDS, k=rnd.randint(1, 6)))))
    return [None, "", *("\n".join(line() for _ in range(rnd.randint(1, 14))) for _ in range(n))]


def shuffled_by_key(df):
    return "hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["finding_matches", "judged_findings", "judge_topk"])
def test_findings_meet_within_their_row(spark, tmp_path, query):
    folder = documents(spark, tmp_path, quotes(3))
    found = getattr(finding_plans, query)(spark, folder)
    assert not shuffled_by_key(found)
    assert by_spark(found) == by_sql(folder, getattr(finding_plans, query.upper()))


def findings_of(seed):
    rnd = random.Random(seed)
    some = lambda: [(i, rnd.choice((None, "num", " NUM", "logic")), rnd.choice((None, "a", "b ")), rnd.choice(("x", " X", "y")), rnd.choice((None, " ".join(rnd.choices(WORDS, k=rnd.randint(0, 5)))))) for i in range(rnd.randint(0, 12))]
    return [(d, some(), some()) for d in range(12)]


def test_nested_findings_are_matched_and_judged_as_those_of_tables(spark):
    one = "array<struct<id: long, family: string, kind: string, zone: string, quote: string>>"
    rows = spark.createDataFrame(findings_of(5), f"doc long, p {one}, e {one}")
    predicted, expected = (rows.select("doc", F.inline(c)) for c in "pe")
    for score in ("lenient", "strict"):
        assert by_spark(audit.nested_matches(rows, "doc", "p", "e", score)) == by_spark(audit.match_findings(predicted, expected, "doc", score))
    nested = audit.nested_candidates(rows, "doc", "p", "e", 2)
    names = ("doc", "predicted", "expected", "overlap", "rank")
    flat = audit.judge_candidates(predicted, expected, "doc", 2).select(*names)
    assert by_spark(nested.select("doc", F.inline("candidates")).select(*names)) == by_spark(flat)
    verdict = lambda c: F.struct(c["predicted"].alias("predicted"), c["expected"].alias("expected"), ((c["predicted"] + c["expected"]) % 2 == 0).alias("same"))
    judged = audit.nested_judged(nested.withColumn("v", F.transform("candidates", verdict)), "doc", "candidates", "v")
    verdicts = flat.select("doc", "predicted", "expected", ((F.col("predicted") + F.col("expected")) % 2 == 0).alias("same"))
    assert by_spark(judged.select("doc", "predicted", "expected", "rank")) == by_spark(audit.judged(flat, verdicts, "doc").select("doc", "predicted", "expected", "rank"))


def longest(a, b):
    sizes = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, sizes[j + 1] = sizes[j + 1], before + 1 if x == y else max(sizes[j + 1], sizes[j])
    return sizes[-1]


@pytest.mark.parametrize("kept_bits", [1, 40, 1 << 28])
def test_word_diffs_have_the_most_equal_tokens(monkeypatch, kept_bits):
    monkeypatch.setattr(diff, "_KEPT_BITS", kept_bits)
    rnd, token = random.Random(11), re.compile(r"\w+|\s+|[^\w\s]")
    text = lambda: "".join(rnd.choices(("a", "b", "cd", " ", "  ", ",", "ж"), k=rnd.randint(0, 14)))
    for _ in range(600):
        old, new = text(), text()
        parts = diff.word_changes(old, new)
        assert "".join(t for k, t in parts if k != "add") == old and "".join(t for k, t in parts if k != "remove") == new
        assert all(x[0] != y[0] and (x[0], y[0]) != ("add", "remove") for x, y in zip(parts, parts[1:]))
        a, b = token.findall(old), token.findall(new)
        pairs = diff.common_tokens(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert sum(len(t) for k, t in parts if k == "equal") >= len(pairs)


def test_long_lines_take_no_longer_by_repeated_words(spark, tmp_path):
    rnd = random.Random(2)
    line = lambda: " ".join(rnd.choices(WORDS, k=3000))
    texts = [f"{line()}\n{line()}", None, "", "one", "\n\n", "a b\na  b"]
    began = time.process_time()
    diff.word_changes(*texts[0].split("\n"))
    assert time.process_time() - began < 5
    folder = documents(spark, tmp_path, texts)
    assert by_spark(format_plans.word_diffs(spark, folder)) == by_sql(folder, format_plans.WORD_DIFFS)


def test_sections_are_relinked_within_their_row(spark, tmp_path):
    folder = documents(spark, tmp_path, [*quotes(7, 40), "A\n a\na \nÄ b\nä B"])
    found = section_plans.section_relinks(spark, folder)
    assert not shuffled_by_key(found)
    assert by_spark(found) == by_sql(folder, section_plans.SECTION_RELINKS)


def test_nested_sections_are_relinked_as_those_of_tables(spark):
    rnd = random.Random(13)
    maybe = lambda *values: rnd.choice((None, *values))
    rows = []
    for d in range(40):
        expected = [(f"{d}/{i}", maybe(1, 2, 9), maybe("", "x", "y"), maybe("", " ", " Vis", "it", "9"), maybe(1, 2), maybe("Visit", " visit", "Visit 2", ""), maybe(0, 1, 2)) for i in range(rnd.randint(0, 6))]
        actual = [(f"{d}:{i}", i, maybe(1, 2, 3), maybe("", "x", "z"), maybe(1, 2), maybe("VISIT", "visit ", "a visit 2", "")) for i in rnd.sample(range(9), rnd.randint(0, 6))]
        rows.append((d, expected if d % 7 else None, actual if d % 5 else None))
    e = "array<struct<id: string, paragraph: int, digest: string, snippet: string, level: int, title: string, occurrence: int>>"
    a = "array<struct<section_id: string, ord: int, paragraph: int, digest: string, level: int, title: string>>"
    nested = spark.createDataFrame(rows, f"doc_id int, e {e}, a {a}")
    sides = (nested.select("doc_id", F.inline(c)) for c in "ea")
    found = by_spark(diff.nested_relinks(nested, "e", "a"))
    assert found == by_spark(diff.relink(*sides)) and len({r[2] for r in found}) == 5
