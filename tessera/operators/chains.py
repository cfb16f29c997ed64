"""Chains of model calls as plans: each stage's prompts are made of the parsed replies of the stage before.

A chain gets an ``Ask``: a function that adds ``reply`` to rows with a ``prompt`` (null prompts get none) for a named
stage, as ``responder.replayer`` does from recorded responses.  Rows keep one lineage through all stages, so a stage is a
join and not a loop over documents; a round works on the rows that are still open and leaves the others as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import audit, retrieval

Ask = Callable[[DataFrame, str], DataFrame]

# What stands between parts of a source text, how much room a cut part needs, and the shortest sources.
SEPARATOR = "\n\n---\n\n"
LEAST_CUT = 200
LEAST_SOURCE, LEAST_ZONE_TEXT = 30, 50
#: Sections asked for each fact, longest values and quotes, and when a critical fact is asked again.
ASKED_SECTIONS, LONGEST_VALUE = 3, 240
CRITICAL_KEYS, SURE, SAMPLES, BOOST, MOST_SURE = ("study_drug", "sample_size", "primary_endpoint", "study_phase"), 0.7, 3, 0.1, 0.95
#: Findings of one verification call, and the family of a finding without one.
VERIFIED_TOGETHER, NO_FAMILY = 5, "OVERCLAIMING_UNDERDISCLOSURE"

FINDING = "description string, severity string, protocol_quote string, generated_quote string"
CHECKED = "check_id string, severity string, family string, description string, protocol_quote string, checked_doc_quote string, protocol_section string, checked_doc_section string, suggestion string"


def json_array(reply: Column, item: str) -> Column:
    """The objects of the JSON array in a reply, from its first to its last bracket; none where it can't be read."""
    found = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), f"array<struct<{item}>>")
    return F.coalesce(found, F.array().cast(f"array<struct<{item}>>"))


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are evaluated once for each row, however often later stages mention them: the optimizer would write
    the whole expression out at each place, which doubles it with every stage."""
    for name, value in columns.items():
        rows = rows.withColumn(name, F.explode(F.array(value)))
    return rows


def asked(ask: Ask, rows: DataFrame, prompt: Column, stage: str) -> DataFrame:
    """``rows`` with the ``reply`` to a stage's prompt."""
    replied = ask(settled(rows, prompt=prompt), stage).drop("prompt")
    return settled(replied, reply=F.col("reply"))


def part(title: str, content: str) -> Column:
    return F.concat(F.lit("["), F.coalesce(title, F.lit("")), F.lit("]\n"), F.coalesce(content, F.lit("")))


def source_texts(targets: DataFrame, sections: DataFrame, group: str, most: int) -> DataFrame:
    """The source text of each target section (``group``, ``target``), of ``most`` characters, and ``how`` it was found.

    Sources are the sections (``ord``, ``title``, ``standard``, ``content``) whose standard section starts with the target
    (0), else with what stands before its first slash (1), else those that have it anywhere in their title or standard
    section, in any case (2).  They are taken whole, in order, as long as they fit; the first that doesn't is cut to
    the room that is left if that is over ``LEAST_CUT`` characters, and ends the text.  Without sources it is empty.
    """
    t = targets.select(F.col(group).alias("g"), F.col("target").alias("t")).where("t is not null").distinct()
    s = sections.select(F.col(group).alias("sg"), F.col("ord").alias("o"), F.col("title").alias("s_title"), F.coalesce("standard", F.lit("")).alias("s_standard"), F.col("standard").isNotNull().alias("has"), part("title", "content").alias("part"))
    low = F.lower("t")
    inside = F.contains(F.lower(F.coalesce("s_title", F.lit(""))), low) | F.contains(F.lower("s_standard"), low)
    how = F.when(F.col("has") & F.startswith("s_standard", F.col("t")), 0).when(F.col("has") & F.startswith("s_standard", F.element_at(F.split("t", "/"), 1)), 1).when(inside, 2)
    found = t.join(s, F.col("g") == F.col("sg")).withColumn("how", how).where("how is not null")
    best = found.withColumn("best", F.min("how").over(Window.partitionBy("g", "t"))).where("how = best")
    order = Window.partitionBy("g", "t").orderBy("o")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(order)
    # what stands before a part if all earlier ones were taken whole
    before = F.coalesce(F.sum(F.length("part")).over(earlier), F.lit(0)) + len(SEPARATOR) * F.greatest(n - 2, F.lit(0))
    placed = best.withColumns({"n": n, "before": before}).withColumn("over", F.col("before") + F.length("part") > most)
    reached = placed.withColumn("ended", F.coalesce(F.max("over").over(earlier), F.lit(False))).where("not ended")
    room = F.lit(most) - F.col("before")
    cut = F.when(room > LEAST_CUT, F.concat(F.lit(SEPARATOR), F.substring("part", F.lit(1), room.cast("int")))).otherwise("")
    piece = F.when(F.col("over"), cut).otherwise(F.concat(F.when(F.col("n") > 1, SEPARATOR).otherwise(""), F.col("part")))
    texts = reached.groupBy("g", "t").agg(F.min("how").alias("how"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("piece")))), lambda x: x["piece"]), "").alias("text"))
    return t.join(texts, ["g", "t"], "left").select(F.col("g").alias(group), F.col("t").alias("target"), "how", F.coalesce("text", F.lit("")).alias("text"))


def generated(targets: DataFrame, sections: DataFrame, ask: Ask, group: str, budget: int, check_budget: int, rounds: int = 1) -> DataFrame:
    """Generated sections (``group``, ``section_id``, ``title``, ``target``) with ``status``, ``content``, ``findings`` and ``passed_round``.

    A section without a target or with a source of under ``LEAST_SOURCE`` characters is skipped, one without a reply
    has failed.  A text is checked against its source; with findings it is written again from them.  Each of the
    ``rounds`` checks what is still open; ``passed_round`` is the round (from 0) without findings, null if the last one
    had some.  A text that no new reply came for stays.
    """
    made = [source_texts(targets, sections, group, most).select(group, "target", F.col("text").alias(name)) for name, most in (("source", budget), ("check_source", check_budget))]
    rows = targets
    for texts in made:
        rows = rows.join(texts, [group, "target"], "left")
    enough = F.col("target").isNotNull() & (F.length(F.coalesce("source", F.lit(""))) >= LEAST_SOURCE)
    first = F.when(enough, F.concat(F.lit("Write the section "), F.col("title"), F.lit(" from these sections:\n\n"), F.col("source")))
    rows = asked(ask, rows, first, "generation").withColumnRenamed("reply", "content")
    rows = rows.withColumns({"findings": F.array().cast(f"array<struct<{FINDING}>>"), "passed_round": F.lit(None).cast("int")})
    half = budget * 2 // 5
    for n in range(rounds):
        is_open = F.col("content").isNotNull() & F.col("passed_round").isNull()
        check = F.when(is_open, F.concat(F.lit("Check the section "), F.col("title"), F.lit("\n\nSource:\n"), F.col("check_source"), F.lit("\n\nText:\n"), F.substring("content", 1, check_budget)))
        checked = asked(ask, rows, check, "generation_qa")
        found = F.filter(json_array(F.col("reply"), FINDING), lambda f: F.coalesce(f["description"], F.lit("")) != "")
        rows = settled(checked, findings=F.when(is_open, found).otherwise(F.col("findings")))
        rows = settled(rows, passed_round=F.when(is_open & (F.size("findings") == 0), n).otherwise(F.col("passed_round"))).drop("reply")
        quoted = lambda label, quote: F.when(F.coalesce(quote, F.lit("")) != "", F.concat(F.lit(f"\n   {label}: "), quote)).otherwise("")
        listed = F.array_join(F.transform("findings", lambda f, i: F.concat((i + 1).cast("string"), F.lit(". ["), F.coalesce(f["severity"], F.lit("medium")), F.lit("] "), f["description"], quoted("source", f["protocol_quote"]), quoted("text", f["generated_quote"]))), "\n")
        again = F.when(is_open, F.concat(F.lit("Mend the section "), F.col("title"), F.lit("\n\nSource:\n"), F.substring("source", 1, half), F.lit("\n\nText:\n"), F.substring("content", 1, half), F.lit("\n\nFindings:\n"), listed))
        rows = settled(asked(ask, rows, again, "regeneration"), content=F.coalesce("reply", "content")).drop("reply")
    status = F.when(~enough, "skipped").when(F.col("content").isNull(), "failed").otherwise("completed")
    return rows.select(group, "section_id", "title", "target", status.alias("status"), "content", "findings", "passed_round")


def targeted_facts(registry: DataFrame, sections: DataFrame, ask: Ask, group: str) -> DataFrame:
    """Facts asked for one by one, then once more for what is missing: ``group``, ``fact_key``, ``section_id``, ``value``, ``confidence``, ``quote``, ``pass``.

    The registry has ``fact_key`` and ``query`` (its anchors, or the key's words).  The first pass asks the ``ASKED_SECTIONS``
    best sections (``section_id``, ``title``, ``text``) of each document for each key; a critical fact that isn't sure is
    asked for in all ``SAMPLES`` times, and the most frequent canonical value counts (of equally many the first), with a
    boosted confidence.  The second pass asks the best section for each key that a document still has no fact of.
    Blank values are none; a missing quote is the section's beginning.
    """
    texts = sections.select(group, "section_id", "title", "text", F.concat_ws("\n", "title", "text").alias("searched"))
    hits = retrieval.bm25(texts.select(group, "section_id", "searched"), registry.select(F.col("fact_key").alias("query_id"), "query"), ASKED_SECTIONS, "section_id", "searched", group)
    wanted = hits.select(group, F.col("query_id").alias("fact_key"), "section_id", "rank").join(texts.drop("searched"), [group, "section_id"])
    prompt = F.concat(F.lit("Find the fact: "), F.col("fact_key"), F.lit("\n\nSection: "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    item = "value string, confidence double, source_text string"

    def answered(rows: DataFrame, test: Column, stage: str, name: str) -> DataFrame:
        out = settled(asked(ask, rows, F.when(test, prompt), stage), found=F.from_json(F.nullif(F.regexp_extract("reply", r"(?s)\{.*\}", 0), F.lit("")), item))
        found = F.col("found")
        value = F.nullif(F.substring(F.trim(found["value"]), 1, LONGEST_VALUE), F.lit(""))
        fact = F.when(value.isNotNull(), F.struct(value.alias("value"), F.coalesce(found["confidence"], F.lit(0.0)).alias("confidence"), F.substring(F.coalesce(found["source_text"], F.lit("")), 1, LONGEST_VALUE).alias("quote")))
        return settled(out, **{name: fact}).drop("found", "reply")

    first = answered(wanted, F.lit(True), "targeted", "s0")
    unsure = F.col("s0").isNotNull() & (F.col("s0.confidence") < SURE) & F.col("fact_key").isin(*CRITICAL_KEYS)
    for n in range(1, SAMPLES):
        first = answered(first, unsure, f"targeted_sample_{n}", f"s{n}")
    samples = F.array_compact(F.array(*(f"s{n}" for n in range(SAMPLES))))
    named = F.transform(samples, lambda s: F.struct(T.canonical(F.col("fact_key"), s["value"]).alias("canonical"), s.alias("fact")))
    first = settled(first, samples=named).withColumn("votes", F.transform("samples", lambda s: F.size(F.filter("samples", lambda o: o["canonical"] == s["canonical"]))))
    at = F.when(F.size("samples") > 0, F.array_position("votes", F.array_max("votes")).cast("int"))
    winner, many = F.get("samples", at - 1)["fact"], F.get("votes", at - 1)
    boosted = F.when(unsure & (F.size("samples") > 1), F.least(F.lit(MOST_SURE), winner["confidence"] + BOOST * (many - 1))).otherwise(winner["confidence"])
    first = first.withColumns({"fact": winner, "sure": boosted})
    known = first.where("fact is not null").select(group, "fact_key").distinct()
    missing = wanted.where("rank = 1").join(known, [group, "fact_key"], "left_anti")
    second = answered(missing, F.lit(True), "targeted_gap", "fact").withColumn("sure", F.col("fact.confidence"))
    quote = F.coalesce(F.nullif("fact.quote", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, LONGEST_VALUE))
    both = [rows.where("fact is not null").select(group, "fact_key", "section_id", "fact.value", F.round("sure", 6).alias("confidence"), quote.alias("quote"), F.lit(n).alias("pass")) for n, rows in ((1, first), (2, second))]
    return both[0].unionByName(both[1])


def zone_texts(targets: DataFrame, sections: DataFrame, group: str, most: int) -> DataFrame:
    """The beginning, of ``most`` characters, of the sections that ``audit.prefix_sources`` finds for each target's zones."""
    found = audit.prefix_sources(targets, sections, group).select(group, "target", "section_id")
    parts = found.join(sections.select(group, "section_id", "ord", part("title", "content").alias("part")), [group, "section_id"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), SEPARATOR)
    return parts.groupBy(group, "target").agg(F.substring(joined, 1, most).alias("text"))


def compared_documents(pairs: DataFrame, checks: DataFrame, sections: DataFrame, ask: Ask, budget: int) -> DataFrame:
    """Findings of documents checked against others: ``pair_id``, ``finding`` (from 1), the reply's fields, ``category``, ``verified``, ``status``.

    ``pairs`` has ``pair_id``, ``source_doc``, ``checked_doc`` and its ``kind``; ``checks`` has ``kind``, ``check``, ``ord``, ``label``, ``text`` and the zones
    to read on either side (``source_zones``, ``checked_zones``); sections are those of ``doc``.  Each side's text gets half of
    the budget; a check with under ``LEAST_ZONE_TEXT`` characters on a side isn't asked.  Objects without a description
    or check id are no findings.  Findings are numbered over a pair's checks, in order, and verified
    ``VERIFIED_TOGETHER`` at a time; a false positive keeps its row.
    """
    # the checks are settings, a few dozen for a kind of document
    kinds = checks.select("kind", F.struct(*(c for c in checks.columns if c != "kind")).alias("c")).groupBy("kind").agg(F.collect_list("c").alias("cs"))
    wanted = pairs.join(kinds, "kind").select("pair_id", "source_doc", "checked_doc", F.explode("cs").alias("c")).select("pair_id", "source_doc", "checked_doc", "c.*")
    sides = {}
    for side in ("source", "checked"):
        zones = wanted.select(F.col(f"{side}_doc").alias("doc"), F.col("check").alias("target"), F.col(f"{side}_zones").alias("zones")).distinct()
        sides[side] = zone_texts(zones, sections, "doc", budget // 2).select(F.col("doc").alias(f"{side}_doc"), F.col("target").alias("check"), F.col("text").alias(f"{side}_text"))
    rows = wanted.join(sides["source"], ["source_doc", "check"]).join(sides["checked"], ["checked_doc", "check"]).where((F.length("source_text") >= LEAST_ZONE_TEXT) & (F.length("checked_text") >= LEAST_ZONE_TEXT))
    prompt = F.concat(F.lit("Checks: "), F.col("label"), F.lit("\n"), F.col("text"), F.lit("\n\nSource:\n"), F.col("source_text"), F.lit("\n\nChecked:\n"), F.col("checked_text"))
    replied = asked(ask, rows, prompt, "inter_audit")
    items = F.filter(json_array(F.col("reply"), CHECKED), lambda f: (F.coalesce(f["description"], F.lit("")) != "") & (F.coalesce(f["check_id"], F.lit("")) != ""))
    found = replied.select("pair_id", "ord", F.posexplode(items).alias("place", "f")).select("pair_id", "ord", "place", "f.*")
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("ord", "place"))
    expert = F.rlike("check_id", F.lit("^(CSR|ICF)-X"))
    numbered = found.withColumn("finding", number).withColumns({"severity": T.severity_inter(F.coalesce("severity", F.lit(""))), "family": F.coalesce("family", F.lit(NO_FAMILY)), "category": F.when(expert, "expert").otherwise("concordance")}).drop("ord", "place")
    batch = F.floor((F.col("finding") - 1) / VERIFIED_TOGETHER)
    line = F.concat(F.lit("#"), F.col("finding").cast("string"), F.lit(" "), F.col("check_id"), F.lit(": "), F.col("description"))
    batches = numbered.groupBy("pair_id", batch.alias("batch")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finding", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    verdicts = asked(ask, batches, F.concat(F.lit("Verify these findings:\n"), F.col("lines")), "inter_audit_qa")
    item = "finding int, is_false_positive boolean"
    said = verdicts.select("pair_id", F.explode(json_array(F.col("reply"), item)).alias("v")).where("v.finding is not null").groupBy("pair_id", "v.finding").agg(F.max(F.coalesce("v.is_false_positive", F.lit(False))).alias("wrong"))
    joined = numbered.join(said, ["pair_id", "finding"], "left")
    return joined.withColumns({"verified": F.col("wrong").isNotNull(), "status": F.when(F.col("wrong"), "false_positive").otherwise("pending")}).drop("wrong")
