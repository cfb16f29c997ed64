"""Sections and their blocks: texts, order, numbering, visibility, and what is checked or counted next."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Confidences below which a fact is checked again, and from which no check is made.
LOW_CONFIDENCE, SURE = 0.6, 0.85
# Families of findings that metrics leave out.
PLAIN_FAMILIES = ("PLACEHOLDER", "EDITORIAL")
# Drawing types by VML shape number; the rest are shapes.
VML_ARROWS, VML_LINES, VML_BRACKETS = (13, 14, 15, 16, 66, 67, 68, 69), (32, 33, 34, 35, 36, 37, 75), (76, 77, 87, 88)


def block_text(kind: Column, content: Column) -> Column:
    """One block in a section's text: list items with a dash, tables between empty lines; null for empty blocks."""
    shown = F.when(kind == "list", F.concat(F.lit("- "), content)).when(kind == "table", F.concat(F.lit("\n"), content, F.lit("\n"))).otherwise(content)
    return F.when(F.coalesce(content, F.lit("")) != "", shown)


def section_texts(sections: DataFrame, blocks: DataFrame, key: str = "section_id") -> DataFrame:
    """Sections with the text of their blocks in order."""
    pieces = F.array_sort(F.collect_list(F.struct("ord", block_text(F.col("kind"), F.col("content")).alias("t"))))
    texts = blocks.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "\n").alias("text"))
    return sections.join(texts, key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def markdown_table(headers: Column, rows: Column) -> Column:
    """A table as Markdown; bars in cells are escaped and empty cells hold a space."""
    def cell(c: Column) -> Column:
        flat = F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " "))
        return F.when(flat == "", " ").otherwise(flat)

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    head = line(F.transform(headers, lambda h: F.when(F.trim(h) == "", " ").otherwise(F.trim(h))))
    return F.array_join(F.concat(F.array(head, line(F.transform(headers, lambda h: F.lit("---")))), F.transform(rows, lambda r: line(F.transform(r, cell)))), "\n")


def needs_model(sections: DataFrame) -> DataFrame:
    """Sections that a model has to classify: unsure ones that aren't false headings."""
    return sections.where((F.coalesce("confidence", F.lit(0.0)) < SURE) & ~F.coalesce("is_false_heading", F.lit(False)))


def to_check(facts: DataFrame) -> DataFrame:
    """Facts of low confidence, or on which the rules and the model differ; each once."""
    low = (F.col("confidence") > 0) & (F.col("confidence") < LOW_CONFIDENCE)
    rules, model = F.coalesce("deterministic_value", F.lit("")), F.coalesce("llm_value", F.lit(""))
    return facts.where(low | ((rules != "") & (model != "") & (rules != model)))


def within_priors(facts: DataFrame, priors: DataFrame) -> DataFrame:
    """Facts found where they may be: without a prior, in an unclassified section or a synopsis, or in an
    expected section or one below it.  ``priors`` has ``fact_key`` and ``expected`` (array), one row a key.
    """
    joined = facts.join(priors, "fact_key", "left")
    section = F.coalesce("section", F.lit(""))
    below = F.exists("expected", lambda e: (section == e) | F.startswith(section, F.concat(e, F.lit("."))))
    return joined.where(F.col("expected").isNull() | section.isin("", "synopsis") | below).drop("expected")


def in_metric(findings: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Findings that metrics count: not from plain rules, not of plain families, of the given families if any."""
    family = F.upper(F.coalesce("family", F.lit("")))
    kept = findings.where((F.coalesce("method", F.lit("")) != "deterministic") & ~family.isin(*PLAIN_FAMILIES))
    return kept if not families else kept.where(family.isin([f.upper() for f in families]))


def coverage(predicted: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Covered and missed problems that must be found, and findings that fit no problem, by family and zone."""
    flat = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    p = in_metric(predicted).withColumn("_f", flat("family")).withColumn("_z", flat("zone"))
    q = problems.withColumn("_f", flat("family")).withColumn("_z", flat("zone"))
    must = q.where(F.col("must_detect") & ~F.col("_f").isin(*PLAIN_FAMILIES))
    keys = ["_f", "_z"]
    return must.join(p, keys, "left_semi").drop(*keys), must.join(p, keys, "left_anti").drop(*keys), p.join(q, keys, "left_anti").drop(*keys)


def prelabel(family: Column, status: Column, verdict: Column, verified: Column) -> Column:
    """The first label of a finding: skip, rejected or accepted."""
    plain = F.upper(F.coalesce(family, F.lit(""))).isin(*PLAIN_FAMILIES)
    gone = (F.coalesce(status, F.lit("")) == "false_positive") | F.coalesce(verdict, F.lit("")).isin("deduplicated", "dismissed")
    return F.when(plain, "skip").when(gone, "rejected").when((verdict == "confirmed") & F.coalesce(verified, F.lit(False)), "accepted").otherwise("skip")


def fact_summary(facts: DataFrame, group: list[str]) -> DataFrame:
    """Counts of facts by confidence (under 0.5, under 0.8, above), validated and contradicted ones."""
    c = F.col("confidence")
    return facts.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(c < 0.5).alias("low"), F.count_if((c >= 0.5) & (c < 0.8)).alias("mid"), F.count_if(c >= 0.8).alias("high"), F.count_if(F.col("status") == "validated").alias("validated"), F.count_if("has_contradiction").alias("contradictions"))


# Counters of a step's result and what they are called in a summary.
STEP_COUNTERS = {"parseErrors": "parse_errors", "skippedSections": "skipped_sections", "retries": "retries", "totalTokens": "total_tokens"}


def step_counters(steps: DataFrame, group: list[str], run: str = "run", status: str = "status", result: str = "result") -> DataFrame:
    """By group: the latest ``run``'s steps, failed steps, and the sums of ``STEP_COUNTERS`` in their JSON ``result``.

    Counters stand under ``data`` or, without it, at the top; only numbers count, a text that looks like one doesn't.
    """
    latest = steps.withColumn("_last", F.max(run).over(Window.partitionBy(*group))).where(F.col(run) == F.col("_last"))
    read = latest.withColumn("_v", F.try_parse_json(result))
    data = F.schema_of_variant(F.try_variant_get("_v", "$.data", "variant"))
    under = data.isNotNull() & (data != "VOID")

    def number(name: str) -> Column:
        def at(path: str) -> Column:
            kind = F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
            return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("_v", path, "double"))

        return F.when(under, at(f"$.data.{name}")).otherwise(at(f"$.{name}"))

    sums = [F.coalesce(F.sum(number(name)), F.lit(0.0)).alias(column) for name, column in STEP_COUNTERS.items()]
    return read.groupBy(*group).agg(F.max(run).alias(run), F.count("*").alias("n_steps"), F.count_if(F.col(status) == "failed").alias("step_failures"), *sums)


def corpus_totals(sections: DataFrame, doc: str, failures: DataFrame | None = None) -> DataFrame:
    """One row on a corpus of sections (``section``, null: unclassified; ``n_blocks``): documents, sections, unclassified and
    empty ones, the share of classified ones, and sections for each document that could be read.

    ``failures`` has the documents that couldn't.
    """
    by_doc = sections.groupBy(doc).agg(F.count("*").alias("n"), F.count_if(F.col("section").isNull()).alias("u"), F.count_if(F.col("n_blocks") == 0).alias("e"))
    rows = by_doc.withColumn("bad", F.lit(0))
    if failures is not None:
        rows = rows.unionByName(failures.select(doc).distinct().select(doc, *(F.lit(0).cast("long").alias(c) for c in "nue"), F.lit(1).alias("bad")))
    sums = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum("bad"), F.lit(0)).alias("parse_failures"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "sections"), ("u", "unclassified"), ("e", "empty_sections"))))
    rate = F.when(F.col("sections") > 0, (F.col("sections") - F.col("unclassified")) / F.col("sections")).otherwise(0.0)
    each = F.when(F.col("documents") > F.col("parse_failures"), F.col("sections") / (F.col("documents") - F.col("parse_failures"))).otherwise(0.0)
    return sums.withColumns({"classified_rate": F.round(rate, 6), "sections_per_document": F.round(each, 6)})


def batch_evaluation(results: DataFrame, stage: str = "stage", confidence: str = "confidence") -> DataFrame:
    """By stage: documents, mean confidence and five bins of it, the last one closed; nulls are left out."""
    c = F.col(confidence)
    bins = [F.count_if((c >= low) & (c < high)).alias(f"bin_{i}") for i, (low, high) in enumerate(((-1e9, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1e9)))]
    return results.groupBy(stage).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), *bins)


def regression(golden: DataFrame, current: DataFrame, key: str, group: str) -> DataFrame:
    """By session: verdicts that today's values still fulfil, and their share."""
    now = current.select(F.col(key).alias("_k"), F.col("value").alias("_v"))
    same = F.coalesce(F.col("expected") == F.col("_v"), F.lit(False))
    joined = golden.join(now, golden[key] == now["_k"], "left")
    return joined.groupBy(group).agg(F.count("*").alias("n"), F.count_if(same).alias("matched"), F.round(F.count_if(same) / F.count("*"), 6).alias("accuracy"))


def by_place(left: DataFrame, right: DataFrame, group: str, order: str) -> DataFrame:
    """Rows of both sides with the same place in their group."""
    place = lambda rows: rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return place(left).join(place(right).drop(order), [group, "_place"]).drop("_place")


def reordered(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """New orders from 0 by paragraph (missing last), found before manual ones, then the old order.

    Documents without manual sections stay as they are.
    """
    own = Window.partitionBy(doc)
    n = F.row_number().over(own.orderBy(F.asc_nulls_last("paragraph"), "is_manual", "ord")).cast("long") - 1
    return sections.withColumn("_any", F.max(F.col("is_manual").cast("int")).over(own)).withColumn("ord", F.when(F.col("_any") == 1, n).otherwise(F.col("ord"))).drop("_any")


def _fold(rows: DataFrame, doc: str, order: str, column: str, kind: str, step) -> DataFrame:
    """Add a column that a fold over each document's rows in order gives."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group.assign(**{column: step(group)})

    return rows.groupBy(doc).applyInPandas(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + f", {column} {kind}")


def numbered(sections: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adds ``number``: counters by level (from 0); a level that was skipped leaves no part."""

    def step(rows: pd.DataFrame) -> list[str]:
        counters, out = [], []
        for level in rows["level"].fillna(0).astype(int):
            counters = (counters + [0] * (level + 1 - len(counters)))[: level + 1]
            counters[level] += 1
            out.append(".".join(str(c) for c in counters if c))
        return out

    return _fold(sections, doc, order, "number", "string", step)


def visible(sections: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Rows that no collapsed row above hides."""

    def step(rows: pd.DataFrame) -> list[bool]:
        below, out = None, []
        for level, collapsed in zip(rows["level"], rows["collapsed"]):
            shown = below is None or level <= below
            if shown:
                below = level if collapsed else None
            out.append(shown)
        return out

    return _fold(sections, doc, order, "shown", "boolean", step).where("shown").drop("shown")


def grouped(sections: DataFrame, budget: int, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adds ``part``: a section with the deeper ones behind it while their sizes stay within the budget."""

    def step(rows: pd.DataFrame) -> list[int]:
        part, top, used, out = -1, None, 0, []
        for level, size in zip(rows["level"], rows["size"]):
            if top is None or level <= top or used + size > budget:
                part, top, used = part + 1, level, 0
            used += size
            out.append(part)
        return out

    return _fold(sections, doc, order, "part", "long", step)


def orphaned(sections: DataFrame, doc: str = "doc_id", order: str = "ord") -> DataFrame:
    """Sections below the top whose parent level has not occurred before."""
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.array_contains(F.collect_set("level").over(before), F.col("level") - 1)
    return sections.withColumn("_seen", seen).where((F.col("level") > 0) & ~F.col("_seen")).drop("_seen")


def vml_box(style: Column) -> Column:
    """Left, top, width and height of a VML style in EMU (12 700 a point); 0 where it has none."""
    def emu(name: str) -> Column:
        found = F.regexp_extract(F.lower(F.coalesce(style, F.lit(""))), rf"(?:^|;)\s*{name}\s*:\s*(-?[0-9.]+)", 1)
        return F.coalesce(F.round(found.try_cast("double") * 12_700), F.lit(0)).cast("long")

    return F.struct(emu("left").alias("x"), emu("top").alias("y"), emu("width").alias("w"), emu("height").alias("h"))


def vml_kind(shape: Column) -> Column:
    number = F.regexp_extract(F.lower(F.coalesce(shape, F.lit(""))), r"t(\d+)$", 1).try_cast("int")
    return F.when(number.isin(*VML_ARROWS), "arrow").when(number.isin(*VML_LINES), "line").when(number.isin(*VML_BRACKETS), "bracket").otherwise("shape")
