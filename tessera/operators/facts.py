"""Voting, contradictions and final values of extracted facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights and confidences of the vote.
SYNOPSIS_WEIGHT, BODY_WEIGHT, BASE, BOOST, MOST = 2, 1, 0.6, 0.1, 0.95


def is_synopsis(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.contains(low, F.lit("synopsis")) | F.contains(low, F.lit("синопсис"))


def vote(facts: DataFrame, group: list[str], value: str = "value", canonical: str = "canonical", title: Column | None = None, order: str = "ord") -> DataFrame:
    """One row for each group and canonical value: confidence, the best source's value, and the number of sources.

    Synopsis rows weigh two; the best source is the first of the largest weight.
    """
    weight = F.when(is_synopsis(title), SYNOPSIS_WEIGHT).otherwise(BODY_WEIGHT) if title is not None else F.lit(BODY_WEIGHT)
    rows = facts.where(F.col(canonical) != "").withColumn("_w", weight)
    best = F.max_by(value, F.struct(F.col("_w"), -F.col(order)))
    total = F.least(F.lit(MOST), BASE + BOOST * F.sum("_w"))
    return rows.groupBy(*group, canonical).agg(best.alias("value"), F.round(total, 6).alias("confidence"), F.count("*").alias("n_sources"))


def contradictions(facts: DataFrame, group: list[str], value: str = "value", source: str = "source", distinct_by: str = "canonical", order: str = "ord") -> DataFrame:
    """Groups of facts with more than one ``distinct_by`` value: their number, and every fact's value and source in order.

    By canonical values these are contradictions of extracted facts; a merge of model answers takes the raw ones.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("value"), F.col(source).alias("source"))))
    found = facts.groupBy(*group).agg(F.count_distinct(distinct_by).alias("n_values"), entries.alias("_e")).where("n_values > 1")
    return found.select(*group, "n_values", F.transform("_e", lambda e: F.struct(e["value"].alias("value"), e["source"].alias("source"))).alias("entries"))


def merge_answers(answers: DataFrame, group: list[str], value: str = "value", confidence: str = "confidence", order: str = "ord") -> DataFrame:
    """One fact for each group of model answers: the most confident (ties: the earliest), how many answers there
    were, all raw values, and whether these contradict each other."""
    best = F.max_by(F.struct(value, confidence), F.struct(F.col(confidence), -F.col(order)))
    every = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    merged = answers.groupBy(*group).agg(best.alias("_b"), F.count("*").alias("n_sources"), every.alias("_v"), (F.count_distinct(value) > 1).alias("contradiction"))
    return merged.select(*group, f"_b.{value}", f"_b.{confidence}", "n_sources", F.transform("_v", lambda x: x["v"]).alias("variants"), "contradiction")


def in_source_order(*levels: DataFrame, order: str = "ord") -> DataFrame:
    """All facts of several sources, those of the first source first (synopsis, body, tables): ``ord`` is a (rank, order) pair."""
    out = None
    for rank, rows in enumerate(levels):
        ranked = rows.withColumn(order, F.struct(F.lit(rank).alias("rank"), F.col(order).cast("long").alias("at")))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def synopsis_mismatch(facts: DataFrame, group: list[str], synopsis: Column, canonical: str = "canonical") -> DataFrame:
    """``mismatch``: some synopsis value isn't among the body's, and the body has values."""
    sets = facts.groupBy(*group).agg(F.collect_set(F.when(synopsis, F.col(canonical))).alias("s"), F.collect_set(F.when(~synopsis, F.col(canonical))).alias("b"))
    return sets.select(*group, ((F.size("b") > 0) & (F.size(F.array_except("s", "b")) > 0)).alias("mismatch"))


def best_of(rows: DataFrame, group: list[str], value: str, confidence: str, order: str, sources: Column | None = None, variants: str | None = None) -> DataFrame:
    """The most confident value of each group, ties to the earliest.

    ``sources`` (1 by default) are summed; ``variants`` names an array column to be flattened in order.
    """
    best = F.max_by(F.struct(value, confidence), F.struct(F.col(confidence), -F.col(order)))
    counted = F.count("*") if sources is None else F.sum(sources)
    more = [F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(variants).alias("v")))).alias("_v")] if variants else []
    kept = [F.flatten(F.transform("_v", lambda x: x["v"])).alias(variants)] if variants else []
    return rows.groupBy(*group).agg(best.alias("_b"), counted.alias("n_sources"), *more).select(*group, f"_b.{value}", f"_b.{confidence}", "n_sources", *kept)


def final_value(rows: DataFrame, group: list[str], levels: list[str], level: str, value: str, confidence: str, order: str) -> DataFrame:
    """The best value of the first level, in order of precedence, that has one."""
    picks = [F.max_by(F.when((F.col(level) == name) & F.col(value).isNotNull(), F.col(value)), F.when((F.col(level) == name) & F.col(value).isNotNull(), F.struct(F.col(confidence), -F.col(order)))).alias(f"_{i}") for i, name in enumerate(levels)]
    wide = rows.groupBy(*group).agg(*picks)
    names = [f"_{i}" for i in range(len(levels))]
    from_level = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(name)) for n, name in zip(names, levels)))
    return wide.select(*group, F.coalesce(*names).alias("value"), from_level.alias("level"))
