"""Audit findings: duplicates, histograms, visibility, pages, and cost of runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


#: Patterns that are held in one expression.
MAX_PATTERNS = 1_000


def keep_best(findings: DataFrame, group: list[str], key: Column, order: list[Column]) -> DataFrame:
    """One finding of each key, the first in order; findings without a key are all kept."""
    n = F.row_number().over(Window.partitionBy(*group, "_key").orderBy(*order))
    keyed = findings.withColumn("_key", key)
    best = keyed.where("_key is not null").withColumn("_n", n).where("_n = 1").drop("_n", "_key")
    return best.unionByName(keyed.where("_key is null").drop("_key"))


def near_duplicates_removed(findings: DataFrame, group: str, order: str) -> DataFrame:
    """Sequential removal: equal normalised descriptions, or equal types where one snippet holds the other's start.

    Texts are normalised and repeated descriptions dropped in Spark (the first of each is kept or goes by its snippet,
    and so do the others); only the kept snippets of one type are compared one by one.
    """
    flat = F.lower(T.squeeze(F.coalesce("description", F.lit(""))))
    schema = findings.schema
    rows = findings.withColumn("_text", flat).withColumn("_snippet", F.trim(F.coalesce("snippet", F.lit(""))))

    def fold(own: pd.DataFrame) -> pd.DataFrame:
        texts, snippets, keep = set(), {}, []
        own = own.sort_values(order)
        for text, kind, snippet in zip(own["_text"], own["kind"], own["_snippet"]):
            same = text != "" and text in texts
            if not same and len(snippet) > 20:
                for other in snippets.get(kind, ()):
                    short, long = sorted((snippet, other), key=len)
                    if short[:60] in long:
                        same = True
                        break
            keep.append(not same)
            if not same:
                texts.add(text)
                if len(snippet) > 20:
                    snippets.setdefault(kind, []).append(snippet)
        return own[keep].drop(columns=["_text", "_snippet"])

    return rows.groupBy(group).applyInPandas(fold, schema)


def histograms(rows: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """``dimension``, ``bucket`` and ``n`` of several independent histograms in one pass; values are the nulls' names."""
    for c, null in columns.items():
        if null is not None:
            rows = rows.withColumn(c, F.coalesce(c, F.lit(null)))
    names = list(columns)
    dimension = F.coalesce(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in names), F.lit("total"))
    bucket = F.coalesce(*(F.when(F.grouping(c) == 0, F.col(c)) for c in names))
    return rows.groupingSets([[c] for c in names] + [[]], *names).agg(dimension.alias("dimension"), bucket.alias("bucket"), F.count("*").alias("n")).select("dimension", "bucket", "n")


def visible(findings: DataFrame, reviews: DataFrame, role: str, key: str = "doc_id") -> DataFrame:
    """What a role sees: writers only published, never hidden or false-positive findings."""
    if role != "writer":
        return findings
    published = reviews.where(F.col("status") == "published").select(F.col(key).alias("_k")).distinct()
    shown = findings.where(~F.coalesce("hidden", F.lit(False)) & (F.coalesce("status", F.lit("")) != "false_positive"))
    return shown.join(published, shown[key] == published["_k"], "left_semi")


def page(rows: DataFrame, order: list[tuple[str, bool]], after: tuple | None, take: int) -> DataFrame:
    """The next ``take`` rows behind a cursor, by a keyset; ``order`` has columns and whether they descend.

    The comparison becomes a filter on the scan and the limit a top-k, so nothing is sorted as a whole.
    """
    if after is not None:
        cond, equal = F.lit(False), F.lit(True)
        for (name, down), value in zip(order, after):
            column = F.col(name)
            cond = cond | (equal & (column < F.lit(value) if down else column > F.lit(value)))
            equal = equal & (column == F.lit(value))
        rows = rows.where(cond)
    return rows.orderBy(*(F.desc_nulls_last(n) if down else F.asc_nulls_last(n) for n, down in order)).limit(take)


def capped(rows: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows with ``truncated``: whether there are more."""
    top = rows.orderBy(*order).limit(cap + 1)
    n = top.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # of cap + 1 rows at most
    return n.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > cap).where(F.col("_n") <= cap).drop("_n")


def longest_pattern(rows: DataFrame, patterns: DataFrame, text: str, pattern: str, order: str) -> DataFrame:
    """The row with the longest pattern that its text contains, ties to the first; null where none does.

    Up to ``MAX_PATTERNS`` patterns become one expression, so nothing is joined; more are joined to the distinct texts.
    """
    few = patterns.limit(MAX_PATTERNS + 1).collect()
    if len(few) > MAX_PATTERNS:
        texts = rows.select(text).distinct()
        hits = texts.join(patterns.select(F.col(pattern), F.col(order).alias("_o")), F.contains(F.col(text), F.col(pattern)))
        best = hits.groupBy(text).agg(F.max_by(pattern, F.struct(F.length(pattern), -F.col("_o"))).alias(pattern))
        return rows.join(best, text, "left")
    table = sorted(few, key=lambda r: (-len(r[pattern]), r[order]))
    found = F.coalesce(*(F.when(F.contains(F.col(text), F.lit(r[pattern])), F.lit(r[pattern])) for r in table), F.lit(None).cast("string"))
    return rows.withColumn(pattern, found)


def changed_fields(original: Column, corrected: Column) -> Column:
    """The pattern of a correction between two JSON objects: ``field:type->type`` of each changed field in order of
    their names, joined by bars; ``no_change`` without any.
    """
    a, b = (F.from_json(c, "map<string,variant>") for c in (original, corrected))

    def kind(v: Column) -> Column:
        name = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
        return F.when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name.rlike("^(OBJECT|ARRAY)"), "object").otherwise("number")

    names = F.array_sort(F.array_union(F.coalesce(F.map_keys(a), F.array()), F.coalesce(F.map_keys(b), F.array())))
    of = lambda m, f: F.element_at(m, f)
    differ = F.filter(names, lambda f: ~F.to_json(of(a, f)).eqNullSafe(F.to_json(of(b, f))))
    parts = F.transform(differ, lambda f: F.concat(f, F.lit(":"), kind(of(a, f)), F.lit("->"), kind(of(b, f))))
    return F.when(F.size(differ) > 0, F.array_join(parts, "|")).otherwise("no_change")


#: Fixed value: the currency of a run without priced calls.
NO_CURRENCY = "RUB"


def run_costs(calls: DataFrame, prices: DataFrame, run: list[str], level: str = "level") -> DataFrame:
    """Tokens and cost of model calls by run and level, and in total (level null).

    ``calls`` has ``model``, ``prompt_tokens``, ``completion_tokens`` and ``ord``; ``prices`` has ``pattern``, ``in_k`` and
    ``out_k`` (for a thousand tokens), ``currency`` and ``ord``.  A model takes the longest pattern that it contains, and
    of rows with that pattern the first; ``unpriced`` has the models without one, and ``currency`` is that of the last
    priced call (``NO_CURRENCY`` without any).
    """
    first = prices.groupBy("pattern").agg(F.min_by(F.struct("in_k", "out_k", "currency"), "ord").alias("price"), F.min("ord").alias("ord"))
    priced = longest_pattern(calls, first, "model", "pattern", "ord").join(first.select("pattern", "price.*"), "pattern", "left")
    cost = F.coalesce((F.col("prompt_tokens") * F.col("in_k") + F.col("completion_tokens") * F.col("out_k")) / 1000, F.lit(0.0))
    sums = [F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum(cost), 6).alias("cost"), F.count("*").alias("n")]
    currency = F.coalesce(F.max_by("currency", F.when(F.col("currency").isNotNull(), F.col("ord"))), F.lit(NO_CURRENCY)).alias("currency")
    unpriced = F.array_sort(F.collect_set(F.when(F.col("in_k").isNull(), F.col("model")))).alias("unpriced")
    sets = [[*run, level], run]
    return priced.groupingSets(sets, *run, level).agg(*sums, currency, unpriced)


def mine_corrections(corrections: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """Patterns of corrections with their frequency; at least ``least`` make a recommendation."""
    found = corrections.groupBy(*key).agg(F.count("*").alias("frequency"), F.min("ord").alias("first_ord"))
    return found.withColumn("recommended", F.col("frequency") >= least)
