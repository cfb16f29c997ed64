"""Versioned rule sets, resolution by priority, rule-driven classification and fact extraction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# The classifier's scores.
TITLE_BASE, TITLE_SHARE, MULTI_BONUS, MULTI_MOST = 0.6, 0.3, 0.05, 2
CONTENT_SCORE, NEGATIVE_PENALTY, MOST = 0.65, 0.4, 0.99
PARENT_BONUS, PARENT_PENALTY = 0.05, 0.1
# Sections that a document has once.
SINGLETONS = ("synopsis", "rationale", "introduction", "abbreviations", "table_of_contents", "references", "schema", "visit_schedule")


@dataclass(frozen=True)
class SectionRule:
    """A section with the patterns that tell it; ``kind`` is zone or subzone."""

    section: str
    patterns: tuple[str, ...]
    required: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    kind: str = "zone"
    parent: str | None = None


@dataclass(frozen=True)
class FactRule:
    """A fact key with the patterns whose first group is its value."""

    key: str
    patterns: tuple[str, ...]
    fact_class: str = "general"
    priority: tuple[str, ...] = field(default=())


def rule_score(rule: SectionRule, title: Column, content: Column) -> Column:
    """The score of one rule for a lowered title and content; 0 where it doesn't fit.

    Rules are few and come as one literal expression each, so patterns stay foldable and nothing is joined.
    """
    both = F.when(content == "", title).otherwise(F.concat_ws("\n", title, content))
    matched = [F.length(T.found(title, p)) for p in rule.patterns]
    length = sum(matched, F.lit(0))
    hits = sum((F.when(m > 0, 1).otherwise(0) for m in matched), F.lit(0))
    inside = F.lit(False)
    for p, m in zip(rule.patterns, matched):
        inside = inside | ((m == 0) & (content != "") & T.fits(content, p))
    share = F.least(length / F.greatest(F.length(title), F.lit(1)), F.lit(1.0))
    exact = F.least(F.lit(MOST), TITLE_BASE + TITLE_SHARE * share + MULTI_BONUS * F.least(hits, F.lit(MULTI_MOST)))
    score = F.when(hits > 0, exact).when(inside, CONTENT_SCORE).otherwise(0.0)
    for p in rule.negative[:1]:
        bad = F.lit(False)
        for q in rule.negative:
            bad = bad | T.fits(both, q)
        score = F.when(bad & (score > 0), F.greatest(F.lit(0.0), score - NEGATIVE_PENALTY)).otherwise(score)
    if rule.required:
        gate = F.lit(False)
        for p in rule.required:
            gate = gate | T.fits(both, p)
        score = F.when(gate, score).otherwise(0.0)
    return score


def classify(sections: DataFrame, rules: Sequence[SectionRule], title_col: str = "title", content_col: str | None = None) -> DataFrame:
    """Adds ``section`` and ``confidence``: the best rule, ties to the first; null and 0 where none fits."""
    title = F.lower(F.coalesce(F.col(title_col), F.lit("")))
    content = F.lower(F.coalesce(F.col(content_col), F.lit(""))) if content_col else F.lit("")
    scores = F.array(*(F.struct(rule_score(r, title, content).alias("score"), F.lit(-i).alias("rank"), F.lit(r.section).alias("name")) for i, r in enumerate(rules)))
    best = F.array_max(scores)
    found = sections.withColumn("_best", best)
    fits = F.col("_best.score") > 0
    return found.select("*", F.when(fits, F.col("_best.name")).alias("section"), F.when(fits, F.col("_best.score")).otherwise(0.0).alias("confidence")).drop("_best")


def keep_singletons(classified: DataFrame, id_col: str, order: str, singletons: Sequence[str] = SINGLETONS) -> DataFrame:
    """Where a document has a singleton section twice, all but the most confident (ties: the first) lose it."""
    place = F.row_number().over(Window.partitionBy(id_col, "section").orderBy(F.desc("confidence"), F.asc(order)))
    drop = F.col("section").isin(*singletons) & (F.col("_place") > 1)
    return classified.withColumn("_place", place).withColumn("confidence", F.when(drop, 0.0).otherwise(F.col("confidence"))).withColumn("section", F.when(drop, None).otherwise(F.col("section"))).drop("_place")


def classify_hierarchical(sections: DataFrame, rules: Sequence[SectionRule], id_col: str = "doc_id", order: str = "ord") -> DataFrame:
    """As ``classify``, with a bonus or penalty for subzones by the zone of the nearest section of a smaller level.

    A row's zone depends on its parents' results, so each document is folded in order.  The rules are scored in
    Spark first; the fold only compares numbers.
    """
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    content = F.lower(F.coalesce(F.col("content"), F.lit("")))
    scored = sections.select(id_col, order, F.coalesce("level", F.lit(0)).cast("int").alias("level"), F.array(*(rule_score(r, title, content).cast("double") for r in rules)).alias("scores"))
    own = list(rules)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        stack: list[tuple[int, str | None]] = []
        out = []
        for row in rows.itertuples(index=False):
            while stack and stack[-1][0] >= row.level:
                stack.pop()
            zone = stack[-1][1] if stack else None
            best, name, at = 0.0, None, None
            for rule, score in zip(own, row.scores):
                if score > 0 and zone and rule.kind == "subzone" and rule.parent:
                    score = min(MOST, score + PARENT_BONUS) if rule.parent == zone else max(0.0, score - PARENT_PENALTY)
                if score > best:
                    best, name, at = score, rule.section, rule
            stack.append((row.level, None if at is None else at.section if at.kind == "zone" else at.parent))
            out.append((getattr(row, id_col), getattr(row, order), name, best))
        return pd.DataFrame(out, columns=[id_col, order, "section", "confidence"])

    kinds = dict(sections.dtypes)
    found = scored.groupBy(id_col).applyInPandas(fold, f"{id_col} {kinds[id_col]}, {order} {kinds[order]}, section string, confidence double")
    return keep_singletons(found, id_col, order)


def _named(rule: FactRule):
    return lambda v: F.struct(F.lit(rule.key).alias("fact_key"), F.lit(rule.fact_class).alias("fact_class"), T.clean_value(v).alias("value"))


def extract_facts(docs: DataFrame, rules: Sequence[FactRule], id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``id_col``, the columns to ``keep``, ``fact_key``, ``fact_class``, ``ord`` and ``value`` of every match of every pattern.

    Group 1 of a pattern is the value; patterns without a group give the whole match.
    """
    parts = []
    for rule in rules:
        for p in rule.patterns:
            found = F.regexp_extract_all(F.col(text_col), F.lit(f"(?i){p}"), F.lit(1 if "(" in p.replace("(?:", "").replace("\\(", "") else 0))
            parts.append(F.transform(found, _named(rule)))
    rows = docs.select(id_col, *keep, F.posexplode(F.concat(*parts)).alias("ord", "fact"))
    return rows.select(id_col, *keep, "ord", "fact.*").where("value <> ''")


def resolve(entries: DataFrame, active: DataFrame, key: str, value: str) -> DataFrame:
    """The bundle's entry of each key, else the globally active version."""
    a, b = entries.select(key, F.col(value).alias("_bundle")), active.select(key, F.col(value).alias("_active"))
    return a.join(b, key, "full").select(key, F.coalesce("_bundle", "_active").alias(value))


def prioritised(rows: DataFrame, key: list[str], priority: Column, tie: list[Column]) -> DataFrame:
    """The row of each key with the smallest priority."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(priority, *tie))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def activate(versions: DataFrame, key: str, version: str, chosen: DataFrame) -> DataFrame:
    """``active`` is true for exactly the chosen version of each key that ``chosen`` (key, version) names."""
    pick = chosen.select(F.col(key).alias("_key"), F.col(version).alias("_version"))
    joined = versions.join(pick, versions[key] == pick["_key"], "left")
    return joined.withColumn("active", F.when(F.col("_key").isNull(), F.col("active")).otherwise(F.col(version) == F.col("_version"))).drop("_key", "_version")


def rollback(versions: DataFrame, key: str, version: str) -> DataFrame:
    """``key`` and ``version``: the largest version below each key's active one."""
    current = versions.where("active").select(F.col(key).alias("_key"), F.col(version).alias("_now"))
    return versions.join(current, (versions[key] == current["_key"]) & (versions[version] < current["_now"])).groupBy(key).agg(F.max(version).alias(version))


def export_rules(rules: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One JSON document of all rules of each key."""
    packed = F.array_sort(F.collect_list(F.struct(*columns)))
    return rules.groupBy(key).agg(F.to_json(packed).alias("json"))


def import_rules(exported: DataFrame, key: str, ddl: str) -> DataFrame:
    """The rules of exported documents; ``ddl`` names their fields."""
    return exported.select(key, F.explode(F.from_json("json", f"array<struct<{ddl}>>")).alias("rule")).select(key, "rule.*")


def version_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key`` and ``change``: added, removed, modified or unchanged, by null-safe comparison of the fields."""
    a, b = old.alias("a"), new.alias("b")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    change = F.when(F.col(f"a.{key}").isNull(), "added").when(F.col(f"b.{key}").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"))
