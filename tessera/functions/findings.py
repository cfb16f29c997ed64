"""Canonical values, patterns and editorial checks of findings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

# Issue types whose values are facts of a kind, and those whose values are doses.
FACT_ISSUES = {
    "sample_size_mismatch": "sample_size",
    "sample_size_count_mismatch": "sample_size",
    "enrollment_target_mismatch": "sample_size",
    "visit_count_mismatch": "sample_size",
    "calculation_error_sum": "sample_size",
    "duration_mismatch": "study_duration",
    "dosing_duration_mismatch": "study_duration",
    "washout_duration_mismatch": "study_duration",
    "sae_reporting_timeline_conflict": "study_duration",
    "storage_time_mismatch": "study_duration",
    "contradiction_time_window": "study_duration",
    "contradiction_timepoint": "study_duration",
    "soa_visit_window_mismatch": "study_duration",
    "soa_timepoint_mismatch": "study_duration",
    "endpoint_timeframe_conflict": "study_duration",
    "endpoint_timepoint_mismatch": "study_duration",
    "pk_sampling_duration_mismatch": "study_duration",
    "stability_shelf_life_conflict": "study_duration",
    "be_design_mismatch": "study_phase",
}
DOSE_ISSUES = ("dose_mismatch", "strength_mismatch", "concentration_mismatch", "frequency_mismatch", "magnitude_error", "unit_mismatch", "unit_conversion_error")
# Units of doses and what they are written as; compound ones first.
DOSE_UNITS = (
    (r"(?<!\p{L})мкг\s*/\s*кг(?!\p{L})", "mcg/kg"),
    (r"(?<!\p{L})мг\s*/\s*кг(?!\p{L})", "mg/kg"),
    (r"(?<!\p{L})мг\s*/\s*мл(?!\p{L})", "mg/ml"),
    (r"(?<!\p{L})мкг(?!\p{L})", "mcg"),
    (r"(?<!\p{L})мг(?!\p{L})", "mg"),
    (r"(?<!\p{L})кг(?!\p{L})", "kg"),
    (r"(?<!\p{L})мл(?!\p{L})", "ml"),
    (r"µg", "mcg"),
    (r"(?<!\p{L})ug(?!\p{L})", "mcg"),
)
# Wordings that make a finding doubtful, in order, with their names.
DOUBTFUL = (
    ("hedging:возможно", r"(?<!\p{L})возможно\s+(не|противоречие|конфликт|расхождение)"),
    ("hedging:может быть", r"(?<!\p{L})мож(ет\s+быть|но\s+предположить)"),
    ("hedging:предположительно", r"(?<!\p{L})предположительно(?!\p{L})"),
    ("hedging:вероятно", r"(?<!\p{L})ве?роятно,?\s+(не|конфликт|противоречие)"),
    ("hedging:кажется", r"(?<!\p{L})кажется,?\s+(не|есть)"),
    ("hedging:возможно стоит", r"(?<!\p{L})возможн[оы]\s+(не\s+)?(стоит|следует|нужно)"),
    ("suggestion-like", r"(?<!\p{L})(стоит|следует|нужно|необходимо|рекомендуется)\s+(добавить|уточнить|проверить|изменить|переформулировать)"),
    ("suggestion-like:хорошо бы", r"(?<!\p{L})хорошо\s+бы(?!\p{L})"),
    ("suggestion-like:было бы", r"(?<!\p{L})было\s+бы\s+(лучше|хорошо|правильнее)"),
    ("meta:неясно", r"(?<!\p{L})в\s+(тексте|документе|секции)\s+(не\s+ясно|неясно)(?!\p{L})"),
    ("meta:трудно определить", r"(?<!\p{L})(трудно|сложно)\s+определить(?!\p{L})"),
    ("meta:требуется уточнение", r"(?<!\p{L})требует(ся)?\s+(дополнительн[аеы]\w*|уточн)"),
)
MISSING = (
    ("missingness-no-value", r"(?<!\p{L})не\s+(указан[оаы]?|упомянут[оаы]?|представлен[оаы]?)(?!\p{L})"),
    ("missingness-absent", r"(?<!\p{L})отсутству(ет|ют|ющ)"),
)


def canonical_dose(raw: Column) -> Column:
    """A dose in lower case with Latin units, joined to their numbers, and decimal points."""
    value = F.lower(T.squeeze(raw))
    for pattern, unit in DOSE_UNITS:
        value = F.regexp_replace(value, pattern, unit)
    value = F.regexp_replace(value, r"(\d+(?:[.,]\d+)?)\s+(mg|mcg|kg|g|ml|l)", "$1$2")
    return F.regexp_replace(value, r"(\d),(\d)", "$1.$2")


def canonical_value(issue: Column, raw: Column) -> Column:
    """The canonical value of one side of a finding; null for blank values."""
    text = F.regexp_replace(F.lower(T.squeeze(raw)), "[«»„“”]", '"')
    out = F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", None).when(issue.isin(*DOSE_ISSUES), canonical_dose(raw))
    for key in dict.fromkeys(FACT_ISSUES.values()):
        out = out.when(issue.isin([i for i, k in FACT_ISSUES.items() if k == key]), F.coalesce(F.nullif(T.canonical(F.lit(key), raw), F.lit("")), text))
    return out.otherwise(text)


def anti_pattern(*fields: tuple[str, Column]) -> Column:
    """Field, name and words of the first doubtful wording: fields in order, then patterns in order.

    Missing values only count where the text has no digit or named value.
    """
    found = []
    for name, text in fields:
        low = F.lower(F.coalesce(text, F.lit("")))
        # a boundary only counts beside ASCII words
        concrete = low.rlike(r"\d|(?<![a-z0-9_])(major|primary|secondary)|(?<=[a-z0-9_])критическ")
        for patterns, fits in ((DOUBTFUL, F.lit(True)), (MISSING, ~concrete)):
            for label, p in patterns:
                found.append(F.when(low.rlike(p) & fits, F.struct(F.lit(name).alias("field"), F.lit(label).alias("pattern"), F.regexp_extract(low, p, 0).alias("words"))))
    return F.coalesce(*found)


def editorial(text: Column) -> Column:
    """An array of (kind, severity): double spaces, mixed tenses, placeholders."""
    low = F.lower(text)
    future, past = F.regexp_count(low, F.lit(r"\b(will|shall)\b")), F.regexp_count(low, F.lit(r"\b(was|were|has been)\b"))
    checks = (("double_space", "low", text.rlike("  ")), ("mixed_tense", "medium", (future > 2) & (past > 2)), ("placeholder", "high", low.rlike(r"\[(tbd|insert|placeholder|todo)\]")))
    return F.array_compact(F.array(*(F.when(test, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, test in checks)))


def group_key(family: Column, explicit: Column, issue: Column, ref: Column, target: Column, ref_value: Column, target_value: Column, quote: Column) -> Column:
    """What duplicate findings share: an explicit key, else canonical values, else the quote; null: nothing."""
    head = F.upper(F.coalesce(family, F.lit("UNKNOWN")))
    values = T.dedup_key(F.coalesce(issue, F.lit("unknown")), ref, target, ref_value, target_value)
    flat = F.nullif(F.lower(T.squeeze(F.coalesce(quote, F.lit("")))), F.lit(""))
    return F.coalesce(F.when(F.coalesce(explicit, F.lit("")) != "", F.concat_ws("|", head, F.lit("DK"), explicit)), F.when(values.isNotNull(), F.concat_ws("|", head, F.lit("CV"), values)), F.when(flat.isNotNull(), F.concat_ws("|", head, flat)))
