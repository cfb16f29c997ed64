"""Audits inside and across documents: prompts, table facts, matching, linking and metrics."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, schedules

# How cells of a table's first column name a fact.
HEADER_SYNONYMS = {
    "study_title": ("study title", "название исследования", "название протокола", "наименование исследования", "protocol title", "title of the study"),
    "protocol_number": ("protocol number", "protocol no", "protocol #", "номер протокола", "код исследования", "идентификатор протокола"),
    "sponsor": ("sponsor", "спонсор", "sponsored by", "организация спонсор"),
    "study_phase": ("phase", "фаза", "фаза исследования", "phase of study"),
    "indication": ("indication", "показание", "показания", "терапевтическая область", "therapeutic area"),
    "study_drug": ("investigational product", "investigational medicinal product", "imp", "study drug", "исследуемый препарат", "ип", "иp", "исследуемое лекарственное средство"),
    "sample_size": ("sample size", "размер выборки", "объем выборки", "число участников", "число пациентов", "n participants", "n patients"),
    "study_duration": ("study duration", "treatment duration", "продолжительность исследования", "длительность лечения", "сроки проведения", "продолжительность участия"),
    "primary_endpoint": ("primary endpoint", "primary outcome", "первичная конечная точка", "основная конечная точка", "первичный критерий"),
    "secondary_endpoint": ("secondary endpoint", "secondary outcome", "вторичная конечная точка", "вторичный критерий"),
    "inclusion_criteria": ("inclusion criteria", "критерии включения"),
    "exclusion_criteria": ("exclusion criteria", "критерии исключения", "критерии невключения"),
}


def header_key(text: Column) -> Column:
    """A header cell reduced to stems."""
    return T.stem_phrase(T.squeeze(F.regexp_replace(F.lower(text), r"[:.,;()/\\-]", " ")))


def synonym_table(spark, synonyms: dict[str, Sequence[str]] = HEADER_SYNONYMS) -> DataFrame:
    rows = spark.createDataFrame([(k, a) for k, aliases in synonyms.items() for a in aliases], "fact_key string, alias string")
    return rows.select("fact_key", header_key(F.col("alias")).alias("key")).where("key <> ''").groupBy("key").agg(F.max("fact_key").alias("fact_key"))


#: Fixed value: the length that cells are cut to.
MAX_CELL = 240


def cell_text(value: Column) -> Column:
    return F.substring(T.squeeze(F.coalesce(value, F.lit(""))), 1, MAX_CELL)


def table_facts(rows: DataFrame, id_col: str, order: str, cells: str, synonyms: DataFrame, headers: str | None = None) -> DataFrame:
    """Facts of a table's rows: of the first two cells the one that is a known header gives the key, the other the value.

    With ``headers`` (an array column), a known first header also gives the key of every row's second cell.  Facts of
    rows come before those of the header.
    """
    base = rows.select(id_col, order, cell_text(F.get(F.col(cells), F.lit(0))).alias("l"), cell_text(F.get(F.col(cells), F.lit(1))).alias("r"), (F.get(F.col(headers), F.lit(0)) if headers else F.lit(None).cast("string")).alias("h"), (F.size(headers) >= 2 if headers else F.lit(False)).alias("wide"))
    names = {n: synonyms.select(F.col("key").alias(f"_k{n}"), F.col("fact_key").alias(f"_f{n}")) for n in "lrh"}
    sides = base.where("l <> '' and r <> ''")
    keyed = sides.join(names["l"], header_key(F.col("l")) == F.col("_kl"), "left").join(names["r"], header_key(F.col("r")) == F.col("_kr"), "left").where("_fl is not null or _fr is not null")
    found = keyed.select(id_col, order, F.lit(0).alias("layout"), F.coalesce("_fl", "_fr").alias("fact_key"), F.when(F.col("_fl").isNotNull(), F.col("r")).otherwise(F.col("l")).alias("value"))
    if not headers:
        return found.drop("layout")
    by_header = base.where("wide and r <> ''").join(names["h"], header_key(F.col("h")) == F.col("_kh")).select(id_col, order, F.lit(1).alias("layout"), F.col("_fh").alias("fact_key"), F.col("r").alias("value"))
    return found.unionByName(by_header)


# Zones that are checked against each other where nothing is configured.
ZONE_AFFINITY = (
    ("synopsis", "overview"), ("synopsis", "design"), ("synopsis", "endpoints"), ("synopsis", "population"), ("synopsis", "ip"), ("synopsis", "safety"), ("synopsis", "statistics"), ("synopsis", "procedures"),
    ("overview", "endpoints"), ("endpoints", "statistics"), ("endpoints", "procedures"), ("design", "procedures"), ("design", "population"), ("design", "appendix"),
    ("safety", "ip"), ("safety", "procedures"), ("safety", "population"), ("safety", "ethics"), ("population", "statistics"), ("ip", "procedures"),
    ("data_management", "statistics"), ("data_management", "procedures"), ("design", "statistics"), ("design", "ip"), ("safety", "statistics"), ("population", "procedures"), ("ip", "population"),
    ("overview", "design"), ("overview", "population"), ("ethics", "population"), ("ethics", "procedures"),
)


def affinity_table(spark, pairs: Sequence[tuple[str, str]] = ZONE_AFFINITY) -> DataFrame:
    return spark.createDataFrame(list(pairs), "a string, b string")


def zone_pairs(zones: DataFrame, id_col: str, zone: str, affinity: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Pairs of zones to check against each other that a document has both of; ``affinity`` has ``a`` and ``b``.

    A document with ``manual`` pairs (``id_col``, ``a``, ``b``) takes those instead.
    """
    have = zones.select(id_col, F.substring_index(zone, ".", 1).alias("z")).distinct()
    open_zones = have if manual is None else have.join(manual.select(id_col), id_col, "left_anti")
    first = open_zones.join(affinity, open_zones["z"] == affinity["a"]).select(id_col, "a", "b")
    if manual is not None:
        first = first.unionByName(manual.select(id_col, "a", "b").join(have.withColumnRenamed("z", "a"), [id_col, "a"], "left_semi"))
    return first.join(have.withColumnRenamed("z", "b"), [id_col, "b"], "left_semi").select(id_col, "a", "b")


def prompt_plan(zone_texts: DataFrame, pairs: DataFrame, id_col: str, budget: int, prompts: dict[str, str]) -> DataFrame:
    """The calls of an audit: three over the whole document where it fits the budget, else by zone and pair.

    ``zone_texts`` has ``zone`` and ``zone_text``, ``pairs`` has ``a`` and ``b``.
    """
    longest = max(map(len, prompts.values()))
    whole = zone_texts.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("zone", "zone_text"))), lambda z: z["zone_text"]), "\n\n").alias("document"))
    sized = whole.withColumn("fits", F.length("document") + longest + 200 <= budget)
    full = sized.where("fits").select(id_col, F.explode(F.array(*map(F.lit, ("full_self", "full_cross", "full_editorial")))).alias("label"), F.col("document").alias("prompt"))
    room = budget - longest - 500
    split = zone_texts.join(sized.where("not fits").select(id_col), id_col, "left_semi")
    own = split.select(id_col, F.explode(F.array(F.concat(F.lit("self:"), "zone"), F.concat(F.lit("editorial:"), "zone"))).alias("label"), F.substring("zone_text", 1, room).alias("prompt"))
    a, b = (split.select(id_col, F.col("zone").alias(n), F.substring("zone_text", 1, room // 2).alias(f"text_{n}")) for n in "ab")
    cross = pairs.join(a, [id_col, "a"]).join(b, [id_col, "b"]).select(id_col, F.concat(F.lit("cross:"), "a", F.lit(">"), "b").alias("label"), F.concat("text_a", F.lit("\n\n---\n\n"), "text_b").alias("prompt"))
    return full.unionByName(own).unionByName(cross)


def resolve_zone(raw: DataFrame, column: str, zones: Sequence[str], most: int = 3) -> DataFrame:
    """Adds ``zone``: exact, else normalised, else without the parent, else the nearest key within ``most`` edits."""
    table = {z: z for z in zones}
    short: dict[str, list[str]] = {}
    for z in zones:
        table.setdefault(z.lower().replace(".", "_").replace("-", "_").replace(" ", "_"), z)
        short.setdefault(z.rsplit(".", 1)[-1].lower(), []).append(z)
    for key, own in short.items():
        if len(own) == 1:
            table.setdefault(key, own[0])
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    flat = lambda c: F.regexp_replace(F.lower(c), r"[.\s-]+", "_")
    value = F.col(column)
    inner = F.when(F.contains(value, F.lit(".")), F.expr(f"substring(`{column}`, locate('.', `{column}`) + 1)"))
    near = F.array_min(F.filter(F.array(*(F.struct(F.levenshtein(flat(value), F.lit(k)).alias("d"), F.lit(i).alias("i"), F.lit(z).alias("zone"), F.lit(len(k) // 2).alias("half")) for i, (k, z) in enumerate(table.items()) if len(k) >= 4)), lambda x: (x["d"] <= most) & (x["d"] <= x["half"])))
    return raw.withColumn("zone", F.coalesce(*(F.element_at(known, k) for k in (value, flat(value), inner, flat(inner))), near["zone"]))


# Overlaps of quotes for a strict and a lenient match, and the lenient score by type and zone.
STRICT, LENIENT, BY_PLACE = 0.7, 0.5, 0.5


def _comparable(rows: DataFrame, group: str, name: str) -> DataFrame:
    return rows.select(F.col(group).alias("g"), F.nullif(F.upper(F.trim("family")), F.lit("")).alias("f"), F.col("id").alias(name), T.quote_words(F.col("quote")).alias(f"{name}_words"), F.nullif(F.lower(F.trim("kind")), F.lit("")).alias("kind"), F.nullif(F.upper(F.trim("zone")), F.lit("")).alias("zone"))


def _shared_words(p: DataFrame, e: DataFrame, least: float = 0.0) -> DataFrame:
    """The overlap of every two findings of a group and family that share a word: counted by words, so only keys and words
    are shuffled and a pair comes out once.

    With ``least``, pairs whose numbers of words exclude that overlap are only counted where type and zone may be equal.
    """
    place = F.when(F.col("kind").isNotNull() & F.col("zone").isNotNull(), F.xxhash64("kind", "zone"))
    # outer: Spark infers no filter from it, which would compute the words again; null words don't meet
    met = [rows.select("g", "f", name, F.size(f"{name}_words").alias(f"n_{name}"), place.alias(f"at_{name}"), F.explode_outer(f"{name}_words").alias("word")) for rows, name in ((p, "predicted"), (e, "expected"))]
    both = met[0].join(met[1], ["g", "f", "word"])
    if least:
        both = both.where((F.least("n_predicted", "n_expected") / F.greatest("n_predicted", "n_expected") >= least) | (F.col("at_predicted") == F.col("at_expected")))
    shared = both.groupBy("g", "f", "predicted", "expected", "n_predicted", "n_expected").agg(F.count("*").alias("n"))
    return shared.select("g", "f", "predicted", "expected", (F.col("n") / (F.col("n_predicted") + F.col("n_expected") - F.col("n"))).alias("overlap"))


def overlap_pairs(predicted: DataFrame, expected: DataFrame, group: str, least: float = LENIENT) -> DataFrame:
    """Scored pairs of findings of one group (a document) and family: the overlap of their quotes, and a strict and a
    lenient score, at least one of them above 0 or the overlap at least ``least``.

    Strict: the same type and zone, and the strict overlap.  Lenient: the lenient overlap, else the same type and zone.
    Either makes a pair: the type and zone by an equi join, the overlap by the words that quotes share.
    """
    p, e = _comparable(predicted, group, "predicted").where("f is not null"), _comparable(expected, group, "expected").where("f is not null")
    keys = ["g", "f", "predicted", "expected"]
    placed = p.select("g", "f", "kind", "zone", "predicted").join(e.select("g", "f", "kind", "zone", "expected"), ["g", "f", "kind", "zone"]).select(*keys).withColumn("place", F.lit(True))
    met = placed.join(_shared_words(p, e, min(least, LENIENT)), keys, "full").select("g", "predicted", "expected", F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("place", F.lit(False)).alias("place"))
    return _scored(met.where(F.col("place") | (F.col("overlap") >= min(least, LENIENT)))).withColumnRenamed("g", group)


def _scores(overlap: Column, place: Column) -> dict[str, Column]:
    strict = F.when(place & (overlap >= STRICT), overlap).otherwise(0.0)
    return {"strict": strict, "lenient": F.when(overlap >= LENIENT, overlap).when(place, BY_PLACE).otherwise(0.0)}


def _scored(met: DataFrame) -> DataFrame:
    return met.withColumns(_scores(F.col("overlap"), F.col("place"))).drop("place")


def _nested_sides(predicted: str, expected: str) -> list[Column]:
    """``ps`` and ``es``: what is compared of the findings in two arrays, those with a family."""
    def comparable(x: Column) -> Column:
        upper = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
        return F.struct(x["id"].alias("id"), upper(x["family"]).alias("f"), F.nullif(F.lower(F.trim(x["kind"])), F.lit("")).alias("kind"), upper(x["zone"]).alias("zone"), T.quote_words(x["quote"]).alias("words"))

    return [F.filter(F.transform(c, comparable), lambda x: x["f"].isNotNull()).alias(n) for c, n in ((predicted, "ps"), (expected, "es"))]


def _met(p: Column, e: Column) -> Column:
    place = F.coalesce((p["kind"] == e["kind"]) & (p["zone"] == e["zone"]), F.lit(False))
    return F.struct(e["id"].alias("id"), place.alias("place"), (F.size(p["words"]) + F.size(e["words"])).alias("n"), F.size(F.array_intersect(p["words"], e["words"])).alias("shared"))


def _met_overlap(m: Column) -> Column:
    return F.when(m["shared"] == 0, 0.0).otherwise(m["shared"] / (m["n"] - m["shared"]))


def _each_met(predicted: str, expected: str, of) -> Column:
    """One array of what ``of`` gives for each predicted finding and the array of its meetings with those of its family."""
    def met(sides: Column, p: Column) -> Column:
        return F.transform(F.filter(sides["es"], lambda e: e["f"] == p["f"]), lambda e: _met(p, e))

    # both sides in one value that is worked out once, not again for each predicted finding
    return schedules.once(F.struct(*_nested_sides(predicted, expected)), lambda sides: F.flatten(F.transform(sides["ps"], lambda p: of(p, met(sides, p)))))


def nested_pairs(rows: DataFrame, id_col: str, predicted: str, expected: str, least: float = LENIENT) -> DataFrame:
    """As ``overlap_pairs``, for findings that stand in two arrays of a document's row (structs of ``id``, ``family``,
    ``kind``, ``zone`` and ``quote``): nothing is shuffled.
    """
    sides = rows.select(id_col, *_nested_sides(predicted, expected))
    # by family first: an exploded column would be computed again for the filter that Spark infers from it
    of_family = lambda f: F.struct(F.filter("ps", lambda p: p["f"] == f).alias("ps"), F.filter("es", lambda e: e["f"] == f).alias("es"))
    families = sides.select(id_col, F.explode(F.transform(F.array_distinct(F.transform("ps", lambda p: p["f"])), of_family)).alias("family"))
    each = families.select(id_col, F.explode("family.ps").alias("p"), F.col("family.es").alias("es"))
    p = F.col("p")
    kept = F.filter(F.transform("es", lambda e: _met(p, e)), lambda m: m["place"] | (_met_overlap(m) >= min(least, LENIENT)))
    pairs = each.select(id_col, p["id"].alias("predicted"), F.explode(kept).alias("m"))
    return _scored(pairs.select(id_col, "predicted", F.col("m.id").alias("expected"), _met_overlap(F.col("m")).alias("overlap"), F.col("m.place").alias("place")))


def nested_matches(rows: DataFrame, id_col: str, predicted: str, expected: str, score: str = "lenient") -> DataFrame:
    """As ``match_findings``, for findings in two arrays of a document's row (see ``nested_pairs``), a document being one
    row: its pairs are sorted and matched where they stand, so nothing is shuffled."""
    def of(p: Column, met: Column) -> Column:
        met = F.transform(met, lambda m: F.struct(m["id"].alias("id"), m["place"].alias("place"), _met_overlap(m).alias("overlap")))
        scored = F.transform(met, lambda m: F.struct((-_scores(m["overlap"], m["place"])[score]).alias("score"), p["id"].alias("predicted"), m["id"].alias("expected")))
        return F.filter(scored, lambda x: x["score"] < 0)

    pairs = rows.select(id_col, F.array_sort(_each_met(predicted, expected, of)).alias("pairs"))
    sides = pairs.select(id_col, "pairs.predicted", "pairs.expected", F.transform("pairs.score", lambda s: -s).alias(score))
    return evaluation.free_pairs(sides, id_col, "predicted", "expected", [score])


def match_findings(predicted: DataFrame, expected: DataFrame, group: str, score: str = "lenient") -> DataFrame:
    """One-to-one matches of findings by descending score (``strict`` or ``lenient``) within each group."""
    scored = overlap_pairs(predicted, expected, group).where(F.col(score) > 0)
    return evaluation.greedy_pairs(scored, group, "predicted", "expected", score, 0.0)


def judge_candidates(predicted: DataFrame, expected: DataFrame, group: str, k: int = 3) -> DataFrame:
    """The ``k`` most overlapping expected findings of each predicted one in its group (a document) and family, for a judge.

    Those that share a word are met by their words; the first ``k`` of the family fill up with an overlap of 0.
    """
    p, e = (_comparable(rows, group, name).where("f is not null") for rows, name in ((predicted, "predicted"), (expected, "expected")))
    near = _shared_words(p, e).drop("f")
    place = F.row_number().over(Window.partitionBy("g", "f").orderBy("expected"))
    first = e.select("g", "f", "expected", place.alias("place")).where(F.col("place") <= k).drop("place")
    spare = p.select("g", "f", "predicted").join(first, ["g", "f"]).select("g", "predicted", "expected", F.lit(0.0).alias("overlap"))
    best = near.unionByName(spare).groupBy("g", "predicted", "expected").agg(F.max("overlap").alias("overlap"))
    n = F.row_number().over(Window.partitionBy("g", "predicted").orderBy(F.desc("overlap"), "expected"))
    return best.withColumn("rank", n).where(F.col("rank") <= k).withColumnRenamed("g", group)


def judged(candidates: DataFrame, verdicts: DataFrame, group: str) -> DataFrame:
    """Accepted candidates where each expected finding is used once, in order of predicted id and rank.

    What is free depends on the choices before, so each group is folded in order.
    """
    accepted = candidates.join(verdicts.where("same"), [group, "predicted", "expected"], "left_semi")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        used, done, keep = set(), set(), []
        rows = rows.sort_values(["predicted", "rank"])
        for p, e in zip(rows["predicted"], rows["expected"]):
            free = p not in done and e not in used
            keep.append(free)
            if free:
                done.add(p)
                used.add(e)
        return rows[keep]

    return accepted.groupBy(group).applyInPandas(fold, accepted.schema)


def nested_candidates(rows: DataFrame, id_col: str, predicted: str, expected: str, k: int = 3) -> DataFrame:
    """As ``judge_candidates``, for findings in two arrays of a document's row (see ``nested_pairs``): ``candidates`` is an
    array of structs of ``predicted``, ``expected``, ``overlap`` and ``rank``.  Nothing is shuffled."""
    def of(p: Column, met: Column) -> Column:
        best = F.slice(F.array_sort(F.transform(met, lambda m: F.struct((-_met_overlap(m)).alias("less"), m["id"].alias("id")))), 1, k)
        return F.transform(best, lambda b, i: F.struct(p["id"].alias("predicted"), b["id"].alias("expected"), (-b["less"]).alias("overlap"), (i + 1).alias("rank")))

    return rows.select(id_col, _each_met(predicted, expected, of).alias("candidates"))


def nested_judged(rows: DataFrame, id_col: str, candidates: str, verdicts: str) -> DataFrame:
    """As ``judged``, for candidates and verdicts (structs of ``predicted``, ``expected`` and ``same``) in two arrays of a
    document's row: each row is folded where it stands."""
    ordered = F.array_sort(F.transform(candidates, lambda c: F.struct(c["predicted"].alias("predicted"), c["rank"].alias("rank"), c["expected"].alias("expected"))))
    sides = rows.select(id_col, ordered.alias("c"), F.filter(verdicts, lambda v: v["same"]).alias("v"))
    arrays = sides.select(id_col, "c.predicted", "c.expected", "c.rank", F.col("v.predicted").alias("_p"), F.col("v.expected").alias("_e"))
    return evaluation.free_pairs(arrays, id_col, "predicted", "expected", ["rank"], ("_p", "_e"))


def structure_diff(expected: DataFrame, actual: DataFrame, id_col: str) -> DataFrame:
    """``kind`` (missing, extra, wrong_level), ``title``, ``expected_level`` and ``level`` by document.

    Titles are compared trimmed and lowered; each actual heading is used once, one of the wanted level first.
    """
    key = F.lower(F.trim("title"))
    both = expected.select(id_col, "ord", "title", "level", key.alias("key"), F.lit("e").alias("side")).unionByName(actual.select(id_col, "ord", "title", "level", key.alias("key"), F.lit("a").alias("side")))
    kind = dict(both.dtypes)[id_col]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        free = rows[rows["side"] == "a"].to_dict("records")
        out = []
        for e in rows[rows["side"] == "e"].to_dict("records"):
            own = [a for a in free if a["key"] == e["key"]]
            hit = next((a for a in own if a["level"] == e["level"]), own[0] if own else None)
            if hit is None:
                out.append((e[id_col], "missing", e["title"], e["level"], None))
                continue
            free = [a for a in free if a is not hit]
            if hit["level"] != e["level"]:
                out.append((e[id_col], "wrong_level", e["title"], e["level"], hit["level"]))
        out += [(a[id_col], "extra", a["title"], None, a["level"]) for a in free]
        return pd.DataFrame(out, columns=[id_col, "kind", "title", "expected_level", "level"]).astype({"expected_level": "Int64", "level": "Int64"})

    return both.groupBy(id_col).applyInPandas(fold, f"{id_col} {kind}, kind string, title string, expected_level long, level long")


def link_findings(findings: DataFrame, sections: DataFrame, group: str) -> DataFrame:
    """``id`` and ``section_id``: the first section that holds one of the finding's quotes and lies in one of its zones,
    else the first that holds a quote, else the first in a zone.

    ``quotes`` and ``zones`` are arrays; quotes are normalised, cut to 60 characters, and used from 12 characters on.  A
    section (``standard``) lies in a zone that is its own, its root or a part before a dot.
    """
    flat = lambda c: F.lower(T.squeeze(c))
    probes = F.filter(F.transform(F.filter("quotes", lambda q: F.trim(F.coalesce(q, F.lit(""))) != ""), lambda q: F.substring(flat(q), 1, 60)), lambda p: F.length(p) >= 12)
    f = findings.select(F.col(group).alias("g"), "id", probes.alias("probes"), F.filter("zones", lambda z: F.coalesce(z, F.lit("")) != "").alias("wanted"))
    s = sections.select(F.col(group).alias("sg"), "section_id", "ord", F.coalesce("standard", F.lit("")).alias("standard"), flat(F.coalesce("content", F.lit(""))).alias("c"))
    inside = F.exists("probes", lambda p: F.contains(F.col("c"), p))
    fits = F.exists("wanted", lambda z: (F.substring_index("standard", ".", 1) == z) | (F.col("standard") == z) | F.startswith(F.col("standard"), F.concat(z, F.lit("."))))
    joined = f.join(s, (F.col("g") == F.col("sg")) & (inside | fits))
    rank = F.when(inside & fits, 0).when(inside, 1).otherwise(2)
    return joined.groupBy("id").agg(F.min_by("section_id", F.struct(rank, "ord")).alias("section_id"))


def verified_tables(tables: DataFrame, answers: DataFrame, key: str = "block_id") -> DataFrame:
    """Detected schedules with a model's answer (``is_schedule``, ``confidence``): a disagreement is checked again
    (``llm_qa``), an agreement isn't (``llm_check``); without an answer both columns are null."""
    a = answers.select(F.col(key).alias("_key"), F.col("is_schedule").alias("_says"), F.col("confidence").alias("model_confidence"))
    level = F.when(F.col("_says").isNull(), None).when(F.col("_says"), "llm_check").otherwise("llm_qa")
    return tables.join(a, tables[key] == a["_key"], "left").withColumn("verification", level).drop("_key", "_says")


def prefix_sources(targets: DataFrame, sections: DataFrame, group: str, fallback: int = 5) -> DataFrame:
    """Sections for each wanted group of zones: those whose standard section starts with one of them, else those that have
    one anywhere in their title or standard section (lowered), else the document's first ``fallback``.

    ``targets`` has ``target`` and ``zones`` (an array); ``sections`` has ``standard``, ``title`` and ``ord``.
    """
    t = targets.select(F.col(group).alias("g"), "target", "zones")
    s = sections.select(F.col(group).alias("sg"), "section_id", "standard", "title", "ord")
    joined = t.join(s, F.col("g") == F.col("sg"))
    standard, title = (F.coalesce(c, F.lit("")) for c in ("standard", "title"))
    begins = F.exists("zones", lambda z: F.startswith(standard, z) & F.col("standard").isNotNull())
    inside = F.exists("zones", lambda z: F.contains(F.lower(title), z) | F.contains(F.lower(standard), z))
    how = F.when(F.coalesce(begins, F.lit(False)), 0).when(F.coalesce(inside, F.lit(False)), 1).otherwise(2)
    ranked = joined.withColumn("how", how).withColumn("best", F.min("how").over(Window.partitionBy("g", "target"))).where("how = best")
    n = F.row_number().over(Window.partitionBy("g", "target").orderBy("ord"))
    return ranked.withColumn("n", n).where((F.col("how") < 2) | (F.col("n") <= fallback)).select(F.col("g").alias(group), "target", "section_id", "how")


def source_contents(mapping: DataFrame, sections: DataFrame, placeholder: str) -> DataFrame:
    """Content for each target's source zones; of sections with one zone the last counts, missing ones get a placeholder."""
    last = sections.groupBy("standard").agg(F.max_by("content", "ord").alias("content"))
    wanted = mapping.select("target", F.posexplode("sources").alias("pos", "standard"))
    return wanted.join(last, "standard", "left").select("target", "pos", "standard", F.coalesce(F.nullif("content", F.lit("")), F.lit(placeholder)).alias("content"))


SCHEDULE_KINDS = ("visit", "procedure", "cell", "footnote")


def schedule_scores(samples: DataFrame, expected: DataFrame, actual: DataFrame, group: str) -> DataFrame:
    """Precision, recall and F1 of each sample's schedules by kind (``SCHEDULE_KINDS``), and whether any was found.

    ``samples`` has the number of expected and of detected tables (``expected_tables``, null: no truth, all scores are
    null; ``actual_tables``).  ``expected`` has ``kind``, ``procedure``, ``visit`` and ``value`` (a cell's value, or a
    footnote's marker); ``actual`` has ``kind`` (cell or footnote), ``procedure``, ``visit``, ``value`` and ``manual``.

    Visits and procedures count as they are written; those of all detected cells count.  Cells count with their
    scored value (a manual one goes first) unless that is empty, footnotes with procedure and visit.  Items are sets
    over all tables: nothing on either side scores 1, but a footnote then has no score.
    """
    value = T.scored_cell(F.coalesce("manual", "value"))
    cell, foot = F.col("kind") == "cell", F.col("kind") == "footnote"
    named = lambda kind, *parts: F.struct(F.lit(kind).alias("kind"), F.to_json(F.array(*parts)).alias("item"))
    items = {
        "visit": named("visit", F.col("visit")), "procedure": named("procedure", F.col("procedure")),
        "cell": named("cell", F.col("procedure"), F.col("visit"), value), "footnote": named("footnote", F.col("procedure"), F.col("visit"), F.col("value")),
    }
    some = lambda test, kind: F.when(test, items[kind])
    truth = [some(F.col("kind") == k, k) for k in ("visit", "procedure", "footnote")] + [some(cell & (value != ""), "cell")]
    seen = [some(cell, "visit"), some(cell, "procedure"), some(cell & (value != ""), "cell"), some(foot & F.col("procedure").isNotNull() & F.col("visit").isNotNull(), "footnote")]

    def distinct(rows: DataFrame, found: list[Column], side: str) -> DataFrame:
        exploded = rows.select(group, F.explode(F.array_compact(F.array(*found))).alias("x")).select(group, "x.kind", "x.item")
        return exploded.distinct().withColumn(side, F.lit(True))

    both = distinct(expected.withColumn("manual", F.lit(None).cast("string")), truth, "e").join(distinct(actual, seen, "a"), [group, "kind", "item"], "full")
    counts = both.groupBy(group, "kind").agg(F.count_if(F.col("e") & F.col("a")).alias("hit"), F.count("a").alias("n_actual"), F.count("e").alias("n_expected"))
    kinds = samples.select(group, "expected_tables", "actual_tables", F.explode(F.array(*map(F.lit, SCHEDULE_KINDS))).alias("kind"))
    joined = kinds.join(counts, [group, "kind"], "left").fillna(0, ["hit", "n_actual", "n_expected"])
    p, r, f = evaluation.rates(F.col("hit"), F.col("n_actual"), F.col("n_expected"), "tables")
    scored = F.col("expected_tables").isNotNull() & ((F.col("kind") != "footnote") | (F.col("n_actual") + F.col("n_expected") > 0))
    agreed = F.when(F.col("expected_tables").isNotNull(), ((F.col("expected_tables") > 0) == (F.col("actual_tables") > 0)).cast("int"))
    return joined.select(group, "kind", agreed.alias("detection"), *(F.when(scored, F.round(x, 6)).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", f))))


def resolved_footnotes(definitions: DataFrame, anchors: DataFrame, table: str) -> DataFrame:
    """Defined markers, then anchors' markers without a definition, numbered in order; the first of each counts."""
    a = definitions.select(table, "marker", "text", "ord", F.lit(0).alias("side")).unionByName(anchors.select(table, "marker", F.lit("").alias("text"), "ord", F.lit(1).alias("side")))
    first = F.row_number().over(Window.partitionBy(table, "marker").orderBy("side", "ord"))
    place = F.row_number().over(Window.partitionBy(table).orderBy("side", "ord")) - 1
    return a.withColumn("_n", first).where("_n = 1").withColumn("marker_order", place).select(table, "marker", "marker_order", "text")


def stage_metrics(results: DataFrame) -> DataFrame:
    """By stage: total, passed, failed, pass rate, and means that leave nulls out; errors count in the total only."""
    passed, failed = F.count_if(F.col("status") == "passed"), F.count_if(F.col("status") == "failed")
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for c in ("precision", "recall", "f1", "latency")]
    return results.groupBy("stage").agg(F.count("*").alias("total"), passed.alias("passed"), failed.alias("failed"), F.round(passed / F.count("*"), 6).alias("pass_rate"), *means, F.round(F.sum("cost"), 6).alias("cost"))


def family_macro(results: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Mean over samples of each family's metric; ``metrics`` is a map from family to value."""
    return results.select("run_id", F.explode(metrics).alias("family", "value")).groupBy("run_id", "family").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def disagreements(sections: DataFrame) -> DataFrame:
    """Rows on which two classifiers differ, with whether they are resolved."""
    differ = F.col("algo_section").isNotNull() & F.col("llm_section").isNotNull() & (F.col("algo_section") != F.col("llm_section"))
    return sections.where(differ).withColumn("resolved", F.coalesce(F.startswith("classified_by", F.lit("resolved_")), F.lit(False)))


def tuning_stats(verdicts: DataFrame, session: str = "session_id") -> DataFrame:
    """Counts by verdict and rating, ratings 1 to 5 filled with zeros, and the mean rating."""
    ratings = [F.count_if(F.col("rating") == n).alias(f"rating_{n}") for n in range(1, 6)]
    return verdicts.groupBy(session).agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") == "incorrect").alias("incorrect"), F.round(F.avg("rating"), 2).alias("mean_rating"), *ratings)


def few_shots(approved: DataFrame, n: int) -> DataFrame:
    """One example of each sample and section with its facts in order; the first ``n`` samples of each section."""
    facts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fact_key", "value"))), lambda f: F.concat_ws("=", f["fact_key"], f["value"])), "; ")
    rows = approved.groupBy("section", "sample_id").agg(facts.alias("facts"))
    place = F.row_number().over(Window.partitionBy("section").orderBy("sample_id"))
    return rows.withColumn("n", place).where(F.col("n") <= n).drop("n")


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Dismissed findings become false positives, adjusted ones take the mapped severity and the verdict's details."""
    v = verdicts.select(F.col("id").alias("_id"), "verdict", F.col("severity").alias("_severity"), F.col("details").alias("_details"))
    joined = findings.join(v, findings["id"] == v["_id"], "left")
    return (
        joined.withColumn("status", F.when(F.col("verdict") == "dismissed", "false_positive").otherwise(F.col("status")))
        .withColumn("severity", F.when(F.col("verdict") == "adjusted", T.severity_intra(F.col("_severity"))).otherwise(F.col("severity")))
        .withColumn("details", F.when(F.col("verdict").isNotNull(), F.col("_details")).otherwise(F.col("details")))
        .drop("_id", "verdict", "_severity", "_details")
    )


def merge_answers(levels: DataFrame, group: list[str], canonical: str = "canonical") -> DataFrame:
    """Self-consistency: the most frequent canonical answer (ties: the first) with a boosted confidence."""
    voted = levels.groupBy(*group, canonical).agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.min_by("value", "ord").alias("value"), F.min_by("confidence", "ord").alias("confidence"))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first"))
    return voted.withColumn("_n", best).where("_n = 1").select(*group, "value", F.round(F.least(F.lit(0.95), F.col("confidence") + 0.1 * (F.col("n") - 1)), 6).alias("confidence"), "n")
