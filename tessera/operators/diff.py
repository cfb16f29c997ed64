"""Differences of versions, impact, and relinking."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def diff_values(old: DataFrame, new: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """``key``, ``change``, ``old_value`` and ``new_value`` of a keyed diff; of repeated keys the last in ``order`` counts."""
    if order:
        old, new = last_wins(old, key, order), last_wins(new, key, order)
    a, b = old.select(key, F.col(value).alias("old_value"), F.lit(1).alias("_a")), new.select(key, F.col(value).alias("new_value"), F.lit(1).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "unchanged").otherwise("modified")
    return a.join(b, key, "full").select(key, change.alias("change"), "old_value", "new_value")


def diff_sections(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Section diff over ``key``, ``ord``, ``title``, ``standard``, ``content``: ``key``, ``change``, ``title``, ``standard``, both orders.

    Within a document (``key``) an old section matches the first new one with the same standard section or the same
    normalised title: two equi joins on reduced tables, not one disjunctive join.  A new section nobody matched is
    added, unless an old or earlier added one has its title or standard section.
    """
    a = old.select(key, F.col("ord").alias("old_ord"), F.col("title").alias("old_title"), F.nullif("standard", F.lit("")).alias("old_standard"), F.col("content").alias("old_content"), T.normal_title(F.col("title")).alias("_title"))
    b = new.select(key, F.col("ord").alias("new_ord"), F.struct("ord", "title", F.nullif("standard", F.lit("")).alias("standard"), "content").alias("new"), T.normal_title(F.col("title")).alias("_title"))
    # the first new section of each title and of each standard section, so no join multiplies rows
    by_title = b.groupBy(key, "_title").agg(F.min_by("new", "new_ord").alias("t"))
    by_standard = b.where("new.standard is not null").groupBy(key, F.col("new.standard").alias("old_standard")).agg(F.min_by("new", "new_ord").alias("s"))
    both = a.join(by_title, [key, "_title"], "left").join(by_standard, [key, "old_standard"], "left")
    new_of = F.when(F.col("t").isNull() | (F.col("s.ord") < F.col("t.ord")), F.col("s")).otherwise(F.col("t"))
    matched = both.withColumn("new", new_of)
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old_content").eqNullSafe(F.col("new.content")), "unchanged").otherwise("modified")
    standard = F.coalesce("old_standard", "new.standard")
    diffs = matched.select(key, change.alias("change"), F.coalesce("new.title", "old_title").alias("title"), standard.alias("standard"), "old_ord", F.col("new.ord").alias("new_ord"))
    free = b.select(key, "new_ord", F.col("new.title").alias("title"), F.col("new.standard").alias("standard"))
    free = free.join(diffs.select(key, "new_ord"), [key, "new_ord"], "left_anti").join(diffs.select(key, "title"), [key, "title"], "left_anti").join(diffs.select(key, "standard"), [key, "standard"], "left_anti")
    return diffs.unionByName(added_sections(free, key).select(key, F.lit("added").alias("change"), "title", "standard", F.lit(None).cast("long").alias("old_ord"), "new_ord"))


def added_sections(free: DataFrame, key: str) -> DataFrame:
    """Of the unmatched sections (``key``, ``new_ord``, ``title``, ``standard``) those that no earlier *added* one of
    the document blocks by its title or standard section.

    Whether a section blocks depends on those before it, so a document's are folded in order.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        titles, standards, kept = set(), set(), []
        rows = rows.sort_values("new_ord")
        for title, standard in zip(rows["title"], rows["standard"]):
            free = title not in titles and (standard is None or standard not in standards)
            kept.append(free)
            if free:
                titles.add(title)
                standards.add(standard)
        return rows[kept]

    return free.groupBy(key).applyInPandas(fold, free.schema)


def impact(changes: DataFrame, mapping: dict[str, list[str]], section: str = "standard", change: str = "change", parts: Column | None = None) -> DataFrame:
    """One row for each changed section and section that it touches, with severity."""
    spark = changes.sparkSession
    table = spark.createDataFrame([(k, v) for k, vs in mapping.items() for v in vs], "_section string, impacted string")
    many = (parts > 5) if parts is not None else F.lit(False)
    severity = F.when((F.col(change) == "removed") | many, "high").otherwise("medium")
    rows = changes.where(F.col(change) != "unchanged").join(table, F.col(section) == F.col("_section"))
    return rows.withColumn("severity", severity).withColumn("requires_update", F.col("severity") == "high").drop("_section")


def relink(expected: DataFrame, actual: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``id``, ``section_id`` and ``method`` of each expected section, by the first way that finds one: its paragraph, the
    digest of its content, a snippet inside a title of its level, or its title's occurrence (the first, if there are fewer).

    Expected rows have ``paragraph``, ``digest``, ``snippet``, ``level``, ``title`` and ``occurrence``, actual ones
    ``section_id``, ``ord``, ``paragraph``, ``digest``, ``level`` and ``title``.  Where actual paragraphs or digests repeat, the last counts.
    """
    key = F.lower(F.trim("title"))
    last = F.max_by("section_id", "ord")
    out = expected.withColumn("_title", key).withColumn("_needle", F.nullif(F.lower(F.trim("snippet")), F.lit("")))
    by_paragraph = actual.where("paragraph is not null").groupBy(doc, "paragraph").agg(last.alias("_paragraph"))
    by_digest = actual.where("digest <> ''").groupBy(doc, "digest").agg(last.alias("_digest"))
    place = F.row_number().over(Window.partitionBy(doc, "_title").orderBy("ord")) - 1
    titled = actual.withColumn("_title", key).withColumn("occurrence", place).select(doc, "_title", "occurrence", "section_id")
    out = out.withColumn("occurrence", F.coalesce("occurrence", F.lit(0)))
    out = out.join(by_paragraph, [doc, "paragraph"], "left").join(by_digest, [doc, "digest"], "left")
    out = out.join(titled.withColumnRenamed("section_id", "_nth"), [doc, "_title", "occurrence"], "left").join(titled.where("occurrence = 0").select(doc, "_title", F.col("section_id").alias("_first")), [doc, "_title"], "left")
    # a substring has no key but the document and the level: only rows without a better way are compared
    open_rows = out.where("_paragraph is null and _digest is null and _needle is not null").select(doc, "level", "id", "_needle")
    inside = open_rows.join(actual.select(doc, "level", "title", "ord", "section_id"), [doc, "level"]).where(F.contains(F.lower("title"), F.col("_needle")))
    out = out.join(inside.groupBy("id").agg(F.min_by("section_id", "ord").alias("_snippet")), "id", "left").withColumn("_title_occurrence", F.coalesce("_nth", "_first"))
    ways = ("paragraph", "digest", "snippet", "title_occurrence")
    how = F.coalesce(*(F.when(F.col(f"_{w}").isNotNull(), F.lit(w)) for w in ways))
    return out.select("id", F.coalesce(*(F.col(f"_{w}") for w in ways)).alias("section_id"), how.alias("method"))


def found_sections(expected: list[tuple], actual: list[tuple]) -> Iterator[tuple]:
    """Id, section and way of each expected section of one document; see ``relink`` for the ways.

    Expected ones are (id, paragraph, digest, title, needle, level, occurrence), actual ones in order (section, paragraph,
    digest, title, level), titles and needles trimmed and lowered.
    """
    paragraphs, digests, places, counts, levels = {}, {}, {}, {}, {}
    for section, paragraph, digest, title, level in actual:
        paragraphs[paragraph] = digests[digest] = section
        places[title, counts.setdefault(title, 0)] = section
        counts[title] += 1
        levels.setdefault(level, []).append((title, section))
    for nothing, known in ((None, paragraphs), (None, digests), ("", digests)):
        known.pop(nothing, None)
    for key, paragraph, digest, title, needle, level, occurrence in expected:
        section, way = paragraphs.get(paragraph), "paragraph"
        if section is None:
            section, way = digests.get(digest), "digest"
        if section is None and needle is not None and level is not None:
            section, way = next((own for name, own in levels.get(level, ()) if name is not None and needle in name), None), "snippet"
        if section is None and title is not None:
            section, way = places.get((title, occurrence), places.get((title, 0))), "title_occurrence"
        yield key, section, None if section is None else way


def nested_relinks(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """As ``relink``, for sections that stand in two arrays of a document's row (structs of the same fields), a document
    being one row: nothing is shuffled.

    Sections go to Python as rows, a document's behind each other and with a mark at its last one, so that only one
    document is held at a time.
    """
    flat = lambda c: F.lower(F.trim(c))
    rows = rows.select(*(F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in (expected, actual)))
    wanted = F.transform(expected, lambda e: F.struct(e["id"].alias("id"), e["paragraph"].alias("paragraph"), e["digest"].alias("digest"), flat(e["title"]).alias("title"), F.nullif(flat(e["snippet"]), F.lit("")).alias("needle"), e["level"].alias("level"), F.coalesce(e["occurrence"], F.lit(0)).alias("occurrence")))
    have = F.array_sort(F.transform(actual, lambda a: F.struct(a["ord"].alias("ord"), a["section_id"].alias("section_id"), a["paragraph"].alias("paragraph"), a["digest"].alias("digest"), flat(a["title"]).alias("title"), a["level"].alias("level"))))
    paired = rows.select(F.arrays_zip(wanted.alias("e"), have.alias("a")).alias("both"))
    # outer: Spark infers no filter, which would make the arrays again
    each = paired.select(F.size("both").alias("n"), F.posexplode_outer("both").alias("at", "x")).where("x is not null")
    sides = {"e": ("id", "paragraph", "digest", "title", "needle", "level", "occurrence"), "a": ("section_id", "paragraph", "digest", "title", "level")}
    sent = each.select((F.col("at") == F.col("n") - 1).alias("last"), *(c for k, names in sides.items() for c in (F.col(f"x.{k}").isNotNull().alias(f"{k}_there"), *(F.col(f"x.{k}.{n}").alias(f"{k}_{n}") for n in names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, new = [], []
        for batch in batches:
            out = []
            for last, *line in zip(*(c.to_pylist() for c in batch.columns)):
                if line[0]:
                    old.append(line[1:8])
                if line[8]:
                    new.append(line[9:])
                if last:
                    out += found_sections(old, new)
                    old, new = [], []
            columns = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (batch.schema.field("e_id").type, batch.schema.field("a_section_id").type, pa.string()))], names=["id", "section_id", "method"])

    kinds = dict(sent.dtypes)
    return sent.mapInArrow(run, f"id {kinds['e_id']}, section_id {kinds['a_section_id']}, method string")


@functools.lru_cache(maxsize=2)
def _tokens(text: str) -> list[str]:
    """Words, blanks and other characters; the last texts' are kept, as a line is often compared with both neighbours."""
    return re.findall(r"\w+|\s+|[^\w\s]", text)


#: Fixed value: bits of a comparison's state that are kept at once, 32 MB of them.
_KEPT_BITS = 1 << 28


def common_tokens(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order."""
    in_a, in_b = set(a), set(b)
    rows, columns = [i for i, t in enumerate(a) if t in in_b], [j for j, t in enumerate(b) if t in in_a]
    return [(rows[i], columns[j]) for i, j in _longest([a[i] for i in rows], [b[j] for j in columns])]


def _longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """``common_tokens`` of texts without words of their own.

    A state has a bit for each token of ``b``, clear where the subsequence of the tokens of ``a`` so far grows; states
    of some tokens of ``a`` are kept and those between them worked out again, so memory doesn't grow with both lengths.
    """
    step = max(1, _KEPT_BITS // (len(b) + 1))
    full = (1 << len(b)) - 1
    masks: dict[str, int] = {}
    places: dict[str, list[int]] = {}
    few = len(b) <= step
    for j, token in enumerate(b):
        if few:
            masks[token] = masks.get(token, 0) | 1 << j
        else:
            places.setdefault(token, []).append(j)

    def mask(token: str) -> int:
        """Where ``b`` has the token; of many tokens only some masks are kept."""
        found = masks.get(token)
        if found is None:
            bits = bytearray(len(b) + 7 >> 3)
            for j in places[token]:
                bits[j >> 3] |= 1 << (j & 7)
            found = int.from_bytes(bits, "little")
            if len(masks) < step:
                masks[token] = found
        return found

    def states(state: int, tokens: list[str]) -> list[int]:
        found = [state]
        for hit in map(masks.__getitem__ if few else mask, tokens):
            hit &= state
            state = (state + hit | state - hit) & full
            found.append(state)
        return found

    kept = [full]
    for at in range(0, len(a) - step, step):
        kept.append(states(kept[-1], a[at:at + step])[-1])
    found, row, bit = [], len(a), 1 << len(b) >> 1
    for at in range((len(kept) - 1) * step, -1, -step):
        between = states(kept.pop(), a[at:row])
        state = between[-1]
        while row > at and bit:
            if not state & bit:
                row -= 1
                state = between[row - at]
                if not state & bit:
                    continue
                found.append((row, bit.bit_length() - 1))
            bit >>= 1
    return found[::-1]


def word_changes(old: str, new: str) -> list[tuple[str, str]]:
    """Parts of a word diff with the most equal tokens: (equal, remove or add; text).

    Time grows with the product of the numbers of tokens, some two thousand pairs of them a microsecond in long texts.
    """
    a, b = _tokens(old or ""), _tokens(new or "")
    shortest = min(len(a), len(b))
    head = next((i for i in range(shortest) if a[i] != b[i]), shortest)
    tail = next((i for i in range(shortest - head) if a[-1 - i] != b[-1 - i]), shortest - head)
    blocks = [[0, 0, head]]
    for i, j in common_tokens(a[head:len(a) - tail], b[head:len(b) - tail]):
        last = blocks[-1]
        if (head + i, head + j) == (last[0] + last[2], last[1] + last[2]):
            last[2] += 1
        else:
            blocks.append([head + i, head + j, 1])
    parts: list[tuple[str, str]] = []
    i = j = 0
    for k, m, size in [*blocks, [len(a) - tail, len(b) - tail, tail]]:
        if i < k:
            parts.append(("remove", "".join(a[i:k])))
        if j < m:
            parts.append(("add", "".join(b[j:m])))
        if size and parts and parts[-1][0] == "equal":
            parts[-1] = ("equal", parts[-1][1] + "".join(a[k:k + size]))
        elif size:
            parts.append(("equal", "".join(a[k:k + size])))
        i, j = k + size, m + size
    return parts


def with_word_changes(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Adds ``parts``: the word diff of two text columns, an array of (kind, text).  Equal texts are not compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            kinds, texts, ends = [], [], [0]
            for a, b in zip(own[old].to_pylist(), own[new].to_pylist()):
                for kind, text in word_changes(a, b) if a != b else [("equal", a)] if a else []:
                    kinds.append(kind)
                    texts.append(text)
                ends.append(len(kinds))
            # flat columns: a tuple for each part costs more than its comparison
            parts = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["kind", "text"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)], names=[*own.schema.names, "parts"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", parts array<struct<kind: string, text: string>>")
