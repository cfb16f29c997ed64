"""Headings of paragraphs with properties, numbering counters and prompts' text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Lines that look numbered but are time points or footnotes.
TIMEPOINT = rf"^(день|days?|неделя|weeks?|визит|visits?|месяц|months?)[{T.WHITE}]+\d+([{T.WHITE}]*\([^)]*\))?[{T.WHITE}]*$"
FOOTNOTE_ROW = rf"^\d+[{T.WHITE}]*[-–—][{T.WHITE}]+[a-zа-яё]"


def detect(paragraphs: DataFrame, base_size: Column) -> DataFrame:
    """Adds ``level`` and ``method`` to paragraphs (``text``, ``style``, ``outline``, ``bold``, ``size``); null: no heading.

    Precedence: style, outline, larger bold text, number, bold alone.
    """
    text = T.trimmed(F.col("text"))
    style = F.regexp_extract(F.lower(F.coalesce("style", F.lit(""))), r"^heading\s*(\d+)$", 1)
    other = (F.coalesce("style", F.lit("")) == "") & (F.lower(text).rlike(TIMEPOINT) | text.rlike(FOOTNOTE_ROW))
    bold, ratio = F.coalesce("bold", F.lit(False)), F.col("size") / base_size
    number = F.regexp_extract("text", rf"^(\d+(?:\.\d+)*)[{T.WHITE}]+", 1)
    depth = F.size(F.split(number, r"\."))
    ends = text.rlike("[,;:]$")
    numbered = (number != "") & (bold | (~ends & ((depth >= 2) | (F.length(text) <= 80))))
    alone = bold & (number == "") & F.length(text).between(5, 120) & ~text.rlike("[,;:.]$") & text.rlike("^[A-ZА-ЯЁ0-9]")
    larger = bold & (F.col("size") > base_size)

    def choose(*values: Column) -> Column:
        tests = (style != "", F.col("outline").between(0, 8), larger, numbered, alone)
        chosen = F.when((text == "") | other, None)
        for test, value in zip(tests, values):
            chosen = chosen.when(F.coalesce(test, F.lit(False)), value)
        return chosen.otherwise(None)

    visual = F.when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).otherwise(3)
    short = F.when((F.length(text) <= 60) & (text == F.upper(text)), 1).when(F.length(text) <= 80, 2).otherwise(3)
    level = choose(style.try_cast("int"), F.col("outline") + 1, visual, depth, short)
    method = choose(*map(F.lit, ("style", "outline", "visual", "numbered", "visual")))
    return paragraphs.withColumn("level", level.cast("int")).withColumn("method", method)


def base_size(paragraphs: DataFrame, id_col: str) -> DataFrame:
    """The median font size of each document; 12 with under five sizes."""
    return paragraphs.groupBy(id_col).agg(F.when(F.count("size") < 5, 12.0).otherwise(F.median("size")).alias("base_size"))


def number_paragraphs(paragraphs: DataFrame, levels: DataFrame, id_col: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adds ``number`` to paragraphs with ``num_id`` and ``ilvl``.

    ``levels``: each document's (``id_col``) ``num_id``, ``ilvl``, ``start`` and ``format`` (``%1.%2``).  Counters run
    along a document, so each document is folded in order, together with its levels.
    """

    def fold(rows: pd.DataFrame, own_levels: pd.DataFrame) -> pd.DataFrame:
        table = {(int(n), int(i)): (int(s), f) for n, i, s, f in zip(*(own_levels[c] for c in ("num_id", "ilvl", "start", "format")))}
        rows = rows.sort_values(order)
        counters: dict[int, dict[int, int]] = {}
        numbers = []
        for num, lvl in zip(rows["num_id"], rows["ilvl"]):
            if pd.isna(num) or pd.isna(lvl) or (int(num), int(lvl)) not in table:
                numbers.append(None)
                continue
            num, lvl = int(num), int(lvl)
            own = counters.setdefault(num, {})
            for deeper in [k for k in own if k > lvl]:
                del own[deeper]
            start, shape = table[num, lvl]
            own[lvl] = own[lvl] + 1 if lvl in own else start
            for k in range(9, 0, -1):
                shape = shape.replace(f"%{k}", str(own.get(k - 1, table.get((num, k - 1), (1, ""))[0])))
            numbers.append(shape.rstrip(".)]: \t"))
        return rows.assign(number=pd.Series(numbers, rows.index, object))

    schema = ", ".join(f"`{n}` {k}" for n, k in paragraphs.dtypes) + ", number string"
    return paragraphs.groupBy(id_col).cogroup(levels.groupBy(id_col)).applyInPandas(fold, schema)


def chunks(text: str, size: int = 8000, overlap: int = 1000) -> list[str]:
    """Pieces of a text that overlap; a cut moves back to white space in the last tenth, and always gets on."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            space = max(text.rfind(c, at + size - size // 10, end) for c in " \n\t")
            end = space if space > at else end
        out.append(text[at:end])
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 8000, overlap: int = 1000) -> DataFrame:
    """``id_col``, ``chunk`` (from 0) and ``text`` of the overlapping pieces of every text; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(key, i, piece) for key, text in zip(rows[id_col], rows[text_col]) if text for i, piece in enumerate(chunks(text, size, overlap))]
            yield pd.DataFrame(found, columns=[id_col, "chunk", "text"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(docs.dtypes)[id_col]}, chunk int, text string")


# With fewer headings, or fewer of the sure methods, a model is asked, and what those methods are.
FEW_HEADINGS, FEW_SURE, SURE_METHODS = 20, 10, ("style", "outline", "numbered")


def with_fallback(headings: DataFrame, paragraphs: DataFrame, answers: DataFrame, id_col: str = "doc_id", deepest: int = 9) -> DataFrame:
    """Headings (``id_col``, ``paragraph``, ``text``, ``level``, ``method``) where a model's (``paragraph``, ``level``)
    replace a document's own.

    A model is asked where headings are few or few are sure; its answer counts if it names more headings, of existing
    paragraphs and levels from 1 to 9, than were sure.
    """
    sure = F.count_if(F.col("method").isin(*SURE_METHODS))
    counted = headings.groupBy(id_col).agg(F.count("*").alias("_n"), sure.alias("_sure"))
    documents = paragraphs.select(id_col).distinct().join(counted, id_col, "left").select(id_col, F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_sure", F.lit(0)).alias("_sure"))
    asked = documents.where((F.col("_n") < FEW_HEADINGS) | (F.col("_sure") < FEW_SURE))
    named = answers.where("level between 1 and 9").join(paragraphs.select(id_col, "paragraph", "text"), [id_col, "paragraph"]).join(asked, id_col)
    enough = named.groupBy(id_col).agg(F.count("*").alias("_m"), F.first("_sure").alias("_sure")).where("_m > _sure").select(id_col)
    theirs = named.join(enough, id_col, "left_semi").select(id_col, "paragraph", F.trim("text").alias("text"), F.least("level", F.lit(deepest)).alias("level"), F.lit("llm").alias("method"))
    own = headings.join(enough, id_col, "left_anti").select(id_col, "paragraph", "text", "level", "method")
    return own.unionByName(theirs)


def budget_batches(rows: DataFrame, id_col: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """Adds ``batch``: consecutive rows whose sizes stay within a budget and a count."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        batch, used, n, out = 0, 0, 0, []
        for s in group[size]:
            if n and (used + s > budget or n >= most):
                batch, used, n = batch + 1, 0, 0
            used, n = used + s, n + 1
            out.append(batch)
        return group.assign(batch=out)

    return rows.groupBy(id_col).applyInPandas(fold, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes) + ", batch long")


def within_budget(rows: DataFrame, group: list[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """The first rows of each group whose running size stays within the budget."""
    from pyspark.sql import Window

    running = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_used", running).where(F.col("_used") <= budget).drop("_used")


# Fixed value: characters that count as one token.
CHARS_PER_TOKEN = 3.5


def zone_texts(sections: DataFrame, id_col: str, zone: str, order: str, text: str) -> DataFrame:
    """The text of each document's root zones in section order; sections without a zone are ``__unclassified__``."""
    root = F.coalesce(F.substring_index(F.col(zone), ".", 1), F.lit("__unclassified__"))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return sections.groupBy(id_col, root.alias("zone")).agg(F.array_join(F.transform(pieces, lambda p: p[text]), "\n\n").alias("zone_text"))
