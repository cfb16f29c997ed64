"""Order and hierarchy inside a document: lines, headings, parents, neighbours, anomalies, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ord`` (from 0) and ``line`` of every line."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("ord", "line"))


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ord`` (from 0) and ``sentence``: pieces between closing marks with white space behind."""
    return docs.select(id_col, F.posexplode(F.split(F.col(text_col), r"[.!?]\s+", -1)).alias("ord", "sentence"))


def is_heading(line: Column) -> Column:
    """Numbered lines, lines in capitals, and short lines without a closing mark."""
    flat = F.trim(line)
    numbered = flat.rlike(r"^[0-9]+(\.[0-9]+)*[.)]?\s+\S")
    capitals = flat.rlike("[A-Z]") & ~flat.rlike("[a-z]")
    short = (F.length(flat) <= 40) & flat.rlike("[A-Za-z]") & ~flat.rlike("[.,;:!?]$")
    return (flat != "") & (numbered | capitals | short)


def last_heading(rows: DataFrame, id_col: str = "doc_id", order: str = "ord", flag: str = "heading") -> DataFrame:
    """Adds ``under``: the order of the last heading at or before each row, null before the first."""
    before = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("under", F.last(F.when(F.col(flag), F.col(order)), ignorenulls=True).over(before))


def parents(rows: DataFrame, id_col: str, order: str, level: str, levels: int) -> DataFrame:
    """Adds ``parent``: the order of the last row before with a smaller level (from 1 to ``levels``).

    One running last value for each level; the latest among the smaller levels is the top of the level stack.
    """
    before = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.last(F.when(F.col(level) == n, F.col(order)), ignorenulls=True).over(before) for n in range(1, levels + 1)]
    below = [F.when(F.col(level) > n, found) for n, found in enumerate(latest, 1)]
    return rows.withColumn("parent", F.greatest(*below, F.lit(None).cast("long")))


def neighbours(rows: DataFrame, id_col: str, order: str, value: Column, reach: int = 3) -> DataFrame:
    """Adds ``context``: the values of the rows at most ``reach`` places away, joined in order."""
    around = Window.partitionBy(id_col).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn("context", F.array_join(F.collect_list(value).over(around), " | "))


def anomalies(rows: DataFrame, id_col: str = "doc_id", order: str = "ord", title: str = "line") -> DataFrame:
    """One row for each ``id_col``, ``order`` and kind: empty, short (under 20 characters), duplicate."""
    key = F.lower(F.trim(F.col(title)))
    same = Window.partitionBy(id_col, key)
    counted = rows.withColumn("_same", F.count("*").over(same))
    kinds = F.array(
        F.when(key == "", "empty"),
        F.when((key != "") & (F.length(key) < 20), "short"),
        F.when((key != "") & (F.col("_same") > 1), "duplicate"),
    )
    return counted.select(id_col, order, F.explode(F.array_compact(kinds)).alias("kind"))


def fixed_batches(rows: DataFrame, id_col: str, order: list[str], size: int) -> DataFrame:
    """Adds ``batch``: runs of ``size`` rows in order, from 0."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("long"))


def occurrence(rows: DataFrame, id_col: list[str], title: Column, order: list[Column]) -> DataFrame:
    """Adds ``occurrence``: the place among rows with the same title, from 0."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*id_col, title).orderBy(*order)).cast("long") - 1)


def spread_occurrence(rows: DataFrame, key: Column, order: str, width: int) -> DataFrame:
    """As ``occurrence`` by one integer column, without ever bringing all rows of a key together.

    Rows are ranked inside ranges of ``width`` of the order column; the counts of a key's earlier ranges, one
    row each, are added.
    """
    dealt = rows.withColumn("_key", key).withColumn("_range", F.floor(F.col(order) / width))
    counts = dealt.groupBy("_key", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_key", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_key", "_range").orderBy(order)).cast("long") - 1
    ranked = dealt.withColumn("_place", place).join(before, ["_key", "_range"])
    return ranked.withColumn("occurrence", F.col("_place") + F.col("_before")).drop("_key", "_range", "_place", "_before")


def running_offsets(rows: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """Adds ``offset``: the sizes of all earlier parts of the same key."""
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("long"))


# What a table of contents is called, a line's page number, and a heading's own number.
TOC_TITLE = rf"^(содержани[ея]|оглавлени[ея]|table[{T.WHITE}]+of[{T.WHITE}]+contents|contents)[{T.WHITE}]*$"
PAGE_TAIL, OWN_NUMBER = rf"[{T.WHITE}.…]+(\d{{1,4}})[{T.WHITE}]*$", rf"^\d+(\.\d+)*\.?[{T.WHITE}]+"


def table_of_contents(headings: DataFrame, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Headings (``ord``, ``text``, ``paragraph``) that are lines of a table of contents.

    Such a line ends with a page number, has a twin without one, has no block (``paragraph``) of its own, stands
    beside the title of the contents, another line without blocks or the document's edge, and its page fits
    between its neighbours' pages.
    """
    page = F.regexp_extract("text", PAGE_TAIL, 1).try_cast("int")
    twin = F.lower(T.trimmed(F.regexp_replace(F.regexp_replace("text", PAGE_TAIL, ""), OWN_NUMBER, "")))
    # blocks below a heading: those between its paragraph and the next heading's
    marks = headings.select(id_col, "paragraph", "ord").unionByName(blocks.select(id_col, "paragraph", F.lit(None).cast(dict(headings.dtypes)["ord"]).alias("ord")))
    before = Window.partitionBy(id_col).orderBy("paragraph", F.desc_nulls_last("ord")).rowsBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy(id_col, "paragraph")
    below = marks.withColumn("_under", F.last("ord", ignorenulls=True).over(before)).withColumn("_at", F.max("ord").over(at)).where("ord is null and _at is null and _under is not null")
    filled = below.select(F.col(id_col).alias("_id"), F.col("_under").alias("_ord")).distinct().withColumn("_filled", F.lit(True))
    own = headings.join(filled, (headings[id_col] == F.col("_id")) & (headings["ord"] == F.col("_ord")), "left").drop("_id", "_ord")
    row = Window.partitionBy(id_col).orderBy("ord")
    rows = own.select(*headings.columns, F.coalesce("_filled", F.lit(False)).alias("_filled"), page.alias("_page"), twin.alias("_twin"), F.lower(T.trimmed(F.col("text"))).rlike(TOC_TITLE).alias("_title"))
    rows = rows.withColumn("_plain", F.max(F.when(F.col("_page").isNull(), 1)).over(Window.partitionBy(id_col, "_twin")))
    for name, step in (("_prev", F.lag), ("_next", F.lead)):
        rows = rows.withColumn(name, step(F.struct("_filled", "_page", "_title")).over(row))
    first = F.col("_prev").isNull() | F.col("_prev._title") | ~F.col("_prev._filled")
    last = F.col("_next").isNull() | ~F.col("_next._filled")
    rising = (F.coalesce("_prev._page", "_page") <= F.col("_page")) & (F.coalesce("_next._page", "_page") >= F.col("_page"))
    return rows.where(F.col("_page").isNotNull() & (F.col("_twin") != "") & (F.col("_plain") == 1) & ~F.col("_filled") & (first | last) & rising).select(*headings.columns)
