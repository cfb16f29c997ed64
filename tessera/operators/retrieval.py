"""Retrieval and corpus statistics over tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# BM25's parameters.
K1, B = 1.5, 0.75
#: Terms of all queries that filter the postings as literals; with more of them the join alone does.
MAX_TERMS = 10_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``term`` (lower case) and ``tf``."""
    return docs.select(id_col, F.explode(T.tokens(F.lower(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", group: str | None = None) -> DataFrame:
    """The ``k`` best texts for each query (``query_id``, ``query``), of positive score; ties by id.

    With a ``group`` (as a document whose sections are the texts) the texts of each group are a corpus of their own.
    Only postings of the queries' terms are shuffled.  A term that a query repeats counts as often.
    """
    own = F.col(group) if group else F.lit(0)
    asked = queries.select("query_id", F.explode(T.tokens(F.lower("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    words = docs.select(id_col, own.alias("_group"), T.tokens(F.lower(text_col)).alias("words"))
    sized = words.select(id_col, "_group", F.size("words").cast("long").alias("length"), "words")
    wanted = [r["term"] for r in asked.select("term").distinct().limit(MAX_TERMS + 1).collect()]
    if len(wanted) <= MAX_TERMS:
        sized = sized.withColumn("words", F.filter("words", lambda w: w.isin(wanted)))
    # one pass for the number and mean length of texts (no term) and for how many texts have each term
    met = sized.select("_group", "length", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("words"))).alias("term")).groupBy("_group", "term").agg(F.count("*").alias("df"), F.avg("length").alias("mean"))
    stats = met.where("term is null").select("_group", F.col("df").alias("n"), "mean")
    weighed = asked.join(met.where("term is not null").select("_group", "term", "df"), "term").join(stats, "_group")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    tf = sized.select(id_col, "_group", "length", F.explode("words").alias("term")).groupBy(id_col, "_group", "length", "term").agg(F.count("*").alias("tf"))
    scored = tf.join(weighed, ["_group", "term"]).groupBy("query_id", "_group", id_col).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id", "_group").orderBy(F.desc("score"), F.asc(id_col)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("_group", group or "_all").drop("_all")


def alike(left: DataFrame, right: DataFrame, left_key: list[str], right_key: list[str], a: str, b: str, least: float, within: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of rows whose word sets (``a``, ``b``) have a Jaccard similarity of ``least`` or more, as ``overlap``; equal in
    the columns ``within``, if there are any.

    Words are put in one order, by how many right sets have them.  A similar pair shares one of either set's first words, of
    so many that fewer than the needed share are left: both sides are listed under these only.  No pair is lost.
    Only keys, words and sizes are shuffled for the search; the sets are fetched for pairs that meet.
    """
    same, left_key, right_key = list(within), [*within, *(k for k in left_key if k not in within)], [*within, *(k for k in right_key if k not in within)]

    def exploded(rows: DataFrame, key: list[str], words: str, size: str) -> DataFrame:
        few = F.size(words) - F.ceil(F.size(words) * least - 1e-9) + 1
        return rows.select(*key, F.size(words).alias(size), few.alias("_few"), F.explode(words).alias("_word"))

    def listed(words: DataFrame, key: list[str], how: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.coalesce("_df", F.lit(0)), "_word"))
        return words.join(counts, [*same, "_word"], how).withColumn("_rank", rank).where("_rank <= _few and _df is not null").drop("_df", "_few", "_rank")

    mine, theirs = exploded(left, left_key, a, "_n"), exploded(right, right_key, b, "_m")
    counts = theirs.groupBy(*same, "_word").agg(F.count("*").alias("_df"))
    sizes = (F.col("_n") >= least * F.col("_m") - 1e-9) & (F.col("_m") >= least * F.col("_n") - 1e-9)
    keys = [*left_key, *(k for k in right_key if k not in same)]
    met = listed(mine, left_key, "left").join(listed(theirs, right_key, "inner"), [*same, "_word"]).where(sizes).select(*keys).distinct()
    found = met.join(left.select(*left_key, a), left_key).join(right.select(*right_key, b), right_key)
    return found.withColumn("overlap", T.jaccard(F.col(a), F.col(b))).where(F.col("overlap") >= least)


def top_tokens(docs: DataFrame, k: int, least: int = 4, stop: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """The most frequent tokens of at least ``least`` characters that aren't numbers or stop words."""
    found = docs.select(F.explode(T.tokens(F.lower(text_col))).alias("token"))
    kept = found.where((F.length("token") >= least) & ~F.col("token").rlike("^[0-9]+$") & ~F.col("token").isin(*stop)) if stop else found.where((F.length("token") >= least) & ~F.col("token").rlike("^[0-9]+$"))
    return kept.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)
