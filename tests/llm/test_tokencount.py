import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library_and_the_cache_grows_by_misses_only(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    long = "some words here. " * 9000
    rows = [(1, None, 1), (2, "", 2), (3, "Hello <|endoftext|> é", 3), (3, "Hello <|endoftext|> é", 4), (3, "other", 5), (4, long, 6), (None, "null id", 7)] + [(10 + i, "copy of a text", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")

    def check(found):
        assert len(found) == len(rows)
        wanted = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == wanted
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)

    check(tokencount.count_tokens(docs, PATH, cache).collect())
    stored = spark.read.parquet(cache)
    distinct = len({t or "" for _, t, _ in rows})
    assert stored.count() == stored.select("digest").distinct().count() == distinct
    check(tokencount.count_tokens(docs, PATH, cache).collect())
    assert spark.read.parquet(cache).count() == distinct
    tokencount.count_tokens(docs.limit(0).unionByName(spark.createDataFrame([(99, "new", 1)], docs.schema)), PATH, cache).collect()
    assert spark.read.parquet(cache).count() == distinct + 1


def test_another_version_shares_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello there")], "doc_id long, text string")
    cache = str(tmp_path / "cache")
    other = public_tokenizers.path("word_bpe_49k.json")
    a = tokencount.count_tokens(docs, PATH, cache).first()["n_tokens"]
    b = tokencount.count_tokens(docs, other, cache).first()["n_tokens"]
    assert (a, b) == (2, 2) and spark.read.parquet(cache).select(F.count_distinct("tokenizer")).first()[0] == 2


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.count_tokens(docs, PATH, str(tmp_path / "c")).collect() == []


def test_many_rows_of_one_id(spark, tmp_path):
    rows = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "concat('text ', id % 1000) as text")
    found = tokencount.count_tokens(rows, PATH, str(tmp_path / "c"))
    assert found.count() == 100_000 and found.select("n_tokens").distinct().count() <= 3 and spark.read.parquet(str(tmp_path / "c")).count() == 1000
