import re

import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = queries.op2_langid(spark, sf).join(langs, "doc_id").where("held_out and lang_pred <> 'und'")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 150 and right / n >= 0.96


def test_cases(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat sat on the mat with them", "en"), ("der hund und die katze sind im haus", "de")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = langid.train(docs)
    assert sorted(content) == ["de", "en"]
    asked = spark.createDataFrame([(1, None, "q", 1.0), (2, "", "q", 1.0), (3, "123 ... 4 ²½", "q", 1.0), (4, "the mat with the cat", None, None), (4, "the mat with the cat", "de", None), (5, "und die katze im haus " * 9000, "en", 0.0)], "doc_id long, text string, lang string, score double")
    found = {r["doc_id"]: r for r in langid.identify(asked, content).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[1]["score"] == 0
    assert found[1]["rejected"] and not found[5]["rejected"]
    kept = langid.keep_known(asked, content)
    assert kept.columns == asked.columns and {r["doc_id"] for r in kept.collect()} == {4, 5}
    assert langid.identify(asked.limit(0), content).collect() == []


def test_predictions_equal_brute_force(spark, small):
    """Every text against every dictionary, with a compressor made anew for each."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").limit(60).unionByName(spark.createDataFrame([(None, "sans identité mais des mots", "fr"), (None, None, None)], "doc_id long, text string, lang string"))
    content = langid.train(docs)
    found = {(r["doc_id"], r["text"]): (r["lang_pred"], r["margin"]) for r in langid.identify(docs, content).join(docs, "doc_id").collect()}
    for r in docs.where("doc_id is not null").collect():
        plain = re.sub(r"[\W\d_]+", " ", (r["text"] or "").lower())
        sizes = []
        for lang, raw in content.items():
            data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            compressor = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(compressor.compress(plain[i : i + 1200].encode())) for i in range(0, len(plain), 1200)), lang))
        best, following = sorted(sizes)[:2]
        assert found[r["doc_id"], r["text"]] == (best[1], (following[0] - best[0]) / following[0])
    nameless = langid.identify(docs.where("doc_id is null"), content).collect()
    assert len(nameless) == 2 and {r["lang_pred"] for r in nameless} - set(content) == {"und"}


def test_more_languages_than_can_be_held(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "some words here", f"l{i % 3}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs)


def test_without_training_rows_everything_is_unknown(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.train(docs) == {}
    assert langid.identify(docs, {}).first()["lang_pred"] == "und"


def test_ties_and_single_languages():
    one = langid._compressors((("xx", b"abc"),))
    assert langid.classify("hello", one) == ("xx", 1.0, 1.0)
    two = langid._compressors((("aa", b"same words"), ("bb", b"same words")))
    lang, score, margin = langid.classify("other text", two)
    assert lang == "aa" and margin == 0 and score == 0.5


def test_blocks_cover_the_whole_text():
    text = "é" * 5003
    assert b"".join(langid.blocks(text)).decode() == text


def test_samples_are_bounded_where_one_id_or_row_repeats(spark):
    from pyspark.sql import functions as F

    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 6 == 0, "same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    found = langid.training_texts(rows, F.lit(False))["en"]
    assert langid.SAMPLE_ROWS // 2 < len(found) < 2 * langid.SAMPLE_ROWS and found.count("same") <= 1
