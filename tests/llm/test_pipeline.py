import os

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__
from tessera.llm import langid, quality, simhash


def test_stages_keep_the_columns_and_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    at, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, "unused").cache()
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
            sizes.append(out.count())
        if name == "quality_rules":
            assert all(quality.measure(r["text"])[6] for r in out.collect())
        if name == "near_dedup":
            groups = simhash.near_duplicates(at).select("component_id").distinct().count()
            # what is kept has no link within the radius, and the groups only grew by similar texts
            assert out.count() == simhash.near_duplicates(out).select("component_id").distinct().count() <= groups
        before, at = at, out
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[3]
    assert {r["doc_id"] for r in at.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_run_equals_its_stages(spark, small):
    found = corpus_pipeline.run(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = quality.keep_good(docs)
    kept = simhash.keep_first(langid.keep_known(kept, langid.train(kept)))
    assert {r["doc_id"] for r in found.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}


def test_stages_handle_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    # no sequence of words repeats
    good = " ".join(f"word{i} the{i} and{i} of{i}" for i in range(30))
    rows = [(1, None, None, None, None, None), (2, "", "en", None, 0, 1.0), (None, good, "en", "s", 5, None), (3, good, "en", "s", 5, None), (3, good, "en", "s", 5, None)]
    kept = {}
    at = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "unused")
        kept[name] = sorted((r["doc_id"] for r in at.collect()), key=str)
    # too short texts go; rows without an id can't be told apart and stay; of repeated rows one stays
    assert kept == {"quality_rules": [3, 3, None], "language_id": [3, 3, None], "near_dedup": [3, None], "best_fit_packing": [3, None]}
    at = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "unused")
        assert at.collect() == [] and (name == "best_fit_packing" or at.columns == [c.split()[0] for c in schema.split(", ")])


@pytest.mark.parametrize("name", ["op3_urls", "op10_warc"])
def test_queries_equal_their_sql(spark, small, name):
    sql = __spark_entry__.oracle_sql()[name]
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{small}/pages.parquet')")
    wanted = con.execute(sql)
    names = [d[0] for d in wanted.description]
    found = __spark_entry__.queries()[name](spark, small)
    assert sorted(found.columns) == sorted(names)
    wanted = wanted.fetchall()
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in found.select(*names).collect()) and wanted


def test_no_operator_writes_outside_the_shared_folder(spark):
    from tessera.llm import common

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    made = common.materialize(spark.range(3), "t")
    assert os.path.isdir(f"{shared}/tessera") and made.count() == 3 and made._tessera_path.startswith(common.tables_dir(spark))
    other = common.materialize(spark.range(4), "t", instead_of=made)
    assert not os.path.exists(made._tessera_path.removeprefix("file://")) and other.count() == 4


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tessera.llm import common

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="share"):
        common.shared_dir(session)
    context.getCheckpointDir = lambda: "hdfs://shared/x/"
    assert common.shared_dir(session) == "hdfs://shared/x"
