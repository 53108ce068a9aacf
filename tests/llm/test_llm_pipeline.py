"""The pipeline's stages against brute force on their own input."""

import corpus_pipeline
import pytest
from test_llm_operators import contamination_truth, jaccard_truth

from skillweft.llm.common import workspace


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out, work = spark.read.parquet(f"{sf}/documents.parquet"), [], workspace(spark, "t")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{work}/{k}")
        now = spark.read.parquet(f"{work}/{k}")
        out.append((docs, now))
        docs = now
    return out


def test_columns_stay(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "packing"]
    for before, after in stages[:-1]:
        assert before.columns == after.columns


def test_clean_documents_stay(stages):
    before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    gone = [r for r in before.collect() if r.doc_id not in kept]
    assert len(gone) <= 0.03 * before.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    truth = jaccard_truth([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {c for _, c, _ in truth}
    assert after.count() == len({c for _, c, _ in truth})


def test_contaminated_documents_go(spark, stages, sf):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    truth = contamination_truth([(r.doc_id, r.text) for r in before.collect()], items)
    assert {r.doc_id for r in after.collect()} == {x[0] for x in truth if not x[-1]}


def test_all_documents_are_packed(stages):
    before, after = stages[3]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_repeated_and_null_ids(spark, sf):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (3, "other words are here too", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.one_of_each(spark, docs, sf).collect()) == [0, 1, 3]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    odd = docs.unionByName(spark.createDataFrame([(None, item, "en", "s", 1), (3, f"x {item}", "en", "s", 1)], docs.schema))
    assert sorted(map(tuple, corpus_pipeline.clean(spark, odd, sf).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.one_of_each(spark, odd, sf).collect())[:3] == [0, 1, 3]
    assert corpus_pipeline.language(spark, docs.limit(0), sf).collect() == []
    assert corpus_pipeline.packed(spark, docs.limit(0), sf).collect() == []


def test_clashing_columns_are_packed(spark, sf):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, 7, "x"), (2, None, None, None, 0, 8, "y")], "doc_id long, text string, lang string, source string, n_chars long, start int, sequence_id string")
    got = corpus_pipeline.packed(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.start, r.sequence_id) for r in got) == [(1, 0, 0), (2, 0, 0)]


def test_very_long_texts_pass_all_stages(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first().text
    long = "some words of a very long text " * 40_000
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + "end", "en", "s", 1), (3, long + item, "en", "s", 1), (4, "short one", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(corpus_pipeline.language(spark, docs, sf).collect()) == 4
    kept = corpus_pipeline.one_of_each(spark, docs.where("doc_id <> 3"), sf)
    truth = jaccard_truth([(r.doc_id, r.text) for r in docs.where("doc_id <> 3").collect()])
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {c for _, c, _ in truth}
    assert sorted(r.doc_id for r in corpus_pipeline.clean(spark, docs, sf).select("doc_id").collect()) == [1, 2, 4]
