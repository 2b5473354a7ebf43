"""The pipeline's stages against what each operator's own results say."""

import corpus_pipeline
from lodestone.llm import decontaminate, langid, neardup, quality
from lodestone.llm.packing import default_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_every_stage_on_its_predecessor(spark, sf_small):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_dedup", "benchmark_decontamination", "packing"]

    told = stages[0](spark, docs, sf_small).cache()
    pred = langid.predict(docs, langid.fit(docs))
    assert told.columns == COLUMNS and ids(told) == ids(pred.where("lang_pred <> 'und' AND score >= 0.3"))

    good = stages[1](spark, told, sf_small).cache()
    graded = quality.grade(told, quality.fit(told, spark.read.parquet(f"{sf_small}/labels.parquet")))
    assert good.columns == COLUMNS and ids(good) == ids(graded.where("p_good >= 0.5")) and good.count() < told.count()

    once = stages[2](spark, good, sf_small).cache()
    assert once.columns == COLUMNS and ids(once) == ids(neardup.near_duplicates(good, 5).where("kept")) and once.count() == len(ids(once))

    kept = stages[3](spark, once, sf_small).cache()
    bad = ids(decontaminate.matches(once, spark.read.parquet(f"{sf_small}/benchmark.parquet")))
    assert kept.columns == COLUMNS and ids(kept) == ids(once) - bad

    packed = stages[4](spark, kept, sf_small).collect()
    tok = Tokenizer.from_file(default_vocabulary())
    want = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept.collect()}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_small).collect()} == set(want)


def test_nulls_repeats_and_clashing_columns(spark, sf_small):
    """Null and repeated doc_ids and extra columns named like the operators' own pass through all stages."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    first = docs.first()
    more = spark.createDataFrame([(None, first["text"], "en", "s", 1), (first["doc_id"], first["text"], "en", "s", 1), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, " \n", None, "s", 2)], docs.schema)
    docs = docs.unionByName(more).selectExpr("*", "1 AS rep", "2 AS label", "3 AS grade", "4 AS bad_id", "5 AS gone_id", "6 AS item_id")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_small).cache()
        assert docs.columns == names, name
        if name == "language_id":
            assert not ids(docs) & {10**9, 10**9 + 1, 10**9 + 2}
    kept = [r["doc_id"] for r in docs.collect()]
    assert len([i for i in kept if i is not None]) == len({i for i in kept if i is not None}) > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect()
    assert {r["doc_id"] for r in pieces} == set(kept)


def test_corpus_without_languages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(20).selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN '12 !' ELSE text END AS text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")
    kept = corpus_pipeline.language_id(spark, docs, sf_small)
    assert kept.columns == docs.columns and kept.count() == docs.where("doc_id % 5 <> 0").count()


def test_empty_corpus(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
        assert docs.collect() == []
        if docs.columns != COLUMNS:
            break
