import corpus_pipeline
from dwell.llm import quality_classifier as Q
from dwell.llm import simhash
from dwell.llm import toxicity as T

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "simhash_near_dedup", "packing"]
    ids = {r.doc_id for r in docs.collect()}

    clean = corpus_pipeline.toxic(spark, docs, SF).cache()
    of = T.Scorer(T.train(docs, labels))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if of(r.text) < T.THRESHOLD}

    good = corpus_pipeline.quality(spark, clean, SF).cache()
    model, grams = Q.train(clean, labels), Q.Grams()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in clean.collect() if model.score(grams(r.text)) >= Q.THRESHOLD}

    one = corpus_pipeline.near_duplicates(spark, good, SF).cache()
    parts = {r.doc_id: r.component_id for r in simhash.near_duplicates(good).collect()}
    assert {r.doc_id for r in one.collect()} == {d for d, c in parts.items() if d == c}
    assert clean.columns == good.columns == one.columns == docs.columns

    packed = corpus_pipeline.pack(spark, one, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in one.collect()} <= ids
    assert {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.start, r.ids_crc32) for r in packed.collect()}


def test_an_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF) if _ == "packing" else stage(spark, docs, SF).cache()
        assert docs.count() == 0
