import corpus_pipeline as pipeline

from weftline.llm import neardup
from weftline.llm.queries import queries


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = docs.count()
        docs = pipeline.keep(spark, stage(spark, docs, sf_dir), name)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "near_dedup":
            assert docs.count() < before and neardup.near_duplicates(docs, 80).filter("not kept").count() == 0
        if name in ("personal_data", "sentencepiece"):
            assert docs.count() == before
    assert docs.filter("not round_trip").count() == 0
    assert pipeline.run(spark, sf_dir).count() == docs.count()


def test_stages_on_odd_documents(spark, sf_dir, odd_docs, make_docs):
    """Nulls, empty and very long texts, repeated rows, an extra column and an empty table go through every stage."""
    extra = odd_docs.selectExpr("*", "7 as raw", "'x' as item_ids")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    docs = extra.unionByName(make_docs((20, "Some words here. " + bench, "en"), (21, "call +1 (415) 555-7766 or a.b@c.de now", "en")).selectExpr("*", "7 as raw", "'x' as item_ids"))
    kept = {name: stage(spark, docs, sf_dir) for name, stage in pipeline.STAGES}
    for name in ("language_id", "near_dedup", "decontamination", "personal_data"):
        assert kept[name].columns == docs.columns
    ids = lambda name: sorted((r.doc_id for r in kept[name].select("doc_id").collect() if r.doc_id is not None))
    assert not {1, 2, 3} & set(ids("language_id"))
    assert ids("near_dedup") == [1, 2, 3, 4, 4, 5, 6, 7, 20, 21]
    assert 20 not in ids("decontamination") and kept["decontamination"].count() == docs.count() - 1
    masked = {r.doc_id: r for r in kept["personal_data"].collect()}
    assert masked[21].text == "call [PHONE] or [EMAIL] now" and masked[1].text is None and len(masked) == 10
    assert kept["sentencepiece"].filter("not round_trip").count() == 0 and kept["sentencepiece"].count() == docs.count()
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_all_operators_have_a_query():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
