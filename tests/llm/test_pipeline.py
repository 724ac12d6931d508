import corpus_pipeline
import pyarrow as pa
import pytest
from fleetbump.llm import exact_dedup, near_dedup, queries
from fleetbump.session import BATCH_BYTES, bounded_batches

SMALL = "/root/testdata/sf0.001"


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert 0 < out.count() <= docs.count()
        assert out.select("doc_id").distinct().count() == out.count()


def test_run_packs_what_is_kept(spark):
    packed = corpus_pipeline.run(spark, SMALL)
    kept = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where(f"doc_id in ({','.join(map(str, kept))})")
    assert exact_dedup.groups(docs).where("group_size > 1").count() == 0
    assert near_dedup.near_classes(docs).where("class_nodes > 1").count() == 0


def test_stages_hand_long_texts_to_workers_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    for module, name in (("toxicity", "train"), ("toxicity", "keep_clean"), ("exact_dedup", "keep_one"), ("near_dedup", "keep_one"), ("decontaminate", "keep_clean"), ("packing", "pack")):
        monkeypatch.setattr(getattr(corpus_pipeline, module), name, lambda docs, *rest: docs)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, str(64 << 20))
            stage(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
            long = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) AS text")
            found = [r.bytes for r in long.mapInArrow(sizes, "bytes long").collect()]
            assert sum(found) >= 20_000_000 and max(found) <= BATCH_BYTES + 200_000, name
        spark.conf.set(key, "1000")
        bounded_batches(spark)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, was)


# Rows of each query by rows of its table: one for each, except where it says otherwise.
OF_PAGES = {"op6_html_text", "op7_url_filter"}
SEVERAL = {"op3_best_fit_packing": 1, "op12_whitening": 8}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_its_rows(spark, name):
    table = "pages" if name in OF_PAGES else "embeddings" if name == "op12_whitening" else "documents"
    given = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    found = queries.QUERIES[name](spark, SMALL).count()
    if name == "op9_decontamination":
        assert 0 < found
    else:
        assert found >= SEVERAL[name] * given if name in SEVERAL else found == given
